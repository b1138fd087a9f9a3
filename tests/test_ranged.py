"""Neighbours and ranks over several ranges: hot ids, one hot instant, equal rows, clashing names."""

import random
from collections import Counter
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import dedupe as D
from shelfspark.operators import ranged as R


@contextmanager
def many_ranges(spark):
    """Small ranges stay apart, as large ones do."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.unset(name)


def ranges_of(spark, run):
    """How many rows each range of the last written scan held."""
    seen = []
    written = R._written

    def noted(df, label):
        out = written(df, label)
        seen.append(Counter(r["range"] for r in out.select("range").collect()))
        return out

    R._written = noted
    try:
        return run(), seen[-1]
    finally:
        R._written = written


def test_history_of_one_instant_is_dealt_over_ranges(spark):
    """One id, and one time of it, hold nearly all rows: ranges stay even and prices are carried over."""
    rng = random.Random(3)
    rows = [(None if i % 50 == 0 else "hot", 7 if i % 20 else i, i, rng.random()) for i in range(2000)]
    df = spark.createDataFrame(rows, "id string, at int, tie int, price double").repartition(5)
    with many_ranges(spark):
        found, held = ranges_of(spark, lambda: D.price_history(df, "id", "at", "price", ["tie"]).collect())
    assert len(held) == 8 and max(held.values()) < 600
    last, want = {}, {}
    for i, at, tie, price in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        want[tie] = last.get(i)
        last[i] = price
    assert {r["tie"]: r["previous_price"] for r in found} == want
    assert all(r["price_change"] == (None if want[r["tie"]] is None else r["price"] - want[r["tie"]]) for r in found)


def test_equal_rows_of_one_id_are_dealt_over_ranges(spark):
    rows = [("a", 1, "x")] * 1500 + [("b", 1, ""), ("b", 2, "y"), (None, 0, "z"), ("", 0, "z")]
    df = spark.createDataFrame(rows, "id string, ord int, doc string").repartition(6)
    with many_ranges(spark):
        found, held = ranges_of(spark, lambda: D.with_reject_reason(df, "id", "ord", "doc").collect())
    assert max(held.values()) < 600
    assert Counter((r["id"], r["ord"], r["doc"], r["reason"]) for r in found) == Counter(
        {("a", 1, "x", None): 1, ("a", 1, "x", D.DUPLICATE): 1499, ("b", 1, "", D.EMPTY): 1, ("b", 2, "y", D.DUPLICATE): 1,
         (None, 0, "z", D.MISSING): 1, ("", 0, "z", D.MISSING): 1})


def test_names_of_the_input_are_its_own(spark):
    """Columns named like working columns, and like parts of a path, come back untouched."""
    columns = "key string, row int, value int, range int, same int, before int, head int, tail int, tie int, number int, s0 int, `a.b` int, _at int"
    rows = [("k", 1, i, 3, 4, 5, 6, 7, 8, 9, 10, 11, i) for i in (2, 1, 3)]
    df = spark.createDataFrame(rows, columns)
    assert [tuple(r) for r in D.keep_first(df, "key", ["_at"]).collect()] == [rows[1]]
    assert [tuple(r) for r in D.keep_latest(df, "key", ["_at"]).collect()] == [rows[2]]
    assert {tuple(r)[:-1]: r["reason"] for r in D.with_reject_reason(df, "key", "_at", "key").collect()} == {
        rows[0]: D.DUPLICATE, rows[1]: None, rows[2]: D.DUPLICATE}
    assert {r["value"]: r["previous_price"] for r in D.price_history(df, "key", "_at", "a.b", ["tie"]).collect()} == {1: None, 2: 11, 3: 11}


def test_rank_is_a_row_number_over_ranges(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, 1, 2, 2, 2]), rng.choice("ab"), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "page int, url string, i int").repartition(7)
    with many_ranges(spark):
        ranked, held = ranges_of(spark, lambda: R.with_rank(df, ["page", "url", "i"], "place"))
        found = ranked.collect()
    assert len(held) == 8 and max(held.values()) < 900
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    assert [tuple(r)[:3] for r in sorted(found, key=lambda r: r["place"])] == want
    assert sorted(r["place"] for r in found) == list(range(1, 3001))
    assert "Window" not in ranked._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        R.with_rank(df, ["page"], "url")
    assert R.with_rank(df.limit(0), ["page"], "place").count() == 0


def test_empty_input_and_nested_columns(spark):
    df = spark.createDataFrame([("a", {"x": [1]}, 1), ("a", {"x": [2]}, 0), ("a", None, 0)], "id string, m map<string, array<int>>, ord int")
    assert D.keep_first(df, "id", ["ord"]).first()["ord"] == 0
    flagged = D.with_reject_reason(df, "id", "ord", "id").collect()
    assert Counter(r["reason"] for r in flagged) == {None: 1, D.DUPLICATE: 2}
    for out in (D.keep_first(df.limit(0), "id", ["ord"]), D.with_reject_reason(df.limit(0), "id", "ord", "id")):
        assert out.count() == 0


def test_first_and_latest_read_once_and_shuffle_once(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("id"), F.col("id").alias("ord"))
    for kept in (D.keep_first(df, "id", ["ord"]), D.keep_latest(df, "id", ["ord"])):
        plan = kept._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("Range (") == 1 and "Join" not in plan and "Window" not in plan
        assert kept._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
