"""Dedup, history, merge, unions, limits and quality against brute force, also under skew."""

import random

import pytest
from pyspark.sql import functions as F

from shelfspark import session
from shelfspark.operators import analytics as A
from shelfspark.operators import dedupe as D
from shelfspark.operators import merge as J
from shelfspark.operators import quality as Q
from shelfspark.operators import skew as K
from shelfspark.plans.ingest import prepare


def products(n=900, seed=5):
    """A third of the rows share one id; some ids are missing, some documents empty."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        pid = "hot" if i % 3 == 0 else rng.choice(["", "  ", None, *map(str, range(200))])
        rows.append((pid, rng.choice(["", "Bag", " Tote "]), rng.choice([None, "", "Acme"]), float(i), i))
    return rows


COLUMNS = "product_id string, title string, brand string, price double, ord long"


def brute_reasons(rows):
    seen, out = set(), {}
    for pid, title, brand, _, o in rows:
        pid = (pid or "").strip()
        if not pid:
            out[o] = D.MISSING
        elif pid in seen:
            out[o] = D.DUPLICATE
        else:
            seen.add(pid)
            doc = " ".join(x.strip() for x in (title, brand) if x and x.strip())
            out[o] = None if doc else D.EMPTY
    return out


def test_reject_reasons_with_a_hot_id_in_any_row_order(spark):
    rows = products()
    want = brute_reasons(rows)
    for seed in (1, 2):
        shuffled = rows[:]
        random.Random(seed).shuffle(shuffled)
        flagged = prepare(spark.createDataFrame(shuffled, COLUMNS), "ord")
        assert {r.ord: r.reason for r in flagged.collect()} == want
    counts = {r.reason: r.n for r in D.reason_counts(flagged).collect()}
    assert sum(counts.values()) == len(rows) and counts["accepted"] == sum(v is None for v in want.values())
    assert D.accepted(flagged).count() + D.rejected(flagged).count() == len(rows)


def test_reject_reasons_with_tie_breaks(spark):
    rows = [("a", "late", 2, 1), ("a", "first", 1, 1), ("a", "tied", 1, 2), ("b", "", 1, 1), ("b", "x", 1, 2)]
    df = spark.createDataFrame(rows, "product_id string, title string, at int, place int")
    flagged = prepare(df, ["at", "place"])
    got = {(r.id, r.at, r.place): r.reason for r in flagged.collect()}
    assert got == {
        ("a", 2, 1): D.DUPLICATE, ("a", 1, 1): None, ("a", 1, 2): D.DUPLICATE, ("b", 1, 1): D.EMPTY, ("b", 1, 2): D.DUPLICATE,
    }


def test_first_and_latest_in_any_row_order(spark):
    rows = [r for r in products() if r[0] and r[0].strip()]
    first, last = {}, {}
    for r in rows:
        first.setdefault(r[0], r)
        last[r[0]] = r
    random.Random(9).shuffle(rows)
    df = spark.createDataFrame(rows, COLUMNS)
    assert {tuple(r) for r in D.keep_first(df, "product_id", ["ord"]).collect()} == set(first.values())
    assert {tuple(r) for r in D.keep_latest(df, "product_id", ["ord"]).collect()} == set(last.values())
    assert [tuple(r) for r in D.first_n(df, 7, ["ord"]).collect()] == sorted(rows, key=lambda r: r[4])[:7]
    assert D.first_n(df, None, ["ord"]).count() == len(rows)
    assert D.first_n(df, 0, ["ord"]).count() == len(rows)
    assert D.first_n(df, 0, ["ord"], zero_means_all=False).count() == 0
    assert D.first_n(df, 10**6, ["ord"]).count() == len(rows)


def test_price_history_splits_hot_products(spark):
    rng = random.Random(4)
    rows = []
    for i in range(1500):
        pid = "hot" if i % 3 == 0 else f"p{rng.randrange(300)}"
        rows.append((pid, rng.randrange(60), rng.randrange(9), i, float(rng.randrange(50))))
    last, want = {}, {}
    for pid, day, tie, i, price in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3])):
        want[i] = last.get(pid)
        last[pid] = price
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id string, day int, tie int, i long, price double").withColumn(
        "at", F.expr("timestamp_ntz '2024-01-01' + make_dt_interval(day)")
    )
    history = D.price_history(df, "id", "at", "price", ["tie", "i"])
    assert {r.i: r.previous_price for r in history.collect()} == want
    assert [r[0] for r in K.hot_keys(df, "id", 4, 0).collect()] == ["hot"]
    assert K.hot_keys(df, "id", 200, 0).count() < 200 and K.hot_keys(df, "id").count() == 0


def test_before_marker_rows(spark):
    rows = [(k, i, "stop" if (k, i) in {("a", 3), ("a", 5), ("c", 0)} else "go") for k in "abc" for i in range(7)]
    df = spark.createDataFrame(rows, "k string, i int, t string")
    got = D.before_marker_rows(df, "k", "i", F.col("t") == "stop").groupBy("k").count().collect()
    assert {r.k: r["count"] for r in got} == {"a": 3, "b": 7}


def test_merge_rules(spark):
    listing = spark.createDataFrame(
        [
            ("u1", "T1", "listed", 5.0, ["x"], 10),
            ("u1", "T1b", "listed", 6.0, [], 20),
            ("u2", "T2", "listed", 7.0, ["x"], 30),
            ("u9", "T9", "listed", 8.0, ["x"], 40),
            ("", "T0", "listed", 9.0, ["x"], 50),
        ],
        "url string, title string, description string, price_current double, colors array<string>, discount_percent int",
    )
    detail = spark.createDataFrame(
        [("u1", "D1", "", 0.0, ["", ""]), ("u2", "D2", "better", 1.5, []), ("", "D0", "wrong", 3.0, ["w"])],
        "url string, title string, description string, price_current double, colors array<string>",
    )
    got = {r.title: r for r in J.merge_adv(listing, J.one_per_key(detail, "url")).collect()}
    assert len(got) == 5
    assert (got["T1"].description, got["T1"].price_current, got["T1"].colors) == ("listed", 5.0, ["", ""])
    assert (got["T2"].description, got["T2"].price_current, got["T2"].colors) == ("better", 1.5, ["x"])
    assert got["T9"].description == "listed" and got["T0"].description == "listed"
    assert got["T2"].discount_percent == 30  # stale by rule


def test_one_per_key_keeps_rows_single(spark):
    df = spark.createDataFrame([("u", 2, "b"), ("u", 1, "z"), ("v", 1, "c")], "url string, at int, x string")
    assert {tuple(r) for r in J.one_per_key(df, "url", ["at"]).collect()} == {("u", 1, "z"), ("v", 1, "c")}


def test_hot_join_key_is_split(spark, tmp_path):
    """With a third of the listing on one URL, AQE splits that partition of the left join."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        url = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("u"), F.col("id").cast("string")))
        # several map tasks: a skewed partition is split along them
        listing = spark.range(0, 60000, 1, 16).select(url.alias("url"), F.lit("l").alias("description"), F.sha2(F.col("id").cast("string"), 256).alias("pad"))
        detail = listing.select("url").distinct().withColumn("description", F.lit("d"))
        merged = J.merge_adv(listing, detail)
        rows = merged.collect()
        assert len(rows) == 60000 and all(r.description == "d" for r in rows)
        assert "skew=true" in merged._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_unions(spark):
    a = spark.createDataFrame([(1, "x")], "id int, early string")
    b = spark.createDataFrame([(2, "y")], "id int, later string")
    assert {tuple(r) for r in D.union_runs(a, b).select("id", "early", "later").collect()} == {(1, "x", None), (2, None, "y")}
    assert D.same_rows(D.union_all(a, a), a).count() == 1
    with pytest.raises(Exception):
        D.union_all(a, b)


def test_quality(spark):
    df = spark.createDataFrame(
        [("1", "5", 4.5, "https://x", "2024-01-01"), ("1", "0", 5.1, "http://x", "soon"), ("", None, None, None, None)],
        "product_id string, price string, rating double, url string, at string",
    )
    checks = Q.row_checks(
        df,
        {
            "price": Q.bad_price(F.col("price")),
            "rating": Q.bad_rating(F.col("rating")),
            "url": Q.bad_url(F.col("url")),
            "time": Q.bad_time(F.col("at")),
        },
    )
    assert {r.check: (r.n_rows, r.n_bad) for r in checks.collect()} == dict.fromkeys(("price", "rating", "url", "time"), (3, 2))
    assert Q.duplicate_ids(df).first().n_bad == 1
    assert tuple(Q.duplicate_rows(D.union_all(df, df)).first())[1:] == (6, 3)
    paths = spark.createDataFrame([("A > B > C",), ("A > B > D",), ("X > C",)], "category_breadcrumb string")
    assert tuple(Q.breadcrumb_hierarchy(paths).first())[1:] == (5, 1)
    assert tuple(Q.duplicate_rows(df.filter("false")).first())[1:] == (0, 0)


def test_completeness_and_means(spark):
    df = spark.createDataFrame([("a", 1.1, None), ("", 2.2, "x"), (None, 3.3, "y")], "t string, price_current double, m string")
    got = {r.field: r.n_present for r in A.completeness(df).collect()}
    assert got == {"t": 1, "price_current": 3, "m": 2}
    assert A.mean_price(df).first().mean_price == pytest.approx(2.2)
    assert A.completeness(df.filter("false")).first().share is None


def test_session_needs_a_shared_folder_on_a_cluster(spark):
    assert session.scratch(spark, "a") != session.scratch(spark, "a")
    assert session.scratch(spark, "a").startswith(session.shared_dir(spark))


def test_prices_that_are_not_finite_are_bad(spark):
    prices = [("1.5", False), ("0", True), ("-1", True), ("NaN", True), ("Infinity", True), ("-Infinity", True), ("x", True), (None, True)]
    df = spark.createDataFrame(prices, "p string, bad boolean")
    assert df.filter(Q.bad_price(F.col("p")) != F.col("bad")).count() == 0
    assert df.select(Q.bad_price(F.col("p").try_cast("double")).alias("b"), "bad").filter("b <> bad").count() == 0


def test_duplicate_rows_whose_digests_clash(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(rng.choice([None, "a", "b"]), rng.choice([None, 1.0, 2.0]), {"k": rng.choice([None, "x"])}) for _ in range(300)]
    df = spark.createDataFrame(rows, "a string, digest double, n map<string, string>").repartition(4)
    rows = {(a, d, n["k"]) for a, d, n in rows}
    want = [("duplicate_rows", 300, 300 - len(rows))]
    assert [tuple(r) for r in Q.duplicate_rows(df).collect()] == want
    # every row meets every other
    monkeypatch.setattr(Q, "row_digest", lambda df: F.lit(7))
    assert [tuple(r) for r in Q.duplicate_rows(df).collect()] == want
    assert [tuple(r) for r in Q.duplicate_rows(df.limit(0)).collect()] == [("duplicate_rows", 0, 0)]


def test_rows_that_are_alone_do_not_move(spark):
    """Counting wide rows shuffles digests alone."""
    wide = spark.range(2000).select("id", F.repeat(F.lit("x"), 2000).alias("pad"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("digests", "")
    assert Q.duplicate_rows(wide).first()["n_bad"] == 0
    stages = [s for j in tracker.getJobIdsForGroup("digests") for s in tracker.getJobInfo(j).stageIds]
    store = spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    moved = [store.lastStageAttempt(s).shuffleWriteBytes() for s in stages]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < sum(moved) < 400_000
