"""Order keys that are missing or tie, links and markers that only look right, and sinks run twice."""

from collections import Counter

from pyspark.sql import functions as F

from shelfspark.functions import markup as M
from shelfspark.functions import nested as N
from shelfspark.operators import dedupe as D
from shelfspark.operators import pages as H
from shelfspark.plans.catalog import build_catalog, build_catalog_from_links
from shelfspark.plans.ingest import run_ingest
from shelfspark.schema import CATALOG_SCHEMA, to_canonical
from shelfspark.sources import codec, readers, writers

ROWS = [("a", None, "x"), ("a", None, "x"), ("a", 2, "y"), ("b", None, "z"), ("b", None, "w"), ("c", 1, ""), ("c", 1, "q"),
        (None, 1, "n"), (" ", 1, "m"), ("e", 5, "1"), ("e", 5, "1")]


def frame(spark):
    return spark.createDataFrame(ROWS, "id string, ord int, doc string").repartition(3)


def test_one_row_per_id_is_accepted_and_every_other_has_a_reason(spark):
    flagged = D.with_reject_reason(frame(spark), "id", "ord", "doc").collect()
    assert Counter((r["id"], r["ord"], r["doc"]) for r in flagged) == Counter(ROWS)
    claims = Counter(r["id"] for r in flagged if r["reason"] in (None, D.EMPTY))
    assert claims == {"a": 1, "b": 1, "c": 1, "e": 1}
    assert [r["doc"] for r in flagged if r["id"] == "a" and r["reason"] is None] == ["y"]
    assert Counter(r["reason"] for r in flagged)[D.MISSING] == 2


def test_first_and_latest_take_whole_rows(spark):
    first = {r["id"]: tuple(r) for r in D.keep_first(frame(spark), "id", ["ord"]).collect()}
    last = {r["id"]: tuple(r) for r in D.keep_latest(frame(spark), "id", ["ord"]).collect()}
    assert set(first) == set(last) == {"a", "b", "c", "e", None, " "}
    assert set(first.values()) | set(last.values()) <= set(ROWS)
    assert first["a"] == last["a"] == ("a", 2, "y")
    assert D.keep_first(frame(spark), "id", ["ord"]).count() == 6


def test_many_first_rows_are_not_gathered(spark, monkeypatch):
    monkeypatch.setattr(D, "FIRST_IN_ONE_TASK", 10)
    df = spark.range(500).select(F.pmod(F.col("id") * 7, F.lit(500)).alias("k")).repartition(6)
    for n in (11, 137, 499, 500, 900):
        assert sorted(r["k"] for r in D.first_n(df, n, ["k"]).collect()) == list(range(min(n, 500)))


def test_history_of_missing_ids_and_of_one_hour(spark):
    rows = [(None if i % 2 else "p", f"2024-01-01 00:{i % 60:02d}:00", i, float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "id string, t string, n int, price double").withColumn("t", F.col("t").cast("timestamp_ntz"))
    got = {r["n"]: r["previous_price"] for r in D.price_history(df, "id", "t", "price", ["n"]).collect()}
    for key in (None, "p"):
        line = sorted((t, n) for i, t, n, _ in rows if i == key)
        assert [got[n] for _, n in line] == [None] + [float(n) for _, n in line[:-1]]


def test_links_and_embedded_json_that_only_look_right(spark):
    html = spark.createDataFrame(
        [("""<a data-x="a>b" href="/x?a=1&#38;b=2&#x2F;c">t</a><a HREF='/y&amp;#38;'>u</a><a data-href="no">z</a>"""
          """<a class=k href=/z/q>w</a><abbr href="n"><a href>x</a><a  title='href="n"' href = "&#233;&#x1F600;&#99999999;">""",)], "h string")
    assert html.select(M.link_hrefs(F.col("h"))).first()[0] == ["/x?a=1&b=2/c", "/y&#38;", "/z/q", "é😀&#99999999;"]
    pages = spark.createDataFrame(
        [(1, """<!-- <script id="X">{"a":0}</script> --><script data-id="Xx">{"a":1}</script><script>var x="<!--";</script>"""
             """<script type="j" id='X'>{"a":"<!-- 2 -->"}</script>"""), (2, '<script id="Xx">{"a":3}</script>')], "i int, h string")
    found = pages.select("i", M.embedded_json(F.col("h"), "X").cast("string").alias("j"))
    assert {r["i"]: r["j"] for r in found.collect()} == {1: '{"a":"<!-- 2 -->"}', 2: None}


def test_frontier_of_unreadable_and_many_pages(spark):
    rows = [(1, "https://x/", "page 1 of 99999999999999999999999"), (2, "https://x/", "page 1 of 3"), (3, "https://x/", "page 5 of 25010")]
    found = H.page_frontier(spark.createDataFrame(rows, "page_id int, url string, position_text string"), ["page_id"])
    assert {r[0]: r[1:] for r in found.groupBy("page_id").agg(F.count("page"), F.min("page"), F.max("page")).collect()} == {
        2: (2, 2, 3), 3: (25005, 6, 25010)}


def test_no_time_is_no_text(one):
    assert one(N.time_to_iso(F.lit(None).cast("timestamp_ntz"))) == (None,)



def test_pages_to_collection(spark, tmp_path):
    """Pages to catalog to snapshot to collection, in line, with every column of the record."""
    from shelfspark import site as S

    card = f'<div data-test="{S.CARD_WRAPPER}"><a data-test="{S.CARD_TITLE}" href="/p/x/-/A-{{0}}">T{{0}}</a></div>'
    listing = spark.createDataFrame([(p, card.format(i), f"2024-01-0{p} 00:00:00") for p in (1, 2) for i in [p]] + [(3, card.format(1), None)],
                                    "page_id int, html string, scraped_at string").withColumn("scraped_at", F.col("scraped_at").cast("timestamp_ntz"))
    detail = spark.createDataFrame([("https://none/", 1, "<h1>other</h1>"), ("https://none/", 2, "<h1>other</h1>")], "url string, page_id int, html string")
    built = build_catalog(listing, detail)
    assert built.select("in_stock", "fulfillment_info").distinct().collect() == [(True, "")]
    rows = to_canonical(built)
    assert rows.columns == CATALOG_SCHEMA.names and len(rows.columns) == 31
    writers.write_snapshot(rows.withColumn("run_ts", F.lit("2024-02-01").cast("timestamp_ntz")), str(tmp_path / "runs"))
    writers.write_snapshot(rows.withColumn("run_ts", F.lit("2024-02-01").cast("timestamp_ntz")), str(tmp_path / "runs"))
    back = readers.read_snapshots(spark, str(tmp_path / "runs/json"))
    assert back.count() == 3
    lines = str(tmp_path / "rows.jsonl")
    writers.write_jsonl(codec.to_file_rows(rows), lines)
    for _ in range(2):
        path, rejects = run_ingest(spark, lines, collection="c", collection_root=str(tmp_path / "roots"), use_images=False)
        stored = spark.read.parquet(path)
        assert sorted(r["id"] for r in stored.collect()) == ["1", "2"]
        assert [tuple(r) for r in rejects.collect()] == [("1", D.DUPLICATE)]


def test_details_are_pruned_before_they_are_read(spark):
    pages = spark.createDataFrame([(1, '<a href="/p/x/-/A-1">t</a>')], "page_id int, html string")
    products = spark.createDataFrame([("u", 1, "<h1>x</h1>")], "url string, page_id int, html string")
    plan = build_catalog_from_links(pages, products)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.split("\n")
    arrow = next(i for i, line in enumerate(lines) if "MapInArrow" in line)
    assert any("LeftSemi" in line for line in lines[arrow:])
    assert "min_by" not in plan


def test_a_batch_reads_only_its_buckets(spark, tmp_path):
    path = str(tmp_path / "c")
    rows = spark.range(200).select(F.col("id").cast("string").alias("id"), F.lit("d").alias("document"))
    writers.add_to_collection(rows, path)
    writers.add_to_collection(rows.filter("id = '7'"), path)
    assert spark.read.parquet(path).count() == 200
    held = writers.read_collection(spark, path, rows.schema).filter(F.col(writers.BUCKET).isin([3]))
    assert "PartitionFilters: [_bucket" in held._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).replace("isnotnull(_bucket#", "_bucket#").replace("[(", "[")
