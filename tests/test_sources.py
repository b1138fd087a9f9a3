"""Readers, sinks, round trips, the ingest job and arriving files."""

import json
import os

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfspark import schema
from shelfspark.operators import embed as E
from shelfspark.operators.dedupe import same_rows
from shelfspark.plans.ingest import embed, prepare, run_ingest
from shelfspark.sources import codec, readers, writers
from shelfspark.streaming.arrivals import ingest_arrivals

RECORDS = [
    {"product_id": "1", "title": 'Bag "big", red', "price_current": 10.5, "is_new": True, "description": "two\nlines ", "highlights": ""},
    {"product_id": "2", "title": "Täsche", "price_current": 0.0, "rating_count": 3, "images": "https://a/1.jpg|https://b"},
]


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


@pytest.mark.parametrize(
    "doc, n",
    [
        (RECORDS, 2),
        ({"products": RECORDS}, 2),
        ({"products": []}, 0),
        (RECORDS[0], 1),
    ],
)
def test_json_forms(spark, tmp_path, doc, n):
    rows = readers.read_json(spark, write(tmp_path / "a.json", json.dumps(doc, indent=2))).collect()
    assert len(rows) == n
    assert all(len(r) == 31 for r in rows)


def test_jsonl_skips_blank_lines_and_fails_on_bad_ones(spark, tmp_path):
    good = "\n".join(["", json.dumps(RECORDS[0]), "   ", json.dumps(RECORDS[1]), ""])
    assert readers.read_jsonl(spark, write(tmp_path / "a.jsonl", good)).count() == 2
    bad = readers.read_jsonl(spark, write(tmp_path / "b.jsonl", good + "\n{oops"))
    with pytest.raises(Exception):
        bad.collect()


def test_csv_is_text(spark, tmp_path):
    path = write(tmp_path / "a.CSV", 'product_id,title,note\n1,"a ""q"", b","x\ny"\n2,,""\n')
    assert [tuple(r) for r in readers.read_products(spark, path).collect()] == [("1", 'a "q", b', "x\ny"), ("2", "", "")]


def test_suffix_and_missing_file(spark, tmp_path):
    with pytest.raises(ValueError, match="Unsupported format"):
        readers.read_products(spark, str(tmp_path / "a.xml"))
    with pytest.raises(ValueError, match="Unsupported format"):
        readers.read_products(spark, str(tmp_path / "noending"))
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        readers.read_products(spark, str(tmp_path / "none.jsonl"))


def typed(spark):
    rows = spark.createDataFrame(
        [("1", ["Red", "Blue"], {"a": "1", "ß": 'q"'}, " x \n"), ("2", [], {}, ""), ("3", None, None, None)],
        "product_id string, colors array<string>, dimensions map<string,string>, description string",
    )
    return rows.withColumn("scraped_at", F.expr("timestamp_ntz '2026-02-20 14:30:45.5'"))


def test_nested_round_trip(spark):
    back = codec.from_file_rows(codec.to_file_rows(typed(spark)), ("colors",), ("dimensions",))
    got = {r.product_id: r for r in back.collect()}
    assert (got["1"].colors, got["1"].dimensions) == (["Red", "Blue"], {"a": "1", "ß": 'q"'})
    assert (got["2"].colors, got["3"].dimensions) == ([], {})
    assert str(got["1"].scraped_at) == "2026-02-20 14:30:45.500000"


@pytest.mark.parametrize("form", ["json", "jsonl", "csv", "documents", "wrapped"])
def test_round_trips(spark, tmp_path, form):
    rows = codec.to_file_rows(typed(spark)).withColumn("description", F.coalesce("description", F.lit("")))
    path = str(tmp_path / "out")
    if form == "csv":
        assert writers.write_csv(rows, path)
        back = readers.read_csv(spark, path)
    elif form in ("documents", "wrapped"):
        writers.write_json_documents(rows, path, "products" if form == "wrapped" else None)
        back = readers.read_json(spark, path, rows.schema)
    else:
        writers.write_json(rows, path)
        back = readers.read_jsonl(spark, path, rows.schema)
    assert same_rows(back.select(rows.columns), rows).count() == 0


def test_empty_csv_warns_and_writes_nothing(spark, tmp_path):
    with pytest.warns(UserWarning, match="No products"):
        assert not writers.write_csv(typed(spark).select("product_id").filter("false"), str(tmp_path / "x"))
    assert not os.path.exists(tmp_path / "x")


def test_snapshots_and_latest(spark, tmp_path):
    root = str(tmp_path / "runs")
    for day in (1, 2):
        run = typed(spark).withColumn("run_ts", F.expr(f"timestamp_ntz '2026-02-0{day} 10:00:00'"))
        writers.write_snapshot(run.filter(f"product_id <= '{day + 1}'"), root)
    every = readers.read_snapshots(spark, f"{root}/json")
    assert every.count() == 5 and {"material_text", "file"} <= set(every.columns)
    assert sorted(os.listdir(f"{root}/csv"))[-2:] == ["run_ts=20260201_100000", "run_ts=20260202_100000"]
    latest = spark.read.json(f"{writers.latest_path(spark, root)}/json").select("product_id", "run_ts").collect()
    assert {tuple(r) for r in latest} == {(p, "20260202_100000") for p in "123"}


def test_latest_copy_is_whole_when_a_job_ends_early(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "runs")
    run = typed(spark).withColumn("run_ts", F.expr("timestamp_ntz '2026-02-01 10:00:00'"))
    with pytest.raises(FileNotFoundError):
        writers.latest_path(spark, root)
    writers.write_snapshot(run.filter("product_id = '1'"), root)
    first = writers.latest_path(spark, root)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(writers, "_publish", killed)
        with pytest.raises(KeyboardInterrupt):
            writers.write_snapshot(run, root)
    # the new copy is there, but nobody is sent to it
    assert writers.latest_path(spark, root) == first and spark.read.json(f"{first}/json").count() == 1
    assert len([f for f in os.listdir(f"{root}/latest") if not f.startswith((".", "_"))]) == 2
    writers.write_snapshot(run, root)
    now = writers.latest_path(spark, root)
    assert now != first and spark.read.json(f"{now}/json").count() == run.count()
    # the copy before stays for its readers, those before it go
    assert spark.read.json(f"{first}/json").count() == 1
    writers.write_snapshot(run, root)
    kept = [f for f in os.listdir(f"{root}/latest") if not f.startswith((".", "_"))]
    assert sorted(kept) == sorted([os.path.basename(now), os.path.basename(writers.latest_path(spark, root))])


def test_drifting_runs_read_under_one_schema(spark, tmp_path):
    early = spark.createDataFrame([("1", "A")], "product_id string, title string")
    later = spark.createDataFrame([("2", "B", True)], "product_id string, title string, best_seller boolean")
    writers.write_jsonl(early, str(tmp_path / "s/r1"))
    writers.write_jsonl(later, str(tmp_path / "s/r2"))
    rows = readers.read_snapshots(spark, str(tmp_path / "s"))
    assert len(rows.columns) == 32
    assert {(r.product_id, r.best_seller) for r in rows.collect()} == {("1", None), ("2", True)}


def test_sample_runs(spark):
    """Set SHELFSPARK_SAMPLES to a folder of real runs to check the known totals."""
    folder = os.environ.get("SHELFSPARK_SAMPLES")
    if not folder:
        pytest.skip("no samples named")
    rows = spark.read.schema(schema.FILE_SCHEMA).option("pathGlobFilter", "*.jsonl").json(folder)
    assert (rows.count(), rows.select("product_id").distinct().count()) == (64, 13)
    assert rows.filter("best_seller is null").count() == 14
    docs = readers.read_json(spark, folder.rstrip("/") + "/*.json")
    assert same_rows(docs, rows).count() == 0
    built = codec.from_file_rows(rows, schema.LIST_COLUMNS, schema.MAP_COLUMNS)
    assert built.filter("scraped_at is null").count() == 0


def catalog(spark, n=40):
    return spark.range(n).select(
        F.col("id").cast("string").alias("product_id"),
        F.concat(F.lit("Bag "), F.col("id").cast("string")).alias("title"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("https://i/"), "id")).alias("images"),
        F.format_string("%06d", "id").alias("scraped_at"),
    )


def encoders():
    """Local functions travel to the workers with their code."""

    def letters():
        return lambda texts: np.array([[len(t), t.count("a"), 1.0] for t in texts])

    def images():
        # every fourth download fails
        return lambda urls: np.array(
            [[np.nan] * 3 if int(u.rsplit("/", 1)[1]) % 4 == 0 else [0.0, 0.0, 2.0] for u in urls]
        )

    return letters, images


def test_encoders_and_fallbacks(spark):
    letters, images = encoders()
    rows = {r.id: r.embedding for r in embed(prepare(catalog(spark), "scraped_at"), letters, images).collect()}
    text = {r.id: r.embedding for r in embed(prepare(catalog(spark), "scraped_at"), letters, images, use_images=False).collect()}
    assert len(rows) == 40
    for key, vector in rows.items():
        assert np.linalg.norm(vector) == pytest.approx(1, abs=1e-6)
        t = np.array([len(f"Bag {key}"), 1.0, 1.0])
        t /= np.linalg.norm(t)
        assert np.allclose(text[key], t, atol=1e-6)
        fused = (t + [0, 0, 1]) / 2
        want = fused / np.linalg.norm(fused) if int(key) % 4 == 2 else t
        assert np.allclose(vector, want, atol=1e-6)


def test_text_only_plans_no_image_step(spark):
    letters, images = encoders()
    plan = embed(prepare(catalog(spark), "scraped_at"), letters, images, use_images=False)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("ArrowEvalPython") == 1


def test_zero_vector_has_no_direction(spark):
    d = spark.createDataFrame([("",), ("a",)], "document string")
    got = E.text_vectors(d).orderBy("document").collect()
    assert set(got[0].text_vector) == {None} and sum(x * x for x in got[1].text_vector) == pytest.approx(1)


def test_run_ingest_twice(spark, tmp_path):
    path = str(tmp_path / "in.jsonl")
    both = catalog(spark).unionByName(catalog(spark, 5).withColumn("scraped_at", F.concat(F.lit("9"), "scraped_at")))
    writers.write_jsonl(both, path)
    out, rejects = run_ingest(spark, path, collection="c", collection_root=str(tmp_path))
    assert out == f"{tmp_path}/c" and rejects.count() == 5
    run_ingest(spark, path, collection="c", collection_root=str(tmp_path))
    stored = spark.read.parquet(out)
    assert stored.count() == 40 and stored.select("id").distinct().count() == 40


def test_slices_reach_an_external_store(spark, tmp_path):
    folder = str(tmp_path)

    def connect():
        import uuid

        def add(rows):
            with open(f"{folder}/{uuid.uuid4().hex}.txt", "w") as f:
                f.write("\n".join(r.product_id for r in rows))

        return add

    writers.send_in_slices(catalog(spark, 100).coalesce(2), connect, batch_size=32)
    sizes = [len(open(f"{folder}/{f}").read().split("\n")) for f in os.listdir(folder)]
    assert sum(sizes) == 100 and max(sizes) <= 32


def test_arrivals_equal_one_batch_and_replays_are_harmless(spark, tmp_path):
    rows = catalog(spark, 60)
    folder, state, out = (str(tmp_path / x) for x in ("in", "state", "out"))
    for i, part in enumerate((rows.filter("product_id < '3'"), rows.filter("product_id >= '2'"))):
        writers.write_jsonl(part, f"{folder}/drop{i}")
        ingest_arrivals(spark, f"{folder}/*", rows.schema, out, state).awaitTermination()
    # a lost checkpoint replays every file
    ingest_arrivals(spark, f"{folder}/*", rows.schema, out, state + "2", files_per_batch=1).awaitTermination()
    whole = embed(prepare(rows, "scraped_at"))
    stored = spark.read.parquet(out)
    assert stored.count() == 60
    assert same_rows(stored.select("id", "document", "metadata"), whole.select("id", "document", "metadata")).count() == 0


def test_table_load(spark, tmp_path):
    rows = catalog(spark, 3)
    writers.load_table(rows, "load_test", replace=True, path=str(tmp_path / "t"))
    writers.load_table(rows.select(*reversed(rows.columns)), "load_test")
    assert spark.table("load_test").count() == 6
    assert spark.table("load_test").filter("product_id = '1' and title = 'Bag 1'").count() == 2


def test_page_files(spark, tmp_path):
    write(tmp_path / "a.html", "<h1>\nA</h1>")
    got = readers.read_pages(spark, str(tmp_path)).first()
    assert got.html == "<h1>\nA</h1>" and got.url.endswith("a.html")


def test_scans_read_only_what_is_used(spark, sf_dir):
    pages = readers.read_pages(spark, f"{sf_dir}/pages.parquet").filter("page_id > 3").select("url")
    plan = pages._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan and "GreaterThan(page_id,3)" in plan
    assert isinstance(pages.schema, StructType)


def test_no_value_of_a_drifting_run_vanishes(spark, tmp_path):
    lines = [
        '{"product_id": "1", "title": "Bag", "price_current": 10.5}',
        '{"product_id": "2", "price_current": "ten", "shelf": {"row": [1, "x"]}, "note": null}',
        '{"product_id": "3", "rating_count": 2.5, "Title": "case", "title": null}',
        "",
        "   ",
        "not json",
        '["a", "list"]',
        '{"product_id": "4", "images": {"a": 1}, "is_new": "yes", "": "no key"}',
    ]
    write(tmp_path / "run.jsonl", "\n".join(lines))
    rows = readers.read_drifting(spark, str(tmp_path))
    assert rows.columns == [*schema.FILE_SCHEMA.names, "rescued", "file"]
    got = {r["product_id"]: r for r in rows.filter("product_id is not null").collect()}
    assert got["1"]["rescued"] == {} and (got["1"]["title"], got["1"]["price_current"]) == ("Bag", 10.5)
    assert got["2"]["price_current"] is None
    assert got["2"]["rescued"] == {"price_current": "ten", "shelf": '{"row":[1,"x"]}'}
    assert got["3"]["rescued"] == {"rating_count": "2.5", "Title": "case"}
    assert got["4"]["rescued"]["is_new"] == "yes" and got["4"]["rescued"][""] == "no key"
    # every value of an object is in its column or among the rescued
    for line in lines:
        record = json.loads(line) if line.startswith("{") else {}
        for key, value in record.items():
            row = got[record["product_id"]]
            assert value is None or key in row["rescued"] or row[key] is not None
    whole = [r["rescued"] for r in rows.filter("product_id is null").collect()]
    assert sorted(r[readers.WHOLE_LINE] for r in whole) == sorted(["not json", '["a", "list"]'])
    report = {(r["key"], r["kind"]): r["n_rows"] for r in readers.drift_report(rows).collect()}
    assert report[readers.WHOLE_LINE, "unreadable"] == 2
    assert report["shelf", "unknown"] == report["price_current", "mistyped"] == 1
    with pytest.raises(ValueError, match="title"):
        readers.read_drifting(spark, str(tmp_path), rescue="title")
