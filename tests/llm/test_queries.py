"""The registered queries: against SQL where there is any, and the pipeline as a whole."""

import re

import duckdb
import pytest

import corpus_pipeline
from shelfspark.llm import jaccard_join
from shelfspark.llm.queries import ORACLES, QUERIES

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def con(sf_dir):
    out = duckdb.connect()
    for table in TABLES:
        out.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return out


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, con, sf_dir):
    found = QUERIES[name](spark, sf_dir)
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(found.columns) == sorted(columns)
    mine = sorted((tuple(r) for r in found.select(*columns).collect()), key=repr)
    assert mine == sorted(result.fetchall(), key=repr)


def test_operators_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == [*range(1, 14)]


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    total = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        ids = [r["doc_id"] for r in rows]
        if name != "mixing":
            assert len(set(ids)) == len(ids) and 0.5 * total <= len(ids) <= before.count()
        else:
            assert {r["doc_id"] for r in before.collect()} == set(ids)
        if name == "exact_dedup":
            assert len({re.sub(r"[\x20\x09-\x0D]", "", r["text"]) for r in rows}) == len(rows)
    alone = jaccard_join.similar_documents(before)
    assert alone.filter("doc_id <> component_id").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.selectExpr("count(distinct doc_id)").first()[0] == len(set(ids))
    assert corpus_pipeline.run(spark, sf_dir).count() == packed.count()


def test_stages_on_an_empty_table_and_extra_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    wide = docs.selectExpr("*", "1 as kept", "2 as n", "3 as id", "4 as `odd.name`")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, sf_dir)
        assert out.columns == wide.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, wide, sf_dir).count() == 0
