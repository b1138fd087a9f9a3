"""The corpus pipeline: raw documents to training sequences.

Every stage is (name, function); a function takes (spark, docs, sf_dir) and returns a frame that is
written as Parquet and read again as the next one's ``docs``. All but the last return the columns
that they are given.

Defined cases, in every stage: null texts count as empty, rows without a doc_id are judged by their
text alone, repeated rows are judged each (the dedup stages keep one of them), columns beyond those
of ``documents`` are carried along, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfspark.llm import exact_dedup, jaccard_join, mixing, packing, quality
from shelfspark.llm.common import read, stored, text_of
from shelfspark.session import configure


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line CRF rejects go; it learns from the labels outside the held-out fold."""
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return docs.filter(quality.score_of(model, text_of("text")) >= quality.THRESHOLD)


def keep_different(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    configure(spark)
    return exact_dedup.survivors(docs)


def keep_dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingle overlap stays, the one with the smallest doc_id."""
    configure(spark)
    return jaccard_join.one_of_each(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of scarce languages are repeated until the domains' tokens meet their targets."""
    domains = mixing.fit_domains(mixing.labelled_documents(docs, read(spark, sf_dir, "labels")))
    members = stored(mixing.memberships(docs, domains), "pipeline-members")
    return mixing.mix(docs, mixing.fit_mixture(members, domains))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of binary lengths, with their ids."""
    configure(spark)
    return packing.pieces(docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("exact_dedup", keep_different),
    ("ngram_jaccard_join", keep_dissimilar),
    ("mixing", mix_domains),
    ("packing", pack),
]

# Classifiers, links and tokenizers are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
