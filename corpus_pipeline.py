"""A corpus from raw documents: quality, near-duplicates, contamination, mixture, shards.

Every stage takes (spark, docs, sf_dir), where ``docs`` is what the stage before kept, and returns a DataFrame; all but the
last return the columns of ``docs``. ``labels`` and ``benchmark`` are read from ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wattline.llm import decontamination, kit, mixing, near_dedup, quality, sharding

ORACLE_SQL = None  # a trained classifier and seeded draws; tests/llm compares each stage with brute force


_LAST = (1 << 63) - 1


def _named(docs: DataFrame) -> DataFrame:
    """(_row, _id, _hash): the columns of ``docs`` in one, and what tells a document; a null id is a value of its own."""
    return docs.select(F.struct(*docs.columns).alias("_row"), F.coalesce("doc_id", F.lit(_LAST)).alias("_id"), F.xxhash64("text").alias("_hash"))


def _judged(found: DataFrame) -> DataFrame:
    return found.select(F.coalesce("doc_id", F.lit(_LAST)).alias("_id"), F.col("text_hash").alias("_hash"))


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; without usable labels all stay."""
    return quality.keep_good(docs, quality.learn(docs, kit.table(spark, sf_dir, "labels")))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str, one_row: bool = False) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id; texts without words all stay.

    Groups link five-word shingle sets with a similarity of 0.8 or more. With ``one_row`` rows alike in id and text,
    those without words too, become one row, any of them; otherwise all of them stay.
    """
    kept = _judged(near_dedup.groups(docs, shingle=5, numerator=80).where("kept"))
    rows = _named(docs)
    if one_row:
        rows = rows.groupBy("_id", "_hash").agg(F.any_value("_row").alias("_row"))
    return rows.join(kept, ["_id", "_hash"], "left_semi").select("_row.*")


def distinct_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``distinct_documents`` with one row for a document that is repeated as it is."""
    return distinct_documents(spark, docs, sf_dir, one_row=True)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark passages."""
    found = decontamination.report(docs, kit.table(spark, sf_dir, "benchmark")).where("contaminated")
    return _named(docs).join(_judged(found), ["_id", "_hash"], "left_anti").select("_row.*")


def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources; a document is repeated as often as it was drawn, up to three times. A null source is one source."""
    return mixing.mix(docs, kit.size_words(F.col("text")), ordered=False, shard_col=None)


def sharded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows over the shards, with ``shard`` and ``slot``."""
    return sharding.shard(docs)


STAGES = [
    ("quality_classifier", good_documents),
    ("near_dedup", distinct_rows),
    ("decontamination", clean_documents),
    ("mixing", mixed_documents),
    ("sharding", sharded_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = kit.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kit.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
