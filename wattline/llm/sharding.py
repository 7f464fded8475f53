"""Proportional stratified interleaving: every shard gets the sources in the mixture's proportions.

Rows of a source are put in seeded random order; row ``r`` of ``n`` gets the fractional rank ``(2r+1)/(2n)``.
In the order of fractional rank any run of rows holds each source in proportion, so cutting that order into
equal runs gives shards whose row counts differ by one at most. Both ranks come from ``kit.numbered``: a
source with most of the rows is ranked in buckets of the random draw, and all rows in buckets of the
fractional rank, which hold the same number of rows whatever the sources' sizes are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wattline.llm import kit

SHARDS = 40
SEED = 20_240_607
BUCKET_ROWS = 200_000


def shard(df: DataFrame, source: str = "source", key: tuple[str, ...] = ("doc_id",), shards: int = SHARDS,
          seed: int = SEED, bucket_rows: int = BUCKET_ROWS, shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """``df`` with ``shard_col`` (0 .. shards-1) and ``slot_col`` (gapless from 0 in each shard).

    ``key`` names the columns that identify a row; rows alike in them and in ``source`` are interchangeable.
    Null sources form a source of their own, null keys draw like any value, an empty table stays empty,
    with fewer rows than shards some shards are empty. Columns of ``df`` named like the two new ones are
    replaced; all others are kept.
    """
    rows = df.count()
    parts = max(64, -(-rows // bucket_rows))
    kept = [c for c in df.columns if c not in (shard_col, slot_col)]
    # the caller's columns travel in one, so their names meet none of those below
    drawn = df.select(F.struct(*kept).alias("_row"), F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")).alias("_stratum"),
                      kit.seeded(seed, F.col(source), *[F.col(k) for k in key]).alias("_draw"), *[F.col(k).alias(f"_key{i}") for i, k in enumerate(key)])
    keys = [F.col(f"_key{i}") for i in range(len(key))]
    ranked = kit.numbered(drawn, F.floor((F.col("_draw") / 2.0 ** 64 + 0.5) * parts).cast("long"),
                          [F.col("_draw"), *keys], "_rank", by=["_stratum"], total="_n")
    placed = ranked.withColumn("_at", (2 * F.col("_rank") + 1) / (2 * F.col("_n")))
    ordered = kit.numbered(placed, F.floor(F.col("_at") * parts).cast("long"),
                           [F.col("_at"), F.col("_stratum"), F.col("_draw"), *keys], "_place")
    which = F.expr(f"cast((_place * {shards}) div {max(rows, 1)} as int)")
    start = F.expr(f"(cast(_shard as bigint) * {rows} + {shards - 1}) div {shards}")
    return ordered.withColumn("_shard", which).select("_row.*", F.col("_shard").alias(shard_col), (F.col("_place") - start).alias(slot_col))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 40 shards by the law ``rows``."""
    slim = kit.table(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long").alias("text_crc32"))
    slim = kit.materialize(slim, "sharding-rows")
    return shard(slim, key=("doc_id", "size", "text_crc32")).select(
        "doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op7_sharding": op7_sharding}
ORACLES = {}
