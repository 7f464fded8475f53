"""Small helpers shared by the operators: tables, scratch tables, distributed ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from wattline import session

SPACE_CLASS = r"[^\x20\x09-\x0D]+"
ARROW_ROWS = "1000"
_ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialize(df: DataFrame, label: str, partition_by=()) -> DataFrame:
    """``session.materialize`` with small batches to Python workers: whole texts at the usual 10,000 rows a batch take
    some hundred MB of an executor outside its heap."""
    conf = df.sparkSession.conf
    before = conf.get(_ARROW)
    conf.set(_ARROW, min(ARROW_ROWS, before, key=int))
    try:
        return session.materialize(df, label, partition_by)
    finally:
        conf.set(_ARROW, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def size_words(text: Column) -> Column:
    """Number of runs of ``[^\\x20\\x09-\\x0D]``; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_CLASS)), F.lit(0)).cast("long")


def seeded(seed: int, *cols: Column) -> Column:
    """A 64-bit draw that depends on the seed and the columns alone."""
    return F.xxhash64(F.lit(seed), *cols)


def numbered(df: DataFrame, bucket: Column, order: list[Column], out: str, by: list[str] | None = None,
             total: str | None = None) -> DataFrame:
    """Adds ``out``: each row's rank from 0 within ``by`` in the order of (bucket, order).

    Rows are ranked only inside their bucket and shifted by the sizes of the buckets before it, so no task
    holds more than a bucket even where one value of ``by`` has most rows. ``bucket`` must not decrease
    along the order; neither it nor ``by`` may be null. ``total`` adds the number of rows with the same ``by``.
    """
    keys = [*(by or []), "_bucket"]
    df = df.withColumn("_bucket", bucket)
    group = Window.partitionBy(*(by or []))
    before = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    shift = sizes.select(*keys, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_shift"),
                         *([F.sum("_rows").over(group).alias(total)] if total else []))
    ranked = df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1)
    return ranked.join(shift, keys).withColumn(out, F.col(out) + F.col("_shift")).drop("_bucket", "_shift")


def join_hot(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, least: int = 100_000) -> DataFrame:
    """``rows`` inner-joined with ``groups`` (one row a key, ``size`` rows of ``rows``) so that no task gets a large group.

    Groups of more than ``least`` and more than a thousandth of the ``total`` rows, a thousand at most, are broadcast.
    """
    bound = max(least, total // 1000)
    large = F.broadcast(groups.where(F.col(size) > bound))
    others = rows.join(large.select(*keys), keys, "left_anti").join(groups.where(F.col(size) <= bound), keys)
    return rows.join(large, keys).unionByName(others)


def held_out(row: Column) -> Column:
    """Rows kept from learning: crc32 of the id as text is divisible by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(row.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def bounded_sample(df: DataFrame, stratum: str, per_stratum: int, seed: int, key: list[str]) -> DataFrame:
    """At most ``per_stratum`` rows of each value of ``stratum``: those with the least seeded draws, with ``_count``,
    the stratum's rows in ``df`` (a column of that name is replaced). Rows without a stratum are left out.

    Large strata are thinned by their draw first, so no task ranks more than about twice the bound.
    """
    kept = [c for c in df.columns if c != "_count"]
    rows = df.select(F.struct(*kept).alias("_row"), F.col(stratum).alias("_stratum"), seeded(seed, *[F.col(k) for k in key]).alias("_draw"),
                     *[F.col(k).alias(f"_key{i}") for i, k in enumerate(key)])
    counts = rows.groupBy("_stratum").agg(F.count(F.lit(1)).alias("_count"))
    thin = rows.join(F.broadcast(counts), "_stratum").where(F.col("_draw") / 2.0 ** 64 + 0.5 <= (2.0 * per_stratum + 50) / F.col("_count"))
    rank = F.row_number().over(Window.partitionBy("_stratum").orderBy("_draw", *[f"_key{i}" for i in range(len(key))]))
    return thin.withColumn("_rank", rank).where(F.col("_rank") <= per_stratum).select("_row.*", "_count")
