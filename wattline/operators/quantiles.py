"""Exact group quantiles without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def exact_quantiles(df: DataFrame, keys, value: str, probs, buckets: int = 200) -> DataFrame:
    """Linear-interpolated quantiles of ``value`` per group, exact at any group size.

    Values are counted first, so repeated ones shrink map-side. Approximate percentiles then cut every
    group into about ``buckets`` slices; ranks run inside a slice and start from the count of the slices
    below it. A quantile needs two neighbouring order statistics, which the ranks give directly.
    """
    keys = list(keys)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    cut_at = [i / buckets for i in range(1, buckets)]
    cuts = counted.groupBy(*keys).agg(F.percentile_approx(value, cut_at, 10_000).alias("_cuts"),
                                      F.sum("_c").alias("_n"))
    placed = counted.join(cuts, keys) if keys else counted.crossJoin(cuts)
    slice_no = F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    placed = placed.withColumn("_slice", slice_no)
    sizes = placed.groupBy(*keys, "_slice").agg(F.sum("_c").alias("_size"))
    below = sizes.withColumn("_below", F.coalesce(F.sum("_size").over(
        W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_size")
    ranked = placed.join(below, [*keys, "_slice"]).withColumn(
        "_to", F.col("_below") + F.sum("_c").over(W.partitionBy(*keys, "_slice").orderBy(value)))
    hit = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("_n") - 1)).alias("pos")) for i, p in enumerate(probs)])
    at = ranked.select(*keys, value, (F.col("_to") - F.col("_c")).alias("_from"), (F.col("_to") - 1).alias("_last"),
                       F.explode(hit).alias("h"))
    low, high = F.floor("h.pos"), F.ceil("h.pos")

    def holds(rank):
        return (F.col("_from") <= rank) & (rank <= F.col("_last"))

    near = at.filter(holds(low) | holds(high)).groupBy(*keys, F.col("h.i").alias("i"), F.col("h.pos").alias("pos")).agg(
        F.max(F.when(holds(low), F.col(value))).alias("lo"), F.max(F.when(holds(high), F.col(value))).alias("hi"))
    quantile = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("pos") - F.floor("pos"))
    out = near.withColumn("q", quantile).groupBy(*keys) if keys else near.withColumn("q", quantile).groupBy()
    return out.agg(*[F.max(F.when(F.col("i") == i, F.col("q"))).alias(f"q{i}") for i in range(len(probs))])


def describe(df: DataFrame, keys, value: str) -> DataFrame:
    """Count, mean, standard deviation, minimum, quartiles and maximum per group."""
    keys = list(keys)
    moments = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
                                    F.min(value).alias("min"), F.max(value).alias("max"))
    q = exact_quantiles(df, keys, value, (0.25, 0.5, 0.75)).toDF(*keys, "q25", "q50", "q75")
    return moments.join(q, keys, "left")
