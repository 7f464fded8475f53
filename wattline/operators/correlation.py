"""Correlations between measures and between yearly series."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from wattline import names as N


def _correlation(a: str, b: str) -> Column:
    """Correlation of two measures as an aggregate; null below two rows or for a constant measure, for which ``corr`` divides by zero."""
    x, y = F.col(a), F.col(b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y)))


def measure_correlation(df: DataFrame, keys, a: str, b: str) -> DataFrame:
    """Correlation of two measures per group; null below two rows or for a constant measure."""
    return df.groupBy(*keys).agg(_correlation(a, b).alias("correlation"))


def correlation_matrix(df: DataFrame, cols) -> DataFrame:
    """All pairs of the listed columns in one aggregate, as rows (a, b, correlation)."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    row = df.agg(*[_correlation(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    items = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("correlation"))
                      for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(items).alias("x")).select("x.*")


def most_correlated(yearly: DataFrame, key: str, value: str, target, top_n: int | None = None, threshold: float | None = None) -> DataFrame:
    """Series most correlated with one series over common years; a single pass, the target's few years broadcast."""
    one = yearly.filter(F.col(key) == target).select(N.ANNEE, F.col(value).alias("_t"))
    both = yearly.filter(F.col(key) != target).join(one, N.ANNEE)
    out = measure_correlation(both, [key], value, "_t").filter(F.col("correlation").isNotNull())
    if threshold is not None:
        out = out.filter(F.abs("correlation") >= threshold)
    strength = F.round(F.abs("correlation"), 9)
    return out.orderBy(F.desc(strength), F.asc(key)).limit(top_n) if top_n else out


def correlated_pairs(yearly: DataFrame, key: str, value: str, threshold: float) -> DataFrame:
    """Pairs of series whose correlation over their common years reaches ``threshold`` in absolute value.

    Centred to unit length over the common years, two series reach it only when they (or one and the
    other's negative) lie within sqrt(2 (1 - threshold)). Series meet in the cells of a grid of that width
    over two coordinates, and only there; a pair outside neighbouring cells is never formed. Series with
    different years meet under the years both have, so each pair is scored on exactly those.
    """
    width = math.sqrt(2 * (1 - threshold)) + 1e-9
    years = yearly.agg(F.array_sort(F.collect_set(N.ANNEE)).alias("_all"))
    packed = yearly.filter(F.col(value).isNotNull()).groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct(N.ANNEE, F.col(value).cast("double")))).alias("_v"))
    packed = packed.crossJoin(F.broadcast(years)).select(
        key, F.filter("_all", lambda y: F.map_contains_key("_v", y)).alias("_own"), "_v")
    patterns = packed.select("_own").distinct().agg(F.collect_list("_own").alias("_patterns"))
    met = packed.crossJoin(F.broadcast(patterns)).select(key, "_own", "_v", F.explode("_patterns").alias("_other"))
    met = met.withColumn("_common", F.array_intersect("_own", "_other")).filter(F.size("_common") >= 2)
    raw = F.transform("_common", lambda y: F.element_at("_v", y))
    met = met.withColumn("_x", raw).withColumn("_mean", F.aggregate("_x", F.lit(0.0), lambda a, v: a + v) / F.size("_x"))
    met = met.withColumn("_x", F.transform("_x", lambda v: v - F.col("_mean")))
    met = met.withColumn("_norm", F.sqrt(F.aggregate("_x", F.lit(0.0), lambda a, v: a + v * v))).filter(F.col("_norm") > 0)
    unit = met.select(key, "_own", "_other", F.transform("_x", lambda v: v / F.nullif(F.col("_norm"), F.lit(0.0))).alias("_z"))

    def cell(z: Column, i: int) -> Column:
        return F.floor(F.element_at(z, i) / width)

    left = unit.select(F.col(key).alias("serie_1"), F.col("_own").alias("_o1"), F.col("_other").alias("_o2"), F.col("_z").alias("_z1"),
                       cell(F.col("_z"), 1).alias("_cx"), cell(F.col("_z"), 2).alias("_cy"))
    signed = unit.select(key, "_own", "_other", "_z", F.explode(F.array(F.lit(1.0), F.lit(-1.0))).alias("_sign"))
    signed = signed.withColumn("_z", F.transform("_z", lambda v: v * F.col("_sign")))
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    right = signed.select(F.col(key).alias("serie_2"), F.col("_own").alias("_o2"), F.col("_other").alias("_o1"), F.col("_z").alias("_z2"), "_sign",
                          F.explode(near).alias("_dx")).select("*", F.explode(near).alias("_dy"))
    right = right.select("serie_2", "_o1", "_o2", "_z2", "_sign", (cell(F.col("_z2"), 1) + F.col("_dx")).alias("_cx"),
                         (cell(F.col("_z2"), 2) + F.col("_dy")).alias("_cy"))
    pairs = left.join(right, ["_o1", "_o2", "_cx", "_cy"]).filter(F.col("serie_1") < F.col("serie_2"))
    dot = F.aggregate(F.zip_with("_z1", "_z2", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    return pairs.withColumn("_dot", dot).filter(F.col("_dot") >= threshold).select(
        "serie_1", "serie_2", (F.col("_dot") * F.col("_sign")).alias("correlation"))
