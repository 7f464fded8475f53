"""Fills, overrides and replacements expressed as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wattline import names as N


def neighbour_year_mean(monthly: DataFrame, keys, value: str, first: int, second: int) -> DataFrame:
    """Mean of two years per month, where both have the month; one pass instead of a self-join."""
    def of(y):
        return F.max(F.when(F.col(N.ANNEE) == y, F.col(value)))

    both = monthly.filter(F.col(N.ANNEE).isin(first, second)).groupBy(*keys, N.MOIS).agg(of(first).alias("a"), of(second).alias("b"))
    return both.filter("a is not null and b is not null").withColumn("moyenne", (F.col("a") + F.col("b")) / 2)


def fill_from(df: DataFrame, other: DataFrame, keys, value: str) -> DataFrame:
    """Fill nulls by the other source's mean per key."""
    means = other.groupBy(*keys).agg(F.avg(value).alias("_other"))
    return df.join(means, list(keys), "left").withColumn(value, F.coalesce(value, "_other")).drop("_other")


def adopt_attributes(old: DataFrame, new: DataFrame, key: str, attrs) -> DataFrame:
    """Old rows under the current attributes of their key, stacked on the new rows."""
    current = new.select(key, *attrs).distinct()
    return new.unionByName(old.join(current, key).select(*new.columns))


def override(df: DataFrame, fixes: DataFrame, keys, cols) -> DataFrame:
    """Non-null corrections win, matched on the full key."""
    f = fixes.select(*keys, *[F.col(c).alias(f"_{c}") for c in cols])
    out = df.join(f, list(keys), "left")
    for c in cols:
        out = out.withColumn(c, F.coalesce(f"_{c}", c))
    return out.select(*df.columns)


def replace_groups(df: DataFrame, replacement: DataFrame, keys) -> DataFrame:
    """Drop every row of the groups the replacement holds and take its rows instead."""
    return df.join(replacement.select(*keys).distinct(), list(keys), "left_anti").unionByName(replacement)


def same_month_ratio(monthly: DataFrame, keys, value: str) -> DataFrame:
    """Value over the same month of the year before; null when the two years differ in months."""
    counts = monthly.groupBy(*keys, N.ANNEE).agg(F.count(F.lit(1)).alias("_n"))
    rows = monthly.join(counts, [*keys, N.ANNEE])
    prev = rows.select(*keys, (F.col(N.ANNEE) + 1).alias(N.ANNEE), N.MOIS, F.col(value).alias("_p"), F.col("_n").alias("_np"))
    out = rows.join(prev, [*keys, N.ANNEE, N.MOIS], "left")
    return out.withColumn("precedent", F.col("_p")).withColumn(
        "ratio", F.when(F.col("_n") == F.col("_np"), F.try_divide(F.col(value), F.col("_p")))).drop("_n", "_np", "_p")


def drop_groups_with_null(df: DataFrame, keys, value: str) -> DataFrame:
    return df.join(df.filter(F.col(value).isNull()).select(*keys).distinct(), list(keys), "left_anti")
