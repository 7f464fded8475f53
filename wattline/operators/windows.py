"""Status, ordering and set operations over yearly series and result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wattline import names as N
from wattline.functions.series import by_year, change


def growth_status(yearly: DataFrame, keys, value: str) -> DataFrame:
    """Yearly growth with a status: start (from zero), stop (to zero), stopped (no rate)."""
    prev = F.lag(value).over(by_year(*keys))
    x = F.col(value)
    status = (F.when(prev.isNull() | ((prev == 0) & (x == 0)), "stopped").when(prev == 0, "start").when(x == 0, "stop"))
    return yearly.withColumn("growth", change(value, keys, "pct")).withColumn("statut", status)


def annual_change(ratios: DataFrame, keys, value: str) -> DataFrame:
    """Annual change implied by monthly ratios: sum X / sum(X/R), and sum(R * previous) / sum(previous)."""
    ok = ratios.filter(F.col("ratio").isNotNull())
    return ok.groupBy(*keys, N.ANNEE).agg(
        (F.sum(value) / F.nullif(F.sum(F.try_divide(F.col(value), F.col("ratio"))), F.lit(0.0))).alias("change"),
        (F.sum(F.col("ratio") * F.col("precedent")) / F.nullif(F.sum("precedent"), F.lit(0.0))).alias("change_prev"))


def top_k(df: DataFrame, value: str, tie_break: str, k: int, largest: bool = True) -> DataFrame:
    """The k largest (or smallest) rows; ties by ``tie_break``. Runs as a per-partition top-k and a merge."""
    order = F.desc_nulls_last(value) if largest else F.asc_nulls_last(value)
    return df.orderBy(order, F.asc(tie_break)).limit(k)


def last_row(df: DataFrame, keys, order: str, values) -> DataFrame:
    return df.groupBy(*keys).agg(F.max(F.struct(order, *values)).alias("x")).select(*keys, "x.*")


def order_results(results: DataFrame) -> DataFrame:
    """Flatten the metrics struct; best error first, missing metrics last."""
    return results.select(*[c for c in results.columns if c != "metrics"], "metrics.*").orderBy(
        F.asc_nulls_last("annual_mape"), F.desc_nulls_last("annual_r2"))


def common_years(predictions: DataFrame, keys, model: str, n_models: int) -> DataFrame:
    """Years every one of ``n_models`` models has predicted."""
    return (predictions.select(*keys, N.ANNEE, model).distinct().groupBy(*keys, N.ANNEE)
            .agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == n_models).drop("_n"))
