"""Forecast errors and model choice as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def mape(actual: Column, pred: Column, floor: float = 0.0) -> Column:
    """Mean absolute percent error; actuals within ``floor`` of zero do not count."""
    return F.avg(F.when(F.abs(actual) > floor, F.abs((actual - pred) / F.nullif(actual, F.lit(0.0))))) * 100


def mae(actual: Column, pred: Column) -> Column:
    return F.avg(F.abs(actual - pred))


def r2(actual: Column, pred: Column) -> Column:
    """1 - SSE/SST over pairs where both sides are present; null for fewer than two or constant actuals."""
    both = actual.isNotNull() & pred.isNotNull()
    a = F.when(both, actual)
    sst = F.count(a) * F.var_pop(a)
    return F.when((F.count(a) >= 2) & (sst > 0), 1 - F.sum(F.when(both, (actual - pred) * (actual - pred))) / F.nullif(sst, F.lit(0.0)))


def metric_columns(prefix: str, actual: str = "actual", pred: str = "prediction") -> list[Column]:
    a, p = F.col(actual), F.col(pred)
    return [mae(a, p).alias(f"{prefix}_mae"), mape(a, p).alias(f"{prefix}_mape"), r2(a, p).alias(f"{prefix}_r2")]


def annual_metrics(pred: DataFrame, keys) -> DataFrame:
    return pred.groupBy(*keys).agg(*metric_columns("annual"))


def all_metrics(monthly: DataFrame, keys, year: str = "annee") -> DataFrame:
    """Monthly and annual errors of monthly predictions; annual values are the sums of the months."""
    annual = monthly.groupBy(*keys, year).agg(F.sum("actual").alias("actual"), F.sum("prediction").alias("prediction"))
    return monthly.groupBy(*keys).agg(*metric_columns("monthly")).join(annual_metrics(annual, keys), list(keys))


def select_best(results: DataFrame, keys, ordinal: str, threshold: float, r2_col: str = "annual_r2", loss: str = "annual_mae") -> DataFrame:
    """Lowest loss among results at or above the R2 threshold; none reaches it: highest R2. First in grid order on ties."""
    passed = F.coalesce(F.col(r2_col) >= threshold, F.lit(False))
    order = W.partitionBy(*keys).orderBy(
        F.desc(passed), F.asc_nulls_last(F.when(passed, F.col(loss))), F.desc_nulls_last(r2_col), F.asc(ordinal))
    return results.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def select_best_or_empty(entities: DataFrame, results: DataFrame, keys, ordinal: str, threshold: float) -> DataFrame:
    """As ``select_best``; an entity without any result keeps a row of nulls."""
    return entities.join(select_best(results, keys, ordinal, threshold), list(keys), "left")


def drop_invalid(predictions: DataFrame, keys, value: str = "prediction") -> DataFrame:
    """Remove every model that has a missing or non-finite prediction."""
    inf = float("inf")
    x = F.col(value)
    bad = x.isNull() | F.isnan(x) | (x == inf) | (x == -inf)
    invalid = predictions.filter(bad).select(*keys).distinct()
    return predictions.join(invalid, list(keys), "left_anti")


def residual_interval(pred: DataFrame, keys, target_year: Column, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Empirical interval per calendar month: the target prediction plus residual percentiles of the other years.

    A series holds at most one residual per year and month, so the percentile buffer stays small.
    """
    other = F.col("annee") != target_year
    resid = F.when(other, F.col("actual") - F.col("prediction"))
    q = pred.groupBy(*keys, "mois").agg(
        F.percentile(resid, F.array(F.lit(low), F.lit(high))).alias("q"), F.max(F.when(~other, F.col("prediction"))).alias("prediction"))
    return q.select(*keys, "mois", "prediction", (F.col("prediction") + F.col("q")[0]).alias("bas"),
                    (F.col("prediction") + F.col("q")[1]).alias("haut"))


def weighted_quantile(df: DataFrame, keys, value: str, weight: str, tau: float) -> DataFrame:
    """Smallest value whose cumulative weight share reaches ``tau``; meant for the few points of one series."""
    up_to = W.partitionBy(*keys).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    total = F.sum(weight).over(W.partitionBy(*keys))
    cdf = df.withColumn("_cdf", F.sum(weight).over(up_to) / total)
    return cdf.filter(F.col("_cdf") >= tau).groupBy(*keys).agg(F.min(value).alias("quantile"))


def flat_results(results: DataFrame, metrics: str = "metrics") -> DataFrame:
    """Nested metrics (parts of named values) as plain columns ``name_part``, beside the other columns."""
    parts = results.schema[metrics].dataType.fields
    flat = [F.col(metrics)[p.name][v.name].alias(f"{v.name}_{p.name}") for p in parts for v in p.dataType.fields]
    return results.select(*[c for c in results.columns if c != metrics], *flat)


def ranked_nulls_last(results: DataFrame, first: str, second: str, tie: str, slices: int = 200) -> DataFrame:
    """``results`` with ``rang`` from 1 by ``first``, then ``second``, then ``tie``, missing values last.

    Rows are ranked inside slices of ``first``, cut at its approximate percentiles, and shifted by the slices before.
    """
    cuts = results.agg(F.percentile_approx(first, [i / slices for i in range(1, slices)], 10_000).alias("_cuts"))
    # null is a slice after all others; equal values share a slice
    at = F.when(F.col(first).isNull(), F.lit(slices)).otherwise(F.size(F.filter("_cuts", lambda c: c < F.col(first))))
    placed = results.join(F.broadcast(cuts)).withColumn("_slice", F.coalesce(at, F.lit(0)).cast("int")).drop("_cuts")
    sizes = placed.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n")).agg(F.collect_list(F.struct("_slice", "_n")).alias("_sizes"))
    before = F.aggregate("_sizes", F.lit(0).cast("bigint"), lambda s, x: s + F.when(x["_slice"] < F.col("_slice"), x["_n"]).otherwise(F.lit(0)))
    inside = F.row_number().over(W.partitionBy("_slice").orderBy(F.asc_nulls_last(first), F.asc_nulls_last(second), F.asc(tie)))
    return placed.join(F.broadcast(sizes)).withColumn("rang", before + inside).drop("_slice", "_sizes")
