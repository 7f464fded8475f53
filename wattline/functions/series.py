"""Window expressions over one series: changes, gaps, weights and feature joins.

A series is a contract, an activity or a region after aggregation to months or years, so a window
partition holds at most its months.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wattline import names as N
from wattline.functions.columns import finite_or_null, require_columns


def by_year(*keys):
    return W.partitionBy(*keys).orderBy(N.ANNEE)


def change(value: str, keys, kind: str, epsilon: float | None = None, lag: int = 1) -> Column:
    """Change against the previous row: ``pct``, ``diff`` or ``log``. Null where it is undefined."""
    x = F.col(value).cast("double")
    prev = F.lag(x, lag).over(by_year(*keys))
    if kind == "pct":
        return F.try_divide(x - prev, prev)
    if kind == "diff":
        return x - prev
    if kind == "log":
        if epsilon is not None:
            x, prev = x + epsilon, prev + epsilon
        return F.when((x > 0) & (prev > 0), F.ln(x) - F.ln(prev))
    raise ValueError("kind must be 'pct', 'diff' or 'log'")


def exogenous_features(df: DataFrame, years: DataFrame, keys, block, use_rate: bool = False, kind: str = "log",
                       epsilon: float | None = None, fill: float = 0.0) -> DataFrame:
    """Feature levels or changes aligned to ``years``; undefined values and absent years become ``fill``."""
    require_columns(df, [*block, N.ANNEE], "features")
    cols = [F.coalesce(finite_or_null(change(c, keys, kind, epsilon)) if use_rate else F.col(c).cast("double"), F.lit(fill)).alias(c)
            for c in block]
    on = [*keys, N.ANNEE]
    return years.join(df.select(*on, *cols), on, "left").na.fill(fill, list(block))


def with_interpolated(df: DataFrame, cols, keys) -> DataFrame:
    """Linear by row position between known values; both ends take the nearest known value."""
    w = W.partitionBy(*keys).orderBy(N.ANNEE)
    out = df.withColumn("_pos", F.row_number().over(w))
    for c in cols:
        known = F.when(F.col(c).isNotNull(), F.struct(F.col("_pos").alias("p"), F.col(c).cast("double").alias("v")))
        out = (out.withColumn("_l", F.last(known, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
               .withColumn("_r", F.first(known, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))))
        step = (F.col("_r.v") - F.col("_l.v")) * (F.col("_pos") - F.col("_l.p")) / F.nullif(F.col("_r.p") - F.col("_l.p"), F.lit(0))
        out = out.withColumn(c, F.when(F.col("_l").isNull(), F.col("_r.v")).when(F.col("_r").isNull(), F.col("_l.v"))
                             .when(F.col(c).isNotNull(), F.col(c).cast("double")).otherwise(F.col("_l.v") + step))
    return out.drop("_pos", "_l", "_r")


def trim_and_interpolate(df: DataFrame, value: str, keys, min_points: int = 7) -> DataFrame:
    """Drop leading and trailing gaps, fill inner ones, keep series with at least ``min_points`` years."""
    whole = W.partitionBy(*keys)
    known = F.when(F.col(value).isNotNull(), F.col(N.ANNEE))
    spans = df.withColumn("_a", F.min(known).over(whole)).withColumn("_b", F.max(known).over(whole))
    inner = spans.filter(F.col(N.ANNEE).between(F.col("_a"), F.col("_b"))).drop("_a", "_b")
    filled = with_interpolated(inner, [value], keys)
    return filled.withColumn("_n", F.count(F.lit(1)).over(whole)).filter(F.col("_n") >= min_points).drop("_n")


def growth_features(df: DataFrame, keys, block, transforms=("lag_lchg",), lags=(1,)) -> DataFrame:
    """Levels, lags, log changes and lagged log changes of a feature block per series and year.

    Gaps in levels and in log changes are interpolated; what a lag leaves empty takes the column mean
    over all features' years (0 when there is none).
    """
    keys = list(keys)
    w = by_year(*keys)
    levels = with_interpolated(df.select(*keys, N.ANNEE, *[F.col(c).cast("double").alias(c) for c in block]), block, keys)
    names: list[str] = []
    if {"lchg", "lag_lchg"} & set(transforms):
        for c in block:
            levels = levels.withColumn(f"{c}_lchg", change(c, keys, "log"))
        levels = with_interpolated(levels, [f"{c}_lchg" for c in block], keys).na.fill(0.0, [f"{c}_lchg" for c in block])
    out = levels
    if "level" in transforms:
        names += list(block)
    if "lag" in transforms:
        for k in lags:
            for c in block:
                out = out.withColumn(f"{c}_lag{k}", F.lag(c, k).over(w))
                names.append(f"{c}_lag{k}")
    if "lchg" in transforms:
        names += [f"{c}_lchg" for c in block]
    if "lag_lchg" in transforms:
        for k in lags:
            for c in block:
                out = out.withColumn(f"{c}_lchg_lag{k}", F.lag(f"{c}_lchg", k).over(w))
                names.append(f"{c}_lchg_lag{k}")
    whole = W.partitionBy(*keys)
    return out.select(*keys, N.ANNEE, *[F.coalesce(F.col(n), F.avg(n).over(whole), F.lit(0.0)).alias(n) for n in names])


def lag_vectors(annual: DataFrame, keys, value: str, n_lags: int) -> DataFrame:
    """The previous ``n_lags`` values, newest first; rows without a full vector go."""
    w = by_year(*keys)
    out = annual.select(*keys, N.ANNEE, value, *[F.lag(value, k).over(w).alias(f"lag{k}") for k in range(1, n_lags + 1)])
    return out.filter(F.col(f"lag{n_lags}").isNotNull())


def power_weights(df: DataFrame, keys, lam: float) -> DataFrame:
    """``lam`` to the rank from the newest year (0 for the newest)."""
    newest = W.partitionBy(*keys).orderBy(F.desc(N.ANNEE))
    return df.withColumn("poids", F.power(F.lit(float(lam)), F.row_number().over(newest) - 1))


def decayed_curve(monthly: DataFrame, keys, value: str, test_year: int, rate: float = 0.1) -> DataFrame:
    """Normalised monthly shape of the years before ``test_year``, older years fading exponentially."""
    past = monthly.filter(F.col(N.ANNEE) < test_year)
    weight = F.exp(-rate * (F.lit(test_year) - F.col(N.ANNEE)))
    curve = past.groupBy(*keys, N.MOIS).agg(F.sum(weight * F.col(value)).alias("_m"))
    return curve.withColumn("part", F.try_divide(F.col("_m"), F.sum("_m").over(W.partitionBy(*keys)))).drop("_m")


def mean_curve(monthly: DataFrame, keys, value: str) -> DataFrame:
    """Normalised mean monthly shape."""
    curve = monthly.groupBy(*keys, N.MOIS).agg(F.avg(value).alias("_m"))
    return curve.withColumn("part", F.try_divide(F.col("_m"), F.sum("_m").over(W.partitionBy(*keys)))).drop("_m")


def standardize(df: DataFrame, cols, keys) -> DataFrame:
    """(x - mean) / population deviation per group; a constant column divides by 1.

    Moments come from a grouped aggregate joined back, so a group may be of any size.
    """
    stats = df.groupBy(*keys).agg(*[F.avg(c).alias(f"_mu_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_sd_{c}") for c in cols])
    out = df.join(stats, list(keys)) if keys else df.crossJoin(F.broadcast(stats))
    for c in cols:
        sd = F.when(F.col(f"_sd_{c}") == 0, 1.0).otherwise(F.col(f"_sd_{c}"))
        out = out.withColumn(c, (F.col(c) - F.col(f"_mu_{c}")) / sd)
    return out.select(*df.columns)


def monthly_feature(monthly: DataFrame, years: DataFrame, keys, feature: str, how=F.avg) -> DataFrame:
    """Twelve columns of a monthly feature per year; absent months and years are 0."""
    on = [*keys, N.ANNEE]
    wide = monthly.groupBy(*on).pivot(N.MOIS, list(N.MONTHS)).agg(how(feature))
    wide = wide.select(*on, *[F.col(str(m)).alias(f"{feature}_{m}") for m in N.MONTHS])
    return years.join(wide, on, "left").na.fill(0.0, [f"{feature}_{m}" for m in N.MONTHS])


def yearly_feature(monthly: DataFrame, years: DataFrame, keys, feature: str, how=F.sum) -> DataFrame:
    on = [*keys, N.ANNEE]
    return years.join(monthly.groupBy(*on).agg(how(feature).alias(feature)), on, "left").na.fill(0.0, [feature])


def client_feature(years: DataFrame, forecasts: DataFrame, keys, annual: bool) -> DataFrame:
    """Client forecasts (``valeurs`` array of 12) as a monthly array, or their annual sum; absent: zeros."""
    on = [*keys, N.ANNEE]
    out = years.join(forecasts.select(*on, "valeurs"), on, "left").withColumn(
        "valeurs", F.coalesce("valeurs", F.array_repeat(F.lit(0.0), 12)))
    return out.withColumn("clients_annuels", F.aggregate("valeurs", F.lit(0.0), lambda a, v: a + v)).drop("valeurs") if annual else out
