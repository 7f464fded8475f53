"""Group aggregations, reshapes and profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from wattline import names as N
from wattline.operators.quantiles import exact_quantiles

AGGREGATES = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}


def monthly_sum(df: DataFrame, keys, value: str = N.CONSO) -> DataFrame:
    return df.groupBy(*keys, N.ANNEE, N.MOIS).agg(F.sum(value).alias(value))


def yearly_totals(df: DataFrame, keys, sums, means=()) -> DataFrame:
    return df.groupBy(*keys, N.ANNEE).agg(*[F.sum(c).alias(c) for c in sums], *[F.avg(c).alias(c) for c in means])


def collapse_duplicates(df: DataFrame, keys, sums, means=()) -> DataFrame:
    """One row per key: measures summed, ``means`` averaged."""
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *[F.avg(c).alias(c) for c in means])


def with_distributors(regional: DataFrame, distributors: DataFrame | None, value: str) -> tuple[DataFrame, DataFrame]:
    """Regional rows plus an 'All distributers' activity, and the combined monthly series per region.

    A region that reports a 'Total' activity uses it; the others sum their activities.
    """
    keys = [N.REGION, N.ANNEE, N.MOIS]
    rows = regional.select(*keys, N.ACTIVITE, value)
    is_total = F.col(N.ACTIVITE) == N.TOTAL
    has_total = rows.groupBy(N.REGION).agg(F.max(is_total).alias("_has_total"))
    # monthly first: the region flag then meets a handful of rows per region, not its raw rows
    monthly = rows.groupBy(*keys, is_total.alias("_is_total")).agg(F.sum(value).alias(value))
    base = monthly.join(has_total, N.REGION).filter(F.col("_is_total") == F.col("_has_total")).select(*keys, value)
    if distributors is None:
        return rows, base
    dist = distributors.groupBy(*keys).agg(F.sum(value).alias(value))
    updated = rows.unionByName(dist.withColumn(N.ACTIVITE, F.lit(N.ALL_DISTRIBUTORS)))
    combined = base.unionByName(dist).groupBy(*keys).agg(F.sum(value).alias(value))
    return updated, combined


def monthly_matrix(df: DataFrame, keys, value: str) -> DataFrame:
    """Year by 12 months. A month no row of the series ever has is 0; a gap in one year stays null."""
    wide = df.groupBy(*keys, N.ANNEE).pivot(N.MOIS, list(N.MONTHS)).agg(F.sum(value))
    wide = wide.select(*keys, N.ANNEE, *[F.col(str(m)).alias(f"m{m}") for m in N.MONTHS])
    over = W.partitionBy(*keys)
    return wide.select(*keys, N.ANNEE, *[
        F.when(F.count(f"m{m}").over(over) == 0, F.lit(0.0)).otherwise(F.col(f"m{m}")).alias(f"m{m}") for m in N.MONTHS])


def weather_monthly(scan: DataFrame) -> DataFrame:
    return scan.groupBy(N.REGION, N.ANNEE, N.MOIS).agg(
        F.avg("temp_min_latest").alias("temp_min_latest"),
        F.sum("precipitation_sum_latest").alias("precipitation_sum_latest"), F.sum("et0_latest").alias("et0_latest"))


def weather_yearly(scan: DataFrame) -> DataFrame:
    """Mean of monthly mean temperatures, sums of rain and evapotranspiration."""
    return weather_monthly(scan).groupBy(N.REGION, N.ANNEE).agg(
        F.avg("temp_min_latest").alias("temp_min_latest"),
        F.sum("precipitation_sum_latest").alias("precipitation_sum_latest"), F.sum("et0_latest").alias("et0_latest"))


def weather_latest(scan: DataFrame) -> DataFrame:
    """The newest year's values per region."""
    cols = ["temp_min_latest", "precipitation_sum_latest", "et0_latest"]
    return weather_yearly(scan).groupBy(N.REGION).agg(F.max_by(F.struct(*cols), N.ANNEE).alias("x")).select(N.REGION, "x.*")


def city_weather_to_region(daily: DataFrame, keys, max_cols, drop=()) -> DataFrame:
    """Maximum for the listed columns, mean for every other measure."""
    rest = [c for c in daily.columns if c not in {*keys, *max_cols, *drop}]
    return daily.groupBy(*keys).agg(*[F.max(c).alias(c) for c in max_cols], *[F.avg(c).alias(c) for c in rest])


def compound_growth(annual: DataFrame, keys, value: str) -> DataFrame:
    """Compound annual growth in percent over all rows and over the last five."""
    newest = W.partitionBy(*keys).orderBy(F.desc(N.ANNEE))
    rows = annual.withColumn("_r", F.row_number().over(newest))
    five = F.when(F.col("_r") <= 5, F.col(N.ANNEE))
    stats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min_by(value, N.ANNEE).alias("first"), F.max_by(value, N.ANNEE).alias("last"),
        F.min_by(value, five).alias("first5"))
    overall = F.when(F.col("n") > 1, (F.power(F.try_divide(F.col("last"), F.col("first")), F.lit(1.0) / (F.greatest(F.col("n"), F.lit(2)) - 1)) - 1) * 100
                     ).otherwise(F.lit(0.0))
    last5 = F.when(F.col("n") >= 5, (F.power(F.try_divide(F.col("last"), F.col("first5")), F.lit(0.25)) - 1) * 100).otherwise(overall)
    return stats.select(*keys, overall.alias("cagr"), last5.alias("cagr_last5"))


def average_annual_increase(annual: DataFrame, keys, value: str) -> DataFrame:
    """Least-squares yearly increase, rounded up, over all rows and over the last five."""
    newest = W.partitionBy(*keys).orderBy(F.desc(N.ANNEE))
    y, x = F.col(value).cast("double"), F.col(N.ANNEE).cast("double")
    rows = annual.withColumn("_r", F.row_number().over(newest))
    five = F.col("_r") <= 5
    stats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("s"),
        F.regr_slope(F.when(five, y), F.when(five, x)).alias("s5"))

    def up(slope):  # summation noise must not lift an exact integer to the next one
        return F.ceil(F.round(F.coalesce(slope, F.lit(0.0)), 9))

    overall = F.when(F.col("n") > 1, up(F.col("s"))).otherwise(F.lit(0))
    return stats.select(*keys, overall.alias("increase"),
                        F.when(F.col("n") >= 5, up(F.col("s5"))).otherwise(overall).alias("increase_last5"))


def activity_shares(df: DataFrame, activities, value: str) -> DataFrame:
    """Percent of each activity in its region-year, one column per activity, next to the total."""
    wide = df.groupBy(N.REGION, N.ANNEE).pivot(N.ACTIVITE, list(activities)).agg(F.sum(value))
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"`{a}`"), F.lit(0.0)) for a in activities])
    share = [F.when(F.col("total") > 0, F.coalesce(F.col(f"`{a}`"), F.lit(0.0)) / F.col("total") * 100)
             .otherwise(F.lit(0.0)).alias(f"pct_{a.lower()}") for a in activities]
    return wide.withColumn("total", total).select(N.REGION, N.ANNEE, "total", *share)


def label_lists(df: DataFrame, key: str, label: str) -> DataFrame:
    """Distinct labels per key, counted and listed in order."""
    return df.select(key, label).distinct().groupBy(key).agg(
        F.count(label).alias("n"), F.array_join(F.array_sort(F.collect_list(label)), ", ").alias("labels"))


def unique_or_error(df: DataFrame, keys, cols, sums=()) -> DataFrame:
    """The single non-null value per group; a second distinct value fails the job."""
    got = df.groupBy(*keys).agg(*[F.min(c).alias(c) for c in cols], *[F.max(c).alias(f"_max_{c}") for c in cols],
                                *[F.sum(c).alias(c) for c in sums])
    for c in cols:
        conflict = F.col(c) != F.col(f"_max_{c}")
        message = F.concat(F.lit(f"several values of {c}: "), F.col(c).cast("string"), F.lit(", "), F.col(f"_max_{c}").cast("string"))
        got = got.withColumn(c, F.when(conflict, F.raise_error(message).cast("string")).otherwise(F.col(c)))
    return got.drop(*[f"_max_{c}" for c in cols])


def duplicates(df: DataFrame, keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def column_profile(df: DataFrame, cols) -> DataFrame:
    """Null count and presence of non-positive values per column, from one pass."""
    stats = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in cols],
                   *[F.max((F.col(c) <= 0).cast("int")).alias(f"z_{c}") for c in cols])
    rows = F.array(*[F.struct(F.lit(c).alias("colonne"), F.col(f"n_{c}").alias("nulls"),
                              F.col(f"z_{c}").alias("non_positive")) for c in cols])
    return stats.select(F.explode(rows).alias("x")).select("x.*")


def value_shares(df: DataFrame, keys, label: str) -> DataFrame:
    """Normalised value counts of a label per group."""
    counts = df.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_total"))
    return counts.join(totals, list(keys)).withColumn("share", F.col("n") / F.col("_total")).drop("_total")


def contract_endings(df: DataFrame, year: int) -> DataFrame:
    """Contracts without use since ``year``, and those still without use in it that start later."""
    since = F.sum(F.when(F.col(N.ANNEE) >= year, F.col(N.CONSO)).otherwise(F.lit(0.0)))
    within = F.sum(F.when(F.col(N.ANNEE) == year, F.col(N.CONSO)).otherwise(F.lit(0.0)))
    sums = df.groupBy(N.CONTRAT).agg(since.alias("since"), within.alias("within"))
    return sums.withColumn("etat", F.when(F.col("since") == 0, "finished").when(F.col("within") == 0, "starting")).filter(
        "etat is not null").select(N.CONTRAT, "etat")


def quality_shares(results: DataFrame) -> DataFrame:
    """Percent of results by R2 threshold and the count of the best ones."""
    def pct(cond):
        return F.avg(F.when(cond, 1.0).otherwise(0.0)) * 100

    r2, mape = F.col("annual_r2"), F.col("annual_mape")
    return results.agg(pct(r2 >= 0.3).alias("pct_good"), pct(r2 < -1).alias("pct_poor"),
                       F.count_if((r2 >= 0) & (mape < 10)).alias("n_close"),
                       F.count_if((r2 >= 0.6) & (mape < 10)).alias("n_best"))


def annual_error_totals(pred: DataFrame) -> DataFrame:
    sums = pred.groupBy(N.ANNEE).agg(F.sum("prediction").alias("prediction"), F.sum("actual").alias("actual"))
    error = F.col("prediction") - F.col("actual")
    return sums.withColumn("error", error).withColumn("percent_error", F.try_divide(error, F.col("actual")) * 100)


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts per equal-width bin; the upper edge belongs to the last bin."""
    b = F.least(F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins))
    return df.filter(F.col(value).between(low, high)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def time_evolution(df: DataFrame, value: str, how: str, yearly: bool, keys=()) -> DataFrame:
    """Monthly series, or the yearly one made from it with the same function."""
    def by(rows, *cols):
        if how == "median":  # exact, without a group in one buffer
            return exact_quantiles(rows, cols, value, (0.5,)).withColumnRenamed("q0", value)
        return rows.groupBy(*cols).agg(AGGREGATES[how](value).alias(value))

    monthly = by(df, *keys, N.ANNEE, N.MOIS)
    return by(monthly, *keys, N.ANNEE) if yearly else monthly
