"""Weather and electric-vehicle corrections and their application to forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from wattline import names as N

COEFFICIENT_COLUMNS = ("implicit_intercept", "coef_temperature_min", "coef_precipitation", "coef_et0")

# Fitted weather sensitivities (intercept, temperature, precipitation, evapotranspiration).
WEATHER_COEFFICIENTS = {
    "Béni Mellal-Khénifra": (-761556999.0194256, 150945.52494459832, 695965.7652271345, 312589.59634202055),
    "Casablanca-Settat": (-843349325.577105, 56799106.10845571, 580606.2664738528, -135632.51806734095),
    "Drâa-Tafilalet": (-869168753.9888884, -51561747.956962235, -28065.201556676668, 703244.7969628241),
    "Fès-Meknès": (-266981324.65040958, -48271934.772982344, 254007.85221659957, 427861.7030791526),
    "Laâyoune-Sakia El Hamra": (-452163189.50732774, 23777614.312995747, 1424568.6105868893, 1225.4153371571465),
    "Marrakech-Safi": (-859034964.2931361, 23843194.044664875, 151813.4221894953, 300419.78504665446),
    "Oriental": (-965823292.7294213, 92906001.74314561, 234975.31276205444, -209013.88780028952),
    "Rabat-Salé-Kénitra": (-198068003.8375749, 3990694.8839878566, 4478.622242531856, 77090.86797711515),
    "Souss-Massa": (-2356575808.4518914, 120356403.23536505, 710014.7274596494, 142635.66650035518),
    "Tanger-Tétouan-Al Hoceïma": (-926807170.2146193, 8629097.307845984, 125543.96345687777, 556269.2226169758),
}


def shipped_coefficients(spark: SparkSession) -> DataFrame:
    schema = f"{N.REGION} string, " + ", ".join(f"{c} double" for c in COEFFICIENT_COLUMNS)
    return spark.createDataFrame([(r, *v) for r, v in WEATHER_COEFFICIENTS.items()], schema)


def weather_correction(diff: DataFrame, latest: DataFrame, coefficients: DataFrame) -> DataFrame:
    """Sum of (latest + difference) times coefficient, plus intercept; 0 for a region without coefficients."""
    rows = diff.join(latest, N.REGION, "left").join(coefficients.withColumn("_known", F.lit(True)), N.REGION, "left")
    value = ((F.col("temp_min_latest") + F.col("temp_min_diff")) * F.col("coef_temperature_min")
             + (F.col("precipitation_sum_latest") + F.col("precipitation_sum_diff")) * F.col("coef_precipitation")
             + (F.col("et0_latest") + F.col("et0_diff")) * F.col("coef_et0") + F.col("implicit_intercept"))
    return rows.select(N.REGION, N.ANNEE, F.when(F.col("_known"), value).otherwise(F.lit(0.0)).alias("correction"))


def learned_growth(pred: DataFrame, value: str = "consommation") -> DataFrame:
    """Mean year-over-year growth of a region's predictions."""
    prev = F.lag(value).over(W.partitionBy(N.REGION).orderBy(N.ANNEE))
    rows = pred.withColumn("_g", F.try_divide(F.col(value) - prev, prev))
    return rows.groupBy(N.REGION).agg(F.avg("_g").alias("learned_growth_rate"))


def previous_ev(ev: DataFrame) -> DataFrame:
    return ev.withColumn("ev_prev", F.lag("ev").over(W.partitionBy(N.REGION).orderBy(N.ANNEE)))


def missing_years(pred: DataFrame, ev: DataFrame) -> DataFrame:
    """Prediction years without EV data."""
    return pred.select(N.ANNEE).distinct().join(ev.select(N.ANNEE).distinct(), N.ANNEE, "left_anti")


def ev_correction(ev: DataFrame, pred: DataFrame, value: str = "consommation") -> DataFrame:
    """EV load beyond what the learned growth already carries, for the prediction years.

    A prediction year absent from the EV table fails the job. Regions without predictions have growth 0.
    """
    years = pred.select(N.ANNEE).distinct()
    absent = missing_years(pred, ev).agg(F.array_join(F.array_sort(F.collect_list(F.col(N.ANNEE).cast("string"))), ", ").alias("_absent"))
    rows = previous_ev(ev).join(learned_growth(pred, value), N.REGION, "left").join(years, N.ANNEE, "left_semi")
    rows = rows.crossJoin(F.broadcast(absent))
    growth = F.coalesce("learned_growth_rate", F.lit(0.0))
    value_col = F.coalesce(F.col("ev") - F.col("ev_prev") * (1 + growth), F.lit(0.0))
    checked = F.when(F.col("_absent") != "", F.raise_error(F.concat(F.lit("no EV data for years "), F.col("_absent"))).cast("double")).otherwise(value_col)
    return rows.select(N.REGION, N.ANNEE, checked.alias("correction"))


def apply_to_annual(pred: DataFrame, correction: DataFrame, name: str = "correction", value: str = "consommation") -> DataFrame:
    """Add the correction (0 when none) and the adjusted value to annual forecasts."""
    c = correction.select(N.REGION, N.ANNEE, F.col("correction").alias(name))
    return (pred.join(c, [N.REGION, N.ANNEE], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
            .withColumn(f"ajuste_{name}", F.col(value) + F.col(name)))


def yearly_share(pred: DataFrame, value: str = "consommation") -> DataFrame:
    """Share of each row in its region-year; a zero year spreads evenly over 12.

    Totals are aggregated and joined back rather than windowed: a region's rows may be many contracts.
    """
    totals = pred.groupBy(N.REGION, N.ANNEE).agg(F.sum(value).alias("_total"))
    return pred.join(totals, [N.REGION, N.ANNEE]).withColumn(
        "part", F.coalesce(F.try_divide(F.col(value), F.col("_total")), F.lit(1.0) / 12)).drop("_total")


def apply_to_monthly(pred: DataFrame, correction: DataFrame, name: str = "correction", value: str = "consommation") -> DataFrame:
    """Spread the yearly correction over months by their share of the year."""
    c = correction.select(N.REGION, N.ANNEE, F.col("correction").alias("_y"))
    return (yearly_share(pred, value).join(c, [N.REGION, N.ANNEE], "left")
            .withColumn(name, F.coalesce("_y", F.lit(0.0)) * F.col("part"))
            .withColumn(f"ajuste_{name}", F.col(value) + F.col(name)).drop("part", "_y"))


def coefficients_by_region(fits: DataFrame) -> DataFrame:
    """Mean over the fits of an activity, summed over the activities of a region."""
    means = fits.groupBy(N.REGION, N.ACTIVITE).agg(*[F.avg(c).alias(c) for c in COEFFICIENT_COLUMNS])
    return means.groupBy(N.REGION).agg(*[F.sum(c).alias(c) for c in COEFFICIENT_COLUMNS])


FEATURES = {"coef_temperature_min": "apparent_temperature_min", "coef_precipitation": "precipitation_sum",
            "coef_et0": "et0_fao_evapotranspiration_sum"}


def _contribution():
    # absent contributions count as 0, as in a row sum that skips missing values
    total = F.coalesce(F.col("implicit_intercept"), F.lit(0.0))
    for coef, feature in FEATURES.items():
        total = total + F.coalesce(F.col(coef) * F.col(feature), F.lit(0.0))
    return total


def simulate_correction(pred: DataFrame, sensitivities: DataFrame) -> DataFrame:
    """Weather contribution to each prediction's error and the errors before and after it is added."""
    rows = pred.join(sensitivities, [N.REGION, N.ACTIVITE], "left").withColumn("contribution", _contribution())
    a, p = F.col("actual"), F.col("prediction")
    rows = (rows.withColumn("error", a - p).withColumn("corrected", p + F.col("contribution"))
            .withColumn("error_corrected", a - F.col("corrected")))
    explained = F.try_divide(F.col("contribution"), F.col("error")) * 100
    return (rows.withColumn("error_pct", F.try_divide(F.col("error"), a) * 100)
            .withColumn("error_corrected_pct", F.try_divide(F.col("error_corrected"), a) * 100)
            .withColumn("explained_pct", F.when(explained.isNotNull(), F.greatest(F.lit(-200.0), F.least(F.lit(200.0), explained)))))


def correction_summary(simulated: DataFrame, keys) -> DataFrame:
    """RMSE and MAE before and after, with the percent change."""
    def rmse(c):
        return F.sqrt(F.avg(F.col(c) * F.col(c)))

    s = simulated.groupBy(*keys).agg(
        rmse("error").alias("rmse"), rmse("error_corrected").alias("rmse_corrected"),
        F.avg(F.abs("error")).alias("mae"), F.avg(F.abs("error_corrected")).alias("mae_corrected"),
        F.avg("explained_pct").alias("explained_pct"))
    return (s.withColumn("rmse_change_pct", F.try_divide(F.col("rmse") - F.col("rmse_corrected"), F.col("rmse")) * 100)
            .withColumn("mae_change_pct", F.try_divide(F.col("mae") - F.col("mae_corrected"), F.col("mae")) * 100))


def absolute_prediction(rows: DataFrame, sensitivities: DataFrame) -> DataFrame:
    """Prediction straight from weather and sensitivities, and its error."""
    out = rows.join(sensitivities, [N.REGION, N.ACTIVITE], "left").withColumn("prediction", _contribution())
    return out.withColumn("error", F.col("actual") - F.col("prediction")).withColumn(
        "error_pct", F.try_divide(F.col("error"), F.col("actual")) * 100)
