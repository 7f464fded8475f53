"""Row-level repairs: safety nets, contract renumbering, attribute copies, profiles and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from wattline import names as N
from wattline.functions import columns as C


def non_negative_forecast(pred: DataFrame, realised: DataFrame, keys, value: str) -> DataFrame:
    """A negative forecast becomes last year's realised value when that is not negative, else 0.

    Joins on the month too when the forecast is monthly.
    """
    on = [*keys, N.ANNEE] + ([N.MOIS] if N.MOIS in pred.columns else [])
    last = realised.select(*[(F.col(N.ANNEE) + 1).alias(N.ANNEE) if k == N.ANNEE else F.col(k) for k in on],
                           F.col(value).alias("_last"))
    fixed = (F.when(F.col(value) >= 0, F.col(value)).when(F.col("_last") >= 0, F.col("_last")).otherwise(F.lit(0.0)))
    return pred.join(last, on, "left").withColumn(value, fixed).drop("_last").select(*pred.columns)


def remap_contracts(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Replace (partenaire, contrat) pairs listed in the mapping."""
    hit = (F.col(N.PARTENAIRE) == F.col("old_partenaire")) & (F.col(N.CONTRAT) == F.col("old_contrat"))
    return (df.join(mapping, hit, "left")
            .withColumn(N.PARTENAIRE, F.coalesce("new_partenaire", N.PARTENAIRE))
            .withColumn(N.CONTRAT, F.coalesce("new_contrat", N.CONTRAT)).select(*df.columns))


def unmatched_mappings(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Mapping keys that no row carries."""
    keys = df.select(F.col(N.PARTENAIRE).alias("old_partenaire"), F.col(N.CONTRAT).alias("old_contrat")).distinct()
    return mapping.join(keys, ["old_partenaire", "old_contrat"], "left_anti").select("old_partenaire", "old_contrat")


def copy_attributes(df: DataFrame, attributes: DataFrame, pairs: DataFrame, cols) -> DataFrame:
    """Overwrite ``cols`` of every target contract by those of its source contract."""
    donor = pairs.join(attributes.withColumnRenamed(N.CONTRAT, "source"), "source").select(
        F.col("target").alias(N.CONTRAT), F.struct(*cols).alias("_donor"))
    out = df.join(donor, N.CONTRAT, "left")
    for c in cols:
        out = out.withColumn(c, F.when(F.col("_donor").isNotNull(), F.col(f"_donor.{c}")).otherwise(F.col(c)))
    return out.select(*df.columns)


def move_in_profile(dates: DataFrame, year: int) -> DataFrame:
    d = C.parse_date(F.col(N.DATE_IN))
    return dates.select(d.alias("d")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("d").alias("n_dates"), F.min("d").alias("first_date"),
        F.max("d").alias("last_date"), F.count_if(F.year("d") == year).alias(f"n_{year}"))


def holdout_split(annual: DataFrame, keys, periods: int, cut: int) -> DataFrame:
    """Three hold-out rules as columns: last ``periods`` rows, last year, years from ``cut``."""
    by = W.partitionBy(*keys)

    def side(is_test):
        return F.when(is_test, "test").otherwise("train")

    return (annual
            .withColumn("last_two", side(F.row_number().over(by.orderBy(F.desc(N.ANNEE))) <= periods))
            .withColumn("last_year", side(F.col(N.ANNEE) == F.max(N.ANNEE).over(by)))
            .withColumn("before_cut", side(F.col(N.ANNEE) >= cut)))
