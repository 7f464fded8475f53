"""Business rules on forecasts: imputation, corrections, splits, allocation and blending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wattline import names as N
from wattline.functions import columns as C
from wattline.operators.asof import latest_at
from wattline.operators.cleaning import non_negative_forecast


def extrapolate_features(df: DataFrame, keys, cols, target_year: int) -> DataFrame:
    """Carry features to ``target_year`` with the growth of the last year (not compounded over added years)."""
    pairs = df.groupBy(*keys).agg(F.max(F.struct(N.ANNEE, *cols)).alias("_l"), F.collect_list(F.struct(N.ANNEE, *cols)).alias("_all"))
    pairs = pairs.filter(F.col(f"_l.{N.ANNEE}") < target_year)
    prev = F.filter("_all", lambda r: r[N.ANNEE] == F.col(f"_l.{N.ANNEE}") - 1)
    pairs = pairs.withColumn("_p", F.get(prev, F.lit(0)))

    def grown(c):
        last, before = F.col(f"_l.{c}"), F.col(f"_p.{c}")
        checked = F.when(F.col("_p").isNull(), F.raise_error(F.lit(f"{c}: the year before the last one is missing")).cast("double")).otherwise(before)
        return F.when(checked != 0, last * (1 + (last - before) / F.nullif(before, F.lit(0.0)))).otherwise(last).alias(c)

    added = pairs.select(*keys, F.explode(F.sequence(F.col(f"_l.{N.ANNEE}") + 1, F.lit(target_year).cast("bigint"))).alias(N.ANNEE),
                         *[grown(c) for c in cols])
    return df.select(*keys, N.ANNEE, *cols).unionByName(added)


def impute_year(df: DataFrame, keys, value: str, year: int = 2020) -> DataFrame:
    """Replace a year's existing rows by the mean of its two neighbours, month by month; null when one lacks."""
    on = [*keys, N.MOIS]

    def of(y):
        return F.max(F.when(F.col(N.ANNEE) == y, F.col(value)))

    near = df.filter(F.col(N.ANNEE).isin(year - 1, year + 1)).groupBy(*on).agg(((of(year - 1) + of(year + 1)) / 2).alias("_mean"))
    return df.join(near, on, "left").withColumn(
        value, F.when(F.col(N.ANNEE) == year, F.col("_mean")).otherwise(F.col(value))).select(*df.columns)


def ensure_years(df: DataFrame, first: int, last: int, measures) -> DataFrame:
    """Twelve zero rows for every year of the range a contract lacks; attributes copied from its first row."""
    attrs = [c for c in df.columns if c not in (N.CONTRAT, N.ANNEE, N.MOIS, *measures)]
    ym = C.month_key()
    template = df.groupBy(N.CONTRAT).agg(
        F.collect_set(N.ANNEE).alias("_years"), *[F.min_by(a, F.when(F.col(a).isNotNull(), ym)).alias(a) for a in attrs])
    wanted = F.sequence(F.lit(first).cast("bigint"), F.lit(last).cast("bigint"))
    months = F.sequence(F.lit(1).cast("bigint"), F.lit(12).cast("bigint"))
    added = (template.select(N.CONTRAT, *attrs, F.explode(F.array_except(wanted, "_years")).alias(N.ANNEE))
             .withColumn(N.MOIS, F.explode(months)))
    return df.unionByName(added.select(*[F.lit(0.0).alias(c) if c in measures else F.col(c) for c in df.columns]))


def correct_with_realised(forecast: DataFrame, realised: DataFrame, keys, value: str = "consommation", bands=()) -> DataFrame:
    """Replace the first n forecast months by the n realised ones and scale the rest by their mean ratio.

    Applies per key and year with exactly 12 forecast rows and at least one realised one; months pair up
    by position. ``bands`` keep their share of the total.
    """
    on = [*keys, N.ANNEE]
    order = W.partitionBy(*on).orderBy(N.MOIS)
    real = realised.select(*on, F.row_number().over(order).alias("_i"), F.col(value).alias("_real"))
    whole = W.partitionBy(*on)
    rows = forecast.withColumn("_i", F.row_number().over(order)).join(real, [*on, "_i"], "left")
    ratio = F.when(F.col("_real").isNotNull(), F.try_divide(F.col("_real"), F.col(value)))
    rows = (rows.withColumn("_factor", F.coalesce(F.avg(ratio).over(whole), F.lit(1.0)))
            .withColumn("_ok", (F.count(F.lit(1)).over(whole) == 12) & (F.count("_real").over(whole) > 0)))
    fixed = F.when(~F.col("_ok"), F.col(value)).otherwise(F.coalesce(F.col("_real"), F.col(value) * F.col("_factor")))
    rows = rows.withColumn("_new", fixed)
    for b in bands:
        share = F.when(F.col(value) > 0, F.col(b) / F.nullif(F.col(value), F.lit(0.0))).otherwise(F.lit(0.0))
        rows = rows.withColumn(b, F.when(F.col("_ok"), F.col("_new") * share).otherwise(F.col(b)))
    return rows.withColumn(value, F.col("_new")).select(*forecast.columns)


def adjustment_factor(pred: Column, realised: Column) -> Column:
    """Twelve corrected months from two arrays (12 predictions, n <= 12 realised values)."""
    pairs = F.filter(F.arrays_zip(pred.alias("p"), realised.alias("r")), lambda x: x["r"].isNotNull() & (x["p"] != 0))
    total = F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x["r"] / x["p"])
    factor = F.when(F.size(pairs) > 0, total / F.nullif(F.size(pairs), F.lit(0))).otherwise(F.lit(1.0))
    return F.concat(realised, F.transform(F.slice(pred, F.size(realised) + 1, 12), lambda p: p * factor))


def _tension(c: str) -> Column:
    return F.when(F.col(c).isNull() | (F.col(c) == ""), N.DEFAULT_TENSION).otherwise(F.col(c))


def split_bands(forecast: DataFrame, contracts: DataFrame, value: str = "consommation") -> DataFrame:
    """Monthly contract forecast into tariff bands by the shares of the contract's latest known month."""
    history = [f"_h_{b}" for b in N.BANDS]
    hist = contracts.select(N.CONTRAT, N.ANNEE, N.MOIS, *[F.col(b).alias(h) for b, h in zip(N.BANDS, history)], N.PF, N.TENSION)
    rows = latest_at(forecast, hist, [N.CONTRAT], C.month_key(), C.month_key(), [*history, N.PF, N.TENSION])
    total = F.col(history[0]) + F.col(history[1]) + F.col(history[2])
    for b, h in zip(N.BANDS, history):
        rows = rows.withColumn(b, F.col(value) * F.when(total > 0, F.col(h) / F.nullif(total, F.lit(0.0))).otherwise(F.lit(1) / F.lit(3)))
    return rows.withColumn(N.TENSION, _tension(N.TENSION)).drop(*history)


def first_attributes(df: DataFrame, cols) -> DataFrame:
    """The earliest month's attributes per contract."""
    return df.groupBy(N.CONTRAT).agg(F.min(F.struct(C.month_key().alias("ym"), *cols)).alias("x")).select(N.CONTRAT, *[F.col(f"x.{c}").alias(c) for c in cols])


def operating_contracts(targets: DataFrame, contracts: DataFrame, spans: DataFrame, entity: str) -> DataFrame:
    """Every (entity, year) target with the contracts of the entity that have not moved out before the year."""
    info = first_attributes(contracts, [N.REGION, N.PARTENAIRE, N.ACTIVITE])
    live = info.join(spans.select(N.CONTRAT, "finish_year"), N.CONTRAT)
    return live.join(targets, entity).filter(F.col("finish_year") >= F.col(N.ANNEE)).drop("finish_year")


def allocate_to_contracts(pred: DataFrame, contracts: DataFrame, spans: DataFrame, entity: str, value: str = "consommation") -> DataFrame:
    """Annual entity forecast down to its operating contracts by billed power, then into bands.

    Entity totals are a grouped aggregate joined back, so an entity with very many contracts is never
    gathered in one window.
    """
    realised = contracts.groupBy(entity, N.ANNEE).agg(F.sum(N.CONSO).alias(value))
    targets = non_negative_forecast(pred.filter(F.col(entity).isNotNull()).select(entity, N.ANNEE, value), realised, [entity], value)
    rows = operating_contracts(targets, contracts, spans, entity)
    ym = C.month_key()
    yearly = contracts.groupBy(N.CONTRAT, N.ANNEE).agg(
        *[F.sum(b).alias(f"_h_{b}") for b in N.BANDS], F.sum(N.PF).alias(N.PF), F.min_by(N.TENSION, F.when(F.col(N.TENSION).isNotNull(), ym)).alias(N.TENSION))
    history = [f"_h_{b}" for b in N.BANDS]
    rows = latest_at(rows, yearly, [N.CONTRAT], F.col(N.ANNEE), F.col(N.ANNEE), [*history, N.PF, N.TENSION])
    rows = rows.withColumn(N.PF, F.coalesce(N.PF, F.lit(0.0)))
    totals = rows.groupBy(entity, N.ANNEE).agg(F.sum(N.PF).alias("_pf"), F.count(F.lit(1)).alias("_n"))
    rows = rows.join(totals, [entity, N.ANNEE])
    share = F.when(F.col("_pf") > 0, F.col(N.PF) / F.nullif(F.col("_pf"), F.lit(0.0))).otherwise(F.lit(1.0) / F.col("_n"))
    rows = rows.withColumn(value, F.col(value) * share)
    total = F.col(history[0]) + F.col(history[1]) + F.col(history[2])
    for b, h in zip(N.BANDS, history):
        rows = rows.withColumn(b, F.col(value) * F.when(total > 0, F.col(h) / F.nullif(total, F.lit(0.0))).otherwise(F.lit(1) / F.lit(3)))
    return rows.withColumn(N.TENSION, _tension(N.TENSION)).select(
        N.REGION, N.PARTENAIRE, N.CONTRAT, N.ACTIVITE, N.ANNEE, value, *N.BANDS, N.PF, N.TENSION)


def choose_total_method(annual: DataFrame, keys=(N.REGION,), total: str = N.TOTAL) -> DataFrame:
    """Per region: does the sum of the activities beat the direct total over three back-test years?

    ``annual`` holds (keys, activite, annee, actual, prediction). The newest of at least four evaluated
    years of the total is left out; an activity without a prediction voids its year.
    """
    is_total = F.col(N.ACTIVITE) == total
    years = annual.filter(is_total).select(*keys, N.ANNEE, F.col("actual").alias("_a"), F.col("prediction").alias("_p"))
    newest = W.partitionBy(*keys).orderBy(F.desc(N.ANNEE))
    years = (years.withColumn("_r", F.row_number().over(newest)).withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*keys)))
             .filter("_n >= 4 and _r between 2 and 4 and _a <> 0"))
    parts = annual.filter(~is_total)
    n_activities = parts.select(*keys, N.ACTIVITE).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("_na"))
    summed = parts.groupBy(*keys, N.ANNEE).agg(F.sum("prediction").alias("_s"), F.count("prediction").alias("_np"))
    summed = summed.join(n_activities, list(keys)).filter("_np = _na").select(*keys, N.ANNEE, "_s")
    both = years.join(summed, [*keys, N.ANNEE], "left")
    direct = F.avg(F.abs((F.col("_p") - F.col("_a")) / F.nullif(F.col("_a"), F.lit(0.0))) * 100)
    by_sum = F.avg(F.abs((F.col("_s") - F.col("_a")) / F.nullif(F.col("_a"), F.lit(0.0))) * 100)
    scored = both.groupBy(*keys).agg(direct.alias("mape_total"), by_sum.alias("mape_somme"),
                                     (F.count("_s") == F.count(F.lit(1))).alias("_complete"))
    regions = annual.select(*keys).distinct()
    use = F.coalesce(F.col("_complete") & (F.col("mape_somme") < F.col("mape_total")), F.lit(False))
    return regions.join(scored, list(keys), "left").select(*keys, "mape_total", "mape_somme", use.alias("somme"))


def rebuild_total(forecast: DataFrame, choice: DataFrame, keys=(N.REGION,), value: str = "consommation") -> DataFrame:
    """Replace 'Total' by the sum of the activities where the choice says so."""
    flagged = forecast.join(choice.select(*keys, "somme"), list(keys), "left")
    kept = flagged.filter((F.col(N.ACTIVITE) != N.TOTAL) | ~F.coalesce("somme", F.lit(False))).drop("somme")
    summed = (flagged.filter(F.col("somme") & (F.col(N.ACTIVITE) != N.TOTAL)).groupBy(*keys, N.ANNEE, N.MOIS)
              .agg(F.sum(value).alias(value)).withColumn(N.ACTIVITE, F.lit(N.TOTAL)))
    return kept.unionByName(summed.select(*kept.columns))


def remaining_and_next(current: DataFrame, following: DataFrame, status: DataFrame, keys) -> DataFrame:
    """Months of the current year after the last realised one, and the whole next year."""
    rest = current.join(status, list(keys)).filter(
        (F.col(N.ANNEE) == F.col("derniere_annee")) & (F.col(N.MOIS) > F.col("dernier_mois"))).select(*current.columns)
    nxt = following.join(status, list(keys)).filter(F.col(N.ANNEE) == F.col("derniere_annee") + 1).select(*current.columns)
    return rest.unionByName(nxt)


def latest_status(df: DataFrame, keys=()) -> DataFrame:
    """Newest year and month of a table (or per key)."""
    newest = F.max(F.struct(N.ANNEE, N.MOIS)).alias("x")
    got = df.groupBy(*keys).agg(newest)
    return got.select(*keys, F.col(f"x.{N.ANNEE}").alias("derniere_annee"), F.col(f"x.{N.MOIS}").alias("dernier_mois"),
                      (F.col(f"x.{N.MOIS}") == 12).alias("complete"))


def monthly_from_annual(annual: DataFrame, curve: DataFrame, keys, value: str = "consommation") -> DataFrame:
    """Spread annual values over months by a curve of shares."""
    return annual.join(curve, list(keys)).withColumn(value, F.col(value) * F.col("part")).drop("part")


def blend_curves(mean: DataFrame, client: DataFrame, keys, weight: float) -> DataFrame:
    """(1 - w) of the mean curve plus w of the client curve; the mean curve alone where no client curve is."""
    other = client.select(*keys, N.MOIS, F.col("part").alias("_c"))
    joined = mean.join(other, [*keys, N.MOIS], "left")
    whole = W.partitionBy(*keys)
    usable = F.count("_c").over(whole) == F.count("part").over(whole)
    return joined.withColumn("part", F.when(usable, (1 - weight) * F.col("part") + weight * F.col("_c")).otherwise(F.col("part"))).drop("_c")


def with_placeholder_year(monthly: DataFrame, keys, evaluation_year: int, value: str, carried=()) -> DataFrame:
    """Copy the last year as ``evaluation_year`` when that is the next one; a wider gap fails the job.

    ``carried`` names further columns that the copy takes along.
    """
    last = monthly.groupBy(*keys).agg(F.max(N.ANNEE).alias("_last"))
    rows = monthly.join(last, list(keys))
    gap = F.lit(evaluation_year) - F.col("_last")
    copied = rows.filter((F.col(N.ANNEE) == F.col("_last")) & (gap >= 1)).withColumn(
        N.ANNEE, F.when(gap == 1, F.lit(evaluation_year)).otherwise(
            F.raise_error(F.lit("evaluation year lies more than one year after the data")).cast("int")).cast("bigint"))
    cols = [*keys, N.ANNEE, N.MOIS, value, *carried]
    return monthly.select(*cols).withColumn("is_placeholder", F.lit(False)).unionByName(
        copied.select(*cols).withColumn("is_placeholder", F.lit(True)))


def prediction_report(pred: DataFrame) -> DataFrame:
    """Predictions next to actuals with percent error."""
    return pred.withColumn("percent_error", C.percent_error(F.col("prediction"), F.col("actual")))


def upsert(history: DataFrame, forecast: DataFrame, keys, value: str, scope) -> DataFrame:
    """Forecast values replace history on equal keys and extend it elsewhere.

    Only the entities (``scope`` columns) that have a forecast are kept.
    """
    covered = history.join(forecast.select(*scope).distinct(), list(scope), "left_semi")
    shared = [c for c in history.columns if c not in keys and c != value and c in forecast.columns]
    f = forecast.select(*keys, F.col(value).alias("_f"), *[F.col(c).alias(f"_f_{c}") for c in shared])
    joined = covered.withColumn("_here", F.lit(True)).join(f, list(keys), "full")
    out = joined.withColumn(value, F.coalesce("_f", value))
    for c in shared:
        out = out.withColumn(c, F.when(F.col("_here").isNull(), F.col(f"_f_{c}")).otherwise(F.col(c)))
    return out.select(*history.columns)


def evaluation_window(rows: DataFrame, forecast_year: int, back: int = 3) -> DataFrame:
    """Back-test years of a run: the forecast year and ``back`` years before it (0: that year alone)."""
    return rows.filter(F.col(N.ANNEE).between(forecast_year - back, forecast_year))


def horizon_rows(arrays: DataFrame, realised: DataFrame, keys, value: str = "consommation") -> DataFrame:
    """One row per horizon year from (keys, base, horizon array); negatives fall back on last year's realised value."""
    rows = arrays.select(*keys, "base", F.posexplode("horizon").alias("_i", value))
    rows = rows.select(*keys, (F.col("base") + F.col("_i") + 1).cast("bigint").alias(N.ANNEE), value)
    return non_negative_forecast(rows, realised, keys, value)
