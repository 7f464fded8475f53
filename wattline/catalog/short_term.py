"""Queries over the short-term model grid, its selection, ensemble and intervals."""

from pyspark.sql import functions as F

from wattline import names as N
from wattline.catalog.registry import query
from wattline.functions import series as S
from wattline.models import short_term as M
from wattline.operators import metrics as Q
from wattline.sources import tables as T

KEYS = [N.REGION, N.ACTIVITE]
_METRICS = "monthly_mae:d monthly_mape:d monthly_r2:d annual_mae:d annual_mape:d annual_r2:d"


def regional_monthly(t):
    """Dense series per region and activity plus the regional total, complete years only."""
    parts = t.history.groupBy(*KEYS, N.ANNEE, N.MOIS).agg(
        F.sum(N.CONSO).alias("v"), F.sum(N.PF).alias("p"))
    total = parts.groupBy(N.REGION, N.ANNEE, N.MOIS).agg(F.sum("v").alias("v"), F.sum("p").alias("p")).withColumn(N.ACTIVITE, F.lit(N.TOTAL))
    return parts.unionByName(total)


def packed_regional(t):
    exo = t.exogenous
    growth = S.growth_features(exo, [N.REGION], N.GDP, ("lag_lchg",), (1,))
    return M.pack_series(regional_monthly(t), KEYS, "v", exo, N.GDP, growth, [f"{c}_lchg_lag1" for c in N.GDP], power="p", feature_keys=[N.REGION])


@query("packed_series_h30", "region:s activite:s n_years:i first_year:i total:d",
       "select region, activite, count(distinct annee) as n_years, min(annee) as first_year, sum(v) as total from (select region, activite, annee, mois, "
       "sum(consommation_kwh) as v from cd where annee < 2001 group by 1, 2, 3, 4 union all select region, 'Total', annee, mois, sum(consommation_kwh) from cd where "
       "annee < 2001 group by 1, 3, 4) x group by 1, 2 having count(*) = 12 * count(distinct annee)", "cd", scale=2)
def _(t):
    p = packed_regional(t)
    total = F.aggregate(F.flatten("matrix"), F.lit(0.0), lambda a, v: a + v)
    return p.select(*KEYS, F.size("years").alias("n_years"), F.element_at("years", 1).alias("first_year"), total.alias("total"))


def _one_strategy(t, number):
    grid = M.grid_frame(t.spark).filter(F.col("strategy") == number)
    return M.score(M.fold_predictions(packed_regional(t), grid, KEYS))


for _n, _name in ((1, "pattern_autoregression_h05"), (2, "level_autoregression_h06"), (3, "blended_pattern_h07"), (4, "growth_strategy_h08")):
    query(_name, f"region:s activite:s ordinal:i n_folds:i {_METRICS}")(
        lambda t, n=_n: _one_strategy(t, n).withColumn("n_folds", F.size("annees")))


@query("strategy_ensemble_h09", f"region:s activite:s n_folds:i {_METRICS}")
def _(t):
    best = M.best_per_strategy(M.score(M.fold_predictions(packed_regional(t), M.grid_frame(t.spark), KEYS)), KEYS)
    return M.score(M.ensemble_of(best, KEYS)).withColumn("n_folds", F.size("annees"))


@query("short_term_selection_h30", f"region:s activite:s strategy:i ordinal:i {_METRICS}")
def _(t):
    return M.run_short_term(packed_regional(t), KEYS)


@query("short_term_intervals_h30", "region:s activite:s mois:i prediction:d bas:d haut:d")
def _(t):
    rows = M.long_predictions(M.run_short_term(packed_regional(t), KEYS, favor_overestimation=False), KEYS)
    return Q.residual_interval(rows, KEYS, F.lit(t.last_year))
