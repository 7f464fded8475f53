"""Queries over metrics, selection, intervals and correlations."""

from pyspark.sql import functions as F

from wattline import names as N
from wattline.catalog.aggregates import _RESULTS, naive_results
from wattline.catalog.registry import query
from wattline.catalog.windows import ACT, annual
from wattline.operators import correlation as C, metrics as M
from wattline.operators.weather_regression import X

_MAE = "avg(abs(actual - prediction))"
_MAPE = "avg(case when actual <> 0 then abs((actual - prediction) / actual) end) * 100"
_R2 = ("case when count(*) >= 2 and var_pop(actual) > 0 then 1 - sum((actual - prediction) ** 2) / (count(*) * "
       "var_pop(actual)) end")

# Back-test of three naive monthly rules per region and activity.
_NAIVE = ("m as (select region, activite, annee, mois, sum(consommation_kwh) as v from cd group by 1, 2, 3, 4), pm as (select c.region, c.activite, "
          "c.annee, c.mois, k.config, k.ordinal, c.v as actual, p.v * k.f as prediction from m c join m p on p.region = c.region and p.activite = "
          "c.activite and p.annee = c.annee - 1 and p.mois = c.mois cross join (values ('same', 1, 1.0), ('up', 2, 1.2), ('down', 3, 0.5)) k(config, "
          "ordinal, f))")
_ANN = ("pa as (select region, activite, config, ordinal, annee, sum(actual) as actual, sum(prediction) as prediction from pm group by 1, 2, 3, 4, 5), "
        f"res as (select region, activite, config, ordinal, {_MAE} as annual_mae, {_MAPE} as annual_mape, {_R2} as annual_r2 from pa group by 1, 2, 3, 4)")
KEYS = [N.REGION, N.ACTIVITE]


def naive_monthly(t):
    m = t.cd.groupBy(*KEYS, N.ANNEE, N.MOIS).agg(F.sum(N.CONSO).alias("actual"))
    rules = F.array(*[F.struct(F.lit(n).alias("config"), F.lit(i).alias("ordinal"), F.lit(f).alias("f"))
                      for n, i, f in (("same", 1, 1.0), ("up", 2, 1.2), ("down", 3, 0.5))])
    last = m.select(*KEYS, (F.col(N.ANNEE) + 1).alias(N.ANNEE), N.MOIS, F.col("actual").alias("p"), F.explode(rules).alias("k"))
    return m.join(last, [*KEYS, N.ANNEE, N.MOIS]).select(*KEYS, N.ANNEE, N.MOIS, "k.config", "k.ordinal", "actual",
                                                         (F.col("p") * F.col("k.f")).alias("prediction"))


def naive_annual_results(t):
    pm = naive_monthly(t)
    pa = pm.groupBy(*KEYS, "config", "ordinal", N.ANNEE).agg(F.sum("actual").alias("actual"), F.sum("prediction").alias("prediction"))
    return M.annual_metrics(pa, [*KEYS, "config", "ordinal"])


@query("mape_g01", "contrat:i mape:d mape_above:d",
       "select contrat, avg(case when a <> 0 then abs((a - p) / a) end) * 100 as mape, avg(case when abs(a) > 1e-10 then abs((a - p) / a) end) * 100 "
       "as mape_above from (select contrat, annee, sum(consommation_zconhp) as a, sum(consommation_zconhc) as p from cd group by 1, 2) x group by 1", "cd")
def _(t):
    pairs = t.cd.groupBy(N.CONTRAT, N.ANNEE).agg(F.sum(N.ZCONHP).alias("a"), F.sum(N.ZCONHC).alias("p"))
    a, p = F.col("a"), F.col("p")
    return pairs.groupBy(N.CONTRAT).agg(M.mape(a, p).alias("mape"), M.mape(a, p, 1e-10).alias("mape_above"))


@query("all_metrics_g02", "region:s activite:s config:s monthly_mae:d monthly_mape:d monthly_r2:d annual_mae:d annual_mape:d annual_r2:d",
       f"select a.*, annual_mae, annual_mape, annual_r2 from (select region, activite, config, {_MAE} as monthly_mae, {_MAPE} as monthly_mape, {_R2} as "
       "monthly_r2 from pm group by 1, 2, 3) a join res on res.region = a.region and res.activite = a.activite and res.config = a.config", "cd",
       _NAIVE + ", " + _ANN, scale=6)
def _(t):
    return M.all_metrics(naive_monthly(t), [*KEYS, "config"])


_BEST = ("select region, activite, config, annual_mae, annual_r2 from (select *, row_number() over (partition by region, activite order by coalesce("
         "annual_r2 >= -1, false) desc, case when annual_r2 >= -1 then annual_mae end asc nulls last, annual_r2 desc nulls last, ordinal) as k from res) "
         "x where k = 1")


@query("best_model_g03", "region:s activite:s config:s annual_mae:d annual_r2:d", _BEST, "cd", _NAIVE + ", " + _ANN)
def _(t):
    return M.select_best(naive_annual_results(t), KEYS, "ordinal", -1.0)


@query("best_model_or_empty_g04", "region:s activite:s config:s annual_mae:d",
       f"select k.region, k.activite, config, annual_mae from (select distinct region, activite from cd) k left join (select * from ({_BEST}) b where "
       "region <> 'ASIA') b on b.region = k.region and b.activite = k.activite", "cd", _NAIVE + ", " + _ANN)
def _(t):
    return M.select_best_or_empty(t.cd.select(*KEYS).distinct(), naive_annual_results(t).filter(F.col(N.REGION) != "ASIA"), KEYS, "ordinal", -1.0)


@query("valid_models_g05", "region:s activite:s config:s n:i",
       "select region, activite, config, count(*) as n from pm group by 1, 2, 3 having not (config = 'up' and activite = 'BUILDING' and count(*) filter (where mois "
       "= 3) > 0) and not (config = 'down' and region = 'ASIA' and count(*) filter (where mois = 7) > 0)", "cd", _NAIVE)
def _(t):
    p = F.col("prediction")
    broken = (F.when((F.col("config") == "up") & (F.col(N.ACTIVITE) == "BUILDING") & (F.col(N.MOIS) == 3), F.lit(float("nan")))
              .when((F.col("config") == "down") & (F.col(N.REGION) == "ASIA") & (F.col(N.MOIS) == 7), F.lit(float("inf"))).otherwise(p))
    rows = naive_monthly(t).withColumn("prediction", broken)
    return M.drop_invalid(rows, [*KEYS, "config"]).groupBy(*KEYS, "config").agg(F.count(F.lit(1)).alias("n"))


@query("residual_interval_g06", "region:s activite:s mois:i prediction:d bas:d haut:d",
       "select region, activite, mois, max(case when annee = 2001 then prediction end) as prediction, max(case when annee = 2001 then prediction end) + "
       "quantile_cont(actual - prediction, 0.025) filter (where annee <> 2001) as bas, max(case when annee = 2001 then prediction end) + "
       "quantile_cont(actual - prediction, 0.975) filter (where annee <> 2001) as haut from pm where config = 'same' group by 1, 2, 3", "cd", _NAIVE, scale=6)
def _(t):
    return M.residual_interval(naive_monthly(t).filter("config = 'same'"), KEYS, F.lit(2001))


@query("pinball_lambda_g07", "region:s activite:s lam:d",
       "select region, activite, min(z) as lam from (select region, activite, z, sum(p) over (partition by region, activite order by z rows between "
       "unbounded preceding and current row) / sum(p) over (partition by region, activite) as cdf from (select region, activite, actual / prediction - 1 "
       "as z, prediction as p from pm where config = 'same' and prediction > 1e-8) a) b where cdf >= 0.6 group by 1, 2", "cd", _NAIVE, scale=6)
def _(t):
    penalty = 1.5
    rows = naive_monthly(t).filter("config = 'same' and prediction > 1e-8").withColumn("z", F.col("actual") / F.col("prediction") - 1)
    return M.weighted_quantile(rows, KEYS, "z", "prediction", penalty / (1 + penalty)).withColumnRenamed("quantile", "lam")


_RA = "ra as (select region || '|' || activite as k, annee, sum(consommation_kwh) as v from cd where annee < 2001 group by 1, 2)"


@query("correlated_pairs_g08", "serie_1:s serie_2:s correlation:d",
       "select a.k as serie_1, b.k as serie_2, corr(a.v, b.v) as correlation from ra a join ra b on b.annee = a.annee and a.k < b.k group by 1, 2 having "
       "abs(corr(a.v, b.v)) >= 0.85", "cd", _RA, scale=6)
def _(t):
    yearly = t.history.groupBy(F.concat_ws("|", *KEYS).alias("k"), N.ANNEE).agg(F.sum(N.CONSO).alias("v"))
    return C.correlated_pairs(yearly, "k", "v", 0.85)


@query("most_correlated_contracts_g08", "contrat:i correlation:d",
       "select contrat, correlation from (select b.contrat, case when var_pop(a.v) > 0 and var_pop(b.v) > 0 then corr(a.v, b.v) end as correlation from y "
       "a join y b on b.annee = a.annee and b.contrat <> a.contrat where a.contrat = 10 group by 1) x where correlation is not null order by "
       "round(abs(correlation), 9) desc, contrat limit 20", "cd",
       "y as (select contrat, annee, sum(consommation_kwh) as v from cd group by 1, 2)", scale=6)
def _(t):
    yearly = t.cd.groupBy(N.CONTRAT, N.ANNEE).agg(F.sum(N.CONSO).alias("v"))
    return C.most_correlated(yearly, N.CONTRAT, "v", 10, top_n=20)


@query("measure_correlation_g08", "contrat:i correlation:d",
       "select contrat, case when var_pop(v) > 0 and var_pop(p) > 0 then corr(v, p) end as correlation from (select contrat, annee, sum(consommation_kwh) "
       "as v, sum(puissance_facturee) as p from cd group by 1, 2) x group by 1", "cd", scale=6)
def _(t):
    yearly = t.cd.groupBy(N.CONTRAT, N.ANNEE).agg(F.sum(N.CONSO).alias("v"), F.sum(N.PF).alias("p"))
    return C.measure_correlation(yearly, [N.CONTRAT], "v", "p")


@query("weather_correlation_g09", "a:s b:s correlation:d",
       " union all ".join(f"select '{a}' as a, '{b}' as b, corr({a}, {b}) as correlation from weather" for i, a in enumerate(X) for b in X[i + 1:]),
       "weather", scale=6)
def _(t):
    return C.correlation_matrix(t.weather, X)
