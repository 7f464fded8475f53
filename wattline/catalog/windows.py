"""Queries over windows, ordering, set operations and feature joins."""

from pyspark.sql import Window as W, functions as F

from wattline import names as N
from wattline.catalog.aggregates import naive_results, _RESULTS
from wattline.catalog.joins import GROWTH, PRED, annual_predictions
from wattline.catalog.registry import query
from wattline.functions import series as S
from wattline.operators import adjustments as J, aggregates as A, joins as L, metrics as M, rules as R, windows as X
from wattline.sources import tables as T

ACT = "a as (select activite, annee, sum(consommation_kwh) as v, sum(puissance_facturee) as p from cd group by 1, 2)"
MON = "m as (select activite, annee, mois, sum(consommation_kwh) as v from cd group by 1, 2, 3)"
REG = "rm as (select region, annee, mois, sum(consommation_kwh) as v from cd group by 1, 2, 3)"


def annual(t):
    return t.cd.groupBy(N.ACTIVITE, N.ANNEE).agg(F.sum(N.CONSO).alias("v"), F.sum(N.PF).alias("p"))


def monthly(t, key=N.ACTIVITE):
    return t.cd.groupBy(key, N.ANNEE, N.MOIS).agg(F.sum(N.CONSO).alias("v"))


_LAG = "lag({0}) over (partition by region order by annee)"


@query("exogenous_change_e01", "region:s annee:i pct:d diff:d lchg:d lchg_eps:d",
       "select region, annee, coalesce((pib_mdh - p) / p, 0) as pct, coalesce(pib_mdh - p, 0) as diff, coalesce(ln(pib_mdh) - ln(p), 0) as "
       "lchg, coalesce(ln(pib_mdh + 1) - ln(p + 1), 0) as lchg_eps from (select *, lag(pib_mdh) over (partition by region order by annee) as "
       "p from exogenous) x", "exogenous")
def _(t):
    years = t.exogenous.select(N.REGION, N.ANNEE)
    out = years
    for name, kind, eps in (("pct", "pct", None), ("diff", "diff", None), ("lchg", "log", None), ("lchg_eps", "log", 1.0)):
        feature = S.exogenous_features(t.exogenous, years, [N.REGION], ["pib_mdh"], use_rate=True, kind=kind, epsilon=eps)
        out = out.join(feature.withColumnRenamed("pib_mdh", name), [N.REGION, N.ANNEE])
    return out


@query("exogenous_levels_e01", "region:s annee:i pib_mdh:d gdp_primaire:d",
       "select r.r_name as region, y as annee, coalesce(pib_mdh, 0) as pib_mdh, coalesce(gdp_primaire, 0) as gdp_primaire from region r cross "
       "join range(1994, 2004) ys(y) left join exogenous e on e.region = r_name and e.annee = y", "exogenous")
def _(t):
    years = t.raw("region").select(F.col("r_name").alias(N.REGION), F.explode(F.sequence(F.lit(1994), F.lit(2003)).cast("array<bigint>")).alias(N.ANNEE))
    return S.exogenous_features(t.exogenous, years, [N.REGION], ["pib_mdh", "gdp_primaire"])


@query("growth_features_e02", "region:s annee:i pib_mdh:d pib_mdh_lag1:d pib_mdh_lag2:d pib_mdh_lchg:d pib_mdh_lchg_lag1:d pib_mdh_lchg_lag2:d",
       "select region, annee, pib_mdh, " + ", ".join(
           f"coalesce({c}, avg({c}) over (partition by region), 0) as {c}" for c in
           ("pib_mdh_lag1", "pib_mdh_lag2", "pib_mdh_lchg_lag1", "pib_mdh_lchg_lag2")) + ", pib_mdh_lchg from (select *, "
       "lag(pib_mdh, 1) over w as pib_mdh_lag1, lag(pib_mdh, 2) over w as pib_mdh_lag2, lag(pib_mdh_lchg, 1) over w as pib_mdh_lchg_lag1, "
       "lag(pib_mdh_lchg, 2) over w as pib_mdh_lchg_lag2 from (select region, annee, pib_mdh, coalesce(l, lead(l) over (partition by region "
       "order by annee)) as pib_mdh_lchg from (select *, ln(pib_mdh) - ln(lag(pib_mdh) over (partition by region order by annee)) as l from "
       "exogenous) x) y window w as (partition by region order by annee)) z", "exogenous")
def _(t):
    return S.growth_features(t.exogenous, [N.REGION], ["pib_mdh"], ("level", "lag", "lchg", "lag_lchg"), (1, 2))


@query("annual_lags_e03", "activite:s annee:i v:d lag1:d lag2:d lag3:d",
       "select * from (select activite, annee, v, lag(v, 1) over w as lag1, lag(v, 2) over w as lag2, lag(v, 3) over w as lag3 from a window w "
       "as (partition by activite order by annee)) x where lag3 is not null", "cd", ACT, scale=2)
def _(t):
    return S.lag_vectors(annual(t), [N.ACTIVITE], "v", 3)


_GAP = ("g as (select region, annee, case when annee in (1995, 1997, 1998, 2001) then null else pib_mdh end as x, row_number() over (partition "
        "by region order by annee) as k from exogenous), k as (select * from g where x is not null)")


@query("linear_interpolation_e04", "region:s annee:i pib_mdh:d",
       "select g.region, g.annee, case when g.x is not null then g.x when l.k is null then r.x when r.k is null then l.x else l.x + (r.x - l.x) "
       "* (g.k - l.k) / (r.k - l.k) end as pib_mdh from g left join k l on l.region = g.region and l.k = (select max(k) from k q where q.region "
       "= g.region and q.k <= g.k) left join k r on r.region = g.region and r.k = (select min(k) from k q where q.region = g.region and q.k >= "
       "g.k)", "exogenous", _GAP)
def _(t):
    return S.with_interpolated(gappy(t), ["pib_mdh"], [N.REGION])


def gappy(t):
    keep = ~F.col(N.ANNEE).isin(1995, 1997, 1998, 2001)
    return t.exogenous.select(N.REGION, N.ANNEE, F.when(keep, F.col("pib_mdh")).alias("pib_mdh"))


@query("trimmed_interpolation_e04", "region:s annee:i pib_mdh:d",
       "select g.region, g.annee, case when g.x is not null then g.x else l.x + (r.x - l.x) * (g.k - l.k) / (r.k - l.k) end as pib_mdh from g "
       "left join k l on l.region = g.region and l.k = (select max(k) from k q where q.region = g.region and q.k <= g.k) left join k r on "
       "r.region = g.region and r.k = (select min(k) from k q where q.region = g.region and q.k >= g.k) where g.annee between 1996 and 2000",
       "exogenous", _GAP)
def _(t):
    return S.trim_and_interpolate(gappy(t), "pib_mdh", [N.REGION], min_points=5)


@query("same_month_ratio_e05", "activite:s annee:i mois:i ratio:d",
       "select c.activite, c.annee, c.mois, case when kc.n = kp.n then c.v / p.v end as ratio from m c join k kc on kc.activite = c.activite and "
       "kc.annee = c.annee left join m p on p.activite = c.activite and p.annee = c.annee - 1 and p.mois = c.mois left join k kp on kp.activite "
       "= c.activite and kp.annee = c.annee - 1", "cd", MON + ", k as (select activite, annee, count(*) as n from m group by 1, 2)", scale=6)
def _(t):
    return L.same_month_ratio(monthly(t), [N.ACTIVITE], "v")


@query("annual_growth_e06", "activite:s annee:i growth:d",
       "select activite, annee, (v - lag(v) over w) / lag(v) over w as growth from a window w as (partition by activite order by annee)",
       "cd", ACT, scale=6)
def _(t):
    return annual(t).withColumn("growth", S.change("v", [N.ACTIVITE], "pct"))


@query("growth_status_e07", "contrat:i annee:i consommation:d growth:d statut:s",
       "select contrat, annee, v as consommation, case when p <> 0 then (v - p) / p end as growth, case when p is null or (p = 0 and v = 0) "
       "then 'stopped' when p = 0 then 'start' when v = 0 then 'stop' end as statut from (select contrat, annee, v, lag(v) over (partition by "
       "contrat order by annee) as p from (select contrat, annee, sum(consommation_zconhp) as v from cd group by 1, 2) y) x", "cd")
def _(t):
    yearly = t.cd.groupBy(N.CONTRAT, N.ANNEE).agg(F.sum(N.ZCONHP).alias("consommation"))
    return X.growth_status(yearly, [N.CONTRAT], "consommation")


@query("annual_change_from_ratios_e08", "activite:s annee:i change:d change_prev:d",
       "select c.activite, c.annee, sum(c.v) / sum(p.v) as change, sum(c.v / p.v * p.v) / sum(p.v) as change_prev from m c join m p on "
       "p.activite = c.activite and p.annee = c.annee - 1 and p.mois = c.mois join k kc on kc.activite = c.activite and kc.annee = c.annee "
       "join k kp on kp.activite = c.activite and kp.annee = c.annee - 1 and kp.n = kc.n group by 1, 2", "cd",
       MON + ", k as (select activite, annee, count(*) as n from m group by 1, 2)",
       scale=6)
def _(t):
    ratios = L.same_month_ratio(monthly(t), [N.ACTIVITE], "v")
    return X.annual_change(ratios, [N.ACTIVITE], "v")


@query("log_growth_e09", "activite:s annee:i log_growth:d",
       "select activite, annee, ln(v / lag(v) over (partition by activite order by annee)) as log_growth from a", "cd", ACT, scale=6)
def _(t):
    return annual(t).withColumn("log_growth", S.change("v", [N.ACTIVITE], "log"))


@query("learned_growth_e10", "region:s learned_growth_rate:d", "select region, g as learned_growth_rate from gr", "cd", PRED + ", " + GROWTH, scale=6)
def _(t):
    return J.learned_growth(annual_predictions(t))


@query("previous_ev_e11", "region:s annee:i ev:d ev_prev:d",
       "select region, annee, ev, lag(ev) over (partition by region order by annee) as ev_prev from ev", "ev")
def _(t):
    return J.previous_ev(t.ev)


@query("yearly_share_e12", "region:s annee:i mois:i part:d",
       "select region, annee, mois, coalesce(v / nullif(sum(v) over (partition by region, annee), 0), 1.0 / 12) as part from rm", "cd", REG, scale=8)
def _(t):
    return J.yearly_share(monthly(t, N.REGION), "v")


@query("weighted_quantile_e13", "activite:s quantile:d",
       "select activite, min(z) as quantile from (select activite, z, sum(w) over (partition by activite order by z rows between unbounded "
       "preceding and current row) / sum(w) over (partition by activite) as cdf from (select activite, v / lag(v) over (partition by activite "
       "order by annee) - 1 as z, lag(v) over (partition by activite order by annee) as w from a) x where w is not null) y where cdf >= 0.6 "
       "group by 1", "cd", ACT, scale=6)
def _(t):
    prev = F.lag("v").over(S.by_year(N.ACTIVITE))
    points = annual(t).select(N.ACTIVITE, (F.col("v") / prev - 1).alias("z"), prev.alias("w")).filter("w is not null")
    return M.weighted_quantile(points, [N.ACTIVITE], "z", "w", 0.6)


@query("power_weights_e14", "activite:s annee:i poids:d",
       "select activite, annee, power(0.7, row_number() over (partition by activite order by annee desc) - 1) as poids from a", "cd", ACT, scale=8)
def _(t):
    return S.power_weights(annual(t), [N.ACTIVITE], 0.7)


@query("decayed_curve_e15", "activite:s mois:i part:d",
       "select activite, mois, sum(exp(-0.1 * (2001 - annee)) * v) / sum(sum(exp(-0.1 * (2001 - annee)) * v)) over (partition by activite) as "
       "part from m where annee < 2001 group by 1, 2", "cd", MON, scale=8)
def _(t):
    return S.decayed_curve(monthly(t), [N.ACTIVITE], "v", 2001)


@query("latest_month_e16", "derniere_annee:i dernier_mois:i complete:b",
       "select max(ym) // 100 as derniere_annee, max(ym) % 100 as dernier_mois, max(ym) % 100 = 12 as complete from (select annee * 100 + mois "
       "as ym from cd) x", "cd")
def _(t):
    return R.latest_status(t.cd)


@query("top_contracts_e17", "contrat:i total:d",
       "select contrat, sum(consommation_kwh) as total from cd group by 1 order by 2 desc, 1 limit 15", "cd", scale=2)
def _(t):
    totals = t.cd.groupBy(N.CONTRAT).agg(F.sum(N.CONSO).alias("total"))
    return X.top_k(totals, "total", N.CONTRAT, 15)


@query("bottom_results_e17", "contrat:i annual_mape:d",
       "select contrat, annual_mape from res order by annual_mape, contrat limit 10", "cd", _RESULTS)
def _(t):
    results = naive_results(t)[1].withColumn("annual_mape", F.round("annual_mape", 9))
    return X.top_k(results, "annual_mape", N.CONTRAT, 10, largest=False)


@query("last_month_of_year_e18", "activite:s annee:i mois:i v:d",
       "select activite, annee, max(mois) as mois, arg_max(v, mois) as v from m group by 1, 2", "cd", MON, scale=2)
def _(t):
    return X.last_row(monthly(t), [N.ACTIVITE, N.ANNEE], N.MOIS, ["v"])


@query("ordered_results_e19", "contrat:i annual_mae:d annual_mape:d annual_r2:d",
       "select contrat, avg(abs(actual - prediction)) as annual_mae, avg(abs((actual - prediction) / actual)) * 100 as annual_mape, case when "
       "count(*) >= 2 and var_pop(actual) > 0 then 1 - sum((actual - prediction) ** 2) / (count(*) * var_pop(actual)) end as annual_r2 from p "
       "group by 1 order by annual_mape nulls last", "cd", _RESULTS)
def _(t):
    nested = naive_results(t)[1].select(N.CONTRAT, F.struct("annual_mae", "annual_mape", "annual_r2").alias("metrics"))
    return X.order_results(nested)


@query("union_of_forecasts_e20", "region:s activite:s annee:i mois:i v:d",
       "select region, activite, annee, mois, v from (select region, activite, annee, mois, sum(consommation_kwh) as v from cd group by 1, 2, 3, "
       "4) a union all select region, 'Total', annee, mois, v from rm", "cd", REG, scale=2)
def _(t):
    parts = t.cd.groupBy(N.REGION, N.ACTIVITE, N.ANNEE, N.MOIS).agg(F.sum(N.CONSO).alias("v"))
    return T.union_eras(parts, monthly(t, N.REGION).withColumn(N.ACTIVITE, F.lit(N.TOTAL)))


@query("common_years_e21", "contrat:i n:i",
       "select contrat, count(*) as n from (select contrat, annee from (select distinct contrat, annee, mois from cd where mois in (3, 6)) x group "
       "by 1, 2 having count(*) = 2) y group by 1", "cd")
def _(t):
    models = t.cd.filter(F.col(N.MOIS).isin(3, 6)).select(N.CONTRAT, N.ANNEE, F.col(N.MOIS).alias("modele")).distinct()
    return X.common_years(models, [N.CONTRAT], "modele", 2).groupBy(N.CONTRAT).agg(F.count(F.lit(1)).alias("n"))


@query("missing_years_e22", "annee:i", "select distinct annee from cd where annee > 1998 except select annee from weather_diff", "cd weather_diff")
def _(t):
    return J.missing_years(t.cd.filter(F.col(N.ANNEE) > 1998), t.weather_diff)


_W12 = [f"t{m}" for m in N.MONTHS]


@query("monthly_feature_i01", "region:s annee:i " + " ".join(f"apparent_temperature_mean_{m}:d" for m in N.MONTHS),
       "select y.region, y.annee, " + ", ".join(f"coalesce(avg(case when w.mois = {m} then apparent_temperature_mean end), 0) as "
                                                 f"apparent_temperature_mean_{m}" for m in N.MONTHS)
       + " from (select distinct region, annee from cd where annee < 2001 union select 'ASIA', 1990) y left join weather w on w.region = "
       "y.region and w.annee = y.annee group by 1, 2", "cd weather")
def _(t):
    years = t.cd.filter(F.col(N.ANNEE) < 2001).select(N.REGION, N.ANNEE).distinct()
    extra = t.raw("region").filter("r_name = 'ASIA'").select(F.col("r_name").alias(N.REGION), F.lit(1990).cast("bigint").alias(N.ANNEE))
    return S.monthly_feature(t.weather, years.unionByName(extra), [N.REGION], "apparent_temperature_mean")


@query("yearly_feature_i02", "region:s annee:i puissance_facturee:d",
       "select y.region, y.annee, coalesce(sum(puissance_facturee), 0) as puissance_facturee from (select distinct region, annee from exogenous "
       "union all select distinct region, 1990 from exogenous) y left join cd on cd.region = y.region and cd.annee = y.annee group by 1, 2",
       "cd exogenous")
def _(t):
    years = t.exogenous.select(N.REGION, F.explode(F.array(N.ANNEE, F.lit(1990).cast("bigint"))).alias(N.ANNEE)).distinct()
    return S.yearly_feature(t.cd, years, [N.REGION], N.PF)


_CL = ("cl as (select region, annee, mois, sum(nbr_clients) as v from grd where classe = 'Total' group by 1, 2, 3), ok as (select region, annee, "
       "count(*) as n from cl group by 1, 2), ys as (select distinct region, annee from cd)")


def client_arrays(t):
    packed = (t.grd.filter(F.col(N.CLASSE) == N.CLASS_TOTAL).groupBy(N.REGION, N.ANNEE, N.MOIS).agg(F.sum(N.CLIENTS).cast("double").alias("v"))
              .groupBy(N.REGION, N.ANNEE).agg(F.array_sort(F.collect_list(F.struct(N.MOIS, "v"))).alias("x"))
              .select(N.REGION, N.ANNEE, F.transform("x", lambda e: e["v"]).alias("valeurs")))
    return T.valid_forecast_years(packed)


@query("monthly_client_feature_i03", "region:s annee:i mois:i clients:d",
       "select ys.region, ys.annee, m as mois, coalesce(case when n = 12 then v end, 0) as clients from ys cross join range(1, 13) ms(m) left join "
       "ok on ok.region = ys.region and ok.annee = ys.annee left join cl on cl.region = ys.region and cl.annee = ys.annee and cl.mois = m",
       "cd grd", _CL)
def _(t):
    out = S.client_feature(t.cd.select(N.REGION, N.ANNEE).distinct(), client_arrays(t), [N.REGION], annual=False)
    return out.select(N.REGION, N.ANNEE, F.posexplode("valeurs").alias("i", "clients")).withColumn(N.MOIS, F.col("i") + 1)


@query("annual_client_feature_i04", "region:s annee:i clients_annuels:d",
       "select ys.region, ys.annee, coalesce(case when n = 12 then s end, 0) as clients_annuels from ys left join (select region, annee, "
       "count(*) as n, sum(v) as s from cl group by 1, 2) o on o.region = ys.region and o.annee = ys.annee", "cd grd", _CL)
def _(t):
    return S.client_feature(t.cd.select(N.REGION, N.ANNEE).distinct(), client_arrays(t), [N.REGION], annual=True)


@query("standard_scaling_i05", "activite:s annee:i v:d p:d",
       "select activite, annee, (v - avg(v) over w) / stddev_pop(v) over w as v, (p - avg(p) over w) / stddev_pop(p) over w as p from a window w "
       "as (partition by activite)", "cd", ACT, scale=6)
def _(t):
    return S.standardize(annual(t), ["v", "p"], [N.ACTIVITE])
