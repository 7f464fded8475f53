"""Queries over aggregations, reshapes, tariffs and profiles."""

from pyspark.sql import functions as F

from wattline import names as N
from wattline.catalog.registry import query
from wattline.catalog.scalars import parsed
from wattline.functions import columns as C
from wattline.operators import aggregates as A, contracts as K, quantiles as Q, tariffs as P
from wattline.sources import sheets as S, tables as T

MONTHS = range(1, 13)


@query("monthly_sum_by_activity_c01", "activite:s annee:i mois:i consommation_kwh:d",
       "select activite, annee, mois, sum(consommation_kwh) as consommation_kwh from cd group by 1, 2, 3", "cd", scale=2)
def _(t):
    return A.monthly_sum(t.cd, [N.ACTIVITE])


@query("monthly_sum_by_region_c01", "region:s annee:i mois:i consommation_kwh:d",
       "select region, annee, mois, sum(consommation_kwh) as consommation_kwh from cd group by 1, 2, 3", "cd", scale=2)
def _(t):
    return A.monthly_sum(t.cd, [N.REGION])


@query("yearly_totals_c01b", "region:s annee:i classe:s activite:s consommation_kwh:d nbr_clients:i",
       "select region, annee, classe, activite, sum(consommation_kwh) as consommation_kwh, sum(nbr_clients) as nbr_clients "
       "from grd where grd = 'SRM' group by 1, 2, 3, 4", "grd", scale=2)
def _(t):
    return A.yearly_totals(t.grd.filter(F.col(N.GRD) == N.SRM), [N.REGION, N.CLASSE, N.ACTIVITE], [N.CONSO, N.CLIENTS])


@query("yearly_totals_by_contract_c01b", "partenaire:s contrat:i activite:s annee:i consommation_kwh:d temperature:d",
       "select partenaire, contrat, activite, annee, sum(consommation_kwh) as consommation_kwh, avg(temperature) as temperature "
       "from (select c.*, w.temperature from cd c left join (select region, annee, mois, avg(apparent_temperature_mean) as "
       "temperature from weather group by 1, 2, 3) w on w.region = c.region and w.annee = c.annee and w.mois = c.mois) x "
       "group by 1, 2, 3, 4", "cd weather")
def _(t):
    w = t.weather.groupBy(N.REGION, N.ANNEE, N.MOIS).agg(F.avg("apparent_temperature_mean").alias("temperature"))
    return A.yearly_totals(t.cd.join(w, [N.REGION, N.ANNEE, N.MOIS], "left"), [N.PARTENAIRE, N.CONTRAT, N.ACTIVITE],
                           [N.CONSO], ["temperature"])


_NEW_ID = "case when contrat % 50 = 3 then contrat + 1 else contrat end"


@query("collapse_duplicates_c01c", "contrat:i annee:i mois:i consommation_kwh:d puissance_facturee:d puissance_appelee:d",
       f"select {_NEW_ID} as contrat, annee, mois, sum(consommation_kwh) as consommation_kwh, sum(puissance_facturee) as "
       "puissance_facturee, avg(puissance_appelee) as puissance_appelee from cd group by 1, 2, 3", "cd")
def _(t):
    moved = t.cd.withColumn(N.CONTRAT, F.when(F.col(N.CONTRAT) % 50 == 3, F.col(N.CONTRAT) + 1).otherwise(F.col(N.CONTRAT)))
    return A.collapse_duplicates(moved, [N.CONTRAT, N.ANNEE, N.MOIS], [N.CONSO, N.PF], [N.PA])


_DIST = ("d as (select region, annee, mois, sum(consommation_kwh) as v from grd where grd <> 'SRM' group by 1, 2, 3), "
         "g as (select * from grd where not (region = 'ASIA' and classe = 'Total'))")


@query("regional_with_distributors_c02", "region:s annee:i mois:i consommation_kwh:d",
       "select region, annee, mois, sum(v) as consommation_kwh from (select region, annee, mois, consommation_kwh as v from g "
       "where grd = 'SRM' and ((classe = 'Total') = (region <> 'ASIA')) union all select region, annee, mois, v from d) x "
       "group by 1, 2, 3", "grd", _DIST, scale=2)
def _(t):
    grd = t.grd.filter(~((F.col(N.REGION) == "ASIA") & (F.col(N.CLASSE) == N.CLASS_TOTAL)))
    return A.with_distributors(T.load_regional(grd), T.distributor_scan(grd), N.CONSO)[1]


@query("distributors_as_activity_c02", "region:s annee:i mois:i activite:s consommation_kwh:d",
       "select region, annee, mois, coalesce(activite, 'Total') as activite, consommation_kwh from g where grd = 'SRM' "
       "union all select region, annee, mois, 'All distributers', v from d", "grd", _DIST, scale=2)
def _(t):
    grd = t.grd.filter(~((F.col(N.REGION) == "ASIA") & (F.col(N.CLASSE) == N.CLASS_TOTAL)))
    return A.with_distributors(T.load_regional(grd), T.distributor_scan(grd), N.CONSO)[0]


_M = ", ".join(f"case when count(m{m}) over (partition by contrat) = 0 then 0 else m{m} end as m{m}" for m in MONTHS)
_P = ", ".join(f"sum(case when mois = {m} then consommation_kwh end) as m{m}" for m in MONTHS)


@query("monthly_matrix_c03", "contrat:i annee:i " + " ".join(f"m{m}:d" for m in MONTHS),
       f"select contrat, annee, {_M} from (select contrat, annee, {_P} from cd group by 1, 2) x", "cd", scale=2)
def _(t):
    return A.monthly_matrix(t.cd, [N.CONTRAT], N.CONSO)


_WM = ("wm as (select region, annee, mois, avg(apparent_temperature_min) as temp_min_latest, sum(precipitation_sum) as "
       "precipitation_sum_latest, sum(et0_fao_evapotranspiration_sum) as et0_latest from weather group by 1, 2, 3), "
       "wy as (select region, annee, avg(temp_min_latest) as temp_min_latest, sum(precipitation_sum_latest) as "
       "precipitation_sum_latest, sum(et0_latest) as et0_latest from wm group by 1, 2)")
_WCOLS = "temp_min_latest:d precipitation_sum_latest:d et0_latest:d"


@query("weather_monthly_c04", f"region:s annee:i mois:i {_WCOLS}", "select * from wm", "weather", _WM)
def _(t):
    return A.weather_monthly(T.weather_scan(t.weather))


@query("weather_yearly_c04", f"region:s annee:i {_WCOLS}", "select * from wy", "weather", _WM)
def _(t):
    return A.weather_yearly(T.weather_scan(t.weather))


@query("weather_latest_c05", f"region:s {_WCOLS}",
       "select * from wy where annee = (select max(annee) from wy y where y.region = wy.region)", "weather", _WM)
def _(t):
    return A.weather_latest(T.weather_scan(t.weather))


@query("city_weather_to_region_c06", "region:s date_jour:t annee:i mois:i apparent_temperature_max:d temp:d rain:d",
       "select r_name as region, cast(l_shipdate as date) as date_jour, max(year(l_shipdate)) as annee, max(month(l_shipdate)) "
       "as mois, max(l_quantity) as apparent_temperature_max, avg(l_quantity) as temp, avg(l_tax) as rain from lineitem join "
       "supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey "
       "group by 1, 2", scale=7)
def _(t):
    li = t.raw("lineitem").join(t.suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    daily = li.select(N.REGION, F.to_date("l_shipdate").alias("date_jour"), F.year("l_shipdate").alias(N.ANNEE),
                      F.month("l_shipdate").alias(N.MOIS), F.col("l_quantity").alias("apparent_temperature_max"),
                      F.col("l_quantity").alias("temp"), F.col("l_tax").alias("rain"))
    return A.city_weather_to_region(daily, [N.REGION, "date_jour"], [N.ANNEE, N.MOIS, "apparent_temperature_max"])


_ANNUAL = "a as (select region, annee, sum(consommation_kwh) as v, count(distinct contrat) as n from cd group by 1, 2)"
_RANKED = _ANNUAL + ", r as (select *, row_number() over (partition by region order by annee desc) as k from a)"


def annual_by_region(t):
    """Use and number of contracts with rows, per region and year."""
    return (t.cd.groupBy(N.REGION, N.ANNEE, N.CONTRAT).agg(F.sum(N.CONSO).alias(N.CONSO))
            .groupBy(N.REGION, N.ANNEE).agg(F.sum(N.CONSO).alias("v"), F.count(F.lit(1)).alias("n")))


@query("compound_growth_c12", "region:s cagr:d cagr_last5:d",
       "select region, (power(arg_max(v, annee) / arg_min(v, annee), 1.0 / (count(*) - 1)) - 1) * 100 as cagr, (power(arg_max(v, "
       "annee) / arg_min(v, annee) filter (where k <= 5), 0.25) - 1) * 100 as cagr_last5 from r group by 1", "cd", _RANKED)
def _(t):
    return A.compound_growth(annual_by_region(t), [N.REGION], "v")


@query("average_annual_increase_c13", "region:s increase:i increase_last5:i",
       "select region, ceil(round(regr_slope(n, annee), 9)) as increase, ceil(round(regr_slope(n, annee) filter (where k <= 5), "
       "9)) as increase_last5 from r group by 1", "cd", _RANKED)
def _(t):
    return A.average_annual_increase(annual_by_region(t), [N.REGION], "n")


_FEATS = "activite:s annee:i total_active_contrats:i puissance_facturee_total:d consommation_kwh:d per_contract:d intensity:d"


@query("use_per_contract_c14", _FEATS,
       "select u.activite, u.annee, f.n as total_active_contrats, f.pf as puissance_facturee_total, u.v as consommation_kwh, "
       "u.v / nullif(f.n, 0) as per_contract, u.v / nullif(f.pf, 0) as intensity from (select activite, annee, "
       "sum(consommation_kwh) as v from cd group by 1, 2) u left join (select activite, annee, count(*) as n, sum(pf) as pf from "
       "contract_power join contract_span using (contrat) where start_year <= annee and finish_year >= annee group by 1, 2) f "
       "on f.activite = u.activite and f.annee = u.annee", "contracts", K.SPAN_SQL)
def _(t):
    yearly = A.yearly_totals(t.cd, [N.ACTIVITE], [N.CONSO])
    return K.use_per_contract(yearly, K.contract_features(t.contracts, N.ACTIVITE), [N.ACTIVITE])


_ACTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_SHARES = ", ".join(f"coalesce(sum(case when activite = '{a}' then v end) / sum(v) * 100, 0) as pct_{a.lower()}" for a in _ACTS)


@query("activity_shares_c15", "region:s annee:i total:d " + " ".join(f"pct_{a.lower()}:d" for a in _ACTS),
       f"select region, annee, sum(v) as total, {_SHARES} from (select region, annee, activite, sum(consommation_kwh) / 1000 as v "
       "from cd group by 1, 2, 3) x group by 1, 2", "cd", scale=6)
def _(t):
    return A.activity_shares(t.cd.withColumn("mwh", F.col(N.CONSO) / 1000), _ACTS, "mwh")


@query("label_lists_c16", "activite:s n:i labels:s",
       "select activite, count(distinct partenaire) as n, string_agg(distinct partenaire, ', ' order by partenaire) as labels "
       "from cd group by 1", "cd")
def _(t):
    return A.label_lists(t.cd, N.ACTIVITE, N.PARTENAIRE)


@query("unique_or_error_c17", "contrat:i annee:i date_emmenagement:s niveau_tension:s consommation_kwh:d",
       "select contrat, annee, max(date_emmenagement) as date_emmenagement, max(niveau_tension) as niveau_tension, "
       "sum(consommation_kwh) as consommation_kwh from contracts group by 1, 2", "contracts", scale=2)
def _(t):
    return A.unique_or_error(t.contracts, [N.CONTRAT, N.ANNEE], [N.DATE_IN, N.TENSION], [N.CONSO])


_LABELS = S.month_labels(1998, 1999)


@query("melt_c18", "contrat:i label:s pf:d",
       "select contrat, lpad(cast(m as varchar), 2, '0') || '.' || y as label, sum(case when annee = y and mois = m then "
       "puissance_facturee end) as pf from cd cross join range(1998, 2000) ys(y) cross join range(1, 13) ms(m) group by "
       "contrat, y, m", "cd")
def _(t):
    return S.melt(S.pivot_months(t.cd, [N.CONTRAT], N.PF, _LABELS), [N.CONTRAT], _LABELS, "label", "pf")


@query("pivot_first_c19", "contrat:i annee:i mois:i Pf:d Pa:d",
       "select contrat, annee, mois, min(puissance_facturee) as Pf, min(puissance_appelee) as Pa from cd group by 1, 2, 3", "cd")
def _(t):
    long = t.cd.select(N.CONTRAT, N.ANNEE, N.MOIS, F.col(N.PF).alias("Pf"), F.col(N.PA).alias("Pa"))
    long = S.melt(long, [N.CONTRAT, N.ANNEE, N.MOIS], ["Pf", "Pa"], "metric", "value")
    return S.pivot_first(long, [N.CONTRAT, N.ANNEE, N.MOIS], ["Pf", "Pa"], "metric", "value")


def tariff_rows(t):
    """Tariff lines per contract-month: the three bands, a super-peak line for some contracts, general ones for others."""
    c = F.col(N.CONTRAT)
    lines = F.when(c % 10 == 0, F.array(F.struct(F.lit("Puis Sous -Tarif Gén").alias("l"), F.col(N.PF).alias("v")))).otherwise(
        F.array_compact(F.array(
            F.struct(F.lit("Puis Sous HP -Tarif Opt").alias("l"), F.col(N.PF).alias("v")),
            F.struct(F.lit("Puis Sous HPL -Tarif Opt").alias("l"), (F.col(N.PF) * 2 - F.when(c % 6 == 0, F.lit(40)).otherwise(F.lit(0))).alias("v")),
            F.struct(F.lit("Puis Sous HC -Tarif Opt").alias("l"), F.when(c % 13 != 0, F.col(N.PF) * 3).alias("v")),
            F.when(c % 10 < 3, F.struct(F.lit("Puis Sous HSP -Tarif Sup pointe").alias("l"), (F.col(N.PF) / 2).alias("v"))))))
    return t.cd.select(N.CONTRAT, N.ANNEE, N.MOIS, F.explode(lines).alias("x")).select(
        N.CONTRAT, N.ANNEE, N.MOIS, F.col("x.l").alias("type_ligne"), F.col("x.v").alias("valeur"))


@query("billed_power_by_tariff_c20", "contrat:i annee:i mois:i tarif:s puissance_facturee:d avertissement:s",
       "select contrat, annee, mois, tarif, case when tarif = 'Tarif gén' then hp when tarif = 'Tarif optionnel' then 0.4 * hp + "
       "0.2 * hpl + 0.4 * hc else 0.2 * hsp + 0.2 * hp + 0.2 * hpl + 0.4 * hc end as puissance_facturee, case when tarif = "
       "'Tarif gén' then '' when hc is null then 'missing_band' when not (hp <= hpl and hpl <= hc and (tarif = "
       "'Tarif optionnel' or hsp <= hp)) then 'not_rising' else '' end as avertissement from (select contrat, annee, "
       "mois, case when contrat % 10 = 0 then 'Tarif gén' when contrat % 10 < 3 then 'Tarif super pointe' else 'Tarif optionnel' "
       "end as tarif, puissance_facturee / 2 as hsp, puissance_facturee as hp, puissance_facturee * 2 - case when contrat % 6 = 0 "
       "then 40 else 0 end as hpl, case when contrat % 13 <> 0 then puissance_facturee * 3 end as hc, lpad(cast(mois as varchar), "
       "2, '0') || '.' || annee as label from cd) x", "cd")
def _(t):
    return P.billed_power(tariff_rows(t))


@query("called_power_by_tariff_c21", "contrat:i annee:i mois:i puissance_appelee:d",
       "select contrat, annee, mois, case when contrat % 2 = 0 then a + 0.6 * (b - a) + 0.4 * (c - b) else d + 0.8 * (a - d) + 0.6 "
       "* (b - a) + 0.4 * (c - b) end as puissance_appelee from (select contrat, annee, mois, puissance_appelee as a, "
       "puissance_appelee * 1.5 as b, puissance_appelee * 2 as c, puissance_appelee / 2 as d from cd) x", "cd", scale=5)
def _(t):
    p = F.col(N.PA)
    wide = t.cd.select(N.CONTRAT, N.ANNEE, N.MOIS, F.when(F.col(N.CONTRAT) % 2 == 1, p / 2).alias("HSP"), p.alias("HP"),
                       (p * 1.5).alias("HPL"), (p * 2).alias("HC"))
    return P.called_power(wide)


@query("merged_contract_dates_c22", "contrat:i date_emmenagement:t date_demenagement:t",
       f"select x.contrat, case when g.n > 1 then g.a else x.a end as date_emmenagement, case when g.n > 1 then g.b else x.b end "
       f"as date_demenagement from (select {_NEW_ID} as contrat, {parsed('date_emmenagement')} as a, "
       f"{parsed('date_demenagement')} as b from contract_dates) x join (select {_NEW_ID} as contrat, count(*) as n, "
       f"min({parsed('date_emmenagement')}) as a, max({parsed('date_demenagement')}) as b from contract_dates group by 1) g on "
       "g.contrat = x.contrat", "contract_dates")
def _(t):
    c = F.col(N.CONTRAT)
    renumbered = t.contract_dates.select(F.when(c % 50 == 3, c + 1).otherwise(c).alias(N.CONTRAT),
                                         C.parse_date(F.col(N.DATE_IN)).alias(N.DATE_IN), C.parse_date(F.col(N.DATE_OUT)).alias(N.DATE_OUT))
    merged = A.duplicates(renumbered, [N.CONTRAT]).select(N.CONTRAT)
    return K.widen_dates(renumbered, merged)


@query("duplicate_keys_c23", "contrat:i annee:i mois:i n:i",
       f"select {_NEW_ID} as contrat, annee, mois, count(*) as n from cd group by 1, 2, 3 having count(*) > 1", "cd")
def _(t):
    c = F.col(N.CONTRAT)
    return A.duplicates(t.cd.withColumn(N.CONTRAT, F.when(c % 50 == 3, c + 1).otherwise(c)), [N.CONTRAT, N.ANNEE, N.MOIS])


_PROFILED = ("niveau_tension", "consommation_kwh", "consommation_zconhc", "puissance_facturee")


@query("column_profile_c24", "colonne:s nulls:i non_positive:i",
       " union all ".join(f"select '{c}' as colonne, count(*) filter (where {c} is null) as nulls, "
                          f"max(case when try_cast({c} as double) <= 0 then 1 when try_cast({c} as double) > 0 then 0 end) as "
                          f"non_positive from cd" for c in _PROFILED[1:]), "cd")
def _(t):
    return A.column_profile(t.cd, _PROFILED[1:])


@query("group_describe_c25", "activite:s n:i mean:d std:d min:d q25:d q50:d q75:d max:d",
       "select activite, count(*) as n, avg(puissance_facturee) as mean, stddev_samp(puissance_facturee) as std, "
       "min(puissance_facturee) as min, quantile_cont(puissance_facturee, 0.25) as q25, quantile_cont(puissance_facturee, 0.5) "
       "as q50, quantile_cont(puissance_facturee, 0.75) as q75, max(puissance_facturee) as max from cd group by 1", "cd")
def _(t):
    return Q.describe(t.cd, [N.ACTIVITE], N.PF)


@query("value_shares_c25", "region:s activite:s n:i share:d",
       "select region, activite, count(*) as n, count(*) / sum(count(*)) over (partition by region) as share from cd group by 1, 2",
       "cd", scale=8)
def _(t):
    return A.value_shares(t.cd, [N.REGION], N.ACTIVITE)


@query("contract_endings_c26", "contrat:i etat:s",
       "select contrat, case when s = 0 then 'finished' else 'starting' end as etat from (select contrat, sum(case when annee >= "
       "2000 then consommation_kwh else 0 end) as s, sum(case when annee = 2000 then consommation_kwh else 0 end) as w from cd "
       "group by 1) x where s = 0 or w = 0", "cd")
def _(t):
    return A.contract_endings(t.cd, 2000)


_RESULTS = ("p as (select c.contrat, c.annee, sum(c.consommation_kwh) as actual, sum(c.consommation_zconhc) * 2 as prediction "
            "from cd c group by 1, 2), res as (select contrat, case when count(*) >= 2 and var_pop(actual) > 0 then 1 - sum((actual - "
            "prediction) ** 2) / (count(*) * var_pop(actual)) end as annual_r2, avg(abs((actual - prediction) / actual)) * 100 as "
            "annual_mape from p group by 1)")


def naive_results(t):
    """A prediction per contract-year and its metrics, the input of the result-table reports."""
    from wattline.operators.metrics import annual_metrics

    pred = t.cd.groupBy(N.CONTRAT, N.ANNEE).agg(F.sum(N.CONSO).alias("actual"), (F.sum(N.ZCONHC) * 2).alias("prediction"))
    return pred, annual_metrics(pred, [N.CONTRAT])


@query("quality_shares_c27", "pct_good:d pct_poor:d n_close:i n_best:i",
       "select avg(case when annual_r2 >= 0.3 then 1.0 else 0 end) * 100 as pct_good, avg(case when annual_r2 < -1 then 1.0 else 0 "
       "end) * 100 as pct_poor, count(*) filter (where annual_r2 >= 0 and annual_mape < 10) as n_close, count(*) filter (where "
       "annual_r2 >= 0.6 and annual_mape < 10) as n_best from res", "cd", _RESULTS)
def _(t):
    return A.quality_shares(naive_results(t)[1])


@query("annual_error_totals_c28", "annee:i prediction:d actual:d error:d percent_error:d",
       "select annee, sum(prediction) as prediction, sum(actual) as actual, sum(prediction) - sum(actual) as error, "
       "(sum(prediction) - sum(actual)) / sum(actual) * 100 as percent_error from p group by 1", "cd", _RESULTS)
def _(t):
    return A.annual_error_totals(naive_results(t)[0])


@query("metric_histogram_c29", "bin:i n:i",
       "select least(cast(floor((annual_mape) / 10) as bigint) + 1, 20) as bin, count(*) as n from res where annual_mape between 0 "
       "and 200 group by 1", "cd", _RESULTS)
def _(t):
    return A.histogram(naive_results(t)[1].withColumn("annual_mape", F.round("annual_mape", 9)), "annual_mape", 0.0, 200.0, 20)


@query("time_evolution_monthly_c30", "annee:i mois:i puissance_facturee:d",
       "select annee, mois, max(puissance_facturee) as puissance_facturee from cd group by 1, 2", "cd")
def _(t):
    return A.time_evolution(t.cd, N.PF, "max", yearly=False)


@query("time_evolution_yearly_c30", "activite:s annee:i puissance_facturee:d",
       "select activite, annee, avg(v) as puissance_facturee from (select activite, annee, mois, avg(puissance_facturee) as v from "
       "cd group by 1, 2, 3) x group by 1, 2", "cd")
def _(t):
    return A.time_evolution(t.cd, N.PF, "mean", yearly=True, keys=[N.ACTIVITE])


@query("time_evolution_median_monthly_c30", "annee:i mois:i puissance_facturee:d",
       "select annee, mois, median(puissance_facturee) as puissance_facturee from cd group by 1, 2", "cd")
def _(t):
    return A.time_evolution(t.cd, N.PF, "median", yearly=False)


@query("time_evolution_median_yearly_c30", "activite:s annee:i puissance_facturee:d",
       "select activite, annee, median(v) as puissance_facturee from (select activite, annee, mois, median(puissance_facturee) as v from "
       "cd group by 1, 2, 3) x group by 1, 2", "cd")
def _(t):
    return A.time_evolution(t.cd, N.PF, "median", yearly=True, keys=[N.ACTIVITE])


@query("ranked_results_e19b", "contrat:i mape_test:d mae_train:d rang:i",
       "select contrat, mape_test, mae_train, row_number() over (order by mape_test nulls last, mae_train nulls last, contrat) as rang from (select "
       "contrat, round(avg(abs((actual - prediction) / actual)) filter (where annee >= 1999 and actual <> 0) * 100, 6) as mape_test, round(avg(abs(actual - "
       "prediction)) filter (where annee < 1999), 6) as mae_train from p group by 1) x", "cd", _RESULTS)
def _(t):
    """Contracts by test error, those never tested last: nested metrics flattened, then ranked."""
    from wattline.operators import metrics as Q

    pred = naive_results(t)[0]
    tested, actual, prediction = F.col(N.ANNEE) >= 1999, F.col("actual"), F.col("prediction")
    error = F.abs(actual - prediction)
    nested = pred.groupBy(N.CONTRAT).agg(F.struct(
        F.struct(F.round(F.avg(F.when(~tested, error)), 6).alias("mae")).alias("train"),
        F.struct(F.round(F.avg(F.when(tested & (actual != 0), F.abs((actual - prediction) / F.nullif(actual, F.lit(0.0))))) * 100, 6).alias("mape")).alias("test")).alias("metrics"))
    return Q.ranked_nulls_last(Q.flat_results(nested), "mape_test", "mae_train", N.CONTRAT)
