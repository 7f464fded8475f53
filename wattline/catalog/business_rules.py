"""Queries over the business rules applied to forecasts."""

from pyspark.sql import functions as F

from wattline import names as N
from wattline.catalog.contracts import SPAN
from wattline.catalog.joins import GROWTH, PRED, SENS_SQL, _WY, annual_predictions, sensitivities
from wattline.catalog.registry import query
from wattline.catalog.windows import REG, client_arrays, monthly
from wattline.functions import series as S
from wattline.operators import adjustments as J, aggregates as A, contracts as K, rules as R
from wattline.sources import tables as T

CONSO = "consommation"


@query("extrapolated_features_f01", "region:s annee:i pib_mdh:d gdp_tertiaire:d",
       "select region, annee, pib_mdh, gdp_tertiaire from exogenous union all select l.region, y as annee, case when p.pib_mdh <> 0 then "
       "l.pib_mdh * (1 + (l.pib_mdh - p.pib_mdh) / p.pib_mdh) else l.pib_mdh end, case when p.gdp_tertiaire <> 0 then l.gdp_tertiaire * (1 + "
       "(l.gdp_tertiaire - p.gdp_tertiaire) / p.gdp_tertiaire) else l.gdp_tertiaire end from exogenous l join exogenous p on p.region = "
       "l.region and p.annee = 2000 cross join range(2002, 2004) ys(y) where l.annee = 2001", "exogenous")
def _(t):
    return R.extrapolate_features(t.exogenous, [N.REGION], ["pib_mdh", "gdp_tertiaire"], 2003)


@query("imputed_year_f02", "region:s annee:i mois:i v:d",
       "select r.region, r.annee, r.mois, case when r.annee = 2000 then (a.v + b.v) / 2 else r.v end as v from rm r left join rm a on a.region = "
       "r.region and a.mois = r.mois and a.annee = 1999 left join rm b on b.region = r.region and b.mois = r.mois and b.annee = 2001", "cd", REG,
       scale=3)
def _(t):
    return R.impute_year(monthly(t, N.REGION), [N.REGION], "v", 2000)


@query("ensured_years_f03", "contrat:i annee:i mois:i region:s activite:s niveau_tension:s consommation_kwh:d",
       "select contrat, annee, mois, region, activite, niveau_tension, consommation_kwh from cd union all select a.contrat, y, m, a.region, "
       "a.activite, a.niveau_tension, 0 from (select contrat, min(region) as region, min(activite) as activite, min(niveau_tension) as "
       "niveau_tension from cd group by 1) a cross join range(1996, 1999) ys(y) cross join range(1, 13) ms(m) where not exists (select 1 from cd "
       "where cd.contrat = a.contrat and cd.annee = y)", "cd", scale=2)
def _(t):
    cols = [N.CONTRAT, N.ANNEE, N.MOIS, N.REGION, N.ACTIVITE, N.TENSION, N.CONSO]
    return R.ensure_years(t.cd.select(*cols), 1996, 1998, [N.CONSO])


# Forecast of 2001 = the months of 2000 plus 5 percent; realised = the eight months of 2001.
_CORR = ("fc as (select {k}, 2001 as annee, mois, v * 1.05 as v{b} from s where annee = 2000), rl as (select *, row_number() over (partition by {k} "
         "order by mois) as i from s where annee = 2001), fi as (select *, row_number() over (partition by {k} order by mois) as i, count(*) over "
         "(partition by {k}) as n from fc), j as (select fi.*, rl.v as r, avg(rl.v / nullif(fi.v, 0)) over (partition by {k0}) as factor, "
         "count(rl.v) over (partition by {k0}) as nr from fi left join rl on {on} and rl.i = fi.i)")
_S_REG = "s as (select region, activite, annee, mois, sum(consommation_kwh) as v from cd group by 1, 2, 3, 4)"


def _corr(keys, bands=""):
    return _CORR.format(k=", ".join(keys), b=bands, k0=", ".join(f"fi.{k}" for k in keys), on=" and ".join(f"rl.{k} = fi.{k}" for k in keys))


@query("realised_correction_f04", "region:s annee:i mois:i consommation:d",
       "select region, annee, mois, case when n = 12 and nr > 0 then coalesce(r, v * coalesce(factor, 1)) else v end as consommation from j", "cd",
       "s as (select region, annee, mois, sum(consommation_kwh) as v from cd group by 1, 2, 3), " + _corr(["region"]), scale=4)
def _(t):
    s = A.monthly_sum(t.cd, [N.REGION]).withColumnRenamed(N.CONSO, CONSO)
    return R.correct_with_realised(_forecast(s), s.filter(F.col(N.ANNEE) == 2001), [N.REGION])


def _forecast(s, cols=(CONSO,)):
    f = s.filter(F.col(N.ANNEE) == 2000).withColumn(N.ANNEE, F.lit(2001).cast("bigint"))
    for c in cols:
        f = f.withColumn(c, F.col(c) * 1.05)
    return f


@query("realised_correction_by_activity_f05", "region:s activite:s annee:i mois:i consommation:d",
       "select region, activite, annee, mois, case when n = 12 and nr > 0 then coalesce(r, v * coalesce(factor, 1)) else v end as consommation "
       "from j", "cd", _S_REG + ", " + _corr(["region", "activite"]), scale=4)
def _(t):
    s = A.monthly_sum(t.cd, [N.REGION, N.ACTIVITE]).withColumnRenamed(N.CONSO, CONSO)
    return R.correct_with_realised(_forecast(s), s.filter(F.col(N.ANNEE) == 2001), [N.REGION, N.ACTIVITE])


@query("realised_correction_with_bands_f06", "partenaire:s annee:i mois:i consommation:d consommation_zconhc:d consommation_zconhp:d",
       "select partenaire, annee, mois, x as consommation, case when ok then x * case when v > 0 then hc / v else 0 end else hc end as "
       "consommation_zconhc, case when ok then x * case when v > 0 then hp / v else 0 end else hp end as consommation_zconhp from (select *, n = "
       "12 and nr > 0 as ok, case when n = 12 and nr > 0 then coalesce(r, v * coalesce(factor, 1)) else v end as x from j) z", "cd",
       "s as (select partenaire, annee, mois, sum(consommation_kwh) as v, sum(consommation_zconhc) as hc, sum(consommation_zconhp) as hp from cd "
       "group by 1, 2, 3), " + _corr(["partenaire"], ", hc * 1.05 as hc, hp * 1.05 as hp"), scale=4)
def _(t):
    bands = [N.ZCONHC, N.ZCONHP]
    s = t.cd.groupBy(N.PARTENAIRE, N.ANNEE, N.MOIS).agg(F.sum(N.CONSO).alias(CONSO), *[F.sum(b).alias(b) for b in bands])
    return R.correct_with_realised(_forecast(s, [CONSO, *bands]), s.filter(F.col(N.ANNEE) == 2001), [N.PARTENAIRE], bands=bands)


_BAND = ", ".join(f"v * case when tot > 0 then {b} / tot else 1.0 / 3 end as {b}" for b in N.BANDS)


@query("tariff_band_split_f07", "contrat:i annee:i mois:i consommation:d consommation_zconhc:d consommation_zconhl:d consommation_zconhp:d "
       "puissance_facturee:d niveau_tension:s",
       f"select contrat, annee, mois, v as consommation, {_BAND}, puissance_facturee, coalesce(niveau_tension, 'HT') as niveau_tension from (select "
       "f.contrat, f.annee, f.mois, f.v, h.consommation_zconhc, h.consommation_zconhl, h.consommation_zconhp, h.puissance_facturee, "
       "h.niveau_tension, h.consommation_zconhc + h.consommation_zconhl + h.consommation_zconhp as tot from (select contrat, y as annee, m as "
       "mois, y * 12 + m as ym, v from (select contrat, sum(consommation_kwh) / 7 as v from cd group by 1) a cross join range(1997, 2003, 5) ys(y) "
       "cross join range(1, 13) ms(m)) f asof left join (select *, annee * 12 + mois as ym from cd) h on h.contrat = f.contrat and h.ym <= f.ym) x",
       "cd", scale=4)
def _(t):
    f = t.cd.groupBy(N.CONTRAT).agg((F.sum(N.CONSO) / 7).alias(CONSO))
    f = f.withColumn(N.ANNEE, F.explode(F.array(F.lit(1997).cast("bigint"), F.lit(2002).cast("bigint"))))
    f = f.withColumn(N.MOIS, F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(12).cast("bigint"))))
    return R.split_bands(f, t.cd)


def _allocation_sql(entity):
    bands = ", ".join(f"x * case when tot > 0 then {b} / tot else 1.0 / 3 end as {b}" for b in N.BANDS)
    return (f"select region, partenaire, contrat, activite, annee, x as consommation, {bands}, pf as puissance_facturee, "
            f"coalesce(niveau_tension, 'HT') as niveau_tension from (select *, v * case when sum(pf) over (partition by {entity}, annee) > 0 then pf "
            f"/ sum(pf) over (partition by {entity}, annee) else 1.0 / count(*) over (partition by {entity}, annee) end as x from (select i.*, "
            f"q.annee, q.v, coalesce(h.pf, 0) as pf, h.niveau_tension, h.consommation_zconhc, h.consommation_zconhl, h.consommation_zconhp, "
            f"h.consommation_zconhc + h.consommation_zconhl + h.consommation_zconhp as tot from pred q join info i on i.{entity} = q.{entity} join "
            f"contract_span s on s.contrat = i.contrat and s.finish_year >= q.annee asof left join yearly h on h.contrat = i.contrat and h.annee <= "
            f"q.annee) y) z")


_ALLOC = (", info as (select contrat, arg_min(region, annee * 12 + mois) as region, arg_min(partenaire, annee * 12 + mois) as partenaire, "
          "arg_min(activite, annee * 12 + mois) as activite from cd group by 1), yearly as (select contrat, annee, sum(puissance_facturee) as pf, "
          "sum(consommation_zconhc) as consommation_zconhc, sum(consommation_zconhl) as consommation_zconhl, sum(consommation_zconhp) as "
          "consommation_zconhp, max(niveau_tension) as niveau_tension from cd group by 1, 2), pred as (select {e}, annee + 2 as annee, case when "
          "{e} = '{neg}' then 0 else v * 1.1 end as v from (select {e}, annee, sum(consommation_kwh) as v from cd group by 1, 2) u where annee in "
          "(1995, 2000))")


def _entity_forecast(t, entity, negative):
    yearly = t.cd.groupBy(entity, N.ANNEE).agg(F.sum(N.CONSO).alias("v")).filter(F.col(N.ANNEE).isin(1995, 2000))
    factor = F.when(F.col(entity) == negative, -1e9).otherwise(1.1)
    return yearly.select(entity, (F.col(N.ANNEE) + 2).alias(N.ANNEE), (F.col("v") * factor).alias(CONSO))


_ALLOC_COLS = ("region:s partenaire:s contrat:i activite:s annee:i consommation:d consommation_zconhc:d consommation_zconhl:d "
               "consommation_zconhp:d puissance_facturee:d niveau_tension:s")


@query("contract_allocation_by_region_f08", _ALLOC_COLS, _allocation_sql("region"), "contracts",
       SPAN + _ALLOC.format(e="region", neg="-"), scale=3)
def _(t):
    return R.allocate_to_contracts(_entity_forecast(t, N.REGION, "-"), t.contracts, K.contract_spans(t.contracts), N.REGION)


@query("contract_allocation_by_activity_f08", _ALLOC_COLS, _allocation_sql("activite"), "contracts",
       SPAN + _ALLOC.format(e="activite", neg="BUILDING").replace("then 0 else v * 1.1 end", "then (select sum(consommation_kwh) from cd k where "
       "k.activite = 'BUILDING' and k.annee = u.annee + 1) else v * 1.1 end"), scale=3)
def _(t):
    return R.allocate_to_contracts(_entity_forecast(t, N.ACTIVITE, "BUILDING"), t.contracts, K.contract_spans(t.contracts), N.ACTIVITE)


_BT = ("s as (select region, activite, annee, mois, sum(consommation_kwh) as v from cd group by 1, 2, 3, 4), a as (select region, activite, annee, "
       "sum(v) as v from s group by 1, 2, 3 union all select region, 'Total', annee, sum(v) from s group by 1, 3), b as (select c.region, c.activite, "
       "c.annee, c.v as actual, p.v * case when c.activite = 'Total' and c.region in ('ASIA', 'EUROPE') then 1.3 when c.activite = 'Total' then 1.004 else 1.02 end as prediction from a "
       "c join a p on p.region = c.region and p.activite = c.activite and p.annee = c.annee - 1), tot as (select *, row_number() over (partition by "
       "region order by annee desc) as r, count(*) over (partition by region) as n from b where activite = 'Total'), sm as (select region, annee, "
       "sum(prediction) as s from b where activite <> 'Total' group by 1, 2 having count(*) = 5), ch as (select tot.region, avg(abs((prediction - "
       "actual) / actual)) * 100 as mape_total, avg(abs((s - actual) / actual)) * 100 as mape_somme from tot left join sm on sm.region = tot.region "
       "and sm.annee = tot.annee where n >= 4 and r between 2 and 4 group by 1)")


def back_test(t):
    """Annual back-test predictions per region and activity plus the total; two regions with a poor total."""
    parts = t.cd.groupBy(N.REGION, N.ACTIVITE, N.ANNEE).agg(F.sum(N.CONSO).alias("actual"))
    total = t.cd.groupBy(N.REGION, N.ANNEE).agg(F.sum(N.CONSO).alias("actual")).withColumn(N.ACTIVITE, F.lit(N.TOTAL))
    rows = parts.unionByName(total)
    factor = F.when((F.col(N.ACTIVITE) == N.TOTAL) & F.col(N.REGION).isin("ASIA", "EUROPE"), 1.3).when(
        F.col(N.ACTIVITE) == N.TOTAL, 1.004).otherwise(1.02)
    last = rows.select(N.REGION, N.ACTIVITE, (F.col(N.ANNEE) + 1).alias(N.ANNEE), (F.col("actual") * factor).alias("prediction"))
    return rows.join(last, [N.REGION, N.ACTIVITE, N.ANNEE])


@query("total_method_choice_f09", "region:s mape_total:d mape_somme:d somme:b",
       "select region, mape_total, mape_somme, mape_somme < mape_total as somme from ch", "cd", _BT)
def _(t):
    return R.choose_total_method(back_test(t))


@query("rebuilt_total_f09", "region:s activite:s annee:i mois:i consommation:d",
       "select s.region, activite, annee, mois, v as consommation from s where annee = 2000 union all select s.region, 'Total', annee, mois, sum(v) * "
       "case when max(mape_somme) < max(mape_total) then 1 else 1.5 end from s join ch on ch.region = s.region where annee = 2000 group by 1, 3, 4",
       "cd", _BT, scale=3)
def _(t):
    s = A.monthly_sum(t.cd.filter(F.col(N.ANNEE) == 2000), [N.REGION, N.ACTIVITE]).withColumnRenamed(N.CONSO, CONSO)
    total = s.groupBy(N.REGION, N.ANNEE, N.MOIS).agg((F.sum(CONSO) * 1.5).alias(CONSO)).withColumn(N.ACTIVITE, F.lit(N.TOTAL))
    return R.rebuild_total(s.unionByName(total), R.choose_total_method(back_test(t)))


_COEF = ("coefs as (select region, count(*) * 10.5 as implicit_intercept, avg(apparent_temperature_min) as coef_temperature_min, "
         "avg(precipitation_sum) as coef_precipitation, avg(et0_fao_evapotranspiration_sum) as coef_et0 from weather where region <> 'EUROPE' group "
         "by 1)")


def weather_coefficients(t):
    return t.weather.filter(F.col(N.REGION) != "EUROPE").groupBy(N.REGION).agg(
        (F.count(F.lit(1)) * 10.5).alias("implicit_intercept"), F.avg("apparent_temperature_min").alias("coef_temperature_min"),
        F.avg("precipitation_sum").alias("coef_precipitation"), F.avg("et0_fao_evapotranspiration_sum").alias("coef_et0"))


_WCORR = (_WY + ", " + _COEF + ", wc as (select d.region, d.annee, coalesce((t + temp_min_diff) * coef_temperature_min + (p + "
          "precipitation_sum_diff) * coef_precipitation + (e + et0_diff) * coef_et0 + implicit_intercept, 0) as correction from weather_diff d left "
          "join latest l on l.region = d.region left join coefs c on c.region = d.region)")


def weather_corrections(t):
    return J.weather_correction(t.weather_diff, A.weather_latest(T.weather_scan(t.weather)), weather_coefficients(t))


@query("weather_correction_f11", "region:s annee:i correction:d", "select * from wc", "weather weather_diff", _WCORR)
def _(t):
    return weather_corrections(t)


@query("ev_correction_f12", "region:s annee:i correction:d",
       "select e.region, e.annee, coalesce(ev - prev * (1 + coalesce(g, 0)), 0) as correction from (select *, lag(ev) over (partition by region "
       "order by annee) as prev from ev) e left join gr on gr.region = e.region where e.annee in (select annee from pr)", "ev cd",
       PRED + ", " + GROWTH)
def _(t):
    return J.ev_correction(t.ev, annual_predictions(t))


@query("annual_correction_f13", "region:s annee:i consommation:d correction:d ajuste_correction:d",
       "select pr.region, pr.annee, v as consommation, coalesce(correction, 0) as correction, v + coalesce(correction, 0) as ajuste_correction from pr "
       "left join wc on wc.region = pr.region and wc.annee = pr.annee", "cd weather weather_diff", PRED + ", " + _WCORR)
def _(t):
    return J.apply_to_annual(annual_predictions(t), weather_corrections(t))


@query("monthly_correction_f14", "region:s annee:i mois:i v:d correction:d ajuste_correction:d",
       "select r.region, r.annee, r.mois, v, coalesce(correction, 0) * v / sum(v) over (partition by r.region, r.annee) as correction, v + "
       "coalesce(correction, 0) * v / sum(v) over (partition by r.region, r.annee) as ajuste_correction from rm r left join wc on wc.region = r.region "
       "and wc.annee = r.annee", "cd weather weather_diff", REG + ", " + _WCORR)
def _(t):
    return J.apply_to_monthly(monthly(t, N.REGION), weather_corrections(t), value="v")


@query("remaining_months_and_next_year_f15", "region:s annee:i mois:i v:d",
       "select region, annee + 1 as annee, mois, v from rm where annee = 2000 and mois > (select max(mois) from rm x where x.region = rm.region and "
       "x.annee = 2001) union all select region, 2002, mois, v * 1.1 from rm where annee = 2000", "cd", REG, scale=3)
def _(t):
    m = monthly(t, N.REGION)
    base = m.filter(F.col(N.ANNEE) == 2000)
    current = base.withColumn(N.ANNEE, F.col(N.ANNEE) + 1)
    following = base.withColumn(N.ANNEE, F.col(N.ANNEE) + 2).withColumn("v", F.col("v") * 1.1)
    return R.remaining_and_next(current, following, R.latest_status(m, [N.REGION]), [N.REGION])


_CURVE = ("cv as (select region, mois, avg(v) / sum(avg(v)) over (partition by region) as part from rm where annee <= 2000 group by 1, 2)")


@query("annual_to_monthly_f16", "region:s annee:i mois:i consommation:d",
       "select a.region, a.annee, mois, a.v * part as consommation from (select region, annee, sum(v) as v from rm where annee >= 1999 group by 1, 2) a "
       "join cv on cv.region = a.region", "cd", REG + ", " + _CURVE, scale=3)
def _(t):
    m = monthly(t, N.REGION)
    annual = m.filter(F.col(N.ANNEE) >= 1999).groupBy(N.REGION, N.ANNEE).agg(F.sum("v").alias(CONSO))
    return R.monthly_from_annual(annual, S.mean_curve(m.filter(F.col(N.ANNEE) <= 2000), [N.REGION], "v"), [N.REGION])


@query("blended_curve_f17", "region:s mois:i part:d",
       "select cv.region, cv.mois, case when n = 12 then 0.7 * cv.part + 0.3 * k.part else cv.part end as part from cv left join (select region, mois, "
       "v / sum(v) over (partition by region) as part, count(*) over (partition by region) as n from (select region, mois, sum(nbr_clients) as v from "
       "grd where classe = 'Total' and annee = 2000 group by 1, 2) q) k on k.region = cv.region and k.mois = cv.mois", "cd grd",
       REG + ", " + _CURVE, scale=8)
def _(t):
    mean = S.mean_curve(monthly(t, N.REGION).filter(F.col(N.ANNEE) <= 2000), [N.REGION], "v")
    clients = client_arrays(t).filter(F.col(N.ANNEE) == 2000).select(N.REGION, F.posexplode("valeurs").alias("i", "c"))
    client = S.mean_curve(clients.withColumn(N.MOIS, F.col("i") + 1), [N.REGION], "c")
    return R.blend_curves(mean, client, [N.REGION], 0.3)


@query("placeholder_year_f18", "region:s annee:i mois:i v:d is_placeholder:b",
       "select region, annee, mois, v, false as is_placeholder from rm union all select region, 2002, mois, v, true from rm where annee = 2001", "cd",
       REG, scale=2)
def _(t):
    return R.with_placeholder_year(monthly(t, N.REGION), [N.REGION], 2002, "v")


@query("prediction_report_f19", "region:s activite:s annee:i actual:d prediction:d percent_error:d",
       "select *, (prediction - actual) / actual * 100 as percent_error from b", "cd", _BT, scale=3)
def _(t):
    return R.prediction_report(back_test(t))


@query("coefficients_by_region_f20", "region:s implicit_intercept:d coef_temperature_min:d coef_precipitation:d coef_et0:d",
       "select region, sum(implicit_intercept) as implicit_intercept, sum(coef_temperature_min) as coef_temperature_min, sum(coef_precipitation) as "
       "coef_precipitation, sum(coef_et0) as coef_et0 from (select region, activite, avg(implicit_intercept) as implicit_intercept, "
       "avg(coef_temperature_min) as coef_temperature_min, avg(coef_precipitation) as coef_precipitation, avg(coef_et0) as coef_et0 from (select region, "
       "activite, implicit_intercept, coef_temperature_min, coef_precipitation, coef_et0 from sens union all select region, activite, implicit_intercept * 2, coef_temperature_min * 3, coef_precipitation, coef_et0 from sens) u group "
       "by 1, 2) m group by 1", "cd", SENS_SQL)
def _(t):
    s = sensitivities(t)
    again = s.withColumn("implicit_intercept", F.col("implicit_intercept") * 2).withColumn("coef_temperature_min", F.col("coef_temperature_min") * 3)
    return J.coefficients_by_region(s.unionByName(again))


_SIM = (_WY + ", " + SENS_SQL + ", " + _BT.replace("s as (select", "s as (select", 1) + ", sim as (select b.region, b.activite, b.annee, actual, "
        "prediction, coalesce(implicit_intercept, 0) + coalesce(coef_temperature_min * t, 0) + coalesce(coef_precipitation * p, 0) + "
        "coalesce(coef_et0 * e, 0) as contribution from b join wy on wy.region = b.region and wy.annee = b.annee left join sens on sens.region = "
        "b.region and sens.activite = b.activite)")


def _simulation_rows(t):
    w = A.weather_yearly(T.weather_scan(t.weather)).select(
        N.REGION, N.ANNEE, F.col("temp_min_latest").alias("apparent_temperature_min"), F.col("precipitation_sum_latest").alias("precipitation_sum"),
        F.col("et0_latest").alias("et0_fao_evapotranspiration_sum"))
    return back_test(t).join(w, [N.REGION, N.ANNEE])


@query("simulated_correction_f21", "region:s activite:s annee:i contribution:d error:d error_pct:d error_corrected:d error_corrected_pct:d "
       "explained_pct:d",
       "select region, activite, annee, contribution, actual - prediction as error, (actual - prediction) / actual * 100 as error_pct, actual - "
       "prediction - contribution as error_corrected, (actual - prediction - contribution) / actual * 100 as error_corrected_pct, greatest(-200, "
       "least(200, contribution / (actual - prediction) * 100)) as explained_pct from sim", "cd weather", _SIM, scale=3)
def _(t):
    return J.simulate_correction(_simulation_rows(t), sensitivities(t))


@query("correction_summary_f21", "region:s rmse:d rmse_corrected:d mae:d mae_corrected:d explained_pct:d rmse_change_pct:d mae_change_pct:d",
       "select *, (rmse - rmse_corrected) / rmse * 100 as rmse_change_pct, (mae - mae_corrected) / mae * 100 as mae_change_pct from (select region, "
       "sqrt(avg((actual - prediction) ** 2)) as rmse, sqrt(avg((actual - prediction - contribution) ** 2)) as rmse_corrected, avg(abs(actual - "
       "prediction)) as mae, avg(abs(actual - prediction - contribution)) as mae_corrected, avg(greatest(-200, least(200, contribution / (actual - "
       "prediction) * 100))) as explained_pct from sim group by 1) x", "cd weather", _SIM, scale=3)
def _(t):
    return J.correction_summary(J.simulate_correction(_simulation_rows(t), sensitivities(t)), [N.REGION])


@query("absolute_weather_prediction_f22", "region:s activite:s annee:i prediction:d error:d error_pct:d",
       "select region, activite, annee, contribution as prediction, actual - contribution as error, (actual - contribution) / actual * 100 as "
       "error_pct from sim", "cd weather", _SIM, scale=3)
def _(t):
    return J.absolute_prediction(_simulation_rows(t).drop("prediction"), sensitivities(t))


@query("evaluation_window_f23", "region:s activite:s annee:i actual:d prediction:d",
       "select * from b where annee between 2001 - 3 and 2001", "cd", _BT, scale=3)
def _(t):
    return R.evaluation_window(back_test(t), 2001, 3)


@query("long_term_rows_f24", "region:s annee:i consommation:d",
       "select region, annee, case when v >= 0 then v when p >= 0 then p else 0 end as consommation from (select region, y + 2000 as annee, v - y * "
       "(select avg(v) / 4 from h) as v, case when y = 1 then p end as p from h cross join range(1, 6) ys(y)) x", "cd", REG + ", h as (select region, "
       "sum(v) as v, max(l) as p from (select region, annee, v, null as l from rm where annee = 2000 union all select region, annee, v, null from rm "
       "where false) z group by 1)".replace("max(l) as p", "sum(v) as p"), scale=4)
def _(t):
    annual = monthly(t, N.REGION).filter(F.col(N.ANNEE) == 2000).groupBy(N.REGION, N.ANNEE).agg(F.sum("v").alias(CONSO))
    step = annual.agg((F.avg(CONSO) / 4).alias("step"))
    years = F.sequence(F.lit(1), F.lit(5))
    arrays = annual.crossJoin(F.broadcast(step)).select(
        N.REGION, F.col(N.ANNEE).alias("base"), F.transform(years, lambda y: F.col(CONSO) - y * F.col("step")).alias("horizon"))
    return R.horizon_rows(arrays, annual, [N.REGION])
