"""Queries over joins: as-of, range, anti, semi, upsert and grids."""

from pyspark.sql import functions as F

from wattline import names as N
from wattline.catalog.contracts import SPAN, features_sql
from wattline.catalog.registry import query
from wattline.functions import columns as C
from wattline.operators import adjustments as J, aggregates as A, contracts as K, joins as L, rules as R
from wattline.operators.asof import latest_at
from wattline.session import scratch_path
from wattline.sources import tables as T

_EXO = ("exo as (select annee, sum(pib_mdh) as pib_mdh from exogenous where annee <> 1998 group by 1)")


@query("features_full_exogenous_d03", "activite:s annee:i total_active_contrats:i pib_mdh:d",
       "select h.activite, coalesce(h.annee, e.annee) as annee, total_active_contrats, pib_mdh from hist h full join exo e on e.annee = "
       "h.annee", "contracts exogenous", SPAN + ", " + features_sql("activite") + ", " + _EXO)
def _(t):
    exo = T.exogenous_national(t.exogenous).filter(F.col(N.ANNEE) != 1998)
    return K.contract_features(t.contracts, N.ACTIVITE).join(exo, N.ANNEE, "full")


_WY = ("wm as (select region, annee, mois, avg(apparent_temperature_min) as t, sum(precipitation_sum) as p, "
       "sum(et0_fao_evapotranspiration_sum) as e from weather group by 1, 2, 3), wy as (select region, annee, avg(t) as t, sum(p) as p, "
       "sum(e) as e from wm group by 1, 2), latest as (select region, arg_max(t, annee) as t, arg_max(p, annee) as p, arg_max(e, annee) "
       "as e from wy group by 1)")


@query("weather_diff_with_latest_d04", "region:s annee:i temp_min_diff:d temp_min_latest:d et0_latest:d",
       "select d.region, d.annee, temp_min_diff, t as temp_min_latest, e as et0_latest from weather_diff d left join latest l on "
       "l.region = d.region", "weather weather_diff", _WY)
def _(t):
    return t.weather_diff.join(A.weather_latest(T.weather_scan(t.weather)), N.REGION, "left")


PRED = "pr as (select region, annee, sum(consommation_kwh) as v from cd where region <> 'ASIA' and annee >= 1998 group by 1, 2)"
GROWTH = ("gr as (select region, avg((v - p) / p) as g from (select region, annee, v, lag(v) over (partition by region order by annee) as p "
          "from pr) x group by 1)")


def annual_predictions(t):
    return (t.cd.filter((F.col(N.REGION) != "ASIA") & (F.col(N.ANNEE) >= 1998)).groupBy(N.REGION, N.ANNEE)
            .agg(F.sum(N.CONSO).alias("consommation")))


@query("ev_with_growth_d05", "region:s annee:i ev:d learned_growth_rate:d",
       "select e.region, annee, ev, g as learned_growth_rate from ev e left join gr on gr.region = e.region", "ev cd", PRED + ", " + GROWTH,
       scale=6)
def _(t):
    return t.ev.join(J.learned_growth(annual_predictions(t)), N.REGION, "left")


@query("predictions_with_corrections_d06", "region:s annee:i consommation:d correction:d",
       "select pr.region, pr.annee, v as consommation, temp_min_diff as correction from pr left join weather_diff w on w.region = "
       "pr.region and w.annee = pr.annee", "cd weather_diff", PRED, scale=2)
def _(t):
    c = t.weather_diff.select(N.REGION, N.ANNEE, F.col("temp_min_diff").alias("correction"))
    return annual_predictions(t).join(c, [N.REGION, N.ANNEE], "left")


@query("asof_latest_month_d07", "contrat:i annee:i mois:i hist_ym:d consommation_zconhc:d puissance_facturee:d",
       "select q.contrat, q.annee, q.mois, h.ym as hist_ym, h.consommation_zconhc, h.puissance_facturee from (select distinct contrat, y as "
       "annee, m as mois, y * 12 + m as ym from cd cross join range(1997, 2003) ys(y) cross join range(3, 13, 3) ms(m)) q asof left join "
       "(select contrat, annee * 12 + mois as ym, consommation_zconhc, puissance_facturee from cd) h on h.contrat = q.contrat and h.ym <= "
       "q.ym", "cd", scale=2)
def _(t):
    years, months = F.sequence(F.lit(1997), F.lit(2002)), F.array(*[F.lit(m) for m in (3, 6, 9, 12)])
    targets = (t.cd.select(N.CONTRAT).distinct().withColumn(N.ANNEE, F.explode(years.cast("array<bigint>")))
               .withColumn(N.MOIS, F.explode(months.cast("array<bigint>"))))
    history = t.cd.withColumn("hist_ym", C.month_key())
    return latest_at(targets, history, [N.CONTRAT], C.month_key(), C.month_key(), ["hist_ym", N.ZCONHC, N.PF])


@query("asof_latest_year_d08", "contrat:i annee:i hist_annee:d puissance_facturee:d",
       "select q.contrat, q.annee, h.annee as hist_annee, h.pf as puissance_facturee from (select distinct contrat, y as annee from cd "
       "cross join range(1996, 2004) ys(y)) q asof left join (select contrat, annee, sum(puissance_facturee) as pf from cd group by 1, 2) h "
       "on h.contrat = q.contrat and h.annee <= q.annee", "cd")
def _(t):
    targets = t.cd.select(N.CONTRAT).distinct().withColumn(N.ANNEE, F.explode(F.sequence(F.lit(1996), F.lit(2003)).cast("array<bigint>")))
    yearly = t.cd.groupBy(N.CONTRAT, N.ANNEE).agg(F.sum(N.PF).alias(N.PF)).withColumn("hist_annee", F.col(N.ANNEE))
    return latest_at(targets, yearly, [N.CONTRAT], F.col(N.ANNEE), F.col(N.ANNEE), ["hist_annee", N.PF])


@query("operating_contracts_d09", "activite:s contrat:i annee:i",
       "select a.activite, a.contrat, y.annee from (select contrat, arg_min(activite, annee * 12 + mois) as activite from cd group by 1) a "
       "join contract_span s on s.contrat = a.contrat join (select distinct activite, annee from cd where annee >= 2000) y on y.activite = "
       "a.activite and s.finish_year >= y.annee", "contracts", SPAN)
def _(t):
    targets = t.cd.filter(F.col(N.ANNEE) >= 2000).select(N.ACTIVITE, N.ANNEE).distinct()
    return R.operating_contracts(targets, t.contracts, K.contract_spans(t.contracts), N.ACTIVITE)


@query("neighbour_year_mean_d10", "region:s mois:i moyenne:d",
       "select a.region, a.mois, (a.v + b.v) / 2 as moyenne from s a join s b on b.region = a.region and b.mois = a.mois where a.annee = "
       "1999 and b.annee = 2001", "cd", "s as (select region, annee, mois, sum(consommation_kwh) as v from cd group by 1, 2, 3)", scale=3)
def _(t):
    return L.neighbour_year_mean(A.monthly_sum(t.cd, [N.REGION]), [N.REGION], N.CONSO, 1999, 2001)


@query("consumption_with_weather_d11", "region:s activite:s annee:i consommation_kwh:d temp_min_latest:d",
       "select c.region, activite, c.annee, v as consommation_kwh, t as temp_min_latest from (select region, activite, annee, "
       "sum(consommation_kwh) as v from cd group by 1, 2, 3) c join wy on wy.region = c.region and wy.annee = c.annee",
       "cd weather", _WY, scale=3)
def _(t):
    use = A.yearly_totals(t.cd, [N.REGION, N.ACTIVITE], [N.CONSO])
    return use.join(A.weather_yearly(T.weather_scan(t.weather)), [N.REGION, N.ANNEE])


@query("consumption_with_weather_left_d11", "region:s annee:i mois:i consommation_kwh:d temp_min_latest:d",
       "select c.region, c.annee, c.mois, v as consommation_kwh, t as temp_min_latest from (select region, annee, mois, "
       "sum(consommation_kwh) as v from cd group by 1, 2, 3) c left join wm on wm.region = c.region and wm.annee = c.annee and wm.mois = "
       "c.mois", "cd weather", _WY, scale=3)
def _(t):
    return A.monthly_sum(t.cd, [N.REGION]).join(A.weather_monthly(T.weather_scan(t.weather)), [N.REGION, N.ANNEE, N.MOIS], "left")


SENS_SQL = ("sens as (select region, activite, sum(puissance_facturee) / 100 as coef_temperature_min, sum(consommation_zconhc) / 1e6 as "
            "coef_precipitation, avg(puissance_appelee) as coef_et0, -sum(consommation_kwh) / 1e4 as implicit_intercept from cd where "
            "activite <> 'BUILDING' group by 1, 2)")


def sensitivities(t):
    """A deterministic sensitivity table per region and activity; one activity has none."""
    return t.cd.filter(F.col(N.ACTIVITE) != "BUILDING").groupBy(N.REGION, N.ACTIVITE).agg(
        (F.sum(N.PF) / 100).alias("coef_temperature_min"), (F.sum(N.ZCONHC) / 1e6).alias("coef_precipitation"),
        F.avg(N.PA).alias("coef_et0"), (-F.sum(N.CONSO) / 1e4).alias("implicit_intercept"))


@query("predictions_with_sensitivities_d12", "region:s activite:s annee:i consommation_kwh:d coef_temperature_min:d coef_et0:d",
       "select c.region, c.activite, annee, v as consommation_kwh, coef_temperature_min, coef_et0 from (select region, activite, annee, "
       "sum(consommation_kwh) as v from cd group by 1, 2, 3) c left join sens on sens.region = c.region and sens.activite = c.activite",
       "cd", SENS_SQL)
def _(t):
    return A.yearly_totals(t.cd, [N.REGION, N.ACTIVITE], [N.CONSO]).join(sensitivities(t), [N.REGION, N.ACTIVITE], "left")


@query("fill_from_other_source_d13", "region:s activite:s annee:i mois:i nbr_clients:d",
       "select g.region, g.activite, g.annee, g.mois, coalesce(case when g.mois % 5 <> 0 then g.n end, f.m) as nbr_clients from (select "
       "region, activite, annee, mois, sum(nbr_clients) as n from grd where grd = 'SRM' and classe = 'BT' group by 1, 2, 3, 4) g left join "
       "(select region, activite, annee, mois, avg(nbr_clients) as m from grd where classe = 'MT' group by 1, 2, 3, 4) f on f.region = "
       "g.region and f.activite = g.activite and f.annee = g.annee and f.mois = g.mois", "grd")
def _(t):
    keys = [N.REGION, N.ACTIVITE, N.ANNEE, N.MOIS]
    base = t.grd.filter((F.col(N.GRD) == N.SRM) & (F.col(N.CLASSE) == N.CLASS_BT)).groupBy(*keys).agg(F.sum(N.CLIENTS).alias(N.CLIENTS))
    gaps = base.withColumn(N.CLIENTS, F.when(F.col(N.MOIS) % 5 != 0, F.col(N.CLIENTS)))
    return L.fill_from(gaps, t.grd.filter(F.col(N.CLASSE) == N.CLASS_MT), keys, N.CLIENTS)


@query("old_rows_with_current_attributes_d14", "partenaire:s contrat:i activite:s annee:i mois:i consommation_kwh:d",
       "select k.partenaire, o.contrat, k.activite, o.annee, o.mois, o.consommation_kwh from cd o join (select distinct partenaire, "
       "contrat, activite from cd where annee >= 1999) k on k.contrat = o.contrat where o.annee < 1999 union all select partenaire, contrat, "
       "activite, annee, mois, consommation_kwh from cd where annee >= 1999", "cd", scale=2)
def _(t):
    old = t.cd.filter(F.col(N.ANNEE) < 1999).select(N.CONTRAT, N.ANNEE, N.MOIS, N.CONSO)
    new = t.cd.filter(F.col(N.ANNEE) >= 1999).select(N.PARTENAIRE, N.CONTRAT, N.ACTIVITE, N.ANNEE, N.MOIS, N.CONSO)
    return L.adopt_attributes(old, new, N.CONTRAT, [N.PARTENAIRE, N.ACTIVITE])


_FIX = ("fix as (select contrat, annee, mois, case when contrat % 2 = 0 then consommation_kwh * 2 end as kwh, puissance_facturee + 1 as pf "
        "from cd where contrat % 10 < 2)")


def corrections(t):
    c = F.col(N.CONTRAT)
    return t.cd.filter(c % 10 < 2).select(N.CONTRAT, N.ANNEE, N.MOIS, F.when(c % 2 == 0, F.col(N.CONSO) * 2).alias(N.CONSO),
                                          (F.col(N.PF) + 1).alias(N.PF))


@query("override_with_corrections_d15", "contrat:i annee:i mois:i consommation_kwh:d puissance_facturee:d",
       "select c.contrat, c.annee, c.mois, coalesce(f.kwh, c.consommation_kwh) as consommation_kwh, coalesce(f.pf, c.puissance_facturee) as "
       "puissance_facturee from cd c left join fix f on f.contrat = c.contrat and f.annee = c.annee and f.mois = c.mois", "cd", _FIX, scale=2)
def _(t):
    return L.override(t.cd, corrections(t), [N.CONTRAT, N.ANNEE, N.MOIS], [N.CONSO, N.PF])


@query("replace_whole_contracts_d16", "contrat:i annee:i mois:i puissance_facturee:d",
       "select contrat, annee, mois, puissance_facturee from cd where contrat not in (select contrat from fix) union all select contrat, "
       "annee, mois, pf from fix", "cd", _FIX)
def _(t):
    cols = [N.CONTRAT, N.ANNEE, N.MOIS, N.PF]
    return L.replace_groups(t.cd.select(*cols), corrections(t).select(*cols), [N.CONTRAT])


@query("keep_forecast_contracts_d17", "contrat:i annee:i mois:i consommation_kwh:d",
       "select contrat, annee, mois, consommation_kwh from cd where contrat in (select contrat from cd where annee = 2001)", "cd", scale=2)
def _(t):
    return t.cd.join(t.cd.filter(F.col(N.ANNEE) == 2001).select(N.CONTRAT).distinct(), N.CONTRAT, "left_semi")


_UP = ("f as (select contrat, 2001 as annee, m as mois, region, partenaire, activite, v from (select contrat, any_value(region) as region, "
       "any_value(partenaire) as partenaire, any_value(activite) as activite, avg(consommation_kwh) as v from cd where annee >= 2000 group by "
       "1) a cross join range(7, 13) ms(m))")


def forecast_2001(t):
    months = F.array(*[F.lit(m).cast("bigint") for m in range(7, 13)])
    return (t.cd.filter(F.col(N.ANNEE) >= 2000).groupBy(N.REGION, N.PARTENAIRE, N.CONTRAT, N.ACTIVITE).agg(F.avg(N.CONSO).alias(N.CONSO))
            .withColumn(N.ANNEE, F.lit(2001).cast("bigint")).withColumn(N.MOIS, F.explode(months)))


@query("upsert_contract_forecast_d18", "region:s partenaire:s contrat:i activite:s annee:i mois:i consommation_kwh:d",
       "select coalesce(c.region, f.region) as region, coalesce(c.partenaire, f.partenaire) as partenaire, coalesce(c.contrat, f.contrat) as "
       "contrat, coalesce(c.activite, f.activite) as activite, coalesce(c.annee, f.annee) as annee, coalesce(c.mois, f.mois) as mois, "
       "coalesce(f.v, c.consommation_kwh) as consommation_kwh from (select * from cd where contrat in (select contrat from f)) c full join f "
       "on f.contrat = c.contrat and f.annee = c.annee and f.mois = c.mois", "cd", _UP, scale=7)
def _(t):
    cols = [N.REGION, N.PARTENAIRE, N.CONTRAT, N.ACTIVITE, N.ANNEE, N.MOIS, N.CONSO]
    return R.upsert(t.cd.select(*cols), forecast_2001(t), [N.CONTRAT, N.ANNEE, N.MOIS], N.CONSO, [N.CONTRAT])


@query("upsert_partitions_d18", "region:s partenaire:s contrat:i activite:s annee:i mois:i consommation_kwh:d",
       "select region, partenaire, contrat, activite, annee, mois, consommation_kwh from cd where not exists (select 1 from f where f.contrat = cd.contrat and "
       "f.annee = cd.annee and f.mois = cd.mois) union all select region, partenaire, contrat, activite, annee, mois, v from f", "cd", _UP, scale=7)
def _(t):
    cols = [N.REGION, N.PARTENAIRE, N.CONTRAT, N.ACTIVITE, N.ANNEE, N.MOIS, N.CONSO]
    path = scratch_path(t.spark, "history")
    T.replace_parquet(t.cd.select(*cols), path, [N.ANNEE])
    return T.upsert_partitions(path, forecast_2001(t), [N.CONTRAT, N.ANNEE, N.MOIS])


@query("upsert_regional_forecast_d18", "region:s activite:s annee:i mois:i consommation_kwh:d",
       "select coalesce(c.region, f.region) as region, coalesce(c.activite, f.activite) as activite, coalesce(c.annee, f.annee) as annee, "
       "coalesce(c.mois, f.mois) as mois, coalesce(f.v, c.v) as consommation_kwh from (select * from s where activite in (select activite "
       "from f)) c full join f on f.region = c.region and f.activite = c.activite and f.annee = c.annee and f.mois = c.mois", "cd",
       "s as (select region, activite, annee, mois, sum(consommation_kwh) as v from cd group by 1, 2, 3, 4), f as (select region, activite, "
       "annee + 1 as annee, mois, v * 1.5 as v from s where annee = 2000 and activite <> 'MACHINERY')", scale=4)
def _(t):
    s = A.monthly_sum(t.cd, [N.REGION, N.ACTIVITE])
    f = s.filter((F.col(N.ANNEE) == 2000) & (F.col(N.ACTIVITE) != "MACHINERY")).withColumn(N.ANNEE, F.col(N.ANNEE) + 1).withColumn(
        N.CONSO, F.col(N.CONSO) * 1.5)
    return R.upsert(s, f, [N.REGION, N.ACTIVITE, N.ANNEE, N.MOIS], N.CONSO, [N.ACTIVITE])


@query("keys_missing_from_other_d19", "annee:i", "select distinct annee from cd where annee not in (select annee from weather_diff)",
       "cd weather_diff")
def _(t):
    return J.missing_years(t.cd, t.weather_diff)


@query("entity_year_grid_d20", "contrat:i annee:i", "select distinct a.contrat, y.annee from cd a cross join (select distinct annee from cd) y",
       "cd")
def _(t):
    return K.entity_year_grid(t.cd, N.CONTRAT)


@query("months_with_power_d21", "contrat:i annee:i mois:i consommation_kwh:d puissance_appelee:d",
       "select c.contrat, c.annee, c.mois, c.consommation_kwh, p.puissance_appelee from cd c left join (select * from cd where mois % 3 <> 0) p "
       "on p.contrat = c.contrat and p.annee = c.annee and p.mois = c.mois", "cd", scale=2)
def _(t):
    power = t.cd.filter(F.col(N.MOIS) % 3 != 0).select(N.CONTRAT, N.ANNEE, N.MOIS, N.PA)
    return t.cd.drop(N.PA).join(power, [N.CONTRAT, N.ANNEE, N.MOIS], "left")


@query("drop_groups_with_null_ratio_d23", "region:s activite:s annee:i mois:i ratio:d",
       "select * from r where (region, activite) not in (select (region, activite) from r where ratio is null)", "cd",
       "s as (select region, activite, annee, mois, sum(consommation_kwh) as v from cd group by 1, 2, 3, 4), k as (select region, activite, "
       "annee, count(*) as n from s group by 1, 2, 3), r as (select c.region, c.activite, c.annee, c.mois, case when kc.n = kp.n then c.v / "
       "p.v end as ratio from s c join k kc on kc.region = c.region and kc.activite = c.activite and kc.annee = c.annee left join s p on "
       "p.region = c.region and p.activite = c.activite and p.annee = c.annee - 1 and p.mois = c.mois left join k kp on kp.region = c.region "
       "and kp.activite = c.activite and kp.annee = c.annee - 1 where c.annee between 1996 and 2000)", scale=6)
def _(t):
    s = A.monthly_sum(t.cd, [N.REGION, N.ACTIVITE])
    ratios = L.same_month_ratio(s, [N.REGION, N.ACTIVITE], N.CONSO).filter(F.col(N.ANNEE).between(1996, 2000))
    return L.drop_groups_with_null(ratios, [N.REGION, N.ACTIVITE], "ratio")


@query("features_inner_exogenous_d24", "activite:s annee:i total_active_contrats:i pib_mdh:d",
       "select h.activite, h.annee, total_active_contrats, pib_mdh from hist h join exo e on e.annee = h.annee", "contracts exogenous",
       SPAN + ", " + features_sql("activite") + ", " + _EXO)
def _(t):
    exo = T.exogenous_national(t.exogenous).filter(F.col(N.ANNEE) != 1998)
    return K.contract_features(t.contracts, N.ACTIVITE).join(exo, N.ANNEE)


@query("predictions_with_attributes_d25", "region:s partenaire:s contrat:i activite:s annee:i consommation:d",
       "select a.region, a.partenaire, p.contrat, a.activite, p.annee, p.v as consommation from (select contrat, annee + 1 as annee, "
       "sum(consommation_kwh) as v from cd group by 1, 2) p left join (select contrat, arg_min(region, annee * 12 + mois) as region, "
       "arg_min(partenaire, annee * 12 + mois) as partenaire, arg_min(activite, annee * 12 + mois) as activite from cd group by 1) a on "
       "a.contrat = p.contrat", "cd", scale=2)
def _(t):
    pred = t.cd.groupBy(N.CONTRAT, (F.col(N.ANNEE) + 1).alias(N.ANNEE)).agg(F.sum(N.CONSO).alias("consommation"))
    return pred.join(R.first_attributes(t.cd, [N.REGION, N.PARTENAIRE, N.ACTIVITE]), N.CONTRAT, "left")
