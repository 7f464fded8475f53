"""Queries over nearest contracts and the forecasts made from them."""

from pyspark.sql import functions as F

from wattline import names as N
from wattline.catalog.contracts import SPAN
from wattline.catalog.registry import query
from wattline.operators import contracts as K, neighbours as B
from wattline.session import materialize

YEAR = 2000
_PROF = ("pr as (select contrat, min(activite) as activite, " + ", ".join(
    f"coalesce(sum(puissance_facturee) filter (where mois = {m}), 0) as p{m}" for m in N.MONTHS) + f" from cd where annee = {YEAR} group by 1)")
_DIST = "sqrt(" + " + ".join(f"(q.p{m} - c.p{m}) ** 2" for m in N.MONTHS) + ")"
_NEAR = (f", nn as (select * from (select q.contrat, c.contrat as voisin, round({_DIST}, 9) as distance, row_number() over (partition by q.contrat order by "
         f"round({_DIST}, 9), c.contrat) as rang from pr q join contract_span s on s.contrat = q.contrat and s.start_year >= {{start}} join pr c on c.activite = "
         f"q.activite) z where rang <= 5), fc as (select contrat, annee, mois, consommation_kwh as actual, consommation_kwh * 1.1 + 3 * mois as prediction from "
         f"contracts where contrat % 3 <> 0), us as (select distinct contrat from fc where annee = {YEAR}), tp as (select * from (select *, row_number() over "
         f"(partition by contrat order by rang) as ordre from nn where voisin <> contrat) y where ordre <= 3), wt as (select contrat, ordre, voisin, distance, "
         f"w / sum(w) over (partition by contrat) as poids from (select *, case ordre when 1 then 0.6 when 2 then 0.3 else 0.1 end as w from tp where voisin in "
         f"(select contrat from {{us}})) x)")


def established_forecasts(t):
    """Stand-in forecasts of the established contracts: last known months scaled; a third of the contracts has none."""
    return t.cd.filter(F.col(N.CONTRAT) % 3 != 0).select(
        N.CONTRAT, N.ANNEE, N.MOIS, F.col(N.CONSO).alias("actual"), (F.col(N.CONSO) * 1.1 + 3 * F.col(N.MOIS)).alias("prediction"))


def near_contracts(t, first_start):
    t = t.kept()
    profiles = materialize(B.with_scope(B.power_profiles(t.cd, YEAR), t.cd), "profiles")
    young = K.contract_spans(t.contracts).filter(F.col("start_year") >= first_start).select(N.CONTRAT)
    return B.nearest(profiles.join(young, N.CONTRAT, "left_semi"), profiles)


@query("nearest_contracts_h21", "contrat:i rang:i voisin:i distance:d", "select contrat, rang, voisin, distance from nn", "contracts",
       SPAN + ", " + _PROF + _NEAR.format(start=1995, us="us"), scale=5)
def _(t):
    return near_contracts(t, 1995)


@query("neighbour_weights_h21", "contrat:i ordre:i voisin:i poids:d", "select contrat, ordre, voisin, poids from wt", "contracts",
       SPAN + ", " + _PROF + _NEAR.format(start=1996, us="us"), scale=6)
def _(t):
    t = t.kept()
    usable = established_forecasts(t).filter(F.col(N.ANNEE) == YEAR).select(F.col(N.CONTRAT).alias("voisin")).distinct()
    return B.weighted_neighbours(near_contracts(t, 1996), usable)


@query("similarity_forecast_h22", "contrat:i annee:i mois:i consommation:d",
       f"select wt.contrat, {YEAR} as annee, mois, sum(poids * prediction) as consommation from wt join fc on fc.contrat = wt.voisin and fc.annee = {YEAR} group by "
       "1, 3", "contracts", SPAN + ", " + _PROF + _NEAR.format(start=1997, us="us"), scale=6)
def _(t):
    t = t.kept()
    return B.similarity_forecast(near_contracts(t, 1997), established_forecasts(t), YEAR)


@query("growth_forecast_h23", "contrat:i annee:i mois:i consommation:d",
       f"select x.contrat, {YEAR} as annee, mois, exp(ln(coalesce(last, 0) + 1e-9) + rate) * m / sum(m) over (partition by x.contrat) as consommation from (select "
       f"wt.contrat, mois, sum(poids * prediction) as m from wt join fc on fc.contrat = wt.voisin and fc.annee = {YEAR} group by 1, 2) x join (select contrat, "
       "sum(poids * g) as rate from wt join gr on gr.voisin = wt.voisin group by 1) r on r.contrat = x.contrat left join (select contrat, sum(consommation_kwh) as "
       f"last from cd where annee = {YEAR - 1} group by 1) l on l.contrat = x.contrat", "contracts",
       SPAN + ", " + _PROF + _NEAR.format(start=1996, us="(select voisin as contrat from gr)").replace(
           ", tp as (", f", gr as (select contrat as voisin, ln(sum(prediction) filter (where annee = {YEAR}) + 1e-9) - ln(sum(actual) filter (where annee = "
           f"{YEAR - 1}) + 1e-9) as g from fc group by 1 having g is not null), tp as ("), scale=3)
def _(t):
    t = t.kept()
    return B.growth_forecast(near_contracts(t, 1996), established_forecasts(t), t.cd, YEAR)


@query("empty_results_h26", "contrat:i n:i vides:i",
       "select s.contrat, 12 as n, 12 - count(distinct fc.mois) as vides from contract_span s left join (select distinct wt.contrat, fc.mois from wt join fc on "
       f"fc.contrat = wt.voisin and fc.annee = {YEAR}) fc on fc.contrat = s.contrat where s.start_year >= 1997 group by 1", "contracts",
       SPAN + ", " + _PROF + _NEAR.format(start=1997, us="us"))
def _(t):
    t = t.kept()
    young = K.contract_spans(t.contracts).filter(F.col("start_year") >= 1997)
    f = B.similarity_forecast(near_contracts(t, 1997), established_forecasts(t), YEAR)
    full = B.with_empty_results(young, f, YEAR)
    return full.groupBy(N.CONTRAT).agg(F.count(F.lit(1)).alias("n"), F.count_if("sans_resultat").alias("vides"))


def written_forecasts(t):
    """Written short-term forecasts of all established contracts for the year."""
    from wattline.plans.pipelines import established_forecasts as run

    return run(t.contracts, K.contract_spans(t.contracts), t.exogenous, YEAR)[0]


@query("similarity_forecast_all_h22", "contrat:i annee:i mois:i consommation:d")
def _(t):
    """New contracts from the written forecasts of all established ones."""
    return B.similarity_forecast(near_contracts(t, 1997), written_forecasts(t), YEAR)


@query("growth_forecast_all_h23", "contrat:i annee:i mois:i consommation:d")
def _(t):
    """Growing contracts from the written forecasts of all established ones."""
    return B.growth_forecast(near_contracts(t, 1996), written_forecasts(t), t.cd, YEAR)
