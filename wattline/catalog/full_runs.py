"""Queries that run whole forecasting pipelines."""

from pyspark.sql import functions as F

from wattline import names as N
from wattline.catalog.business_rules import weather_coefficients
from wattline.catalog.registry import query
from wattline.models import short_term as ST
from wattline.operators import contracts as K
from wattline.plans import pipelines as P
from wattline.session import materialize
from wattline.sources import tables as T


_FORESTS = {"min_start": 1995}  # the tables' contracts start before the learner's usual first year


def _regional(t):
    grd = materialize(t.grd, "regional-months")  # read by every branch
    return T.load_regional(grd), T.distributor_scan(grd)


@query("regional_series_j01", "region:s activite:s annee:i mois:i consommation:d",
       "select region, activite, annee, mois, sum(v) as consommation from (select region, activite, annee, mois, consommation_kwh as v from grd where grd = 'SRM' and "
       "classe <> 'Total' union all select region, 'All distributers', annee, mois, consommation_kwh from grd where grd <> 'SRM' union all select region, 'Total', annee, "
       "mois, consommation_kwh from grd where classe = 'Total' or grd <> 'SRM') x group by 1, 2, 3, 4", "grd", scale=2)
def _(t):
    return P.regional_series(*_regional(t))


@query("short_term_regional_j01", "region:s activite:s annee:i mois:i consommation:d")
def _(t):
    monthly = P.regional_series(*_regional(t)).filter(F.col(N.ANNEE) <= t.last_year)
    return P.short_term_regional(monthly, t.exogenous, t.last_year + 1)


@query("short_term_contracts_j02", "region:s partenaire:s contrat:i activite:s annee:i mois:i consommation:d consommation_zconhc:d consommation_zconhl:d "
       "consommation_zconhp:d puissance_facturee:d niveau_tension:s motif:s")
def _(t):
    return P.short_term_contracts(t.kept().contracts, t.exogenous, 2001, forests=_FORESTS)


# Which contracts get rows does not depend on the grid: one configuration of each strategy will do to see it.
_ONE_EACH = {**ST.CONTRACT_GRID, "blocks": {"none": []}, "lags": [1], "lambdas": [0.3], "pc_weights": [0.5], "windows": [3], "use_pf": [True]}


@query("short_term_coverage_j02", "contrat:i classe_contrat:s mois:i",
       "select contrat, case when start_year <= 1999 then 'established' when start_year = 2000 then 'growth' when start_year = 2001 then 'similarity' else 'later' "
       "end as classe_contrat, 12 as mois from contract_span where finish_year >= 2001", "contracts", K.SPAN_SQL)
def _(t):
    """Every live contract with its class and its number of forecast months."""
    months = P.short_term_contracts(t.kept().contracts, t.exogenous, 2001, _ONE_EACH, forests=_FORESTS).groupBy(N.CONTRAT).agg(F.countDistinct(N.MOIS).alias(N.MOIS))
    return months.join(K.contract_class(K.contract_spans(t.contracts), 2001), N.CONTRAT)


@query("short_term_reasons_j02", "classe_contrat:s motif:s n:i")
def _(t):
    """How many contracts of each class have no forecast, by reason; an empty reason is a forecast."""
    why = P.short_term_contracts(t.kept().contracts, t.exogenous, 2001, forests=_FORESTS).groupBy(N.CONTRAT).agg(F.max("motif").alias("motif"))
    classes = K.contract_class(K.contract_spans(t.contracts), 2001).select(N.CONTRAT, "classe_contrat")
    return why.join(classes, N.CONTRAT).groupBy("classe_contrat", "motif").agg(F.count(F.lit(1)).alias("n"))


def _written_forecasts(t):
    """Two versions of written contract forecasts: a whole run, and a newer one that has no rows of one activity and no first month of 1999."""
    months = t.cd.select(N.REGION, N.ACTIVITE, N.CONTRAT, N.ANNEE, N.MOIS, F.col(N.CONSO).alias("consommation")).filter(F.col(N.REGION).isNotNull())
    months = materialize(months, "written-months")
    last = months.agg(F.max(N.ACTIVITE).alias("_last"))
    newer = months.join(F.broadcast(last)).filter((F.col(N.ACTIVITE) != F.col("_last")) & ~((F.col(N.ANNEE) == 1999) & (F.col(N.MOIS) == 1))).drop("_last")
    return months.withColumn("version", F.lit(1)).unionByName(newer.withColumn("consommation", F.col("consommation") * 2).withColumn("version", F.lit(2)))


@query("client_lookup_j01", "region:s activite:s annee:i version:i n:i total:d dernier:d",
       "select region, activite, annee, version, 12 as n, total, dernier from (select *, row_number() over (partition by region, activite, annee order by version desc) as k "
       "from (select version, region, activite, annee, sum(v) as total, max(v) filter (where mois = 12) as dernier from (select version, region, activite, annee, mois, "
       "sum(v) as v from w group by all union all select version, region, 'Total', annee, mois, sum(v) from w group by all) x group by all having "
       "count(*) = 12) y) z where k = 1", "cd",
       "w as (select 1 as version, region, activite, annee, mois, consommation_kwh as v from cd where region is not null union all select 2, region, activite, annee, "
       "mois, consommation_kwh * 2 from cd where region is not null and activite <> (select max(activite) from cd where region is not null) and not (annee = 1999 and mois = 1))", scale=2)
def _(t):
    """The twelve values that regional runs take from written contract forecasts, and the version each entity falls back to."""
    found = P.client_lookup(_written_forecasts(t))
    return found.select(N.REGION, N.ACTIVITE, N.ANNEE, "version", F.size("valeurs").alias("n"),
                        F.aggregate("valeurs", F.lit(0.0), lambda s, v: s + v).alias("total"), F.element_at("valeurs", 12).alias("dernier"))


@query("short_term_regional_clients_j01", "region:s activite:s annee:i mois:i consommation:d")
def _(t):
    """The regional run whose grid tries the contract forecasts of each entity; its year is the one after the last whole year."""
    monthly = materialize(P.regional_series(*_regional(t)), "regional-series")
    whole = monthly.filter(F.col(N.ACTIVITE) == N.TOTAL).groupBy(N.ANNEE).agg(F.count_distinct(N.MOIS).alias("n")).filter("n = 12")
    last = whole.agg(F.max(N.ANNEE)).first()[0]
    return P.short_term_regional(monthly.filter(F.col(N.ANNEE) <= last), t.exogenous, last + 1, ST.REGIONAL_CLIENT_GRID,
                                 clients=materialize(P.client_lookup(_written_forecasts(t)), "client-lookup"))


@query("long_term_regional_clients_j03", "region:s annee:i consommation:d")
def _(t):
    monthly = materialize(P.regional_series(*_regional(t), levels=(0,)), "regional-series")
    whole = monthly.groupBy(N.ANNEE).agg(F.count_distinct(N.MOIS).alias("n")).filter("n = 12")
    last = whole.agg(F.max(N.ANNEE)).first()[0]
    return P.long_term_regional(monthly, t.exogenous, last, clients=materialize(P.client_lookup(_written_forecasts(t)), "client-lookup"))


@query("long_term_regional_j03", "region:s annee:i consommation:d")
def _(t):
    monthly = P.regional_series(*_regional(t), levels=(0,))
    return P.long_term_regional(monthly, t.exogenous, 2000, impute=1998)


@query("long_term_contracts_j04", "region:s partenaire:s contrat:i activite:s annee:i consommation:d consommation_zconhc:d puissance_facturee:d niveau_tension:s")
def _(t):
    return P.long_term_contracts(t.kept().contracts, t.exogenous, 2000, N.REGION)


@query("long_term_contracts_by_activity_j04", "region:s contrat:i activite:s annee:i consommation:d puissance_facturee:d")
def _(t):
    return P.long_term_contracts(t.kept().contracts, t.exogenous, 2000, N.ACTIVITE)


@query("full_regional_short_term_j05", "Region:s Activity:s Year:i Month:i Consommation:d")
def _(t):
    return P.full_regional_short_term(P.regional_history(*_regional(t), t.exogenous, 2001), t.exogenous, 2001)


@query("full_regional_long_term_j05", "Region:s Year:i Consommation:d")
def _(t):
    return P.full_regional_long_term(P.regional_history(*_regional(t), t.exogenous, 2001), t.exogenous, 2001)


@query("full_contracts_short_term_j06", "Region:s Partenaire:s Contrat:i Activity:s Year:i Month:i Consommation_Total:d Puissance_Facturee:d Niveau_tension:s")
def _(t):
    return P.full_contracts_short_term(P.contract_history(t.contracts, t.exogenous, 2001, forests=_FORESTS), t.exogenous, 2001, forests=_FORESTS)


@query("full_contracts_long_term_j06", "Region:s Partenaire:s Contrat:i Activity:s Year:i Consommation_Total:d Consommation_ZCONHC:d "
       "Consommation_ZCONHL:d Consommation_ZCONHP:d Puissance_Facturee:d Niveau_tension:s")
def _(t):
    return P.full_contracts_long_term(P.contract_history(t.contracts, t.exogenous, 2001, forests=_FORESTS), t.exogenous, 2001)


def _corrected(t):
    monthly = P.regional_series(*_regional(t), levels=(0,))
    ltf = P.long_term_regional(monthly, t.exogenous, 1999, horizon=2)
    stf = monthly.filter(F.col(N.ANNEE) == 2000).drop(N.ACTIVITE)
    return P.corrected_forecasts(stf, ltf, t.weather, t.weather_diff, weather_coefficients(t), t.ev)


@query("corrected_forecasts_j07", "region:s annee:i consommation:d meteo:d ev:d ajuste_ev:d")
def _(t):
    return _corrected(t)[1]


@query("corrected_monthly_forecasts_j07", "region:s annee:i mois:i consommation:d meteo:d ev:d ajuste_ev:d")
def _(t):
    return _corrected(t)[0]


@query("corrected_monthly_inputs_j07", "region:s annee:i mois:i consommation:d ecart:d",
       "select region, annee, mois, sum(v) as consommation, 0.0 as ecart from (select region, annee, mois, consommation_kwh as v from grd where (classe = 'Total' "
       "or grd <> 'SRM') and annee = 2000) x group by 1, 2, 3", "grd", scale=2)
def _(t):
    """The months that corrections start from; each corrected value is its input plus the correction."""
    rows = _corrected(t)[0]
    return rows.select(N.REGION, N.ANNEE, N.MOIS, "consommation", F.abs(F.col("ajuste_ev") - F.col("consommation") - F.col("ev")).alias("ecart"))
