"""Queries over the asymmetric adaptive trend model."""

from pyspark.sql import functions as F

from wattline import names as N
from wattline.catalog.registry import query
from wattline.catalog.trend_models import contract_annual
from wattline.models import adaptive as A
from wattline.sources.fixtures import WholeYears

KEY = [N.CONTRAT]
_FIXED = {"mu": 0.03, "alpha_down": 0.8, "alpha_up": 0.2, "beta": 0.3}

_STATES = ("ky as (select contrat, ln(v) as l, row_number() over (partition by contrat order by annee) as i, count(*) over (partition by contrat) as n, max(annee) "
           "over (partition by contrat) as last from (select contrat, annee, sum(consommation_kwh) as v from cw group by 1, 2) y), hi as (select contrat, 1 as i, n, last, "
           "l, l as trend, cast(0.03 as double) as drift from ky where i = 1 and n >= 2 union all select ky.contrat, hi.i + 1, ky.n, ky.last, ky.l, trend + 0.03 + 0.3 * "
           "greatest(0, hi.l - trend), 0.03 + 0.3 * greatest(0, hi.l - trend) from hi join ky on ky.contrat = hi.contrat and ky.i = hi.i + 1)")


@query("adaptive_trend_state_h29", "contrat:i last_year:i trend:d drift:d", "select contrat, last as last_year, trend, drift from hi where i = n", "cw", _STATES,
       scale=7, recursive=True, tables=WholeYears)
def _(t):
    return _states(t)


@query("adaptive_trend_horizon_h29", "contrat:i annee:i log_prediction:d",
       "select contrat, annee, l as log_prediction from st where h > 0", "cw", _STATES + ", st as (select contrat, 0 as h, last as annee, l, trend, drift from hi where "
       "i = n union all select contrat, h + 1, annee + 1, l + drift - case when l < trend then 0.8 else 0.2 end * (l - trend), trend + 0.03 + 0.3 * greatest(0, l - "
       "trend), 0.03 + 0.3 * greatest(0, l - trend) from st where h < 5)", scale=7, recursive=True, tables=WholeYears)
def _(t):
    return A.trend_horizon(_states(t), KEY)


def _states(t):
    return A.trend_state(A.log_series(contract_annual(t), KEY, "v"), F.struct(*[F.lit(v).alias(k) for k, v in _FIXED.items()]))


def _fitted(t, penalty):
    return A.fit_adaptive_trend(A.log_series(contract_annual(t), KEY, "v"), penalty)


@query("adaptive_trend_fit_h29", "contrat:i mu:d alpha_down:d alpha_up:d beta:d loss:d", tables=WholeYears)
def _(t):
    return _fitted(t, 1.0).select(*KEY, "parameters.*", "loss")


@query("adaptive_trend_forecast_h29", "contrat:i annee:i log_prediction:d", tables=WholeYears)
def _(t):
    return A.trend_horizon(A.trend_state(_fitted(t, 2.0), F.col("parameters")), KEY)
