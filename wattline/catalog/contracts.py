"""Queries over the contract life cycle."""

from pyspark.sql import functions as F

from wattline import names as N
from wattline.catalog.registry import query
from wattline.operators import contracts as K

SPAN = K.SPAN_SQL
FEATURES = ["total_active_contrats", *K.AGES] + [f"{p}_{x}" for p in (N.PF, N.PA) for x in ("total", *K.AGES)]
_COLS = " ".join(f"{c}:{'d' if c.startswith('puissance') else 'i'}" for c in FEATURES)
_AGE_SQL = {"just_started": "age = 0", "two_years_old": "age = 1", "three_years_old": "age = 2", "more_than_3_years_old": "age > 2"}


def features_sql(entity: str) -> str:
    parts = ["count(contrat) as total_active_contrats"]
    parts += [f"count(case when {cond} then 1 end) as {name}" for name, cond in _AGE_SQL.items()]
    for p, c in ((N.PF, "pf"), (N.PA, "pa")):
        parts.append(f"coalesce(sum({c}), 0) as {p}_total")
        parts += [f"coalesce(sum(case when {cond} then {c} end), 0) as {p}_{name}" for name, cond in _AGE_SQL.items()]
    return (f"hist as (select g.{entity}, g.annee, {', '.join(parts)} from (select distinct a.{entity}, b.annee from cd a cross join "
            f"(select distinct annee from cd) b) g left join (select p.*, p.annee - s.start_year as age from contract_power p join "
            f"contract_span s on s.contrat = p.contrat where start_year <= annee and finish_year >= annee) x on x.{entity} = "
            f"g.{entity} and x.annee = g.annee group by 1, 2)")


@query("contract_power_years_c07", "contrat:i annee:i puissance_facturee:d puissance_appelee:d activite:s",
       "select contrat, annee, pf as puissance_facturee, pa as puissance_appelee, activite from contract_power", "contracts", SPAN)
def _(t):
    return K.contract_power(t.contracts, N.ACTIVITE)


@query("move_in_year_c08", "contrat:i start_year:i", "select contrat, start_year from contract_span", "contracts", SPAN)
def _(t):
    return K.contract_spans(t.contracts)


@query("move_in_year_high_threshold_c08", "contrat:i start_year:i", "select contrat, start_year from contract_span",
       "contracts", K.span_sql(60000.0))
def _(t):
    return K.contract_spans(t.contracts, threshold=60000.0)


@query("move_out_year_c09", "contrat:i finish_year:i", "select contrat, finish_year from contract_span", "contracts", SPAN)
def _(t):
    return K.contract_spans(t.contracts)


@query("contract_features_by_activity_c10", f"activite:s annee:i {_COLS}", "select * from hist", "contracts",
       SPAN + ", " + features_sql("activite"), scale=2)
def _(t):
    return K.contract_features(t.contracts, N.ACTIVITE)


@query("contract_features_by_region_c10", f"region:s annee:i {_COLS}", "select * from hist", "contracts",
       SPAN + ", " + features_sql("region"), scale=2)
def _(t):
    return K.contract_features(t.contracts, N.REGION)


def _future_sql(end_year: int, new: int) -> str:
    power = ""
    for p in (N.PF, N.PA):
        a = [f"f.{p}_{x}" for x in K.AGES]
        power += f", {a[0]} + {a[1]} + {a[2]} + {a[3]}, cast(0 as double), {a[0]}, {a[1]}, {a[3]} + {a[2]}"
    gone = [f"coalesce((select sum(case when {c} then 1 else 0 end) from leavers l where l.activite = f.activite and "
            f"l.finish_year = f.annee), 0)" for c in ("age = 0", "age = 1", "age = 2", "age > 2")]
    two, three = f"f.just_started - {gone[0]}", f"f.two_years_old - {gone[1]}"
    more = f"f.more_than_3_years_old + f.three_years_old - {gone[2]} - {gone[3]}"
    cols = ", ".join(["activite", "annee", *FEATURES])
    return (f", leavers as (select activite, finish_year, finish_year - start_year as age from contract_span s join (select contrat, "
            f"arg_min(activite, annee * 12 + mois) as activite from cd group by 1) c on c.contrat = s.contrat), "
            f"future as (select {cols} from hist where annee = (select max(annee) from hist) union all "
            f"select f.activite, f.annee + 1, cast({new} + {two} + {three} + {more} as bigint), cast({new} as bigint), "
            f"cast({two} as bigint), cast({three} as bigint), cast({more} as bigint){power} from future f where f.annee < {end_year})")


@query("contract_features_future_c11", f"activite:s annee:i {_COLS}",
       f"select * from (select {', '.join(['activite', 'annee', *FEATURES])} from hist) h union all select * from future where annee > "
       "(select max(annee) from hist)", "contracts", SPAN + ", " + features_sql("activite") + _future_sql(2005, 3), scale=2, recursive=True)
def _(t):
    return K.future_features(t.contracts, N.ACTIVITE, 2005, 3)


@query("contract_years_with_power_d01", "contrat:i activite:s start_year:i finish_year:i annee:i puissance_facturee:d",
       "select s.contrat, e.activite, start_year, finish_year, p.annee, p.pf as puissance_facturee from contract_span s join (select "
       "contrat, arg_min(activite, annee * 12 + mois) as activite from cd group by 1) e on e.contrat = s.contrat left join contract_power "
       "p on p.contrat = s.contrat and p.activite = e.activite", "contracts", SPAN)
def _(t):
    spans = K.contract_spans(t.contracts, first_of=[N.ACTIVITE])
    return spans.join(K.contract_power(t.contracts, N.ACTIVITE), [N.CONTRAT, N.ACTIVITE], "left")


@query("active_in_year_d02", "contrat:i annee:i", "select contrat, y as annee from contract_span cross join (select distinct annee as y "
       "from cd) ys where start_year <= y and y <= finish_year", "contracts", SPAN)
def _(t):
    years = t.contracts.agg(F.max(N.ANNEE).alias("last"))
    spans = K.contract_spans(t.contracts).crossJoin(F.broadcast(years))
    upto = F.least("finish_year", "last")
    return spans.filter(F.col("start_year") <= upto).select(N.CONTRAT, F.explode(F.sequence("start_year", upto)).alias(N.ANNEE))


@query("contract_class_f10", "contrat:i start_year:i classe_contrat:s",
       "select contrat, start_year, case when start_year <= 1997 then 'established' when start_year = 1998 then 'growth' when start_year = 1999 then "
       "'similarity' else 'later' end as classe_contrat from contract_span", "contracts", SPAN)
def _(t):
    return K.contract_class(K.contract_spans(t.contracts), 1999)


@query("use_before_start_d22", "contrat:i start_year:i consommation_kwh:d",
       "select s.contrat, start_year, sum(kwh) as consommation_kwh from contract_span s join contract_power p on p.contrat = s.contrat "
       "and p.annee < s.start_year group by 1, 2 having sum(kwh) <> 0", "contracts", K.span_sql(60000.0), scale=2)
def _(t):
    return K.use_before_start(t.contracts, K.contract_spans(t.contracts, threshold=60000.0))


_VEC = [(f"{a}{i}", c, i) for a, c in (("pf", "puissance_facturee"), ("pa", "puissance_appelee"), ("use", "consommation_kwh")) for i in N.MONTHS]
_FIRST = (" from (select c.*, row_number() over (partition by c.contrat order by mois) as k from contracts c join contract_span s on s.contrat = c.contrat and "
          "s.start_year = c.annee) x group by 1, 2")


@query("first_year_vectors_e23", "contrat:i annee:i " + " ".join(f"{n}:d" for n, _, _ in _VEC),
       "select contrat, annee, " + ", ".join(f"coalesce(max(case when k = {i} then {c} end), 0) as {n}" for n, c, i in _VEC) + _FIRST, "contracts", SPAN, scale=2)
def _(t):
    return K.first_year_vectors(t.contracts, K.contract_spans(t.contracts))


@query("first_year_ratios_e23", "contrat:i annee:i " + " ".join(f"ratio{i}:d" for i in N.MONTHS),
       "select contrat, annee, " + ", ".join(f"coalesce(max(case when k = {i} then puissance_appelee / puissance_facturee end), 0) as ratio{i}" for i in N.MONTHS)
       + _FIRST, "contracts", SPAN, scale=10)
def _(t):
    return K.first_year_vectors(t.contracts, K.contract_spans(t.contracts))
