"""SQL text of the electricity tables: the oracle side of every check starts from these rows."""

VIEWS = {}

VIEWS["cd"] = """
select r_name as region, n_name as partenaire, c_custkey as contrat, c_mktsegment as activite,
  cast(year(o_orderdate) as bigint) as annee, cast(month(o_orderdate) as bigint) as mois,
  sum(l_extendedprice) as consommation_kwh,
  sum(case when l_returnflag = 'A' then l_extendedprice else 0 end) as consommation_zconhc,
  sum(case when l_returnflag = 'N' then l_extendedprice else 0 end) as consommation_zconhl,
  sum(case when l_returnflag = 'R' then l_extendedprice else 0 end) as consommation_zconhp,
  sum(l_quantity) as puissance_facturee, sum(l_quantity * (1 - l_discount)) as puissance_appelee,
  case when c_custkey % 7 = 0 then null when c_custkey % 2 = 0 then 'HT' else 'THT' end as niveau_tension
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
  join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
group by 1, 2, 3, 4, 5, 6, 13
"""

VIEWS["grd"] = """
select cast(year(o_orderdate) as bigint) as annee, cast(month(o_orderdate) as bigint) as mois,
  c_mktsegment as activite, case when c_custkey % 4 = 0 then n_name else 'SRM' end as grd,
  case when o_orderstatus = 'F' then 'MT' else 'BT' end as classe, r_name as region,
  sum(o_totalprice) as consommation_kwh, count(distinct c_custkey) as nbr_clients
from orders join customer on o_custkey = c_custkey
  join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
group by 1, 2, 3, 4, 5, 6
union all
select cast(year(o_orderdate) as bigint), cast(month(o_orderdate) as bigint), null, 'SRM', 'Total', r_name,
  sum(o_totalprice), count(distinct c_custkey)
from orders join customer on o_custkey = c_custkey
  join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
where c_custkey % 4 <> 0 group by 1, 2, 6
"""

VIEWS["exogenous"] = """
select r_name as region, cast(year(l_shipdate) as bigint) as annee,
  sum(l_extendedprice) / 1e6 as pib_mdh,
  sum(case when l_linestatus = 'F' then l_extendedprice else 0 end) / 1e6 as gdp_primaire,
  sum(case when l_linestatus = 'O' and l_returnflag = 'A' then l_extendedprice else 0 end) / 1e6 as gdp_secondaire,
  sum(case when l_linestatus = 'O' and l_returnflag <> 'A' then l_extendedprice else 0 end) / 1e6 as gdp_tertiaire
from lineitem join supplier on l_suppkey = s_suppkey
  join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
group by 1, 2
"""

VIEWS["weather"] = """
select r_name as region, cast(l_shipdate as date) as date_jour,
  cast(year(l_shipdate) as bigint) as annee, cast(month(l_shipdate) as bigint) as mois,
  min(l_quantity) - 5 as apparent_temperature_min, avg(l_quantity) as apparent_temperature_mean,
  max(l_quantity) as apparent_temperature_max, sum(l_tax) as precipitation_sum,
  sum(l_discount) as et0_fao_evapotranspiration_sum
from lineitem join supplier on l_suppkey = s_suppkey
  join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
group by 1, 2, 3, 4
"""

VIEWS["contract_dates"] = """
select c_custkey as contrat,
  case when c_custkey % 11 = 0 then null
       when c_custkey % 3 = 0 then concat(lpad(cast(day(d0) as varchar(2)), 2, '0'), '/', lpad(cast(month(d0) as varchar(2)), 2, '0'), '/', cast(year(d0) as varchar(4)))
       when c_custkey % 3 = 1 then concat(cast(year(d0) as varchar(4)), '-', lpad(cast(month(d0) as varchar(2)), 2, '0'), '-', lpad(cast(day(d0) as varchar(2)), 2, '0'))
       else 'a verifier' end as date_emmenagement,
  case when c_custkey % 5 = 0 then concat(cast(year(d1) as varchar(4)), '-', lpad(cast(month(d1) as varchar(2)), 2, '0'), '-', lpad(cast(day(d1) as varchar(2)), 2, '0'), ' 00:00:00')
       when c_custkey % 5 = 1 then '9999-12-31 00:00:00' else null end as date_demenagement
from (select c_custkey, min(o_orderdate) as d0, max(o_orderdate) as d1
      from customer join orders on o_custkey = c_custkey group by c_custkey) t
"""

VIEWS["ev"] = """
select region, annee, cast(1000 * (annee - 1993) * (annee - 1993) as double) as ev from
  (select distinct r_name as region, cast(year(o_orderdate) as bigint) as annee from orders cross join region) t
"""

VIEWS["weather_diff"] = """
select r_name as region, y as annee, cast(0.5 * (y - 2000) as double) as temp_min_diff,
  cast(-1.0 * (y - 2000) as double) as precipitation_sum_diff, cast(2.0 * (y - 2000) as double) as et0_diff
from region cross join (select distinct cast(year(o_orderdate) as bigint) as y from orders where year(o_orderdate) >= 2000) t
"""

VIEWS["contracts"] = """
select cd.*, date_emmenagement, date_demenagement
from cd left join contract_dates on cd.contrat = contract_dates.contrat
"""

# The last year with orders in all twelve months, and the contract-months up to it.
VIEWS["ly"] = """
select max(y) as y from (select year(o_orderdate) as y from orders group by 1 having count(distinct month(o_orderdate)) = 12) t
"""

VIEWS["cw"] = """
select * from cd where annee <= (select y from ly)
"""

_NEEDS = {"contracts": ["cd", "contract_dates"], "cw": ["cd", "ly"]}


def with_views(*names: str) -> str:
    """``with a as (...), b as (...)`` for the named views and those they build on."""
    ordered: list[str] = []
    for name in names:
        for n in [*_NEEDS.get(name, []), name]:
            if n not in ordered:
                ordered.append(n)
    return ", ".join(f"{n} as ({VIEWS[n].strip()})" for n in ordered)
