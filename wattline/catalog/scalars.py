"""Queries over projections, filters and scalar functions."""

from pyspark.sql import functions as F

from wattline import names as N
from wattline.catalog.registry import query
from wattline.functions import columns as C
from wattline.operators import cleaning as K
from wattline.sources import sheets as S

_PARSED = ("coalesce(try_strptime(trim({0}), '%Y-%m-%d'), try_strptime(trim({0}), '%d.%m.%Y'), "
           "try_strptime(trim({0}), '%d/%m/%Y'), try_strptime(trim({0}), '%Y/%m/%d'), "
           "try_strptime(trim({0}), '%Y-%m-%d %H:%M:%S'), try_strptime(trim({0}), '%d-%m-%Y'), "
           "try_strptime(trim({0}), '%m/%d/%Y'), try_strptime(trim({0}), '%d %b %Y'), try_strptime(trim({0}), '%d %B %Y'))")


def parsed(column: str) -> str:
    return _PARSED.format(column)


@query("unit_conversion_b01", "contrat:i annee:i mois:i mwh:d gwh:d kwh:d",
       "select contrat, annee, mois, consommation_kwh / 1000 as mwh, consommation_kwh / 1e6 as gwh, "
       "consommation_kwh * 1000 as kwh from cd", "cd", scale=5)
def _(t):
    x = F.col(N.CONSO)
    return t.cd.select(N.CONTRAT, N.ANNEE, N.MOIS, (x / 1000).alias("mwh"), (x / 1e6).alias("gwh"), (x * 1000).alias("kwh"))


@query("value_mapping_b02", "contrat:i city:s region:s",
       "select c_custkey as contrat, n_name as city, r_name as region from customer join nation on c_nationkey = "
       "n_nationkey join region on n_regionkey = r_regionkey")
def _(t):
    sites = t.raw("customer").join(t.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias(N.CONTRAT), F.col("n_name").alias("city"))
    return S.map_values(sites, "city", t.places, "nation", N.REGION, N.REGION)


@query("last_token_b03", "contrat:i city:s",
       "select c_custkey as contrat, regexp_extract(trim(string_split(s, ':')[-1]), '(\\S+)$', 1) as city from (select "
       "c_custkey, 'DR ' || c_mktsegment || ' : AS ' || n_name as s from customer join nation on c_nationkey = n_nationkey) x")
def _(t):
    label = F.concat(F.lit("DR "), F.col(N.ACTIVITE), F.lit(" : AS "), F.col("nation"))
    return t.customers.select(N.CONTRAT, C.last_token_after_colon(label).alias("city"))


@query("text_cleaning_b04", "contrat:i header:s safe:s",
       "select c_custkey as contrat, replace(lower(trim(s)), ' ', '_') as header, translate(s, ':/\\ ', '____') as safe "
       "from (select c_custkey, ' ' || c_name || ': ' || n_name || '/\\x ' as s from customer join nation on "
       "c_nationkey = n_nationkey) x")
def _(t):
    sites = t.raw("customer").join(t.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    s = F.concat(F.lit(" "), F.col("c_name"), F.lit(": "), F.col("n_name"), F.lit("/\\x "))
    return sites.select(F.col("c_custkey").alias(N.CONTRAT), C.clean_header(s).alias("header"), C.clean_name(s).alias("safe"))


@query("metric_key_split_b05", "contrat:i metric:s mois:i annee:i",
       "select contrat, 'Pf' as metric, mois, annee from cd", "cd")
def _(t):
    key = F.concat(F.lit("Pf __"), C.month_label())
    metric, month, year = C.metric_key_parts(key)
    return t.cd.select(N.CONTRAT, metric.alias("metric"), month.alias("mois"), year.alias("annee"))


@query("month_label_split_b06", "contrat:i mois:i annee:i", "select contrat, mois, annee from cd", "cd")
def _(t):
    label = C.month_label()
    return t.cd.select(N.CONTRAT, C.label_month(label).alias("mois"), C.label_year(label).alias("annee"))


@query("month_label_padding_b07", "contrat:i label:s",
       "select contrat, lpad(cast(mois as varchar), 2, '0') || '.' || cast(annee as varchar) as label from cd", "cd")
def _(t):
    raw = F.concat_ws(".", F.col(N.MOIS).cast("string"), F.col(N.ANNEE).cast("string"))
    return t.cd.select(N.CONTRAT, C.pad_month_label(raw).alias("label"))


@query("prefix_filter_b08", "contrat:i label:s",
       "select c_custkey as contrat, n_name as label from customer join nation on c_nationkey = n_nationkey where "
       "n_name not like 'U%' and c_mktsegment <> 'MACHINERY'")
def _(t):
    return t.customers.filter(~F.col("nation").startswith("U") & (F.col(N.ACTIVITE) != "MACHINERY")).select(
        N.CONTRAT, F.col("nation").alias("label"))


@query("numeric_coercion_b09", "contrat:i value:d",
       "select contrat, coalesce(try_cast(case when contrat % 5 = 0 then 'n/a' when contrat % 7 = 0 then null "
       "else cast(round(puissance_facturee, 2) as varchar) end as double), 0) as value from cd", "cd")
def _(t):
    c = F.col(N.CONTRAT)
    text = F.when(c % 5 == 0, "n/a").when(c % 7 == 0, F.lit(None).cast("string")).otherwise(
        F.round(N.PF, 2).cast("string"))
    return t.cd.select(N.CONTRAT, C.to_number(text).alias("value"))


@query("safe_date_parse_b10", "contrat:i date_in:t date_out:t date_us:t date_month:t",
       f"select contrat, {parsed('date_emmenagement')} as date_in, {parsed('date_demenagement')} as date_out, "
       f"{parsed('us')} as date_us, {parsed('named')} as date_month from (select c.*, "
       "strftime(d, '%m/%d/%Y') as us, strftime(d, '%d %b %Y') as named from contract_dates c join "
       "(select o_custkey, min(o_orderdate) as d from orders group by 1) o on o_custkey = contrat) x", "contract_dates")
def _(t):
    first = t.raw("orders").groupBy(F.col("o_custkey").alias(N.CONTRAT)).agg(F.min("o_orderdate").alias("d"))
    return t.contract_dates.join(first, N.CONTRAT).select(
        N.CONTRAT, C.parse_date(F.col(N.DATE_IN)).alias("date_in"), C.parse_date(F.col(N.DATE_OUT)).alias("date_out"),
        C.parse_date(F.date_format("d", "MM/dd/yyyy")).alias("date_us"),
        C.parse_date(F.date_format("d", "dd MMM yyyy")).alias("date_month"))


@query("entity_name_parse_b11", "entity:s contrat:s activite:s",
       "select 'Contrat_' || c_custkey as entity, c_custkey as contrat, null as activite from customer union all "
       "select distinct 'Activity_' || c_mktsegment, null, c_mktsegment from customer")
def _(t):
    c = t.raw("customer")
    names = c.select(F.concat(F.lit("Contrat_"), F.col("c_custkey")).alias("entity")).unionByName(
        c.select(F.concat(F.lit("Activity_"), F.col("c_mktsegment")).alias("entity")).distinct())
    e = F.col("entity")
    return names.select("entity", C.entity_part(e, "Contrat").cast("bigint").alias("contrat"),
                        C.entity_part(e, "Activity").alias("activite"))


@query("dimension_filters_b12", "contrat:i annee:i mois:i consommation_kwh:d",
       "select contrat, annee, mois, consommation_kwh from cd where annee between 1997 and 1999 and region = 'ASIA' "
       "and activite in ('BUILDING', 'MACHINERY')", "cd", scale=2)
def _(t):
    return t.cd.filter(F.col(N.ANNEE).between(1997, 1999) & (F.col(N.REGION) == "ASIA")
                       & F.col(N.ACTIVITE).isin("BUILDING", "MACHINERY"))


@query("drop_year_b13", "region:s annee:i pib_mdh:d",
       "select region, annee, pib_mdh from exogenous where annee <> 2000", "exogenous")
def _(t):
    return t.exogenous.filter(F.col(N.ANNEE) != 2000)


@query("drop_negative_rows_b14", "region:s date_jour:t apparent_temperature_min:d",
       "select * from weather where apparent_temperature_min >= 0 and precipitation_sum >= 0", "weather")
def _(t):
    return C.drop_non_positive(t.weather, ["apparent_temperature_min", "precipitation_sum", "absent"])


@query("month_keys_b15", "contrat:i annee:i mois:i ym:i debut:t label:s",
       "select contrat, annee, mois, annee * 12 + mois as ym, make_date(annee, mois, 1) as debut, "
       "lpad(cast(mois as varchar), 2, '0') || '.' || cast(annee as varchar) as label from cd", "cd")
def _(t):
    return t.cd.select(N.CONTRAT, N.ANNEE, N.MOIS, C.month_key().alias("ym"), C.month_start().alias("debut"),
                       C.month_label().alias("label"))


@query("guarded_arithmetic_b16", "contrat:i annee:i mois:i clipped:d err:d ratio:d",
       "select contrat, annee, mois, case when consommation_zconhl <> 0 then greatest(-200, least(200, (consommation_zconhc "
       "- consommation_zconhl) / consommation_zconhl * 100)) end as clipped, (consommation_zconhc - consommation_zconhp) / "
       "nullif(consommation_zconhp, 0) * 100 as err, puissance_appelee / nullif(consommation_zconhp, 0) as ratio from cd",
       "cd")
def _(t):
    hc, hl, hp = (F.col(c) for c in N.BANDS)
    # a division that yields +-inf for a zero divisor, as floating point does outside ANSI SQL
    ratio = F.when(hp == 0, F.lit(float("inf"))).otherwise(F.col(N.PA) / F.nullif(hp, F.lit(0.0)))
    return t.cd.select(N.CONTRAT, N.ANNEE, N.MOIS, C.clip(C.percent_error(hc, hl), -200, 200).alias("clipped"),
                       C.percent_error(hc, hp).alias("err"), C.finite_or_null(ratio).alias("ratio"))


@query("negative_safety_net_b17", "region:s activite:s annee:i mois:i consommation:d",
       "select p.region, p.activite, p.annee, p.mois, case when p.v >= 0 then p.v when r.v >= 0 then r.v else 0 end as "
       "consommation from (select region, activite, annee + 1 as annee, mois, v - 2 * (select avg(v) from s) as v from s) p "
       "left join s r on r.region = p.region and r.activite = p.activite and r.annee = p.annee - 1 and r.mois = p.mois",
       "cd", ctes="s as (select region, activite, annee, mois, sum(consommation_zconhp) as v from cd group by 1, 2, 3, 4)",
       scale=2)
def _(t):
    s = t.cd.groupBy(N.REGION, N.ACTIVITE, N.ANNEE, N.MOIS).agg(F.sum(N.ZCONHP).alias("v"))
    mean = s.agg(F.avg("v").alias("mean_v"))
    pred = s.crossJoin(mean).select(N.REGION, N.ACTIVITE, (F.col(N.ANNEE) + 1).alias(N.ANNEE), N.MOIS,
                                    (F.col("v") - 2 * F.col("mean_v")).alias("consommation"))
    return K.non_negative_forecast(pred, s.withColumnRenamed("v", "consommation"), [N.REGION, N.ACTIVITE], "consommation")


@query("forward_fill_b18", "row_id:i label:s value:d",
       "select row_id, last_value(l ignore nulls) over (order by row_id rows between unbounded preceding and current row) "
       "as label, value from (select o_orderkey as row_id, case when o_orderkey % 97 = 0 then o_orderpriority end as l, "
       "o_totalprice as value from orders) x")
def _(t):
    sheet = t.raw("orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.when(F.col("o_orderkey") % 97 == 0, F.col("o_orderpriority")).alias("label"), F.col("o_totalprice").alias("value"))
    return S.forward_fill(sheet, "row_id", ["label"], block_rows=1000)


def merged_contracts(t):
    """Old (partenaire, contrat) pairs and the pairs that replace them; every 50th contract moved, plus unknown keys."""
    c = t.customers
    moved = c.filter(F.col(N.CONTRAT) % 50 == 3).select(
        F.col("nation").alias("old_partenaire"), F.col(N.CONTRAT).alias("old_contrat"),
        F.concat(F.col("nation"), F.lit(" II")).alias("new_partenaire"), (F.col(N.CONTRAT) + 1).alias("new_contrat"))
    unknown = c.filter(F.col(N.CONTRAT) % 100 == 7).select(
        F.concat(F.lit("X "), F.col("nation")).alias("old_partenaire"), F.col(N.CONTRAT).alias("old_contrat"),
        F.col("nation").alias("new_partenaire"), F.col(N.CONTRAT).alias("new_contrat"))
    return moved.unionByName(unknown)


_MERGED = ("mp as (select n_name as old_partenaire, c_custkey as old_contrat, n_name || ' II' as new_partenaire, "
           "c_custkey + 1 as new_contrat from customer join nation on c_nationkey = n_nationkey where c_custkey % 50 = 3 "
           "union all select 'X ' || n_name, c_custkey, n_name, c_custkey from customer join nation on "
           "c_nationkey = n_nationkey where c_custkey % 100 = 7)")


@query("contract_remap_b19", "partenaire:s contrat:i annee:i mois:i consommation_kwh:d",
       "select coalesce(new_partenaire, partenaire) as partenaire, coalesce(new_contrat, contrat) as contrat, annee, mois, "
       "consommation_kwh from cd left join mp on partenaire = old_partenaire and contrat = old_contrat",
       "cd", _MERGED, scale=2)
def _(t):
    return K.remap_contracts(t.cd, merged_contracts(t))


@query("contract_remap_unmatched_b19", "old_partenaire:s old_contrat:i",
       "select old_partenaire, old_contrat from mp where not exists (select 1 from cd where partenaire = old_partenaire "
       "and contrat = old_contrat)", "cd", _MERGED)
def _(t):
    return K.unmatched_mappings(t.cd, merged_contracts(t))


@query("copy_attributes_b20", "contrat:i annee:i mois:i date_emmenagement:s date_demenagement:s",
       "select c.contrat, annee, mois, case when s.contrat is not null then s.date_emmenagement else c.date_emmenagement "
       "end as date_emmenagement, case when s.contrat is not null then s.date_demenagement else c.date_demenagement end "
       "as date_demenagement from contracts c left join contract_dates s on c.contrat % 50 = 3 and s.contrat = c.contrat + 1",
       "contracts")
def _(t):
    pairs = t.customers.filter(F.col(N.CONTRAT) % 50 == 3).select(
        F.col(N.CONTRAT).alias("target"), (F.col(N.CONTRAT) + 1).alias("source"))
    return K.copy_attributes(t.contracts, t.contract_dates, pairs, [N.DATE_IN, N.DATE_OUT])


@query("use_per_client_b21", "region:s activite:s annee:i mois:i cons_moy_kwh:d",
       "select region, activite, annee, mois, (consommation_kwh / 1000) * 1000 / nullif(nbr_clients, 0) as cons_moy_kwh "
       "from grd where grd = 'SRM' and region = 'EUROPE'", "grd", scale=7)
def _(t):
    rows = t.grd.filter((F.col(N.GRD) == N.SRM) & (F.col(N.REGION) == "EUROPE"))
    return rows.withColumn("cons_moy_kwh", F.try_divide((F.col(N.CONSO) / 1000) * 1000, F.col(N.CLIENTS)))


@query("move_in_profile_b22", "n_rows:i n_dates:i first_date:t last_date:t n_1996:i",
       f"select count(*) as n_rows, count(d) as n_dates, min(d) as first_date, max(d) as last_date, count(case when "
       f"year(d) = 1996 then 1 end) as n_1996 from (select {parsed('date_emmenagement')} as d from contract_dates) x",
       "contract_dates")
def _(t):
    return K.move_in_profile(t.contract_dates, 1996)


@query("holdout_split_b23", "region:s annee:i last_two:s last_year:s before_cut:s",
       "select region, annee, case when row_number() over (partition by region order by annee desc) <= 2 then 'test' else "
       "'train' end as last_two, case when annee = max(annee) over (partition by region) then 'test' else 'train' end as "
       "last_year, case when annee < 1999 then 'train' else 'test' end as before_cut from exogenous", "exogenous")
def _(t):
    return K.holdout_split(t.exogenous, [N.REGION], periods=2, cut=1999)
