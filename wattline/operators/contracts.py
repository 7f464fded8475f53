"""Contract life cycle: first and last year, age buckets per entity and year, history and future."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wattline import names as N
from wattline.functions import columns as C

NOT_STARTED_KWH = 20.0  # fixed value: a year at or below this use counts as not started
AGES = ("just_started", "two_years_old", "three_years_old", "more_than_3_years_old")


def contract_spans(df: DataFrame, threshold: float = NOT_STARTED_KWH, first_of=()) -> DataFrame:
    """(contrat, start_year, finish_year) and the first value of the ``first_of`` columns.

    Two small aggregates: to contract-years, then to contracts with the list of years above the threshold.
    The start is the move-in year, moved forward while the annual use stays at or below the threshold.
    """
    ym = C.month_key()

    def dated(c):
        return F.when(F.col(c).isNotNull(), F.struct(ym.alias("ym"), F.col(c).alias("v")))

    yearly = df.groupBy(N.CONTRAT, N.ANNEE).agg(
        F.sum(N.CONSO).alias("use"), F.min(dated(N.DATE_IN)).alias("first_in"), F.max(dated(N.DATE_OUT)).alias("last_out"),
        *[F.min(F.struct(ym.alias("ym"), F.col(c).alias("v"))).alias(f"_f_{c}") for c in first_of])
    per = yearly.groupBy(N.CONTRAT).agg(
        F.min(N.ANNEE).alias("min_year"), F.max(N.ANNEE).alias("max_year"),
        F.min("first_in").alias("first_in"), F.max("last_out").alias("last_out"),
        F.collect_list(F.when(F.col("use") > threshold, F.col(N.ANNEE))).alias("busy"),
        *[F.min(f"_f_{c}").alias(f"_f_{c}") for c in first_of])
    per = per.withColumn("m0", F.coalesce(F.year(C.parse_date(F.col("first_in.v"))).cast("bigint"), F.col("min_year")))
    per = per.withColumn("finish_year", F.coalesce(F.year(C.parse_date(F.col("last_out.v"))).cast("bigint"), F.lit(N.NEVER)))
    nxt = F.col("m0") + 1
    walked = F.least(F.greatest(nxt, F.col("max_year")), F.greatest(nxt, F.col("finish_year")),
                     F.array_min(F.filter("busy", lambda y: y > F.col("m0"))))
    start = F.when(F.array_contains("busy", F.col("m0")) | (F.col("m0") >= F.col("finish_year")), F.col("m0")).otherwise(walked)
    return per.select(N.CONTRAT, start.alias("start_year"), "finish_year", *[F.col(f"_f_{c}.v").alias(c) for c in first_of])


def contract_power(df: DataFrame, entity: str) -> DataFrame:
    """Billed and called power per contract-year with the year's first entity."""
    first = F.min(F.struct(C.month_key().alias("ym"), F.col(entity).alias("v")))
    return (df.groupBy(N.CONTRAT, N.ANNEE).agg(F.sum(N.PF).alias(N.PF), F.sum(N.PA).alias(N.PA), first.alias("_e"))
            .select(N.CONTRAT, N.ANNEE, N.PF, N.PA, F.col("_e.v").alias(entity)))


def entity_year_grid(df: DataFrame, entity: str) -> DataFrame:
    """Every entity with every year of the data; the years travel as one array on one row."""
    years = df.agg(F.collect_set(N.ANNEE).alias("_years"))
    return df.select(entity).distinct().crossJoin(F.broadcast(years)).select(entity, F.explode("_years").alias(N.ANNEE))


def _buckets():
    age = F.col(N.ANNEE) - F.col("start_year")
    return dict(zip(AGES, (age == 0, age == 1, age == 2, age > 2)))


def contract_features(df: DataFrame, entity: str, spans: DataFrame | None = None) -> DataFrame:
    """Active contracts, age buckets and power sums for every entity and year."""
    spans = contract_spans(df, first_of=[entity]) if spans is None else spans
    active = spans.join(contract_power(df, entity), [N.CONTRAT, entity]).filter(
        (F.col("start_year") <= F.col(N.ANNEE)) & (F.col("finish_year") >= F.col(N.ANNEE)))
    aggs = [F.count(F.lit(1)).alias("total_active_contrats")]
    aggs += [F.count_if(cond).alias(name) for name, cond in _buckets().items()]
    for p in (N.PF, N.PA):
        aggs.append(F.sum(p).alias(f"{p}_total"))
        aggs += [F.sum(F.when(cond, F.col(p)).otherwise(F.lit(0.0))).alias(f"{p}_{name}") for name, cond in _buckets().items()]
    got = active.groupBy(entity, N.ANNEE).agg(*aggs)
    return entity_year_grid(df, entity).join(got, [entity, N.ANNEE], "left").na.fill(0)


def future_features(df: DataFrame, entity: str, end_year: int, new_per_year: int = 0) -> DataFrame:
    """History plus the years after it: buckets age by one, contracts that finished leave the counts.

    One fold per entity over the future years; power shifts with age and is not reduced by leavers.
    """
    spans = contract_spans(df, first_of=[entity])
    history = contract_features(df, entity, spans)
    age = F.col("finish_year") - F.col("start_year")
    leavers = (spans.filter(F.col("finish_year") < end_year).groupBy(entity, "finish_year").agg(
        F.count_if(age == 0).alias("f0"), F.count_if(age == 1).alias("f1"), F.count_if(age == 2).alias("f2"),
        F.count_if(age > 2).alias("f3"))
        .groupBy(entity).agg(F.map_from_entries(F.collect_list(F.struct("finish_year", F.struct("f0", "f1", "f2", "f3")))).alias("_fin")))
    measures = [c for c in history.columns if c not in (entity, N.ANNEE)]
    last = history.groupBy(entity).agg(F.max(F.struct(N.ANNEE, *measures)).alias("_last")).join(leavers, entity, "left")

    def step(states, year):
        prev = F.element_at(states, -1)
        fin = F.when(F.col("_fin").isNotNull(), F.element_at(F.col("_fin"), year - 1))

        def gone(i):
            return F.coalesce(fin[f"f{i}"], F.lit(0).cast("bigint"))

        just = F.lit(new_per_year).cast("bigint")
        two = prev[AGES[0]] - gone(0)
        three = prev[AGES[1]] - gone(1)
        more = prev[AGES[3]] + prev[AGES[2]] - gone(2) - gone(3)
        values = {N.ANNEE: year, AGES[0]: just, AGES[1]: two, AGES[2]: three, AGES[3]: more,
                  "total_active_contrats": just + two + three + more}
        for p in (N.PF, N.PA):
            aged = prev[f"{p}_{AGES[3]}"] + prev[f"{p}_{AGES[2]}"]
            values[f"{p}_{AGES[0]}"] = F.lit(0.0)
            values[f"{p}_{AGES[1]}"] = prev[f"{p}_{AGES[0]}"]
            values[f"{p}_{AGES[2]}"] = prev[f"{p}_{AGES[1]}"]
            values[f"{p}_{AGES[3]}"] = aged
            values[f"{p}_total"] = prev[f"{p}_{AGES[0]}"] + prev[f"{p}_{AGES[1]}"] + aged
        return F.concat(states, F.array(F.struct(*[values[c].alias(c) for c in [N.ANNEE, *measures]])))

    types = dict(history.dtypes)
    state_type = "array<struct<" + ",".join(f"{c}:{types[c]}" for c in [N.ANNEE, *measures]) + ">>"
    years = F.filter(F.sequence(F.col(f"_last.{N.ANNEE}"), F.greatest(F.lit(end_year).cast("bigint"), F.col(f"_last.{N.ANNEE}"))),
                     lambda y: y > F.col(f"_last.{N.ANNEE}"))
    states = F.aggregate(years, F.array(F.col("_last")).cast(state_type), lambda s, y: step(s, y).cast(state_type))
    future = (last.select(entity, F.explode(states).alias("x")).select(entity, "x.*")
              .join(history.agg(F.max(N.ANNEE).alias("_max")), F.col(N.ANNEE) > F.col("_max")).drop("_max"))
    return history.unionByName(future.select(*history.columns))


def use_per_contract(yearly_use: DataFrame, features: DataFrame, keys) -> DataFrame:
    """Use per active contract and per unit of billed power."""
    f = features.select(*keys, N.ANNEE, "total_active_contrats", f"{N.PF}_total")
    joined = yearly_use.join(f, [*keys, N.ANNEE], "left")
    absent = F.col("total_active_contrats") == 0
    return (joined
            .withColumn("total_active_contrats", F.when(~absent, F.col("total_active_contrats")))
            .withColumn(f"{N.PF}_total", F.when(~absent, F.col(f"{N.PF}_total")))
            .withColumn("per_contract", F.try_divide(F.col(N.CONSO), F.col("total_active_contrats")))
            .withColumn("intensity", F.try_divide(F.col(N.CONSO), F.col(f"{N.PF}_total"))))


def widen_dates(df: DataFrame, merged: DataFrame) -> DataFrame:
    """Earliest move-in and latest move-out for the merged contracts; other rows keep theirs."""
    ranges = df.join(merged, N.CONTRAT, "left_semi").groupBy(N.CONTRAT).agg(
        F.struct(F.min(N.DATE_IN).alias("a"), F.max(N.DATE_OUT).alias("b")).alias("_r"))
    out = df.join(ranges, N.CONTRAT, "left")
    hit = F.col("_r").isNotNull()
    return (out.withColumn(N.DATE_IN, F.when(hit, F.col("_r.a")).otherwise(F.col(N.DATE_IN)))
            .withColumn(N.DATE_OUT, F.when(hit, F.col("_r.b")).otherwise(F.col(N.DATE_OUT))).select(*df.columns))


def contract_class(spans: DataFrame, year: int) -> DataFrame:
    """Forecast route of a contract: established, growing or new in ``year``; one that starts later has none yet."""
    s = F.col("start_year")
    return spans.withColumn("classe_contrat", F.when(s <= year - 2, "established").when(s == year - 1, "growth").when(s == year, "similarity").otherwise("later"))


def use_before_start(df: DataFrame, spans: DataFrame) -> DataFrame:
    """Contracts with use before their start year."""
    yearly = df.groupBy(N.CONTRAT, N.ANNEE).agg(F.sum(N.CONSO).alias(N.CONSO))
    return (yearly.join(spans.select(N.CONTRAT, "start_year"), N.CONTRAT).filter(F.col(N.ANNEE) < F.col("start_year"))
            .groupBy(N.CONTRAT, "start_year").agg(F.sum(N.CONSO).alias(N.CONSO)).filter(F.col(N.CONSO) != 0))


def first_year_vectors(df: DataFrame, spans: DataFrame) -> DataFrame:
    """Twelve slots of a contract's first year, filled by position and zero-padded at the end."""
    from pyspark.sql import Window as W

    first = df.join(spans.select(N.CONTRAT, F.col("start_year").alias(N.ANNEE)), [N.CONTRAT, N.ANNEE])
    slot = F.row_number().over(W.partitionBy(N.CONTRAT).orderBy(N.MOIS))
    cells = first.withColumn("_slot", slot).groupBy(N.CONTRAT, N.ANNEE)
    ratio = F.when(F.col(N.PF) > 0, F.col(N.PA) / F.nullif(F.col(N.PF), F.lit(0.0))).otherwise(F.lit(0.0))

    def at(i, value):
        return F.coalesce(F.max(F.when(F.col("_slot") == i, value)), F.lit(0.0))

    return cells.agg(*[at(i, F.col(N.PF)).alias(f"pf{i}") for i in N.MONTHS],
                     *[at(i, F.col(N.PA)).alias(f"pa{i}") for i in N.MONTHS],
                     *[at(i, ratio).alias(f"ratio{i}") for i in N.MONTHS],
                     *[at(i, F.col(N.CONSO)).alias(f"use{i}") for i in N.MONTHS])


# SQL of the spans, for the oracles.
_DATE = ("coalesce(try_strptime(trim({0}), '%Y-%m-%d'), try_strptime(trim({0}), '%d.%m.%Y'), try_strptime(trim({0}), "
         "'%d/%m/%Y'), try_strptime(trim({0}), '%Y/%m/%d'), try_strptime(trim({0}), '%Y-%m-%d %H:%M:%S'))")


def span_sql(threshold: float = NOT_STARTED_KWH) -> str:
    """CTEs contract_power and contract_span over ``contracts``."""
    return f"""
contract_power as (select contrat, annee, arg_min(activite, mois) as activite, arg_min(region, mois) as region,
  sum(puissance_facturee) as pf, sum(puissance_appelee) as pa, sum(consommation_kwh) as kwh from contracts group by 1, 2),
contract_raw as (select contrat, min(annee) as min_year, max(annee) as max_year,
  {_DATE.format("(arg_min(date_emmenagement, annee * 12 + mois) filter (where date_emmenagement is not null))")} as d_in,
  {_DATE.format("(arg_max(date_demenagement, annee * 12 + mois) filter (where date_demenagement is not null))")} as d_out
  from contracts group by 1),
contract_m0 as (select contrat, max_year, coalesce(year(d_in), min_year) as m0, coalesce(year(d_out), 9999) as finish_year
  from contract_raw),
contract_span as (select m.contrat, finish_year, case when coalesce((select p.kwh from contract_power p where p.contrat =
  m.contrat and p.annee = m.m0), 0) > {threshold} or m0 >= finish_year then m0 else least(greatest(m0 + 1, max_year),
  greatest(m0 + 1, finish_year), coalesce((select min(p.annee) from contract_power p where p.contrat = m.contrat and p.annee >
  m.m0 and p.kwh > {threshold}), 99999)) end as start_year from contract_m0 m)"""


SPAN_SQL = span_sql()
