"""The contract run: every live contract has its year, billed power reaches the forecast year, scratch tables go."""

import os

import pytest
from pyspark.sql import functions as F

from wattline import names as N
from wattline.models import short_term as ST
from wattline.operators import contracts as K, neighbours as B, rules as R
from wattline.plans import pipelines as P
from wattline.session import materialize, scratch_run, shared_dir
from wattline.sources.fixtures import Tables

SF = "/root/testdata/sf0.001"
SMALL = {**ST.CONTRACT_GRID, "blocks": {"none": []}, "lambdas": [0.3], "pc_weights": [0.5], "windows": [3], "use_pf": [True]}


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, SF)


def test_every_live_contract_has_twelve_months_or_a_reason(spark, tables):
    got = P.short_term_contracts(tables.contracts, tables.exogenous, 2001, SMALL).cache()
    spans = K.contract_class(K.contract_spans(tables.contracts), 2001).filter("finish_year >= 2001")
    months = {r[0]: r[1] for r in got.groupBy(N.CONTRAT).agg(F.countDistinct(N.MOIS)).collect()}
    assert set(months) == {r.contrat for r in spans.collect()} and set(months.values()) == {12}
    assert got.count() == 12 * len(months)
    reasons = got.join(spans.select(N.CONTRAT, "classe_contrat"), N.CONTRAT)
    assert reasons.filter("motif is not null and consommation <> 0").count() == 0
    assert reasons.filter("classe_contrat = 'later' and motif <> 'starts_later'").count() == 0
    data = tables.contracts.filter("annee = 2000").select(N.CONTRAT).distinct()
    silent = reasons.filter("classe_contrat = 'established'").join(data, N.CONTRAT, "left_anti")
    assert silent.filter("motif is null or motif <> 'no_recent_data'").count() == 0


def test_shapes_come_from_neighbours_of_any_id(spark):
    near = spark.createDataFrame([(7, 1, 7), (7, 2, 9), (7, 3, 4), (8, 1, 5)], "contrat long, rang int, voisin long").withColumn("distance", F.lit(0.0))
    forecasts = spark.createDataFrame([(c, 1998, m, float(m if c == 9 else 13 - m)) for c in (4, 9) for m in range(1, 13)],
                                      "contrat long, annee long, mois long, prediction double")
    got = {(r.contrat, r.mois): r.part for r in B.neighbour_shapes(near, forecasts, 1998).collect()}
    assert set(got) == {(7, m) for m in range(1, 13)}
    assert all(abs(got[7, m] - (2 / 3 * m + 1 / 3 * (13 - m)) / 78) < 1e-12 for m in range(1, 13))


def test_young_contracts_take_the_forests_first(spark, tables, monkeypatch):
    spans = K.contract_class(K.contract_spans(tables.contracts).filter("finish_year >= 1998"), 1998)
    new, growing = ([r.contrat for r in spans.filter(f"classe_contrat = '{c}'").orderBy("contrat").collect()] for c in ("similarity", "growth"))
    asked = {}

    def forecast(ids, value):
        rows = [(c, 1998, m, value) for c in ids for m in range(1, 13)]
        return spark.createDataFrame(rows, "contrat long, annee long, mois long, consommation double")

    def growing_forecast(contracts, spans, shapes, year, **options):
        asked.update(options, shapes={r.contrat for r in shapes.collect()})
        return forecast(growing, 321.0)

    monkeypatch.setattr(P.forest, "growing_contract_forecast", growing_forecast)
    monkeypatch.setattr(P.forest, "new_contract_forecast", lambda *_, **options: forecast(new[:1], 123.0))
    got = P.short_term_contracts(tables.contracts, tables.exogenous, 1998, SMALL, forests={"min_start": 1995})
    use = {(r.contrat, r.mois): r.consommation for r in got.filter(F.col(N.CONTRAT).isin(new + growing)).collect()}
    assert asked["min_start"] == 1995 and asked["shapes"] >= set(growing) and len(use) == 12 * len(new + growing)
    assert {use[c, m] for c in growing for m in range(1, 13)} == {321.0} and {use[new[0], m] for m in range(1, 13)} == {123.0}
    assert all(use[c, m] != 123.0 for c in new[1:] for m in range(1, 13))


def test_both_halves_of_the_contract_run_are_registered(spark, monkeypatch):
    import __spark_entry__ as entry

    def halves(contracts, exogenous, year, **options):
        return [spark.createDataFrame([tuple("1" for _ in h)], list(h.values())) for h in (N.STF_CD_HEADER, N.LTF_CD_HEADER)]

    monkeypatch.setattr(P, "full_contracts", halves)
    assert entry.queries()["full_contracts_long_term_j06"](spark, SF).columns == list(N.LTF_CD_HEADER.values())
    assert "short_term_reasons_j02" in entry.queries()


def test_contract_classes(spark):
    spans = spark.createDataFrame([(1, 2018), (2, 2019), (3, 2020), (4, 2021)], "contrat long, start_year long")
    assert [r.classe_contrat for r in K.contract_class(spans, 2020).orderBy("contrat").collect()] == ["established", "growth", "similarity", "later"]


def test_billed_power_reaches_the_forecast_year(spark):
    def ahead(last_power):
        rows = [("a", y, m, 100.0 + 3 * y % 7 + m + 2 * (y - 2010) * (1 + y % 3), 10.0 + (y % 3) * 5 if y < 2016 else last_power)
                for y in range(2010, 2017) for m in range(1, 13)]
        df = spark.createDataFrame(rows, "k string, annee long, mois long, v double, p double")
        placed = R.with_placeholder_year(df, ["k"], 2017, "v", ["p"])
        packed = ST.pack_series(placed, ["k"], "v", power="p", fill_gaps=True)
        assert packed.first().power[-1] == [last_power] * 12
        folds = ST.fold_predictions(packed, ST.grid_frame(spark, SMALL), ["k"], ST.CONTRACT_ALPHAS)
        return {r.ordinal: r.predictions[-1] for r in folds.filter("strategy = 2").collect()}

    low, high = ahead(10.0), ahead(40.0)
    assert low.keys() == high.keys() and all(abs(sum(low[k]) - sum(high[k])) > 1e-6 for k in low)


def test_scratch_run_empties_its_folder(spark):
    root = f"{shared_dir(spark).removeprefix('file:')}/wattline"
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    with scratch_run(spark):
        assert materialize(spark.range(5), "scratch-test").count() == 5
        assert set(os.listdir(root)) - before
    assert set(os.listdir(root)) == before
