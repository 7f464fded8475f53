"""Hand-checked cases of the business rules and the traps around contract dates."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from wattline.functions import columns as C
from wattline.operators import adjustments as J, cleaning, contracts as K, joins as L, rules as R, tariffs as P
from wattline.operators.asof import latest_at
from wattline.sources import sheets, tables as T


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_ev_correction_literal(spark):
    ev = spark.createDataFrame([("Casablanca", y, float(v)) for y, v in ((2022, 1000), (2023, 1500), (2024, 2500), (2025, 4000), (2026, 6000))],
                               "region string, annee bigint, ev double")
    pred = spark.createDataFrame([("Casablanca", 2024, 1e6), ("Casablanca", 2025, 1.05e6), ("Casablanca", 2026, 1.1e6)],
                                 "region string, annee bigint, consommation double")
    got = {r.annee: r.correction for r in J.ev_correction(ev, pred).collect()}
    assert sorted(got) == [2024, 2025, 2026]
    assert got[2024] == pytest.approx(926.7857142857)
    with pytest.raises(Exception, match="no EV data"):
        J.ev_correction(ev.filter("annee <> 2025"), pred).collect()


def test_realised_correction_literal(spark):
    pred = spark.createDataFrame([("A", 2023, m, 100.0) for m in range(1, 13)], "region string, annee bigint, mois bigint, consommation double")
    real = spark.createDataFrame([("A", 2023, 1, 110.0), ("A", 2023, 2, 90.0), ("A", 2023, 3, 130.0)], pred.schema)
    got = {r.mois: r.consommation for r in R.correct_with_realised(pred, real, ["region"]).collect()}
    assert [got[m] for m in (1, 2, 3)] == [110.0, 90.0, 130.0]
    assert all(got[m] == pytest.approx(110.0) for m in range(4, 13))
    short = R.correct_with_realised(pred.filter("mois < 12"), real, ["region"])
    assert {r.consommation for r in short.collect()} == {100.0}
    arr = pred.groupBy("region").agg(F.collect_list("consommation").alias("p")).withColumn("r", F.array(F.lit(110.0), F.lit(90.0), F.lit(130.0)))
    assert arr.select(R.adjustment_factor(F.col("p"), F.col("r")).alias("x")).first().x[3:] == pytest.approx([110.0] * 9)


def test_extrapolation_is_not_compounded(spark):
    df = spark.createDataFrame([(2022, 100.0), (2023, 110.0)], "annee bigint, x double")
    assert rows(R.extrapolate_features(df, [], ["x"], 2025))[2:] == [(2024, pytest.approx(121.0)), (2025, pytest.approx(121.0))]
    with pytest.raises(Exception, match="missing"):
        R.extrapolate_features(df.filter("annee = 2023"), [], ["x"], 2025).collect()


def test_imputation_literal(spark):
    df = spark.createDataFrame([(2019, 1, 10.0), (2020, 1, 99.0), (2021, 1, 20.0), (2020, 2, 7.0)], "annee bigint, mois bigint, v double")
    got = {(r.annee, r.mois): r.v for r in R.impute_year(df, [], "v", 2020).collect()}
    assert got[(2020, 1)] == 15.0 and got[(2020, 2)] is None


def test_tariffs(spark):
    label = {v: k for k, v in P.LINE_TYPES.items()}
    lines = [(1, label["HP"], 10.0), (1, label["HPL"], 20.0), (1, label["HC"], 30.0),
             (2, label["HSP"], 10.0), (2, label["HP"], 20.0), (2, label["HPL"], 15.0), (2, label["HC"], 40.0),
             (3, label["GEN"], 8.0), (3, label["HP"], 4.0)]
    df = spark.createDataFrame([(c, 2020, 1, t, v) for c, t, v in lines], "contrat bigint, annee bigint, mois bigint, type_ligne string, valeur double")
    got = {r.contrat: r for r in P.billed_power(df).collect()}
    assert got[1].puissance_facturee == pytest.approx(20.0) and got[1].tarif == "Tarif optionnel" and got[1].avertissement == ""
    assert got[2].puissance_facturee == pytest.approx(25.0) and got[2].avertissement == "not_rising"
    assert got[3].puissance_facturee == 6.0 and got[3].tarif == "Tarif gén"
    with pytest.raises(Exception, match="invalid line set"):
        P.billed_power(df.filter("contrat = 1 and type_ligne not like '%HPL%'")).collect()
    with pytest.raises(Exception, match="unknown line type"):
        P.billed_power(df.withColumn("type_ligne", F.lit("?"))).collect()


def test_zero_year_spreads_evenly(spark):
    pred = spark.createDataFrame([("A", 2024, m, 0.0) for m in range(1, 13)], "region string, annee bigint, mois bigint, consommation double")
    corr = spark.createDataFrame([("A", 2024, 120.0)], "region string, annee bigint, correction double")
    assert {round(r.correction, 9) for r in J.apply_to_monthly(pred, corr).collect()} == {10.0}


def test_weather_correction_unknown_region(spark):
    coef = J.shipped_coefficients(spark)
    diff = spark.createDataFrame([("Oriental", 2024, 0.5, -10.0, 5.0), ("Atlantis", 2024, 1.0, 1.0, 1.0)],
                                 "region string, annee bigint, temp_min_diff double, precipitation_sum_diff double, et0_diff double")
    latest = spark.createDataFrame([("Oriental", 10.0, 300.0, 1200.0)], "region string, temp_min_latest double, precipitation_sum_latest double, et0_latest double")
    got = {r.region: r.correction for r in J.weather_correction(diff, latest, coef).collect()}
    want = 10.5 * 92906001.74314561 + 290 * 234975.31276205444 + 1205 * -209013.88780028952 - 965823292.7294213
    assert got["Oriental"] == pytest.approx(want) and got["Atlantis"] == 0.0


def walk(m0, use, move_out, max_year, threshold=20):
    """The rule in words: step forward while the year's use is at or below the threshold."""
    y = m0
    while use.get(y, 0) <= threshold and y < move_out:
        y += 1
        if y >= max_year:
            break
    return y


def test_move_in_walk_matches_stepwise_rule(spark):
    rnd = random.Random(7)
    data, want = [], {}
    for c in range(400):
        years = sorted(rnd.sample(range(2010, 2020), rnd.randint(1, 8)))
        use = {y: rnd.choice([0.0, 5.0, 20.0, 21.0, 500.0]) for y in years}
        m0 = rnd.choice([None, 2008, 2010, 2013, 2016, 2019])
        out = rnd.choice([None, 2009, 2012, 2015, 2018])
        for y in years:
            data.append((c, y, 6, use[y], f"01/02/{m0}" if m0 else None, f"{out}-03-04 00:00:00" if out else None))
        want[c] = walk(m0 or years[0], use, out or 9999, years[-1])
    df = spark.createDataFrame(data, "contrat bigint, annee bigint, mois bigint, consommation_kwh double, date_emmenagement string, date_demenagement string")
    assert {r.contrat: r.start_year for r in K.contract_spans(df).collect()} == want


@pytest.mark.parametrize("text,want", [
    ("2020-01-05", date(2020, 1, 5)), ("05.02.2020", date(2020, 2, 5)), ("1/2/2020", date(2020, 2, 1)), ("12/25/2020", date(2020, 12, 25)),
    ("2020/3/4", date(2020, 3, 4)), ("9999-12-31 00:00:00", date(9999, 12, 31)), ("24 Nov 2022", date(2022, 11, 24)),
    ("24 November 2022", date(2022, 11, 24)), ("07-08-2019", date(2019, 8, 7)), ("a verifier", None), ("", None), (None, None)])
def test_date_patterns(spark, text, want):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(C.parse_date(F.col("s")).alias("d")).first().d == want


def test_future_features_age_and_leave(spark):
    data = [(1, 2018, 1, "2018-01-01", None), (1, 2019, 1, "2018-01-01", None),
            (2, 2019, 1, "2019-01-01", "2019-06-01"), (3, 2019, 1, "2019-01-01", None)]
    df = spark.createDataFrame([(c, y, m, "x", 100.0, 10.0, 5.0, a, b) for c, y, m, a, b in data],
                               "contrat bigint, annee bigint, mois bigint, activite string, consommation_kwh double, puissance_facturee double, "
                               "puissance_appelee double, date_emmenagement string, date_demenagement string")
    got = {r.annee: r for r in K.future_features(df, "activite", 2021, 4).collect()}
    assert (got[2019].just_started, got[2019].two_years_old) == (2, 1)
    assert (got[2020].just_started, got[2020].two_years_old, got[2020].three_years_old, got[2020].total_active_contrats) == (4, 1, 1, 6)
    assert got[2020].puissance_facturee_two_years_old == 20.0  # power is not reduced by leavers
    assert got[2021].more_than_3_years_old == 1


def test_asof_takes_latest_not_later(spark):
    hist = spark.createDataFrame([("a", 1, 10.0), ("a", 5, 50.0), ("b", 9, 90.0)], "k string, t bigint, v double")
    ask = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("a", 4, 3), ("a", 9, 4), ("b", 3, 5)], "k string, t bigint, id bigint")
    got = latest_at(ask, hist, ["k"], F.col("t"), F.col("t"), ["v"]).select("id", "v").collect()
    assert {r.id: r.v for r in got} == {1: None, 2: 10.0, 3: 10.0, 4: 50.0, 5: None}


def test_unmapped_value_fails(spark):
    df = spark.createDataFrame([("X",), (None,)], "city string")
    known = spark.createDataFrame([("Y", "r")], "city string, label string")
    with pytest.raises(Exception, match="unmapped city"):
        sheets.map_values(df, "city", known, "city", "label", "region").collect()


def test_override_does_not_fan_out(spark):
    df = spark.createDataFrame([(1, 2020, m, float(m)) for m in (1, 2, 3)], "contrat bigint, annee bigint, mois bigint, v double")
    fix = spark.createDataFrame([(1, 2020, 2, 99.0), (1, 2020, 3, None)], df.schema)
    assert rows(L.override(df, fix, ["contrat", "annee", "mois"], ["v"])) == [(1, 2020, 1, 1.0), (1, 2020, 2, 99.0), (1, 2020, 3, 3.0)]


def test_forward_fill_crosses_blocks(spark):
    df = spark.createDataFrame([(i, "a" if i == 3 else "b" if i == 17 else None) for i in range(40)], "id bigint, s string")
    got = dict(rows(sheets.forward_fill(df, "id", ["s"], block_rows=5)))
    assert got == {i: None if i < 3 else "a" if i < 17 else "b" for i in range(40)}


def test_safety_net(spark):
    pred = spark.createDataFrame([(1, 2020, -5.0), (2, 2020, -5.0), (3, 2020, 4.0)], "k bigint, annee bigint, v double")
    real = spark.createDataFrame([(1, 2019, 7.0), (2, 2019, -1.0)], pred.schema)
    assert rows(cleaning.non_negative_forecast(pred, real, ["k"], "v")) == [(1, 2020, 7.0), (2, 2020, 0.0), (3, 2020, 4.0)]


def test_allocation_keeps_the_total(spark):
    data = [(c, "R", "P", "A", 2020, m, 10.0, 4.0, 3.0, 3.0, float(c * 5), 1.0, None, None, None) for c in (1, 2, 3) for m in (1, 2)]
    df = spark.createDataFrame(data, "contrat bigint, region string, partenaire string, activite string, annee bigint, mois bigint, consommation_kwh double, "
                               "consommation_zconhc double, consommation_zconhl double, consommation_zconhp double, puissance_facturee double, puissance_appelee "
                               "double, niveau_tension string, date_emmenagement string, date_demenagement string")
    pred = spark.createDataFrame([("R", 2021, 900.0)], "region string, annee bigint, consommation double")
    got = R.allocate_to_contracts(pred, df, K.contract_spans(df), "region").collect()
    assert sum(r.consommation for r in got) == pytest.approx(900.0)
    assert sorted(round(r.consommation) for r in got) == [150, 300, 450]
    assert all(r.consommation == pytest.approx(r.consommation_zconhc + r.consommation_zconhl + r.consommation_zconhp) for r in got)


def test_placeholder_gap_fails(spark):
    df = spark.createDataFrame([("a", 2019, 1, 1.0)], "k string, annee bigint, mois bigint, v double")
    assert R.with_placeholder_year(df, ["k"], 2020, "v").count() == 2
    with pytest.raises(Exception, match="more than one year"):
        R.with_placeholder_year(df, ["k"], 2022, "v").collect()


def test_missing_column_is_reported(spark):
    with pytest.raises(KeyError, match="Missing columns"):
        C.require_columns(spark.range(1), ["absent"], "test")


def test_saved_table_is_replaced(spark, tmp_path):
    spark.sql("create database if not exists wl_test location '" + str(tmp_path / "db") + "'")
    T.replace_table(spark.range(5), "wl_test.t")
    T.replace_table(spark.range(3), "wl_test.t")
    assert spark.table("wl_test.t").count() == 3
    spark.sql("drop database wl_test cascade")


def test_upsert_rewrites_touched_years_only(spark, tmp_path):
    path = tmp_path / "history"
    T.replace_parquet(spark.createDataFrame([(c, y, m, 1.0, "a") for c in range(5) for y in (2000, 2001, 2002) for m in (1, 2)],
                                            "contrat bigint, annee int, mois int, v double, tag string"), str(path), ["annee"])
    files = lambda: {f.relative_to(path): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}
    before = files()
    new = spark.createDataFrame([(0, 2001, 1, 9.0), (0, 2001, 3, 8.0), (7, 2003, 1, 7.0)], "contrat bigint, annee int, mois int, v double")
    for _ in range(2):  # a rerun changes nothing more
        got = T.upsert_partitions(str(path), new, ["contrat", "annee", "mois"])
        assert got.count() == 32
        assert rows(got.filter("v > 1").select("contrat", "annee", "mois", "v", "tag")) == [(0, 2001, 1, 9.0, None), (0, 2001, 3, 8.0, None), (7, 2003, 1, 7.0, None)]
        assert got.filter("annee = 2001").count() == 11
    after = files()
    untouched = {f for f in before if f.parts[0] in ("annee=2000", "annee=2002")}
    assert {f: after[f] for f in untouched} == {f: before[f] for f in untouched}
    assert not {f for f in before if f.parts[0] == "annee=2001"} & set(after)
    assert T.upsert_partitions(str(path), new.limit(0), ["contrat", "annee", "mois"]).count() == 32 and files() == after
