"""Skew-safe operators against brute force, and the shape of physical plans."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattline import catalog
from wattline.operators import correlation as C, neighbours as B
from wattline.operators.quantiles import exact_quantiles
from wattline.sources.fixtures import Tables

SF = "/root/testdata/sf0.001"


def test_exact_quantiles_with_a_hot_value(spark):
    rng = np.random.default_rng(1)
    frames = []
    for k, n in (("hot", 30_000), ("small", 7), ("one", 1)):
        v = rng.normal(size=n).round(3)
        v[: n // 3] = 0.5
        frames.append(pd.DataFrame({"k": k, "v": v}))
    pdf = pd.concat(frames)
    got = exact_quantiles(spark.createDataFrame(pdf), ["k"], "v", (0.0, 0.25, 0.5, 0.975, 1.0)).collect()
    for r in got:
        want = np.quantile(pdf[pdf.k == r.k].v, (0.0, 0.25, 0.5, 0.975, 1.0))
        assert [r[f"q{i}"] for i in range(5)] == pytest.approx(list(want))


@pytest.mark.parametrize("seed,spread", [(1, 1.0), (2, 1000.0), (3, 0.0)])
def test_nearest_is_exact_under_skew(spark, seed, spread):
    rng = np.random.default_rng(seed)
    n = 700
    v = (rng.normal(size=(n, 12)) * spread).round(2)
    v[: n // 3] = v[0]                     # a third of the contracts share one profile
    scope = np.where(np.arange(n) % 5 == 0, "x", "y")
    scope[-2:] = "tiny"
    pdf = pd.DataFrame(v, columns=B.DIMS).assign(contrat=np.arange(n), scope=scope)
    df = spark.createDataFrame(pdf)
    got = B.nearest(df, df)
    found = {}
    for r in got.collect():
        found.setdefault(r.contrat, []).append((r.rang, r.voisin))
    for i in range(n):
        peers = [j for j in range(n) if scope[j] == scope[i]]
        d = {j: round(float(np.sqrt(((v[i] - v[j]) ** 2).sum())), 9) for j in peers}
        want = sorted(peers, key=lambda j: (d[j], j))[:5]
        assert [x for _, x in sorted(found[i])] == want


def test_lone_contract_searches_everything(spark):
    pdf = pd.DataFrame(np.arange(60.0).reshape(5, 12), columns=B.DIMS).assign(contrat=range(5), activite=["a", "a", "a", "a", "lone"])
    profiles = B.with_scope(spark.createDataFrame(pdf), spark.createDataFrame(pdf[["contrat", "activite"]]))
    got = B.nearest(profiles.filter("contrat = 4"), profiles).orderBy("rang").collect()
    assert [r.voisin for r in got] == [4, 3, 2, 1, 0]


def test_correlated_pairs_with_gaps_equal_pairwise_complete(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(40):
        years = sorted(rng.choice(range(2010, 2018), size=rng.integers(3, 9), replace=False))
        base = np.arange(8) if k % 3 == 0 else -np.arange(8) if k % 3 == 1 else np.zeros(8)
        rows += [(f"s{k:02d}", int(y), float(base[y - 2010] + rng.normal(0, 0.6))) for y in years]
    pdf = pd.DataFrame(rows, columns=["k", "annee", "v"])
    matrix = pdf.pivot(index="annee", columns="k", values="v").corr()
    want = {(a, b): matrix.loc[a, b] for a, b in itertools.combinations(matrix.columns, 2) if abs(matrix.loc[a, b]) >= 0.85 - 1e-12}
    got = {(r.serie_1, r.serie_2): r.correlation for r in C.correlated_pairs(spark.createDataFrame(pdf), "k", "v", 0.85).collect()}
    assert set(got) == set(want)
    assert all(got[p] == pytest.approx(want[p]) for p in want)


def plan(df):
    return df._jdf.queryExecution().toString()


def test_scans_prune_columns_and_push_filters(spark):
    t = Tables(spark, SF)
    text = plan(t.raw("orders").filter(F.col("o_totalprice") > 1000).select("o_custkey"))
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,1000.0)]" in text
    grd = plan(t.grd)
    assert "o_orderpriority" not in grd.split("== Physical Plan ==")[1]


@pytest.mark.parametrize("name", ["table_contract_months", "monthly_sum_by_region_c01", "contract_features_by_activity_c10", "asof_latest_month_d07",
                                  "contract_allocation_by_region_f08", "linear_trend_forecast_h12", "mean_reverting_growth_h10", "best_model_g03"])
def test_plans_hold_no_product_and_no_python(spark, name):
    text = plan(catalog.load()[0][name](spark, SF)).split("== Physical Plan ==")[1]
    assert "CartesianProduct" not in text
    assert "Python" not in text and "InPandas" not in text
