"""Queries that read the contract-months, a sheet or the points of a search more than once: written first, compared in parts."""

import numpy as np
import pandas as pd
import pytest

from wattline import catalog
from wattline.catalog import full_runs
from wattline.operators import clustering as G, nearest_blocks as NB, neighbours as B
from wattline.sources import sheets as S
from wattline.sources.fixtures import Tables

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


def test_nearest_over_many_blocks(spark, monkeypatch):
    """whole numbers with many zeros and ties, in small blocks cut from a sample of a third."""
    for name, value in (("LEAF", 24), ("BLOCK", 60), ("SAMPLE", 200)):
        monkeypatch.setattr(NB, name, value)
    rng = np.random.default_rng(4)
    n = 600
    v = np.where(rng.random((n, 12)) < 0.15, rng.integers(1, 12, (n, 12)), 0).astype(float)
    scope = np.where(np.arange(n) % 7 == 0, "x", "y")
    df = spark.createDataFrame(pd.DataFrame(v, columns=B.DIMS).assign(contrat=np.arange(n), scope=scope))
    found = {}
    for r in B.nearest(df.filter("contrat % 2 = 0"), df).collect():
        found.setdefault(r.contrat, []).append((r.rang, r.voisin, r.distance))
    assert len(found) == n // 2
    for i in range(0, n, 2):
        d = {j: float(np.sqrt(((v[i] - v[j]) ** 2).sum())) for j in range(n) if scope[j] == scope[i]}
        want = sorted(d, key=lambda j: (round(d[j], 9), j))[:5]
        assert [x[1] for x in sorted(found[i])] == want
        assert [x[2] for x in sorted(found[i])] == pytest.approx([d[j] for j in want])


def test_kept_contract_months(spark):
    """F16, F18, F19, F21: the same rows, from one written table."""
    plain, kept = Tables(spark, SF), Tables(spark, SF).kept()
    for a, b in ((plain.cd, kept.cd), (plain.contracts, kept.contracts)):
        assert a.columns == b.columns and sorted(a.toPandas().round(4).astype(str).values.tolist()) == sorted(b.toPandas().round(4).astype(str).values.tolist())
        assert "lineitem.parquet" not in plan(b)
    assert kept.kept().cd is kept.cd


def test_sales_and_use_from_written_months(spark):
    """the facts are read once, and no long table is shuffled."""
    text = plan(catalog.load()[0]["sales_and_use_a18"](spark, SF))
    assert "lineitem.parquet" not in text


def test_sales_without_use(spark):
    """every month of a sheet, use where its key has a row; text that is no number is 0."""
    sales = spark.createDataFrame([("a", "1", None), ("b", "x", "4"), (None, "5", "6")], "k string, `01.2020` string, `02.2020` string")
    use = spark.createDataFrame([("a", 7.0, None), ("a", 8.0, 9.0), (None, 1.0, 1.0)], "k string, `01.2020` double, `02.2020` double")
    got = S.sales_and_use(sales, use, ["k"], ["01.2020", "02.2020"])
    assert got.columns == ["k", "mois", "annee", "ventes", "consommation"]
    want = [("a", 1, 2020, 1.0, 7.0), ("a", 1, 2020, 1.0, 8.0), ("a", 2, 2020, 0.0, 0.0), ("a", 2, 2020, 0.0, 9.0), ("b", 1, 2020, 0.0, None),
            ("b", 2, 2020, 4.0, None), (None, 1, 2020, 5.0, None), (None, 2, 2020, 6.0, None)]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    assert "MERGE" not in plan(got) and "Expand" not in plan(got)


def test_clusters_read_their_input_once(spark):
    """F22."""
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def count(x):
        seen.add(1)
        return float(x)

    rows = spark.range(60).select(F.col("id"), (F.col("id") % 3 * 10).cast("double").alias("y1"), count("id").alias("y2"))
    got = G.kmeans_sweep(rows, ["y1", "y2"], range(2, 4)).orderBy("k").collect()
    assert [r.k for r in got] == [2, 3] and seen.value == 60


def test_written_forecasts_read_facts_once(spark):
    """F24."""
    assert "lineitem.parquet" not in plan(full_runs._written_forecasts(Tables(spark, SF)))
