"""Correlations of measures that do not vary."""

import pytest

from wattline.operators import correlation as C


@pytest.fixture(scope="module")
def measures(spark):
    rows = [(1, 1.0, 2.0), (1, 1.0, 3.0), (2, 1.0, 2.0), (3, 1.0, 2.0), (3, 2.0, 5.0), (3, 4.0, 4.0), (3, 9.0, None), (3, None, 1.0), (4, 1.0, 1.0), (4, 2.0, 1.0), (4, 5.0, None)]
    return spark.createDataFrame(rows, "k int, a double, b double")


def test_constant_measure_has_no_correlation(measures):
    got = {r.k: r.correlation for r in C.measure_correlation(measures, ["k"], "a", "b").collect()}
    assert got[1] is None and got[2] is None and got[4] is None
    assert got[3] == pytest.approx(0.5)  # of (1, 2), (2, 5), (4, 4)


def test_matrix_with_a_constant_column(measures):
    got = C.correlation_matrix(measures.filter("k = 1").selectExpr("a", "b", "b * 2 as c"), ["a", "b", "c"]).collect()
    assert {(r.a, r.b): r.correlation and round(r.correlation, 9) for r in got} == {("a", "b"): None, ("a", "c"): None, ("b", "c"): 1.0}
