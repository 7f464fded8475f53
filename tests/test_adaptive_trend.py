"""The asymmetric adaptive trend model against plain loops."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattline.models import adaptive as A


def plain_path(logs, mu, down, up, beta):
    trend, drift, forecasts = logs[0], mu, []
    for l in logs[:-1]:
        gap = l - trend
        drift = mu + beta * max(0.0, gap)
        trend += drift
        forecasts.append(drift - (down if gap < 0 else up) * gap)
    return forecasts, trend, drift


def plain_loss(logs, mu, down, up, beta, penalty):
    errors = [d - f for d, f in zip(np.diff(logs), plain_path(logs, mu, down, up, beta)[0])]
    return sum((penalty if e > 0 else 1.0) * e * e for e in errors) / len(errors)


def series(n=6, years=9):
    rng = np.random.default_rng(7)
    rows = []
    for k in range(n):
        level = 5.0
        for y in range(years):
            rows.append((k, 1990 + y, float(math.exp(level))))
            level += rng.normal(0.04, 0.12)
    return rows


@pytest.fixture(scope="module")
def annual(spark):
    return spark.createDataFrame(series(), "k int, annee bigint, v double")


def logs_of(k):
    return [math.log(v) for i, _, v in series() if i == k]


def test_state_and_horizon_match_loops(spark, annual):
    p = (0.03, 0.9, 0.2, 0.4)
    states = A.trend_state(A.log_series(annual, ["k"], "v"), F.struct(*[F.lit(v).alias(n) for n, v in zip(A.PARAMETERS, p)]))
    got = {(r.k, r.annee): r.log_prediction for r in A.trend_horizon(states, ["k"], 4).collect()}
    assert len(got) == 6 * 4
    mu, down, up, beta = p
    for k in range(6):
        logs = logs_of(k)
        _, trend, drift = plain_path(logs, *p)
        level = logs[-1]
        for h in range(1, 5):
            gap = level - trend
            level += drift - (down if gap < 0 else up) * gap
            drift = mu + beta * max(0.0, gap)
            trend += drift
            assert got[(k, 1998 + h)] == pytest.approx(level, abs=1e-9)


@pytest.mark.parametrize("penalty", [1.0, 2.0])
def test_fit_is_no_worse_than_a_wide_search(annual, penalty):
    fitted = A.fit_adaptive_trend(A.log_series(annual, ["k"], "v"), penalty).select("k", "parameters.*", "loss").collect()
    assert len(fitted) == 6
    rng = np.random.default_rng(1)
    for r in fitted:
        logs = logs_of(r.k)
        p = (r.mu, r.alpha_down, r.alpha_up, r.beta)
        assert r.mu >= 0 and 0.1 <= r.alpha_down <= 1.5 and 0 <= r.alpha_up <= 0.5 and 0 <= r.beta <= 0.5
        assert r.loss == pytest.approx(plain_loss(logs, *p, penalty), abs=1e-12)
        tried = zip(rng.uniform(0, 0.4, 4000), rng.uniform(0.1, 1.5, 4000), rng.uniform(0, 0.5, 4000), rng.uniform(0, 0.5, 4000))
        assert r.loss <= min(plain_loss(logs, *q, penalty) for q in tried) * 1.001 + 1e-12


def test_short_null_and_falling_series(spark):
    rows = [(1, 2000, 5.0), (2, 2000, 5.0), (2, 2001, None), (3, 2000, 5.0), (3, 2001, 0.0), (4, 2000, 9.0), (4, 2001, 6.0), (4, 2002, 4.0)]
    fit = A.fit_adaptive_trend(A.log_series(spark.createDataFrame(rows, "k int, annee bigint, v double"), ["k"], "v")).select("k", "parameters.*").collect()
    assert [r.k for r in fit] == [4]
    assert fit[0].mu == 0.0


def test_many_series_of_mixed_lengths_are_fitted_together(spark):
    """6,000 series took 50 s when every candidate was an expression of its own; each must equal its fit alone."""
    rng = np.random.default_rng(3)
    logs = [np.cumsum(rng.normal(0.04, 0.12, 2 + k % 8)).tolist() for k in range(6000)]
    df = spark.createDataFrame(list(enumerate(logs)), "k int, logs array<double>").withColumn("last_year", F.lit(2000))
    start = time.monotonic()
    fitted = {r.k: r for r in A.fit_adaptive_trend(df, 2.0).collect()}
    assert time.monotonic() - start < 25 and len(fitted) == 6000
    for k in (0, 1, 2, 7, 4003, 5999):
        loss, mu, down, up, beta = A._search(np.array([logs[k]]), 2.0, (12, 8), 4, 6)[0]
        assert tuple(fitted[k].parameters) == (mu, down, up, beta) and fitted[k].loss == loss
        assert loss == pytest.approx(plain_loss(logs[k], mu, down, up, beta, 2.0), abs=1e-12)
