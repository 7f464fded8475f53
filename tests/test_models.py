"""Kernels against plain loops, recoveries of known parameters, and no look into the future."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattline.models import kernels as K, long_term as LT, short_term as ST, trend as T
from wattline.models.gaussian_process import KERNELS, gp_predict, trend_gp

RNG = np.random.default_rng(3)


def slow_ridge(x, y, x_test, alphas):
    def fit(a, b, c, alpha):
        mu, sd = a.mean(axis=0), a.std(axis=0)
        sd = np.where(sd == 0, 1, sd)
        z = (a - mu) / sd
        beta = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (b - b.mean()))
        return b.mean() + ((c - mu) / sd) @ beta

    errors = [np.mean([abs(fit(np.delete(x, i, 0), np.delete(y, i), x[i], a) - y[i]) for i in range(len(x))]) for a in alphas]
    return fit(x, y, x_test, alphas[int(np.argmin(errors))])


def test_ridge_matches_plain_loops():
    for n in (3, 5, 8):
        x, y, q = RNG.normal(size=(n, 3)), RNG.normal(size=n), RNG.normal(size=3)
        assert K.ridge_loo(x, y, q, [0.1, 1.0, 10.0]) == pytest.approx(slow_ridge(x, y, q, [0.1, 1.0, 10.0]))


def test_full_component_set_reconstructs():
    x = RNG.normal(size=(20, 5))
    mean, comps = K.weighted_pca(x, K.power_weights(20, 0.7), 5)
    assert ((x - mean) @ comps.T) @ comps + mean == pytest.approx(x)


def test_growth_fit_is_the_best_in_its_box():
    for _ in range(60):
        g = RNG.normal(0.02, 0.1, size=RNG.integers(3, 8))
        c, rho, _ = K.growth_fit(g, np.zeros((len(g), 0)))
        loss = ((g[1:] - c - rho * g[:-1]) ** 2).sum()
        grid = min(((g[1:] - a - b * g[:-1]) ** 2).sum() for a in np.linspace(0, 0.5, 101) for b in np.linspace(0, 1, 101))
        assert 0 <= rho <= 1 and c >= 0 and loss <= grid + 1e-9


def test_native_growth_equals_kernel(spark):
    rows, want = [], {}
    for k in range(40):
        n = int(RNG.integers(3, 9))
        v = 100 * np.exp(np.cumsum(RNG.normal(0.02, 0.1, size=n)))
        rows += [(k, 2000 + i, float(x)) for i, x in enumerate(v)]
        want[k] = K.growth_forecast(v, np.zeros((n, 0)), np.zeros(0))
    df = spark.createDataFrame(rows, "k bigint, annee bigint, v double")
    got = T.mean_reverting_growth(df, ["k"], "v").withColumn("p", T.next_level())
    assert {r.k: pytest.approx(r.p, rel=1e-6) for r in got.collect()} == want


def test_asymmetric_growth_is_the_best_in_its_box(spark):
    rng = np.random.default_rng(8)
    rows, growths = [], {}
    for k in range(60):
        n = int(rng.integers(4, 10))
        v = 100 * np.exp(np.cumsum(rng.normal(0.02, 0.1, size=n)))
        rows += [(k, 2000 + i, float(x)) for i, x in enumerate(v)]
        growths[k] = np.diff(np.log(v))
    df = spark.createDataFrame(rows, "k bigint, annee bigint, v double")
    a, b = (z.ravel() for z in np.meshgrid(np.linspace(0, 0.3, 301), np.linspace(0, 1, 201)))
    for penalty in (2.0, 10.0):
        got = T.asymmetric_growth(df, ["k"], "v", penalty).collect()
        assert len(got) == 60
        for r in got:
            g = growths[r.k]

            def loss(c, rho):
                e = g[1:, None] - c - rho * g[:-1, None]
                return (np.where(e > 0, penalty, 1.0) * e * e).sum(axis=0)

            assert 0 <= r.rho <= 1 and r.drift >= 0 and loss(np.array([r.drift]), np.array([r.rho]))[0] <= loss(a, b).min() + 1e-9
    plain = {r.k: (r.rho, r.drift) for r in T.mean_reverting_growth(df, ["k"], "v").collect()}
    assert {r.k: pytest.approx((r.rho, r.drift), abs=1e-6) for r in T.asymmetric_growth(df, ["k"], "v", 1.0).collect()} == plain


def test_known_growth_is_recovered():
    g = [0.05]
    for _ in range(40):
        g.append(0.01 + 0.6 * g[-1])
    c, rho, _ = K.growth_fit(np.array(g), np.zeros((41, 0)))
    assert (c, rho) == (pytest.approx(0.01, abs=1e-6), pytest.approx(0.6, abs=1e-4))


def test_ensemble_first_year_is_the_mean_and_weights_follow_the_truth():
    truth = RNG.uniform(50, 100, size=(4, 12))
    mixed = K.ensemble(np.stack([truth, truth * 3]), truth, 0.6)
    assert mixed[0] == pytest.approx(truth[0] * 2)
    assert mixed[3] == pytest.approx(truth[3], rel=1e-6)


def test_pinball_factor():
    y, p = np.array([110.0, 120.0, 90.0, 100.0]), np.array([100.0, 100.0, 100.0, 100.0])
    assert K.pinball_factor(y, p, 0.6) == pytest.approx(0.1)


def test_gp_follows_points_and_every_kernel_runs():
    x = np.linspace(-1.5, 1.5, 8)[:, None]
    y = np.sin(x[:, 0])
    for key in KERNELS:
        mean, sd = gp_predict(x, y, x, key)
        assert np.isfinite(mean).all() and (sd >= 0).all()
    mean, _ = gp_predict(x, y, x, "matern_smooth")
    assert mean == pytest.approx(y, abs=0.3)


def test_trend_gp_on_an_exact_line_and_band():
    years = np.arange(2010.0, 2018.0)
    y = 100 + 5 * (years - 2010)
    ahead = np.arange(2018.0, 2021.0)
    mean, low, high = trend_gp(years, y, np.zeros((8, 0)), ahead, np.zeros((3, 0)), {"prior": LT.LINEAR_PRIOR, "kernel": "rbf_white"})
    assert mean == pytest.approx(100 + 5 * (ahead - 2010), rel=1e-6)
    assert (low <= mean).all() and (mean <= high).all()


def series(spark, n_years=7, change=None):
    rows = []
    rng = np.random.default_rng(11)
    for k in ("a", "b", "c"):
        for y in range(2010, 2010 + n_years):
            for m in range(1, 13):
                v = 100 + 5 * (y - 2010) + 20 * np.sin(m) + rng.normal(0, 3)
                rows.append((k, y, m, float(v if change is None or y < change else v * 7)))
    return spark.createDataFrame(rows, "k string, annee bigint, mois bigint, v double")


SMALL = {**ST.REGIONAL_GRID, "blocks": {"none": []}, "lambdas": [0.7], "pc_weights": [0.5], "windows": [4]}


def test_no_strategy_looks_ahead(spark):
    def preds(df):
        packed = ST.pack_series(df, ["k"], "v")
        folds = ST.fold_predictions(packed, ST.grid_frame(spark, SMALL), ["k"])
        long = folds.select("k", "strategy", "ordinal", F.explode(F.arrays_zip("annees", "predictions")).alias("f"))
        return {(r.k, r.ordinal, r.f.annees): r.f.predictions for r in long.collect()}

    base, changed = preds(series(spark)), preds(series(spark, change=2015))
    early = [k for k in base if k[2] <= 2015]
    assert {k[1] for k in early} == {k[1] for k in base} and early
    for k in early:
        assert base[k] == pytest.approx(changed[k])


def test_grid_sizes_and_incomplete_series(spark):
    assert ST.grid_frame(spark).groupBy("strategy").count().orderBy("strategy").toPandas()["count"].tolist() == [24, 8, 48, 12]
    assert ST.grid_frame(spark, ST.CONTRACT_GRID).count() == 192
    df = series(spark).filter("not (k = 'a' and annee = 2012 and mois = 5)")
    assert sorted(r.k for r in ST.pack_series(df, ["k"], "v").collect()) == ["b", "c"]
    assert ST.pack_series(df, ["k"], "v", fill_gaps=True).count() == 3


def test_scores_equal_plain_metrics(spark):
    packed = ST.pack_series(series(spark), ["k"], "v")
    got = ST.score(ST.fold_predictions(packed, ST.grid_frame(spark, SMALL), ["k"])).collect()
    for r in got:
        p, a = np.array(r.predictions), np.array(r.actuals)
        assert r.monthly_mae == pytest.approx(np.abs(p - a).mean())
        assert r.annual_r2 == pytest.approx(1 - ((p.sum(1) - a.sum(1)) ** 2).sum() / ((a.sum(1) - a.sum(1).mean()) ** 2).sum())


def test_placeholder_year_does_not_enter_the_scores(spark):
    packed = ST.pack_series(series(spark), ["k"], "v")
    folds = ST.fold_predictions(packed, ST.grid_frame(spark, SMALL), ["k"])
    r = ST.score(folds, 2016).filter("ordinal = 0 and k = 'a'").first()
    keep = [i for i, y in enumerate(r.annees) if y != 2016]
    p, a = np.array(r.predictions)[keep], np.array(r.actuals)[keep]
    assert r.annual_mae == pytest.approx(np.abs(p.sum(1) - a.sum(1)).mean())


def test_short_term_run_prefers_the_ensemble(spark):
    packed = ST.pack_series(series(spark), ["k"], "v")
    assert {r.strategy for r in ST.run_short_term(packed, ["k"], SMALL).collect()} == {5}
    free = ST.run_short_term(packed, ["k"], SMALL, favor_overestimation=False).collect()
    assert len(free) == 3
    for r in free:
        p, a = np.array(r.predictions), np.array(r.actuals)
        assert np.abs(p.sum(1) / a.sum(1) - 1).mean() < 0.1


def test_registered_model_is_used(spark):
    LT.register_model("last", lambda ys, y, x, new, xn, p: (np.full(len(new), y[-1]),) * 3)
    annual = series(spark).groupBy("k", "annee").agg(F.sum("v").alias("v"))
    feats = spark.createDataFrame([(y,) for y in range(2010, 2022)], "annee bigint")
    packed, columns = LT.pack_annual(annual, feats, ["k"], "v", [])
    best, ahead = LT.run_long_term(packed, columns, [[]], ["k"], {**LT.REGIONAL_GRID, "transforms": [[]], "models": [{"model": "last"}]})
    last = {r.k: r.v for r in annual.filter("annee = 2016").collect()}
    assert ahead.count() == 15 and all(r.prediction == pytest.approx(last[r.k]) for r in ahead.collect())
    with pytest.raises(TypeError):
        LT.register_model("bad", 1)
