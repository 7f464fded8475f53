"""Screening of the short-term grid: same choice to the last bit, few back-tests by month."""

import numpy as np
import pytest

from test_short_term_batch import LAMBDAS, configs, made
from wattline.models import kernels as K, screening as SC, short_term as ST


def batch(rows):
    return ST._Batch(rows, LAMBDAS, list(ST.CONTRACT_ALPHAS), ST.N_PCS)


def odd(n):
    """Months that recur, years alike, a year that grows evenly."""
    rows = made(n, years=7, seed=8)
    rows[0].matrix = [rows[0].matrix[0]] * 7
    rows[1].matrix = [[50.0] * 12] * 7
    rows[2].matrix = (np.outer(2.0 ** np.arange(7), np.arange(1, 13))).tolist()
    rows[3].matrix = [[0.0] * 12] * 7
    rows[4].matrix = [[float(m == y) * 9 for m in range(12)] for y in range(7)]
    return rows


@pytest.mark.parametrize("rows", [[r for r in made(75) if r.k % 5], made(20), odd(30), made(40, years=4), made(20, years=3)])
@pytest.mark.parametrize("clients", [[False], [True, False]])
def test_the_best_of_the_grid_takes_few_regressions_and_keeps_its_bits(spark, monkeypatch, rows, clients):
    options = configs(spark, {**ST.CONTRACT_GRID, "use_clients": clients, "client_weights": [0.4], "lambdas": LAMBDAS})
    strategies = np.array([c["strategy"] for c in options])
    solved, solve = [0], K._ridge
    monkeypatch.setattr(K, "_ridge", lambda z, y, alphas: solved.__setitem__(0, solved[0] + y[..., 0].size * np.shape(alphas)[-1]) or solve(z, y, alphas))
    preds, there = batch(rows).predictions(options)
    keep = ST._candidates(batch(rows), preds, there, strategies, 0.6, 1996)
    whole, solved[0] = solved[0], 0
    want = {(i, j): (there[i, j].tolist(), preds[i, j].tolist()) for i, j in zip(*np.nonzero(keep))}
    got = {}
    for i, j, at, months in ST._best_of_grid(batch(rows), options, strategies, 0.6, 1996):
        got.update({(a, b): (c.tolist(), d.tolist()) for a, b, c, d in zip(i, j, at, months)})
    assert got == want
    if len(rows) == 60:
        assert solved[0] < whole / 8


@pytest.mark.parametrize("n,f", [(1, 3), (2, 4), (3, 2), (5, 18), (12, 6)])
def test_regressions_in_rows_equal_regressions_in_columns(n, f):
    rng = np.random.default_rng(n)
    x, y, ahead = rng.normal(size=(50, n, f)), rng.normal(size=(50, n)), rng.normal(size=(50, f))
    x[::7, :, 0] = 3.0  # a constant column
    both = SC.add_products(*(SC.column_products(x[:, :, c].transpose(1, 2, 0), ahead[:, c].T) for c in (slice(0, 1), slice(1, f))))
    got, _, at = SC.ridge(both, np.ascontiguousarray(y.T), ST.CONTRACT_ALPHAS)
    assert got == pytest.approx(K.ridge_loo_many(x, y, ahead, ST.CONTRACT_ALPHAS), rel=1e-9, abs=1e-9)
    if at is not None:
        assert (K.ridge_loo_many(x, y, ahead, ST.CONTRACT_ALPHAS, best=at) == K.ridge_loo_many(x, y, ahead, ST.CONTRACT_ALPHAS)).all()


@pytest.mark.parametrize("years,f", [(3, 0), (3, 5), (4, 5), (6, 0), (9, 3), (14, 2)])
def test_growth_in_pairs_equals_growth_in_parameters(years, f):
    rng = np.random.default_rng(years)
    a, x = np.exp(rng.normal(size=(60, years))), rng.normal(size=(60, years, f))
    a[:3] = 2.0 ** np.arange(years)  # growths all alike
    assert SC.growth_forecast(a, x, rng.normal(size=(60, f)) * 0) == pytest.approx(K.growth_forecast_many(a, x, np.zeros((60, f))), rel=1e-8)


def test_ensembles_together_equal_ensembles_alone():
    rng = np.random.default_rng(3)
    preds, actual = rng.uniform(0, 9, (40, 4, 5, 12)), rng.uniform(0, 9, (40, 5, 12))
    preds[::5, 1] = 2 * preds[::5, 0]  # one model is a multiple of another
    preds[1], actual[2] = 0.0, 0.0

    def slow(p, a):
        out = np.zeros(a.shape)
        for i in range(len(a)):
            w, lam = np.full(4, 0.25), 0.0
            if i:
                flat, real = p[:, :i].reshape(4, -1), a[:i].ravel()
                raw = np.clip(np.linalg.lstsq(flat.T, real, rcond=None)[0], 0, None)
                w = raw / raw.sum() if raw.sum() > 0 else w
                mixed = w @ flat
                ok = mixed > 1e-8
                if ok.any():
                    z, v = real[ok] / mixed[ok] - 1, mixed[ok]
                    order = np.argsort(z, kind="stable")
                    lam = z[order][min(np.searchsorted(np.cumsum(v[order]) / v.sum(), 0.6), len(z) - 1)]
            out[i] = (1 + lam) * np.tensordot(w, p[:, i], axes=(0, 0))
        return out

    got = K.ensemble_many(preds, actual, 0.6)
    for p, a, g in zip(preds, actual, got):
        assert g == pytest.approx(slow(p, a), rel=1e-8, abs=1e-8)
