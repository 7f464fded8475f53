"""Series go through the short-term grid together: as many array operations for a batch as for one series, each with its own result."""

from types import SimpleNamespace

import numpy as np
import pytest

from wattline.models import kernels as K, short_term as ST

LAMBDAS = ST.CONTRACT_GRID["lambdas"]


def made(n, years=6, seed=5):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        m = rng.uniform(0, 100, (years, 12)) * (rng.random((years, 12)) < 0.6)
        if i % 5 == 0:
            m[1] = 0  # a year without use: no growth model
        out.append(SimpleNamespace(k=i, years=[1990 + i % 3 + y for y in range(years)], matrix=m.tolist(), exog=rng.normal(50, 3, (years, 4)).tolist(),
                                   growth=rng.normal(0, 0.02, (years, 4)).tolist(), clients=(rng.uniform(0, 9, (years, 12)) * (i % 2)).tolist(),
                                   power=rng.uniform(0, 40, (years, 12)).tolist()))
    return out


def configs(spark, grid):
    return [{**c.asDict(), "block": tuple(c.block)} for c in ST.grid_frame(spark, grid).orderBy("ordinal").collect()]


@pytest.mark.parametrize("grid", [ST.CONTRACT_GRID, {**ST.CONTRACT_GRID, "use_clients": [True, False], "lags": [1], "client_weights": [0.4]}])
def test_a_batch_makes_no_more_fits_than_one_series_and_gives_the_same(spark, monkeypatch, grid):
    calls, solve = [], K.ridge_loo_many
    monkeypatch.setattr(K, "ridge_loo_many", lambda *a, **k: calls.append(1) or solve(*a, **k))
    options, rows = configs(spark, grid), made(12)
    preds, there = ST._Batch(rows, LAMBDAS, list(ST.CONTRACT_ALPHAS), ST.N_PCS).predictions(options)
    together = len(calls)
    for i, r in enumerate(rows):
        calls.clear()
        one, has = ST._Batch([r], LAMBDAS, list(ST.CONTRACT_ALPHAS), ST.N_PCS).predictions(options)
        assert len(calls) == together
        assert (has[0] == there[i]).all()
        assert one[0] == pytest.approx(preds[i], rel=1e-9, abs=1e-9)
    late = [j for j, c in enumerate(options) if c["strategy"] == 4 and c["window"] == 4]
    assert not there[0, late].all() and there[1, late][:, 3:].all()


SCHEMA = ("k long, years array<bigint>, matrix array<array<double>>, exog array<array<double>>, growth array<array<double>>, "
          "clients array<array<double>>, power array<array<double>>")


@pytest.mark.parametrize("placeholder", [None, 1995])
def test_tasks_keep_the_rows_that_the_selection_takes(spark, placeholder):
    packed = spark.createDataFrame([tuple(vars(r).values()) for r in made(9) + [SimpleNamespace(**{**vars(r), "k": 100 + r.k}) for r in made(4, years=3)]], SCHEMA)
    grid = ST.grid_frame(spark, ST.CONTRACT_GRID)

    def chosen(best):
        folds = ST.fold_predictions(packed, grid, ["k"], ST.CONTRACT_ALPHAS, best=best)
        picked = ST.best_per_strategy(ST.score(folds, placeholder), ["k"], 0.6)
        return folds.count(), {(r.k, r.strategy): (r.ordinal, r.annees, r.predictions) for r in picked.collect()}

    everything, want = chosen(None)
    few, got = chosen((0.6, placeholder))
    assert got == want and few == len(want) < everything


def test_a_series_that_cannot_be_solved_leaves_the_others(spark, monkeypatch):
    solve = K.ridge_loo_many

    def refuses(x, y, *a, **k):
        if (y == 777.0).any():
            raise np.linalg.LinAlgError("singular")
        return solve(x, y, *a, **k)

    rows = made(5)
    rows[2].matrix = [[0.0] * 11 + [777.0]] * 6
    monkeypatch.setattr(K, "ridge_loo_many", refuses)
    options = configs(spark, ST.CONTRACT_GRID)
    with pytest.raises(np.linalg.LinAlgError):
        ST._Batch(rows, LAMBDAS, list(ST.CONTRACT_ALPHAS), ST.N_PCS).predictions(options)
    _, there = ST._Batch([rows[2]], LAMBDAS, list(ST.CONTRACT_ALPHAS), ST.N_PCS).predictions(options)
    assert not any(there[0, j].any() for j, c in enumerate(options) if c["strategy"] == 2)
    assert any(there[0, j].any() for j, c in enumerate(options) if c["strategy"] == 4)
