"""Callers' priors and kernels reach the workers; unknown names and unused options are told at once."""

import warnings

import numpy as np
import pytest

from wattline.models import gaussian_process as G, long_term as LT

GRID = {**LT.REGIONAL_GRID, "transforms": [[]]}


def half_of_last():
    """Made inside a function: Spark ships such functions whole, those of a module by the module's name."""
    return lambda prior, years, y, driver: lambda ys, d=None: np.full(len(ys), prior["share"] * y[-1])


@pytest.fixture
def registered():
    kernels, priors, options = dict(G.KERNELS), dict(G.PRIORS), dict(G.PRIOR_OPTIONS)
    G.register_prior("share_of_last", half_of_last(), ["share"])
    G.register_kernel("nothing", lambda d: np.zeros_like(d), (1.0, 2.0), (0.1, 0.2))
    yield
    for live, saved in ((G.KERNELS, kernels), (G.PRIORS, priors), (G.PRIOR_OPTIONS, options)):
        live.clear()
        live.update(saved)


def packed(spark):
    annual = spark.createDataFrame([(k, y, 100.0 * (k + 1) + y - 2010) for k in range(3) for y in range(2010, 2017)], "k int, annee bigint, v double")
    feats = spark.createDataFrame([(y,) for y in range(2010, 2022)], "annee bigint")
    return LT.pack_annual(annual, feats, ["k"], "v", [])


def test_prior_and_kernel_are_used_on_workers(spark, registered):
    series, columns = packed(spark)
    # a kernel without covariance leaves the prior alone as the forecast
    model = {"model": "gp", "kernel": "nothing", "normalize": False, "prior": {"type": "share_of_last", "share": 0.5}}
    ahead = LT.run_long_term(series, columns, [[]], ["k"], {**GRID, "models": [model]})[1].collect()
    assert len(ahead) == 15
    for r in ahead:
        assert r.prediction == pytest.approx(0.5 * (100.0 * (r.k + 1) + 6))


def test_builtin_kernel_equals_its_registered_form(registered):
    G.register_kernel("own_rbf", lambda d: np.exp(-0.5 * d ** 2), *G.KERNELS["rbf_white"][1:])
    x, y = np.arange(8.0)[:, None] / 4, np.array([1.0, 3, 2, 5, 4, 6, 8, 7])
    for a, b in zip(G.gp_predict(x, y, x + 0.3, "own_rbf"), G.gp_predict(x, y, x + 0.3, "rbf_white")):
        assert np.allclose(a, b)


@pytest.mark.parametrize("model", [{"model": "no_such"}, {"model": "gp", "kernel": "no_such"}, {"model": "gp", "prior": {"type": "no_such"}}])
def test_unknown_names_are_refused(model):
    with pytest.raises(ValueError, match="no_such"):
        LT.check_models([model])


def test_unused_options_warn(registered):
    with pytest.warns(UserWarning) as told:
        LT.check_models([{"model": "gp", "speed": 3, "prior": {"type": "share_of_last", "share": 1, "power": 2}}, {"model": "mean_reverting", "kernel": "rbf_white"}])
    assert sorted(str(w.message) for w in told) == ["gp: option prior.power is not used", "gp: option speed is not used", "mean_reverting: option kernel is not used"]


def test_shipped_grids_do_not_warn():
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        LT.check_models(LT.REGIONAL_GRID["models"] + LT.CONTRACT_GRID["models"])


def test_builtin_names_are_kept():
    with pytest.raises(ValueError):
        G.register_prior("linear", half_of_last())
    with pytest.raises(ValueError):
        G.register_kernel("rbf_white", lambda d: d, (1, 2), (1, 2))
    with pytest.raises(TypeError):
        G.register_kernel("other", 3, (1, 2), (1, 2))
