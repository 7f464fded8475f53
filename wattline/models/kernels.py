"""Small numeric kernels for short series, most of them for a stack at a time; Spark packs the series and ranks the results."""

from __future__ import annotations

import numpy as np


def scale_fit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation along the rows; constant columns divide by 1."""
    mu, sd = x.mean(axis=-2), x.std(axis=-2)
    return mu, np.where(sd <= 1e-12 * np.maximum(1.0, np.abs(mu)), 1.0, sd)


def _ridge(z, y, alphas):
    """Coefficients for a stack of centred designs and every alpha: (..., alphas, features); alphas may lead with the stack's axes."""
    gram = np.swapaxes(z, -1, -2) @ z
    moment = (np.swapaxes(z, -1, -2) @ (y - y.mean(axis=-1, keepdims=True))[..., None])
    eye = np.eye(z.shape[-1])
    return np.linalg.solve(gram[..., None, :, :] + np.asarray(alphas)[..., :, None, None] * eye, moment[..., None, :, :])[..., 0]


def ridge_loo_many(x: np.ndarray, y: np.ndarray, x_test: np.ndarray, alphas, alone: bool = False, best: np.ndarray | None = None) -> np.ndarray:
    """Ridge on scaled inputs for a stack of problems (b, n, f), (b, n), (b, f); alpha of each by leave-one-out mean
    absolute error, the first one on ties. With ``alone`` sums run in the order of a stack of one, to the last bit.
    ``best`` holds the positions of the alphas where they are known."""
    stack, n = y.shape
    # of two rows the one that stays predicts itself, whatever the alpha
    if best is None and n >= 3 and len(alphas) > 1:
        keep = np.array([[j for j in range(n) if j != i] for i in range(n)])
        xt, yt = (np.take(x, keep, axis=1), np.take(y, keep, axis=1)) if alone else (x[:, keep], y[:, keep])
        mu, sd = scale_fit(xt)
        beta = _ridge((xt - mu[..., None, :]) / sd[..., None, :], yt, alphas)
        pred = yt.mean(axis=-1)[..., None] + np.einsum("biaf,bif->bia", beta, (x - mu) / sd)
        best = np.argmin(np.abs(pred - y[..., None]).mean(axis=1), axis=1)
    chosen = np.asarray(alphas, dtype=float)[np.zeros(stack, dtype=int) if best is None else best, None]
    mu, sd = scale_fit(x)
    beta = _ridge((x - mu[:, None]) / sd[:, None], y, chosen)[:, 0]
    return y.mean(axis=1) + np.einsum("bf,bf->b", (x_test - mu) / sd, beta)


def ridge_loo(x: np.ndarray, y: np.ndarray, x_test: np.ndarray, alphas) -> float:
    return float(ridge_loo_many(x[None], y[None], x_test[None], alphas)[0])


def weighted_pca(x: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Weighted mean and the k leading directions (rows) of each table of a stack (..., rows, columns)."""
    mean = (x * weights[:, None]).sum(axis=-2) / weights.sum()
    c = (x - mean[..., None, :]) * np.sqrt(weights)[:, None]
    _, vec = np.linalg.eigh(np.swapaxes(c, -1, -2) @ c / weights.sum())
    return mean, np.swapaxes(vec[..., ::-1][..., :k], -1, -2)


def power_weights(n: int, lam: float | None) -> np.ndarray:
    w = np.ones(n) if lam is None else np.power(float(lam), np.arange(n - 1, -1, -1.0))
    return w if np.isfinite(w).all() and w.sum() > 0 else np.ones(n)


def lagged(values: np.ndarray, n_lags: int, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of n previous values plus extra columns, with their targets; both may lead with the axis of a stack."""
    n = values.shape[-1]
    before = values[..., np.arange(n_lags, n)[:, None] + np.arange(-n_lags, 0)]
    return np.ascontiguousarray(np.concatenate([before, extra[..., n_lags:n, :]], axis=-1)), np.ascontiguousarray(values[..., n_lags:])


def principal_mean(m: np.ndarray, t: int, lam: float | None):
    """Scale and mean of ``principal``."""
    mu, sd = scale_fit(m[:, :t])
    w = power_weights(t, lam)
    return mu, sd, ((m[:, :t] - mu[:, None]) / sd[:, None] * w[:, None]).sum(axis=-2) / w.sum()


def principal(m: np.ndarray, t: int, lam: float | None, k: int):
    """Scale, mean, directions and scores of the rows before t of each table (stack, rows, columns), recent rows weighted more."""
    mu, sd = scale_fit(m[:, :t])
    z = (m[:, :t] - mu[:, None]) / sd[:, None]
    mean, comps = weighted_pca(z, power_weights(t, lam), k)
    return mu, sd, mean, comps, (z - mean[:, None]) @ np.swapaxes(comps, -1, -2)


def score_forecasts(scores: np.ndarray, n_lags: int, extra: np.ndarray, alphas, alone: bool = False, best: np.ndarray | None = None) -> np.ndarray:
    """Next value of each row of ``scores`` (b, t) from its lags and its extra columns (b, years, f); 0 without a training row."""
    stack, t = scores.shape
    if t <= n_lags or not stack:
        return np.zeros(stack)
    x, y = lagged(scores, n_lags, extra)
    return ridge_loo_many(x, y, np.concatenate([scores[:, t - n_lags:], extra[:, t]], axis=1), alphas, alone, best)


def shares(curves: np.ndarray) -> np.ndarray:
    """Each curve (last axis) as parts of its total; equal parts where there is none."""
    total = curves.sum(axis=-1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(total > 0, curves / total, 1 / curves.shape[-1])


def growth_fit_many(g: np.ndarray, z: np.ndarray, penalty: float = 10.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(drift, rho, gamma) of next growth = drift + rho * growth + z gamma, drift >= 0, rho in [0, 1], for a stack of series.

    The quadratic's constrained optimum frees or fixes each bounded parameter: every such face is solved
    and the best feasible one kept. A single pair of growths holds rho at 0.5.
    """
    stack, n, width = len(g), g.shape[1] - 1, 2 + z.shape[2]
    y = g[:, 1:]
    full = np.concatenate([np.ones((stack, n, 1)), g[:, :-1, None], z[:, :n]], axis=2)
    reg = np.array([0.0, 0.0] + [penalty * n] * z.shape[2])
    faces = [({}, [0, 1]), ({1: 0.0}, [0]), ({1: 1.0}, [0]), ({0: 0.0}, [1]), ({0: 0.0, 1: 0.0}, []), ({0: 0.0, 1: 1.0}, [])]
    if n == 1:
        faces = [({1: 0.5}, [0]), ({0: 0.0, 1: 0.5}, [])]
    best, least, found = np.zeros((stack, width)), np.zeros(stack), np.zeros(stack, dtype=bool)
    for fixed, free in faces:
        cols = free + list(range(2, width))
        target = y - sum((v * full[:, :, j] for j, v in fixed.items()), np.zeros((stack, n)))
        beta = np.zeros((stack, width))
        for j, v in fixed.items():
            beta[:, j] = v
        if cols:
            a = full[:, :, cols]
            at = np.swapaxes(a, 1, 2)
            normal = zip(at @ a + np.diag(reg[cols]), (at @ target[:, :, None])[:, :, 0])
            beta[:, cols] = [np.linalg.lstsq(gram, moment, rcond=None)[0] for gram, moment in normal]
        feasible = ~(beta[:, 0] < -1e-12) & (-1e-12 <= beta[:, 1]) & (beta[:, 1] <= 1 + 1e-12)
        loss = ((y - (full @ beta[:, :, None])[:, :, 0]) ** 2).sum(axis=1) + (reg * beta ** 2).sum(axis=1)
        better = feasible & (~found | (loss < least - 1e-14))
        best[better], least[better] = beta[better], loss[better]
        found |= better
    return best[:, 0], best[:, 1], best[:, 2:]


def growth_fit(g: np.ndarray, z: np.ndarray, penalty: float = 10.0) -> tuple[float, float, np.ndarray]:
    """``growth_fit_many`` of one series."""
    drift, rho, gamma = growth_fit_many(g[None], z[None], penalty)
    return float(drift[0]), float(rho[0]), gamma[0]


def growth_forecast_many(a: np.ndarray, x: np.ndarray, x_next: np.ndarray) -> np.ndarray:
    """Next annual levels (b) of the mean-reverting growth model from (b, years), (b, years, f), (b, f); the inputs start in
    the second year."""
    g = np.diff(np.log(a), axis=1)
    mu, sd = scale_fit(x[:, 1:])
    z, z_next = (x[:, 1:] - mu[:, None]) / sd[:, None], (x_next - mu) / sd
    drift, rho, gamma = growth_fit_many(g, z)
    return a[:, -1] * np.exp(drift + rho * g[:, -1] + (z_next[:, None] @ gamma[:, :, None])[:, 0, 0])


def growth_forecast(a: np.ndarray, x: np.ndarray, x_next: np.ndarray) -> float:
    """``growth_forecast_many`` of one series."""
    return float(growth_forecast_many(a[None], x[None], x_next[None])[0])


def _least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The shortest least-squares solution of each of a stack (s, rows, columns), (s, rows), with the usual cut of singular values."""
    u, val, vt = np.linalg.svd(a, full_matrices=False)
    there = val > np.finfo(float).eps * max(a.shape[1:]) * val[:, :1]
    part = (b[:, None] @ u)[:, 0] * np.where(there, 1 / np.where(there, val, 1.0), 0.0)
    return (part[:, None] @ vt)[:, 0]


def ensemble_many(preds: np.ndarray, actual: np.ndarray, tau: float) -> np.ndarray:
    """(series, models, years, 12) to (series, years, 12): weights and upward bias of a year learned from earlier years only."""
    stack, k, years, _ = preds.shape
    out = np.zeros((stack, years, preds.shape[3]))
    for i in range(years):
        w, lam = np.full((stack, k), 1 / k), np.zeros(stack)
        if i:
            flat, real = preds[:, :, :i].reshape(stack, k, -1), actual[:, :i].reshape(stack, -1)
            raw = np.clip(_least_squares(np.swapaxes(flat, 1, 2), real), 0, None)
            total = raw.sum(axis=1, keepdims=True)
            w = np.where(np.isfinite(raw).all(axis=1, keepdims=True) & (total > 0), raw / np.where(total > 0, total, 1.0), w)
            lam = pinball_factors(real, (w[:, None] @ flat)[:, 0], tau)
        out[:, i] = (1 + lam)[:, None] * (w[:, :, None] * preds[:, :, i]).sum(axis=1)
    return out


def ensemble(preds: np.ndarray, actual: np.ndarray, tau: float) -> np.ndarray:
    """``ensemble_many`` of one series."""
    return ensemble_many(preds[None], actual[None], tau)[0]


def pinball_factors(y: np.ndarray, p: np.ndarray, tau: float) -> np.ndarray:
    """Weighted tau-quantile of y/p - 1 with weights p, of each row; 0 where no p serves."""
    ok = (p > 1e-8) & np.isfinite(p) & np.isfinite(y)
    z = np.where(ok, y / np.where(ok, p, 1.0) - 1, np.inf)
    order = np.argsort(z, axis=1, kind="stable")
    w = np.take_along_axis(np.where(ok, p, 0.0), order, axis=1)
    total, n = w.sum(axis=1, keepdims=True), ok.sum(axis=1)
    below = (np.cumsum(w, axis=1) / np.where(total > 0, total, 1.0) < tau).sum(axis=1)
    at = np.maximum(np.minimum(below, n - 1), 0)
    return np.where(n > 0, np.take_along_axis(z, np.take_along_axis(order, at[:, None], axis=1), axis=1)[:, 0], 0.0)


def pinball_factor(y: np.ndarray, p: np.ndarray, tau: float) -> float:
    """``pinball_factors`` of one row."""
    return float(pinball_factors(y[None], p[None], tau)[0])
