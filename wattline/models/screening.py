"""Which configurations of the short-term grid can be the best of their strategy, from the years that each predicts.

The selection reads a configuration's annual errors alone, and annual sums ask for less than months: strategies that spread a level over
a curve predict the level. So the years of the whole grid are found for a stack of series, by regressions in as many unknowns as a
series has years, and only configurations that rounding cannot tell from the best are back-tested by month.
"""

from __future__ import annotations

import numpy as np

from wattline.models import kernels as K

CLOSE = 1e-9   # errors of two alphas this close, of the targets' spread, may rank either way
MARGIN = 1e-8  # so may annual errors, of the months' size
EASY = 8       # systems up to this size are eliminated for a whole stack at once, larger ones one by one


def _forward(matrix, vectors):
    """Forward elimination of symmetric positive systems of a stack: ``matrix[i][j]`` (j <= i) and the entries of each vector are
    arrays that broadcast. The vectors times the inverse of the lower factor, the inverse pivots (v'M^-1 w is the
    sum of their products) and the factor times its pivots."""
    n = len(matrix)
    rows = [[matrix[i][j] for j in range(i + 1)] for i in range(n)]
    vectors = [list(v) for v in vectors]
    pivots = []
    for j in range(n):
        inverse = 1.0 / rows[j][j]
        pivots.append(inverse)
        factors = [rows[i][j] * inverse for i in range(j + 1, n)]
        for v in vectors:
            for i in range(j + 1, n):
                v[i] = v[i] - factors[i - j - 1] * v[j]
        for i in range(j + 1, n):
            for c in range(j + 1, i + 1):
                rows[i][c] = rows[i][c] - factors[i - j - 1] * rows[c][j]
    return vectors, pivots, rows


def _between(matrix, left, right):
    """left' M^-1 right for a stack of symmetric positive systems, as ``_forward`` takes them."""
    n = len(matrix)
    if n > EASY:
        full = np.broadcast_arrays(*[matrix[max(i, j)][min(i, j)] for i in range(n) for j in range(n)])
        full = np.moveaxis(np.stack(full).reshape(n, n, *full[0].shape), (0, 1), (-2, -1))
        ends = [np.moveaxis(np.stack(np.broadcast_arrays(*v)), 0, -1) for v in (left, right)]
        return (ends[0] * np.linalg.solve(full, np.broadcast_to(ends[1], full.shape[:-1])[..., None])[..., 0]).sum(axis=-1)
    (left, right), pivots, _ = _forward(matrix, (left, right))
    return sum((a * b * d for a, b, d in zip(left, right, pivots)), 0.0)


def _products(x: np.ndarray, at: np.ndarray):
    """Products of the scaled columns of (rows, columns, ...) with each other and with those of ``at`` (columns, ...), summed over columns."""
    mu = x.mean(axis=0)
    sd = np.sqrt(((x - mu) ** 2).mean(axis=0))
    sd = np.where(sd <= 1e-12 * np.maximum(1.0, np.abs(mu)), 1.0, sd)
    z, ahead = (x - mu) / sd, (at - mu) / sd
    return [[(z[i] * z[j]).sum(axis=0) for j in range(i + 1)] for i in range(len(z))], [(row * ahead).sum(axis=0) for row in z]


def _kept(n: int) -> np.ndarray:
    """(n - 1, n): the rows that stay when each of n is left out."""
    return np.array([[j for j in range(n) if j != i] for i in range(n)]).T


def column_products(x: np.ndarray, x_test: np.ndarray) -> list:
    """What columns (rows, columns, ...) give to a ridge: their products without each row, where there are three, and with all rows,
    against ``x_test`` (columns, ...). Sums of those of several sets of columns are those of all columns together."""
    n = len(x)
    # (kept row, column, left-out row, ...)
    out = [_products(np.moveaxis(x[_kept(n)], 1, 2), np.moveaxis(x, 0, 1))] if n >= 3 else [None]
    return [*out, _products(x, x_test)]


def add_products(*parts) -> list:
    """The sum of ``column_products``; None stands for no column."""
    parts = [p for p in parts if p is not None]
    if len(parts) == 1:
        return parts[0]

    def total(sets):
        if sets[0] is None:
            return None
        return ([[sum(c[1:], c[0]) for c in zip(*rows)] for rows in zip(*(s[0] for s in sets))], [sum(c[1:], c[0]) for c in zip(*(s[1] for s in sets))])

    return [total(sets) for sets in zip(*parts)]


def _predicted(y, products, alphas):
    """Ridge predictions at the test rows: the mean and what the inputs add, for ``alphas`` (leading axes of each entry)."""
    matrix, ahead = products
    mean = y.mean(axis=0)
    centred = [row - mean for row in y]
    matrix = [[c + alphas if i == j else c for j, c in enumerate(row)] for i, row in enumerate(matrix)]
    return mean + _between(matrix, ahead, centred)


def ridge(products: list, y: np.ndarray, alphas) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Ridge predictions (...) from ``column_products`` and targets (rows, ...), alpha of each problem by leave-one-out mean absolute
    error, as ``kernels.ridge_loo_many``; where rounding may decide between alphas; the positions of the alphas, None if all are the
    first. As many unknowns as rows, whatever the columns."""
    n, alphas = len(y), np.asarray(alphas, dtype=float)
    close = np.zeros(y.shape[1:], dtype=bool)
    best, at = alphas[0], None
    if n >= 3 and len(alphas) > 1:
        pred = _predicted(y[_kept(n)], products[0], alphas.reshape(len(alphas), *(1,) * y.ndim))
        off = np.abs(pred - y).sum(axis=1)
        first, second = np.partition(off, 1, axis=0)[:2]
        close = second - first < CLOSE * np.abs(y - y.mean(axis=0)).sum(axis=0)
        at = np.argmin(off, axis=0).astype(np.int8)
        best = alphas[at]
    return _predicted(y, products[1], best), close, at


def lag_products(values: np.ndarray, n_lags: int) -> list:
    """``column_products`` of the previous values of each row of (t, ...), against those of the row after the last."""
    t = len(values)
    return column_products(np.stack([values[k:t - n_lags + k] for k in range(n_lags)], axis=1), values[t - n_lags:])


def principal(m: np.ndarray, t: int, lam: float | None, k: int):
    """Scale, mean, directions and scores of the rows before t of each table (stack, rows, columns), as ``kernels.principal`` gives them
    but for signs and for directions in which nothing varies; where rounding may choose the directions; where all vary.

    Rows about their weighted mean span at most t - 1 directions, so the products of the rows have them all.
    """
    mu, sd = K.scale_fit(m[:, :t])
    z = (m[:, :t] - mu[:, None]) / sd[:, None]
    w = K.power_weights(t, lam)
    mean = (z * w[:, None]).sum(axis=-2) / w.sum()
    away = z - mean[:, None]
    c = away * np.sqrt(w / w.sum())[:, None]
    k = min(k, t - 1, m.shape[2])
    val, vec = np.linalg.eigh(c @ np.swapaxes(c, -1, -2))
    val, vec = val[:, ::-1], vec[:, :, ::-1][:, :, :k]
    there = val[:, :k] > 1e-13 * val[:, :1]
    unsure = (there & ((val[:, :k] - val[:, 1:k + 1] < 1e-6 * val[:, :1]) | (val[:, :k] < 1e-8 * val[:, :1]))).any(axis=1) | (w.min() <= 1e-9 * w.max())
    comps = np.swapaxes(vec, -1, -2) @ c * np.where(there, 1 / np.sqrt(np.where(there, val[:, :k], 1.0)), 0.0)[:, :, None]
    return mu, sd, mean, comps, away @ np.swapaxes(comps, -1, -2), unsure, there.all(axis=1)


def growth_fit(g: np.ndarray, z: np.ndarray, penalty: float = 10.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``kernels.growth_fit_many``: the inputs are penalised, so with them solved for, what is left is least squares in drift and
    rho, weighted by the inverse of I + z z' / penalty. Series whose growths are all but alike go to the former."""
    stack, n = len(g), g.shape[1] - 1
    if not 1 <= n <= EASY or not stack:
        return K.growth_fit_many(g, z, penalty)
    y, prev, reg = g[:, 1:], g[:, :-1], penalty * n
    used = z[:, :n]
    near = used @ np.swapaxes(used, 1, 2) / reg
    matrix = [[near[:, i, j] + (i == j) for j in range(i + 1)] for i in range(n)]
    (one, last, target), pivots, lower = _forward(matrix, (np.ones((n, stack)), prev.T, y.T))

    def product(a, b):
        return sum(p * q * d for p, q, d in zip(a, b, pivots))

    s11, s1g, sgg, s1y, sgy = product(one, one), product(one, last), product(last, last), product(one, target), product(last, target)
    free, zero = np.ones(stack), np.zeros(stack)
    faces = [(s1y / s11, zero), ((s1y - s1g) / s11, free), (zero, None), (zero, zero), (zero, free)]
    bad = zero > 0
    if n == 1:
        faces = [((s1y - 0.5 * s1g) / s11, 0.5 * free), (zero, 0.5 * free)]
    else:
        det = s11 * sgg - s1g * s1g
        bad = ~(det > 1e-8 * s11 * sgg) | ~(sgg > 1e-8)
        det, over = np.where(bad, 1.0, det), np.where(bad, 1.0, sgg)
        faces[2] = (zero, sgy / over)
        faces = [((s1y * sgg - s1g * sgy) / det, (s11 * sgy - s1g * s1y) / det), *faces]
    drift, rho, least, found = zero, zero, zero, zero > 0
    for d, r in faces:
        feasible = ~(d < -1e-12) & (-1e-12 <= r) & (r <= 1 + 1e-12)
        loss = sum((t - d * a - r * b) ** 2 * p for t, a, b, p in zip(target, one, last, pivots))
        better = feasible & (~found | (loss < least - 1e-14))
        drift, rho, least = np.where(better, d, drift), np.where(better, r, rho), np.where(better, loss, least)
        found = found | better
    rest = [None] * n  # what drift and rho leave, by the inverse of the weights: back from the lower factor
    for i in range(n - 1, -1, -1):
        rest[i] = (target[i] - drift * one[i] - rho * last[i] - sum((lower[j][i] * rest[j] for j in range(i + 1, n)), 0.0)) * pivots[i]
    gamma = (np.swapaxes(used, 1, 2) @ np.stack(rest, axis=1)[:, :, None])[:, :, 0] / reg
    if bad.any():
        drift[bad], rho[bad], gamma[bad] = K.growth_fit_many(g[bad], z[bad], penalty)
    return drift, rho, gamma


def growth_forecast(a: np.ndarray, x: np.ndarray, x_next: np.ndarray) -> np.ndarray:
    """``kernels.growth_forecast_many``."""
    g = np.diff(np.log(a), axis=1)
    mu, sd = K.scale_fit(x[:, 1:])
    z, z_next = (x[:, 1:] - mu[:, None]) / sd[:, None], (x_next - mu) / sd
    drift, rho, gamma = growth_fit(g, z)
    return a[:, -1] * np.exp(drift + rho * g[:, -1] + (z_next * gamma).sum(axis=1))


class Years:
    """Annual predictions of the grid for series of one length; the arrays are those of ``short_term._Batch``."""

    def __init__(self, batch, configs):
        self.b, self.configs = batch, configs
        series, years = batch.annual.shape
        shape = (series, len(configs), years)
        self.there, self.pred, self.size = np.zeros(shape, dtype=bool), np.zeros(shape), np.zeros(shape)
        self.unsure, self.plain = np.zeros(series, dtype=bool), np.ones(series, dtype=bool)
        self.alphas: dict[tuple, np.ndarray] = {}  # their positions, by fold, lags and inputs
        keys = [(c["block"], bool(c["use_clients"]), bool(c["use_pf"])) for c in configs]
        for lags in sorted({c["n_lags"] for c in configs if c["strategy"] != 4}):
            of = {s: [j for j, c in enumerate(configs) if c["strategy"] == s and c["n_lags"] == lags] for s in (1, 2, 3)}
            for t in range(lags, years):
                self._lagged(t, lags, keys, of)
        late = [j for j, c in enumerate(configs) if c["strategy"] == 4]
        for t in range(3, years):
            self._grown(t, late, keys)

    def _set(self, j: int, t: int, pred, size, there=True) -> None:
        self.there[:, j, t], self.pred[:, j, t], self.size[:, j, t] = there, pred, size

    def _lagged(self, t: int, lags: int, keys, of) -> None:
        sets = list(dict.fromkeys(keys[j] for j in of[1] + of[3]))
        found = self._patterns(t, lags, sets) if sets else {}
        for j in of[1]:
            self._set(j, t, *found[keys[j]][self.configs[j]["lam"]])
        if t > lags:
            levels = self._levels(t, lags, list(dict.fromkeys(keys[j] for j in of[2] + of[3])))
            for j in of[2]:
                self._set(j, t, levels[keys[j]], np.abs(levels[keys[j]]))
            for j in of[3]:
                total, size = found[keys[j]][self.configs[j]["lam"]]
                with np.errstate(all="ignore"):
                    wide = np.where(total != 0, size / np.abs(total), 1.0)
                self.unsure |= (np.abs(total) <= CLOSE * size) & (size > 0)
                self._set(j, t, levels[keys[j]], np.abs(levels[keys[j]]) * (1 + wide))

    def _levels(self, t: int, lags: int, sets) -> dict:
        """Annual levels by set of inputs; a column that a set lacks is zero, which adds nothing to a scaled regression."""
        b = self.b
        values = np.concatenate([b.exog, b.clients.sum(axis=2, keepdims=True), b.power.sum(axis=2, keepdims=True)], axis=2)
        one = [column_products(np.ascontiguousarray(values[:, lags:t, [i]].transpose(1, 2, 0)), values[:, t, [i]].T) for i in range(values.shape[2])]
        annual = np.ascontiguousarray(b.annual.T)
        own, out = lag_products(annual[:t], lags), {}
        for block, clients, power in sets:
            inputs = block, clients, power
            out[inputs], close, at = ridge(add_products(own, *(one[i] for i in (*block, *[-2] * clients, *[-1] * power))), annual[lags:t], b.alphas)
            self.unsure |= close
            if at is not None:
                self.alphas["level", t, lags, inputs] = at
        return out

    def _patterns(self, t: int, lags: int, sets) -> dict:
        """Annual sums of the months of fold t, and the sums of what they are made of, by set of inputs and lambda."""
        b = self.b
        parts = [b._once(("near", t, lam), lambda lam=lam: principal(b.m, t, lam, b.n_pcs)) for lam in b.lambdas]
        for p in parts:
            self.unsure |= p[5]
            if t >= lags + 3:
                self.plain &= p[6]
        base = [p[2] * p[1] + p[0] for p in parts]
        base = [(x.sum(axis=1), np.abs(x).sum(axis=1)) for x in base]
        scores = np.ascontiguousarray(np.stack([p[4] for p in parts]).transpose(2, 3, 0, 1))  # year, component, lambda, series
        if t <= lags or not scores.shape[1]:
            return {s: dict(zip(b.lambdas, base)) for s in sets}
        turn = np.stack([p[3] * p[1][:, None] for p in parts])  # lambda, series, component, month
        turn, wide = (x.transpose(2, 0, 1) for x in (turn.sum(axis=3), np.abs(turn).sum(axis=3)))
        own = lag_products(scores[:, :1], lags), lag_products(scores[:, 1:], lags) if scores.shape[1] > 1 else None

        def inputs(values):
            return column_products(np.ascontiguousarray(values[:, lags:t].transpose(1, 2, 0))[:, :, None, None], np.ascontiguousarray(values[:, t].T)[:, None, None])

        one, firsts, out = {}, {}, {}
        for block, clients, power in sets:
            for name, used, values in (*((j, True, b.exog[:, :, [j]]) for j in block), ("clients", clients, b.clients), ("power", power, b.power)):
                if used and name not in one:
                    one[name] = inputs(values)
            if block not in firsts:
                firsts[block], close, at = ridge(add_products(own[0], *(one[j] for j in block)), scores[lags:, :1], b.alphas)
                self.unsure |= close.any(axis=(0, 1))
                if at is not None:
                    self.alphas["first", t, lags, block] = at
            ahead = firsts[block]
            if own[1] is not None:
                rest, close, at = ridge(add_products(own[1], *(one[n] for n in (*block, *["clients"] * clients, *["power"] * power))), scores[lags:, 1:], b.alphas)
                self.unsure |= close.any(axis=(0, 1))
                ahead = np.concatenate([ahead, rest])
                if at is not None and scores.shape[1] == b.n_pcs:
                    self.alphas["rest", t, lags, (block, clients, power)] = at
            total, size = (ahead * turn).sum(axis=0), (np.abs(ahead) * wide).sum(axis=0)
            out[block, clients, power] = {lam: (total[i] + base[i][0], size[i] + base[i][1]) for i, lam in enumerate(b.lambdas)}
        return out

    def _grown(self, t: int, late, keys) -> None:
        b = self.b
        for first in sorted({max(0, t - self.configs[j]["window"]) for j in late}):
            if t - first < 3:
                continue
            ok = ~(b.annual[:, first:t] <= 0).any(axis=1)
            if not ok.any():
                continue
            of = [j for j in late if max(0, t - self.configs[j]["window"]) == first]
            sets = list(dict.fromkeys((keys[j][0], keys[j][2] and bool(keys[j][0])) for j in of))
            every = np.concatenate([b.growth[ok], b.power[ok].sum(axis=2, keepdims=True)], axis=2)
            used = np.array([[i in block for i in range(every.shape[2] - 1)] + [power] for block, power in sets])
            x = (every[None] * used[:, None, None]).reshape(-1, *every.shape[1:])
            got = growth_forecast(np.tile(b.annual[ok, first:t], (len(sets), 1)), x[:, first:t], x[:, t]).reshape(len(sets), -1)
            level = dict(zip(sets, got))
            for j in of:
                row = np.zeros(len(ok))
                row[ok] = level[keys[j][0], keys[j][2] and bool(keys[j][0])]
                self._set(j, t, row, np.abs(row), ok)

    def possible(self, threshold: float, placeholder_year) -> tuple[np.ndarray, np.ndarray]:
        """Which configurations (series, configurations) can be the best of their strategy, all of a series in doubt; the series without."""
        b, strategies = self.b, np.array([c["strategy"] for c in self.configs])
        use = self.there & (b.years != (-1 if placeholder_year is None else placeholder_year))[:, None]
        actual = b.annual[:, None]
        n = use.sum(axis=2)
        with np.errstate(all="ignore"):
            a, size = np.where(use, actual, 0.0), np.where(use, self.size + np.abs(actual), 0.0)
            off = np.where(use, np.abs(actual - self.pred), 0.0)
            mean = a.sum(axis=2) / n
            sst = (a * a).sum(axis=2) - n * mean * mean
            known = (n >= 2) & (sst > 1e-9 * mean * mean)
            doubt = (n >= 2) & (np.abs(sst - 1e-9 * mean * mean) <= 1e-12 * (a * a).sum(axis=2))
            mae, mae_margin = off.sum(axis=2) / n, MARGIN * size.sum(axis=2) / n
            r2 = np.where(known, 1 - (off * off).sum(axis=2) / sst, -np.inf)
            r2_margin = np.where(known, MARGIN * (size * size).sum(axis=2) / sst, 0.0)
        unsure = self.unsure | doubt.any(axis=1) | ~np.isfinite(self.pred).all(axis=(1, 2)) | ~np.isfinite(self.size).all(axis=(1, 2)) | ~np.isfinite(b.m).all(axis=(1, 2))
        there = self.there.any(axis=2)
        out = np.zeros(there.shape, dtype=bool)
        for s in np.unique(strategies):
            at = np.flatnonzero(strategies == s)
            has = there[:, at]
            maybe = has & (r2[:, at] + r2_margin[:, at] >= threshold)
            surely = has & (r2[:, at] - r2_margin[:, at] >= threshold)
            top = np.where(surely, mae[:, at] + mae_margin[:, at], np.inf).min(axis=1, keepdims=True)
            by_loss = maybe & (mae[:, at] - mae_margin[:, at] <= top)
            some = has & known[:, at]
            best = np.where(some, r2[:, at] - r2_margin[:, at], -np.inf).max(axis=1, keepdims=True)
            by_r2 = some & (r2[:, at] + r2_margin[:, at] >= best)
            first = has & (np.cumsum(has, axis=1) == 1)  # without any error to compare: grid order
            out[:, at] = by_loss | np.where(surely.any(axis=1, keepdims=True), False, np.where(some.any(axis=1, keepdims=True), by_r2, first))
        for j, c in enumerate(self.configs):  # power alone is no input of the growth model: the first of two alike
            if c["strategy"] == 4 and not c["block"]:
                for i in range(j):
                    if {**self.configs[i], "use_pf": c["use_pf"], "ordinal": c["ordinal"]} == c:
                        out[:, j] &= ~out[:, i]
        out[unsure] = there[unsure]
        return out, ~unsure
