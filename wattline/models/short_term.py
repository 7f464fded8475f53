"""Short-term forecasts: a grid of four strategies back-tested for every series in one job.

Spark packs a series into one row (years, 12-month matrix, features). Tasks take the series of a length
together through the whole configuration grid, in array operations over all of them; metrics, selection,
ensemble inputs and intervals are DataFrame expressions. The only shuffles key on the series.
"""

from __future__ import annotations

from copy import copy
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wattline import names as N
from wattline.models import kernels as K, screening
from wattline.operators.metrics import select_best

# Shipped settings of the regional runs.
REGIONAL_GRID = {
    "blocks": {"none": [], "gdp_only": [0], "sectoral_only": [1, 2, 3], "gdp_sectoral": [0, 1, 2, 3]},
    "lags": [2, 3], "lambdas": [0.3, 0.7, 1.0], "pc_weights": [0.2, 0.5], "windows": [4, 7, 10],
    "client_weights": [0.3, 0.5, 0.8], "use_clients": [False], "use_pf": [False],
}
# The same with and without the forecasts of the region's contracts.
REGIONAL_CLIENT_GRID = {**REGIONAL_GRID, "use_clients": [True, False]}
# Shipped settings of the contract runs.
CONTRACT_GRID = {**REGIONAL_GRID, "lags": [1, 2], "lambdas": [0.2, 0.3, 0.4], "pc_weights": [0.5, 0.8], "windows": [1, 2, 3, 4],
                 "use_pf": [True, False]}
REGIONAL_ALPHAS = (0.1, 1.0, 10.0)
CONTRACT_ALPHAS = (0.01, 0.1, 1.0, 10.0)
N_PCS = 3
DECAY = 0.1

_GRID_SCHEMA = ("strategy int, ordinal int, n_lags int, block array<int>, block_name string, lam double, pc_weight double, window int, "
                "use_clients boolean, client_weight double, use_pf boolean")


def grid_frame(spark: SparkSession, grid: dict = REGIONAL_GRID) -> DataFrame:
    """All configurations in grid order; the ordinal breaks ties."""
    rows: list[tuple] = []
    for lags, (name, block), lam, clients, pf in product(grid["lags"], grid["blocks"].items(), grid["lambdas"], grid["use_clients"], grid["use_pf"]):
        rows.append((1, lags, block, name, lam, None, None, clients, None, pf))
    for lags, (name, block), clients, pf in product(grid["lags"], grid["blocks"].items(), grid["use_clients"], grid["use_pf"]):
        for w in (grid["client_weights"] if clients else [None]):
            rows.append((2, lags, block, name, None, None, None, clients, w, pf))
    for pcw, lags, (name, block), lam, clients, pf in product(grid["pc_weights"], grid["lags"], grid["blocks"].items(), grid["lambdas"],
                                                               grid["use_clients"], grid["use_pf"]):
        for w in (grid["client_weights"] if clients else [None]):
            rows.append((3, lags, block, name, lam, pcw, None, clients, w, pf))
    for window, (name, block), clients, pf in product(grid["windows"], grid["blocks"].items(), grid["use_clients"], grid["use_pf"]):
        for w in (grid["client_weights"] if clients else [None]):
            rows.append((4, None, block, name, None, None, window, clients, w, pf))
    return spark.createDataFrame([(r[0], i, *r[1:]) for i, r in enumerate(rows)], _GRID_SCHEMA)


def pack_series(monthly: DataFrame, keys, value: str, features: DataFrame | None = None, feature_cols=(), growth: DataFrame | None = None,
                growth_cols=(), clients: DataFrame | None = None, power: str | None = None, feature_keys=(), fill_gaps: bool = False) -> DataFrame:
    """One row per series: sorted years, year-by-month matrix and aligned feature arrays.

    A month the series never has is 0; a month missing in some year only leaves the series out, because
    the models need whole years (``fill_gaps`` reads such a month as 0 instead). Absent features are 0.
    At most twelve values per year enter a row.
    """
    on = [*keys, N.ANNEE]
    cells = [F.sum(F.when(F.col(N.MOIS) == m, F.col(value))).alias(f"_m{m}") for m in N.MONTHS]
    if power:
        cells += [F.coalesce(F.sum(F.when(F.col(N.MOIS) == m, F.col(power))), F.lit(0.0)).alias(f"_p{m}") for m in N.MONTHS]
    wide = monthly.groupBy(*on).agg(*cells)

    def zeros(c, width):
        return F.coalesce(c, F.array_repeat(F.lit(0.0), width))

    def attach(df, other, cols, out):
        if other is None or not cols:
            return df.withColumn(out, F.array().cast("array<double>"))
        fk = [*(feature_keys or []), N.ANNEE]
        rows = other.select(*fk, F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols]).alias(out))
        return df.join(rows, fk, "left").withColumn(out, zeros(F.col(out), len(cols)))

    wide = attach(attach(wide, features, feature_cols, "_x"), growth, growth_cols, "_g")
    if clients is not None:
        wide = wide.join(clients.select(*on, F.col("valeurs").alias("_c")), on, "left").withColumn("_c", zeros(F.col("_c"), 12))
    else:
        wide = wide.withColumn("_c", F.array_repeat(F.lit(0.0), 12))
    months = F.array(*[F.col(f"_m{m}") for m in N.MONTHS])
    powers = F.array(*[F.col(f"_p{m}") for m in N.MONTHS]) if power else F.array_repeat(F.lit(0.0), 12)
    packed = wide.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(N.ANNEE).alias("y"), months.alias("m"), F.col("_x").alias("x"), F.col("_g").alias("g"),
                                             F.col("_c").alias("c"), powers.alias("p")))).alias("_s"),
        *[F.count(f"_m{m}").alias(f"_n{m}") for m in N.MONTHS], F.count(F.lit(1)).alias("_years"))
    whole = F.lit(True)
    for m in N.MONTHS:
        whole = whole & ((F.col(f"_n{m}") == 0) | (F.col(f"_n{m}") == F.col("_years")))
    return (packed if fill_gaps else packed.filter(whole)).select(
        *keys, F.col("_s.y").alias("years"),
        F.transform("_s.m", lambda year: F.transform(year, lambda v: F.coalesce(v, F.lit(0.0)))).alias("matrix"),
        F.col("_s.x").alias("exog"), F.col("_s.g").alias("growth"), F.col("_s.c").alias("clients"), F.col("_s.p").alias("power"))


def _stack(values) -> np.ndarray:
    return np.array([np.asarray(v, dtype=float) for v in values])


def _flat(column) -> np.ndarray:
    """Numbers of a column of nested lists, in order."""
    while pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        column = column.flatten()
    return column.to_numpy(zero_copy_only=False)


def _tensors(rows, columns) -> list[np.ndarray]:
    """Arrays (series, years, width) of columns of series of one length, from rows or an Arrow batch."""
    if isinstance(rows, pa.RecordBatch):
        years = len(rows.column("years")[0])
        return [_flat(rows.column(c)).astype(float).reshape(rows.num_rows, years, -1) for c in columns]
    return [np.stack([_stack(getattr(r, c)) for r in rows]) for c in columns]


def _nested(values: np.ndarray, counts) -> pa.Array:
    """Lists of ``counts`` rows of (rows, 12), or of (rows), as an Arrow column."""
    inner = pa.array(np.ascontiguousarray(values).ravel())
    if values.ndim == 2:
        inner = pa.ListArray.from_arrays(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32), inner)
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), inner)


def _result(rows, at: np.ndarray, keys, strategy: np.ndarray, ordinal: np.ndarray, years, preds, actuals, counts) -> pa.RecordBatch:
    """Back-tests of the series ``at`` of an Arrow batch, each with its count of folds."""
    taken = rows.select(list(keys)).take(pa.array(at))
    return pa.RecordBatch.from_arrays(
        [*taken.columns, pa.array(strategy, pa.int32()), pa.array(ordinal, pa.int32()), _nested(years.astype(np.int64), counts), _nested(preds, counts),
         _nested(actuals, counts)], [*keys, "strategy", "ordinal", "annees", "predictions", "actuals"])


TOGETHER = 256  # series of a length that share array operations


class _Batch:
    """Series of one length with what their configurations share: components by (fold, lambda), regressions by (fold, lags, inputs)."""

    def __init__(self, rows, lambdas, alphas, n_pcs: int):
        self.m, self.exog, self.growth, self.clients, self.power = _tensors(rows, ("matrix", "exog", "growth", "clients", "power"))
        self.years = _flat(rows.column("years")).reshape(len(self.m), -1) if isinstance(rows, pa.RecordBatch) else np.array([np.asarray(r.years) for r in rows])
        self.annual = self.m.sum(axis=2)
        self.lambdas, self.alphas, self.n_pcs = lambdas, alphas, n_pcs
        self._known: dict[tuple, object] = {}
        self.known_alphas: dict[tuple, np.ndarray] = {}  # positions of alphas by fold, lags and inputs, the series last

    def some(self, at: np.ndarray, lambdas=None) -> _Batch:
        """The series ``at`` as a batch of their own; with known alphas lambdas stand alone, so those not asked for can go."""
        out = copy(self)
        for name in ("m", "exog", "growth", "clients", "power", "years", "annual"):
            setattr(out, name, getattr(self, name)[at])
        out._known = {}
        out.known_alphas = {k: v[..., at] for k, v in self.known_alphas.items()}
        if lambdas is not None:
            where = [self.lambdas.index(lam) for lam in lambdas]
            out.lambdas = lambdas
            out.known_alphas = {k: v if k[0] == "level" else v[:, where] for k, v in out.known_alphas.items()}
        return out

    def _alphas(self, *key):
        """Known positions of alphas in the order of series, lambdas, components."""
        at = self.known_alphas.get(key)
        return None if at is None else np.ravel(at.T)

    def _once(self, key: tuple, make):
        if key not in self._known:
            self._known[key] = make()
        return self._known[key]

    def inputs(self, block: tuple, clients: bool, power: bool, monthly: bool) -> np.ndarray:
        """Columns of a regression: features, then client forecasts and billed power, by month or as yearly sums."""
        parts = [self.exog[:, :, list(block)] if block else np.zeros((*self.annual.shape, 0))]
        for used, values in ((clients, self.clients), (power, self.power)):
            if used:
                parts.append(values if monthly else values.sum(axis=2, keepdims=True))
        return np.concatenate(parts, axis=2)

    def level(self, t: int, lags: int, block: tuple, clients: bool, power: bool):
        """Annual levels of fold t from their lags and inputs; None without a training row."""
        if t <= lags:
            return None
        return self._once(("level", t, lags, block, clients, power), lambda: K.score_forecasts(
            self.annual[:, :t], lags, self.inputs(block, clients, power, False), self.alphas, alone=True, best=self._alphas("level", t, lags, (block, clients, power))))

    def grown(self, t: int, window: int, block: tuple, power: bool):
        """Annual levels of fold t by the growth model and the series that have one; None if the window is too short for all."""
        first = max(0, t - window)
        if t - first < 3:
            return None

        def make():
            ok = ~(self.annual[:, first:t] <= 0).any(axis=1)
            level = np.zeros(len(ok))
            if ok.any():
                g = self.growth[ok][:, :, list(block)] if block else np.zeros((ok.sum(), self.m.shape[1], 0))
                if block and power:
                    g = np.concatenate([g, self.power[ok].sum(axis=2, keepdims=True)], axis=2)
                level[ok] = K.growth_forecast_many(self.annual[ok, first:t], g[:, first:t], g[:, t])
            return level, ok

        return self._once(("grown", t, first, block, power and bool(block)), make)

    def patterns(self, t: int, lags: int, block: tuple, clients: bool, power: bool) -> dict:
        """The twelve months of fold t for every lambda: one stack of regressions for all of them and all series."""
        def make():
            if t <= lags:  # nothing to learn from: the mean of the years before
                means = [K.principal_mean(self.m, t, lam) for lam in self.lambdas]
                return {lam: (0.0 + mean) * sd + mu for lam, (mu, sd, mean) in zip(self.lambdas, means)}
            parts = [self._once(("pca", t, lam), lambda lam=lam: K.principal(self.m, t, lam, self.n_pcs)) for lam in self.lambdas]
            scores = np.stack([np.swapaxes(p[4], 1, 2) for p in parts], axis=1)  # series, lambda, component, year
            stack, lams, comps = scores.shape[:3]
            firsts = self._once(("first", t, lags, block), lambda: K.score_forecasts(
                scores[:, :, 0].reshape(-1, t), lags, np.repeat(self.inputs(block, False, False, True), lams, axis=0), self.alphas,
                alone=lams == 1, best=self._alphas("first", t, lags, block))).reshape(stack, lams, 1)
            rest = K.score_forecasts(scores[:, :, 1:].reshape(-1, t), lags, np.repeat(self.inputs(block, clients, power, True), lams * (comps - 1), axis=0),
                                     self.alphas, alone=lams * (comps - 1) == 1, best=self._alphas("rest", t, lags, (block, clients, power))).reshape(
                                         stack, lams, comps - 1)
            ahead = np.concatenate([firsts, rest], axis=2)
            return {lam: ((ahead[:, i, None] @ comps)[:, 0] + mean) * sd + mu for i, (lam, (mu, sd, mean, comps, _)) in enumerate(zip(self.lambdas, parts))}

        return self._once(("pattern", t, lags, block, clients, power), make)

    def fold(self, c: dict, t: int):
        """Predicted months of fold t under one configuration (series, 12) and the series that have them; None if none has."""
        strategy, block, clients, power = c["strategy"], c["block"], bool(c["use_clients"]), bool(c["use_pf"])
        every = np.ones(len(self.m), dtype=bool)
        pattern = self.patterns(t, c["n_lags"], block, clients, power)[c["lam"]] if strategy in (1, 3) else None
        if strategy == 1:
            return pattern, every
        got = self.grown(t, c["window"], block, power) if strategy == 4 else self.level(t, c["n_lags"], block, clients, power)
        if got is None:
            return None
        level, ok = got if strategy == 4 else (got, every)
        if strategy == 3:
            recent = np.exp(-DECAY * (self.years[:, t, None] - self.years[:, :t]))
            curve = self._once(("recent", t), lambda: K.shares((recent[:, None] @ self.m[:, :t])[:, 0]))
        else:
            first = max(0, t - c["window"]) if strategy == 4 else 0
            curve = self._once(("mean", first, t), lambda: K.shares(self.m[:, first:t].mean(axis=1)))
        if clients:
            mixed = (1 - c["client_weight"]) * curve + c["client_weight"] * K.shares(self.clients[:, t])
            curve = np.where(self.clients[:, t].sum(axis=1, keepdims=True) > 0, mixed, curve)
        if strategy == 3:
            curve = c["pc_weight"] * K.shares(pattern) + (1 - c["pc_weight"]) * curve
        return level[:, None] * curve, ok

    def predictions(self, configs, strict: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Predicted months (series, configurations, years, 12) and which folds there are. A configuration that cannot be
        solved for a single series has none; in a stack, or with ``strict``, the error is raised, because it says nothing of the others."""
        series, years = self.annual.shape
        out, there = np.zeros((series, len(configs), years, 12)), np.zeros((series, len(configs), years), dtype=bool)
        for i, c in enumerate(configs):
            try:
                for t in range(3 if c["strategy"] == 4 else c["n_lags"], years):
                    got = self.fold(c, t)
                    if got is not None:
                        out[:, i, t], there[:, i, t] = got
            except np.linalg.LinAlgError:
                if series > 1 or strict:
                    raise
                there[:, i] = False
        return out, there


def _candidates(batch: _Batch, preds: np.ndarray, there: np.ndarray, strategies: np.ndarray, threshold: float, placeholder_year) -> np.ndarray:
    """Which back-tests (series, configurations) can be the best of their strategy, by the sums and the order of ``score`` and
    ``select_best``: one each, or all of a series with values that are not finite."""
    counted = there & (batch.years != (-1 if placeholder_year is None else placeholder_year))[:, None]
    pred, actual = np.zeros(there.shape), np.zeros(batch.annual.shape)
    for m in range(12):
        pred, actual = pred + preds[..., m], actual + batch.m[..., m]
    finite = np.isfinite(preds).all(axis=(1, 2, 3)) & np.isfinite(batch.m).all(axis=(1, 2))
    n = counted.sum(axis=2)
    total, squares, off, off2 = (np.zeros(n.shape) for _ in range(4))
    with np.errstate(all="ignore"):
        for t in range(there.shape[2]):
            use, a = counted[:, :, t], actual[:, None, t]
            err = a - pred[:, :, t]
            for sums, x in ((total, a), (squares, a * a), (off, np.abs(err)), (off2, err * err)):
                np.add(sums, x, out=sums, where=use)
        mean = total / n
        sst = squares - n * mean * mean
        known = (n >= 2) & (sst > 1e-9 * mean * mean)
        r2 = np.where(known, 1 - off2 / sst, 0.0)
        passed = known & (r2 >= threshold)
        mae = np.where(passed, off / n, 0.0)
    keep = np.repeat(~finite[:, None], there.shape[1], axis=1)
    for s in np.unique(strategies):
        at = np.flatnonzero(strategies == s)  # in grid order
        order = np.lexsort((np.broadcast_to(at, (len(n), len(at))), -r2[:, at], ~known[:, at], mae[:, at], ~passed[:, at], ~there[:, at].any(axis=2)), axis=-1)
        keep[np.arange(len(n)), at[order[:, 0]]] = True
    return keep & there.any(axis=2)


def _best_of_grid(batch: _Batch, configs, strategies: np.ndarray, threshold: float, placeholder_year):
    """Back-tests that ``_candidates`` keeps of the whole grid, as (series, configuration, folds, predictions): configurations that
    screening leaves are back-tested as the whole grid would be. One that cannot be solved raises an error."""
    every, left, plain, alphas = np.arange(len(batch.m)), [], [], []
    for start in range(0, len(every), TOGETHER):
        years = screening.Years(batch.some(every[start:start + TOGETHER]), configs)
        possible, sure = years.possible(threshold, placeholder_year)
        left.append(possible)
        plain.append(sure & years.plain)
        alphas.append(years.alphas)
    left, plain = np.concatenate(left), np.concatenate(plain)
    known = {k: np.concatenate([x[k] for x in alphas], axis=-1) for k in alphas[0]}
    for s in np.unique(strategies):
        of = np.flatnonzero(strategies == s)
        sets, which = np.unique(np.concatenate([left[:, of], plain[:, None]], axis=1), axis=0, return_inverse=True)
        for k, chosen in enumerate(sets):
            alike, those = np.flatnonzero(which.ravel() == k), of[chosen[:-1]]
            batch.known_alphas = known if chosen[-1] else {}
            lambdas = sorted({configs[j]["lam"] for j in those} - {None}) if chosen[-1] else None
            for start in range(0, len(alike) if len(those) else 0, TOGETHER):
                at = alike[start:start + TOGETHER]
                some = batch.some(at, lambdas)
                preds, there = some.predictions([configs[j] for j in those], strict=True)
                i, j = np.nonzero(_candidates(some, preds, there, strategies[those], threshold, placeholder_year))
                yield at[i], those[j], there[i, j], preds[i, j]


def fold_predictions(packed: DataFrame, grid: DataFrame, keys, alphas=REGIONAL_ALPHAS, n_pcs: int = N_PCS, best: tuple | None = None) -> DataFrame:
    """Back-test every series under every configuration; one output row per pair that has a fold.

    A series goes to Python once; up to ``TOGETHER`` series of a length go through the whole grid in common, so that their
    configurations share fits and an array operation serves them all. The grid's size is set by the run's options, so it
    travels in the closure. The number of tasks is fixed: a series is few bytes and much work. With ``best`` (threshold
    and placeholder year of ``best_per_strategy``) only the rows that it can choose leave the task.
    """
    types = dict(packed.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + (
        ", strategy int, ordinal int, annees array<bigint>, predictions array<array<double>>, actuals array<array<double>>")
    configs = sorted(({**c.asDict(), "block": tuple(c.block)} for c in grid.collect()), key=lambda c: c["ordinal"])
    lambdas = sorted({c["lam"] for c in configs if c["lam"] is not None})
    strategies, ordinals = np.array([c["strategy"] for c in configs]), np.array([c["ordinal"] for c in configs])

    def result(rows, batch, i, j, at, preds):
        return _result(rows, i, keys, strategies[j], ordinals[j], batch.years[i][at], preds[at], batch.m[i][at], at.sum(axis=1))

    def tested(rows, screened: bool):
        batch = _Batch(rows, lambdas, list(alphas), n_pcs)
        try:
            if screened:
                yield from [result(rows, batch, *found) for found in _best_of_grid(batch, configs, strategies, *best)]
                return
            preds, there = batch.predictions(configs)
        except np.linalg.LinAlgError:
            for i in range(rows.num_rows):
                yield from tested(rows.slice(i, 1), False)
            return
        keep = there.any(axis=2) if best is None else _candidates(batch, preds, there, strategies, *best)
        for i, own in enumerate(keep):  # the whole grid of a series is large enough for one batch
            j = np.flatnonzero(own)
            yield result(rows, batch, np.full(len(j), i), j, there[i, j], preds[i, j])

    def run(batches):
        for rows in batches:
            lengths = np.array([len(y) for y in rows.column("years")])
            for n in np.unique(lengths):
                same = np.flatnonzero(lengths == n)
                size = len(same) if best is not None else TOGETHER  # few series share what screening leaves
                for i in range(0, len(same), size):
                    yield from tested(rows.take(pa.array(same[i:i + size])), best is not None)

    tasks = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return packed.repartition(tasks, *keys).mapInArrow(run, schema)


def spread(packed: DataFrame, grid: DataFrame, keys, by: str) -> DataFrame:
    """Every series with every configuration, over all cores even when the series are few.

    Configurations travel as one array per group (``by``): the shuffle carries a series once per group,
    and the product with the configurations inside it is a narrow explode after the shuffle. The grid's
    size is set by the run's options, so it is broadcast.
    """
    options = [c for c in grid.columns if c != by]
    groups = grid.groupBy(by).agg(F.collect_list(F.struct(*options)).alias("_configs"))
    tasks = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    work = packed.crossJoin(F.broadcast(groups)).repartition(tasks, *keys, by)
    return work.withColumn("_c1", F.explode("_configs")).select(*packed.columns, by, "_c1.*")


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def _array_metrics(pairs: Column) -> dict[str, Column]:
    """MAE, MAPE and R2 of an array of (p, a) structs."""
    n = F.size(pairs)
    err = F.transform(pairs, lambda x: x["a"] - x["p"])
    nonzero = F.filter(pairs, lambda x: x["a"] != 0)
    mean = _sum(F.transform(pairs, lambda x: x["a"])) / F.nullif(n, F.lit(0))
    sst = _sum(F.transform(pairs, lambda x: x["a"] * x["a"])) - n * mean * mean
    ape = _sum(F.transform(nonzero, lambda x: F.abs((x["a"] - x["p"]) / x["a"])))
    return {"mae": _sum(F.transform(err, F.abs)) / F.nullif(n, F.lit(0)),
            "mape": ape / F.nullif(F.size(nonzero), F.lit(0)) * 100,
            "r2": F.when((n >= 2) & (sst > 1e-9 * mean * mean), 1 - _sum(F.transform(err, lambda e: e * e)) / sst)}


def monthly_autoregression(packed: DataFrame, keys, n_lags: int = 2, alphas=REGIONAL_ALPHAS) -> DataFrame:
    """Ridge per calendar month on the same month of earlier years, trained on all other years of the series."""
    types = dict(packed.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", annee bigint, mois bigint, prediction double, actual double"

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                m = _stack(r.matrix)
                for month in range(12):
                    if len(m) <= n_lags + 1:
                        continue
                    x, y = K.lagged(m[:, month], n_lags, np.zeros((len(m), 0)))
                    for i in range(len(y)):
                        pred = K.ridge_loo(np.delete(x, i, axis=0), np.delete(y, i), x[i], list(alphas))
                        rows.append((*[getattr(r, k) for k in keys], int(r.years[i + n_lags]), month + 1, pred, float(y[i])))
            yield pd.DataFrame(rows, columns=[*keys, "annee", "mois", "prediction", "actual"])

    return packed.mapInPandas(run, schema)


def score(folds: DataFrame, placeholder_year: int | None = None) -> DataFrame:
    """Monthly and annual errors of each back-test, from its arrays: no shuffle. A placeholder year does not count."""
    zipped = F.arrays_zip(F.col("annees").alias("y"), F.col("predictions").alias("p"), F.col("actuals").alias("a"))
    if placeholder_year is not None:
        zipped = F.filter(zipped, lambda f: f["y"] != placeholder_year)
    out = folds.withColumn("_f", zipped)
    monthly = F.flatten(F.transform("_f", lambda f: F.zip_with(f["p"], f["a"], lambda p, a: F.struct(p.alias("p"), a.alias("a")))))
    annual = F.transform("_f", lambda f: F.struct(_sum(f["p"]).alias("p"), _sum(f["a"]).alias("a")))
    out = out.withColumn("_m", monthly).withColumn("_a", annual)
    for prefix, c in (("monthly", "_m"), ("annual", "_a")):
        for name, expr in _array_metrics(F.col(c)).items():
            out = out.withColumn(f"{prefix}_{name}", expr)
    return out.drop("_f", "_m", "_a")


def drop_broken(folds: DataFrame) -> DataFrame:
    """Leave out back-tests with a missing or non-finite prediction."""
    inf = float("inf")
    return folds.filter(~F.exists(F.flatten("predictions"), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == inf)))


def best_per_strategy(scored: DataFrame, keys, threshold: float = 0.6) -> DataFrame:
    return drop_broken(select_best(scored, [*keys, "strategy"], "ordinal", threshold))


def _years(models, inner):
    """The years of each model of each series of an Arrow column of models."""
    lists = inner.field("annees").to_pylist()
    ends = np.cumsum([len(m) for m in models])
    return [lists[a:b] for a, b in zip(np.concatenate([[0], ends[:-1]]), ends)]


def ensemble_of(best: DataFrame, keys, penalty: float = 1.5) -> DataFrame:
    """Strategy 5: the best models of a series combined over their common years (two models at least)."""
    models = best.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("strategy", "annees", "predictions", "actuals"))).alias("models"))
    models = models.filter(F.size("models") >= 2)
    types = dict(best.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + (
        ", strategy int, ordinal int, annees array<bigint>, predictions array<array<double>>, actuals array<array<double>>")
    tau = penalty / (1 + penalty)

    def run(batches):
        for rows in batches:
            models = rows.column("models")
            inner = models.flatten()
            preds, actuals = (_flat(inner.field(c)).astype(float).reshape(-1, 12) for c in ("predictions", "actuals"))
            alike: dict[tuple[int, int], list] = {}  # series by number of models and common years
            start = 0  # of a model's first fold among all folds
            for i, row in enumerate(_years(models, inner)):
                years = sorted(set.intersection(*[set(y) for y in row]))
                at = []
                for y in row:
                    place = {v: start + j for j, v in enumerate(y)}
                    at.append([place[v] for v in years])
                    start += len(y)
                if years:
                    alike.setdefault((len(row), len(years)), []).append((i, years, at))
            for found in alike.values():
                i, years, at = (np.array(x) for x in zip(*found))
                real = actuals[at].mean(axis=1)
                mixed = K.ensemble_many(preds[at], real, tau)
                n = len(i)
                yield _result(rows, i, keys, np.full(n, 5), np.full(n, 1_000_000), years.ravel(), mixed.reshape(-1, 12), real.reshape(-1, 12),
                              np.full(n, years.shape[1]))

    return models.mapInArrow(run, schema)


def choose(best: DataFrame, ensemble: DataFrame, keys, threshold: float = 0.6, favor_overestimation: bool = True,
           placeholder_year: int | None = None) -> DataFrame:
    """Final model per series; a series with an ensemble takes it when overestimation is favoured."""
    mixed = drop_broken(score(ensemble, placeholder_year))
    candidates = best.unionByName(mixed, allowMissingColumns=True)
    if favor_overestimation:
        candidates = mixed.unionByName(best.join(mixed.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)
    return select_best(candidates, keys, "ordinal", threshold)


def long_predictions(models: DataFrame, keys) -> DataFrame:
    """(keys, strategy, annee, mois, prediction, actual) rows of the chosen back-tests."""
    years = models.select(*keys, "strategy", F.explode(F.arrays_zip("annees", "predictions", "actuals")).alias("f"))
    months = years.select(*keys, "strategy", F.col("f.annees").alias(N.ANNEE), F.posexplode(F.arrays_zip(
        F.col("f.predictions").alias("p"), F.col("f.actuals").alias("a"))).alias("i", "x"))
    return months.select(*keys, "strategy", N.ANNEE, (F.col("i") + 1).cast("bigint").alias(N.MOIS), F.col("x.p").alias("prediction"),
                         F.col("x.a").alias("actual"))


def run_short_term(packed: DataFrame, keys, grid: dict = REGIONAL_GRID, alphas=REGIONAL_ALPHAS, threshold: float = 0.6, penalty: float = 1.5,
                   favor_overestimation: bool = True, placeholder_year: int | None = None) -> DataFrame:
    """Grid back-test, best of each strategy, ensemble and final choice for every series at once."""
    from wattline.session import materialize

    folds = fold_predictions(packed, grid_frame(packed.sparkSession, grid), keys, alphas, best=(threshold, placeholder_year))
    best = materialize(best_per_strategy(score(folds, placeholder_year), keys, threshold), "best-models")
    return choose(best, ensemble_of(best, keys, penalty), keys, threshold, favor_overestimation, placeholder_year)
