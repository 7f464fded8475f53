"""Trend model that reverts to a trend which itself leans into growth, at different speeds above and below it.

The trend starts at a series' first log level. Each year the gap of the level over the trend decides: the trend grows by
``mu + beta * gap`` (the second part only above the trend), and the level by as much, less ``alpha`` times the gap, with one
alpha below the trend (recovery) and one above it (correction). A series is one short array: history and forecast are expressions
over it, and the fit, which tries many parameters, takes the series of a batch together in Python workers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from wattline import names as N

PARAMETERS = ("mu", "alpha_down", "alpha_up", "beta")
# Bounds of the parameters (mu has no upper one) and the alphas of a series that never is on that side.
BOUNDS = {"mu": 0.0, "alpha_down": (0.1, 1.5), "alpha_up": (0.0, 0.5), "beta": (0.0, 0.5)}
UNSEEN = {"alpha_down": 0.5, "alpha_up": 0.1}
CELLS = 4096  # years of the series that are fitted at once


def log_series(annual: DataFrame, keys, value: str) -> DataFrame:
    """One row per series: ``logs`` by year and ``last_year``. Series of one year, or with a null or a value not above 0, are left out."""
    rows = annual.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(N.ANNEE, F.ln(F.col(value).cast("double")).alias("l")))).alias("_s"), F.max(N.ANNEE).alias("last_year"))
    whole = F.forall("_s", lambda s: s["l"].isNotNull()) & (F.size("_s") >= 2)
    return rows.filter(whole).select(*keys, F.col("_s.l").alias("logs"), "last_year")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _struct(**fields) -> Column:
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def _growths(p) -> Column:
    """(gap, growth of the trend, growth of the level) of every year but the last, and the trend after them."""
    state = "struct<trend:double,drift:double,steps:array<struct<gap:double,drift:double,d:double>>>"

    def step(a, i):
        def at(gap):
            drift = p["mu"] + p["beta"] * F.greatest(F.lit(0.0), gap)
            one = _struct(gap=gap, drift=drift, d=F.element_at("logs", i + 1) - F.element_at("logs", i))
            return _struct(trend=a["trend"] + drift, drift=drift, steps=F.concat(a["steps"], F.array(one))).cast(state)

        return _let(F.element_at("logs", i) - a["trend"], at)

    none = F.array().cast("array<struct<gap:double,drift:double,d:double>>")
    start = _struct(trend=F.element_at("logs", 1), drift=p["mu"], steps=none).cast(state)
    return F.aggregate(F.sequence(F.lit(1), F.size("logs") - 1), start, step)


def _alpha(p, gap: Column) -> Column:
    return F.when(gap < 0, p["alpha_down"]).otherwise(p["alpha_up"])


def trend_state(series: DataFrame, parameters: Column) -> DataFrame:
    """Adds ``trend`` and ``drift`` after the history for a struct of ``PARAMETERS``, kept as ``parameters``."""
    rows = series.withColumn("parameters", parameters)
    rows = rows.withColumn("_g", _growths(F.col("parameters")))
    return rows.withColumn("trend", F.col("_g.trend")).withColumn("drift", F.col("_g.drift")).drop("_g")


def trend_horizon(states: DataFrame, keys, horizon: int = 5) -> DataFrame:
    """(keys, annee, log_prediction) of the years after ``last_year``. Each forecast uses the drift of the step before it."""
    p = F.col("parameters")
    kind = f"array<struct<{N.ANNEE}:bigint,l:double,trend:double,drift:double>>"

    def step(acc, _):
        def at(x):
            gap = x["l"] - x["trend"]
            drift = p["mu"] + p["beta"] * F.greatest(F.lit(0.0), gap)
            return F.struct((x[N.ANNEE] + 1).alias(N.ANNEE), (x["l"] + x["drift"] - _alpha(p, gap) * gap).alias("l"),
                            (x["trend"] + drift).alias("trend"), drift.alias("drift"))

        return F.concat(acc, F.array(_let(F.element_at(acc, -1), at))).cast(kind)

    start = F.array(F.struct(F.col("last_year").cast("bigint").alias(N.ANNEE), F.element_at("logs", -1).alias("l"), "trend", "drift")).cast(kind)
    path = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, step)
    return states.select(*keys, F.explode(F.slice(path, 2, horizon)).alias("x")).select(*keys, f"x.{N.ANNEE}", F.col("x.l").alias("log_prediction"))


def _scored(logs: np.ndarray, mu: np.ndarray, beta: np.ndarray, penalty: float, passes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(loss, alpha_down, alpha_up) of series (s, years) for their candidates (s, c); each year is one step for all of them."""
    trend, steps = np.broadcast_to(logs[:, :1], mu.shape), []
    for i in range(logs.shape[1] - 1):
        gap = logs[:, i:i + 1] - trend
        drift = mu + beta * np.maximum(0.0, gap)
        steps.append((gap, gap < 0, drift, logs[:, i + 1:i + 2] - logs[:, i:i + 1]))
        trend = trend + drift

    def weight(alphas, gap, below, drift, d):
        return 1.0 if penalty == 1.0 else np.where(d > drift - np.where(below, *alphas) * gap, penalty, 1.0)

    def solved(alphas):
        sums = {side: [np.zeros(mu.shape), np.zeros(mu.shape)] for side in ("down", "up")}
        for gap, below, drift, d in steps:
            w = weight(alphas, gap, below, drift, d)
            rg, gg = w * (drift - d) * gap, w * gap * gap
            for side, held in (("down", below), ("up", ~below)):
                sums[side][0] += np.where(held, rg, 0.0)
                sums[side][1] += np.where(held, gg, 0.0)
        out = []
        for side, (rg, gg) in sums.items():
            low, high = BOUNDS[f"alpha_{side}"]
            best = np.where(gg == 0, UNSEEN[f"alpha_{side}"], rg / np.where(gg == 0, 1.0, gg))
            out.append(np.fmax(low, np.fmin(high, best)))
        return out

    alphas = [np.full(mu.shape, UNSEEN[f"alpha_{side}"]) for side in ("down", "up")]
    for _ in range(1 if penalty == 1.0 else passes):
        alphas = solved(alphas)
    loss = np.zeros(mu.shape)
    for gap, below, drift, d in steps:
        e = d - drift + np.where(below, *alphas) * gap
        loss += weight(alphas, gap, below, drift, d) * e * e
    return loss / len(steps), *alphas


def _search(logs: np.ndarray, penalty: float, cells: tuple[int, int], rounds: int, passes: int) -> np.ndarray:
    """Rows (loss, mu, alpha_down, alpha_up, beta) of series of one length; of equal losses the least mu, then beta."""
    n_mu, n_beta = cells
    top = np.maximum(BOUNDS["mu"], np.diff(logs, axis=1).max(axis=1))
    (low, high), count = BOUNDS["beta"], len(logs)
    mu0, mu1, beta0, beta1 = np.full(count, BOUNDS["mu"]), top, np.full(count, low), np.full(count, high)
    i = np.arange((n_mu + 1) * (n_beta + 1))
    best = None
    for _ in range(rounds):
        wide_mu, wide_beta = (mu1 - mu0) / n_mu, (beta1 - beta0) / n_beta
        mu = mu0[:, None] + wide_mu[:, None] * (i // (n_beta + 1))
        beta = beta0[:, None] + wide_beta[:, None] * (i % (n_beta + 1))
        loss, down, up = _scored(logs, mu, beta, penalty, passes)
        tried = [loss, mu, beta, down, up]
        if best is not None:
            tried = [np.column_stack([best[:, k], x]) for k, x in enumerate(tried)]
        first = np.lexsort(tuple(tried[::-1]), axis=1)[:, :1]
        best = np.concatenate([np.take_along_axis(x, first, axis=1) for x in tried], axis=1)
        mu0, mu1 = np.maximum(BOUNDS["mu"], best[:, 1] - wide_mu), np.minimum(top, best[:, 1] + wide_mu)
        beta0, beta1 = np.maximum(low, best[:, 2] - wide_beta), np.minimum(high, best[:, 2] + wide_beta)
    return best[:, [0, 1, 3, 4, 2]]


def fit_adaptive_trend(series: DataFrame, penalty: float = 1.0, cells: tuple[int, int] = (12, 8), rounds: int = 4, passes: int = 6) -> DataFrame:
    """``series`` with ``parameters`` of least mean squared error and that ``loss``.

    Gaps depend on mu and beta alone, and given those each alpha is a one-dimensional weighted least-squares problem, solved and
    clipped to its bounds. So only (mu, beta) is searched: on a grid over all their bounds, then on grids around the best cell.
    A mu above the largest yearly growth only adds error, which bounds it. With ``penalty`` other than 1 a growth above its
    forecast costs that many times its square; alphas are then reweighted by the signs of errors ``passes`` times. The loss
    need not be convex in (mu, beta): an optimum narrower than a cell of the first grid can be missed.
    """
    tasks = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parameters = T.StructType([T.StructField(p, T.DoubleType()) for p in PARAMETERS])
    schema = T.StructType([*series.schema.fields, T.StructField("parameters", parameters), T.StructField("loss", T.DoubleType())])
    at, names = series.columns.index("logs"), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs = batch.column(at).to_pylist()
            lengths = np.array([len(x) for x in logs], dtype=int)
            out = np.empty((len(logs), 5))
            for n in np.unique(lengths):
                rows = np.flatnonzero(lengths == n)
                step = max(1, CELLS // int(n))
                for i in range(0, len(rows), step):
                    some = rows[i:i + step]
                    out[some] = _search(np.array([logs[k] for k in some], dtype=float), float(penalty), cells, rounds, passes)
            fitted = pa.StructArray.from_arrays([pa.array(out[:, 1 + i]) for i in range(4)], names=list(PARAMETERS))
            yield pa.RecordBatch.from_arrays([*batch.columns, fitted, pa.array(out[:, 0])], names=names)

    # a series is few bytes and much work, so the number of tasks is fixed
    return series.repartition(tasks, *[c for c in series.columns if c != "logs"]).mapInArrow(run, schema)
