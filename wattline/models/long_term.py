"""Long-term forecasts: annual models back-tested over a grid for every series, refitted and extended five years."""

from __future__ import annotations

import json
import warnings
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from wattline import names as N
from wattline.functions.series import growth_features
from wattline.models.gaussian_process import KERNELS, PRIOR_OPTIONS, PRIORS, trend_gp
from wattline.models.kernels import growth_forecast
from wattline.models.short_term import score, spread
from wattline.operators.metrics import select_best

LINEAR_PRIOR = {"type": "linear", "min_annual_growth": 0.02, "anchor_window": 3}
CONSENSUS_PRIOR = {"type": "consensus", "power": 0.5, "anchor_window": 1, "min_annual_growth": None, "driver_weight": 0.0, "memory_decay": 0.2}
# Shipped settings of the regional and the contract runs.
REGIONAL_GRID = {"transforms": [["lchg"], ["lchg", "lag_lchg"]], "lags": [[1, 2]], "use_pf": [False], "windows": [None],
                 "models": [{"model": "gp", "kernel": "rbf_white", "normalize": n, "log": True, "prior": LINEAR_PRIOR} for n in (True, False)]}
CONTRACT_GRID = {"transforms": [["level"], ["level", "lag"]], "lags": [[1, 2]], "use_pf": [True], "windows": [None],
                 "models": [{"model": "gp", "kernel": "matern_white", "normalize": n, "log": False, "prior": CONSENSUS_PRIOR,
                             "intensity": True} for n in (True, False)]}


def mean_reverting(years, y, x, new_years, x_new, params):
    """Growth model, iterated over the horizon; no band."""
    series, feats, out = list(y), x, []
    for i in range(len(new_years)):
        out.append(growth_forecast(np.array(series), feats, x_new[i]))
        series.append(out[-1])
        feats = np.vstack([feats, x_new[i]])
    out = np.array(out)
    return out, np.full(len(out), np.nan), np.full(len(out), np.nan)


# name -> fit_predict(years, values, features, new_years, new_features, params) -> (mean, low, high)
MODELS = {"gp": trend_gp, "mean_reverting": mean_reverting}
# Options each model reads beside its name; a model that is not listed reads any.
MODEL_OPTIONS = {"gp": ("kernel", "normalize", "log", "prior", "alpha", "remove_outliers", "outlier_threshold", "intensity"), "mean_reverting": ("intensity",)}


# (the registries travel inside each job's closure: workers never import the caller's additions)
def register_model(name: str, fit_predict, options=None) -> None:
    """Add a model callers can name in a grid; ``options`` are the keys it reads (None: any)."""
    if not callable(fit_predict):
        raise TypeError("fit_predict must be callable")
    MODELS[name] = fit_predict
    if options is not None:
        MODEL_OPTIONS[name] = (*options, "intensity")
    else:
        MODEL_OPTIONS.pop(name, None)


def check_models(models) -> None:
    """Names must be registered, or every fold of theirs would fail far from here; options that nothing reads bring a warning."""
    for m in models:
        if m["model"] not in MODELS:
            raise ValueError(f"unknown model {m['model']}; registered: {sorted(MODELS)}")
        read = MODEL_OPTIONS.get(m["model"])
        unused = [] if read is None else [k for k in m if k != "model" and k not in read]
        if m["model"] == "gp":
            prior = m.get("prior") or {}
            kind, kernel = prior.get("type", "zero"), m.get("kernel") or "rbf_white"
            if kind not in PRIOR_OPTIONS:
                raise ValueError(f"unknown prior {kind}; registered: {sorted(PRIOR_OPTIONS)}")
            if kernel not in KERNELS:
                raise ValueError(f"unknown kernel {kernel}; registered: {sorted(KERNELS)}")
            unused += [f"prior.{k}" for k in prior if k != "type" and k not in PRIOR_OPTIONS[kind]]
        for k in unused:
            warnings.warn(f"{m['model']}: option {k} is not used", stacklevel=3)


def feature_names(block, transforms, lags) -> list[str]:
    """Columns of a feature block in model order: levels, lags, log changes, lagged log changes."""
    parts = {"level": list(block), "lag": [f"{c}_lag{k}" for k in lags for c in block], "lchg": [f"{c}_lchg" for c in block],
             "lag_lchg": [f"{c}_lchg_lag{k}" for k in lags for c in block]}
    return [c for t in ("level", "lag", "lchg", "lag_lchg") if t in transforms for c in parts[t]]


def grid_frame(spark: SparkSession, grid: dict, blocks, columns: list[str]) -> DataFrame:
    """Configurations in grid order with the positions of their feature columns."""
    check_models(grid["models"])
    rows = []
    order = product(grid["windows"], grid["transforms"], grid["lags"], blocks, grid["use_pf"], grid["models"])
    for i, (window, transforms, lags, block, pf, model) in enumerate(order):
        cols = [columns.index(c) for c in feature_names(block, transforms, lags)]
        rows.append((i % 4, i, cols, window, pf, json.dumps(model)))
    return spark.createDataFrame(rows, "part int, ordinal int, cols array<int>, window int, use_pf boolean, params string")


def pack_annual(annual: DataFrame, features: DataFrame, keys, value: str, block, lags=(1, 2), horizon: int = 5, driver: str | None = None,
                power: str | None = None, feature_keys=()) -> tuple[DataFrame, list[str]]:
    """One row per series: years with values, then the horizon years, with aligned features.

    ``features`` must reach the horizon; log changes and lags come from one window pass per feature series.
    """
    fk = list(feature_keys)
    lags = list(lags)
    columns = feature_names(block, ("level", "lag", "lchg", "lag_lchg"), lags)
    made = growth_features(features.select(*fk, N.ANNEE, *block), fk, block, ("level", "lag", "lchg", "lag_lchg"), lags) if block else features.select(*fk, N.ANNEE)
    made = made.select(*fk, N.ANNEE, F.array(*[F.col(c) for c in columns]).cast("array<double>").alias("_x"))
    if driver:
        made = made.join(features.select(*fk, N.ANNEE, F.col(driver).cast("double").alias("_d")), [*fk, N.ANNEE])
    else:
        made = made.withColumn("_d", F.lit(1.0))
    last = annual.groupBy(*keys).agg(F.max(N.ANNEE).alias("_last"))
    future = last.select(*keys, F.explode(F.sequence(F.col("_last") + 1, F.col("_last") + horizon)).alias(N.ANNEE))
    extra = [F.col(power).cast("double").alias("_p")] if power else [F.lit(0.0).alias("_p")]
    rows = annual.select(*keys, N.ANNEE, F.col(value).cast("double").alias("_v"), *extra).unionByName(future, allowMissingColumns=True)
    rows = rows.join(made, [*fk, N.ANNEE], "left").withColumn("_x", F.coalesce("_x", F.array_repeat(F.lit(0.0), len(columns))))
    packed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        F.col(N.ANNEE).alias("y"), F.col("_v").alias("v"), F.col("_x").alias("x"), F.col("_d").alias("d"),
        F.coalesce("_p", F.lit(0.0)).alias("p")))).alias("_s"))
    return packed.select(*keys, *[F.col(f"_s.{f}").alias(out) for f, out in
                                  (("y", "years"), ("v", "values"), ("x", "features"), ("d", "driver"), ("p", "power"))]), columns


def _plugins() -> dict:
    """Models, priors and kernels as they are now, for the closure of a job."""
    return {"models": dict(MODELS), "priors": dict(PRIORS), "kernels": dict(KERNELS)}


def _call(r, params, train: slice, test: slice, plugins):
    years = np.asarray(r.years)
    x = np.array([np.asarray(v, float) for v in r.features])[:, list(r.cols)] if len(r.cols) else np.zeros((len(years), 0))
    if r.use_pf:
        x = np.column_stack([x, np.asarray(r.power, float)])
    y = np.asarray(r.values, float)
    d = np.asarray(r.driver, float) if params.get("intensity") else np.ones(len(years))
    if not np.isfinite(d[test]).all() or (d[train] == 0).any():
        raise ValueError("the driver is missing for a forecast year or zero in a training year")
    params = {**params, "priors": plugins["priors"], "kernels": plugins["kernels"]}
    out = plugins["models"][params["model"]](years[train], y[train] / d[train], x[train], years[test], x[test], params)
    return [o * d[test] for o in out]


def annual_folds(packed: DataFrame, grid: DataFrame, keys, min_train: int = 3) -> DataFrame:
    """Back-test every series and configuration on each year with enough history; a failing fold is left out."""
    types = dict(packed.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + (
        ", ordinal int, cols array<int>, window int, use_pf boolean, params string, annees array<bigint>, predictions array<array<double>>, "
        "actuals array<array<double>>")
    plugins = _plugins()

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                params = json.loads(r.params)
                y = np.asarray(r.values, float)
                years, preds, actuals = [], [], []
                for t in range(2, int(np.isfinite(y).sum())):
                    first = 0 if pd.isna(r.window) else max(0, t - int(r.window))
                    if t - first < min_train:
                        continue
                    try:
                        mean = _call(r, params, slice(first, t), slice(t, t + 1), plugins)[0]
                    except (np.linalg.LinAlgError, ValueError):
                        continue
                    years.append(int(r.years[t]))
                    preds.append([float(max(mean[0], 0.0))])
                    actuals.append([float(y[t])])
                if years:
                    rows.append((*[getattr(r, k) for k in keys], r.ordinal, list(r.cols), None if pd.isna(r.window) else int(r.window), r.use_pf,
                                 r.params, years, preds, actuals))
            yield pd.DataFrame(rows, columns=[*keys, "ordinal", "cols", "window", "use_pf", "params", "annees", "predictions", "actuals"])

    return spread(packed, grid, keys, "part").mapInPandas(run, schema)


def refit_horizon(packed: DataFrame, best: DataFrame, keys) -> DataFrame:
    """Refit each series' chosen configuration on all its years and forecast the horizon with its band."""
    types = dict(packed.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", ordinal int, annee bigint, prediction double, bas double, haut double"
    work = packed.join(best.select(*keys, "ordinal", "cols", "window", "use_pf", "params"), list(keys))
    plugins = _plugins()

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                n = int(np.isfinite(np.asarray(r.values, float)).sum())
                first = 0 if pd.isna(r.window) else max(0, n - int(r.window))
                mean, low, high = _call(r, json.loads(r.params), slice(first, n), slice(n, len(r.years)), plugins)
                key = [getattr(r, k) for k in keys]
                rows += [(*key, r.ordinal, int(y), float(a), float(b), float(c)) for y, a, b, c in zip(r.years[n:], mean, low, high)]
            yield pd.DataFrame(rows, columns=[*keys, "ordinal", N.ANNEE, "prediction", "bas", "haut"])

    return work.mapInPandas(run, schema)


def run_long_term(packed: DataFrame, columns, blocks, keys, grid: dict = REGIONAL_GRID, threshold: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """(chosen configurations with their errors, horizon forecasts)."""
    from wattline.session import materialize

    packed = materialize(packed, "annual-series")
    folds = annual_folds(packed, grid_frame(packed.sparkSession, grid, blocks, columns), keys)
    best = materialize(select_best(score(folds), keys, "ordinal", threshold), "best-annual")
    return best, refit_horizon(packed, best, keys)


# Autoregression orders on differenced annual series.

# fixed values: the widest of the shipped order grids, p 0 to 3 and d 0 to 2
ORDERS = tuple((p, d) for d in range(3) for p in range(4))


def autoregression_search(packed: DataFrame, keys, orders=ORDERS, hold_out: int = 2) -> DataFrame:
    """AR(p) on d-th differences by least squares per series and order: AIC and hold-out error of the last years."""
    types = dict(packed.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", ordre int, p int, d int, aic double, mape double"

    def one(y, p, d):
        train = np.diff(y[:-hold_out], d) if d else y[:-hold_out]
        if len(train) - p < p + 2:
            return None
        x = np.column_stack([np.ones(len(train) - p)] + [train[p - k:len(train) - k] for k in range(1, p + 1)])
        beta = np.linalg.lstsq(x, train[p:], rcond=None)[0]
        n, sse = len(x), max(((train[p:] - x @ beta) ** 2).sum(), 1e-12)
        z, preds = list(train), []
        last = [np.diff(y[:-hold_out], i)[-1] for i in range(d)]  # newest value of each difference below the d-th
        for _ in range(hold_out):
            z.append(beta[0] + sum(beta[k] * z[-k] for k in range(1, p + 1)))
            step = z[-1]
            for i in range(d - 1, -1, -1):
                last[i] = step = last[i] + step
            preds.append(step)
        real = y[-hold_out:]
        return n * np.log(sse / n) + 2 * (p + 2), np.mean(np.abs((real - preds) / real)) * 100 if (real != 0).all() else np.nan

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                y = np.asarray(r.values, float)
                for i, (p, d) in enumerate(orders):
                    got = one(y[np.isfinite(y)], p, d) if len(y) > hold_out else None
                    if got is not None:
                        rows.append((*[getattr(r, k) for k in keys], i, p, d, float(got[0]), float(got[1])))
            yield pd.DataFrame(rows, columns=[*keys, "ordre", "p", "d", "aic", "mape"])

    return packed.mapInPandas(run, schema)


def best_order(search: DataFrame, keys, by: str = "aic") -> DataFrame:
    order = W.partitionBy(*keys).orderBy(F.asc_nulls_last(by), "ordre")
    return search.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")
