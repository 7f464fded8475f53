"""Regression of consumption on three weather measures per region and activity.

A fit needs only means, variances and covariances, so groups of any size reduce to one row of moments
by partial aggregation; the 3 x 3 system on standardised variables is solved in closed form.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wattline import names as N

X = ("apparent_temperature_min", "precipitation_sum", "et0_fao_evapotranspiration_sum")
COEF = {"apparent_temperature_min": "coef_temperature_min", "precipitation_sum": "coef_precipitation",
        "et0_fao_evapotranspiration_sum": "coef_et0"}


def moments(rows: DataFrame, keys, y: str) -> DataFrame:
    """Count, means, deviations and correlations of the target and the three measures."""
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(y).alias("my"), F.stddev_pop(y).alias("sy")]
    for i, x in enumerate(X):
        aggs += [F.avg(x).alias(f"m{i}"), F.stddev_pop(x).alias(f"s{i}"), F.covar_pop(x, y).alias(f"cy{i}")]
        aggs += [F.covar_pop(x, X[j]).alias(f"c{i}{j}") for j in range(i + 1, 3)]
    return rows.groupBy(*keys).agg(*aggs)


def _ratio(num, *dens) -> Column:
    den = F.lit(1.0)
    for d in dens:
        den = den * F.col(d)
    return F.try_divide(F.col(num), den)


def ols_by_group(rows: DataFrame, keys, y: str) -> DataFrame:
    """Standardised and unscaled coefficients with the implicit intercept; null for a singular system."""
    m = moments(rows, keys, y)
    for i in range(3):
        m = m.withColumn(f"b{i}", _ratio(f"cy{i}", f"s{i}", "sy"))
        for j in range(i + 1, 3):
            m = m.withColumn(f"r{i}{j}", _ratio(f"c{i}{j}", f"s{i}", f"s{j}"))
    r01, r02, r12 = F.col("r01"), F.col("r02"), F.col("r12")
    b0, b1, b2 = F.col("b0"), F.col("b1"), F.col("b2")
    det = 1 + 2 * r01 * r02 * r12 - r01 * r01 - r02 * r02 - r12 * r12
    solved = [(1 - r12 * r12) * b0 + (r02 * r12 - r01) * b1 + (r01 * r12 - r02) * b2,
              (r02 * r12 - r01) * b0 + (1 - r02 * r02) * b1 + (r01 * r02 - r12) * b2,
              (r01 * r12 - r02) * b0 + (r01 * r02 - r12) * b1 + (1 - r01 * r01) * b2]
    m = m.withColumn("_det", F.when(det > 1e-12, det))
    for i, (x, s) in enumerate(zip(X, solved)):
        m = m.withColumn(f"scaled_{COEF[x]}", F.try_divide(s, F.col("_det")))
        m = m.withColumn(COEF[x], F.col(f"scaled_{COEF[x]}") * F.try_divide(F.col("sy"), F.col(f"s{i}")))
    intercept = F.col("my") - F.col(COEF[X[0]]) * F.col("m0") - F.col(COEF[X[1]]) * F.col("m1") - F.col(COEF[X[2]]) * F.col("m2")
    r2 = sum((F.col(f"scaled_{COEF[x]}") * F.col(f"b{i}") for i, x in enumerate(X)), F.lit(0.0))
    return m.select(*keys, "n", "sy", *[f"scaled_{COEF[x]}" for x in X], *[COEF[x] for x in X],
                    intercept.alias("implicit_intercept"), r2.alias("r2"))


def predicted() -> Column:
    out = F.col("implicit_intercept")
    for x in X:
        out = out + F.col(COEF[x]) * F.col(x)
    return out


def last_year_split(rows: DataFrame, keys) -> DataFrame:
    """Flag each group's last year as test; groups with a single year are left out."""
    years = rows.groupBy(*keys).agg(F.max(N.ANNEE).alias("_last"), F.min(N.ANNEE).alias("_first"))
    return rows.join(years.filter("_first < _last"), list(keys)).withColumn("is_test", F.col(N.ANNEE) == F.col("_last")).drop("_last", "_first")


def weather_regression(rows: DataFrame, keys, y: str) -> DataFrame:
    """Fit on the years before the last, score on the last: coefficients, RMSE, MAE, R2, adjusted R2."""
    split = last_year_split(rows, keys)
    fit = ols_by_group(split.filter("not is_test"), keys, y)
    error = F.col(y) - predicted()
    scored = split.filter("is_test").join(fit, list(keys)).groupBy(*keys).agg(
        F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"))
    adj = 1 - F.try_divide(F.col("n") * (1 - F.col("r2")), F.col("n") - 3)
    return fit.join(scored, list(keys)).withColumn("adj_r2", adj)


def residual_tests(rows: DataFrame, keys, y: str) -> DataFrame:
    """Durbin-Watson, skew, kurtosis, Jarque-Bera, log-likelihood, AIC, BIC and F of the fits, on the scaled target."""
    train = last_year_split(rows, keys).filter("not is_test")
    fit = ols_by_group(train, keys, y).filter(F.col("r2").isNotNull() & (F.col("n") > 3))
    res = train.join(fit, list(keys)).withColumn("e", (F.col(y) - predicted()) / F.nullif(F.col("sy"), F.lit(0.0)))
    order = W.partitionBy(*keys).orderBy(*[c for c in (N.ANNEE, N.MOIS) if c in rows.columns])
    res = res.withColumn("d", F.col("e") - F.lag("e").over(order))
    e = F.col("e")
    t = res.groupBy(*keys).agg(F.first("n").alias("n"), F.first("r2").alias("r2"), F.sum(e * e).alias("sse"), F.sum(F.col("d") * F.col("d")).alias("sd"),
                               F.skewness("e").alias("skew"), (F.kurtosis("e") + 3).alias("kurtosis"))
    n = F.col("n")
    llf = -n / 2 * (F.lit(math.log(2 * math.pi) + 1) + F.ln(F.col("sse") / n))
    return t.select(*keys, F.try_divide(F.col("sd"), F.col("sse")).alias("durbin_watson"), "skew", "kurtosis",
                    (n / 6 * (F.col("skew") * F.col("skew") + (F.col("kurtosis") - 3) * (F.col("kurtosis") - 3) / 4)).alias("jarque_bera"),
                    llf.alias("log_likelihood"), (-2 * llf + 6).alias("aic"), (-2 * llf + 3 * F.ln(n)).alias("bic"),
                    F.try_divide(F.col("r2") / 3, (1 - F.col("r2")) / (n - 3)).alias("f_statistic"))


def _coordinate_descent(gram: np.ndarray, target: np.ndarray, alpha: float, l1: float, sweeps: int = 200) -> np.ndarray:
    """Elastic-net coefficients for a batch of correlation systems, refitted on the columns kept."""
    beta = np.zeros_like(target)
    for _ in range(sweeps):
        for j in range(target.shape[1]):
            rest = target[:, j] - np.einsum("bk,bk->b", gram[:, j], beta) + gram[:, j, j] * beta[:, j]
            beta[:, j] = np.sign(rest) * np.maximum(np.abs(rest) - alpha * l1, 0) / (gram[:, j, j] + alpha * (1 - l1))
    kept = np.abs(beta) > 1e-10
    masked = gram * kept[:, :, None] * kept[:, None, :] + np.eye(target.shape[1]) * ~kept[:, :, None]
    return (np.linalg.pinv(masked) @ (target * kept)[:, :, None])[:, :, 0]


def elastic_net_by_group(rows: DataFrame, keys, y: str, alpha: float = 1.0, l1: float = 0.5) -> DataFrame:
    """Penalised fit per group from the moments: l1 = 0 is ridge, 1 lasso. With an l1 part the kept columns are refitted by OLS."""
    m = moments(rows, keys, y)
    names = [f"scaled_{COEF[x]}" for x in X]

    def solve(batches):
        for pdf in batches:
            sx = pdf[["s0", "s1", "s2"]].to_numpy(float)
            sy = pdf["sy"].to_numpy(float)
            ok = (sx > 0).all(axis=1) & (sy > 0)
            pdf, sx, sy = pdf[ok], sx[ok], sy[ok]
            if pdf.empty:
                continue
            gram = np.tile(np.eye(3), (len(pdf), 1, 1))
            for i, j in ((0, 1), (0, 2), (1, 2)):
                gram[:, i, j] = gram[:, j, i] = pdf[f"c{i}{j}"].to_numpy(float) / (sx[:, i] * sx[:, j])
            target = pdf[["cy0", "cy1", "cy2"]].to_numpy(float) / (sx * sy[:, None])
            if l1 == 0:
                beta = np.linalg.solve(gram + alpha * np.eye(3), target[:, :, None])[:, :, 0]
            else:
                beta = _coordinate_descent(gram, target, alpha, l1)
            out = pdf[list(keys)].copy()
            out[names] = beta
            yield out

    fields = ", ".join([f"{k} string" for k in keys] + [f"{n} double" for n in names])
    return m.mapInPandas(solve, fields)


def pooled_elastic_net(rows: DataFrame, y: str, alpha: float, l1: float) -> DataFrame:
    """One elastic net over all rows, distributed."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    data = VectorAssembler(inputCols=list(X), outputCol="features").transform(rows.select(*X, F.col(y).alias("label")))
    model = LinearRegression(regParam=alpha, elasticNetParam=l1, maxIter=1000).fit(data)
    values = [float(v) for v in model.coefficients]
    return rows.sparkSession.createDataFrame([(*values, float(model.intercept))],
                                             ", ".join(f"{COEF[x]} double" for x in X) + ", implicit_intercept double")


def regional_models(rows: DataFrame, key: str, y: str, min_points: int = 5) -> DataFrame:
    """Per region: error on a repeatable 30 percent hold-out, then coefficients refitted on everything.

    Rows are held out by a hash of region and year, so a rerun splits the same way wherever it runs.
    """
    counted = rows.join(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_points), key)
    held = F.pmod(F.xxhash64(key, N.ANNEE), F.lit(10)) < 3
    fit = ols_by_group(counted.filter(~held), [key], y)
    a, p = F.col(y), predicted()
    test = counted.filter(held).join(fit.drop("n"), key).groupBy(key).agg(
        F.avg(F.abs(a - p)).alias("mae_test"), F.sqrt(F.avg((a - p) * (a - p))).alias("rmse_test"),
        (F.avg(F.abs((a - p) / F.nullif(a, F.lit(0.0)))) * 100).alias("mape_test"), F.count(F.lit(1)).alias("n_test"))
    return ols_by_group(counted, [key], y).join(test, key, "left")


def sensitivity_by(fits: DataFrame, keys) -> DataFrame:
    """Mean coefficients and mean absolute sensitivity."""
    coefs = list(COEF.values())
    mean_abs = sum((F.avg(F.abs(c)) for c in coefs[1:]), F.avg(F.abs(coefs[0]))) / len(coefs)
    return fits.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in coefs], mean_abs.alias("sensitivity"), F.avg("r2").alias("r2"))


def sensitivity_long(fits: DataFrame, keys) -> DataFrame:
    return fits.unpivot([F.col(k) for k in keys], [F.col(c) for c in COEF.values()], "feature", "coefficient")
