"""Clusters and curve shapes of contracts."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, functions as F

from wattline import names as N

MAX_ITERATIONS = 300  # fixed value: the source programs' solver default; runs stop earlier when centres settle
PARALLEL = 3


def yearly_columns(df: DataFrame, key: str, value: str, years) -> DataFrame:
    """One row per key, one column per year; absent years are 0."""
    wide = df.groupBy(key).agg(*[F.coalesce(F.sum(F.when(F.col(N.ANNEE) == y, F.col(value))), F.lit(0.0)).alias(f"y{y}") for y in years])
    return wide


def kmeans_sweep(wide: DataFrame, cols, ks=range(2, 11), seed: int = 42) -> DataFrame:
    """Silhouette (squared Euclidean) of k-means on standardised columns for each k."""
    from wattline.session import materialize

    wide = materialize(wide, "wide")
    stages = [VectorAssembler(inputCols=list(cols), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]
    data = materialize(Pipeline(stages=stages).fit(wide).transform(wide).select("features"), "scaled")
    judge = ClusteringEvaluator()

    def silhouette(k: int) -> float:
        return float(judge.evaluate(KMeans(k=k, seed=seed, maxIter=MAX_ITERATIONS).fit(data).transform(data)))

    # independent distributed fits of many short jobs; threads only let the scheduler overlap them
    with ThreadPoolExecutor(PARALLEL) as pool:
        rows = [(int(k), s) for k, s in zip(ks, pool.map(silhouette, [int(k) for k in ks]))]
    return wide.sparkSession.createDataFrame(rows, "k int, silhouette double")


def mixed_clusters(profiles: DataFrame, category: str, cols, k: int = 6, seed: int = 42) -> DataFrame:
    """Clusters over a category and numeric columns: the category one-hot next to scaled numbers."""
    stages = [StringIndexer(inputCol=category, outputCol="_i", handleInvalid="keep"), OneHotEncoder(inputCol="_i", outputCol="_onehot"),
              VectorAssembler(inputCols=list(cols), outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_num", withMean=True),
              VectorAssembler(inputCols=["_num", "_onehot"], outputCol="features"), KMeans(k=k, seed=seed, predictionCol="cluster", maxIter=MAX_ITERATIONS)]
    return Pipeline(stages=stages).fit(profiles).transform(profiles).drop("_i", "_onehot", "_raw", "_num", "features")


def curve_components(packed: DataFrame, keys, n: int = 3) -> DataFrame:
    """Mean monthly curve and leading components of each series' standardised years, as long rows.

    Signs of components are free; each is turned so that its largest loading is positive.
    """
    types = dict(packed.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", composante string, mois int, valeur double, part_variance double"

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                m = np.array([np.asarray(v, float) for v in r.matrix])
                key = [getattr(r, k) for k in keys]
                rows += [(*key, "mean", i + 1, float(v), None) for i, v in enumerate(m.mean(axis=0))]
                sd = m.std(axis=0)
                z = (m - m.mean(axis=0)) / np.where(sd == 0, 1, sd)
                val, vec = np.linalg.eigh(z.T @ z)
                total = val.sum() or 1.0
                for c in range(min(n, *m.shape)):
                    v = vec[:, -1 - c]
                    v = v * np.sign(v[np.argmax(np.abs(v))])
                    rows += [(*key, f"PC{c + 1}", i + 1, float(x), float(val[-1 - c] / total)) for i, x in enumerate(v)]
            yield pd.DataFrame(rows, columns=[*keys, "composante", "mois", "valeur", "part_variance"])

    return packed.mapInPandas(run, schema)


def component_scores(monthly_z: DataFrame, components: DataFrame, keys) -> DataFrame:
    """Score of each year on each component: standardised months times loadings, as a join and a sum."""
    load = components.filter("composante <> 'mean'").select(*keys, "composante", N.MOIS, "valeur")
    return (monthly_z.join(load, [*keys, N.MOIS]).groupBy(*keys, N.ANNEE, "composante")
            .agg(F.sum(F.col("z") * F.col("valeur")).alias("score")))
