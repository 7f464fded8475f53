"""Whitening of vectors on a fixed grid, by a covariance over distinct vectors weighted by their multiplicity or by one.

1. Entries become whole numbers, so equal vectors are equal exactly. Rows with the same vector are packed in groups of
   bounded size (the vector and a salt from the row's id), groups fold into distinct vectors with their counts.
2. Sums are exact. Each task subtracts the mean, first its whole part, and adds up one weighted matrix product; the
   cells of the products are summed. The driver gets one matrix and its eigenvectors.
3. Every distinct vector is projected once and joined back to its packed rows.

Vectors of different length have nothing in common: each length is a fit of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from wattline.llm import kit

STEPS = 64
SHIFT = 1_000_000
COMPONENTS = 16
GROUP_ROWS = 100_000
_LONGEST = 2.0 ** 62
_HIGH, _LOW = 32, (1 << 32) - 1


@dataclass
class Fit:
    """A fit of one vector length: weights' total, exact sums, components (one a column) and their eigenvalues."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    @property
    def centre(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whole part of the mean, the rest of the sums, and the mean's fraction."""
        base = [s // self.n for s in self.sums]
        rest = np.array([s - b * self.n for s, b in zip(self.sums, base)], dtype=np.int64)
        return np.array(base, dtype=np.int64), rest, rest / self.n


def gridded(df: DataFrame, row: str, vector: str) -> DataFrame:
    """(vec_id, x): whole-number vectors of the rows whose entries are all there, finite and within a long's range."""
    entries = F.col(vector).cast("array<double>")
    usable = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * STEPS) < _LONGEST))
    return df.where(F.coalesce(usable, F.lit(False))).select(
        F.col(row).cast("long").alias("vec_id"), F.transform(entries, lambda c: F.floor(c * STEPS) + F.lit(SHIFT)).alias("x"))


def _matrix(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length among the lists of a column."""
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(ends)
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        yield rows, flat[ends[rows][:, None] + np.arange(d)[None, :]]


def covariance(vectors: DataFrame, column: str, weight: str, centred, totals: dict[int, int]) -> dict[int, np.ndarray]:
    """Weighted covariances by vector length; ``centred(d, matrix)`` subtracts the mean, ``totals`` are the divisors."""
    def products(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in parts:
            weights = batch.column(1).to_numpy().astype(np.float64)
            for rows, m in _matrix(batch.column(0)):
                y = centred(m.shape[1], m)
                sums[m.shape[1]] = sums.get(m.shape[1], 0.0) + (y * weights[rows][:, None]).T @ y
        for d, c in sums.items():
            if d:
                yield pa.RecordBatch.from_pydict({"d": np.full(d * d, d, dtype=np.int64), "cell": np.arange(d * d), "value": c.reshape(-1)})

    cells = vectors.select(column, weight).mapInArrow(products, "d long, cell long, value double").groupBy("d", "cell").agg(F.sum("value").alias("value"))
    got = cells.toArrow()
    d, cell, value = (got.column(i).to_numpy() for i in range(3))
    out = {}
    for length in np.unique(d).tolist():
        flat = np.zeros(length * length)
        flat[cell[d == length]] = value[d == length]
        out[length] = flat.reshape(length, length) / totals[length]
    return out


def _exact_sums(distinct: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Total weight and sums of each vector length, as whole numbers of any size."""
    spread = distinct.select(F.size("x").alias("d"), "weight", F.posexplode("x").alias("at", "x"))
    high, low = F.shiftright("x", _HIGH), F.col("x").bitwiseAND(F.lit(_LOW))
    found: dict[int, tuple[int, dict[int, int]]] = {}
    for r in spread.groupBy("d", "at").agg(F.sum(high * F.col("weight")).alias("high"), F.sum(low * F.col("weight")).alias("low"),
                                           F.sum("weight").alias("n")).collect():
        found.setdefault(r["d"], (r["n"], {}))[1][r["at"]] = (r["high"] << _HIGH) + r["low"]
    return {d: (n, [sums[i] for i in range(d)]) for d, (n, sums) in found.items()}


def fit(distinct: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """The fit of each vector length of ``distinct`` (x, weight); components without variance are left out."""
    empty = np.zeros(0)
    fits = {d: Fit(n, sums, empty, empty, empty) for d, (n, sums) in _exact_sums(distinct).items()}
    centres = {d: f.centre for d, f in fits.items()}

    def centred(d: int, x: np.ndarray) -> np.ndarray:
        if d not in centres:
            return x.astype(np.float64)
        base, _, fraction = centres[d]
        return (x - base) - fraction

    for d, v in covariance(distinct, "x", "weight", centred, {d: f.n for d, f in fits.items()}).items():
        values, axes = np.linalg.eigh(v)
        values, axes = values[::-1], axes[:, ::-1]
        kept = int((values[:components] > d * np.finfo(float).eps * max(values[0], 0.0)).sum()) if values[0] > 0 else 0
        fits[d].axes, fits[d].values = axes[:, :kept], values[:kept]
        fits[d].explained = values[:kept] / np.trace(v)
    return fits


def _project(fits: dict[int, Fit]):
    centres = {d: f.centre for d, f in fits.items()}

    def deviations(f: Fit, centre, x: np.ndarray, y: np.ndarray) -> list[int]:
        base, rest, _ = centre
        if f.n * (np.abs(y).max(initial=0.0) + 1) * np.sqrt(max(1, x.shape[1])) < 2.0 ** 31:
            return ((f.n * (x - base) - rest) ** 2).sum(axis=1).tolist()
        wide = f.n * (x - base).astype(object) - rest.astype(object)
        return [sum(t * t for t in r) for r in wide.tolist()]

    def project(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            exact: list = [None] * batch.num_rows
            scores: list = [None] * batch.num_rows
            for rows, x in _matrix(batch.column(0)):
                if x.shape[1] not in fits:
                    continue
                f, centre = fits[x.shape[1]], centres[x.shape[1]]
                y = (x - centre[0]) - centre[2]
                z = y @ f.axes / np.sqrt(f.values)
                for i, e, s in zip(rows.tolist(), deviations(f, centre, x, y), z):
                    exact[i], scores[i] = e, s
            fits_long = [e if e is not None and e < 1 << 63 else None for e in exact]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fits_long, pa.int64()),
                 pa.array([str(e) if e is not None and e >= 1 << 63 else None for e in exact], pa.string()), pa.array(scores, pa.list_(pa.float64()))],
                names=["x", "weight", "deviation", "deviation_digits", "z"])

    return project


def _identity_errors(white: DataFrame, totals: dict[int, int]) -> dict[int, float]:
    """By vector length, how far the covariance of the whitened vectors is from the identity."""
    means: dict[int, dict[int, float]] = {}
    lengths = white.select(F.size("x").alias("d"), "weight", F.posexplode("z").alias("at", "z"))
    for r in lengths.groupBy("d", "at").agg((F.sum(F.col("z") * F.col("weight")) / F.sum("weight")).alias("m")).collect():
        means.setdefault(r["d"], {})[r["at"]] = r["m"]
    out = {}
    for d, m in means.items():
        mean = np.array([m[i] for i in range(len(m))])
        one = white.where(F.size("x") == d)
        c = covariance(one, "z", "weight", lambda _, z, mean=mean: z - mean, {len(m): totals[d]})[len(m)]
        out[d] = float(np.abs(c - np.eye(len(m))).max())
    return out


def whiten(df: DataFrame, row: str = "vec_id", vector: str = "embedding", weights: str = "one", components: int = COMPONENTS,
           group_rows: int = GROUP_ROWS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_digits) for every usable row.

    ``weights`` is ``one`` (each distinct vector counts once) or ``count`` (as often as it occurs). Rows are dropped if the
    vector is null or has null, non-finite or too large entries (64 times the entry is no long). Components without
    variance are left out, so vectors of no entries, or of a length with one distinct vector only, give no rows. Rows that
    share an id, or have none, are all returned. ``deviation`` is null where it is no long; ``deviation_digits`` has it then.
    Other columns are left out; an empty table gives no rows.
    """
    spark = df.sparkSession
    salts = df.count() // group_rows + 1  # no group holds many more rows than ``group_rows``, whatever repeats
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id(), "vec_id"), F.lit(salts))
    packed = kit.materialize(gridded(df, row, vector).groupBy("x", salt.alias("salt")).agg(F.collect_list(F.struct("vec_id")).alias("rows")), "whiten-packed")
    weight = F.lit(1).cast("long") if weights == "one" else F.sum(F.size("rows")).cast("long")
    distinct = kit.materialize(packed.groupBy("x").agg(F.count(F.lit(1)).alias("groups"), weight.alias("weight")).drop("groups"), "whiten-distinct")
    fits = fit(distinct, components)
    white = kit.materialize(distinct.select("x", "weight").mapInArrow(
        _project(fits), "x array<long>, weight long, deviation long, deviation_digits string, z array<double>"), "whiten-projected")
    errors = _identity_errors(white, {d: f.n for d, f in fits.items()})
    known = [(d, f.n, f.explained.tolist(), errors[d]) for d, f in fits.items() if d in errors]
    table = spark.createDataFrame(known, "d int, n long, explained array<double>, identity_error double")
    joined = packed.join(white.select("x", "deviation", "deviation_digits", "z"), "x").withColumn("d", F.size("x")).join(F.broadcast(table), "d")
    one = joined.select(F.explode("rows").alias("r"), "n", "deviation", "deviation_digits", "z", "explained", "identity_error")
    each = one.select("r.vec_id", "n", "deviation", "deviation_digits", "explained", "identity_error", F.posexplode("z").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened",
                       F.element_at("explained", F.col("at") + 1).alias("explained"), "identity_error", "deviation_digits")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(kit.table(spark, sf_dir, "embeddings"))


QUERIES = {"op12_whitening": op12_whitening}
ORACLES = {}
