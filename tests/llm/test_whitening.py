"""Whitening against plain numpy and whole-number arithmetic."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattline.llm import whitening


def usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def grid(v):
    return tuple(math.floor(64 * c) + 1_000_000 for c in v)


def make(seed=3, rows=300, d=20):
    rng = np.random.default_rng(seed)
    base = rng.normal(0, 1, (rows, d)) * np.linspace(0.2, 3, d)
    out = [(i, [float(np.float32(c)) for c in base[i]]) for i in range(rows)]
    out += [(rows + i, out[0][1]) for i in range(120)]                    # one vector with many copies
    out += [(rows + 200 + i, [c + 1e-9 for c in out[1][1]]) for i in range(3)]   # equal on the grid (mostly)
    out += [(900, None), (901, [None] * d), (902, [float("nan")] + [0.0] * (d - 1)), (903, [float("inf")] * d), (904, [1.0] * (d - 1) + [None]),
            (None, out[2][1]), (5, out[3][1]), (5, out[5][1]), (905, [1e300] * d), (906, []), (907, [0.5]), (908, [2.0, 1.0]), (909, [0.0, 0.0])]
    return out


def check(rows, got, weights="one"):
    by_length = {}
    for i, v in rows:
        if usable(v) and all(abs(64 * c) < 2.0 ** 62 for c in v):
            by_length.setdefault(len(v), []).append((i, grid(v)))
    seen = Counter()
    for d, members in by_length.items():
        copies = Counter(x for _, x in members)
        keys = sorted(copies)
        w = np.array([1 if weights == "one" else copies[k] for k in keys])
        x = np.array(keys, dtype=float).reshape(len(keys), d)
        n = int(w.sum())
        sums = [sum(int(a) * k[j] for a, k in zip(w, keys)) for j in range(d)]
        y = x - np.array([s / n for s in sums])
        v = (y * w[:, None]).T @ y / n
        e, axes = np.linalg.eigh(v)
        e, axes = e[::-1], axes[:, ::-1]
        mine = [r for r in got if r["vec_id"] in {i for i, _ in members}]
        parts = min(16, d, int((e > 1e-9 * max(e[0], 1e-300)).sum())) if d else 0
        assert len(mine) == sum(1 for _ in members) * parts
        z = {k: y[i] @ axes[:, :parts] / np.sqrt(e[:parts]) for i, k in enumerate(keys)}
        options = {}
        for i, k in members:
            options.setdefault(i, []).append(k)
        signs = {}
        for r in mine:
            c = r["component"] - 1
            fits = [k for k in options[r["vec_id"]] if sum((n * a - s) ** 2 for a, s in zip(k, sums)) == r["deviation"]]
            assert fits and r["n"] == n
            assert math.isclose(r["explained"], e[c] / np.trace(v), rel_tol=1e-9) and r["identity_error"] < 1e-8
            want = z[fits[0]][c]
            if abs(want) > 1e-6:
                signs.setdefault((d, c), np.sign(want) * np.sign(r["whitened"]))
                assert math.isclose(r["whitened"] * signs[d, c], want, rel_tol=1e-5, abs_tol=1e-6)
            seen[r["vec_id"]] += 1
    assert sum(seen.values()) == len(got)


@pytest.mark.parametrize("weights", ["one", "count"])
def test_equals_numpy(spark, weights):
    rows = make()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", F.lit("other")).withColumn("x", F.lit("other"))
    got = whitening.whiten(df.repartition(5), weights=weights, group_rows=50).collect()
    check(rows, [r.asDict() for r in got], weights)
    assert {r["component"] for r in got if r["vec_id"] == 908} == {1} and not [r for r in got if r["vec_id"] in (905, 906, 907)]


def test_query_over_floats(spark, tmp_path):
    rows = make(seed=9, rows=80, d=7)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = whitening.op12_whitening(spark, str(tmp_path))
    assert got.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    with np.errstate(over="ignore"):
        exact = [(i, v and [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    check(exact, [r.asDict() for r in got.collect()])


def test_deviations_beyond_a_long(spark):
    rows = [(i, [float(i % 7) * 1e9, float(i) * 1e6]) for i in range(40)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    keys = {i: grid(v) for i, v in rows}
    sums = [sum(k[j] for k in keys.values()) for j in range(2)]
    for r in got:
        exact = sum((40 * a - s) ** 2 for a, s in zip(keys[r["vec_id"]], sums))
        assert (r["deviation"], r["deviation_digits"]) == ((exact, None) if exact < 1 << 63 else (None, str(exact)))
    assert any(r["deviation"] is None for r in got) and len(got) == 80


def test_groups_of_equal_vectors_are_bounded(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(400)] + [(1000, [3.0, 1.0])], "vec_id long, embedding array<double>")
    assert whitening.whiten(df, group_rows=20).count() == 401
    assert whitening.whiten(df, group_rows=20).agg(F.max("n")).first()[0] == 2


def test_no_rows(spark):
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
