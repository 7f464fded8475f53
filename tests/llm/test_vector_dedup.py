"""Near-duplicate vectors against all pairs."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattline.llm import kit, vector_dedup as vd

LAST = (1 << 63) - 1


def usable(v, label):
    return v is not None and label is not None and all(c is not None and math.isfinite(c) for c in v) and any(v)


def brute(rows):
    """Sorted (vec_id, n_links, component_id, kept) by all cosines."""
    scopes = defaultdict(list)
    for at, (i, v, label) in enumerate(rows):
        if usable(v, label):
            scopes[label, len(v)].append(at)
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for members in scopes.values():
        m = np.array([rows[at][1] for at in members], dtype=float)
        m /= np.abs(m).max(axis=1)[:, None]
        m /= np.linalg.norm(m, axis=1)[:, None]
        hit = m @ m.T >= 0.93
        np.fill_diagonal(hit, False)
        for x, y in zip(*np.nonzero(hit)):
            links[members[x]] += 1
            a, b = root(members[x]), root(members[y])
            parent[a] = b
    ids = [LAST if r[0] is None else r[0] for r in rows]
    least = defaultdict(lambda: LAST)
    for at in range(len(rows)):
        least[root(at)] = min(least[root(at)], ids[at])
    out = []
    for at, (i, *_) in enumerate(rows):
        c = least[root(at)]
        out.append((i, links[at], None if c == LAST else c, ids[at] == c))
    return sorted(out, key=str)


def near(rng, base, cosine, rows):
    noise = rng.normal(0, 1, (rows, len(base)))
    noise -= np.outer(noise @ base, base) / (base @ base)
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    return cosine * base / np.linalg.norm(base) + math.sqrt(1 - cosine ** 2) * noise


def make(seed=1, d=24):
    rng = np.random.default_rng(seed)
    rows = [(i, v, int(i % 3)) for i, v in enumerate(rng.normal(0, 1, (150, d)))]
    put = lambda vs, label: rows.extend([(len(rows) + k, v, label) for k, v in enumerate(vs)])
    for cosine, n, label in ((0.995, 90, 0), (0.97, 40, 1), (0.955, 30, 1), (0.94, 25, 2), (0.999, 5, 2)):  # tight and loose groups
        put(near(rng, rng.normal(0, 1, d), cosine, n), label)
    chain = rng.normal(0, 1, d)
    for _ in range(12):  # each near the one before
        chain = near(rng, chain, 0.95, 1)[0]
        put([chain], 0)
    put([rows[0][1]] * 20, 0)            # copies
    put([rows[0][1] * 3.0], 0)           # same direction
    put([rows[0][1]] * 2, 1)             # same vector, other label
    rows = [(i, [float(c) for c in v], label) for i, v, label in rows]
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [None] * d, 0), (n + 2, [0.0] * d, 0), (n + 3, [float("nan")] + [1.0] * (d - 1), 0),
             (n + 4, [float("inf")] * d, 0), (n + 5, rows[0][1], None), (n + 6, [], 0), (n + 7, [1.0, 2.0], 0), (n + 8, [2.0, 4.1], 0),
             (n + 9, rows[0][1][:-1] + [-0.0], 0), (n + 10, rows[0][1][:-1] + [0.0], 0),
             (None, rows[1][1], 1), (3, rows[4][1], 1), (3, rows[8][1], 2), (n + 11, [1e200, 1e200], 0), (n + 12, [1e-200, 1e-200], 0)]
    return rows


def found(df, **options):
    return sorted(map(tuple, vd.vector_groups(df, **options).collect()), key=str)


@pytest.mark.parametrize("options", [
    {"sample": 40, "block": 4, "group_rows": 7}, {"sample": 12, "pivots": 8, "shared": 1, "longest": 4, "block": 3}, {"sample": 1, "longest": 30, "block": 16}])
def test_equals_all_pairs(spark, options):
    rows = make()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(6)
    df = df.withColumn("n", F.lit("other")).withColumn("uid", F.lit("other")).withColumn("copies", F.lit("other"))
    assert found(df, **options) == brute(rows)


def test_query_over_floats(spark, tmp_path):
    rows = [(i, v and [None if c is None else float(np.float32(c)) if math.isfinite(c) and abs(c) < 1e30 and (c == 0 or abs(c) > 1e-30) else c for c in v], label)
            for i, v, label in make(4) if v is None or 1e-200 not in v and 1e200 not in v]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = vd.op13_vector_dedup(spark, str(tmp_path))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_recall_of_pairs_no_pivot_knows(spark):
    """Pairs of random vectors of which the bounded sample has no dense place; each label has pairs of one cosine."""
    rows = []
    for label, cosine in enumerate((0.931, 0.95, 0.98)):
        rng = np.random.default_rng(label)
        base = rng.normal(0, 1, (1500, 64))
        twins = np.array([near(rng, b, cosine, 1)[0] for b in base])
        rows += [(len(rows) + i, v.tolist(), label) for i, v in enumerate(np.concatenate([base, twins]))]
    got = vd.vector_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), sample=1200)
    assert got.where("n_links > 1").count() == 0
    found = dict(got.where("n_links = 1").groupBy((F.col("vec_id") / 3000).cast("int")).count().collect())
    recall = [found[label] / 3000 for label in range(3)]
    assert recall[0] >= 0.9 and recall[1] >= 0.93 and recall[2] >= 0.99, recall


def test_pivots_cover_dense_places_first():
    rng = np.random.default_rng(0)
    loose = rng.normal(0, 1, (300, 32))
    loose /= np.linalg.norm(loose, axis=1)[:, None]
    base = loose[7]
    group = near(rng, base, 0.99, 60)
    points = vd.choose_pivots(np.concatenate([loose, group]), pivots=20)
    assert points.shape == (20, 32) and (points[0] @ group.T).min() > math.cos(math.acos(0.93) / 2)
    cosines = points @ points.T - np.eye(20)
    assert cosines.max() < 0.8


def test_pairs_of_a_large_group_are_never_rows(spark):
    """A core gives one edge and one count a node."""
    rng = np.random.default_rng(2)
    group = near(rng, rng.normal(0, 1, 16), 0.995, 600)
    nodes = spark.createDataFrame([(i, "s", 1, i, v.tolist()) for i, v in enumerate(group)], "uid long, scope string, copies long, first long, v array<double>")
    placed = vd.with_cores(vd.describe(nodes, vd.choose_pivots(group[:50]), vd.DEPTH, vd.COSINE), 600)
    assert {(r["rep"], r["inner"]) for r in placed.collect()} == {(0, 599)}
    counts, edges = vd.core_links(placed, nodes, vd.COSINE, vd.BLOCK)
    assert counts.count() == 0 and edges.count() == 0
    counts, edges = vd.list_links(placed, nodes, 1, vd.COSINE, vd.LISTED, vd.SHARED, vd.LIST, vd.BLOCK)
    assert counts.count() == 0 and edges.count() == 0


def test_large_groups_are_joined_apart(spark):
    rows = spark.createDataFrame([(i, min(i, 5)) for i in range(40)], "id long, k long")
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("size"))
    got = kit.join_hot(rows, groups, ["k"], "size", 40, least=10)
    assert sorted((r["id"], r["k"], r["size"]) for r in got.collect()) == [(i, min(i, 5), 1 if i < 5 else 35) for i in range(40)]


def test_no_rows(spark):
    assert vd.vector_groups(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_no_link_is_left_out(spark):
    """Pairs of random vectors at the threshold, and groups that only one pair of vectors joins, in more than one block."""
    rng = np.random.default_rng(11)
    base = rng.normal(0, 1, (400, 64))
    vectors = [*base, *[near(rng, b, 0.9301, 1)[0] for b in base]]
    for cosine in (0.931, 0.934, 0.94):  # paths: each vector near the one before and no other
        path = rng.normal(0, 1, 64)
        for _ in range(40):
            vectors.append(path)
            path = near(rng, path, cosine, 1)[0]
    order = rng.permutation(len(vectors))
    rows = [(i, [float(c) for c in vectors[k]], 0) for i, k in enumerate(order)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    want = brute(rows)
    assert found(df, sample=60) == want
    assert found(df, sample=60, block=2) == want


def test_sets_of_a_task_are_joined_by_any_of_their_links():
    root = np.arange(6)
    # 0-5 and 3-4, joined by 4-5 alone, whose members each have a lesser neighbour
    vd._join(root, np.array([0, 3, 4]), np.array([5, 4, 5]))
    assert root.tolist() == [0, 1, 2, 0, 0, 0]
