"""Near-duplicate vectors of one label: cores around pivots, and blocks compared in full.

1. Equal vectors of a label fold into one node with their number. Pivots are reference points, at most ``PIVOTS``, taken
   from a bounded sample of all nodes: centres of its dense places first, then members far from those.
2. Every node is described by its ``DEPTH`` nearest pivots in order. Nodes of a label within half the linking angle of
   their nearest pivot are that pivot's core: any two are linked, by the triangle inequality, so a core is counted, not
   compared. A node that may link to a core without belonging to it lies within one and a half linking angles of the
   pivot; such nodes are compared with the core in blocks of bounded size.
3. All other links are between nodes outside cores. Those of a label stand in blocks, nodes of one nearest pivot together.
   Two blocks whose balls lie further apart than the linking angle are skipped; of all others every pair of vectors is
   compared, two blocks a task, tile by tile. The vectors of a label that lie apart from nothing cost their square.
4. Links become counts and a spanning set of edges as they are found; pairs are never rows.

A link is a cosine of ``COSINE`` or more in double precision; all links are found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from wattline.llm import bitset, components as cc, kit, textkit as tk

COSINE = 0.93
PIVOTS = 1024
SAMPLE = 8192
DEPTH = 16
LISTED = 5
SHARED = 6
LIST = 1024
BLOCK = 512
SPAN = 32  # blocks of nodes outside cores are so many times larger
BLOCK_CELLS = 1 << 20
TILE = 2048
GROUP_ROWS = 100_000
SEED = 91_403
_LAST = (1 << 63) - 1
_SLACK = 1e-7
_CELLS = 1 << 20
_TALLY = "uid long, n long, a long, b long"


def usable_vectors(df: DataFrame, row: str, vector: str, label: str) -> DataFrame:
    """(vec_id, v, scope, h1, h2): the vector with its fingerprint; ``scope`` is null where a row can have no links."""
    kind = "float" if df.schema[vector].dataType.simpleString() == "array<float>" else "double"
    raw = F.col(vector).cast(f"array<{kind}>")
    finite = F.forall(raw, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    usable = F.coalesce(finite & F.exists(raw, lambda c: c != 0) & F.col(label).isNotNull(), F.lit(False))
    named = df.select(F.coalesce(F.col(row).cast("long"), F.lit(_LAST)).alias("vec_id"),
                      F.when(usable, F.concat_ws(":", F.size(raw), F.col(label).cast("string"))).alias("scope"), raw.alias("v"))
    # adding zero makes -0.0 and 0.0 one value
    plain = F.transform("v", lambda c: c + F.lit(0).cast(kind))
    return named.withColumn("v", F.when(F.col("scope").isNotNull(), plain)).select(
        "vec_id", "scope", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(SEED), "v").alias("h2"))


def unit_rows(column: pa.Array, dimension: int) -> np.ndarray:
    """The vectors of a column as rows of length one in double precision, filled up with zeros."""
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]]
    sizes = np.diff(ends)
    out = np.zeros((len(sizes), dimension))
    at = np.repeat(np.arange(len(sizes)), sizes)
    out[at, np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    out /= np.abs(out).max(axis=1, initial=1e-300)[:, None]  # squares neither overflow nor vanish
    out /= np.linalg.norm(out, axis=1)[:, None]
    return out


def choose_pivots(sample: np.ndarray, pivots: int = PIVOTS, cosine: float = COSINE, apart: float = 0.8) -> np.ndarray:
    """At most ``pivots`` unit vectors whose cosines are all below ``apart``: centres of dense places first.

    A member's weight is the number of members it would link to; its centre is their mean.
    """
    weight, centres = np.zeros(len(sample), dtype=np.int64), np.empty_like(sample)
    for i in range(0, len(sample), 512):
        near = (sample[i:i + 512] @ sample.T >= cosine).astype(np.float64)
        weight[i:i + 512] = near.sum(axis=1)
        centres[i:i + 512] = near @ sample
    centres /= np.maximum(np.linalg.norm(centres, axis=1), 1e-300)[:, None]
    out = np.empty((min(pivots, len(sample)), sample.shape[1]))
    n = 0
    for i in np.argsort(-weight, kind="stable"):
        if n == len(out):
            break
        if n == 0 or (out[:n] @ centres[i]).max() < apart:
            out[n] = centres[i]
            n += 1
    return out[:n]


def describe(nodes: DataFrame, pivots: np.ndarray, depth: int, cosine: float) -> DataFrame:
    """(uid, scope, copies, first, core, halo, nearest): the place of each node among the pivots.

    ``core`` is the pivot whose ball holds the node, or -1; ``halo`` are the other pivots whose cores it may link to;
    ``nearest`` has the numbers of the ``depth`` nearest pivots in order, two bytes each.
    """
    theta = float(np.arccos(cosine))
    inner, outer = np.cos(theta / 2 - _SLACK), np.cos(min(np.pi, 1.5 * theta + _SLACK))
    shared = nodes.sparkSession.sparkContext.broadcast(pivots)

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        k = min(depth, len(p))
        for batch in tk.slices(parts, max(1, min(2048, _CELLS // p.shape[1]))):
            c = unit_rows(batch.column(4), p.shape[1]) @ p.T
            top = np.argpartition(-c, k - 1, axis=1)[:, :k]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(c, top, axis=1), axis=1, kind="stable"), axis=1)
            core = np.where(c[np.arange(len(c)), top[:, 0]] >= inner, top[:, 0], -1)
            close = c >= outer
            held = np.flatnonzero(core >= 0)
            close[held, core[held]] = False
            ends = np.concatenate([[0], np.cumsum(close.sum(axis=1))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(4)), pa.array(core, pa.int32()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(np.nonzero(close)[1], pa.int32())),
                 pa.array([r.tobytes() for r in top.astype("<u2")], pa.binary())], names=["uid", "scope", "copies", "first", "core", "halo", "nearest"])

    return nodes.select("uid", "scope", "copies", "first", "v").mapInArrow(
        place, "uid long, scope string, copies long, first long, core int, halo array<int>, nearest binary")


def with_cores(placed: DataFrame, total: int) -> DataFrame:
    """``placed`` with ``rep``, the node that stands for its core (itself outside cores), and ``inner``, its links in the core."""
    held = placed.where("core >= 0")
    balls = kit.materialize(held.groupBy("scope", "core").agg(
        F.count(F.lit(1)).alias("size"), F.sum("copies").alias("whole"), F.min("uid").alias("rep")), "vector-balls")
    inside = kit.join_hot(held, balls, ["scope", "core"], "size", total).withColumn("inner", F.col("whole") - F.col("copies")).drop("size", "whole")
    loose = placed.where("core < 0").withColumn("rep", F.col("uid")).withColumn("inner", F.lit(0).cast("long"))
    return kit.materialize(inside.unionByName(loose), "vector-cores")


def vectors_of(uids: DataFrame, nodes: DataFrame) -> DataFrame:
    """(uid, v) of the nodes named in ``uids``; a bit set of fixed size drops most others before the shuffle."""
    flags = nodes.sparkSession.sparkContext.broadcast(bitset.build(uids.select(F.xxhash64("uid").alias("h")), "h"))

    def some(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            yield batch.filter(pa.array(bitset.test(flags.value, batch.column(2).to_numpy()))).select([0, 1])

    kind = nodes.schema["v"].dataType.simpleString()
    found = nodes.select("uid", "v", F.xxhash64("uid").alias("h")).mapInArrow(some, f"uid long, v {kind}")
    return kit.materialize(found.join(uids.select("uid").distinct(), "uid", "left_semi"), "vector-needed")


def in_blocks(members: DataFrame, keys: list[str], block: int) -> DataFrame:
    """``members`` with ``block`` and ``blocks``: parts of each key of about ``block`` nodes, by a hash of the node."""
    sizes = members.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    return members.join(sizes, keys).withColumn("block", F.pmod(F.xxhash64(F.lit(SEED), "uid"), F.col("blocks")).cast("int"))


def _join(root: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
    """Joins the sets of ``one[i]`` and ``two[i]``; ``root`` names the least member of each one's set, before and after."""
    while len(one):
        a, b = root[one], root[two]
        apart = a != b
        one, two = one[apart], two[apart]
        np.minimum.at(root, np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart]))
        while (root[root] != root).any():
            root[:] = root[root]


def _tally(cosine: float):
    """Compares the two sides of a task (``side`` 0 and 1, or 2 for one block with itself) tile by tile and returns, for each
    node with links there, their number, copies counted, and a link of its representative to that of its set in the task."""
    def judge(table: pa.Table) -> pa.Table:
        side, names, copies, reps = (table.column(c).to_numpy() for c in ("side", "uid", "copies", "rep"))
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        n, root = np.zeros(len(names), dtype=np.int64), np.arange(len(names))
        if len(left) and len(right):
            vectors = table.column("v").combine_chunks()
            v = unit_rows(vectors, int(np.diff(vectors.offsets.to_numpy()).max()))
            same = bool(side[0] == 2)
            for i in range(0, len(left), TILE):
                x = left[i:i + TILE]
                for j in range(i if same else 0, len(right), TILE):
                    y = right[j:j + TILE]
                    p, q = np.nonzero(v[x] @ v[y].T >= cosine)
                    if same and i == j:  # each pair once
                        p, q = p[p < q], q[p < q]
                    p, q = x[p], y[q]
                    n += np.bincount(p, copies[q], len(n)).astype(np.int64) + np.bincount(q, copies[p], len(n)).astype(np.int64)
                    _join(root, p, q)
        some = np.flatnonzero(n)
        return pa.table({c: a.astype(np.int64) for c, a in (("uid", names[some]), ("n", n[some]), ("a", reps[some]), ("b", reps[root[some]]))})

    return judge


def core_links(placed: DataFrame, nodes: DataFrame, cosine: float, block: int) -> tuple[DataFrame, DataFrame]:
    """Counts (uid, n) and edges (a, b) of the links between cores and the nodes around them."""
    keys = ["scope", "pivot"]
    core = placed.where("core >= 0").select("scope", F.col("core").alias("pivot"), "uid", "copies", "rep")
    around = placed.select("scope", F.explode("halo").alias("pivot"), "uid", "copies", "rep", "core")
    # two cores meet from both sides; the pair belongs to the lesser pivot's core
    around = around.where("core < 0 or core > pivot").drop("core").join(core.select(*keys).distinct(), keys)
    halo = kit.materialize(in_blocks(around, keys, block), "vector-halo")
    held = kit.materialize(in_blocks(core.join(halo.select(*keys).distinct(), keys, "left_semi"), keys, block), "vector-held")

    def against(mine: DataFrame, other: DataFrame, side: int, x: str, y: str) -> DataFrame:
        parts = other.groupBy(*keys).agg(F.max("blocks").alias("parts"))
        return mine.join(parts, keys).select(*keys, F.lit(side).alias("side"), "uid", "copies", "rep", F.col("block").alias(x),
                                             F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias(y))

    tasks = against(held, halo, 0, "x", "y").unionByName(against(halo, held, 1, "y", "x"))
    tasks = tasks.join(vectors_of(held.select("uid").unionByName(halo.select("uid")), nodes), "uid")
    found = kit.materialize(tasks.groupBy(*keys, "x", "y").applyInArrow(_tally(cosine), _TALLY), "vector-around")
    return found.select("uid", "n"), found.select("a", "b").distinct()


def _ball(table: pa.Table) -> pa.Table:
    """Centre and angular radius of a block's vectors."""
    vectors = table.column("v").combine_chunks()
    v = unit_rows(vectors, int(np.diff(vectors.offsets.to_numpy()).max()))
    centre = v.sum(axis=0)
    centre /= max(np.linalg.norm(centre), 1e-300)
    return pa.table({"scope": table.column("scope")[:1], "block": table.column("block")[:1], "centre": pa.array([centre.tolist()]),
                     "radius": [float(np.arccos(np.clip((v @ centre).min(), -1, 1)))]})


def list_links(placed: DataFrame, nodes: DataFrame, pivots: int, cosine: float, listed: int, shared: int, longest: int,
               block: int) -> tuple[DataFrame, DataFrame]:
    """Counts (uid, n) and edges (a, b) of the links among nodes outside cores: of two blocks that can hold one, all pairs.

    ``pivots``, ``listed``, ``shared`` and ``longest`` bounded an index that missed links; they have no effect.
    """
    loose = placed.where("core < 0").select("scope", "uid", "copies", F.substring("nearest", 1, 2).alias("pivot"))
    dimension = nodes.agg(F.max(F.size("v"))).first()[0] or 1
    size = max(1, min(SPAN * block, BLOCK_CELLS // dimension))
    # blocks are filled pivot by pivot, so a large place among the vectors has blocks of its own
    places = loose.groupBy("scope", "pivot").agg(F.count(F.lit(1)).alias("m"))
    places = places.withColumn("start", F.sum("m").over(W.partitionBy("scope").orderBy("pivot")) - F.col("m"))
    at = F.floor((F.col("start") + F.pmod(F.xxhash64(F.lit(SEED), "uid"), F.col("m"))) / size).cast("int")
    held = loose.join(places, ["scope", "pivot"]).select("scope", "uid", "copies", at.alias("block"))
    held = kit.materialize(held.join(nodes.select("uid", "v"), "uid").withColumn("rep", F.col("uid")), "vector-loose")
    balls = held.groupBy("scope", "block").applyInArrow(_ball, "scope string, block int, centre array<double>, radius double")
    balls = kit.materialize(balls, "vector-blocks-balls")
    one, two = (balls.select("scope", *[F.col(c).alias(f"{c}{i}") for c in ("block", "centre", "radius")]) for i in (1, 2))
    dot = F.aggregate(F.zip_with("centre1", "centre2", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))
    meet = one.join(two, "scope").where("block1 <= block2")
    meet = meet.where((F.col("block1") == F.col("block2")) | (angle <= F.col("radius1") + F.col("radius2") + math.acos(cosine) + _SLACK))
    meet = kit.materialize(meet.select("scope", F.col("block1").alias("x"), F.col("block2").alias("y")), "vector-meet")
    first = held.join(meet.withColumn("block", F.col("x")), ["scope", "block"]).withColumn("side", F.when(F.col("x") == F.col("y"), 2).otherwise(0))
    second = held.join(meet.where("x < y").withColumn("block", F.col("y")), ["scope", "block"]).withColumn("side", F.lit(1))
    found = kit.materialize(first.unionByName(second).groupBy("scope", "x", "y").applyInArrow(_tally(cosine), _TALLY), "vector-blocks")
    return found.select("uid", "n"), found.select("a", "b").distinct()


def vector_groups(df: DataFrame, row: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE,
                  pivots: int = PIVOTS, sample: int = SAMPLE, depth: int = DEPTH, listed: int = LISTED, shared: int = SHARED,
                  longest: int = LIST, block: int = BLOCK, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row; linked are other rows of the same label and vector length.

    ``component_id`` is the smallest id reachable. Rows without a label, and vectors that are null, empty, zero or hold null
    or non-finite entries, have no links. Rows that share an id follow the links of their own vector each; a null id
    counts as larger than all others and comes back as null. Equal vectors are told by a 128-bit fingerprint. Other columns
    are left out; an empty table gives no rows. ``listed``, ``shared`` and ``longest`` have no effect.
    """
    spark = df.sparkSession
    rows = usable_vectors(df, row, vector, label)
    same = ["scope", "h1", "h2"]
    usable = rows.where("scope is not null")
    nodes = usable.groupBy(*same).agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first"), F.any_value("v").alias("v"))
    nodes = kit.materialize(nodes.withColumn("uid", F.monotonically_increasing_id()), "vector-nodes")
    total, dimension = nodes.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    placed = spark.createDataFrame([], "uid long, rep long, inner long, first long")
    counts, edges = spark.createDataFrame([], "uid long, n long"), spark.createDataFrame([], "a long, b long")
    if total:
        drawn = nodes.select("v", "uid", "h1").orderBy(F.xxhash64(F.lit(SEED), "h1"), "h1", "first").limit(sample).toArrow()
        points = choose_pivots(unit_rows(drawn.column("v").combine_chunks(), dimension), pivots, cosine)
        placed = with_cores(kit.materialize(describe(nodes, points, depth, cosine), "vector-places"), total)
        near, near_edges = core_links(placed, nodes, cosine, block)
        far, far_edges = list_links(placed, nodes, len(points), cosine, listed, shared, longest, block)
        counts, edges = near.unionByName(far), near_edges.unionByName(far_edges)
    # components of the nodes that stand for cores, then of all nodes
    named = kit.materialize(cc.components(edges), "vector-components").withColumnRenamed("node", "rep")
    reps = placed.groupBy("rep").agg(F.count(F.lit(1)).alias("size"), F.min("first").alias("first")).join(named, "rep", "left")
    reps = kit.materialize(reps.withColumn("component", F.coalesce("component", "rep")), "vector-reps")
    wholes = reps.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.min("first").alias("least"))
    reps = kit.join_hot(reps.drop("first").withColumnRenamed("size", "nodes"), wholes, ["component"], "size", total).select("rep", "nodes", "least")
    known = kit.join_hot(placed.select("uid", "rep", "inner"), reps, ["rep"], "nodes", total)
    linked = (nodes.select("uid", *same, "copies").join(known, "uid").join(counts.groupBy("uid").agg(F.sum("n").alias("n")), "uid", "left")
              .select(*same, (F.col("inner") + F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("least").alias("component")))
    # rows of one vector are packed in groups of bounded size, so a hot vector is no hot key
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id(), "vec_id"), F.lit(df.count() // group_rows + 1))
    packed = usable.select(*same, "vec_id").groupBy(*same, salt.alias("salt")).agg(F.collect_list("vec_id").alias("ids"))
    found = packed.join(linked, same).select(F.explode("ids").alias("vec_id"), "n_links", "component")
    alone = rows.where("scope is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component"))
    back = lambda c: F.when(F.col(c) != _LAST, F.col(c))
    return found.unionByName(alone).select(back("vec_id").alias("vec_id"), "n_links", back("component").alias("component_id"),
                                           (F.col("vec_id") == F.col("component")).alias("kept"))


def op13_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_groups(kit.table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_vector_dedup": op13_vector_dedup}
ORACLES = {"op13_vector_dedup": r"""
with recursive u as (
  select vec_id, label, len(embedding) as d, list_transform(embedding, lambda c: c::double) as v from embeddings
  where embedding is not null and label is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0
    and len(list_filter(embedding, lambda c: c <> 0)) > 0),
link as (select a.vec_id as x, b.vec_id as y from u a join u b on a.label = b.label and a.d = b.d and a.vec_id <> b.vec_id
         where list_cosine_similarity(a.v, b.v) >= 0.93),
reach as (select vec_id as a, vec_id as b from embeddings union select r.a, k.y from reach r join link k on r.b = k.x),
comp as (select a, min(b) as c from reach group by a),
n as (select x, count(*) as n from link group by x)
select e.vec_id, coalesce(n.n, 0) as n_links, c as component_id, e.vec_id = c as kept
from embeddings e join comp on a = e.vec_id left join n on n.x = e.vec_id
"""}
