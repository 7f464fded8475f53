"""MinHash near-dedup with bottom-k sketches from one hash function.

1. A document's set is its distinct word shingles. Equal sets form a class with its smallest id as representative, so
   copies are one node from here on.
2. A sketch holds the ``SKETCH`` least hashes of the set (the whole set if it is smaller). Retained values are counted
   and put in one global order, rare ones first. Two sets at the threshold share so many retained values that they meet
   in the first part of that order, the prefix (see ``_prefix_length``).
3. Inverted lists of prefix values give the candidates. A list does not become all its pairs: its most central member
   is compared with the others, links are joined into components, and the next most central one is compared with
   those of other components. Documents of lists that still span several
   components go on to an exact prefix join of their full sets, with length and positional bounds, across components.
4. The union's sketch estimates the similarity; pairs clearly below the threshold go. The rest are confirmed on full
   sets. Components of the confirmed links are the groups.

A pair at the threshold fails the sketch stage with a probability below 1e-5 (sets up to ``SKETCH`` shingles: never);
most pairs are above it, and groups are usually linked more than once.
"""

from __future__ import annotations

import math
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from wattline.llm import bitset, components as cc, kit, textkit as tk

SHINGLE = 3
SKETCH = 64
NUMERATOR, DENOMINATOR = 85, 100
FILTER_BITS = 26
ROUNDS = 2
SIZE_STEP = 1.02
_WORDS, _LOWER = tk.space_table(), tk.lower_table()
_LAST = (1 << 63) - 1
_NONE = np.uint64((1 << 64) - 1)


def _sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    s, e, first = tk.word_spans(data, offsets, _WORDS)
    words = tk.word_hashes(_LOWER[data], s, e)
    grams = tk.shingle_hashes(words, k)
    whole = tk.span_hashes(words, first[:-1], first[1:]) if len(words) else None
    for d in range(len(first) - 1):
        n = int(first[d + 1] - first[d])
        yield np.unique(grams[first[d]:first[d] + n - k + 1]) if n >= k else whole[d:d + 1] if n else np.zeros(0, np.uint64)


def sketches(docs: DataFrame, k: int, size: int) -> DataFrame:
    """(uid, doc_id, th, n, f1, f2, sketch): size and fingerprint of each document's set and its least hashes."""
    def make(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = secrets.token_hex(8), 0
        for batch in parts:
            for i, j, data, offsets in tk.batches(batch.column(1)):
                n, f1, f2, kept = [], [], [], []
                for s in _sets(data, offsets, k):
                    n.append(len(s))
                    f1.append(s.sum(dtype=np.uint64))
                    f2.append(tk.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                    kept.append(s[:size])
                ends = np.concatenate([[0], np.cumsum([len(x) for x in kept])]).astype(np.int32)
                values = pa.array(tk.signed(np.concatenate(kept)) if kept else [], pa.int64())
                yield pa.RecordBatch.from_arrays([
                    pa.array([f"{task}-{made + x}" for x in range(j - i)]), batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(n, pa.int64()),
                    pa.array(tk.signed(np.array(f1, np.uint64))), pa.array(tk.signed(np.array(f2, np.uint64))),
                    pa.ListArray.from_arrays(pa.array(ends), values)], names=["uid", "doc_id", "th", "n", "f1", "f2", "sketch"])
                made += j - i

    return docs.mapInArrow(make, "uid string, doc_id long, th long, n long, f1 long, f2 long, sketch array<long>")


def _prefix_length(size: int, numerator: int, denominator: int, shared: float) -> Column:
    """Values to list so that sets at the threshold meet.

    Small sets are their own sketches, and so are all sets they may be linked to: ``n - ceil(t n) + 1``. Of a full sketch
    at least ``shared`` of the values are in the other sketch: five standard deviations below the threshold.
    """
    n, kept = F.col("n"), F.least("n", F.lit(size))
    return F.when(n * denominator <= size * numerator, n - F.ceil(n * numerator / denominator) + 1).otherwise(
        kept - F.floor(kept * shared) + 1)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and values of a column of lists of 64-bit values, or of their bytes."""
    if pa.types.is_list(column.type):
        ends = column.offsets.to_numpy()
        return ends - ends[0], column.values.to_numpy()[ends[0]:ends[-1]]
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return (ends - ends[0]) // 8, np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0]:ends[-1]].view(np.int64)


def ranked(sets: DataFrame, values: str, kept: Column, bits: int = FILTER_BITS) -> DataFrame:
    """(rep, n, v, score, at): the values that several sets hold, and their place in the set's order of rarity.

    ``sets`` has ``rep``, ``n``, ``f1`` and ``values``; ``kept`` is the number of values there. Values of one set alone come first in the
    order; they are only counted. A bit set of fixed size drops most of them before values are shuffled, and the exact
    counts drop the rest. ``score`` is high for sets of common values.
    """
    def cells(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.slices(parts):
            cell, n = np.unique(_flat(batch.column(0))[1] & np.int64((1 << bits) - 1), return_counts=True)
            yield pa.RecordBatch.from_pydict({"cell": cell, "n": n})

    twice = sets.select(values).mapInArrow(cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where("n > 1")
    flags = sets.sparkSession.sparkContext.broadcast(bitset.build(twice, "cell", bits))

    def spread(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.slices(parts):
            ends, flat = _flat(batch.column(3))
            of = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            ok = bitset.test(flags.value, flat)
            of = pa.array(of[ok])
            yield pa.RecordBatch.from_arrays([batch.column(i).take(of) for i in range(3)] + [pa.array(flat[ok])], names=["rep", "n", "f1", "v"])

    listed = kit.materialize(sets.select("rep", "n", "f1", values).mapInArrow(spread, "rep long, n long, f1 long, v long"), "near-values")
    counts = kit.materialize(listed.groupBy("v").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "near-counts")
    own = Window.partitionBy("rep", "f1")
    rank = F.row_number().over(own.orderBy("c", "v"))
    return listed.join(counts, "v").select(
        "rep", "n", "v", F.round(F.sum(F.log2("c")).over(own) / kept, 6).alias("score"), (kept - F.count(F.lit(1)).over(own) + rank - 1).alias("at"))


def _estimate(size: int, numerator: int, denominator: int, shared: float):
    def judge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs not ruled out by the union's sketch; ``sure`` where both sketches are whole sets and decide."""
        for batch in tk.slices(parts, 2000):
            m = batch.num_rows
            grid = np.full((m, 2 * size), _NONE)
            for at, column in ((0, 4), (size, 5)):
                ends, flat = batch.column(column).offsets.to_numpy(), batch.column(column).values.to_numpy().view(np.uint64)
                lens = np.diff(ends)
                row = np.repeat(np.arange(m), lens)
                grid[row, at + np.arange(len(row)) - np.repeat(ends[:-1] - ends[0], lens)] = flat[ends[0]:ends[-1]]
            grid.sort(axis=1)
            real = grid != _NONE
            twin = np.zeros_like(real)
            twin[:, 1:] = (grid[:, 1:] == grid[:, :-1]) & real[:, 1:]
            rank = np.cumsum(real & ~twin, axis=1)
            na, nb = batch.column(1).to_numpy(), batch.column(3).to_numpy()
            whole = (na <= size) & (nb <= size)
            common = twin.sum(axis=1)
            exact = denominator * common >= numerator * (na + nb - common)
            inside = (twin & (rank <= size)).sum(axis=1)
            keep = np.where(whole, exact, inside >= shared * np.minimum(size, rank[:, -1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(whole)], names=["a", "b", "sure"]).filter(pa.array(keep))

    return judge


def _confirm(numerator: int, denominator: int):
    def judge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.slices(parts):
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(denominator * common >= numerator * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return judge


def full_sets(needed: DataFrame, reps: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(rep, n, f1, full) of the representatives ``needed`` (``rep``): their whole sets, sorted, as 64-bit values."""
    flags = docs.sparkSession.sparkContext.broadcast(bitset.build(needed.select(F.xxhash64("rep").alias("h")), "h"))

    def make(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            batch = batch.filter(pa.array(bitset.test(flags.value, batch.column(2).to_numpy())))
            for i, j, data, offsets in tk.batches(batch.column(1)):
                made = list(_sets(data, offsets, k))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, j - i), pa.array([len(s) for s in made], pa.int64()),
                    pa.array([s.sum(dtype=np.uint64).view(np.int64) for s in made], pa.int64()),
                    pa.array([s.tobytes() for s in made], pa.binary())], names=["rep", "n", "f1", "full"])

    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("h"))
    sets = keyed.mapInArrow(make, "rep long, n long, f1 long, full binary").join(needed.distinct(), "rep", "left_semi")
    return kit.materialize(sets.join(reps.select("rep", "n", "f1"), ["rep", "n", "f1"], "left_semi").dropDuplicates(["rep", "f1"]), "near-sets")


def confirmed(pairs: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    return (pairs.select("a", "b").join(sets.select(F.col("rep").alias("b"), F.col("full").alias("fb")), "b")
            .join(sets.select(F.col("rep").alias("a"), F.col("full").alias("fa")), "a")
            .select("a", "b", "fa", "fb").mapInArrow(_confirm(numerator, denominator), "a long, b long"))


def likely(pairs: DataFrame, reps: DataFrame, size: int, numerator: int, denominator: int, shared: float) -> DataFrame:
    """(a, b, sure): the pairs that the union's sketch does not rule out; sure where it decides."""
    one = reps.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    other = reps.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    return kit.materialize(
        pairs.join(one, "b").join(other, "a").select("a", "na", "b", "nb", "sa", "sb")
        .mapInArrow(_estimate(size, numerator, denominator, shared), "a long, b long, sure boolean"), "near-likely")


def crossing(sets: DataFrame, comps: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Candidate pairs (a, b) of full sets in different components, by an exact prefix join.

    In the order of rarity the first common value of a pair stands early in both sets, the earlier the more similar in
    size they are: with ``o`` values in common at least, at most ``n - o`` values of a set stand before it. The smaller set
    needs only the places that a partner of its own size allows; the larger set's place bounds the partner's size, which
    is matched in steps of ``SIZE_STEP``. So sets with more values of their own than links allow meet nobody.
    """
    step, both = float(np.log(SIZE_STEP)), numerator + denominator
    placed = ranked(sets, "full", F.col("n")).where(F.col("at") < F.col("n") - F.ceil(F.col("n") * numerator / denominator) + 1)
    listed = kit.materialize(placed.join(comps, "rep").select("v", "rep", "comp", "n", "at"), "near-crossing")
    need = F.ceil(F.lit(numerator) * (F.col("n") + F.col("m")) / both)
    small = listed.where((F.col("n") - F.col("at")) * both >= 2 * numerator * F.col("n")).withColumn("bucket", F.floor(F.log("n") / step))
    most = (F.col("n") - F.col("at")) * both / numerator - F.col("n")
    least = F.floor(F.log(F.col("n") * numerator / denominator) / step) - 1
    large = listed.where(most >= F.col("n") * numerator / denominator - 1).select(
        "v", F.col("rep").alias("other"), F.col("comp").alias("other_comp"), F.col("n").alias("m"), F.col("at").alias("other_at"),
        F.explode(F.sequence(least, F.least(F.floor(F.log(F.greatest(most, F.lit(1.0))) / step) + 1, F.floor(F.log("n") / step)))).alias("bucket"))
    met = small.join(large, ["v", "bucket"]).where(
        (F.col("comp") != F.col("other_comp")) & ((F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("rep") < F.col("other"))))
        & (F.col("n") * denominator >= F.col("m") * numerator) & (F.least(F.col("n") - F.col("at"), F.col("m") - F.col("other_at")) >= need))
    return _ordered(met.select(F.col("rep").alias("a"), F.col("other").alias("b")))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def links(reps: DataFrame, docs: DataFrame, k: int, size: int, numerator: int, denominator: int, shared: float,
          rounds: int) -> DataFrame:
    """Confirmed links that connect whatever all links connect."""
    prefix = F.col("at") < _prefix_length(size, numerator, denominator, shared)
    found = kit.materialize(ranked(reps, "sketch", F.least("n", F.lit(size))).where(prefix).drop("at"), "near-postings")
    close = F.least("n", "other_n") * denominator >= F.greatest("n", "other_n") * numerator
    lists = found.withColumn("comp", F.col("rep"))
    edges = reps.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)
    for turn in range(rounds + 1):
        spread = lists.groupBy("v").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"),
                                        F.max_by(F.struct("rep", "n", "comp"), F.struct("score", -F.col("rep"))).alias("c"))
        spread = kit.materialize(spread.where("lo <> hi").select("v", F.col("c.rep").alias("other"), F.col("c.n").alias("other_n"),
                                                                 F.col("c.comp").alias("other_comp")), "near-centres")
        if spread.isEmpty():
            return edges
        if turn == rounds:
            open_docs = kit.materialize(lists.join(spread.select("v"), "v", "left_semi").select("rep", "comp").distinct(), "near-open")
            sets = full_sets(open_docs.select("rep"), reps, docs, k)
            pairs = kit.materialize(crossing(sets, open_docs, numerator, denominator), "near-pairs")
            return edges.unionByName(kit.materialize(confirmed(pairs, sets, numerator, denominator), "near-links"))
        pairs = lists.join(spread, "v").where(close & (F.col("comp") != F.col("other_comp"))).select(F.col("other").alias("a"), F.col("rep").alias("b"))
        some = likely(_ordered(pairs), reps, size, numerator, denominator, shared)
        unsure = some.where("not sure")
        sets = full_sets(unsure.select(F.explode(F.array("a", "b")).alias("rep")), reps, docs, k)
        new = some.where("sure").select("a", "b").unionByName(confirmed(unsure, sets, numerator, denominator))
        edges = edges.unionByName(kit.materialize(new, "near-links"))
        named = kit.materialize(cc.components(edges), "near-labels").withColumnRenamed("node", "rep")
        lists = (lists.drop("comp").join(named, "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component"))
        if turn + 1 < rounds:  # the next centre is the next most central member
            passed = F.when(F.col("rep") == F.col("other"), F.lit(-1.0)).otherwise(F.col("score"))
            lists = lists.join(spread.select("v", "other"), "v").withColumn("score", passed).drop("other")
        lists = kit.materialize(lists, "near-lists")


def groups(df: DataFrame, row: str = "doc_id", text: str = "text", shingle: int = SHINGLE, size: int = SKETCH,
           numerator: int = NUMERATOR, denominator: int = DENOMINATOR,
           rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash) for every row of ``df``; ``text_hash`` is xxhash64 of the text.

    Sets with ``denominator * common >= numerator * union`` are linked; a group's id is its smallest document id. Words
    are runs of anything but ``[\\x20\\x09-\\x0D]``, A-Z lower-cased; a text of fewer words than a shingle is one shingle.
    Null texts and texts without words have no set and no links. Rows that share an id follow the class of their own
    text each. A null id counts as larger than all others and comes back as null.
    """
    docs = df.select(F.coalesce(F.col(row).cast("long"), F.lit(_LAST)).alias("doc_id"), F.col(text).cast("string").alias("text"),
                     F.xxhash64(text).alias("th"))
    rows = kit.materialize(sketches(docs, shingle, size), "near-sketches")
    classes = kit.materialize(rows.where("n > 0").groupBy("n", "f1", "f2").agg(F.min(F.struct("doc_id", "uid")).alias("r")), "near-classes")
    slim = rows.select("uid", "doc_id", "th", "n", "f1", "f2")
    members = kit.materialize(slim.join(classes, ["n", "f1", "f2"], "left").select(
        "uid", "doc_id", "th", "n", F.coalesce("r.doc_id", "doc_id").alias("rep"), (F.col("uid") == F.col("r.uid")).alias("first")), "near-members")
    reps = kit.materialize(rows.join(members.where("first").select("uid", "rep"), "uid").select("rep", "n", "f1", "sketch"), "near-reps")
    t = numerator / denominator
    shared = t - 5 * math.sqrt(t * (1 - t) / size)
    edges = links(reps, docs, shingle, size, numerator, denominator, shared, rounds)
    labels = kit.materialize(cc.components(edges), "near-components")
    named = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("c", F.coalesce("component", "rep"))
    back = lambda c: F.when(F.col(c) != _LAST, F.col(c))
    return named.select(back("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), back("c").alias("component_id"),
                        (F.col("doc_id") == F.col("c")).alias("kept"), F.col("th").alias("text_hash"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(kit.table(spark, sf_dir, "documents")).drop("text_hash")


QUERIES = {"op4_near_dedup": op4_near_dedup}
ORACLES = {"op4_near_dedup": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') as w from documents),
s as (
  select distinct doc_id, array_to_string(list_slice(w, i, i + 2), ' ') as g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as i from w where len(w) > 0)),
size as (select doc_id, count(*) as n from s group by doc_id),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
link as (select x, y from pairs join size p on p.doc_id = x join size q on q.doc_id = y where 100 * c >= 85 * (p.n + q.n - c)),
twoway as (select x, y from link union select y, x from link),
reach as (select doc_id as a, doc_id as b from w union select r.a, k.y from reach r join twoway k on r.b = k.x),
comp as (select a, min(b) as c from reach group by a)
select w.doc_id, coalesce(n, 0) as n_shingles, c as component_id, w.doc_id = c as kept
from w join comp on a = w.doc_id left join size on size.doc_id = w.doc_id
"""}
