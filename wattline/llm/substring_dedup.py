"""Substring dedup: word windows that also start in a document with a smaller id are cut out.

Count-min prefilter. A window is counted through its anchor, the least hash among its runs of ``GRAM`` words: equal
windows have equal anchors, so a window occurs no oftener than its anchor, and an anchor no oftener than its sketch
counter says. Consecutive windows share an anchor, so the sketch takes one entry for some twenty windows.

1. Each document becomes runs of windows with one anchor. The partitions' sketches (``DEPTH`` rows of counters) are
   merged by addition; anchors with a counter below 2 in any row are dropped: their windows can't occur twice.
2. Second pass, exact. Runs with the same words form a class, owned by its smallest document: in all larger ones the
   whole run goes. Where an anchor has several classes, the windows of the owners' runs are grouped one by one.
3. Covered words are removed from each text.

Sequences are compared by 128-bit fingerprints. Tasks get the merged sketch as bit sets of fixed size; in larger corpora
these let more runs through to the exact pass and change no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from wattline.llm import bitset, kit, textkit as tk

WINDOW = 50
GRAM = 8
DEPTH = 2
WIDTH_BITS = 26
_WORDS = tk.space_table()
_SECTION = 1 << 20
_LAST = (1 << 63) - 1


def _anchors(words: np.ndarray, owner: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and anchor value of each run of windows inside one text."""
    grams, reach = tk.shingle_hashes(words, gram), window - gram + 1
    starts, counts, values = [], [], []
    total = len(words) - window + 1
    for a in range(0, max(0, total), _SECTION):
        b = min(total, a + _SECTION)
        part = grams[a:b + reach - 1]
        key = (part & ~np.uint64((1 << 21) - 1)) | np.arange(len(part), dtype=np.uint64)
        span, least = 1, key
        while span * 2 <= reach:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < reach:
            least = np.minimum(least[:len(key) - reach + 1], least[reach - span:])
        at = (least & np.uint64((1 << 21) - 1)).astype(np.int64)
        inside = owner[a:b] == owner[a + window - 1:b + window - 1]
        fresh = inside.copy()
        fresh[1:] &= ~inside[:-1] | (at[1:] != at[:-1])
        heads = np.flatnonzero(fresh)
        stop = ~inside
        ends = np.append(heads[1:], len(at))
        if stop.any():
            outs = np.append(np.flatnonzero(stop), len(at))
            ends = np.minimum(ends, outs[np.searchsorted(outs, heads)])
        starts.append(heads + a)
        counts.append(ends - heads)
        values.append(part[at[heads]])
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(counts), np.concatenate(values)


def runs(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc_id, th, start, n, g, c): runs of windows, their anchors and the fingerprint of the run's words."""
    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            ids, marks = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            for i, _, data, offsets in tk.batches(batch.column(2)):
                s, e, first = tk.word_spans(data, offsets, _WORDS)
                owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
                start, n, g = _anchors(tk.word_hashes(data, s, e), owner, window, gram)
                c = tk.span_hashes(tk.word_hashes(data, s, e, 1), start, start + n + window - 1, 1)
                of = owner[start]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": ids[i + of], "th": marks[i + of], "start": (start - first[of]).astype(np.int32), "n": n.astype(np.int32),
                    "g": tk.signed(g), "c": tk.signed(c)})

    return docs.mapInArrow(cut, "doc_id long, th long, start int, n int, g long, c long")


def repeated(found: DataFrame, depth: int = DEPTH, bits: int = WIDTH_BITS) -> DataFrame:
    """The runs whose anchor has a count-min estimate of 2 or more."""
    cells = [F.xxhash64(F.lit(r), "g").bitwiseAND(F.lit((1 << bits) - 1)).alias(f"c{r}") for r in range(depth)]
    share = found.sparkSession.sparkContext.broadcast
    filters = []
    for r in range(depth):
        counters = found.select(cells[r]).groupBy(f"c{r}").agg(F.count(F.lit(1)).alias("n"))
        filters.append(share(bitset.build(counters.where("n > 1"), f"c{r}", bits)))

    def keep(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            ok = np.ones(batch.num_rows, dtype=bool)
            for r, f in enumerate(filters):
                ok &= bitset.test(f.value, batch.column(6 + r).to_numpy())
            yield batch.select(list(range(6))).filter(pa.array(ok))

    return found.select("*", *cells).mapInArrow(keep, found.schema)


def _windows(rows: DataFrame, window: int) -> DataFrame:
    """(doc_id, th, start, w1, w2) for every window of the runs listed with each text."""
    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            ids, marks = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            lists = batch.column(3)
            bounds, fields = lists.offsets.to_numpy(), lists.values
            at, many = fields.field("start").to_numpy(), fields.field("n").to_numpy()
            for i, j, data, offsets in tk.batches(batch.column(2)):
                s, e, first = tk.word_spans(data, offsets, _WORDS)
                lo, hi = bounds[i], bounds[j]
                of = np.repeat(np.arange(j - i), np.diff(bounds[i:j + 1]))
                place = tk.ranges(first[of] + at[lo:hi], many[lo:hi])
                of = np.repeat(of, many[lo:hi])
                w = [tk.signed(tk.span_hashes(tk.word_hashes(data, s, e, k), place, place + window, k)) for k in (0, 1)]
                yield pa.RecordBatch.from_pydict({"doc_id": ids[i + of], "th": marks[i + of],
                                                  "start": (place - first[of]).astype(np.int32), "w1": w[0], "w2": w[1]})

    return rows.mapInArrow(cut, "doc_id long, th long, start int, w1 long, w2 long")


def covered(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, th, spans): the word spans [start, stop) of each document that its smaller documents hold too.

    ``docs`` has ``doc_id`` (no nulls), ``th`` and ``text``.
    """
    found = kit.materialize(runs(docs, window, gram), "substring-runs")
    live = kit.materialize(repeated(found), "substring-repeated")
    classes = kit.materialize(live.groupBy("g", "c", "n").agg(F.min("doc_id").alias("owner")), "substring-classes")
    several = kit.materialize(classes.groupBy("g").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1"), "substring-several")
    classes = kit.materialize(classes.join(several, "g", "left").select("g", "c", "n", "owner", F.col("classes").isNotNull().alias("several")),
                              "substring-owners")
    judged = kit.materialize(
        live.join(classes, ["g", "c", "n"]).where((F.col("doc_id") > F.col("owner")) | F.col("several"))
        .select("doc_id", "th", "start", "n", (F.col("doc_id") > F.col("owner")).alias("gone")), "substring-judged")
    gone = judged.where("gone").select("doc_id", "th", "start", (F.col("start") + F.col("n") + (window - 1)).alias("stop"))
    open_runs = (judged.where("not gone").groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "n")).alias("runs")))
    single = kit.materialize(_windows(docs.join(open_runs, ["doc_id", "th"]).select("doc_id", "th", "text", "runs"), window), "substring-windows")
    owners = kit.materialize(single.groupBy("w1", "w2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"))
                             .where("last > owner").drop("last"), "substring-window-owners")
    more = single.join(owners, ["w1", "w2"]).where("doc_id > owner").select("doc_id", "th", "start", (F.col("start") + window).alias("stop"))
    return gone.unionByName(more).groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def _strip(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words, removed words and the kept words joined by blanks."""
    for batch in parts:
        n_words, n_removed, texts = [], [], []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            words = (text or "").encode().split()
            if spans:
                edge = np.zeros(len(words) + 1, dtype=np.int32)
                np.add.at(edge, [s["start"] for s in spans], 1)
                np.add.at(edge, [s["stop"] for s in spans], -1)
                keep = np.cumsum(edge[:-1]) == 0
                kept = list(compress(words, keep.tolist()))
            else:
                kept = words
            n_words.append(len(words))
            n_removed.append(len(words) - len(kept))
            texts.append(b" ".join(kept).decode())
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_words": pa.array(n_words, pa.int64()),
                                          "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(texts, pa.string())})


def dedup(df: DataFrame, row: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) for every row of ``df``.

    Words are runs of anything but ``[\\x20\\x09-\\x0D]``. Null texts have no words; texts shorter than a window keep
    everything; repeats inside one document stay; rows with the same id never cut each other; a null id counts as
    larger than all others.
    """
    docs = df.select(F.coalesce(F.col(row).cast("long"), F.lit(_LAST)).alias("doc_id"), F.xxhash64(text).alias("th"),
                     F.col(text).cast("string").alias("text"))
    spans = covered(docs, window, gram)
    named = df.select(F.col(row).cast("long").alias("_id"), F.col(text).cast("string").alias("_text"),
                      F.coalesce(F.col(row).cast("long"), F.lit(_LAST)).alias("doc_id"), F.xxhash64(text).alias("th"))
    return (named.join(spans, ["doc_id", "th"], "left").select("_id", "_text", "spans")
            .mapInArrow(_strip, "doc_id long, n_words long, n_removed long, kept_text string"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup(kit.table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op3_substring_dedup": op3_substring_dedup}
ORACLES = {"op3_substring_dedup": r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) as g
        from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50)),
own as (select g, min(doc_id) as owner from win group by g),
gone as (select doc_id, list(distinct i + o) as cut from (select win.doc_id, win.i, unnest(range(0, 50)) as o
         from win join own using (g) where win.doc_id > own.owner) group by doc_id),
kept as (select d.doc_id, len(d.w) as n, coalesce(len(cut), 0) as m,
                list_filter(d.w, lambda x, i: cut is null or not list_contains(cut, i)) as k from d left join gone using (doc_id))
select doc_id, cast(n as bigint) as n_words, cast(m as bigint) as n_removed, sha256(array_to_string(k, ' ')) as kept_sha256 from kept
"""}
