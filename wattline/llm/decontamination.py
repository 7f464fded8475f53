"""Benchmark decontamination as a prefix-filtered set join of item windows with document passages.

An item window (``window`` consecutive words, or a whole shorter item) is a set of word shingles that a passage must
hold completely, so the prefix filter needs one token: the window's rarest shingle. Counts of the items' shingles
over all documents give the order; a window whose rarest shingle never occurs is dropped. Documents emit the
positions of prefix shingles with the words around them. The join on the shingle applies the positional bound
(the window must start in the text) and the length bound (it must end there), then compares the words.

What tasks get up front is a bit filter of fixed size; a fuller filter lets more candidates through to the join and
changes no result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from wattline.llm import bitset, kit, textkit as tk

WINDOW = 13
SHINGLE = 3
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = {c: c + 32 for c in range(0x41, 0x5B)}
_ALNUM, _LOWER = tk.alnum_table(), tk.lower_table()


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_UPPER))


def item_windows(bench: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(item, win, n, k, at, shingle): each window's words, their number and its shingles of ``k`` words."""
    schema = pa.schema([("item", pa.string()), ("win", pa.string()), ("n", pa.int32()), ("k", pa.int32()),
                        ("at", pa.int32()), ("shingle", pa.int64())])

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            out: dict[str, list] = {c: [] for c in schema.names}
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(raw)
                if not words:
                    continue
                n = min(window, len(words))
                k = min(shingle, n)
                data = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
                s, e, _ = tk.word_spans(data, np.array([0, len(data)]), _ALNUM)
                hashes = tk.signed(tk.shingle_hashes(tk.word_hashes(data, s, e), k)).tolist()
                for i in range(len(words) - n + 1):
                    win = " ".join(words[i:i + n])
                    for at in range(n - k + 1):
                        for c, v in zip(schema.names, (name or "", win, n, k, at, hashes[i + at])):
                            out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return bench.select(F.col(item).cast("string"), F.col(text).cast("string")).mapInArrow(
        cut, "item string, win string, n int, k int, at int, shingle long")


def _hits(low: np.ndarray, offsets: np.ndarray, lengths: list[int], flags: np.ndarray):
    """Word spans, first words of texts, and for each shingle length the positions and hashes that pass the filter."""
    starts, ends, first = tk.word_spans(low, offsets, _ALNUM)
    words = tk.word_hashes(low, starts, ends)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    found = []
    for k in lengths:
        h = tk.shingle_hashes(words, k)
        pos = np.flatnonzero(bitset.test(flags, h))
        pos = pos[owner[pos] == owner[pos + k - 1]]
        found.append((k, pos, h[pos]))
    return starts, ends, first, owner, found


def shingle_counts(docs: DataFrame, text: str, lengths: list[int], flags) -> DataFrame:
    """(shingle, n): occurrences over all documents of shingles that pass the filter, summed in each task first."""
    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in parts:
            for _, _, data, offsets in tk.batches(batch.column(0)):
                found = _hits(_LOWER[data], offsets, lengths, flags.value)[-1]
                new, n = np.unique(np.concatenate([h for _, _, h in found]), return_counts=True)
                keys, where = np.unique(np.concatenate([keys, new]), return_inverse=True)
                sums = np.bincount(where, weights=np.concatenate([sums, n]), minlength=len(keys)).astype(np.int64)
            if len(keys) > 1 << 20:
                yield pa.RecordBatch.from_pydict({"shingle": tk.signed(keys), "n": sums})
                keys, sums = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        yield pa.RecordBatch.from_pydict({"shingle": tk.signed(keys), "n": sums})

    return docs.select(F.col(text).cast("string")).mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def passages(docs: DataFrame, row: str, text: str, lengths: list[int], flags, window: int, shingle: int) -> DataFrame:
    """A row for each document: its id, number of words, and the prefix shingles in it with the words around them."""
    hit = pa.struct([("shingle", pa.int64()), ("pos", pa.int32()), ("lead", pa.int32()), ("around", pa.string())])
    schema = pa.schema([("uid", pa.string()), ("doc_id", pa.int64()), ("th", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(hit))])

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import secrets

        task, made = secrets.token_hex(8), 0
        for batch in parts:
            ids = batch.column(0)
            for i, j, data, offsets in tk.batches(batch.column(1)):
                low = _LOWER[data]
                starts, ends, first, owner, found = _hits(low, offsets, lengths, flags.value)
                hits: list[list] = [[] for _ in range(j - i)]
                raw = low.tobytes()
                for k, pos, h in found:
                    reach = window if k == shingle else k  # shorter shingles are whole items
                    for p, d, v in zip(pos.tolist(), owner[pos].tolist(), tk.signed(h).tolist()):
                        a, b = max(first[d], p - reach + k), min(first[d + 1], p + reach)
                        around = b" ".join([raw[x:y] for x, y in zip(starts[a:b], ends[a:b])]).decode()
                        hits[d].append({"shingle": v, "pos": p - int(first[d]), "lead": p - int(a), "around": around})
                yield pa.RecordBatch.from_arrays([
                    pa.array([f"{task}-{made + x}" for x in range(j - i)]), ids.slice(i, j - i),
                    batch.column(2).slice(i, j - i), pa.array(np.diff(first)), pa.array(hits, pa.list_(hit))], schema=schema)
                made += j - i

    return docs.select(F.col(row).cast("long"), F.col(text).cast("string"), F.xxhash64(text)).mapInArrow(
        search, "uid string, doc_id long, th long, n_words long, hits array<struct<shingle:long,pos:int,lead:int,around:string>>")


def contamination(docs: DataFrame, bench: DataFrame, row: str = "doc_id", text: str = "text", item: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """Documents (``uid``, ``doc_id``, ``th`` (xxhash64 of the text), ``n_words``) and matches (``uid``, ``start``, ``n``, ``item``), one row for each
    occurrence of an item's window in a document; ``start`` counts words from 0.

    Null and empty texts have no words and no matches; items without words have no windows; a null item id reads
    as the empty string; repeated items and documents match each on their own (``uid`` tells rows apart).
    """
    spark = docs.sparkSession
    cut = kit.materialize(item_windows(bench, item, item_text, window, shingle), "decontaminate-windows")
    lengths = sorted(r[0] for r in cut.select("k").distinct().collect())
    share = spark.sparkContext.broadcast
    counts = shingle_counts(docs, text, lengths or [shingle], share(bitset.build(cut, "shingle")))
    rarest = F.min_by(F.struct("at", "shingle", "count"), F.struct("count", "shingle", "at")).alias("_p")
    prefix = kit.materialize(
        cut.select("win", "n", "at", "shingle").distinct()
        .join(counts.withColumnRenamed("n", "count"), "shingle", "left").withColumn("count", F.coalesce("count", F.lit(0)))
        .groupBy("win", "n").agg(rarest).where(F.col("_p.count") > 0)
        .select("win", "n", F.col("_p.at").alias("at"), F.col("_p.shingle").alias("shingle")), "decontaminate-prefix")
    found = kit.materialize(passages(docs, row, text, lengths or [shingle], share(bitset.build(prefix, "shingle")), window, shingle), "decontaminate-hits")
    near = found.select("uid", "n_words", F.explode("hits").alias("h")).select("uid", "n_words", "h.*").join(prefix, "shingle")
    start = F.col("pos") - F.col("at")
    same = F.expr("concat_ws(' ', slice(split(around, ' '), lead - at + 1, n)) = win")
    exact = near.where((start >= 0) & (start + F.col("n") <= F.col("n_words")) & (F.col("lead") >= F.col("at"))).where(same)
    spans = exact.select("uid", start.alias("start"), "n", "win")
    return found.select("uid", "doc_id", "th", "n_words"), spans.join(cut.select("win", "item").distinct(), "win").select("uid", "start", "n", "item")


def report(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """Per document: words, words hit by any window, items found, whether a twentieth or more of it is hit, and its text's hash."""
    rows, matches = contamination(docs, bench, **options)
    matches = kit.materialize(matches, "decontaminate-matches")
    cover = F.expr("aggregate(array_sort(spans), named_struct('n', 0L, 'end', 0), (a, x) -> named_struct("
                   "'n', a.n + greatest(0, x.stop - greatest(x.start, a.end)), 'end', greatest(a.end, x.stop)), a -> a.n)")
    hit = (matches.groupBy("uid").agg(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("stop"))).alias("spans"),
                                      F.array_sort(F.collect_set("item")).alias("items"))
           .select("uid", cover.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.join(hit, "uid", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.concat_ws(",", F.coalesce("items", F.array().cast("array<string>"))).cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), F.col("th").alias("text_hash"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(kit.table(spark, sf_dir, "documents"), kit.table(spark, sf_dir, "benchmark")).drop("text_hash")


QUERIES = {"op1_decontamination": op1_decontamination}
ORACLES = {"op1_decontamination": r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (
  select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
cut as (select item, w, least(13, len(w)) as n from b where len(w) > 0),
win as (select distinct item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') as g
        from (select item, w, n, unnest(range(1, len(w) - n + 2)) as i from cut)),
grams as (select doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') as g
          from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from win))),
occ as (select grams.doc_id, grams.i, grams.n, win.item from grams join win on grams.n = win.n and grams.g = win.g),
hit as (select doc_id, count(distinct i + o) as n_hit from (select doc_id, i, unnest(range(0, n)) as o from occ) group by doc_id),
items as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as ids from occ group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) as contaminated
from d left join hit using (doc_id) left join items using (doc_id)
"""}
