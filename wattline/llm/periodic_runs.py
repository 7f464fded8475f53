"""Periodic runs of words by multi-scale minimizers.

A run is a longest stretch with smallest period ``q`` that holds at least four periods and six words. It is found by

* a direct scan of the lag ``q`` for periods up to ``SHORT``;
* minimizers for longer ones. At a scale ``K`` the least hash among ``K`` consecutive grams of ``K`` words is marked.
  Inside a run with ``q <= K <= (3q + 1) / 2`` a gram is longer than the period, so equal grams stand ``q`` apart exactly,
  and four periods leave room for two windows whose least grams are neighbours: two equal marks at distance ``q``. Each
  chain of such pairs seeds one extension to both sides, word by word. Scales grow by half, so they cover every period.

Words are compared by identity (a dictionary of the batch), grams by 64-bit hashes. Every run reported is verified; a run
is missed only if two different grams of one stretch agree in all bits kept for the minimum, 37 or more.
Texts go through tasks one batch after another; nothing is shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from wattline.llm import kit, textkit as tk

SHORT = 8
PERIODS = 4
LEAST = 6
_RUNS = "array<struct<start: long, length: long, period: long>>"
_RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def scales(longest: int) -> Iterator[tuple[int, int]]:
    """(gram and window size, least period) of each scale that texts of ``longest`` words need."""
    q = SHORT + 1
    while PERIODS * q <= longest:
        size = (3 * q + 1) // 2
        yield size, q
        q = size + 1


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    span, out = 1, values
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def seeds(values: np.ndarray, first: np.ndarray, size: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, distance) of the heads of chains of equal neighbouring minimizers; ``first`` bounds the texts."""
    grams = tk.shingle_hashes(values, size)
    bits = np.uint64(max(1, int(len(grams)).bit_length()))
    packed = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    minima = window_minima(packed, size)
    starts = tk.ranges(first[:-1], np.maximum(0, np.diff(first) - 2 * size + 2))
    marks = (minima[starts] & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    marks = marks[np.concatenate([[True], marks[1:] != marks[:-1]])]
    gap = np.diff(marks)
    text = np.searchsorted(first, marks, side="right")
    ok = (gap >= least) & (gap <= size) & (grams[marks[1:]] == grams[marks[:-1]]) & (text[1:] == text[:-1])
    at, gap = marks[:-1][ok], gap[ok]
    head = np.ones(len(at), dtype=bool)
    head[1:] = (gap[1:] != gap[:-1]) | (at[:-1] + gap[:-1] != at[1:])
    return at[head], gap[head]


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading entries of two equally long arrays are the same."""
    at, step = 0, 64
    while at < len(a):
        same = a[at:at + step] == b[at:at + step]
        if not same.all():
            return at + int(np.argmin(same))
        at, step = at + step, step * 2
    return len(a)


def _smallest(words: np.ndarray, start: int, q: int) -> bool:
    """No proper divisor of ``q`` is a period of the stretch with period ``q`` (of two periods at least) at ``start``."""
    return not any(q % d == 0 and np.array_equal(words[start:start + q], words[start + d:start + d + q]) for d in _divisors(q))


def _divisors(q: int) -> set[int]:
    """``q`` divided by each of its prime factors."""
    out, rest, p = set(), q, 2
    while rest > 1:
        if p * p > rest:
            p = rest
        if rest % p == 0:
            out.add(q // p)
            rest //= p
        else:
            p += 1
    return out


def find(words: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text, start, length, period) of all runs of texts laid end to end, the longest text first.

    ``words`` are numbers that are equal for equal words; ``lengths`` must not increase.
    """
    first = np.concatenate([[0], np.cumsum(lengths)])
    found: set[tuple[int, int, int]] = set()
    for q in range(1, SHORT + 1):
        same = words[:-q] == words[q:]
        inner = np.minimum(q, lengths)
        cut = tk.ranges(first[1:] - inner, inner)
        same[cut[cut < len(same)]] = False
        hits = np.flatnonzero(same)
        if len(hits) == 0:
            continue
        breaks = np.flatnonzero(np.diff(hits) > 1)
        begin, end = hits[np.concatenate([[0], breaks + 1])], hits[np.concatenate([breaks, [len(hits) - 1]])] + 1
        long = end - begin + q >= max(LEAST, PERIODS * q)
        found.update((s, e - s + q, q) for s, e in zip(begin[long].tolist(), end[long].tolist()) if _smallest(words, s, q))
    values = tk.mix(words.astype(np.uint64) + np.uint64(1))
    for size, least in scales(int(lengths[0]) if len(lengths) else 0):
        texts = int(np.searchsorted(-lengths, -PERIODS * least, side="right"))
        part = first[:texts + 1]
        done: dict[int, int] = {}
        for p, q in zip(*(x.tolist() for x in seeds(values[:part[-1]], part, size, least))):
            if p < done.get(q, 0):
                continue
            t = int(np.searchsorted(part, p, side="right")) - 1
            lo, hi = int(part[t]), int(part[t + 1])
            back = _agree(words[lo:p][::-1], words[lo + q:p + q][::-1])
            start, end = p - back, p + q + _agree(words[p:hi - q], words[p + q:hi])
            done[q] = end - q
            if end - start >= PERIODS * q and _smallest(words, start, q):
                found.add((start, end - start, q))
    out = []
    for s, n, q in found:
        t = int(np.searchsorted(first, s, side="right")) - 1
        out.append((t, s - int(first[t]), n, q))
    return sorted(out, key=lambda r: (r[0], r[1], r[3]))


def _collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words outside the repeated parts of all runs, joined by one space."""
    if not runs:
        return b" ".join(words)
    step = np.zeros(len(words) + 1, dtype=np.int64)
    for s, n, q in runs:
        step[s + q] += 1
        step[s + n] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0)])


def _scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts:
        for i, j, data, offsets in tk.batches(batch.column(1)):
            split = [data[offsets[d]:offsets[d + 1]].tobytes().split() for d in range(j - i)]  # at [\x20\x09-\x0D]
            sizes = np.array([len(w) for w in split], dtype=np.int64)
            order = np.argsort(-sizes, kind="stable")
            number: dict[bytes, int] = defaultdict(count().__next__)
            words = np.fromiter((number[w] for d in order for w in split[d]), np.int64, int(sizes.sum()))
            runs: list[list[tuple[int, int, int]]] = [[] for _ in split]
            for t, *run in find(words, sizes[order]):
                runs[order[t]].append(tuple(run))
            named = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(i, j - i), pa.array(sizes), pa.array(named, _RUN_TYPE),
                pa.array([_collapse(w, r) for w, r in zip(split, runs)], pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(df: DataFrame, row: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row: its runs by start, then period, and its text without repeats.

    Words are runs of anything but ``[\\x20\\x09-\\x0D]``. ``collapsed`` keeps the first period of each run and joins the words
    by one space. Null and empty texts have no words, no runs and an empty ``collapsed``; rows that share an id or have
    none are treated one by one; other columns are left out; an empty table gives no rows.
    """
    return df.select(F.col(row).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        _scan, f"doc_id long, n_words long, runs {_RUNS}, collapsed string")


def with_planted(df: DataFrame, row: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text): every tenth text, by the CRC-32 of its id, repeats a stretch of its words up to its end.

    Texts without words and rows without an id stay as they are.
    """
    h = F.crc32(F.col(row).cast("string").cast("binary")).cast("long")
    hit = F.coalesce(h % 10 == 0, F.lit(False))
    words = F.when(hit, F.regexp_extract_all(F.col(text), F.lit(f"({kit.SPACE_CLASS})"), F.lit(1)))
    base = df.select(F.col(row).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
                     F.floor(h / 10).cast("long").alias("g"), words.alias("words"))
    sized = base.withColumn("n", F.size("words").cast("long"))
    placed = sized.withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    placed = placed.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    part = F.expr("array_repeat(slice(words, a + 1, p), cast(4 + g % 8 as int))")
    repeated = F.expr("slice(words, 1, a)"), F.flatten(part)
    changed = F.array_join(F.slice(F.concat(*repeated), F.lit(1), F.col("n").cast("int")), " ")
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted(kit.table(spark, sf_dir, "documents").select("doc_id", "text")))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    best = F.aggregate("runs", F.lit(None).cast("struct<start: long, length: long, period: long>"), lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words")


QUERIES = {"op11_periodic_runs": op11_periodic_runs}
ORACLES = {}
