"""Word and shingle hashes of Arrow text batches, computed on whole byte buffers with numpy.

Separators are ASCII, so UTF-8 bytes are classified one by one without decoding. A word's hash is a
polynomial over its bytes, a shingle's a polynomial over its words' hashes, both modulo 2**64 and mixed.
Buffers are worked through in sections, so memory is a small multiple of ``SECTION`` and of the word
count of the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SECTION = 1 << 18
U64 = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_SHINGLE_BASES = (0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def space_table() -> np.ndarray:
    """True for bytes of words split at ``[\\x20\\x09-\\x0D]``."""
    t = np.ones(256, dtype=bool)
    t[[0x20, 9, 10, 11, 12, 13]] = False
    return t


def alnum_table() -> np.ndarray:
    """True for bytes of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` in lower-cased text."""
    t = np.zeros(256, dtype=bool)
    t[0x30:0x3A] = t[0x61:0x7B] = t[0x80:] = True
    return t


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[0x41:0x5B] += 32
    return t


def mix(h: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values, in place."""
    h ^= h >> U64(30)
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse modulo 2**64 for i in 0..n-1 at least; grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(10, (n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.ones(1, dtype=U64)
            while len(p) < size:
                p = np.concatenate([p, p * U64(pow(b, len(p), 1 << 64))])
            out.append(p)
        have = _powers[base] = (out[0], out[1])
    return have


def batches(column: pa.Array | pa.ChunkedArray, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``limit`` bytes; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        i = j
    pa.default_memory_pool().release_unused()  # idle workers should not keep a batch's buffers


def slices(parts: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in runs of ``rows`` rows, so that work arrays stay small."""
    for batch in parts:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words and, for each text, the index of its first word (one entry more than texts)."""
    inside = table[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    first[heads] = inside[heads]
    last[tails] = inside[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets, side="left")


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Mixed 64-bit hash of each word; ``which`` picks one of two independent functions."""
    base = _BASES[which]
    out = np.empty(len(starts), dtype=U64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + SECTION, side="right")))
        hi = int(ends[j - 1])
        up, down = powers(base, hi - lo + 1)
        sums = np.zeros(hi - lo + 1, dtype=U64)
        np.cumsum((data[lo:hi].astype(U64) + U64(1)) * up[:hi - lo], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(U64)
        i = j
    return mix(out)


def shingle_hashes(words: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Mixed hash of every run of ``k`` words, for all starts in the whole buffer; length max(0, n-k+1)."""
    n = len(words)
    if n < k:
        return np.zeros(0, dtype=U64)
    base = _SHINGLE_BASES[which]
    up, down = powers(base, n + 1)
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum(words * up[:n], out=sums[1:])
    return mix((sums[k:] - sums[:n - k + 1]) * down[:n - k + 1])


def span_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Mixed hash of each word run ``[start, end)`` of varying length."""
    base = _SHINGLE_BASES[which]
    n = len(words)
    up, down = powers(base, n + 1)
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum(words * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All integers of the runs ``start .. start+length-1``, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    out = np.ones(total, dtype=np.int64)
    keep = lengths > 0
    s, m = starts[keep].astype(np.int64), lengths[keep].astype(np.int64)
    heads = np.concatenate([[0], np.cumsum(m)[:-1]])
    out[heads] = s
    out[heads[1:]] -= s[:-1] + m[:-1] - 1
    return np.cumsum(out)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
