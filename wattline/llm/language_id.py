"""Language ID by averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A text's subwords are its byte runs of 2 to 4 in lower case (A-Z). Each hashes to a row of an embedding table; the mean
of the rows goes through a linear layer and a softmax. Learning takes a bounded sample of labelled rows
(``PER_LANGUAGE`` of each language, texts up to ``FIT_BYTES``); a part of it is kept to fit the temperature of the
softmax and the score below which a prediction is rejected. Once trained, embedding and layer fold into one table,
which scores whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from wattline.llm import kit, textkit as tk

PER_LANGUAGE = 600
FIT_BYTES = 30_000
BUCKET_BITS = 15
DIMENSIONS = 12
SIZES = (2, 3, 4)
EPOCHS = 6
RATE = 0.5
SEED = 5_150
ACCEPT = 0.99
_MULTIPLIERS = (2654435761, 2246822519, 3266489917, 668265263)
_LOWER = tk.lower_table()


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages, temperature included
    bias: np.ndarray
    reject_below: float


def subwords(low: np.ndarray, size: int) -> np.ndarray:
    """Bucket of the byte run of ``size`` at each position; length max(0, n-size+1)."""
    n = len(low) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint16)
    h = np.full(n, 97 * size, dtype=np.uint32)
    for k in range(size):
        h ^= low[k:k + n]
        h *= np.uint32(_MULTIPLIERS[k])
        h ^= h >> np.uint32(13)
    return (h >> np.uint32(32 - BUCKET_BITS)).astype(np.uint16)


def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    low = _LOWER[np.frombuffer(text.encode(), dtype=np.uint8)]
    at, n = np.unique(np.concatenate([subwords(low, s) for s in SIZES]), return_counts=True)
    return at.astype(np.int64), (n / max(1, n.sum())).astype(np.float32)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, str]], seed: int = SEED) -> Model | None:
    """Train on (text, language) rows; every fifth one calibrates. No rows give no model."""
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    bags = [_bag(t) for t, _ in rows]
    y = np.array([languages.index(lang) for _, lang in rows])
    calibrate = np.arange(len(rows)) % 5 == 4
    emb = rng.normal(0, 0.5, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32)
    layer = np.zeros((DIMENSIONS, len(languages)), dtype=np.float32)
    bias = np.zeros(len(languages), dtype=np.float32)
    steps = np.flatnonzero(~calibrate)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(steps):
            at, w = bags[i]
            x = w @ emb[at]
            delta = _softmax(x @ layer + bias)
            delta[y[i]] -= 1
            back = layer @ delta
            layer -= rate * np.outer(x, delta)
            bias -= rate * 0.1 * delta
            emb[at] -= (rate * 50) * np.outer(w, back)
    logits = np.array([w @ emb[at] @ layer + bias for at, w in bags])
    held = np.flatnonzero(calibrate) if calibrate.any() else np.arange(len(rows))
    scales = np.geomspace(0.05, 20, 60)
    losses = [-np.log(np.maximum(1e-12, _softmax(logits[held] * s)[np.arange(len(held)), y[held]])).mean() for s in scales]
    scale = np.float32(scales[int(np.argmin(losses))])
    p = _softmax(logits[held] * scale)
    order = np.argsort(-p.max(axis=1))
    right = np.cumsum((p.argmax(axis=1) == y[held])[order]) / np.arange(1, len(held) + 1)
    good = np.flatnonzero(right >= ACCEPT)
    below = float(p.max(axis=1)[order[good[-1]]]) if len(good) else 1.0
    return Model(languages, (emb @ layer * scale).astype(np.float32), bias * scale, below)


def learn(df: DataFrame, row: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE,
          fit_bytes: int = FIT_BYTES, seed: int = SEED) -> Model | None:
    """A model from rows outside the held-out fifth; at most ``per_language`` rows of a language reach the driver."""
    known = df.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}") & ~kit.held_out(F.col(row))
                     & (F.octet_length(text) <= fit_bytes)).select(
        F.col(row).cast("string").alias("id"), F.col(lang).cast("string").alias("lang"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    ids = kit.bounded_sample(known.select("id", "lang", "th"), "lang", per_language, seed, ["id", "th"]).select("id", "lang", "th").distinct()
    rows = known.join(F.broadcast(ids), ["id", "lang", "th"]).dropDuplicates(["id", "lang", "th"]).toArrow().to_pylist()
    rows.sort(key=lambda r: (r["id"] or "", r["lang"], r["th"]))
    order = np.random.default_rng(seed).permutation(len(rows))
    return fit([(rows[i]["text"], rows[i]["lang"]) for i in order], seed)


def scorer(model: Model | None):
    """An Arrow function (id, text, has letters) -> (doc_id, lang_pred, score, rejected)."""
    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            letters = batch.column(2).to_numpy(zero_copy_only=False)
            names, scores = [], []
            for i, j, data, offsets in tk.batches(batch.column(1), 1 << 20):
                low = _LOWER[data]
                sums = np.zeros((j - i, len(model.languages) if model else 1))
                counts = np.zeros(j - i)
                for size in SIZES if model else ():
                    at = subwords(low, size)
                    first = np.minimum(offsets[:-1], len(at))
                    last = np.maximum(np.minimum(offsets[1:] - size + 1, len(at)), first)
                    counts += last - first
                    for k in range(sums.shape[1]):
                        total = np.concatenate([[0.0], np.cumsum(model.table[:, k][at], dtype=np.float64)])
                        sums[:, k] += total[last] - total[first]
                if model:
                    p = _softmax(sums / np.maximum(1, counts)[:, None] + model.bias)
                    best, top = p.argmax(axis=1), p.max(axis=1)
                for d in range(j - i):
                    known = model is not None and letters[i + d]
                    names.append(model.languages[best[d]] if known else "und")
                    scores.append(float(top[d]) if known else 0.0)
            below = model.reject_below if model else 1.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                                              pa.array([n == "und" or s < below for n, s in zip(names, scores)], pa.bool_())],
                                             names=["doc_id", "lang_pred", "score", "rejected"])

    return score


def identify(df: DataFrame, model: Model | None, row: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row, from the whole text alone.

    Null texts, texts without letters and all texts without a model are ``und`` with score 0. ``rejected`` marks ``und`` and
    scores too low for the calibrated precision ``ACCEPT``.
    """
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return df.select(F.col(row).cast("long").alias("doc_id"), F.col(text).cast("string"), letters).mapInArrow(
        scorer(model), "doc_id long, lang_pred string, score double, rejected boolean")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = kit.table(spark, sf_dir, "documents")
    return identify(docs, learn(docs)).select("doc_id", kit.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op9_language_id": op9_language_id}
ORACLES = {}
