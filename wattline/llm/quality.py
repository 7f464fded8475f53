"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words; only the document has a label. Each passage is encoded from its
shape (bigrams of byte classes, word lengths, repetition), a gated attention layer weighs the passages, and the
weighted mean of their codes is scored. Fitted in numpy with Adam on a bounded sample (``PER_LABEL`` rows of each
label, texts up to ``FIT_BYTES``); labels count by their true frequency. Scoring reads whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from wattline.llm import kit, textkit as tk

PASSAGE = 64
PER_LABEL = 1200
FIT_BYTES = 30_000
HIDDEN, ATTENTION = 32, 16
EPOCHS, BATCH, RATE = 30, 32, 0.005
SEED = 4_242
THRESHOLD = 0.3
_WORDS, _LOWER = tk.space_table(), tk.lower_table()
_MARKS = (b"!", b".,;:", b"#$%&*", b"|", b"<>{}[]/\\=")


def _classes() -> np.ndarray:
    """Byte classes: lower case, upper case, digit, blank, line break, the groups of marks, other ASCII, non-ASCII."""
    t = np.full(256, 10, dtype=np.int64)
    t[0x61:0x7B], t[0x41:0x5B], t[0x30:0x3A], t[0x20], t[0x80:] = 0, 1, 2, 3, 11
    t[[9, 10, 11, 12, 13]] = 4
    for i, group in enumerate(_MARKS):
        t[list(group)] = 5 + i
    return t


_CLASS = _classes()
_N = 12
FEATURES = _N * _N + 7


def _first_seen(keys: np.ndarray) -> np.ndarray:
    """1 where a value occurs for the first time."""
    out = np.zeros(len(keys))
    out[np.unique(keys, return_index=True)[1]] = 1
    return out


def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Passage features and, for each text, the index of its first passage. A text without words is one passage of zeros."""
    starts, ends, first = tk.word_spans(data, offsets, _WORDS)
    n_words = np.diff(first)
    per_doc = np.maximum(1, -(-n_words // PASSAGE))
    heads = np.concatenate([[0], np.cumsum(per_doc)])
    total = int(heads[-1])
    out = np.zeros((total, FEATURES), dtype=np.float32)
    if not len(starts):
        return out, heads
    doc = np.repeat(np.arange(len(n_words)), n_words)
    passage = heads[doc] + (np.arange(len(starts)) - first[doc]) // PASSAGE
    lead = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    ids = passage[lead]
    begin = starts[lead]
    stop = ends[np.concatenate([lead[1:], [len(starts)]]) - 1]
    codes = _CLASS[data]
    pair = codes[:-1] * _N + codes[1:]
    place = tk.ranges(begin, np.maximum(0, stop - begin - 1))
    owner = np.repeat(np.arange(len(ids)), np.maximum(0, stop - begin - 1))
    grid = np.bincount(owner * (_N * _N) + pair[place], minlength=len(ids) * _N * _N).reshape(len(ids), -1)
    count = np.diff(np.concatenate([lead, [len(starts)]])).astype(np.float64)
    words = tk.word_hashes(_LOWER[data], starts, ends)
    same = np.concatenate([[0.0], (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])])
    salt = tk.mix(passage.astype(np.uint64))
    lengths = (ends - starts).astype(np.float64)
    sums = lambda x: np.add.reduceat(x, lead)
    mean = sums(lengths) / count
    rows = np.column_stack([
        grid / np.maximum(1, grid.sum(axis=1, keepdims=True)), np.log1p(count) / np.log1p(PASSAGE), mean / 10,
        np.sqrt(np.maximum(0, sums(lengths ** 2) / count - mean ** 2)) / 10, sums(same) / count,
        sums(_first_seen(words ^ salt)) / count, sums(_first_seen(words ^ tk.mix(doc.astype(np.uint64) + np.uint64(1 << 40)))) / count,
        np.log1p(n_words[doc[lead]]) / 10])
    out[ids] = rows
    return out, heads


@dataclass
class Model:
    shift: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]


def _segment(x: np.ndarray, heads: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, heads[:-1], axis=0)


def forward(model: Model, x: np.ndarray, heads: np.ndarray) -> dict[str, np.ndarray]:
    """All layers for bags of passages; ``p`` is the probability of label 1 of each bag."""
    w = model.weights
    x = (x - model.shift) * model.scale
    h = np.tanh(x @ w["enc"] + w["enc_b"])
    t, s = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
    g = (t * s) @ w["att"]
    bag = np.repeat(np.arange(len(heads) - 1), np.diff(heads))
    e = np.exp(g - np.maximum.reduceat(g, heads[:-1])[bag])
    a = e / _segment(e, heads)[bag]
    z = _segment(a[:, None] * h, heads)
    p = 1 / (1 + np.exp(-(z @ w["out"] + w["out_b"][0])))
    return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "p": p, "bag": bag}


def _gradients(model: Model, f: dict[str, np.ndarray], heads: np.ndarray, y: np.ndarray, cost: np.ndarray) -> dict[str, np.ndarray]:
    w, bag = model.weights, f["bag"]
    d = (f["p"] - y) * cost / cost.sum()
    dz = d[:, None] * w["out"]
    da = (f["h"] * dz[bag]).sum(axis=1)
    dg = f["a"] * (da - _segment(f["a"] * da, heads)[bag])
    dts = dg[:, None] * w["att"]
    dt, ds = dts * f["s"] * (1 - f["t"] ** 2), dts * f["t"] * f["s"] * (1 - f["s"])
    dh = (f["a"][:, None] * dz[bag] + dt @ w["v"].T + ds @ w["u"].T) * (1 - f["h"] ** 2)
    return {"out": f["z"].T @ d, "out_b": np.array([d.sum()]), "att": (f["t"] * f["s"]).T @ dg, "v": f["h"].T @ dt, "u": f["h"].T @ ds,
            "enc": f["x"].T @ dh, "enc_b": dh.sum(axis=0)}


def fit(bags: list[np.ndarray], labels: np.ndarray, cost: np.ndarray, seed: int = SEED) -> Model:
    """Adam over mini-batches of bags; ``cost`` weighs each bag."""
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    shift = every.mean(axis=0)
    scale = 1 / np.maximum(every.std(axis=0), 0.02)
    shape = {"enc": (FEATURES, HIDDEN), "enc_b": (HIDDEN,), "v": (HIDDEN, ATTENTION), "u": (HIDDEN, ATTENTION), "att": (ATTENTION,),
             "out": (HIDDEN,), "out_b": (1,)}
    model = Model(shift, scale, {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) > 1 or k in ("att", "out") else np.zeros(s) for k, s in shape.items()})
    m1, m2 = ({k: np.zeros(s) for k, s in shape.items()} for _ in range(2))
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            pick = order[at:at + BATCH]
            heads = np.concatenate([[0], np.cumsum([len(bags[i]) for i in pick])])
            f = forward(model, np.concatenate([bags[i] for i in pick]), heads)
            step += 1
            for k, g in _gradients(model, f, heads, labels[pick], cost[pick]).items():
                g = g + 1e-4 * model.weights[k]
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                model.weights[k] = model.weights[k] - RATE * (1 - epoch / EPOCHS) * (m1[k] / (1 - 0.9 ** step)) / (
                    np.sqrt(m2[k] / (1 - 0.999 ** step)) + 1e-8)
    return model


def learn(df: DataFrame, labels: DataFrame, row: str = "doc_id", text: str = "text", label: str = "quality",
          per_label: int = PER_LABEL, fit_bytes: int = FIT_BYTES, seed: int = SEED) -> Model | None:
    """A model from labelled rows outside the held-out fifth; at most ``per_label`` rows of a label reach the driver.

    A document labelled more than once counts with its least label. No usable label gives no model.
    """
    marked = (labels.where(F.col(label).isNotNull() & F.col(row).isNotNull() & ~kit.held_out(F.col(row)))
              .groupBy(F.col(row).cast("long").alias("id")).agg((F.min(label) > 0).cast("int").alias("label")))
    sample = kit.bounded_sample(marked, "label", per_label, seed, ["id"]).select("id", "label", "_count")
    rows = (df.select(F.col(row).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
            .where(F.octet_length("text") <= fit_bytes).join(F.broadcast(sample), "id").withColumn("th", F.xxhash64("text")))
    # of rows that share an id the text with the least hash counts, whatever their order
    rows = rows.groupBy("id").agg(F.min_by(F.struct("text", "label", "_count"), F.struct("th", "text")).alias("r")).select("id", "r.*")
    found = rows.limit(2 * per_label).toArrow().to_pylist()
    if not found:
        return None
    found.sort(key=lambda r: r["id"])
    bags = [encode(np.frombuffer(r["text"].encode(), dtype=np.uint8), np.array([0, len(r["text"].encode())]))[0] for r in found]
    y = np.array([r["label"] for r in found], dtype=float)
    sampled = {v: max(1, (y == v).sum()) for v in (0, 1)}
    cost = np.array([r["_count"] / sampled[r["label"]] for r in found], dtype=float)
    return fit(bags, y, cost / cost.mean(), seed)


def scorer(model: Model | None):
    """An Arrow function (id, text) -> (doc_id, score); without a model every score is 1."""
    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            out = [np.zeros(0)]
            for i, j, data, offsets in tk.batches(batch.column(1), 1 << 20):
                out.append(forward(model, *encode(data, offsets))["p"] if model else np.ones(j - i))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out), pa.float64())], names=["doc_id", "score"])

    return score


def scores(df: DataFrame, model: Model | None, row: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) for every row, from the whole text alone; null and empty texts get a score too."""
    return (df.select(F.col(row).cast("long").alias("doc_id"), F.col(text).cast("string")).mapInArrow(scorer(model), "doc_id long, score double")
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def keep_good(df: DataFrame, model: Model | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` that are not rejected, with its columns."""
    def keep(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            ok = [np.zeros(0, dtype=bool)]
            for i, j, data, offsets in tk.batches(batch.column(batch.schema.names.index(text)), 1 << 20):
                ok.append(forward(model, *encode(data, offsets))["p"] >= threshold if model else np.ones(j - i, dtype=bool))
            yield batch.filter(pa.array(np.concatenate(ok)))

    return df.mapInArrow(keep, df.schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = kit.table(spark, sf_dir, "documents")
    model = learn(docs, kit.table(spark, sf_dir, "labels"))
    return scores(docs, model).withColumn("held_out", kit.held_out(F.col("doc_id"))).select("doc_id", "held_out", "score", "predicted")


QUERIES = {"op10_quality": op10_quality}
ORACLES = {}
