"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Sources, in code point order with null last, get the given weights in turn. Their shares of all words are
   their targets; a target stops at ``REPEATS`` times the source's words and the excess goes to the others by weight.
2. Rows of a source fall into blocks by a seeded draw. A target of ``e`` whole passes and a rest takes every block
   ``e`` times and, for the rest, blocks in permuted order that still fit. The number of blocks drawn is the
   source's exact quota.
3. The quotas of all sources are split among the output shards by a binary tree: at each node the left half's share
   is a multivariate hypergeometric draw, so shards are random samples of the mixture and quotas stay exact.
4. Each source's sequence of drawn blocks (pass by pass, permuted) is cut by the quotas of the shards in turn, so
   draws are disjoint; rows get a seeded order inside their shard.

The driver sees one row per source only; blocks, draws and rows stay in Spark.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wattline.llm import kit

WEIGHTS = (1, 2, 3)
REPEATS = 3
SHARDS = 64
SEED = 77_001
LEAST_BLOCKS = 4096
BLOCK_WORDS = 4_000_000


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> list[float]:
    """Words to take from each source: weighted shares of all words, none above ``repeats`` times its source."""
    w = np.array([weights[i % len(weights)] for i in range(len(sizes))], dtype=float)
    caps = repeats * np.array(sizes, dtype=float)
    total, out = float(sum(sizes)), np.zeros(len(sizes))
    free = np.ones(len(sizes), dtype=bool)
    while free.any():
        out[free] = (total - caps[~free].sum()) * w[free] / w[free].sum()
        over = free & (out > caps)
        if not over.any():
            break
        out[over] = caps[over]
        free &= ~over
    return out.tolist()


def split(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Quotas of each shard (shards x sources): column sums are ``quotas``, row sums differ by little."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    stack = [(0, shards, np.asarray(quotas, dtype=np.int64))]
    while stack:
        lo, hi, q = stack.pop()
        if hi - lo == 1:
            out[lo] = q
            continue
        mid = (lo + hi) // 2
        n = int(q.sum())
        take = (n * (mid - lo) + (hi - lo) // 2) // (hi - lo)
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(q, take, method="marginals")
        stack += [(lo, mid, left), (mid, hi, q - left)]
    return out


def _chosen(words: np.ndarray, rest: float) -> np.ndarray:
    """Blocks, in their given order, that fit into ``rest`` words, and a last one if that comes nearer."""
    take, have = np.zeros(len(words), dtype=bool), 0.0
    for i, w in enumerate(words.tolist()):
        if have + w <= rest:
            take[i], have = True, have + w
    left = np.flatnonzero(~take)
    if len(left):
        i = left[np.argmin(words[left])]
        if words[i] - (rest - have) < rest - have:
            take[i] = True
    return take


def _draw_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """Draw positions of one source's blocks; at most as many rows as there are blocks."""
    pdf = pdf.sort_values(["_order", "_block"], ignore_index=True)
    passes, rest = int(pdf["_passes"][0]), float(pdf["_rest"][0])
    n = len(pdf)
    places = np.arange(n)[:, None] + n * np.arange(passes)[None, :]
    extra = _chosen(pdf["_words"].to_numpy(dtype=float), rest) if rest > 0 else np.zeros(n, dtype=bool)
    last = passes * n + np.cumsum(extra) - 1
    places = [[*row, last[i]] if extra[i] else list(row) for i, row in enumerate(places.tolist())]
    return pd.DataFrame({"_stratum": pdf["_stratum"], "_block": pdf["_block"], "_places": places})


def _placed(df: DataFrame, size: str | Column, source: str, key: tuple[str, ...], shards: int, seed: int, weights: tuple[int, ...],
            repeats: int, block_words: int) -> DataFrame:
    """(_row, _key0 .., _source_size, _target, _shards): the caller's columns in one, so their names meet none of those here."""
    spark = df.sparkSession
    size = F.col(size) if isinstance(size, str) else size
    rows = df.select(F.struct(*df.columns).alias("_row"), *[F.col(k).alias(f"_key{i}") for i, k in enumerate(key)],
                     F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")).alias("_stratum"),
                     F.coalesce(size, F.lit(0)).alias("_size"), kit.seeded(seed, F.col(source), *[F.col(k) for k in key]).alias("_draw"))
    slim = rows.select("_stratum", "_size", "_draw")
    found = [(r[0], int(r[1])) for r in slim.groupBy("_stratum").agg(F.sum("_size")).collect()]
    found.sort(key=lambda r: (r[0] == "", r[0]))
    wanted = targets([s for _, s in found], weights, repeats)
    blocks = max(LEAST_BLOCKS, -(-sum(s for _, s in found) // block_words))
    passes = [min(repeats, int(t // s)) if s else 0 for (_, s), t in zip(found, wanted)]
    plan = spark.createDataFrame(
        [(name, s, float(t), p, max(0.0, float(t - p * s))) for (name, s), t, p in zip(found, wanted, passes)],
        "_stratum string, _source_size long, _target double, _passes int, _rest double")
    block = F.floor((F.col("_draw") / 2.0 ** 64 + 0.5) * blocks).cast("long").alias("_block")
    table = (slim.groupBy("_stratum", block).agg(F.sum("_size").alias("_words"))
             .join(plan, "_stratum").withColumn("_order", kit.seeded(seed + 1, F.col("_stratum"), F.col("_block"))))
    drawn = kit.materialize(
        table.groupBy("_stratum").applyInPandas(_draw_blocks, "_stratum string, _block long, _places array<long>"), "mix-draws")
    counts = dict(drawn.groupBy("_stratum").agg(F.sum(F.size("_places"))).collect())
    names = [name for name, _ in found]
    quotas = split(np.array([counts.get(n, 0) for n in names], dtype=np.int64), shards, seed) if names else None
    ends = spark.createDataFrame([(n, np.cumsum(quotas[:, i]).tolist(), *r) for i, (n, r) in enumerate(
        zip(names, [(s, float(t)) for (_, s), t in zip(found, wanted)]))],
        "_stratum string, _ends array<long>, _source_size long, _target double")
    where = F.expr("transform(_places, p -> size(filter(_ends, e -> e <= p)))").alias("_shards")
    lots = drawn.join(ends, "_stratum").select("_stratum", "_block", where, "_source_size", "_target")
    return rows.withColumn("_block", block).join(lots, ["_stratum", "_block"]).drop("_stratum", "_block", "_size", "_draw")


def assign(df: DataFrame, size: str | Column, source: str = "source", key: tuple[str, ...] = ("doc_id",), shards: int = SHARDS,
           seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS,
           block_words: int = BLOCK_WORDS) -> DataFrame:
    """``df`` with ``_source_size``, ``_target`` and ``_shards``, the shards that get a copy of the row.

    A row in no shard has an empty list; a shard may be listed more than once. Null sources form one source,
    which sorts last; null sizes count as 0; sources without words have target 0; an empty table stays empty.
    Rows alike in ``key`` and source share their block and so their fate. Columns of ``df`` named like the three new ones
    are replaced; all others are kept.
    """
    new = ["_source_size", "_target", "_shards"]
    kept = [F.col("_row")[c].alias(c) for c in df.columns if c not in new]
    return _placed(df, size, source, key, shards, seed, weights, repeats, block_words).select(*kept, *new)


def mix(df: DataFrame, size: str | Column, source: str = "source", key: tuple[str, ...] = ("doc_id",), shards: int = SHARDS,
        seed: int = SEED, ordered: bool = True, shard_col: str | None = "_shard", weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS,
        block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mixture: a row of ``df`` as often as it was drawn, with ``shard_col``, in a seeded order inside its shard.

    A shard may span several partitions, one after the other. ``ordered=False`` leaves the rows where they are. A column
    of ``df`` named like ``shard_col`` is replaced, all others are kept; None adds no column.
    """
    placed = _placed(df, size, source, key, shards, seed, weights, repeats, block_words)
    keys = [f"_key{i}" for i in range(len(key))]
    copies = placed.select("_row", *keys, F.posexplode("_shards").alias("_copy", "_shard"))
    out = [F.col("_row")[c].alias(c) for c in df.columns if c != shard_col]
    if shard_col:
        out.append(F.col("_shard").alias(shard_col))
    if not ordered:
        return copies.select(*out)
    order = kit.seeded(seed + 2, F.col("_shard"), F.col("_copy"), *[F.col(k) for k in keys])
    return copies.withColumn("_order", order).repartitionByRange("_shard", "_order").sortWithinPartitions("_shard", "_order").select(*out)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mixture takes of every document."""
    docs = kit.table(spark, sf_dir, "documents").select("doc_id", "source", kit.size_words(F.col("text")).alias("size"))
    docs = kit.materialize(docs, "mix-sizes")
    return assign(docs, "size").select(
        "doc_id", "source", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        (F.col("size") * F.size("_shards")).cast("long").alias("taken"), F.size("_shards").alias("copies"))


QUERIES = {"op8_mixing": op8_mixing}
ORACLES = {}
