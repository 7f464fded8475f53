"""Exact dedup with an extendible-hash index kept in shared files.

1. Each task normalises its texts, hashes them (the 64-bit key is the head of the SHA-256) and folds equal texts,
   compared byte by byte, into one entry: a group of copies leaves a task once, however large it is.
2. The directory starts at ``DEPTH`` leading key bits. While a bucket holds more than ``BUCKET_BYTES``, the directory
   doubles for it: the bucket is split by the next key bit. Buckets whose keys are all equal can't split and stay.
3. Owner tasks take ranges of the directory. In key order they chain the entries of a key, comparing bytes, so texts
   whose keys collide stay apart. The index (entry to chain) is written to the shared folder.
4. Chains are summed, and each row gets its group through its entry.
"""

from __future__ import annotations

import hashlib
import math
import secrets
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from wattline.llm import kit

DEPTH = 8
BUCKET_BYTES = 64 << 20
FOLD_BYTES = 32 << 20
SPACES = b" \t\n\x0b\x0c\r"
_ENTRY = pa.schema([("_row", pa.int64()), ("_len", pa.int64()), ("_sha", pa.string()), ("_key", pa.int64()),
                    ("_entry", pa.string()), ("_text", pa.binary())])
_INDEX = pa.schema([("_entry", pa.string()), ("_chain", pa.string())])


def _fold(task_batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text; the first of equal texts in a fold carries the normalised bytes and names the entry."""
    seen: dict[bytes, list[tuple[bytes, str]]] = {}
    task, made, held = secrets.token_hex(8), 0, 0
    for batch in task_batches:
        cols: dict[str, list] = {n: [] for n in _ENTRY.names}
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            plain = (text or "").encode().translate(None, SPACES)
            digest = hashlib.sha256(plain)
            chain = seen.setdefault(digest.digest(), [])
            entry = next((e for t, e in chain if t == plain), None)
            first = entry is None
            if first:
                entry, made = f"{task}-{made}", made + 1
                chain.append((plain, entry))
                held += len(plain) + 200
            for name, value in zip(_ENTRY.names, (row, len(text or ""), digest.hexdigest(),
                                                  struct.unpack(">q", digest.digest()[:8])[0], entry, plain if first else None)):
                cols[name].append(value)
            if held > FOLD_BYTES:
                seen, held = {}, 0
        yield pa.RecordBatch.from_pydict(cols, schema=_ENTRY)


def _chain(task_batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chain name of every entry; input sorted by key, so only the distinct texts of one key are held."""
    key, chain = None, []
    for batch in task_batches:
        entries, chains = [], []
        for entry, k, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if k != key:
                key, chain = k, []
            at = next((i for i, t in enumerate(chain) if t == text), None)
            if at is None:
                at = len(chain)
                chain.append(text)
            entries.append(entry)
            chains.append(f"{k}/{at}")
        yield pa.RecordBatch.from_arrays([pa.array(entries, pa.string()), pa.array(chains, pa.string())], schema=_INDEX)


def directory(keys: DataFrame, bucket_bytes: int = BUCKET_BYTES, depth: int = DEPTH) -> tuple[int, DataFrame]:
    """First depth and the leaf buckets (``_depth`` leading bits, of value ``_prefix``) over (``_key``, ``_bytes``).

    The first directory has about one bucket for each ``bucket_bytes``; a round doubles it for all overfull buckets
    at once. A bucket with a single key is a leaf whatever it holds.
    """
    total = keys.agg(F.sum("_bytes")).first()[0] or 0
    depth = first = max(depth, math.ceil(math.log2(max(1, total / bucket_bytes))))
    leaves, level = None, keys
    while True:
        prefix = F.shiftrightunsigned("_key", 64 - depth).alias("_prefix")
        sizes = level.groupBy(prefix).agg(F.sum("_bytes").alias("_bytes"), F.min("_key").alias("_lo"), F.max("_key").alias("_hi"))
        sizes = kit.materialize(sizes.select(F.lit(depth).alias("_depth"), "_prefix", (
            (F.col("_bytes") > bucket_bytes) & (F.col("_lo") != F.col("_hi"))).alias("_full")), "dedup-directory")
        done = sizes.where(~F.col("_full")).drop("_full")
        leaves = done if leaves is None else leaves.unionByName(done)
        overfull = sizes.where("_full").select("_prefix")
        if overfull.isEmpty():
            return first, leaves
        level = level.withColumn("_prefix", prefix).join(overfull, "_prefix", "left_semi").drop("_prefix")
        depth += 1


def dedup(df: DataFrame, row: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``) for every row of ``df``.

    Texts are equal if identical without ``[\\x20\\x09-\\x0D]``; null and empty texts are equal to each other. Of
    equal texts the one with most code points stays, then the smallest id. Rows that share an id are rows of their
    own: each is returned, and is ``kept`` if its id is the group's. A null id counts as larger than all others.
    """
    rows = kit.materialize(
        df.select(F.col(row).cast("long").alias("_row"), F.col(text).cast("string").alias("_text"))
        .mapInArrow(_fold, "_row long, _len long, _sha string, _key long, _entry string, _text binary"), "dedup-entries")
    entries = rows.where(F.col("_text").isNotNull())
    first, leaves = directory(entries.select("_key", F.octet_length("_text").alias("_bytes")), bucket_bytes)
    heads = leaves.groupBy(F.expr(f"shiftrightunsigned(_prefix, _depth - {first})").alias("_head")).agg(
        F.collect_list(F.struct("_depth", "_prefix")).alias("_leaves"))
    placed = (entries.withColumn("_head", F.shiftrightunsigned("_key", 64 - first)).join(heads, "_head").withColumn(
        "_bucket", F.expr("filter(_leaves, l -> shiftrightunsigned(_key, 64 - l._depth) = l._prefix)[0]")))
    tasks = max(1, leaves.count())  # owner tasks: one for each leaf bucket
    owned = placed.repartition(tasks, "_bucket").sortWithinPartitions("_key")
    index = kit.materialize(owned.select("_entry", "_key", "_text").mapInArrow(_chain, "_entry string, _chain string"), "dedup-index")
    slim = rows.select("_row", "_len", "_sha", "_entry")
    local = slim.groupBy("_entry").agg(F.count(F.lit(1)).alias("_n"), F.max("_len").alias("_most"),
                                       F.min_by(F.struct(F.col("_row").isNull(), "_row"), F.struct(-F.col("_len"), F.col("_row").isNull(), "_row")).alias("_best"))
    chains = index.join(local, "_entry").groupBy("_chain").agg(
        F.sum("_n").alias("group_size"),
        F.min_by("_best", F.struct(-F.col("_most"), "_best")).getField("_row").alias("keep_id"))
    named = index.join(chains, "_chain").drop("_chain")
    return slim.join(named, "_entry").select(
        F.col("_row").alias("doc_id"), "keep_id", "group_size", F.col("_row").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("_sha").alias("text_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(kit.table(spark, sf_dir, "documents"))


QUERIES = {"op5_exact_dedup": op5_exact_dedup}
ORACLES = {"op5_exact_dedup": r"""
with t as (
  select doc_id, length(coalesce(text, '')) as len,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as plain
  from documents),
best as (
  select plain, arg_min(doc_id, (-len, doc_id)) as keep_id, count(*) as group_size from t group by plain)
select t.doc_id, best.keep_id, best.group_size, t.doc_id = best.keep_id as kept, sha256(t.plain) as text_sha256
from t join best using (plain)
"""}
