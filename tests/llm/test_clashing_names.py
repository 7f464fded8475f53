"""Columns of the caller named like helper columns pass through untouched."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from wattline.llm import kit, mixing, sharding

NAMES = ("_draw", "_stratum", "_n", "_bucket", "_shift", "_rows", "_rank", "_at", "_place", "_size", "_block", "_copy", "_order", "_shards",
         "_target", "_source_size", "_shard", "_row", "_key0", "_count", "_words", "_places", "_ends", "_mix_words", "_id", "_hash")


@pytest.fixture(scope="module")
def named(docs):
    return docs.select("*", *[F.lit("x").alias(n) for n in NAMES])


def whole(rows, names):
    return all(r[n] == "x" for r in rows for n in names)


def test_shard(named, docs, documents):
    got = sharding.shard(named, shards=7).collect()
    assert len(got) == len(documents) and whole(got, NAMES)
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in got} == {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard(docs, shards=7).collect()}


def test_mix(named, docs):
    size = kit.size_words(F.col("text"))
    left = [n for n in NAMES if n != "_shard"]
    got, plain = mixing.mix(named, size, shards=5).collect(), mixing.mix(docs, size, shards=5).collect()
    assert whole(got, left) and Counter((r["doc_id"], r["_shard"]) for r in got) == Counter((r["doc_id"], r["_shard"]) for r in plain)
    loose = mixing.mix(named, size, shards=5, ordered=False).collect()
    assert Counter((r["doc_id"], r["_shard"]) for r in loose) == Counter((r["doc_id"], r["_shard"]) for r in plain)
    assigned = mixing.assign(named, size).collect()
    assert whole(assigned, [n for n in NAMES if n not in ("_source_size", "_target", "_shards")])


def test_bounded_sample(named, docs):
    got = kit.bounded_sample(named, "source", 3, 1, ["doc_id"]).collect()
    assert whole(got, [n for n in NAMES if n != "_count"])
    assert Counter(r["source"] for r in got) and max(Counter(r["source"] for r in got).values()) == 3


def test_mix_plain_python(docs, documents):
    """Words taken of each source, held against targets worked out in plain Python."""
    size = kit.size_words(F.col("text"))
    sizes, taken = Counter(), Counter()
    for r in mixing.assign(docs, size).collect():
        n = len([w for w in (r["text"] or "").replace("\t", " ").replace("\n", " ").split(" ") if w])
        sizes[r["source"]] += n
        taken[r["source"]] += n * len(r["_shards"])
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    fixed = {}
    while True:  # raise nothing above three times its source; share what is left by weight
        rest = sum(sizes.values()) - sum(fixed.values())
        free = [s for s in names if s not in fixed]
        want = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if want[s] > 3 * sizes[s]]
        if not over:
            break
        fixed |= {s: 3 * sizes[s] for s in over}
    want |= fixed
    largest = max(len((t or "").split()) for _, t, *_ in documents)
    assert all(abs(taken[s] - want[s]) <= max(largest / 2, 0.02 * want[s]) for s in names)
