"""Mixing and sharding: quotas, laws and repeatability."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattline.llm import kit, mixing, sharding


def test_targets_share_the_excess():
    got = mixing.targets([100, 10, 1000, 0])
    assert got == pytest.approx([234.0, 30, 846.0, 0]) or sum(got) == pytest.approx(1110)
    assert got[1] == 30 and got[3] == 0 and all(t <= 3 * s for t, s in zip(got, [100, 10, 1000, 0]))
    assert mixing.targets([]) == []


def test_split_keeps_quotas():
    quotas = np.array([1000, 3, 0, 57])
    parts = mixing.split(quotas, 7, 5)
    assert (parts.sum(axis=0) == quotas).all() and parts.sum(axis=1).max() - parts.sum(axis=1).min() <= 2
    assert (parts == mixing.split(quotas, 7, 5)).all()


def test_mix(docs, documents):
    sized = docs.withColumn("size", kit.size_words(F.col("text")))
    first = [r.asDict() for r in mixing.assign(sized, "size").collect()]
    again = {r["doc_id"]: r["_shards"] for r in mixing.assign(sized, "size").collect()}
    assert len(first) == len(documents) and {r["doc_id"]: r["_shards"] for r in first} == again
    sizes, taken, target, largest = Counter(), Counter(), {}, Counter()
    for r in first:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * len(r["_shards"])
        target[r["source"]] = r["_target"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert len(r["_shards"]) <= 3
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    assert [target[s] for s in order] == pytest.approx(mixing.targets([sizes[s] for s in order]))
    for s in order:
        assert abs(taken[s] - target[s]) <= max(largest[s] / 2, 0.02 * target[s])
    rows = mixing.mix(sized, "size", shards=8).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter({r["doc_id"]: len(r["_shards"]) for r in first if r["_shards"]})


def test_mix_of_nothing(no_docs):
    assert mixing.mix(no_docs.withColumn("size", F.lit(0)), "size").count() == 0


@pytest.mark.parametrize("shards,bucket_rows", [(7, 200_000), (40, 200_000), (100, 3)])
def test_shards(clashing, documents, shards, bucket_rows):
    out = sharding.shard(clashing.drop("shard", "slot"), shards=shards, bucket_rows=bucket_rows)
    got = out.collect()
    assert sorted(r["doc_id"] for r in got) == sorted(d[0] for d in documents)
    slots, mix = defaultdict(list), defaultdict(Counter)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        mix[r["source"]][r["shard"]] += 1
    assert set(slots) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots.get(i, [])) for i in range(shards)]
    assert max(counts) - min(counts) <= 1
    for per in mix.values():  # a cut of the order is off by one row of each source at most, so a shard by its part of those
        n = sum(per.values())
        assert all(abs(per.get(i, 0) - n / shards) <= 1 + n * len(mix) / len(got) for i in range(shards))
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in got} == {(r["doc_id"], r["shard"], r["slot"]) for r in out.collect()}


def test_shards_edges(spark, no_docs):
    assert sharding.shard(no_docs).count() == 0
    odd = spark.createDataFrame([(None, None), (None, None), (1, "a"), (1, "a"), (1, None)], "doc_id long, source string")
    got = sharding.shard(odd, shards=3).collect()
    assert sorted(Counter(r["shard"] for r in got).values()) == [1, 2, 2]
