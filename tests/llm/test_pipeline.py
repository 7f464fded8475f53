"""The corpus pipeline: each stage on its own input against brute force, and the whole run."""

import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline as P
from test_texts import brute_contamination, brute_near
from wattline.llm import kit, quality


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory, documents):
    """The documents with more columns and repeated rows, and labels and items for them."""
    where = str(tmp_path_factory.mktemp("pipeline"))
    passage = documents[6][1].split()
    rows = [*documents[:-2], documents[0], (None, "alone here in this row", None, None, 5), (None, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' as shingles", "1 as score").write.parquet(
        f"{where}/documents.parquet")
    spark.createDataFrame([(i, int(i % 9 != 0)) for i in range(40)], "doc_id long, quality int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, " ".join(passage[10:30])), (2, None)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where, rows


def ids(df):
    return Counter(r["doc_id"] for r in df.collect())


def test_stages(spark, small):
    where, rows = small
    docs = kit.table(spark, where, "documents")
    columns = docs.columns
    model = quality.learn(docs, kit.table(spark, where, "labels"))
    good = P.good_documents(spark, docs, where)
    assert good.columns == columns and ids(good) == Counter(r.doc_id for r in quality.scores(docs, model).collect() if r.predicted)

    near = P.distinct_documents(spark, docs, where)
    assert near.columns == columns and ids(near) == Counter(r["doc_id"] for r in brute_near(rows, 5, 80, 100) if r["kept"])

    clean = P.clean_documents(spark, docs, where)
    items = [(r.item_id, r.text) for r in kit.table(spark, where, "benchmark").collect()]
    want = brute_contamination(rows, items)
    assert clean.columns == columns and ids(clean) == Counter(r["doc_id"] for r in want if not r["contaminated"])
    assert any(r["contaminated"] for r in want)

    mixed = P.mixed_documents(spark, docs, where)
    copies = ids(docs)
    assert mixed.columns == columns and all(n <= 3 * copies[i] for i, n in ids(mixed).items())

    out = P.sharded_documents(spark, docs, where)
    assert out.columns == [*columns, "shard", "slot"] and ids(out) == copies


def test_run(spark, small):
    where, _ = small
    got = P.run(spark, where).collect()
    assert [name for name, _ in P.STAGES] == ["quality_classifier", "near_dedup", "decontamination", "mixing", "sharding"]
    slots = Counter((r.shard, r.slot) for r in got)
    assert got and max(slots.values()) == 1
    assert Counter((r.doc_id, r.shard, r.slot) for r in got) == Counter((r.doc_id, r.shard, r.slot) for r in P.run(spark, where).collect())


NAMES = ("_mix_words", "_shard", "_row", "_id", "_hash", "_draw", "_stratum", "_n", "_bucket", "_block", "_copy", "_target", "_count", "kept", "uid")


def test_one_row_of_repeated_documents(spark, small):
    """A document repeated as it is, with or without words, leaves one row; nothing else changes."""
    where, rows = small
    docs = kit.table(spark, where, "documents")
    again = docs.unionByName(docs.where("doc_id in (7, 8, 17) or doc_id is null"))
    plain = Counter((r["doc_id"], r["text"]) for r in P.distinct_documents(spark, docs, where).collect())
    got = P.distinct_rows(spark, again, where)
    assert got.columns == docs.columns and Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter(set(plain))
    assert dict(P.STAGES)["near_dedup"] is P.distinct_rows


def test_columns_named_like_helpers(spark, small, tmp_path):
    from pyspark.sql import functions as F

    where, _ = small
    docs = kit.table(spark, where, "documents").select("*", *[F.lit("x").alias(n) for n in NAMES])
    for name, stage in P.STAGES:
        out = kit.materialize(stage(spark, docs, where), f"names-{name}")
        got = out.collect()
        assert got and all(r[n] == "x" for r in got for n in NAMES)
        docs = out


def test_no_documents(spark, small, tmp_path):
    where, _ = small
    kit.table(spark, where, "documents").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        kit.table(spark, where, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
