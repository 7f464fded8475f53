"""Trained operators: held-out accuracy, repeatability, edge cases; the gradients against differences."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from wattline.llm import kit, language_id as L, quality as Q

SF = "/root/testdata/sf0.01"


def test_language_id(spark):
    docs = kit.table(spark, SF, "documents")
    found = L.op9_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(found) == docs.count() and found["score"].between(0, 1).all()
    held = found[found["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.97
    again = L.op9_language_id(spark, SF).toPandas()
    assert dict(zip(again["doc_id"], again["score"])) == dict(zip(found["doc_id"], found["score"]))


def test_language_id_edges(spark, clashing, documents, no_docs):
    model = L.learn(clashing)
    got = {r.doc_id: r for r in L.identify(clashing, model).collect()}
    assert len(got) == len(documents)
    for i, text, *_ in documents:
        letters = any(c.isalpha() for c in text or "")
        assert (got[i].lang_pred == "und") == (not letters) and (letters or got[i].score == 0.0)
        assert got[i].lang_pred in ("und", "en", "de")
    assert L.learn(no_docs) is None and L.identify(no_docs, None).count() == 0
    assert {r.lang_pred for r in L.identify(clashing, None).collect()} == {"und"}


def test_language_score_is_that_of_the_whole_text(spark):
    """The batch form agrees with a plain mean over all subwords of each text."""
    model = L.fit([(f"the cat number {i} sat", "en") for i in range(40)] + [(f"der hund nummer {i} ging", "de") for i in range(40)])
    texts = ["the cat " * 5000, "x", "der Hund", "é"]
    part = pa.RecordBatch.from_pydict({"i": [1, 2, 3, 4], "t": texts, "l": [True] * 4})
    got = next(L.scorer(model)(iter([part]))).column(2).to_pylist()
    for text, score in zip(texts, got):
        at, w = L._bag(text)
        p = L._softmax((w.astype(float) @ model.table[at] if len(at) else 0) + model.bias)
        assert abs(float(np.max(p)) - score) < 1e-4


def test_quality(spark):
    labels = kit.table(spark, SF, "labels")
    found = Q.op10_quality(spark, SF).join(labels, "doc_id").toPandas()
    assert found["score"].between(0, 1).all() and set(found["predicted"]) <= {0, 1}
    assert ((found["score"] >= 0.3) == (found["predicted"] == 1)).all()
    held = found[found["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.95 and (held[held["quality"] == 1]["predicted"]).mean() > 0.98


def test_quality_edges(spark, clashing, documents, no_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 1), (None, 1), (5, None)], "doc_id long, quality int")
    model = Q.learn(clashing, labels)
    got = Q.scores(clashing, model).collect()
    assert sorted(r.doc_id for r in got) == [d[0] for d in documents] and all(0 <= r.score <= 1 for r in got)
    kept = Q.keep_good(clashing, model)
    assert kept.columns == clashing.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.predicted)
    assert Q.learn(no_docs, labels) is None and Q.learn(clashing, labels.limit(0)) is None
    assert Q.scores(no_docs, model).count() == 0 and Q.keep_good(clashing, None).count() == len(documents)


def test_passages_cover_the_text():
    text = " ".join(f"w{i}" for i in range(Q.PASSAGE * 2 + 5)).encode()
    data = np.frombuffer(text + b"  " + text[:20], dtype=np.uint8)
    x, heads = Q.encode(data, np.array([0, len(text), len(text) + 2, len(data)]))
    assert heads.tolist() == [0, 3, 4, 5] and not x[3].any() and x[:3].any(axis=1).all()
    alone, _ = Q.encode(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]))
    assert np.allclose(alone, x[:3])


def test_attention_gradients():
    rng = np.random.default_rng(1)
    bags = [rng.normal(size=(m, Q.FEATURES)) for m in (3, 1, 4)]
    model = Q.fit(bags, np.array([1.0, 0, 1]), np.ones(3))
    heads, x, y, cost = np.array([0, 3, 4, 8]), np.concatenate(bags), np.array([0.0, 1, 1]), np.array([1.0, 2, 1])

    def loss():
        p = Q.forward(model, x, heads)["p"]
        return -(cost * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / cost.sum()

    exact = Q._gradients(model, Q.forward(model, x, heads), heads, y, cost)
    for name, w in model.weights.items():
        at = tuple(0 for _ in w.shape)
        keep = w[at]
        w[at] = keep + 1e-5
        up = loss()
        w[at] = keep - 1e-5
        down = loss()
        w[at] = keep
        assert abs((up - down) / 2e-5 - exact[name][at]) < 1e-5


def test_bounded_sample(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 900, "x").otherwise("y").alias("s"))
    got = kit.bounded_sample(df, "s", 50, 1, ["id"]).collect()
    assert sorted((r.s, r._count) for r in got) == [("x", 900)] * 50 + [("y", 100)] * 50
