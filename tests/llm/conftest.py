import random

import pytest

LONG_WORDS = 30_000


def make_documents(seed=7, rows=60):
    """Documents with copies, near copies, shared passages, blanks of all kinds, nulls, empty and very long texts."""
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", "été", "straße", "x1", "Word", "ño"] + [f"w{i}" for i in range(300)]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = sentence(70)
    base = sentence(120).split(" ")
    docs = []
    for i in range(rows):
        kind = i % 10
        if kind in (0, 1):
            text = sentence(rng.randint(60, 200))
        elif kind == 2:
            words = list(base)
            words[rng.randrange(len(words))] = f"edit{i}"
            text = " ".join(words)
        elif kind == 3:
            text = sentence(30) + "\n" + passage + "\t" + sentence(30)
        elif kind == 4:
            text = docs[0][1].replace(" ", "  ") if i % 20 == 4 else docs[0][1]
        elif kind == 5:
            text = sentence(rng.randint(1, 4))
        elif kind == 6:
            text = passage
        elif kind == 7:
            text = [None, "", " \n\t", "!!! 123", "A"][(i // 10) % 5]
        elif kind == 8:
            text = " ".join(base)
        else:
            text = sentence(55) + " " + sentence(55)
        docs.append((i, text, ["en", "de", None][i % 3], ["a", "b", None, "hot", "hot", "hot"][i % 6], len(text or "")))
    docs.append((rows, sentence(LONG_WORDS), "en", "hot", 0))
    docs.append((rows + 1, passage + " " + passage, "en", "hot", 0))
    return docs


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents():
    return make_documents()


@pytest.fixture(scope="session")
def docs(spark, documents):
    return spark.createDataFrame(documents, SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """The documents with more columns, named like results and helpers."""
    from pyspark.sql import functions as F

    for name in ("size", "kept", "shard", "slot", "n_words", "score", "item", "target", "taken", "uid", "th", "rep", "entry"):
        docs = docs.withColumn(name, F.lit("other"))
    return docs


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
