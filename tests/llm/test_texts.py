"""Word operators against plain Python: hashes, exact dedup, substring dedup, near-dedup, decontamination."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wattline.llm import decontamination, exact_dedup, near_dedup, substring_dedup, textkit as tk

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LAST = (1 << 63) - 1


def words(text):
    return SPACE.findall(text or "")


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_word_spans_and_hashes_follow_the_words():
    texts = ["a bb  a", None, "", "été\tA\nbb", " x ", "bb"]
    column = pa.array(texts)
    seen = {}
    for i, j, data, offsets in tk.batches(column, limit=6):
        s, e, first = tk.word_spans(data, offsets, tk.space_table())
        h = tk.word_hashes(data, s, e)
        for d in range(j - i):
            want = words(texts[i + d])
            got = [data[a:b].tobytes().decode() for a, b in zip(s[first[d]:first[d + 1]], e[first[d]:first[d + 1]])]
            assert got == want
            for w, v in zip(got, h[first[d]:first[d + 1]].tolist()):
                assert seen.setdefault(w, v) == v
    assert len(set(seen.values())) == len(seen)


def test_shingles_of_a_long_word_and_of_sections(monkeypatch):
    monkeypatch.setattr(tk, "SECTION", 16)
    text = "x" * 100 + " " + " ".join(f"w{i % 7}" for i in range(50))
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    s, e, _ = tk.word_spans(data, np.array([0, len(data)]), tk.space_table())
    parts = tk.word_hashes(data, s, e)
    monkeypatch.setattr(tk, "SECTION", 1 << 20)
    assert (parts == tk.word_hashes(data, s, e)).all()
    grams = tk.shingle_hashes(parts, 3)
    plain = text.split()
    same = defaultdict(set)
    for i, g in enumerate(grams.tolist()):
        same[tuple(plain[i:i + 3])].add(g)
    assert all(len(v) == 1 for v in same.values()) and len({g for v in same.values() for g in v}) == len(same)


def test_ranges():
    assert tk.ranges(np.array([5, 9, 0]), np.array([2, 0, 3])).tolist() == [5, 6, 0, 1, 2]


# exact dedup

def brute_exact(docs):
    groups = defaultdict(list)
    for i, text, *_ in docs:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), LAST if i is None else i, i))
    out = []
    for plain, members in groups.items():
        keep = min(members)[2]
        for _, _, i in members:
            out.append({"doc_id": i, "keep_id": keep, "group_size": len(members), "kept": i == keep,
                        "text_sha256": hashlib.sha256(plain.encode()).hexdigest()})
    return out


def by_id(found):
    return sorted(found, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, str(sorted(r.items(), key=str))))


def test_exact_dedup(documents, docs, clashing):
    want = by_id(brute_exact(documents))
    assert by_id(rows(exact_dedup.dedup(docs))) == want
    assert by_id(rows(exact_dedup.dedup(clashing, bucket_bytes=300))) == want  # splits most buckets


def test_exact_dedup_edges(spark, no_docs):
    assert exact_dedup.dedup(no_docs).count() == 0
    odd = [(1, "a b"), (1, "ab"), (None, "a  b"), (3, None), (4, ""), (None, "zz"), (2, "a\tb")]
    got = rows(exact_dedup.dedup(spark.createDataFrame(odd, "doc_id long, text string")))
    assert by_id(got) == by_id(brute_exact(odd))


def test_colliding_keys_are_chained(spark):
    parts = [pa.RecordBatch.from_pydict({"e": ["p", "q", "r"], "k": [5, 5, 5], "t": [b"one", b"two", b"one"]})]
    chains = next(exact_dedup._chain(iter(parts))).column(1).to_pylist()
    assert chains[0] == chains[2] != chains[1]


# substring dedup

def brute_substring(docs, window):
    owner = {}
    for i, text, *_ in docs:
        w = words(text)
        for a in range(len(w) - window + 1):
            key = tuple(w[a:a + window])
            owner[key] = min(owner.get(key, LAST), LAST if i is None else i)
    out = []
    for i, text, *_ in docs:
        w = words(text)
        gone = {a + k for a in range(len(w) - window + 1) if owner[tuple(w[a:a + window])] < (LAST if i is None else i) for k in range(window)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append({"doc_id": i, "n_words": len(w), "n_removed": len(gone), "kept_text": kept})
    return out


@pytest.mark.parametrize("window,gram", [(50, 8), (12, 5)])
def test_substring_dedup(documents, clashing, window, gram):
    assert by_id(rows(substring_dedup.dedup(clashing, window=window, gram=gram))) == by_id(brute_substring(documents, window))


def test_substring_dedup_in_sections(documents, docs, monkeypatch):
    monkeypatch.setattr(substring_dedup, "_SECTION", 37)
    found = substring_dedup._anchors
    w = np.arange(400, dtype=np.uint64) % np.uint64(90) + np.uint64(3)
    start, n, _ = found(tk.mix(w), np.repeat([0, 1], 200), 50, 8)
    covered = sorted(a + k for a, m in zip(start.tolist(), n.tolist()) for k in range(m))
    assert covered == [*range(151), *range(200, 351)]


def test_substring_dedup_edges(spark, no_docs):
    assert substring_dedup.dedup(no_docs).count() == 0
    text = " ".join(str(i) for i in range(60))
    odd = [(5, text), (5, text), (None, text), (2, None), (3, ""), (None, "x " + text)]
    assert by_id(rows(substring_dedup.dedup(spark.createDataFrame(odd, "doc_id long, text string")))) == by_id(brute_substring(odd, 50))


# near-dedup

def brute_near(docs, k, num, den):
    sets = []
    for i, text, *_ in docs:
        w = words(lower(text))
        sets.append((i, {tuple(w[a:a + k]) for a in range(max(1, len(w) - k + 1))} if w else set()))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and den * len(a & b) >= num * len(a | b):
                parent[root(x)] = root(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        least[root(x)] = min(least.get(root(x), LAST), LAST if i is None else i)
    out = []
    for x, (i, s) in enumerate(sets):
        c = least[root(x)]
        out.append({"doc_id": i, "n_shingles": len(s), "component_id": None if c == LAST else c, "kept": c == (LAST if i is None else i)})
    return out


@pytest.mark.parametrize("k,num,size,rounds", [(3, 85, 64, 2), (5, 80, 16, 0), (3, 60, 32, 1)])
def test_near_dedup(documents, clashing, k, num, size, rounds):
    got = near_dedup.groups(clashing, shingle=k, numerator=num, size=size, rounds=rounds).drop("text_hash")
    assert by_id(rows(got)) == by_id(brute_near(documents, k, num, 100))


def test_near_dedup_chains_of_edits(spark):
    """Neighbours are linked, ends are not: all one group, through lists that span several components."""
    base = [f"w{i}" for i in range(100)]
    docs = []
    for i in range(30):
        words_ = list(base)
        words_[:i] = [f"v{j}" for j in range(i)]
        docs.append((100 - i, " ".join(words_)))
    got = near_dedup.groups(spark.createDataFrame(docs, "doc_id long, text string")).drop("text_hash")
    want = by_id(brute_near(docs, 3, 85, 100))
    assert by_id(rows(got)) == want and len({r["component_id"] for r in want}) == 1


def test_near_dedup_edges(spark, no_docs):
    assert near_dedup.groups(no_docs).count() == 0
    odd = [(1, None), (2, ""), (3, " "), (4, "One two"), (5, "one  TWO"), (None, "one two"), (6, "three")]
    got = near_dedup.groups(spark.createDataFrame(odd, "doc_id long, text string")).drop("text_hash")
    assert by_id(rows(got)) == by_id(brute_near(odd, 3, 85, 100))


# decontamination

def brute_contamination(docs, bench):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = []
    for item, text in bench:
        w = pattern.findall(lower(text))
        n = min(13, len(w))
        windows += [(item, w[a:a + n]) for a in range(len(w) - n + 1)] if w else []
    out = []
    for i, text, *_ in docs:
        w = pattern.findall(lower(text))
        hit, items = set(), set()
        for item, win in windows:
            for a in range(len(w) - len(win) + 1):
                if w[a:a + len(win)] == win:
                    hit |= set(range(a, a + len(win)))
                    items.add("" if item is None else str(item))
        out.append({"doc_id": i, "n_words": len(w), "n_hit": len(hit), "n_items": len(items),
                    "items_sha256": hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(),
                    "contaminated": len(hit) > 0 and 20 * len(hit) >= len(w)})
    return out


def test_decontamination(spark, documents, clashing):
    docs = documents[:-2]
    passage = words(docs[6][1])
    bench = [(1, " ".join(passage[10:30])), (2, " ".join(passage[5:18]).upper()), (3, "The"), (4, None), (5, "?!"), (10, "of, and"),
             (None, "  ".join(passage[40:60])), (2, " ".join(passage[50:70])), (11, "nowhere to be found " * 5)]
    found = decontamination.report(clashing.where(F.col("doc_id") < len(docs)), spark.createDataFrame(bench, "item_id long, text string"))
    assert by_id(rows(found.drop("text_hash"))) == by_id(brute_contamination(docs, bench))


def test_decontamination_of_nothing(spark, docs, no_docs):
    no_items = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.report(no_docs, no_items).count() == 0
    assert decontamination.report(docs, no_items).where("n_hit > 0 or contaminated or n_items > 0").count() == 0
