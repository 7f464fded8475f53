"""Periodic runs against all stretches of all lags."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattline.llm import periodic_runs as pr

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return SPACE.findall(text or "")


def smallest_period(w):
    fail = [0] * (len(w) + 1)
    k = 0
    for i in range(1, len(w)):
        while k and w[i] != w[k]:
            k = fail[k]
        k += w[i] == w[k]
        fail[i + 1] = k
    return len(w) - fail[len(w)]


def brute(w):
    out = set()
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j + q - i
            if n >= max(6, 4 * q) and smallest_period(w[i:i + n]) == q:
                out.add((i, n, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(doc_id, w):
    if doc_id is None or not w:
        return w
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return w
    n, g = len(w), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def digest(doc_id, text):
    w = planted(doc_id, words_of(text))
    runs = brute(w)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)), len(w))


def noisy(rng, n, kinds):
    """Words with runs of many periods, some broken by one word, some of periods that have periods themselves."""
    out = []
    while len(out) < n:
        kind = rng.randrange(4)
        if kind == 0:
            out += [f"w{rng.randrange(kinds)}" for _ in range(rng.randrange(1, 40))]
            continue
        q = rng.choice([1, 2, 3, 5, 8, 9, 10, 13, 14, 15, 23, 24, 36, 37, 50, 57, 90])
        unit = [f"w{rng.randrange(kinds)}" for _ in range(q)]
        if kind == 3:
            unit = unit * 2 + [f"x{rng.randrange(3)}"]
        part = unit * rng.choice([3, 4, 4, 5, 9])
        part = part[:len(part) - rng.randrange(0, q)]
        if rng.random() < 0.3:
            part[rng.randrange(len(part))] = "broken"
        out += part
    return out[:n]


@pytest.mark.parametrize("kinds", [2, 3, 1000])
def test_runs_equal_all_stretches(kinds):
    rng = random.Random(kinds)
    for _ in range(30):
        texts = sorted((noisy(rng, rng.choice([0, 1, 6, 30, 200, 700]), kinds) for _ in range(4)), key=len, reverse=True)
        number = {}
        ids = np.array([number.setdefault(x, len(number)) for t in texts for x in t], dtype=np.int64)
        got = pr.find(ids, np.array([len(t) for t in texts], dtype=np.int64))
        assert got == [(d, s, n, q) for d, t in enumerate(texts) for s, n, q in brute(t)]


def test_every_period_is_found_at_exactly_four_periods():
    for q in range(1, 260):
        unit = [f"u{i}" for i in range(q)]
        w = ["a", "b"] + (unit * 6)[:max(6, 4 * q)] + ["c"]
        ids = np.array([hash(x) % (1 << 40) for x in w], dtype=np.int64)
        assert pr.find(ids, np.array([len(w)])) == [(0, 2, max(6, 4 * q), q)]
        short = ["a"] + (unit * 6)[:max(6, 4 * q) - 1] + ["c"]
        assert pr.find(np.array([hash(x) % (1 << 40) for x in short]), np.array([len(short)])) == []


def test_query_digests(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(noisy(rng, rng.choice([0, 3, 8, 60, 400]), rng.choice([2, 4, 500])))) for i in range(120)]
    rows += [(7, "a \t a\n a a a a"), (7, "a \t a\n a a a a"), (None, "x y " * 9), (200, None), (201, " \n"), (202, "é é é é é é ü"),
             (0, " ".join(f"v{i % 700}" for i in range(9000))), (20, " ".join(f"v{i * i % 991}" for i in range(30_000)))]
    found = [(i, t) for i, t in rows]
    spark.createDataFrame(found, "doc_id long, text string").withColumn("runs", F.lit("other")).withColumn("words", F.lit(1)).write.parquet(
        str(tmp_path / "documents.parquet"))
    got = pr.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns[:8] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    small = [r for r in found if len(words_of(r[1])) <= 1000]
    by = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[6], r[7]))
    kept = [tuple(r) for r in got.collect()]
    assert len(kept) == len(found)
    long_ones = [r for r in kept if r[8] > 1000]
    assert by(r for r in kept if r[8] <= 1000) == by(digest(*r) for r in small)
    assert sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in small if r[0] is not None) > 5
    want = {i: planted(i, words_of(t)) for i, t in found if len(words_of(t)) > 1000}
    for r in long_ones:  # one run at most in these texts: its period is the least lag at which its words repeat
        n, s, q = r[3], r[2], r[4]
        w = want[r[0]]
        if r[1]:
            assert smallest_period(w[s:s + n]) == q and (s == 0 or w[s - 1] != w[s - 1 + q]) and (s + n == len(w) or w[s + n] != w[s + n - q])
    assert any(r[1] == 1 for r in long_ones)


def test_spans_and_collapsed_text(spark):
    df = spark.createDataFrame([(1, "say  go go go go go go now"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pr.periodic_runs(df).collect()}
    assert got[1]["collapsed"] == "say go now" and [tuple(x) for x in got[1]["runs"]] == [(1, 6, 1)]
    assert got[2]["collapsed"] == "" and got[2]["runs"] == [] and got[2]["n_words"] == 0


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pr.periodic_runs(pr.with_planted(empty)).count() == 0
