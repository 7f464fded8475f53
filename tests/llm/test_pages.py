"""HTML extraction and WARC revisits."""

import html as html_lib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattline.llm import html_extraction as H, warc_revisits as W

SHELL = ('<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">a</a></ul></nav>'
         '<!-- ad --><div class="ad">buy</div>%s<footer>&copy; site</footer></body></html>')


@pytest.mark.parametrize("page,want", [
    (SHELL % "<article><h1>T &amp; x</h1><p><b>One<br>two <i>b</i>old<p>Next&nbsp;\n line</p></article>", ["T & x", "One two bold", "Next line"]),
    (SHELL % "<article><header>head</header><p>in</p><aside>side</aside><form><p>mail</p></form><section class='comments'><p>nice</p></section></article>", ["in"]),
    (SHELL % "<main><p>kept</p><div id=cookie-notice>no</div></main><div>outside</div>", ["kept"]),
    (SHELL % "<div class='post'><p>soft</p></div>", ["soft"]),
    (SHELL % "<div class='post'><p>teaser</p></div><article><p>real</p></article>", ["real"]),
    ("<article><p>un closed <a href='x>y'>link</a> 3 < 4", ["un closed link 3 < 4"]),
    ("<article><pre>a\n\n  b</pre><table><tr><td>c<td>d</table></article>", ["a b", "c", "d"]),
    (None, []), ("", []), ("<article></article>", []),
])
def test_article_blocks(page, want):
    assert H.parse(page)[0] == want


@pytest.mark.parametrize("page,want", [
    (SHELL % "<article class='post comments-open'><p>in</p></article>", ["in"]),
    (SHELL % "<main class='has-sidebar'><p>in</p></main>", ["in"]),
    (SHELL % "<main class='search'><p>in</p></main>", ["in"]),
    (SHELL % "<div class='with-sidebar'><article><p>in</p></article></div>", ["in"]),
    (SHELL % "<div class='sidebar'><article class='post comments-open'><p>in</p></article></div>", ["in"]),
    (SHELL % "<main><h1>t</h1><div class='toolbar-layout'><article><p>in</p></article></div></main>", ["t", "in"]),
    (SHELL % "<div class='post has-sidebar'><p>in</p></div>", ["in"]),
    ("<body><form id=aspnetForm><nav>menu</nav><article><p>in</p></article><footer>end</footer></form>", ["in"]),
    ("<body><form id=aspnetForm><div class='post'><p>in</p></div></form>", ["in"]),
    (SHELL % "<article><h1 class='entry-header'>T</h1><h2 id='related-work'>R</h2><p id='search'>in</p><section id='related-work'><p>w</p></section></article>",
     ["T", "R", "in", "w"]),
    (SHELL % "<article data-id='nav'><div data-id='nav'>in</div></article>", ["in"]),
    # what stays chrome
    (SHELL % "<article><p>in</p></article><section class='related-posts'><article><p>other</p></article></section>", ["in"]),
    (SHELL % "<article><p>in</p><div class='comments'><article><p>nice</p></article></div></article>", ["in"]),
    (SHELL % "<main><p>in</p><ol class='comments'><li><article class='comment-body'><p>nice</p></article></ol></main>", ["in"]),
    (SHELL % "<article><p>in</p><ul class='share-buttons'><li>post it</ul><form><h1>mail</h1></form></article>", ["in"]),
])
def test_names_of_layout_keep_the_article(page, want):
    assert H.parse(page)[0] == want


@pytest.mark.parametrize("page,want", [
    ("<article><p>a</p><section class='notice-of-terms'><p>b</p></section></article>", ["a", "b"]),
    ("<article><p>a</p><div class='search-results-explained'><p>b</p></div></article>", ["a", "b"]),
    ("<article><h1>T</h1><section id='header'><p>b c d</p></section></article>", ["T", "b c d"]),
    ("<article><div class='content related'><p>b</p></div></article>", ["b"]),
    ("<article><p>by A</p><div class='content related'><p>%s</p></div></article>" % ("b " * 300), ["by A", ("b " * 300).strip()]),
    ("<article><p>a</p><section class='the-history-of-advertising'><p>b</p></section></article>", ["a", "b"]),
    ("<div class='article-content'><p>long enough</p></div><div>tail</div>", ["long enough"]),
    # an article's own chrome goes, however long it is
    ("<article><p>a</p><div class='site-header'>long head</div><div class='cookie-notice'>we use cookies</div></article>", ["a"]),
    ("<article><h1>T</h1><div class='comments'><p>nice</p></div></article>", ["T"]),
    ("<article><p>a text</p><div class='notice'>a longer notice</div><div id='related'>others</div></article>", ["a text"]),
])
def test_names_count_as_a_whole(page, want):
    assert H.parse(page)[0] == want


def test_small_containers_named_like_an_article_leave_the_page_open():
    for name in ("article-list", "post"):
        article, rest, flags, has = H.parse(f"<div class='{name}'>x</div><p>main text</p>")
        assert not has and [w for w, f in zip(rest, flags) if f] == ["x", "main text"]


def test_very_long_pages_come_back_whole():
    paragraphs = [f"p{i} " + "w" * (i % 70) + " end" for i in range(60_000)]
    page = SHELL % ("<article>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</article>")
    assert H.parse(page)[0] == [" ".join(p.split()) for p in paragraphs]


def test_pages_wrapped_in_a_form_stay_open():
    article, rest, flags, has = H.parse("<body><form id=aspnetForm><nav>menu</nav><h1>T</h1><p>text</p><footer>end</footer></form>")
    assert not has and [w for w, f in zip(rest, flags) if f] == ["T", "text"] and H.parse("<form><p>mail</p></form>")[2] == [False]


def test_escaped_text_comes_back():
    rng = random.Random(3)
    for _ in range(50):
        paragraphs = [" ".join("".join(rng.choice("ab<>&\"'é;#1") for _ in range(6)) for _ in range(5)) for _ in range(3)]
        page = SHELL % ("<article>" + "".join(f"<p>{html_lib.escape(p)}</p>" for p in paragraphs) + "</article>")
        assert H.parse(page)[0] == paragraphs


def test_suffix_ranks():
    tokens, page = np.array([1, 2, 3, 1, 2, 3, 1, 2], dtype=np.uint64), np.array([0, 0, 0, 1, 1, 1, 1, 1])
    rank = H.suffix_ranks(tokens, page, 3)
    assert (rank < 0).tolist() == [False, True, True, False, False, False, True, True] and rank[0] == rank[3] != rank[4]


def brute_text(pages, run):
    streams = {}
    for i, (page_id, url, page) in enumerate(pages):
        _, rest, _, _ = H.parse(page)
        host = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", url or "")
        streams[i] = ((host[1].lower() if host else ""), (page_id, url), " ".join(rest).split())
    seen = {}
    for host, key, words in streams.values():
        for a in range(len(words) - run + 1):
            seen.setdefault((host, tuple(words[a:a + run])), set()).add(key)
    out = []
    for i, (page_id, url, page) in enumerate(pages):
        article, rest, flags, has = H.parse(page)
        if not has:
            host, _, words = streams[i]
            gone = {a + k for a in range(len(words) - run + 1) if len(seen[(host, tuple(words[a:a + run]))]) > 1 for k in range(run)}
            article, at = [], 0
            for block, is_open in zip(rest, flags):
                block = block.split()
                left = [w for k, w in enumerate(block) if at + k not in gone]
                at += len(block)
                if is_open and left:
                    article.append(" ".join(left))
        out.append((page_id, url, "\n\n".join(article)))
    return out


def test_open_blocks_lose_what_other_pages_repeat(spark):
    rng = random.Random(11)
    sentence = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    shared = [sentence(12) for _ in range(3)]
    pages = []
    for i in range(40):
        host = ["one.example", "Two.example", "hot.example", "hot.example", "hot.example"][i % 5]
        body = f"<div>{shared[i % 2]}</div><p>{sentence(20)}</p><div>{shared[2] if i % 3 else sentence(9)} tail{i}</div>"
        pages.append((i, f"http://{host}/p/{i}", SHELL % (f"<article>{body}</article>" if i % 7 == 0 else body)))
    pages += [(40, None, SHELL % f"<p>{shared[0]}</p>"), (None, None, SHELL % f"<p>{shared[0]}</p>"), (41, "http://one.example/p/1", None),
              (42, "http://one.example/q", ""), (0, pages[0][1], pages[0][2])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("x")).withColumn("host", F.lit(1))
    got = sorted(((r.page_id, r.url, r.text) for r in H.extract(df).collect()), key=str)
    assert got == sorted(brute_text(pages, H.RUN), key=str)
    assert H.extract(df.limit(0)).count() == 0


def test_phrases_and_mirrors_keep_open_text(spark):
    rng = random.Random(12)
    sentence = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    phrase, long, tagline, mains = sentence(12), sentence(40), "short tagline", [sentence(60) for _ in range(10)]
    pages = [(i, f"http://one.example/{i}", f"<div>{tagline}</div><p>{phrase} {m}</p><div>{long if i < 2 else sentence(40)}</div>") for i, m in enumerate(mains)]
    pages += [(100 + i, f"http://one.example/again/{i}", pages[9][2]) for i in range(20)]  # one page fetched again and again
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text.split("\n\n") for r in H.extract(df, run=H.LONG, share=H.SHARE).collect()}
    for i, m in enumerate(mains):
        assert got[i][0] == f"{phrase} {m}" and len(got[i]) == (1 if i < 2 else 2)
    assert len(got) == 30 and all(got[100 + i] == got[9] for i in range(20))


def test_canonical_urls(spark):
    cases = {"HTTPS://www.Example.com:443/a/b/?utm_source=x&b=2&a=1#top": "example.com/a/b?a=1&b=2", "http://example.com": "example.com",
             "example.com/?ref=1": "example.com", None: "", "http://h/p?": "h/p", "http://h/P?x": "h/P?x"}
    df = spark.createDataFrame([(k,) for k in cases], "url string").select(W.canonical(F.col("url")).alias("c"))
    assert [r.c for r in df.collect()] == list(cases.values())


def brute_revisits(records):
    out = []
    for r in records:
        if r["kind"] != "revisit":
            continue
        t = -(1 << 62) if r["ts"] is None else r["ts"]
        past = [x for x in records if x["kind"] == "response" and x["status"] == 200 and x["url"] == r["url"] and (-(1 << 62) if x["ts"] is None else x["ts"]) < t]
        own = r["headers"] or {}
        strip = lambda v: None if v is None else re.sub(r"^\s*W/", "", v)
        if not past:
            out.append((r["record_id"], "no_earlier_response", None, own, None))
            continue
        best = max(past, key=lambda x: (-(1 << 62) if x["ts"] is None else x["ts"], x["record_id"]))
        stored = best["headers"] or {}
        if own.get("etag") is None and own.get("last-modified") is None:
            out.append((r["record_id"], "no_validator", best["record_id"], own, None))
            continue
        if own.get("etag") is not None:
            ok = strip(own["etag"]) == strip(stored.get("etag"))
        else:
            ok = own["last-modified"] == stored.get("last-modified")
        if ok:
            out.append((r["record_id"], "resolved", best["record_id"], stored | {k: v for k, v in own.items() if k in W.UPDATED and v is not None}, best["payload"]))
        else:
            out.append((r["record_id"], "validator_mismatch", best["record_id"], own, None))
    return sorted(out)


def test_revisits(spark):
    rng = random.Random(5)
    records = []
    for i in range(400):
        url = rng.choice(["hot/x"] * 4 + [f"h{j}/p" for j in range(8)])
        tag = rng.choice(['"a"', '"b"', 'W/"a"', None])
        headers = {k: v for k, v in {"etag": tag, "last-modified": rng.choice(["mon", None]), "date": str(i), "content-length": str(i)}.items() if v}
        kind = rng.choice(["response", "revisit", "revisit", "request"])
        records.append({"record_id": i, "kind": kind, "url": url, "ts": rng.choice([None, *range(60)]), "status": rng.choice([200, 200, 404]),
                        "headers": headers if i % 50 else None, "payload": f"body{i}" if kind == "response" else None})
    df = spark.createDataFrame(records, "record_id long, kind string, url string, ts long, status int, headers map<string,string>, payload string")
    for block_rows in (10, 200_000):
        got = W.resolve(df.withColumn("outcome", F.lit("x")), block_rows).collect()
        assert sorted((r.record_id, r.outcome, r.ref_id, r.headers, r.payload) for r in got) == brute_revisits(records)
    assert W.resolve(df.limit(0)).count() == 0


def test_every_page_has_one_revisit_whatever_its_id(spark):
    """Repeated and null page ids neither multiply nor lose rows; pages without address meet no response."""
    pages = [(1, "https://a.org/x", "one"), (1, "https://a.org/x", "two"), (2, "https://a.org/y", "three"), (None, "https://b.org/", "four"),
             (None, None, "five"), (3, None, "six"), (4, "", None), (2, "https://a.org/y", "three")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    records = W.captures(df)
    facts = [r.asDict() for r in records.collect()]
    got = W.resolve(records, block_rows=3).collect()
    assert len(got) == len(pages)
    want = []
    for v in facts:
        if v["kind"] != "revisit":
            continue
        url = (v["url"] or "").replace("https://", "").replace("http://", "").replace("#part", "").rstrip("/")
        time = lambda r: -(1 << 62) if r["ts"] is None else r["ts"]
        earlier = [r for r in facts if r["kind"] == "response" and url and time(r) < time(v)
                   and (r["url"] or "").replace("https://", "").rstrip("/") == url]
        tag = lambda r: (r["headers"].get("etag") or "").removeprefix("W/") or None
        if not earlier:
            want.append((v["record_id"], "no_earlier_response", None, None))
            continue
        best = max(earlier, key=lambda r: (time(r), r["record_id"], tag(r)))
        date = v["headers"].get("last-modified")
        if tag(v) is None and date is None:
            outcome = "no_validator"
        else:
            outcome = "resolved" if (tag(v) == tag(best) if tag(v) else date == best["headers"].get("last-modified")) else "validator_mismatch"
        want.append((v["record_id"], outcome, best["record_id"], best["payload"] if outcome == "resolved" else None))
    assert sorted(((r.record_id, r.outcome, r.ref_id, r.payload) for r in got), key=str) == sorted(want, key=str)
