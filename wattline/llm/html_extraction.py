"""HTML extraction: page structure first, a host suffix array for what structure leaves open.

A page's article (``article``, ``main`` or a container named like one) is kept as it is, less the menus, forms, notices,
adverts and comments inside it. Recurring text cannot be judged by repetition there, as paragraphs are shared between
articles, nor can most menus and footers, which differ from page to page: both are told by their markup. Blocks outside
any marked part, on pages without an article, are open. They are judged by the host's other pages:

1. A page's token stream is its visible text outside articles. Tasks join the streams of a host and sort their
   suffixes by the first ``run`` tokens (prefix doubling). Neighbours that agree are folded to one row with the range
   of pages they occur on.
2. Rows of all tasks merge: a run on two distinct pages of the host is repeated.
3. Tokens of open blocks inside a repeated run are removed; the unique runs stay.

The query counts texts, not pages: pages of a host with equal streams are one, so that a page fetched twice repeats nothing.
Runs are ``LONG`` tokens, as shorter ones are phrases that recur in main text the more often the larger the host is. Shorter
boilerplate goes by whole blocks: those on ``SHARE`` of the host's texts, and on ``TEXTS`` at least.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from wattline.llm import bitset, kit, textkit as tk

RUN = 8
LONG = 32
SHARE, TEXTS = 0.2, 3
MOST, BODY = 0.9, 500  # this share of an article's text, headings apart, and so many characters are its body; so is all of it
_WORDS = tk.space_table()
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)
                      |<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^"'>]|"[^"]*"|'[^']*')*)>|<[/!?a-zA-Z][^>]*(?:>|\Z)""", re.S | re.I | re.X)
_NAMED = re.compile(r"""(?<![\w:-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)"
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME_TAGS = frozenset("nav header footer aside form menu dialog head button select".split())
CHROME_NAMES = frozenset("""ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments complementary
    consent contentinfo cookie cookies copyright dialog disclaimer footer form gdpr header legal masthead menu menubar modal nav navbar
    navigation newsletter notice notices pager pagination popup promo promotion related reply replies respond search share sharing sidebar
    signup social sponsor sponsored subscribe subscription toolbar widget""".split())
ARTICLE_NAMES = frozenset("article entry main post story".split())
CONTENT = frozenset("area body container content inner section text wrap wrapper".split())
# chrome names that main text may stand under as well; such an element is no chrome if it holds its article's body
AMBIGUOUS = frozenset("alert banner disclaimer form header legal masthead notice notices related search social widget".split())
# names with these words are titles turned into names ('history-of-advertising')
TITLE_WORDS = frozenset("a about an and for how in of on or the to what why".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# names of an element that lists other texts: such a wrapper is no mere layout around the article
OTHERS = frozenset("""ad ads advert adverts advertisement advertising comment comments promo promotion related replies reply respond
    sponsor sponsored widget""".split())
# an id beside whose chrome words stands another word is a heading's anchor ('related-work')
NEUTRAL = frozenset("area articles block body box button buttons container content div inner items item left links list main outer posts post right section top wrap wrapper".split())
_STATE = re.compile(r"(?:has|have|with|without|no|not|is|show|hide)[-_].*|.*[-_](?:open|opened|closed|enabled|disabled|active|on|off|visible|hidden|allowed)")
CONTAINERS = frozenset("center details div dl fieldset figure ol section table tbody td tr ul".split())
_LEAVE, _CHROME, _ARTICLE = 0, 1, 2
_WEAK, _FORM = 3, 4  # chrome unless it holds the article; a form also where it wraps the page
_RANK = {"article": 3, "main": 2}
_PAGE_TAGS = frozenset("article footer h1 header main nav".split())


class _Element:
    """An open tag that counts: its kind, for an article how sure that is (article 3, main 2, a name 1), its chrome words."""

    __slots__ = ("kind", "rank", "words")

    def __init__(self, kind: int, rank: int = 0, words: frozenset = frozenset()):
        self.kind, self.rank, self.words = kind, rank, words


def _names(attributes: str) -> tuple[set[str], set[str]]:
    """Article words and chrome words that the class, id and role name.

    A name is judged as a whole: its last word that is not ``NEUTRAL`` says what it is, so 'share-buttons' and 'site-header' are
    chrome, 'search-results-explained' and 'article-list' are not. An id must consist of chrome and neutral words alone, an
    article's name of article and ``CONTENT`` words. States ('has-sidebar') and titles ('notice-of-terms') name nothing.
    """
    article, chrome = set(), set()
    for m in _NAMED.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").lower()
        for token in value.split():
            if _STATE.fullmatch(token):
                continue
            parts = [w for w in re.split(r"[^a-z0-9]+", token) if w]
            if TITLE_WORDS.intersection(parts):
                continue
            if parts and all(w in ARTICLE_NAMES or w in CONTENT for w in parts):
                article |= ARTICLE_NAMES.intersection(parts)
            named = [w for w in parts if w not in NEUTRAL and not w.isdigit()]
            if named and named[-1] in CHROME_NAMES and (m[1].lower() != "id" or all(w in CHROME_NAMES for w in named)):
                chrome |= CHROME_NAMES.intersection(named)
    return article, chrome


def _element(tag: str, attributes: str) -> _Element | None:
    if tag in _RANK:
        return _Element(_ARTICLE, _RANK[tag], frozenset(w.rstrip("s") for w in _names(attributes)[1]))
    if tag == "form":
        return _Element(_FORM)
    if tag in CHROME_TAGS:
        return _Element(_CHROME)
    if tag not in CONTAINERS or not attributes.strip():
        return None
    article, chrome = _names(attributes)
    if chrome:
        return _Element(_WEAK, words=frozenset(chrome))
    if article and tag in ("div", "section", "td"):
        return _Element(_ARTICLE, 1)
    return None


def _place(chain: list[_Element]) -> tuple[int, int, bool]:
    """Zone of a block under these elements, how sure its article is, and whether wrappers named like lists of other texts hold it.

    The zone is ``_WEAK`` where an article element stands inside chrome-named wrappers or a form: the page decides.
    """
    if any(e.kind == _CHROME for e in chain):
        return _CHROME, 0, False
    weak = [i for i, e in enumerate(chain) if e.kind in (_WEAK, _FORM)]
    if not weak:
        rank = max((e.rank for e in chain), default=0)
        return (_ARTICLE if rank else _LEAVE), rank, False
    inner = chain[weak[-1] + 1:]
    rank = max((e.rank for e in inner), default=0)
    if rank < 2 or any(e.rank == 3 for e in chain[:weak[-1]]):  # no article in the wrapper, or the wrapper is part of one
        return _CHROME, 0, False
    wrappers = frozenset().union(*(chain[i].words for i in weak))
    if any(e.words & {w.rstrip("s") for w in wrappers} for e in inner):  # <article class=comment> in a list of comments
        return _CHROME, 0, False
    return _WEAK, rank, bool(wrappers & OTHERS)


def _clear_holders(found: list[tuple[list[_Element], bool, str]]) -> None:
    """Elements under ambiguous chrome names that hold their article's body become plain ones."""
    held: dict[_Element, dict[_Element | None, int]] = {}
    for chain, heading, words in found:
        article = next((i for i, e in enumerate(chain) if e.kind == _ARTICLE), None)
        if heading or article is None or any(e.kind in (_CHROME, _FORM) for e in chain[article:]):
            continue
        weak = [e for e in chain[article:] if e.kind == _WEAK]
        if len(weak) > 1 or any(not e.words <= AMBIGUOUS for e in weak):
            continue
        sizes = held.setdefault(chain[article], {})
        holder = weak[0] if weak else None
        sizes[holder] = sizes.get(holder, 0) + len(words)
    for sizes in held.values():
        for holder, size in sizes.items():
            total = sum(sizes.values())
            if holder is not None and (size == total or size >= max(BODY, MOST * total)):
                holder.kind = _LEAVE


def blocks(page: str) -> list[tuple[int, str]]:
    """(zone, text) of the page's blocks in order; zone is article, chrome or open.

    Character references are decoded, white space becomes one blank, empty blocks go. Elements closed by an outer
    end tag or by the end of the page end there. ``article`` and ``main`` are articles whatever they are called. A name makes
    chrome of a container only, and not if the container holds the page's article: one outside such containers goes before, and
    for a list of comments, related texts or adverts any open text does. A form that holds page structure is no chrome. Inside an
    article a chrome-named container that holds its body (``MOST``, ``BODY``) is none either, if the name leaves that open (``AMBIGUOUS``).
    Containers named like an article count only if they hold more text than stands openly outside them.
    """
    found: list[tuple[list[_Element], bool, str]] = []
    text: list[str] = []
    stack: list[tuple[str, _Element | None]] = []
    marked = False

    def flush() -> None:
        words = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if words:
            found.append(([e for _, e in stack if e is not None], any(t in HEADINGS for t, _ in stack), words))

    at = 0
    for m in _TAG.finditer(page):
        text.append(page[at:m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if m[1] or not tag:
            if not m[1]:
                continue
            text.append(" ")
        elif m[2]:
            if tag in BLOCKS:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
                if tag not in BLOCKS and stack[i][0] in BLOCKS:
                    break
        else:
            if tag in BLOCKS:
                flush()
            elif tag == "br":
                text.append(" ")
            if tag == "p" and stack and stack[-1][0] == "p":
                stack.pop()
            if tag not in VOID and not m[4].endswith("/"):
                element = _element(tag, m[4])
                article = element is not None and element.kind == _ARTICLE
                marked = marked or (article and element.rank > 1)
                if (tag in _PAGE_TAGS or article) and not any(e is not None and e.rank for _, e in stack):
                    for _, e in stack:
                        if e is not None and e.kind == _FORM:
                            e.kind = _LEAVE
                stack.append((tag, element))
    text.append(page[at:])
    flush()
    _clear_holders(found)
    placed = [(*_place(chain), words) for chain, _, words in found]
    best = max((rank for zone, rank, _, _ in placed if zone == _ARTICLE), default=0)
    inside = sum(len(words) for zone, _, _, words in placed if zone == _ARTICLE)
    outside = sum(len(words) for zone, _, _, words in placed if zone == _LEAVE)
    minor = best == 1 and inside <= outside
    is_open = any(zone == _LEAVE for zone, _, _, _ in placed)
    out = []
    for zone, rank, others, words in placed:
        if zone == _WEAK:
            zone = _ARTICLE if rank > best and not (others and (best or is_open)) else _CHROME
        elif zone == _ARTICLE and rank == 1 and (marked or minor):  # a container named like an article counts only where no element says so
            zone = _LEAVE
        out.append((zone, words))
    return out


def parse(page: str | None) -> tuple[list[str], list[str], list[bool], bool]:
    """Article blocks; the other blocks, which of them are open, and whether the page has an article."""
    found = blocks(page or "")
    article = [w for z, w in found if z == _ARTICLE]
    rest = [(z, w) for z, w in found if z != _ARTICLE]
    return article, [w for _, w in rest], [z == _LEAVE for z, _ in rest], bool(article)


def suffix_ranks(tokens: np.ndarray, page: np.ndarray, run: int) -> np.ndarray:
    """Rank of each suffix by its first ``run`` tokens (prefix doubling); -1 where the page ends before."""
    rank, width = np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
    n = len(tokens)
    while width < run:
        step = min(width, run - width)
        pair = rank[:n - step] * (n + 1) + rank[step:]
        rank = np.full(n, -1, dtype=np.int64)
        if len(pair):
            rank[:n - step] = np.unique(pair, return_inverse=True)[1]
        width += step
    whole = np.zeros(n, dtype=bool)
    if n >= run:
        whole[:n - run + 1] = page[:n - run + 1] == page[run - 1:]
    return np.where(whole, rank, -1)


def _streams(batch: pa.RecordBatch, page_html: int):
    """Token streams of a batch: two hashes of each token, the pages' first tokens, which pages are open, their blocks' sizes and zones."""
    texts, sizes, zones, is_open = [], [], [], []
    for h in batch.column(page_html).to_pylist():
        _, rest, flags, article = parse(h)
        texts.append(" ".join(rest))
        sizes.append([b.count(" ") + 1 for b in rest])
        zones.append(flags)
        is_open.append(not article and any(flags))
    column = pa.array(texts, pa.string())
    for i, j, data, offsets in tk.batches(column):
        s, e, first = tk.word_spans(data, offsets, _WORDS)
        yield i, j, tk.word_hashes(data, s, e), tk.word_hashes(data, s, e, 1), first, is_open[i:j], sizes[i:j], zones[i:j]


def repeats(pages: DataFrame, run: int, share: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Repeated pieces (host, w1, w2), and pieces of open pages (page, host, w1, w2, at, size).

    A piece is a run of ``run`` tokens on two pages; with ``share``, on two texts, or a block on that share of the host's texts.
    ``pages`` has ``page`` (key), ``host`` and ``html``.
    """
    kinds = "host long, w1 long, w2 long, lo long, hi long, at int, size int"

    def sort(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            keys, hosts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, j, w1, w2, first, is_open, sizes, zones in _streams(batch, 2):
                of = np.repeat(np.arange(j - i), np.diff(first))
                counted = keys[i:j]
                if share is not None and len(of):
                    counted = tk.signed(tk.span_hashes(w1, first[:-1], first[1:], 0))
                    yield from _blocks(keys[i:j], hosts[i:j], counted, w1, w2, first, is_open, sizes, zones)
                host = hosts[i + of]
                order = np.argsort(host, kind="stable")  # the streams of one host stand together
                tokens = (w1 ^ tk.mix(host.view(np.uint64).copy()))[order]
                place = np.arange(len(of)) - first[of]
                of_sorted = of[order]
                rank = suffix_ranks(tokens, of_sorted, run)
                live = np.flatnonzero(rank >= 0)
                suffixes = live[np.argsort(rank[live], kind="stable")]  # the suffix array to depth ``run``
                if not len(suffixes):
                    continue
                head = np.flatnonzero(np.concatenate([[True], np.diff(rank[suffixes]) > 0]))
                page, unit = keys[i + of_sorted[suffixes]], counted[of_sorted[suffixes]]
                begin = order[suffixes[head]]
                f1, f2 = (tk.signed(tk.span_hashes(w, begin, begin + run, k)) for k, w in ((0, w1), (1, w2)))
                yield _rows(host[begin], f1, f2, np.minimum.reduceat(unit, head), np.maximum.reduceat(unit, head), None, None)
                wanted = np.array(is_open)[of_sorted[suffixes]]
                if wanted.any():
                    here = order[suffixes[wanted]]
                    f1, f2 = (tk.signed(tk.span_hashes(w, here, here + run, k)) for k, w in ((0, w1), (1, w2)))
                    yield _rows(host[here], f1, f2, page[wanted], page[wanted], place[here], np.full(len(here), run))

    found = kit.materialize(pages.select("page", "host", "html").mapInArrow(sort, kinds), "html-runs")
    runs = found.where("at is null").groupBy("host", "w1", "w2").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi")
    wanted = found.where("at >= 0").select(F.col("lo").alias("page"), "host", "w1", "w2", "at", "size")
    pieces = runs.select("host", "w1", "w2")
    if share is not None:
        # a block's rows have at -1 and its text in lo; each text has one row with w1 and w2 null
        seen = found.where("at = -1").select("host", "w1", "w2", "lo").distinct().groupBy("host", "w1", "w2").agg(F.count(F.lit(1)).alias("n"))
        texts = seen.where("w1 is null").select("host", F.col("n").alias("texts"))
        common = seen.where("w1 is not null").join(texts, "host").where(F.col("n") >= F.greatest(F.lit(TEXTS), F.ceil(share * F.col("texts"))))
        pieces = pieces.unionByName(common.select("host", "w1", "w2"))
    return pieces, wanted


def _blocks(keys, hosts, texts, w1, w2, first, is_open, sizes, zones) -> Iterator[pa.RecordBatch]:
    """Each text of a slice and its blocks, once for the counts; of open pages also the open blocks with their place."""
    full = np.flatnonzero(np.diff(first))
    none = pa.nulls(len(full), pa.int64())
    yield _rows(hosts[full], none, none, texts[full], texts[full], np.full(len(full), -1), None)
    size = np.array([n for page in sizes for n in page], dtype=np.int64)
    if not len(size):
        return
    of = np.repeat(np.arange(len(sizes)), [len(page) for page in sizes])
    end = np.cumsum(size)  # blocks follow one another without gaps
    f1, f2 = (tk.signed(tk.span_hashes(w, end - size, end, k)) for k, w in ((0, w1), (1, w2)))
    yield _rows(hosts[of], f1, f2, texts[of], texts[of], np.full(len(of), -1), None)
    here = np.flatnonzero(np.array([z for page in zones for z in page]) & np.array(is_open)[of])
    if len(here):
        page = keys[of[here]]
        yield _rows(hosts[of[here]], f1[here], f2[here], page, page, (end - size)[here] - first[of[here]], size[here])


def _rows(host, f1, f2, lo, hi, at, size) -> pa.RecordBatch:
    ints = [pa.nulls(len(host), pa.int32()) if x is None else pa.array(x, pa.int32()) for x in (at, size)]
    return pa.RecordBatch.from_arrays([*map(_column, (host, f1, f2, lo, hi)), *ints], names=["host", "w1", "w2", "lo", "hi", "at", "size"])


def _column(values) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values)


def _unique_runs(rest: list[str], flags: list[bool], cut: list[dict] | None) -> list[str]:
    """Open blocks without the tokens of repeated pieces; what is left of each, if anything."""
    words = [b.split(" ") for b in rest]
    drop = np.zeros(sum(map(len, words)) + 1, dtype=np.int32)
    for piece in cut or ():
        drop[piece["at"]] += 1
        drop[min(len(drop) - 1, piece["at"] + piece["size"])] -= 1
    gone = np.cumsum(drop) > 0
    out, at = [], 0
    for block, is_open in zip(words, flags):
        if is_open and (left := [w for k, w in enumerate(block) if not gone[at + k]]):
            out.append(" ".join(left))
        at += len(block)
    return out


def _texts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts:
        texts = []
        cuts = batch.column(3).to_pylist() if batch.num_columns > 3 else [None] * batch.num_rows
        for page, cut in zip(batch.column(2).to_pylist(), cuts):
            article, rest, flags, has = parse(page)
            texts.append("\n\n".join(article if has else _unique_runs(rest, flags, cut)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(df: DataFrame, page: str = "page_id", url: str = "url", page_html: str = "html", run: int = RUN, share: float | None = None) -> DataFrame:
    """(page_id, url, text) of every row of ``df``.

    Null and empty pages give empty texts; a null or unparsable url belongs to the host ''. Pages are distinct if their
    id or url differ; rows alike in both are one page to the repeat search and are all returned. With ``share``, texts are
    counted instead of pages, and whole blocks on that share of a host's texts go too.
    """
    pages = df.select(F.col(page).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page_html).cast("string").alias("html"),
                      F.xxhash64(page, url).alias("page"), F.xxhash64(F.lower(F.coalesce(F.regexp_extract(url, _HOST, 1), F.lit("")))).alias("host"))
    pieces, wanted = repeats(pages, run, share)
    covers = kit.materialize(wanted.join(pieces, ["host", "w1", "w2"]).groupBy("page").agg(F.collect_set(F.struct("at", "size")).alias("cut")), "html-covers")
    flags = df.sparkSession.sparkContext.broadcast(bitset.build(covers, "page"))

    def side(marked: bool):
        def choose(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in parts:
                ok = bitset.test(flags.value, batch.column(0).to_numpy()) == marked
                yield batch.filter(pa.array(ok))

        return choose

    slim = pages.select("page", "page_id", "url", "html")
    plain = slim.mapInArrow(side(False), slim.schema).select("page_id", "url", "html")
    cut = slim.mapInArrow(side(True), slim.schema).join(covers, "page", "left").select("page_id", "url", "html", "cut")
    out = "page_id long, url string, text string"
    return plain.mapInArrow(_texts, out).unionByName(cut.mapInArrow(_texts, out))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(kit.table(spark, sf_dir, "pages"), run=LONG, share=SHARE).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op2_html_extraction": op2_html_extraction}
ORACLES = {"op2_html_extraction": r"""
with a as (select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) as body from pages),
b as (select page_id, url, list_transform(string_split_regex(body, '</?(p|h1)>'), lambda x: trim(regexp_replace(
        replace(replace(regexp_replace(regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g'), '&quot;?', '"', 'g'), '&amp;', '&'), '&amp', '&'),
        '\s+', ' ', 'g'))) as blocks from a),
t as (select page_id, url, array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10) || chr(10)) as text from b)
select page_id, url, text, length(text) as n_chars from t
"""}
