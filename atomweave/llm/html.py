"""Main text of web pages: structure first, then runs that repeat across pages of a host.

Method (host suffix array): the pages' blocks outside menus, headers, footers and the like are token streams. Every
suffix of a stream is keyed by its host and first ``RUN`` tokens; suffixes of distinct pages that share a key are
repeats, and maximal stretches that they cover are boilerplate. Suffixes are grouped by key instead of kept in one
sorted array, which puts the same neighbours together without one task per host. All pages take part, those that mark their article or
main part too: without a mark, what repeats is cut; of a marked article its own headings and paragraphs stay whole, and
a box inside it (a list, table, section or the like) goes if it is nothing but repeats.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atomweave.llm import sketch
from atomweave.llm.text import encoded, slices
from atomweave.session import cut

RUN = 8
#: A run is boilerplate if it occurs in this many distinct pages of its host.
PAGES = 3
#: Flags by which runs of pages that can lose nothing are looked at.
ASKED_BITS = 20

# Element names by role.
DROPPED = frozenset("script style noscript template svg math iframe object embed canvas audio video map head title nav header footer aside form button select option textarea input dialog menu".split())
RAW = frozenset("script style textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset(("article", "main"))
#: Class names, ids and roles that tell what an element is for; each is compared whole.
UNWANTED = frozenset(
    "ad ads advert adverts advertisement advertising ad-slot adslot adsense banner breadcrumb breadcrumbs byline-links comment comments comment-list comment-section comments-section commentlist respond replies consent "
    "cookie cookies cookie-banner cookie-consent cookie-notice disqus disqus_thread dropdown dropdown-menu footer site-footer page-footer gdpr masthead menu main-menu modal nav navbar nav-bar navigation newsletter newsletter-signup notice notices "
    "overlay pagination pager popup promo promos promotion related related-posts related-articles recommended recommendations share sharing share-buttons sidebar side-bar skip skip-link social social-links social-share sponsor sponsored "
    "subscribe subscription toolbar widget widgets contentinfo complementary search search-form alert alertdialog signup sign-up".split()
)
HEADERS = frozenset("header site-header page-header".split())
#: Elements that are boxes inside an article; what such a box holds itself, without boxes in it, is judged together.
BOXES = frozenset("address article details div dl figure main ol section table ul".split())
_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*+)((?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+|=)*+)(?:>|\Z)""", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?+""", re.S)
_SPACE = re.compile(r"\s+")
#: Opening one of these closes an open paragraph or item of the same kind.
_CLOSES = {"p": "p", "li": "li", "dt": "dd", "dd": "dt", "tr": "tr", "td": "td", "th": "th", "option": "option"}


def blocks(page: str) -> list[tuple[bool, str]]:
    """``(in the article, text)`` of each block of a page that its structure doesn't rule out, in page order."""
    return [(inside, text) for inside, _, text in boxed_blocks(page)]


def boxed_blocks(page: str) -> list[tuple[bool, int, str]]:
    """``blocks`` with the number of the innermost box inside the article that holds each; 0 for what the article holds itself."""
    out: list[tuple[bool, int, str]] = []
    stack: list[tuple[str, bool, bool, int]] = []  # name, dropped, inside an article, box
    boxes = box = 0
    now: list[str] = []
    open_: Counter[str] = Counter()  # open elements by name: an end tag without one is not looked for
    dropped = inside = False

    def end() -> None:
        text = _SPACE.sub(" ", entities.unescape("".join(now))).strip()
        now.clear()
        if text:
            out.append((inside, box, text))

    at = 0
    while at < len(page):
        m = _TAG.search(page, at)
        stop = m.start() if m else len(page)
        if stop > at and not dropped:
            now.append(page[at:stop])
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if name in BLOCKS or name in DROPPED:
            end()
        if m[1]:
            while open_[name]:
                last = stack.pop()[0]
                open_[last] -= 1
                if last == name:
                    break
        else:
            attributes: dict[str, str] = {}
            for k, v in _ATTRIBUTE.findall(m[3]):
                attributes.setdefault(k.lower(), v[1:-1] if v[:1] in ("'", '"') and v[-1:] == v[:1] and len(v) > 1 else v)
            bad = name in DROPPED or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true"
            if name == "header" and inside:  # an article's own heading
                bad = False
            if not bad and attributes and name not in ("html", "body", "article", "main"):
                marks = {w for k in ("class", "id", "role") for w in attributes.get(k, "").lower().split()}
                bad = bool(marks & UNWANTED) or not inside and bool(marks & HEADERS)
            if name in RAW:
                close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                if not dropped and not bad and name == "textarea":
                    now.append(page[at : close.start() if close else len(page)])
                at = close.end() if close else len(page)
                continue
            if name in _CLOSES and stack and stack[-1][0] in (name, _CLOSES[name]):
                open_[stack.pop()[0]] -= 1
            if name not in VOID and not (m[3].endswith("/") and name not in BLOCKS):
                open_[name] += 1
                if inside and name in BOXES:
                    boxes += 1
                stack.append((name, bad or (bool(stack) and stack[-1][1]), name in CONTAINERS or inside, boxes if inside and name in BOXES else box))
        dropped, inside, box = stack[-1][1:] if stack else (False, False, 0)
    end()
    return out


def host_of(url: str | None) -> str:
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", url or "")
    return (m[1].rpartition("@")[2].lower() if m else "")


def _streams(text: bytes | None) -> tuple[list[str], bool, list[int]]:
    """A page's blocks to choose from, whether they are its marked article, and of those in boxes the box, first token and end, in turn."""
    found = boxed_blocks((text or b"").decode())
    if not any(inside for inside, _, _ in found):
        return [t for _, _, t in found], False, []
    texts, spans, at = [], [], 0
    for inside, box, t in found:
        if inside:
            end = at + t.count(" ") + 1
            texts.append(t)
            spans += [box, at, end] if box else []
            at = end
    return texts, True, spans


def _keys(host: str, tokens: list[str]) -> list[int]:
    return [xxhash.xxh3_64_intdigest(host + "\n" + " ".join(tokens[i : i + RUN])) - 2**63 for i in range(len(tokens) - RUN + 1)]


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = encoded(batch.column(2))
        for a, b in slices(texts):
            found = [_streams(t) for t in texts[a:b]]
            names = [xxhash.xxh3_64_intdigest(t) - 2**63 for t in texts[a:b]]
            yield pa.record_batch(
                [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([m for _, m, _ in found], pa.bool_()), pa.array([x for _, _, x in found], pa.list_(pa.int32())), pa.array(names, pa.int64()), pa.array([" ".join(p) for p, _, _ in found], pa.string())],
                names=["page_id", "url", "marked", "boxes", "page", "text"],
            )


def _suffixes(asked=None):
    """Each page's distinct runs; of pages that can lose none only those in ``asked``, flags by hash."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, pages, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), encoded(batch.column(2))
            for a, b in slices(texts):
                keys, marks = [], []
                for i in range(a, b):
                    own = np.array(sorted(set(_keys(host_of(urls[i]), texts[i].decode().split(" ")))), np.int64)
                    if asked is not None:
                        own = own[asked.value[sketch.bucket(own, ASKED_BITS)]]
                    keys.append(own)
                    marks.append(np.full(len(own), pages[i]))
                yield pa.record_batch([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (keys, marks)], names=["run", "page"])

    return kernel


def _without_boxes(keep: list[bool], boxes: list[int]) -> list[bool]:
    """Which tokens of an article stay: all but those of the boxes whose every token is part of a repeat."""
    spans: dict[int, list[tuple[int, int]]] = {}
    for box, start, end in zip(boxes[::3], boxes[1::3], boxes[2::3]):
        spans.setdefault(box, []).append((start, end))
    out = [True] * len(keep)
    for own in spans.values():
        if not any(any(keep[a:b]) for a, b in own):
            for a, b in own:
                out[a:b] = [False] * (b - a)
    return out


def _without_repeats(repeated):
    """Texts without the runs in ``repeated``, a set sent to all tasks, or else in the last column of each row; of marked pages, without the boxes that those fill."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, texts = batch.column(1).to_pylist(), encoded(batch.column(2))
            marked, boxes = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            own = batch.column(5).to_pylist() if repeated is None else None
            for a, b in slices(texts):
                found = []
                for i in range(a, b):
                    tokens = texts[i].decode().split(" ")
                    known = repeated.value if repeated is not None else set(own[i] or ())
                    keep = [True] * len(tokens)
                    for j, key in enumerate(_keys(host_of(urls[i]), tokens) if known else ()):
                        if key in known:
                            keep[j : j + RUN] = [False] * RUN
                    if marked[i]:
                        keep = _without_boxes(keep, boxes[i])
                    found.append(" ".join(t for t, k in zip(tokens, keep) if k))
                yield pa.record_batch([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(found, pa.string())], names=["page_id", "url", "text"])

    return kernel


def extract_main_text(pages: DataFrame, most_sent: int = 500_000) -> DataFrame:
    """Main text of ``pages(page_id, url, html)``: ``page_id, url, text, n_chars``, one row per input row.

    Character references are decoded, white space within a block becomes one space, blocks are joined by one space in
    page order. Null or empty html gives an empty text; a null url has the empty host. Identical pages count once when
    repeats are counted, so copies of a page don't erase each other. Repeats count over all pages of a host; a box with fewer
    tokens than a run goes only where runs reach over it. Each page is parsed once, whole. Repeated rows are
    judged alike; other columns are ignored; an empty table gives an empty result.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    schema = "page_id long, url string, text string"
    parsed = cut(pages.mapInArrow(_parsed, "page_id long, url string, marked boolean, boxes array<int>, page long, text string"), "parsed")
    whole, judged = parsed.where("marked AND size(boxes) = 0"), parsed.where("NOT marked OR size(boxes) > 0")
    runs = "run long, page long"
    some = judged.select("url", "page", "text").mapInArrow(_suffixes(), runs)
    # pages that can lose nothing count too: their runs that a judged page can have, others decide nothing
    asked = sketch.id_table(some.select("run"), ASKED_BITS)
    if not asked.any():
        return parsed.select("page_id", "url", "text").withColumn("n_chars", F.length("text").cast("long"))
    flags = pages.sparkSession.sparkContext.broadcast(asked)
    suffixes = some.unionAll(whole.select("url", "page", "text").mapInArrow(_suffixes(flags), runs)).distinct()
    repeated = cut(suffixes.groupBy("run").count().where(F.col("count") >= PAGES).select("run"), "repeated")
    columns = ["page_id", "url", "text", "marked", "boxes"]
    if repeated.count() <= most_sent:  # 8 bytes each; more of them are joined instead
        sent = pages.sparkSession.sparkContext.broadcast({r[0] for r in repeated.collect()})
        left = judged.select(*columns).mapInArrow(_without_repeats(sent), schema)
    else:
        hits = suffixes.join(repeated, "run").groupBy("page").agg(F.collect_list("run").alias("runs"))
        left = judged.join(hits, "page", "left").select(*columns, "runs").mapInArrow(_without_repeats(None), schema)
    return whole.select("page_id", "url", "text").unionAll(left).withColumn("n_chars", F.length("text").cast("long"))
