"""Main-text extraction by a maximum-scoring subsequence of page tokens.

A page is a sequence of tokens: words, which score by the context they stand in (block tag, link or
not), and tags, which cost; a piece of page furniture is one costly tag.  The weights are log-odds learned from labelled
pages: pages whose markup names their content (``article``, ``main`` or the matching role), that
element itself being no feature.  Weights are counted over all such pages in Spark; the counts
have one row for each context and tag of a fixed list, whatever the pages hold.  The best
contiguous region is found by one linear scan (the running sum restarts where it falls below
zero).  Inside the region, furniture (menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles, comments) is left out, and the rest is the page's text, block by block.

Cases: a null or empty page has an empty text.  Broken markup is read as browsers do: an open
comment, script or tag runs to the end; unmatched end tags are ignored.  Pages without a word that
scores above zero have an empty text.  Without labelled pages fixed default weights are used.
Repeated rows give one row each; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspark.llm.common import batch_rows

BATCH_BYTES = 8 << 20

# fixed values: HTML elements by role
RAW = ("script", "style", "noscript", "template", "iframe", "svg", "annotation", "object", "textarea", "title", "select", "canvas", "audio", "video")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "math mi mn mo ms mrow msup msub msubsup mfrac msqrt mroot mtext mstyle mspace munder mover munderover semantics a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
BLOCK = ("p", "h", "li", "td", "pre", "blockquote", "div", "other")
FURNITURE_TAGS = frozenset("nav header footer aside form button menu dialog head fieldset".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog toolbar".split())
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu submenu breadcrumb breadcrumbs "
    "header masthead footer sidebar side rail aside widget widgets related recommended trending popular share sharing social follow newsletter subscribe subscription "
    "signup login cookie cookies consent gdpr notice notification alert popup modal overlay comment comments reply replies respond discussion disqus form search "
    "pager pagination pagenav toolbar copyright legal skip hidden".split())
# words that say what an element is, not what it is about: a furniture word with these alone names furniture
CONTAINER_WORDS = frozenset(
    "area bar block blocks body box button buttons card cards col column container content group icons inner item items left link links list "
    "main media mobile module outer page panel placeholder post posts right row section site slot small stories tag tags title top bottom unit wrap wrapper".split())
NAMED_INSIDE = frozenset("div section ul ol dl figure iframe center".split())
REPLY_WORDS = frozenset("comment comments reply replies".split())  # articles of readers
CONTENT_TAGS, CONTENT_ROLES = frozenset(("article", "main")), frozenset(("main", "article"))
DEFAULT = {"text": 1.0, "link": -1.0, "tag": -0.5, "edge": -2.0}
WORD_RANGE, TAG_RANGE = (-4.0, 4.0), (-2.0, -0.1)

TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)"
    r"|<svg\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*/>"  # closed in its own tag
    r"|<(" + "|".join(RAW) + r")\b((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>(?:.*?</\1\s*[^>]*(?:>|\Z)|.*\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)|[^<]+|<", re.S | re.I)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
NAME_PART = re.compile(r"[a-z]+")
HEADING = re.compile(r"h[1-6]$")


def _block(tag: str) -> str:
    if HEADING.match(tag):
        return "h"
    return {"th": "td", "dd": "li", "dt": "li", "section": "div", "article": "div", "main": "div", "body": "div"}.get(tag, tag if tag in BLOCK else "other")


def _named(tag: str, content: bool, inside: bool, classes: str, ids: str) -> bool:
    """Whether class or id words call an element furniture.  Headings, paragraphs and inline elements never
    are; content elements only as a reader's reply.  Inside content only plain containers can be, by a
    class that holds nothing but furniture and container words (``share-bar``, not ``side-effects``); ids
    of sections, and of anything inside content, may come from a heading and say nothing."""
    if tag in ("html", "body", "p") or HEADING.match(tag) or tag in INLINE:
        return False
    if content:
        return not REPLY_WORDS.isdisjoint(classes.split())
    if inside:
        return tag in NAMED_INSIDE and any(_furniture_class(c) for c in classes.split())
    if tag == "section":
        return any(p in FURNITURE_WORDS for p in NAME_PART.findall(classes))
    return any(p in FURNITURE_WORDS for p in NAME_PART.findall(classes + " " + ids))


def _furniture_class(name: str) -> bool:
    parts = NAME_PART.findall(name)
    return not FURNITURE_WORDS.isdisjoint(parts) and all(p in FURNITURE_WORDS or p in CONTAINER_WORDS for p in parts)


def _marks(tag: str, attributes: str, inside: bool = False) -> tuple[bool, bool]:
    """Whether an element (``inside`` content or not) is page furniture, and whether its markup names it as
    content."""
    # an article's own header has its headline
    furniture, content = tag in FURNITURE_TAGS and not (inside and tag == "header"), tag in CONTENT_TAGS
    names = {"class": "", "id": ""}
    if attributes and len(attributes) > 3:
        for name, *values in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values).lower()
            if name == "role":
                furniture |= value in FURNITURE_ROLES
                content |= value in CONTENT_ROLES
            elif name in ("class", "id"):
                names[name] += " " + value
            elif name == "style":
                furniture |= "display:none" in value.replace(" ", "")
            elif name == "hidden" or value == "true":
                furniture = True
    return furniture or _named(tag, content, inside, names["class"], names["id"]), content


def tokens(page: str):
    """``(kind, context, text, kept, content)`` of a page in order.  ``kind`` is ``word`` (a run of text),
    ``tag`` (a block tag), or ``gap`` (a break inside a block); ``kept``: not furniture."""
    stack: list[tuple[str, bool, bool]] = []  # name, furniture, content of the open elements
    furniture = content = links = 0
    block = ["div"]
    for m in TOKEN.finditer(page):
        whole = m.group()
        if whole[0] != "<" or whole == "<":
            where = "furniture" if furniture else "link" if links else block[-1]
            yield "word", where, entities.unescape(whole), not furniture, content > 0
            continue
        if m[1] or not m[4]:
            if m[1] and not furniture:
                yield "tag", "raw", "", True, content > 0
            continue
        tag = m[4].lower()
        if tag in ("br", "hr"):
            yield "gap", "br", " ", not furniture, content > 0
        if tag in VOID:
            continue
        if not m[3]:
            if m[5].endswith("/") and tag not in INLINE:
                continue  # an element closed in its own tag
            if tag == "p" and stack and stack[-1][0] == "p":  # a new paragraph ends the open one
                stack.pop()
                block.pop()
            f, c = _marks(tag, m[5], content > 0)
            if tag not in INLINE:
                block.append(_block(tag))
            if not furniture and (f or tag not in INLINE):  # a piece of furniture is one token
                kind = "gap" if tag == "header" and not f else "tag"  # an article's header only breaks
                yield kind, "furniture" if f else _block(tag), " ", not f, content > 0
            stack.append((tag, f, c))
            furniture, content, links = furniture + f, content + c, links + (tag == "a")
            continue
        if tag not in INLINE:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
        else:  # an inline end tag does not close blocks
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag or stack[i][0] not in INLINE), None)
            depth = depth if depth is not None and stack[depth][0] == tag else None
        if depth is None:
            continue
        while len(stack) > depth:
            name, f, c = stack.pop()
            furniture, content, links = furniture - f, content - c, links - (name == "a")
            if name not in INLINE:
                block.pop()
        if tag not in INLINE and not furniture and not f:
            yield "gap" if tag == "header" else "tag", _block(tag), " ", True, content > 0


def count_contexts(page: str) -> Counter:
    """``(kind, context, in content)`` counts of a labelled page; nothing if it is not labelled."""
    seen: Counter = Counter()
    inside_any = False
    for kind, where, text, kept, content in tokens(page):
        inside = content and kept
        inside_any |= inside
        if kind == "word":
            n = len(text.split())
            if n and where != "furniture":
                seen["word", where, inside] += n
        elif kind == "tag":
            seen["tag", where, inside] += 1
    return seen if inside_any else Counter()


def learn(counts: dict) -> dict:
    """Weights from context counts: log-odds of being content, tags a little below zero at most."""
    weights = {}
    for kind in ("word", "tag"):
        for where in {w for k, w, _ in counts if k == kind}:
            odds = math.log((counts.get((kind, where, True), 0) + 0.5) / (counts.get((kind, where, False), 0) + 0.5))
            low, high = WORD_RANGE if kind == "word" else TAG_RANGE
            weights[kind, where] = min(max(odds, low), high)
    return weights


def weight(weights: dict, kind: str, where: str) -> float:
    if kind == "word" and where == "furniture":
        return 0.0  # never part of the text; its tag has the cost
    got = weights.get((kind, where))
    if got is not None:
        return got
    if kind == "word":
        return DEFAULT["link"] if where == "link" else DEFAULT["text"]
    return DEFAULT["edge"] if where in ("furniture", "raw") else DEFAULT["tag"]


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and one past the last token of the contiguous run with the largest sum (the first
    such run; empty if no score is above zero), by one scan."""
    best, at = 0.0, (0, 0)
    total, begin = 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += s
        if total > best:
            best, at = total, (begin, i + 1)
    return at


def main_text(page: str | None, weights: dict) -> str:
    """The main text of a page: the best region without furniture, white space run together."""
    seq = list(tokens(page or ""))
    scores = [weight(weights, k, w) * (len(t.split()) if k == "word" else k == "tag") for k, w, t, _, _ in seq]
    begin, end = best_region(scores)
    out = [t if k == "word" else " " for k, _, t, kept, _ in seq[begin:end] if kept or k != "word"]
    return " ".join("".join(out).split())


def _count(batches):
    total: Counter = Counter()
    for batch in batches:
        for part in batch_rows(batch, BATCH_BYTES, "html"):
            for page in part.column(0).to_pylist():
                if page:
                    total.update(count_contexts(page))
    rows = [(k, w, i, n) for (k, w, i), n in total.items()]
    yield pa.RecordBatch.from_pylist([dict(zip(("kind", "context", "inside", "n"), r, strict=True)) for r in rows],
                                     pa.schema([("kind", pa.string()), ("context", pa.string()), ("inside", pa.bool_()), ("n", pa.int64())]))


def fit(pages: DataFrame) -> dict:
    """Weights from all labelled pages of ``pages`` (``html``)."""
    counts = pages.select("html").mapInArrow(_count, "kind string, context string, inside boolean, n long")
    rows = counts.groupBy("kind", "context", "inside").agg(F.sum("n").alias("n")).collect()  # a row for each context of the fixed list
    return learn({(r.kind, r.context, r.inside): r.n for r in rows})


def extract(pages: DataFrame, weights: dict, key: str = "page_id") -> DataFrame:
    """``key``, ``url``, ``text`` and ``n_chars`` of every page."""

    def run(batches):
        for batch in batches:
            for part in batch_rows(batch, BATCH_BYTES, "html"):
                texts = [main_text(p, weights) for p in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["key", "url", "text", "n_chars"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(F.col(key).alias("key"), "url", "html").mapInArrow(run, f"key {kind}, url string, text string, n_chars long").withColumnRenamed("key", key)
