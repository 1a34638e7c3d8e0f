"""Main text of web pages: flat text blocks and a learned decision tree.

A page is cut into text blocks at block-level tags. A block is described by its
own word count and link density and those of its two neighbours, and by a few
marks of where it stands (in an article, in a menu or form, in an element
whose class or id as a whole names a notice, an advert or reader comments). A decision
tree, trained when the operator is called on the small labelled table
``LABELLED_PAGES``, says which blocks are the article.

Null and empty pages give an empty text, and so do pages without an article.
Broken markup is read as it comes: an end tag without its start is passed over,
an unclosed element ends with the one around it, a head without an end at the
first element that can't stand in it, and what stands in an article or a main
element is judged by the marks inside that element only.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, spare

_RAW = "script|style|noscript|template|textarea|select|button|svg|math|iframe|object|canvas|audio|video|title"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})\b[^>]*(?:/>|>.*?(?:</(?P=raw)\b[^>]*>|\Z))"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?/][^>]*>|<[a-zA-Z][^<>]*(?:>|\Z)", re.S | re.I)
_MAY_NAME = re.compile("class|id|role|aria-label", re.I)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_MAY_HIDE = re.compile("hidden|none", re.I)
_HIDING_STYLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")

BLOCK = set("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption "
            "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p "
            "pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
#: Elements that end when one of the same kind begins.
_SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"},
                 "tr": {"tr", "td", "th"}, "option": {"option"}}
#: A paragraph also ends where one of these begins.
_ENDS_P = BLOCK - {"br", "body", "html", "head"}
#: Elements that can stand in a head, and end tags that end one.
_IN_HEAD = {"html", "head", "title", "base", "basefont", "bgsound", "link", "meta", "script", "style", "noscript", "noframes",
            "template"}
_ENDS_HEAD = {"body", "html", "br"}
FRAME = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset", "search"}

#: Parts of class and id names, by what they mark.
ADVERT = set("ad ads adv advert adverts advertisement advertising adsense adbox adslot banner promo promotion promoted "
             "sponsor sponsored sponsors outbrain taboola".split())
NOTICE = set("cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe "
             "subscription signup paywall disclaimer legal copyright terms toast warning announcement".split())
ASIDE = set("sidebar side rail widget widgets related recommended recommendations share sharing social breadcrumb "
            "breadcrumbs pagination pager nav navbar navigation menu menus toolbar topbar footer foot masthead login search "
            "tags toc skip popular trending sitemap links".split())
COMMENT = set("comment comments commentlist disqus respond reply replies discussion feedback reviews guestbook".split())
ARTICLE = set("article articlebody post entry story content main maincontent body text".split())
#: Words that may stand beside these in a name: boxes, their places and their contents.
BESIDE = set("site page main top bottom left right inner outer wrapper wrap container box bar block section area list item items "
             "panel unit slot module group row col column in inline article articles post posts entry content body text story "
             "stories button buttons icon icons form thread user users reader readers title header head heading message "
             "primary secondary sticky fixed small large mobile desktop the this your for by more recent latest zone region "
             "light dark open active visible card cards feed js us me up".split())
_KNOWN = ADVERT | NOTICE | ASIDE | COMMENT | BESIDE
#: Elements that are text themselves, and those whose id is rather an anchor to jump to.
_TEXT = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"}
_ANCHORED = {"section", "li", "dt", "dd", "table", "tr", "td", "th", "figure", "span", "a", "b", "i", "em", "strong", "sup", "sub", "dfn", "cite"}
_STRONG = {"comment", "comments", "commentlist", "disqus", "respond", "guestbook"}


@dataclass
class Block:
    """A run of text between block-level tags, and where it stands."""

    text: str
    linked: int  # words inside links
    words: int
    heading: bool
    item: bool
    article: bool
    frame: bool
    advert: bool
    notice: bool
    aside: bool
    comment: bool


_MARKS = ("article", "frame", "advert", "notice", "aside", "comment")

#: Of these a header (by element or class) is a part, not a page's head.
_HEADED = {"article", "post", "entry", "story"}


def _hidden(rest: str) -> bool:
    """Whether a tag's attributes hide its element; the words in other values don't."""
    if not _MAY_HIDE.search(rest):
        return False
    for m in _ATTRIBUTE.finditer(rest):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if (name == "hidden" and value.lower() != "false" or name == "aria-hidden" and value.lower() == "true"
                or name == "style" and _HIDING_STYLE.search(value)):
            return True
    return False


def _names(tag: str, rest: str) -> Iterator[list[str]]:
    """The parts of every name in a tag's own attributes: each word of a class, the id,
    the role, the label. An id on a heading or paragraph is an anchor, not a name;
    on other elements of text only a word for reader comments is one."""
    if not _MAY_NAME.search(rest):
        return
    for m in _ATTRIBUTE.finditer(rest):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "role", "data-role"):
            for token in value.split():
                yield [p.lower() for p in _PART.findall(token)]
        elif name == "aria-label" and tag not in _TEXT:
            yield [p.lower() for p in _PART.findall(value)]
        elif name == "id" and tag not in _TEXT:
            parts = [p.lower() for p in _PART.findall(value)]
            if tag not in _ANCHORED or set(parts) & _STRONG:
                yield parts


def _named(parts: list[str], words: set[str]) -> bool:
    """Whether a name as a whole says one of ``words``: what stands beside it must be
    another such word, a word for a box or its place, or a number. ``side-bar``,
    ``ad-slot`` and ``comment-12`` are marks; ``side-effects`` isn't one."""
    return any(p in words for p in parts) and all(p in _KNOWN or p.isdigit() for p in parts)


def _marks(tag: str, rest: str) -> dict[str, bool]:
    names = list(_names(tag, rest)) if rest and tag not in ("html", "body") else []
    comment = any(_named(n, COMMENT) for n in names)
    head = tag == "header" or tag not in _TEXT and any(_named(n, {"header"}) and not set(n) & _HEADED for n in names)
    return {"article": tag in ("article", "main") or (any(p in ARTICLE for n in names for p in n) and not comment and not head),
            "frame": tag in FRAME or head, "head": head and tag not in FRAME, "advert": any(_named(n, ADVERT) for n in names),
            "notice": any(_named(n, NOTICE) for n in names) or _hidden(rest),
            "aside": any(_named(n, ASIDE) for n in names), "comment": comment}


def blocks(page: str) -> list[Block]:
    """The text blocks of a page, in page order; blocks without text are none."""
    out: list[Block] = []
    stack: list[tuple[str, dict[str, bool]]] = []
    here = dict.fromkeys(_MARKS, False)
    runs: list[tuple[str, bool]] = []
    in_link = in_head = False

    def close() -> None:
        text = " ".join("".join(t for t, _ in runs).split())
        if text and not in_head:
            linked = len("".join(t if of_link else " " for t, of_link in runs).split())
            tags = [t for t, _ in stack]
            out.append(Block(text, linked, len(text.split()), any(t in ("h1", "h2", "h3", "h4", "h5", "h6") for t in tags),
                             "li" in tags, **here))
        runs.clear()

    def settle() -> None:
        """Marks of the open elements; an article starts afresh."""
        for k in _MARKS:
            here[k] = False
        for tag, marks in stack:
            if tag in ("article", "main") and not here["comment"]:
                for k in _MARKS:
                    here[k] = False
            for k in _MARKS:
                if marks[k] and not (k == "frame" and marks["head"] and here["article"]):
                    here[k] = True

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            runs.append((html.unescape(page[at:m.start()]), in_link))
        at = m.end()
        tag = (m["tag"] or "").lower()
        if in_head:
            name = tag or (m["raw"] or "").lower()
            if tag == "body" and not m["end"]:
                close()
            if name and (name in _ENDS_HEAD if m["end"] else name not in _IN_HEAD):
                in_head = False
        if not tag:
            continue
        if tag == "a":
            in_link = not m["end"]
            continue
        if tag not in BLOCK:
            if tag in VOID or m["rest"].endswith("/"):
                continue
            if m["end"]:
                _pop(stack, tag, settle, close, inline=True)
            else:
                marks = _marks(tag, m["rest"])
                if any(marks[k] for k in _MARKS[1:] if k != "frame"):  # an inline element that names what it is
                    close()
                    stack.append((tag, marks))
                    settle()
            continue
        close()
        if tag == "head":
            in_head = not m["end"]
            continue
        if tag in VOID:
            continue
        if m["end"]:
            _pop(stack, tag, settle, close)
            continue
        if tag in _ENDS_P and stack and stack[-1][0] == "p":
            stack.pop()
        if tag in _SELF_CLOSING:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in _SELF_CLOSING[tag]:
                    del stack[i:]
                    break
                if stack[i][0] in ("ul", "ol", "dl", "table", "div", "section", "article", "td", "th", "li", "tr", "tbody"):
                    break
        if not m["rest"].endswith("/"):
            stack.append((tag, _marks(tag, m["rest"])))
            settle()
    if at < len(page):
        runs.append((html.unescape(page[at:]), in_link))
    in_head = False
    close()
    return out


def _pop(stack: list, tag: str, settle, close, inline: bool = False) -> None:
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] == tag:
            if inline:
                close()
            del stack[i:]
            settle()
            return


FEATURES = ["words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after",
            "heading", "item", "article", "frame", "advert", "notice", "aside", "comment"]


def describe(bs: list[Block]) -> np.ndarray:
    """One row of ``FEATURES`` for each block."""
    own = [(b.words, b.linked / b.words) for b in bs]
    rows = []
    for i, b in enumerate(bs):
        before = own[i - 1] if i else (0, 0.0)
        after = own[i + 1] if i + 1 < len(bs) else (0, 0.0)
        rows.append([*own[i], *before, *after, b.heading, b.item, b.article, b.frame, b.advert, b.notice, b.aside, b.comment])
    return np.array(rows, float).reshape(len(bs), len(FEATURES))


@dataclass
class Tree:
    """A binary tree: inner nodes test ``value <= threshold``, leaves answer."""

    feature: int = -1
    threshold: float = 0.0
    low: Tree | None = None
    high: Tree | None = None
    answer: bool = False

    def predict(self, row) -> bool:
        node = self
        while node.feature >= 0:
            node = node.low if row[node.feature] <= node.threshold else node.high
        return node.answer


def _impurity(y: np.ndarray) -> float:
    p = y.mean() if len(y) else 0.0
    return len(y) * 2 * p * (1 - p)


def train(x: np.ndarray, y: np.ndarray, depth: int = 12) -> Tree:
    """A tree by Gini impurity; equal splits go to the first feature and threshold."""
    answer = bool(2 * y.sum() > len(y))
    if depth == 0 or y.min() == y.max():
        return Tree(answer=answer)
    best, where = _impurity(y) - 1e-9, None
    for f in range(x.shape[1]):
        v = np.unique(x[:, f])
        for t in (v[1:] + v[:-1]) / 2:
            low = x[:, f] <= t
            cost = _impurity(y[low]) + _impurity(y[~low])
            if cost < best - 1e-9:
                best, where = cost, (f, float(t))
    if where is None:
        return Tree(answer=answer)
    low = x[:, where[0]] <= where[1]
    return Tree(*where, train(x[low], y[low], depth - 1), train(x[~low], y[~low], depth - 1))


def labelled_blocks() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (1: article) of the blocks of ``LABELLED_PAGES``."""
    from .html_labels import LABELLED_PAGES
    xs, ys = [], []
    for page, labels in LABELLED_PAGES:
        found = blocks(page)
        if len(found) != len(labels):
            raise ValueError(f"{len(found)} blocks, {len(labels)} labels: {page[:80]}")
        xs.append(describe(found))
        ys.append(np.array([c == "+" for c in labels], float))
    return np.concatenate(xs), np.concatenate(ys)


def main_text(page: str, tree: Tree) -> str:
    found = blocks(page)
    return "\n\n".join(b.text for b, row in zip(found, describe(found).tolist(), strict=True) if tree.predict(row))


def _extract(tree: Tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = batch.column(batch.num_columns - 1).to_pylist()
            texts = [main_text(p, tree) if p else "" for p in pages]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*batch.schema.names[:-1], "text", "n_chars"])
    return run


def extract(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (by default all but the markup) with ``text`` and
    ``n_chars``, which replace columns of these names. Whole pages are read;
    blocks are joined by two line ends."""
    prepare(pages.sparkSession)
    keep = [c for c in (pages.columns if keep is None else keep) if c not in (html_col, "text", "n_chars")]
    schema = T.StructType([pages.schema[c] for c in keep]
                          + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    tree = train(*labelled_blocks())
    return pages.select(*keep, F.col(html_col).alias(spare(pages, "_html"))).mapInArrow(_extract(tree), schema)
