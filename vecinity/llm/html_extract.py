"""Main text of HTML pages by the maximum-scoring subsequence of words and tags.

A page is read as a sequence of blocks (text between block tags). Every word of a block scores the log-odds, learned from labelled pages, of standing in
main text, given the elements around the block (tags, words and four-letter runs of classes, ids and roles), the block's length, the share of its
words in links, its last character, and length and links of the blocks before and after; a block tag costs a little, as labelled pages have it. One
linear scan finds the contiguous region of highest score, and of its blocks those that score above zero are the text: an advert or comment box
inside the region stays out. Weights come from the pages of `html_layouts` (elements marked data-main hold main text) or from pages given to `fit`.

Blocks are joined by a line feed in page order; inside a block white space is one space and the ends are trimmed; character
references are decoded; scripts, styles, comments and markup are never text. Pages are read in time that grows with their length alone.

Defined results: null or empty html, and pages without a region above zero, give the empty text; unclosed and truncated markup is
read as far as it goes (a quote that never ends doesn't hold its tag open); very long pages are read whole; repeated rows give equal results; an
empty table gives an empty table; further columns pass through, except text and n_chars, which this operator makes.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from vecinity.llm import html_layouts
from vecinity.llm.common import fresh

#: Fixed values of HTML: elements without content, with raw content, those that aren't shown as text, and those that stand in lines.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "iframe", "noembed", "noframes", "textarea", "title"}
HIDDEN = {"noscript", "template", "svg", "math", "canvas", "object", "video", "audio", "select", "datalist"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: What an opening tag closes by itself, at most NEAR elements up.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NEAR = 32
OPEN = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
ATTRIBUTES = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|data-main)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
RUN = 4


def tags(html: str):
    """(text before, name, closing, attributes) of each tag in order, and at last the text that no tag follows (name None)."""
    at, begun, n = 0, 0, len(html)
    missing: set[str] = set()  # elements that are never closed any more
    broken = -1  # up to here quotes don't hold tags open, since one of them never ends
    while True:
        at = html.find("<", at)
        if at < 0 or at + 1 >= n:
            yield html[begun:], None, False, ""
            return
        follows = html[at + 1]
        if follows in "!?":
            end = html.find("-->", at + 4) + 3 if html.startswith("<!--", at) else html.find(">", at) + 1
            end = end if end >= (3 if html.startswith("<!--", at) else 1) and end > at else n
            yield html[begun:at], "!", False, ""
            at = begun = end
            continue
        m = OPEN.match(html, at)
        if not m:
            if follows == "/":  # a closing tag without a name is a comment
                end = html.find(">", at) + 1 or n
                yield html[begun:at], "!", False, ""
                at = begun = end
            else:
                at += 1
            continue
        name, closing = m[1].lower(), follows == "/"
        stop = ATTRIBUTES.match(html, m.end()).end() if at > broken else m.end()
        if stop < n and html[stop] != ">":
            if at > broken:
                broken = stop
            stop = html.find(">", m.end())
            stop = n if stop < 0 else stop
        attributes = html[m.end() : stop]
        text, at = html[begun:at], min(n, stop + 1)
        if name in RAW or name in HIDDEN:
            empty = name in ("svg", "math") and attributes.endswith("/")
            if not closing and not empty and name not in missing:
                close = _closing(name).search(html, at)
                if close:
                    end = html.find(">", close.end())
                    at = n if end < 0 else end + 1
                elif name in RAW:
                    at = n
                else:
                    missing.add(name)
            name = "!"
        yield text, name, closing, attributes
        begun = at


@functools.cache
def _closing(name: str):
    return re.compile(rf"</{name}(?![a-z0-9-])", re.I)


def named(attributes: str) -> tuple[set[str], bool]:
    """Features of an element's class, id and role, and whether it is marked as main text."""
    out, main = set(), False
    for kind, a, b, c in ATTRIBUTE.findall(attributes):
        if kind.lower() == "data-main":
            main = True
            continue
        for w in NAME.findall(a or b or c):
            w = w.lower()
            out.add("." + w)
            out.update("~" + w[k : k + RUN] for k in range(len(w) - RUN + 1) if len(w) > RUN)
    return out, main


class Block:
    """Text between block tags: its words in and out of links, the features of the elements around it, and the block tags since the block before."""

    __slots__ = ("around", "linked", "main", "size", "tags", "text")

    def __init__(self, text, linked, around, tags, main):
        self.text, self.around, self.tags, self.main = text, around, tags, main
        self.size = text.count(" ") + 1
        self.linked = linked


def blocks(html: str, known: frozenset | None = None):
    """The blocks of a page, in order; with known, features are cut to those."""
    stack: list[tuple[str, frozenset, bool]] = []
    opened: Counter = Counter()
    none = frozenset()
    text: list[str] = []
    linked, link, between = 0, 0, 0

    def close():
        nonlocal between, linked
        plain = " ".join("".join(text).split())
        text.clear()
        words, linked = linked, 0
        if not plain:
            return None
        item = Block(plain, words, stack[-1][1] if stack else none, between, bool(stack) and stack[-1][2])
        between = 0
        return item

    def drop(k: int):
        for name, _, _ in stack[k:]:
            opened[name] -= 1
        del stack[k:]

    for before, name, closing, attributes in tags(html):
        if before:
            before = unescape(before) if "&" in before else before
            text.append(before)
            if link:
                linked += len(before.split())
        if name is None:
            break
        if name == "!":
            continue
        if name in INLINE:
            if name == "br":
                text.append(" ")
            elif name == "a":
                link = 0 if closing else 1
            continue
        if item := close():
            yield item
        between += 1
        if closing:
            if opened[name] > 0:
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                drop(k)
            continue
        if stack and stack[-1][0] == "p":
            drop(len(stack) - 1)  # a block tag ends an open paragraph
        if any(opened[c] > 0 for c in CLOSES.get(name, ())):
            for k in range(len(stack) - 1, max(-1, len(stack) - 1 - NEAR), -1):
                if stack[k][0] in CLOSES[name]:
                    drop(k)
                    break
                if stack[k][0] in ("ul", "ol", "dl", "table", "select"):
                    break
        if name in VOID:
            continue
        own, main = named(attributes) if attributes else (set(), False)
        own.add(name)
        around, inside = (stack[-1][1], stack[-1][2]) if stack else (none, False)
        own = own if known is None else own & known
        stack.append((name, around if own <= around else around | own, main or inside))
        opened[name] += 1
    if item := close():
        yield item


def _length(b: Block) -> int:
    return 0 if b.size < 4 else 1 if b.size < 12 else 2 if b.size < 30 else 3


def _links(b: Block) -> int:
    share = b.linked / b.size
    return 0 if not b.linked else 1 if share < 0.34 else 2 if share < 0.8 else 3


def _own(items: list[Block], k: int) -> tuple[str, ...]:
    """Features of a block beside those of the elements around it."""
    b, out = items[k], []
    out.append(f"len{_length(b)}")
    out.append(f"links{_links(b)}")
    out.append(f"both{_length(b)}{_links(b)}")
    out.append("stop" if b.text[-1] in ".!?:;…\"'”»)" else "open")
    if len(items) == 1:
        out.append("alone")
    for name, j in (("before", k - 1), ("after", k + 1)):
        if 0 <= j < len(items):
            out.append(f"{name}{_length(items[j])}{_links(items[j])}")
    return tuple(out)


class Weights:
    """Log-odds of features, of a word anywhere, and the cost of a block tag."""

    def __init__(self, of: dict[str, float], prior: float, tag: float):
        self.of, self.prior, self.tag, self.known = of, prior, tag, frozenset(of)
        self.sums: dict[frozenset, float] = {}

    def word(self, around: frozenset, own: tuple[str, ...]) -> float:
        if (s := self.sums.get(around)) is None:
            if len(self.sums) > 100_000:
                self.sums.clear()
            s = self.sums[around] = self.prior + sum(self.of.get(f, 0.0) for f in around)
        return max(-1.0, min(1.0, s + sum(self.of.get(f, 0.0) for f in own)))


def fit(pages: list[str], rounds: int = 400, ridge: float = 1e-4) -> Weights:
    """Weights from pages in which elements marked data-main hold main text: logistic regression over blocks, each of the weight of log2 of its words."""
    names: dict[str, int] = {}
    cols, rows, y, weight, tag = [], [], [], [], [[0, 1], [0, 1]]
    for page in pages:
        items = list(blocks(page))
        for k, b in enumerate(items):
            side = tag[1 if b.main else 0]
            side[0] += b.tags
            side[1] += b.size
            for f in sorted(b.around - {"html", "body"}) + list(_own(items, k)):
                cols.append(names.setdefault(f, len(names)))
                rows.append(len(y))
            y.append(float(b.main))
            weight.append(np.log2(b.size + 1.0))
    cols, rows, y, weight = np.array(cols, np.int64), np.array(rows, np.int64), np.array(y), np.array(weight)
    weight /= max(weight.sum(), 1e-9)
    w, prior = np.zeros(len(names)), 0.0
    first, second = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for t in range(1, rounds + 1):
        x = prior + np.bincount(rows, w[cols], len(y))
        error = (1 / (1 + np.exp(-x)) - y) * weight
        step = np.append(np.bincount(cols, error[rows], len(names)) + ridge * w, error.sum())
        first, second = 0.9 * first + 0.1 * step, 0.99 * second + 0.01 * step**2
        move = 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        w, prior = w - move[:-1], prior - move[-1]
    # A tag costs what it says about a word: the log ratio of tags a word outside main text and inside.
    (outside, a), (inside, b) = tag
    cost = -min(1.0, max(0.05, 0.1 * float(np.log((outside + 1) / a / ((inside + 1) / b)))))
    return Weights({f: float(w[k]) for f, k in names.items() if abs(w[k]) > 1e-3}, float(prior), cost)


@functools.cache
def learned() -> Weights:
    """The weights of the layouts that come with this module."""
    return fit(html_layouts.pages())


def extract(html: str | None, weights: Weights | None = None) -> str:
    """The main text of a page."""
    if not html:
        return ""
    weights = weights or learned()
    items = list(blocks(html, weights.known))
    scores = [(weights.word(b.around, _own(items, k)) * b.size, weights.tag * b.tags) for k, b in enumerate(items)]
    best, found, run, start = 0.0, (0, 0), 0.0, 0
    for k, (own, cost) in enumerate(scores):
        if run + cost <= 0:
            run, start = 0.0, k
        else:
            run += cost
        run += own
        if run > best:
            best, found = run, (start, k + 1)
    return "\n".join(items[k].text for k in range(*found) if scores[k][0] > 0)


def extract_pages(pages: DataFrame, html: str = "html", weights: Weights | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns keep of pages (all by default), text string and n_chars long."""
    weights = weights or learned()
    keep = [c for c in (pages.columns if keep is None else keep) if c not in ("text", "n_chars")]
    source = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html}`").alias(*fresh([*keep, "text", "n_chars"], "whole_html")))

    def run(batches):
        for batch in batches:
            texts = [extract(x, weights) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    return source.mapInArrow(run, StructType([*source.schema.fields[:-1], StructField("text", StringType()), StructField("n_chars", LongType())]))
