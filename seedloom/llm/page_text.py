"""Main text of web pages by a tree-structured graphical model.

The elements of a page form a tree. Each has a label, content or not; features
of the element give the potential of its label, and each link to its parent
has a potential of both labels. Messages passed up and down the tree give the
exact marginal of every element; the text of those at one half or more is the
page's text. Weights are trained on labelled pages by the gradient of the
likelihood, which the same messages give.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seedloom.llm.common import fresh

# Elements of HTML by how they are read.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript template iframe svg select object canvas audio video".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var label".split()
)
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 header hgroup hr main menu nav ol p pre section table ul li dt dd".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_BOUNDS = frozenset("table td th caption button".split())
# An opening tag ends these, looked for up to those.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot", "caption"), ("table",)), "tbody": (("thead", "tbody", "tfoot", "caption"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "caption"), ("table",)),
}
_TAGS = (
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th figure figcaption blockquote pre "
    "nav header footer aside form fieldset button details summary address dialog menu a span"
).split()

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([A-Za-z][^\s/>]*)([^>]*)>",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([A-Za-z_:][-\w:.]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_TOKEN = re.compile(r"[a-z]+|[A-Z][a-z]*|[^\W\d_]+")
_NAMED = ("class", "id", "role")


class Page(NamedTuple):
    """Elements in page order: parent (-1 for the root), tag, class words; and pieces of text with their element.

    ``marks`` are labels of labelled pages: 1, 0, or -1 where an element has none of its own.
    """

    parent: list[int]
    tag: list[str]
    words: list[tuple[str, ...]]
    marks: list[int]
    owner: list[int]
    pieces: list[str]
    breaks: list[bool]
    linked: list[bool]


def _attributes(text: str) -> tuple[tuple[str, ...], int]:
    """Words of class, id and role (and "hidden"), and the mark of a labelled page."""
    words, mark = [], -1
    for m in _ATTRIBUTE.finditer(text):
        name, value = m.group(1).lower(), (m.group(2) or "").strip("\"'")
        if name in _NAMED:
            words += [w.lower() for w in _TOKEN.findall(value)]
        elif name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none", value)):
            words.append("hidden")
        elif name == "data-content":
            mark = int(value == "yes")
    return tuple(words), mark


def read_page(page: str | None) -> Page:
    """The elements of a page and its text; unclosed, misplaced and unknown tags are put up with.

    Comments, declarations, the head and what ``_RAW`` lists are no text. An
    inline element without class or id counts as part of the one around it.
    """
    page = page or ""
    out = Page([-1], ["html"], [()], [-1], [], [], [], [])
    stack: list[tuple[str, int, bool]] = [("html", 0, False)]  # tag, element, inside a link
    is_open = {"html": 1}
    fresh_block, in_head, at, end = True, False, 0, len(page)

    def add(text: str) -> None:
        nonlocal fresh_block
        if in_head or not text:
            return
        _, node, linked = stack[-1]
        if fresh_block and not text.strip():
            return
        out.owner.append(node)
        out.pieces.append(html.unescape(text) if "&" in text else text)
        out.breaks.append(fresh_block)
        out.linked.append(linked)
        fresh_block = False

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            is_open[stack.pop()[0]] -= 1

    def close(tags: Sequence[str], until: Sequence[str]) -> None:
        if not any(is_open.get(t) for t in tags):
            return
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth][0] in tags:
                pop_to(depth)
                return
            if stack[depth][0] in until:
                return

    last = page.rfind(">") + 1  # nothing behind it is a tag
    while at < end:
        m = _MARKUP.search(page, at, last) if at < last else None
        if m is None:
            add(page[at:] if "<!--" not in page[max(at, last) :] else page[at : page.index("<!--", max(at, last))])
            break
        add(page[at : m.start()])
        at = m.end()
        if m.group().startswith("<!--") and not m.group().endswith("-->"):
            break
        slash, tag, rest = (m.group(1), m.group(2), m.group(3)) if m.group(2) else m.group(4, 5, 6)
        if tag is None:
            continue
        tag = tag.lower()
        inline = tag in _INLINE
        if slash:
            if tag == "head":
                in_head = False
            elif tag == "p" and not is_open.get("p"):
                fresh_block = True
            elif tag in _HEADINGS:
                close(_HEADINGS, _BOUNDS)
            elif is_open.get(tag) and tag not in ("html", "body"):
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == tag:
                        pop_to(depth)
                        break
                    if inline and stack[depth][0] not in _INLINE:
                        break
            if not inline:
                fresh_block = True
            continue
        if tag in _RAW:
            stop = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in ("hr", "body", "html", "head") or tag in _VOID:
            if tag == "body":
                in_head = False
                if len(stack) == 1:
                    words, mark = _attributes(rest)
                    out.words[0] += words
                    out.marks[0] = mark if mark >= 0 else out.marks[0]
            in_head = in_head or tag == "head"
            fresh_block = fresh_block or tag == "hr"
            continue
        if tag in _CLOSES_P or tag in _ENDS:
            close(("p",), _BOUNDS)
        if tag in _ENDS:
            close(*_ENDS[tag])
        if tag in _HEADINGS and stack[-1][0] in _HEADINGS:
            pop_to(len(stack) - 1)
        words, mark = _attributes(rest) if rest and not rest.isspace() else ((), -1)
        node = stack[-1][1]
        if not inline or words or mark >= 0:
            in_head = False
            out.parent.append(node)
            out.tag.append(tag)
            out.words.append(words)
            out.marks.append(mark)
            node = len(out.tag) - 1
        stack.append((tag, node, stack[-1][2] or tag == "a"))
        is_open[tag] = is_open.get(tag, 0) + 1
        fresh_block = fresh_block or not inline
    return out


def joined_text(page: Page, kept: np.ndarray) -> str:
    """The text of the kept elements: one space for white space and between blocks."""
    parts, broken = [], False
    for owner, piece, breaks in zip(page.owner, page.pieces, page.breaks, strict=True):
        broken |= breaks
        if kept[owner]:
            parts.append(" " + piece if broken else piece)
            broken = False
        else:
            broken = True
    return " ".join("".join(parts).split())


# --- features ----------------------------------------------------------------


class Forest(NamedTuple):
    """Several pages as one forest: parents, the kind of each link, and the features of each element."""

    parent: np.ndarray
    levels: list[np.ndarray]
    kind: np.ndarray
    feature: np.ndarray
    owner: np.ndarray
    first: np.ndarray


# How a link behaves depends on the child.
_KINDS = {"p": 1, "li": 2, "ul": 2, "ol": 2, "nav": 3, "aside": 3, "footer": 3, "form": 3, "header": 3, "div": 4, "section": 4,
          "a": 5, "span": 5} | dict.fromkeys(_HEADINGS, 6)
N_KINDS = 7


def _subtree_sums(parent: np.ndarray, levels: list[np.ndarray], own: np.ndarray) -> np.ndarray:
    total = own.astype(np.float64)
    for nodes in reversed(levels[1:]):
        np.add.at(total, parent[nodes], total[nodes])
    return total


def _bucket(value: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(value + 1).astype(np.int64), 12)


def forest(pages: Sequence[Page], vocabulary: dict[str, int]) -> Forest:
    """Features are numbered: tags with and without class, buckets of measures, then words of class and id, own ones and those around."""
    first = np.cumsum([0] + [len(p.tag) for p in pages])
    n = int(first[-1])
    parent, depth = np.full(n, -1), np.zeros(n, np.int64)
    known = {t: i for i, t in enumerate(_TAGS)}
    tag, kind, named = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    own, linked, stops = np.zeros(n), np.zeros(n), np.zeros(n)
    word_owner, word = [], []
    for base, page in zip(first[:-1].tolist(), pages, strict=True):
        # The nearest element around with class words; its words tell of what is in it, too.
        around: list[int] = []
        for i, (up, t, words) in enumerate(zip(page.parent, page.tag, page.words, strict=True)):
            node = base + i
            if up >= 0:
                parent[node] = base + up
                depth[node] = depth[base + up] + 1
            tag[node], kind[node], named[node] = known.get(t, len(_TAGS)), _KINDS.get(t, 0), bool(words)
            around.append(-1 if up < 0 else up if page.words[up] else around[up])
            for w in set(words):
                k = vocabulary.get(w, vocabulary.get(w.rstrip("s")))
                if k is not None:
                    word_owner.append(node)
                    word.append(k)
            for w in set(page.words[around[-1]]) if around[-1] >= 0 else ():
                k = vocabulary.get(w, vocabulary.get(w.rstrip("s")))
                if k is not None:
                    word_owner.append(node)
                    word.append(len(vocabulary) + k)
        for node, piece, link in zip(page.owner, page.pieces, page.linked, strict=True):
            size = len(piece)
            own[base + node] += size
            linked[base + node] += size * link
            stops[base + node] += sum(map(piece.count, ".!?,;:。，"))
    order = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[order], np.arange(depth.max() + 2 if n else 1))
    levels = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    all_text, all_links, all_stops = (_subtree_sums(parent, levels, x) for x in (own, linked, stops))
    count = _subtree_sums(parent, levels, np.ones(n))
    root = np.repeat(first[:-1], np.diff(first))
    # Of the page's text; for what holds other elements only.
    share = np.where(count > 1, all_text / np.maximum(all_text[root], 1), 0)
    # Whether the page has an element for its main part, and who is in it.
    inside = np.isin(tag, [known["article"], known["main"]])
    whole = _subtree_sums(parent, levels, inside) > 0
    titled = _subtree_sums(parent, levels, tag == known["h1"]) > 0
    for nodes in levels[1:]:
        inside[nodes] |= inside[parent[nodes]]
    density = np.minimum((10 * all_links / np.maximum(all_text, 1)).astype(np.int64), 10)
    columns = [
        (2 * tag + named, 2 * (len(_TAGS) + 1)),
        (np.where(own > 0, 1 + _bucket(own), 0), 14),
        (np.where(all_text > 0, 1 + density, 0), 12),
        (_bucket(all_text), 13),
        (np.minimum((10 * share).astype(np.int64), 10), 11),
        (np.minimum((100 * all_stops / np.maximum(all_text, 1)).astype(np.int64), 6), 7),
        (np.minimum(_bucket(count), 8), 9),
        (np.minimum(depth, 8), 9),
        (np.where(whole[root], 1 + inside + (whole & ~inside), 0) * 2 + titled, 8),
    ]
    owner, feature, base = [], [], 0
    for values, size in columns:
        owner.append(np.arange(n))
        feature.append(values + base)
        base += size
    owner.append(np.asarray(word_owner, np.int64))
    feature.append(np.asarray(word, np.int64) + base)
    return Forest(parent, levels, kind, np.concatenate(feature), np.concatenate(owner), first)


_N_FIXED = 2 * (len(_TAGS) + 1) + 14 + 12 + 13 + 11 + 7 + 9 + 9 + 8


# --- the model ---------------------------------------------------------------


class Model(NamedTuple):
    """Weights of features for "content", log potentials ``[kind, parent, child]`` of links, and known words."""

    weights: np.ndarray
    links: np.ndarray
    vocabulary: dict[str, int]


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))


def marginals(trees: Forest, unary: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum-product over a forest: the probability of both labels for each node, and of both with the parent's.

    ``unary`` has the log potentials of both labels. One pass from the leaves
    up and one back down, a level of all trees at a time.
    """
    n = len(trees.parent)
    up, message = unary.copy(), np.zeros((n, 2))
    for nodes in reversed(trees.levels[1:]):
        message[nodes] = _lse(up[nodes][:, None, :] + links[trees.kind[nodes]], 2)
        np.add.at(up, trees.parent[nodes], message[nodes])
    belief = up.copy()
    pair = np.zeros((n, 2, 2))
    for nodes in trees.levels[1:]:
        # What the parent knows without this child.
        rest = belief[trees.parent[nodes]] - message[nodes]
        joint = rest[:, :, None] + links[trees.kind[nodes]] + up[nodes][:, None, :]
        pair[nodes] = np.exp(joint - _lse(joint.reshape(len(nodes), 4), 1)[:, None, None])
        belief[nodes] = up[nodes] + _lse(rest[:, :, None] + links[trees.kind[nodes]], 1)
    single = np.exp(belief - _lse(belief, 1)[:, None]) if n else belief
    return single, pair


def _unary(trees: Forest, weights: np.ndarray) -> np.ndarray:
    score = np.bincount(trees.owner, weights[trees.feature], len(trees.parent))
    return np.stack([np.zeros_like(score), score], axis=1)


def _labels(page: Page) -> np.ndarray:
    """Marks handed down; an element without text of its own goes with the larger part of its text."""
    n = len(page.tag)
    label = np.zeros(n, np.int64)
    for i in range(n):
        label[i] = page.marks[i] if page.marks[i] >= 0 else (label[page.parent[i]] if page.parent[i] >= 0 else 0)
    own, good = np.zeros(n), np.zeros(n)
    for node, piece in zip(page.owner, page.pieces, strict=True):
        own[node] += len(piece)
    good[:] = own * label
    whole = own.copy()
    for i in range(n - 1, 0, -1):
        whole[page.parent[i]] += whole[i]
        good[page.parent[i]] += good[i]
    return np.where(own > 0, label, (2 * good > whole).astype(np.int64))


def train(pages: Sequence[str], *, rounds: int = 100, rate: float = 0.15, ridge: float = 0.3) -> Model:
    """Fit to labelled pages, in which ``data-content="yes"`` or ``"no"`` marks elements and what is in them.

    All pages and their elements are held at once, so give a bounded number.
    """
    read = [read_page(p) for p in pages]
    words = sorted({w for p in read for ws in p.words for w in ws})
    vocabulary = {w: i for i, w in enumerate(words)}
    trees = forest(read, vocabulary)
    label = np.concatenate([_labels(p) for p in read])
    weights, links = np.zeros(_N_FIXED + 2 * len(words)), np.zeros((N_KINDS, 2, 2))
    child = np.flatnonzero(trees.parent >= 0)
    seen_links = np.zeros_like(links)
    np.add.at(seen_links, (trees.kind[child], label[trees.parent[child]], label[child]), 1.0)
    seen = np.bincount(trees.feature, label[trees.owner], len(weights))
    speed = [np.zeros_like(weights), np.zeros_like(links)]
    size = [np.zeros_like(weights), np.zeros_like(links)]
    for step in range(1, rounds + 1):
        single, pair = marginals(trees, _unary(trees, weights), links)
        grown = [seen - np.bincount(trees.feature, single[trees.owner, 1], len(weights)) - ridge * weights]
        expected = np.zeros_like(links)
        np.add.at(expected, trees.kind[child], pair[child])
        grown.append(seen_links - expected - ridge * links)
        for k, values in enumerate((weights, links)):
            speed[k] = 0.9 * speed[k] + 0.1 * grown[k]
            size[k] = 0.99 * size[k] + 0.01 * grown[k] ** 2
            values += rate * (speed[k] / (1 - 0.9**step)) / (np.sqrt(size[k] / (1 - 0.99**step)) + 1e-6)
    return Model(weights, links, vocabulary)


def texts(pages: Sequence[str | None], model: Model) -> list[str]:
    read = [read_page(p) for p in pages]
    trees = forest(read, model.vocabulary)
    single, _ = marginals(trees, _unary(trees, model.weights), model.links)
    kept = single[:, 1] >= 0.5
    return [joined_text(p, kept[a:b]) for p, a, b in zip(read, trees.first[:-1], trees.first[1:], strict=True)]


# Characters of pages that a task reads at once, unless one page has more.
_AT_ONCE = 1 << 20


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """Pages with ``text``, the main text of ``html``, and ``n_chars``, its code points.

    Null and empty pages have the empty text. Every row is looked at by itself,
    so repeated rows give repeated results; columns called ``text`` or
    ``n_chars`` are replaced, others stay as they are. Narrow: no shuffle.
    """

    @F.pandas_udf("text string, n_chars long")
    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found, start, size = [], 0, 0
            for stop, page in enumerate(batch, 1):
                size += len(page or "")
                if size >= _AT_ONCE or stop == len(batch):
                    found += texts(batch[start:stop].tolist(), model)
                    start, size = stop, 0
            yield pd.DataFrame({"text": found, "n_chars": [len(t) for t in found]})

    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("text", "n_chars")]
    name = fresh(pages, "__found")
    return pages.select(*kept, main_text(F.col("html")).alias(name)).select("*", f"{name}.*").drop(name)
