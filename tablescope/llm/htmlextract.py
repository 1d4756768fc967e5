"""Main text of web pages by a tree-structured graphical model.

A page becomes a tree of its block elements; inline elements belong to the block around
them.  Every node has a hidden label, article or not, with a log-linear potential over its
features (tag, words in its class, id and role, length, link share, punctuation); every
parent and child have a 2 x 2 potential for each kind of child.  Sum-product messages go
up from the leaves and down from the root, for all pages of a batch level by level, and
give the exact marginals.  Blocks whose marginal is at least ``THRESHOLD`` make the text.

The weights maximise the likelihood of the labelled pages of ``htmlpages`` (the gradient is
observed minus expected features under the same messages), on the driver, once.

Text: character references decoded, white space inside a block one space, blocks trimmed
and joined in page order by one space.  Scripts, styles, templates, titles, form fields and
comments of the markup are never text; noscript, iframe, svg, object and media fallbacks are nodes
like others, math belongs to its sentence.  Elements left open end where HTML ends them or
with the page.  Behind an opening of a title, template, form field or comment that is never closed the page
goes on (behind one of a script or style nothing is text); a tag cut off by the end of the page is
dropped.  Reading a page takes time in proportion to its length, however it is nested or broken.

Defined results: a null or empty page has an empty text; a page without an article block
has an empty text; pages are read whole; equal rows give equal texts.
"""
from __future__ import annotations

import functools
import re
from dataclasses import dataclass
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tablescope.llm import htmlpages
from tablescope.session import ship_package

THRESHOLD = 0.5
TRAINING_COPIES = 12

#: fixed element classes of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style template title textarea select".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var big label".split()
                   + "math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mstyle semantics".split())
CLOSES_P = frozenset("address article aside blockquote body center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                     "header hgroup hr li main menu nav ol p pre search section summary table ul".split())
#: an opening tag ends open elements of these names, up to the named boundary
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

TAG_FEATURES = "article main section div p heading list item nav header footer aside form table quote pre figure button body other".split()
TAG_OF = {t: t for t in "article main section div p nav header footer aside form pre body".split()} | \
    {f"h{i}": "heading" for i in range(1, 7)} | {"ul": "list", "ol": "list", "dl": "list", "menu": "nav", "li": "item", "dt": "item", "dd": "item",
     "table": "table", "tr": "table", "td": "table", "th": "table", "tbody": "table", "thead": "table", "blockquote": "quote",
     "figure": "figure", "figcaption": "figure", "button": "button", "fieldset": "form", "legend": "form", "search": "form", "html": "body"}
#: fixed word lists for class, id and role
HINTS = {
    "content": "article articlebody content main post entry story body text prose markdown",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs tabs pagination pager toc sitemap topnav",
    "advert": "ad ads adv advert adverts advertisement sponsor sponsored promo promoted promotion banner adsense dfp",
    "sidebar": "sidebar aside rail widget widgets related recommended recommendations trending popular complementary more",
    "footer": "footer foot copyright legal colophon contentinfo credits",
    "header": "header masthead topbar logo branding site-title",
    "notice": "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription paywall alert alerts warning toast dialog",
    "comment": "comment comments commentlist reply replies respond discussion disqus responses reader forum reactions",
    "social": "share sharing social follow tags tagcloud author-bio byline meta metadata",
    "form": "form search searchbox login signup register contact",
    "hidden": "hidden invisible sr-only visually-hidden",
}
HINT_OF = {w: k for k, words in HINTS.items() for w in words.split()}
WORD_STEPS = (1, 5, 15, 40)
NAMES = ([f"tag {t}" for t in TAG_FEATURES] + [f"hint {h}" for h in HINTS] + [f"inside {h}" for h in HINTS] + [f"words {k}" for k in range(5)]
         + [f"links {k}" for k in range(3)] + [f"all words {k}" for k in range(5)] + [f"all links {k}" for k in range(3)] + ["ends a sentence", "bias"])
NUMBER = {n: i for i, n in enumerate(NAMES)}
#: an element nested deeper is a child of its ancestor at this depth, as in browsers
MAX_DEPTH = 512
#: kinds of children for the edge potentials
EDGE_KINDS = 3

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|data-label|style|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_SPLIT = re.compile(r"[^a-z0-9]+")


@dataclass
class Page:
    """Nodes in page order (parents before children) and text segments as (node, text)."""
    tags: list
    parents: list
    hints: list
    labels: list
    segments: list
    words: list
    linked: list


def parse(html: str) -> Page:
    page = Page(["body"], [-1], [frozenset()], [None], [], [0], [0])
    stack, names = [0], ["body"]
    places: dict[str, list[int]] = {}    # of each open name, where it stands in the stack
    unclosed: set[str] = set()           # names that are not closed any more on the rest of the page
    parts: list[str] = []
    link = 0
    at, n = 0, len(html)

    def deepest(some) -> int:
        return max((places[t][-1] for t in some if places.get(t)), default=0)

    def flush():
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                page.segments.append((stack[-1], text))
                page.words[stack[-1]] += text.count(" ") + 1

    def add(text: str):
        parts.append(text)
        if link:
            page.linked[stack[-1]] += len(text.split())

    def pop_to(k: int):
        nonlocal link
        flush()
        for t in names[k:]:
            places[t].pop()
        del stack[k:], names[k:]
        link = 0

    while at < n:
        less = html.find("<", at)
        if less < 0:
            less = n
        if less > at:
            add(unescape(html[at:less]))
        if less == n:
            break
        following = html[less + 1:less + 2]
        if html.startswith("<!--", less):
            end = -1 if "!--" in unclosed else html.find("-->", less + 4)
            at = less + 4 if end < 0 else end + 3
            if end < 0:
                unclosed.add("!--")
            continue
        if following in ("!", "?"):
            end = html.find(">", less)
            at = n if end < 0 else end + 1
            continue
        match = None
        if following == "/" or following.isalpha():
            match = _TAG.match(html, less) or _LOOSE_TAG.match(html, less)
            if match is None and (following.isalpha() or html[less + 2:less + 3].isalpha()):
                break  # a tag cut off by the end of the page
        if match is None:
            add("<")
            at = less + 1
            continue
        at = match.end()
        closing, tag, rest = match[1], match[2].lower(), match[3]
        if tag in INLINE:
            if tag == "a":
                link = 0 if closing else 1
            continue
        if closing:
            if places.get(tag):
                pop_to(places[tag][-1])
            continue
        if tag in SKIPPED:
            if not rest.endswith("/") and tag not in unclosed:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(html, at)
                if end is not None:
                    at = end.end()
                elif tag in ("script", "style"):
                    at = n
                else:
                    unclosed.add(tag)
            continue
        if tag in VOID:
            if tag in ("hr", "br"):
                parts.append(" ")
            continue
        if tag in ("html", "body", "head"):
            if tag == "body" and rest:
                page.labels[0] = _label(rest) or page.labels[0]
            continue
        if tag in CLOSES_P and deepest(("p",)) > deepest(("button", "td", "th", "table")):
            pop_to(places["p"][-1])
        if tag in ENDS:
            ended, boundary = ENDS[tag]
            if (last := deepest(ended)) > deepest(boundary):
                pop_to(last)
        flush()
        link = 0
        page.tags.append(tag)
        page.parents.append(stack[min(len(stack), MAX_DEPTH) - 1])
        hints, label = _attributes(rest) if rest else (frozenset(), None)
        page.hints.append(hints)
        page.labels.append(label)
        page.words.append(0)
        page.linked.append(0)
        places.setdefault(tag, []).append(len(stack))
        stack.append(len(page.tags) - 1)
        names.append(tag)
    flush()
    return page


def _label(rest: str):
    found = re.search(r'data-label="([+-])"', rest)
    return found and found[1]


def _attributes(rest: str):
    hints, label = set(), None
    for name, *values in _ATTRIBUTE.findall(rest):
        name, value = name.lower(), "".join(values)
        if name == "data-label":
            label = value
        elif name == "hidden":
            hints.add("hidden")
        elif name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
                hints.add("hidden")
        else:
            for whole in value.lower().split():
                for word in (whole, *_SPLIT.split(whole)):
                    if word in HINT_OF:
                        hints.add(HINT_OF[word])
    return frozenset(hints), label


@dataclass
class Forest:
    """The nodes of many pages: parents (-1 at roots), levels and a list of (node, feature) pairs."""
    parent: np.ndarray
    kind: np.ndarray
    levels: list
    node: np.ndarray
    feature: np.ndarray


def _step(values: np.ndarray, steps=WORD_STEPS) -> np.ndarray:
    return np.searchsorted(np.array(steps), values, side="right")


def _link_step(linked: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.array([0.25, 0.6]), linked / np.maximum(words, 1), side="right")


def forest(pages: list[Page]) -> Forest:
    sizes = [len(p.tags) for p in pages]
    base = np.cumsum([0, *sizes])
    parent = np.array([q + b if q >= 0 else -1 for p, b in zip(pages, base.tolist()) for q in p.parents], np.int64)
    words = np.array([w for p in pages for w in p.words], float)
    linked = np.array([w for p in pages for w in p.linked], float)
    depth = np.zeros(len(parent), np.int64)
    flat_parent = parent.tolist()
    deep = [0] * len(flat_parent)
    for i, q in enumerate(flat_parent):
        if q >= 0:
            deep[i] = deep[q] + 1
    depth = np.array(deep, np.int64)
    order = np.argsort(depth, kind="stable")
    bounds = np.searchsorted(depth[order], np.arange((depth.max() if len(depth) else 0) + 2))
    levels = [order[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    all_words, all_linked = words.copy(), linked.copy()
    for level in reversed(levels[1:]):
        np.add.at(all_words, parent[level], all_words[level])
        np.add.at(all_linked, parent[level], all_linked[level])
    node, feature = [], []
    i = 0
    ends = np.zeros(len(parent), bool)
    kind = np.zeros(len(parent), np.int64)
    above: list[frozenset] = []
    for p, b in zip(pages, base.tolist()):
        for tag, hints, q in zip(p.tags, p.hints, p.parents):
            name = TAG_OF.get(tag, "other")
            node.append(i)
            feature.append(NUMBER["tag " + name])
            outer = above[q + b] if q >= 0 else frozenset()
            for h in hints:
                node.append(i)
                feature.append(NUMBER["hint " + h])
            for h in outer:
                node.append(i)
                feature.append(NUMBER["inside " + h])
            above.append(outer | (hints - {"content"}) if hints else outer)
            kind[i] = 0 if name in ("p", "heading", "item", "quote", "pre") else 1 if not hints else 2
            i += 1
        for k, text in p.segments:
            if text[-1:] in ".!?:;\"')”…":
                ends[k + b] = True
    every = np.arange(len(parent))
    more = [(every, NUMBER["words 0"] + _step(words)), (every, NUMBER["links 0"] + _link_step(linked, words)),
            (every, NUMBER["all words 0"] + _step(all_words)), (every, NUMBER["all links 0"] + _link_step(all_linked, all_words)),
            (every[ends], np.full(ends.sum(), NUMBER["ends a sentence"])), (every, np.full(len(every), NUMBER["bias"]))]
    return Forest(parent, kind, levels, np.concatenate([np.array(node, np.int64), *(a for a, _ in more)]),
                  np.concatenate([np.array(feature, np.int64), *(b for _, b in more)]))


def marginals(f: Forest, weights: np.ndarray, edges: np.ndarray):
    """Sum-product on the trees: P(article) of every node, and the joint of every parent and child (n x 2 x 2)."""
    n = len(f.parent)
    unary = np.zeros((n, 2))
    np.add.at(unary[:, 1], f.node, weights[f.feature])
    up, message = unary.copy(), np.zeros((n, 2))
    for level in reversed(f.levels[1:]):  # leaves first: what a child tells its parent
        scores = up[level][:, None, :] + edges[f.kind[level]]
        message[level] = np.logaddexp(scores[:, :, 0], scores[:, :, 1])
        np.add.at(up, f.parent[level], message[level])
    belief = up.copy()
    joint = np.zeros((n, 2, 2))
    for level in f.levels[1:]:  # roots first: what the rest of the tree tells the child
        rest = belief[f.parent[level]] - message[level]
        scores = rest[:, :, None] + edges[f.kind[level]] + up[level][:, None, :]
        total = np.logaddexp(np.logaddexp(scores[:, 0, 0], scores[:, 0, 1]), np.logaddexp(scores[:, 1, 0], scores[:, 1, 1]))
        joint[level] = np.exp(scores - total[:, None, None])
        belief[level] = np.logaddexp(scores[:, 0, :], scores[:, 1, :])
    return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500))), joint


@functools.lru_cache(maxsize=4)
def train(copies: int = TRAINING_COPIES, rounds: int = 300, ridge: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """(feature weights, edge potentials) of the greatest penalised likelihood on the labelled pages."""
    labelled = [parse(p) for p in htmlpages.pages(copies)]
    f = forest(labelled)
    y = np.zeros(len(f.parent), np.int64)
    i = 0
    for p in labelled:
        for k, label in enumerate(p.labels):
            y[i] = (label == "+") if label else (y[i - k + p.parents[k]] if p.parents[k] >= 0 else 0)
            i += 1
    child = np.flatnonzero(f.parent >= 0)
    seen = np.zeros((EDGE_KINDS, 2, 2))
    np.add.at(seen, (f.kind[child], y[f.parent[child]], y[child]), 1)
    observed = np.bincount(f.feature, weights=y[f.node], minlength=len(NAMES))
    weights, edges = np.zeros(len(NAMES)), np.zeros((EDGE_KINDS, 2, 2))
    moments = [np.zeros(len(NAMES)), np.zeros((EDGE_KINDS, 2, 2)), np.zeros(len(NAMES)), np.zeros((EDGE_KINDS, 2, 2))]
    for t in range(1, rounds + 1):
        p, joint = marginals(f, weights, edges)
        expected = np.zeros((EDGE_KINDS, 2, 2))
        np.add.at(expected, f.kind[child], joint[child])
        gradient = [observed - np.bincount(f.feature, weights=p[f.node], minlength=len(NAMES)) - ridge * len(labelled) * weights,
                    seen - expected - ridge * len(labelled) * edges]
        for k, (value, g) in enumerate(zip((weights, edges), gradient)):
            g = g / len(labelled)
            moments[k] = 0.9 * moments[k] + 0.1 * g
            moments[k + 2] = 0.999 * moments[k + 2] + 0.001 * g * g
            value += 0.1 * (moments[k] / (1 - 0.9 ** t)) / (np.sqrt(moments[k + 2] / (1 - 0.999 ** t)) + 1e-8)
    return weights, edges


def extract(htmls: list[str | None], weights: np.ndarray, edges: np.ndarray, threshold: float = THRESHOLD) -> list[str]:
    pages = [parse(h or "") for h in htmls]
    if not pages:
        return []
    p, _ = marginals(forest(pages), weights, edges)
    out, base = [], 0
    for page in pages:
        own = p[base:base + len(page.tags)]
        out.append(" ".join(text for k, text in page.segments if own[k] >= threshold))
        base += len(page.tags)
    return out


#: pages are parsed in lots of about this many characters
LOT = 4 << 20


def extract_text(pages: DataFrame, html: str = "html", threshold: float = THRESHOLD, copies: int = TRAINING_COPIES) -> DataFrame:
    """``pages`` as the struct column ``row`` with ``text``, the main text of its page."""
    ship_package(pages.sparkSession)
    weights, edges = train(copies)

    @F.pandas_udf("string")
    def main_text(htmls: pd.Series) -> pd.Series:
        out, lot, size = [], [], 0
        for h in htmls:
            lot.append(h)
            size += len(h or "")
            if size > LOT:
                out += extract(lot, weights, edges, threshold)
                lot, size = [], 0
        return pd.Series(out + extract(lot, weights, edges, threshold), dtype=object)

    row = F.struct(*[pages[c].alias(c) for c in pages.columns]).alias("row")
    return pages.select(row, main_text(pages[html]).alias("text"))
