"""Main text of web pages by gradient-boosted trees over DOM nodes, decoded along the hierarchy.

Each block-level element is a node with features of its own, of its subtree, its ancestors and its
siblings. The trees give the probability that it belongs to the main text. Decoding keeps or drops
whole subtrees, or leaves the choice to the children, whichever is likeliest for the page. What is
kept as a whole holds nothing that is dropped, and what is dropped as a whole nothing that is kept.
Text that lies directly in an element whose choice is left to its children counts as one more child
of it, which is kept or dropped by the element's own probability.

The trees are trained here, on pages that ``synthetic_page`` makes up with known labels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dom import PUNCTUATION, Page, parse
from .synthetic_pages import synthetic_page

# Words of class and id attributes, by what they tell.
TOKENS = {
    "advert": "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion outbrain taboola adbox adslot",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager paging toc tabs skip",
    "frame": "header masthead footer foot head topbar bottom copyright colophon legal branding logo toolbar site",
    "side": "sidebar side aside widget widgets rail related recommended recommendations trending popular more teaser complementary",
    "comment": "comment comments commentlist reply replies respond discussion disqus reviews review thread responses feedback",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay dialog banner message warning announcement paywall",
    "form": "form login signin signup register subscribe subscription newsletter search contact input",
    "share": "share sharing social follow tags tag meta byline author print tools buttons",
    "content": "article content post entry body main story text page blog news hentry maincontent articlebody prose copy",
}
_GROUP = {word: i for i, words in enumerate(TOKENS.values()) for word in words.split()}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_FRAME_TAGS = frozenset("nav header footer aside form menu dialog fieldset address search".split())
_MAIN_TAGS = frozenset(("article", "main"))
_KINDS = {
    **{t: 0 for t in ("p", "blockquote", "pre")},
    **{f"h{i}": 1 for i in range(1, 7)},
    **{t: 2 for t in ("li", "dt", "dd")},
    **{t: 3 for t in ("div", "section", "center", "html")},
    **{t: 4 for t in ("article", "main")},
    **{t: 5 for t in ("td", "th", "tr", "table", "tbody", "thead", "tfoot")},
    **{t: 6 for t in ("ul", "ol", "dl")},
}
_N_KINDS, _N_GROUPS = 8, len(TOKENS)
DEPTH, TREES, BINS, RATE, LEAST_WEIGHT = 4, 40, 32, 0.2, 5.0
TRAINING_PAGES = 500
#: What leaving a choice to the children costs, in nats: single odd children follow their parents.
MIXED = 0.5


@cache
def _token_mask(named: str) -> int:
    mask = 0
    for word in _WORDS.findall(named):
        group = _GROUP.get(word.lower())
        if group is not None:
            mask |= 1 << group
    return mask


@dataclass
class Nodes:
    """Nodes of several pages in one table; parents are row numbers, -1 for roots."""

    parent: np.ndarray
    depth: np.ndarray
    x: np.ndarray
    own: np.ndarray  # characters of own blocks
    subtree: np.ndarray


def _up(parent: np.ndarray, levels: list[np.ndarray], values: np.ndarray) -> np.ndarray:
    """Sums over subtrees."""
    total = values.astype(np.float64).copy()
    for rows in reversed(levels[1:]):
        np.add.at(total, parent[rows], total[rows])
    return total


def table_of(pages: list[Page]) -> Nodes:
    """The features of all nodes of these pages."""
    counts = np.array([len(p.tag) for p in pages])
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    n = int(counts.sum())
    page = np.repeat(np.arange(len(pages)), counts)
    parent = np.array([q + f if q >= 0 else -1 for p, f in zip(pages, first.tolist(), strict=True) for q in p.parent])
    depth = np.array([d for p in pages for d in p.depth])
    tags = [t for p in pages for t in p.tag]
    kind = np.array([_KINDS.get(t, 7) for t in tags])
    mask = np.array([_token_mask(s) for p in pages for s in p.named])
    hidden = np.array([h for p in pages for h in p.hidden], float)
    controls = np.array([c for p in pages for c in p.controls], float)
    frame, main = np.array([t in _FRAME_TAGS for t in tags], float), np.array([t in _MAIN_TAGS for t in tags], float)
    rows = np.array([f + b[0] for p, f in zip(pages, first.tolist(), strict=True) for b in p.blocks], dtype=np.int64)
    texts = [b[1] for p in pages for b in p.blocks]
    chars = np.array([len(t) for t in texts], float)
    each = lambda values: np.bincount(rows, weights=values, minlength=n) if len(rows) else np.zeros(n)
    own, linked = each(chars), each(np.array([c for p in pages for c in p.link_chars], float))
    words, marks = each(np.array([t.count(" ") + 1 for t in texts], float)), each(np.array([len(PUNCTUATION.findall(t)) for t in texts], float))
    order = np.full(n, np.nan)  # place of the first own block among the page's characters
    totals = np.zeros(len(pages))
    so_far = 0
    owner = page[rows] if len(rows) else np.zeros(0, np.int64)
    begins = np.cumsum(chars) - chars
    for i, p in enumerate(owner.tolist()):
        if not i or owner[i - 1] != p:
            so_far = begins[i]
        if np.isnan(order[rows[i]]):
            order[rows[i]] = begins[i] - so_far
        totals[p] += chars[i]
    by_depth = np.argsort(depth, kind="stable")
    levels = np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1) if n else []
    subtree, sub_linked, sub_words, sub_marks = (_up(parent, levels, v) for v in (own, linked, words, marks))
    sub_nodes, sub_controls = _up(parent, levels, np.ones(n)), _up(parent, levels, controls)
    paragraphs = _up(parent, levels, (kind == 0).astype(float))
    place = np.where(np.isnan(order), np.inf, order)
    for level in reversed(levels[1:]):
        np.minimum.at(place, parent[level], place[level])
    page_chars = np.maximum(totals[page], 1)
    place = np.where(np.isfinite(place), place, 0) / page_chars
    above, framed, mained, veiled = np.zeros(n, np.int64), np.full(n, -1.0), np.full(n, -1.0), hidden.copy()
    for level in levels[1:]:
        q = parent[level]
        above[level] = above[q] | mask[q]
        framed[level] = np.where(frame[q] > 0, depth[q], framed[q])
        mained[level] = np.where(main[q] > 0, depth[q], mained[q])
        veiled[level] = np.maximum(veiled[level], veiled[q])
    q = np.maximum(parent, 0)
    siblings = np.bincount(q[parent >= 0], minlength=n).astype(float)
    alike = q * _N_KINDS + kind
    same, same_chars = np.bincount(alike, minlength=n * _N_KINDS)[alike], np.bincount(alike, weights=subtree, minlength=n * _N_KINDS)[alike]
    rank = np.zeros(n)
    by_parent = np.argsort(q, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(q[by_parent]) > 0])
    rank[by_parent] = np.arange(n) - np.repeat(starts, np.diff(np.r_[starts, n]))
    share = lambda a, b: a / np.maximum(b, 1)
    columns = [
        *(kind == k for k in range(_N_KINDS)),
        *(mask >> g & 1 for g in range(_N_GROUPS)),
        *(above >> g & 1 for g in range(_N_GROUPS)),
        frame, main, framed >= 0, mained >= 0, framed - mained, veiled,
        np.log1p(own), np.log1p(subtree), subtree / page_chars, share(sub_linked, subtree), share(linked, own),
        np.log1p(share(subtree, sub_nodes)), np.log1p(sub_nodes), share(sub_marks, sub_words), share(subtree, sub_words),
        np.log1p(paragraphs), np.log1p(sub_controls), depth, place,
        siblings[q], share(rank, siblings[q]), share(same, siblings[q]), np.log1p(share(same_chars, same)),
        share(subtree, subtree[q]), np.log1p(subtree[q]), share(sub_linked[q], subtree[q]),
    ]
    return Nodes(parent, depth, np.stack([np.asarray(c, np.float32) for c in columns], axis=1), own, subtree)


@dataclass(frozen=True)
class Trees:
    """Complete binary trees of one depth: a feature and threshold for each inner node, a value for each leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        rows, z = np.arange(len(x)), np.full(len(x), self.start)
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            z += leaf[at - (2**DEPTH - 1)]
        return z


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
    """Gradient boosting of the logistic loss with second-order leaf values."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    base = float(np.clip(np.average(y, weights=weight), 0.01, 0.99))
    start = float(np.log(base / (1 - base)))
    z = np.full(len(y), start)
    inner = 2**DEPTH - 1
    features, thresholds, leaves = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        g, h = (y - p) * weight, np.maximum(p * (1 - p), 1e-6) * weight
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            local = at - first
            best = np.full(width, 1e-6)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                index, bins = local * (len(c) + 1) + binned[:, f], len(c) + 1
                gs = np.bincount(index, weights=g, minlength=width * bins).reshape(width, bins)
                hs = np.bincount(index, weights=h, minlength=width * bins).reshape(width, bins)
                gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                ga, ha = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                gain = gl**2 / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga**2 / (ha + 1)
                gain[(hl < LEAST_WEIGHT / 10) | (ha - hl < LEAST_WEIGHT / 10)] = 0
                k = gain.argmax(1)
                top = gain[np.arange(width), k]
                better = top > best
                best[better], feature[first + np.flatnonzero(better)], threshold[first + np.flatnonzero(better)] = top[better], f, c[k[better]]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > threshold[at])
        own = at - inner
        leaf = RATE * np.bincount(own, weights=g, minlength=inner + 1) / (np.bincount(own, weights=h, minlength=inner + 1) + 1)
        z += leaf[own]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(np.array(features), np.array(thresholds), np.array(leaves), start)


@cache
def trained(pages: int = TRAINING_PAGES, seed: int = 7) -> Trees:
    """Trees trained on so many made-up pages; the same ones for the same arguments."""
    rng = np.random.default_rng(seed)
    made = [synthetic_page(rng) for _ in range(pages)]
    parsed = [parse(source) for source, _ in made]
    nodes = table_of(parsed)
    good = np.zeros(len(nodes.own))
    at = 0
    for page, (_, wanted) in zip(parsed, made, strict=True):
        for node, text in page.blocks:
            good[at + node] += len(text) * (text in wanted)
        at += len(page.tag)
    by_depth = np.argsort(nodes.depth, kind="stable")
    levels = np.split(by_depth, np.flatnonzero(np.diff(nodes.depth[by_depth])) + 1)
    share = _up(nodes.parent, levels, good) / np.maximum(nodes.subtree, 1)
    used = (nodes.subtree > 0) & ((share < 0.2) | (share > 0.8))  # what is mixed teaches nothing
    y = (share[used] > 0.5).astype(float)
    return boost(nodes.x[used].astype(np.float64), y, np.sqrt(1 + np.minimum(nodes.own[used], 400) / 20))


def decode(nodes: Nodes, logit: np.ndarray) -> np.ndarray:
    """Which nodes are kept: the likeliest choice of kept and dropped subtrees."""
    weight = np.where(nodes.subtree > 0, np.sqrt(1 + np.minimum(nodes.own, 400) / 20), 0.0)
    keep, drop = -np.logaddexp(0, -logit) * weight, -np.logaddexp(0, logit) * weight
    by_depth = np.argsort(nodes.depth, kind="stable")
    levels = np.split(by_depth, np.flatnonzero(np.diff(nodes.depth[by_depth])) + 1) if len(by_depth) else []
    all_in, all_out = _up(nodes.parent, levels, keep), _up(nodes.parent, levels, drop)
    # own blocks of a mixed node are judged by its own probability
    own = np.where(nodes.own > 0, np.maximum(keep, drop), 0.0)
    mixed, best = own - MIXED, np.maximum(all_in, all_out)
    for level in reversed(levels):
        best[level] = np.maximum(best[level], mixed[level])
        if len(level) and nodes.depth[level[0]] > 0:
            np.add.at(mixed, nodes.parent[level], best[level])
    state = np.zeros(len(logit), np.int8)  # 0 undecided, 1 in, 2 out
    kept = np.zeros(len(logit), bool)
    for level in levels:
        q = nodes.parent[level]
        given = np.where(q >= 0, state[np.maximum(q, 0)], 0)
        chosen = np.where(mixed[level] >= np.maximum(all_in[level], all_out[level]), 0, np.where(all_in[level] >= all_out[level], 1, 2))
        state[level] = np.where(given > 0, given, chosen)
        kept[level] = (state[level] == 1) | ((state[level] == 0) & (logit[level] > 0))
    return kept


def main_texts(sources: list[str | None], trees: Trees) -> list[str]:
    """The main text of each page: its kept blocks, in page order, a line each."""
    pages = [parse(s) for s in sources]
    if not pages:
        return []
    nodes = table_of(pages)
    kept = decode(nodes, trees.logit(nodes.x))
    found, at = [], 0
    for page in pages:
        found.append("\n".join(text for node, text in page.blocks if kept[at + node]))
        at += len(page.tag)
    return found


def extract_text(pages: DataFrame, html: str = "html", column: str = "text", trees: Trees | None = None) -> DataFrame:
    """``pages`` with all their columns and the main text of ``html``; null or empty pages have an empty text.

    A column of the name ``column`` is replaced. Rows are read each for itself, so repeated rows
    have equal texts and an empty table gives no rows.
    """
    shared = pages.sparkSession.sparkContext.broadcast(trees or trained())  # some thousand numbers

    def extract(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts: list[str] = []
            sources = batch.column(batch.num_columns - 1).to_pylist()
            for i in range(0, len(sources), 64):
                texts += main_texts(sources[i : i + 64], shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=names)

    others = [c for c in pages.columns if c != column]
    names = [*others, column]
    given = pages.select(*[F.col(f"`{c}`") for c in others], F.col(html).alias("__sl_html"))
    schema = pages.select(*[F.col(f"`{c}`") for c in others]).schema.add(column, "string")
    return given.mapInArrow(extract, schema)


def op8_html_extraction(pages: DataFrame) -> DataFrame:
    """The contract's columns of ``extract_text``."""
    found = extract_text(pages.select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
