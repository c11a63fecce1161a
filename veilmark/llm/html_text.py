"""Main text of HTML pages by a tree-structured graphical model.

Each block element of the page is a variable: content, or boilerplate.  A node's evidence comes from its own tag,
names, text and links; an edge's potential from the labels of parent and child, by their kinds.  One more factor holds
a node and its children together: content has text of its own or a child that is content.  Messages go up from the
leaves and down from the root (sum-product; the factor takes a product of messages less another), and a node's text is
kept where its marginal is for content.

Both potentials are fitted together, by the likelihood of the labels given the pages, to labelled pages: HTML in which
each run of main text begins with ``MARK``.  ``fit`` takes any such pages; where there are none ``made_model`` fits to
those that ``labelled_pages`` makes, in layouts of many kinds (``N_TRAIN`` pages: the documented bound).  A node is
content if its subtree holds main text, so boilerplate passes downward and never up.

Defined results: null and empty pages give an empty text; a page cut short is read as far as it goes; repeated ids
give a row each; an empty table gives no rows; columns other than id, url and html are not read.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import map_arrow, prepare
from .dom import Page

MARK = ""
N_TRAIN = 800
SCHEMA = "page_id long, url string, text string, n_chars long, n_blocks long"

#: Words of class and id attributes that sites commonly give to the parts of a page.
PARTS = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav submenu links tabs pagination pager toc skip".split(),
    "header": "header masthead topbar branding logo banner hero sitename".split(),
    "footer": "footer bottom copyright colophon legal foot imprint".split(),
    "side": "sidebar aside rail widget related recommended trending popular more secondary complementary teaser tags".split(),
    "notice": "cookie cookies consent notice alert gdpr popup modal overlay paywall warning message toast disclaimer announcement".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion adsense banner dfp outbrain taboola".split(),
    "form": "form newsletter subscribe signup search login contact feedback subscription".split(),
    "comments": "comment comments reply replies discussion disqus responses respond thread commentlist reader".split(),
    "share": "share social sharing follow tools buttons print actions".split(),
}
MAIN = "content article post entry main story text body articlebody page primary single news".split()
NEUTRAL = "wrapper container row col inner outer box block site layout grid left right center section wrap item".split()


def _words(r: random.Random, n: int) -> str:
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "ti", "é", "ü", "ñ"]
    return " ".join("".join(r.choices(parts, k=r.randint(1, 4))) for _ in range(n)).capitalize() + r.choice([".", "", "!", "."])


def _link(r: random.Random) -> str:
    return f'<a href="/{r.randint(1, 999)}">{_words(r, r.randint(1, 5))}</a>'


def _attrs(r: random.Random, part: str | list[str], chance: float = 1.0) -> str:
    names = PARTS[part] if isinstance(part, str) else part
    if r.random() > chance:
        return ""
    name = r.choice(names)
    if r.random() < 0.3:
        name += r.choice(["-", "_", " "]) + r.choice([*NEUTRAL, "list", "area", "top", "1"])
    return f' {r.choice(["class", "class", "id"])}="{name}"'


def _boiler(r: random.Random, kind: str) -> str:
    """A part of the page that isn't main text; its prose can be as long as the article's."""
    semantic = {"nav": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form", "comments": r.choice(["section", "div", "div"])}.get(kind, "div")
    tag = semantic if r.random() < 0.6 else r.choice(["div", "div", "section", "ul" if kind == "nav" else "div"])
    attrs = _attrs(r, kind, 0.5 if tag in ("nav", "header", "footer", "aside", "form") else 1.0)
    sentence = lambda: _words(r, r.randint(3, 40))
    links = "".join(f"<li>{_link(r)}</li>" for _ in range(r.randint(2, 9)))
    links = links if tag == "ul" else f"<ul>{links}</ul>"
    prose = "".join(f"<p>{sentence()}</p>" for _ in range(r.randint(1, 3)))
    one = r.choice(["div", "div", "article"])
    inner = {
        "nav": [links, " | ".join(_link(r) for _ in range(4))],
        "header": [f"<h1>{_words(r, 3)}</h1>", f"<p>{sentence()}</p>", f"<div>{_link(r)}</div>{links}", sentence()],
        "footer": [f"&copy; {r.randint(1990, 2030)} {sentence()}", f"<p>{sentence()}</p>{links}", f"&copy; site &middot; {sentence()}", prose],
        "side": [f"<h3>{_words(r, 2)}</h3>{links}", prose, f"<h2>{_words(r, 3)}</h2>{prose}", sentence()],
        "notice": [f"<p>{sentence()}</p><button>OK</button>", sentence(), f"{sentence()} {_link(r)}", prose],
        "ad": [sentence(), f"<p>{sentence()}</p>", f"{_link(r)}", f"<p>{sentence()} {_link(r)}</p>"],
        "form": [f"<label>{_words(r, 2)}</label><input><button>Go</button>", f"<p>{sentence()}</p><input>", f"<h3>{_words(r, 3)}</h3><p>{sentence()}</p><input>"],
        "comments": ["<h3>Comments</h3>" + "".join(f"<{one}{_attrs(r, 'comments', 0.8)}><b>{_words(r, 1)}</b><p>{sentence()}</p></{one}>" for _ in range(r.randint(1, 5))), f"<ol>{''.join(f'<li><p>{sentence()}</p></li>' for _ in range(3))}</ol>", prose],
        "share": [" ".join(_link(r) for _ in range(3)), links],
    }[kind]
    return f"<{tag}{attrs}>{r.choice(inner)}</{tag}>"


def _article(r: random.Random) -> str:
    """Main text; every run of it holds the mark."""
    say = lambda a, b: MARK + _words(r, r.randint(a, b)) + (f" {_link(r)} {_words(r, 5)}" if r.random() < 0.1 else "")
    out = [f"<h1>{say(2, 12)}</h1>"] if r.random() < 0.7 else []
    close = "</p>" if r.random() < 0.8 else ""
    for _ in range(r.randint(1, 14)):
        kind = r.random()
        if kind < 0.72:
            out.append(f"<p>{say(1, 80)}{close}" if r.random() < 0.85 else f"<p><b>{say(1, 9)}<br>{close}")
        elif kind < 0.78:
            out.append(f"<h{(h := r.randint(2, 4))}>{say(1, 8)}</h{h}>")
        elif kind < 0.84:
            out.append("<ul>" + "".join(f"<li>{say(1, 20)}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
        elif kind < 0.88:
            out.append(f"<blockquote>{say(4, 40)}</blockquote>")
        elif kind < 0.91:
            out.append(f"<table><tr><td>{say(1, 6)}</td><td>{say(1, 6)}</td></tr></table>")
        elif kind < 0.93:
            out.append(f"<pre>{say(3, 20)}</pre>")
        elif kind < 0.95:
            out.append(f"<div{_attrs(r, r.choice([NEUTRAL, MAIN]), 0.6)}><p>{say(5, 50)}</p></div>")
        elif kind < 0.96:
            out.append(f"<figure><figcaption>{say(2, 15)}</figcaption></figure>")
        else:
            out.append(_boiler(r, r.choice(["ad", "share", "side", "notice", "form"])))
    if r.random() < 0.3 and len(out) > 1:  # parts of the article in sections of their own
        at = sorted(r.sample(range(len(out) + 1), 2))
        out[at[0] : at[1]] = [f"<section{_attrs(r, r.choice([MAIN, NEUTRAL]), 0.6)}>{''.join(out[at[0] : at[1]])}</section>"]
    if r.random() < 0.05 and out[0].startswith("<h1"):
        out[0] = f"<header{_attrs(r, MAIN + NEUTRAL, 0.3)}>{out[0]}</header>"
    if r.random() < 0.2:  # what readers say, and a page's small print, can stand inside
        out.append(_boiler(r, r.choice(["comments", "comments", "comments", "footer"])))
    body = "".join(out)
    shape = r.random()
    if shape < 0.45:
        return f"<article{_attrs(r, MAIN, 0.4)}>{body}</article>"
    if shape < 0.6:
        return f"<main>{body}</main>"
    if shape < 0.7:
        return f"<section{_attrs(r, MAIN)}>{body}</section>"
    if shape < 0.88:
        return f"<div{_attrs(r, MAIN)}>{body}</div>"
    if shape < 0.95:  # in several containers of one kind
        name, at = _attrs(r, MAIN), r.randint(0, len(out))
        return "".join(f"<div{name}>{''.join(x)}</div>" for x in (out[:at], out[at:]) if x)
    return body


def labelled_pages(n: int, seed: int = 7) -> list[str]:
    """Pages in which the runs of main text begin with ``MARK``."""
    r, out = random.Random(seed), []
    for _ in range(n):
        top = [_boiler(r, k) for k in ("header", "nav", "notice", "ad", "form") if r.random() < 0.5]
        low = [_boiler(r, k) for k in ("comments", "side", "ad", "share", "form", "notice") if r.random() < 0.4]
        foot = [_boiler(r, "footer")] if r.random() < 0.85 else []
        middle = _article(r) if r.random() < 0.96 else ""
        if r.random() < 0.35:
            side = _boiler(r, "side")
            middle = f"<div{_attrs(r, NEUTRAL)}>{''.join(r.sample([middle, side], 2))}</div>"
        if r.random() < 0.2:
            middle = f"<main>{middle}</main>"
        r.shuffle(top)
        r.shuffle(low)
        inner = "".join([*top, middle, *low, *foot])
        if r.random() < 0.2:
            inner = f"<div{_attrs(r, NEUTRAL)}>{inner}</div>"
        out.append(inner if r.random() < 0.1 else f"<!DOCTYPE html><html><head><title>{_words(r, 4)}</title><style>p{{}}</style></head><body>{inner}</body></html>")
    return out


def _bucket(n: int) -> int:
    return min(9, n.bit_length())


KNOWN = frozenset(w for names in PARTS.values() for w in names) | frozenset(MAIN)
PARENT_KINDS = {"#page": "top", "html": "top", "body": "top", "div": "box", "section": "box", "main": "main", "article": "main"}
CHILD_KINDS = {"p": "p", "pre": "p", "blockquote": "p", "ul": "list", "ol": "list", "dl": "list", "li": "list", "div": "box", "section": "box", "article": "main", "main": "main", "body": "main", "html": "main", "nav": "part", "header": "part", "footer": "part", "aside": "part", "form": "part"} | {f"h{i}": "head" for i in range(1, 7)}


def edge_kind(page: Page, i: int) -> str:
    return f"{PARENT_KINDS.get(page.tag[page.parent[i]], 'leaf')}>{CHILD_KINDS.get(page.tag[i], 'other')}"


def features(page: Page) -> list[list[str]]:
    """The evidence of each node, by its own tag, names, text and links."""
    n = len(page.tag)
    chars, linked, first = page.chars[:], page.linked[:], [""] * n
    for node, text in page.runs:
        first[node] = first[node] or text
    for i in range(n - 1, 0, -1):
        chars[page.parent[i]] += chars[i]
        linked[page.parent[i]] += linked[i]
    out = []
    for i in range(n):
        tag, own = page.tag[i], page.chars[i]
        f = ["bias", f"tag={tag}", f"own={_bucket(own)}", f"all={_bucket(chars[i])}"]
        if own:
            f.append(f"link={4 * page.linked[i] // own}")
        if chars[i]:
            f.append(f"links={4 * linked[i] // chars[i]}")
        for w in page.names[i]:
            if w in KNOWN:
                f.append(f"name={w}")
        if first[i].lstrip(MARK)[:1] in ("©",) or first[i][:9].lower() == "copyright":
            f.append("copyright")
        out.append(f)
    return out


#: The least that is left of a probability.
TINY = 1e-12
#: Of an edge of kinds that training never saw: boilerplate passes downward.
FLAT = ((1.0, 1e-3), (0.5, 0.5))


class Model:
    """Node weights (they add up to a node's log odds of content) and edge tables by kinds of parent and child."""

    def __init__(self, weights: dict[str, float], edges: dict[str, tuple[tuple[float, float], tuple[float, float]]]):
        self.weights, self.edges = weights, edges

    def marginals(self, page: Page) -> list[float]:
        """Of each node, the probability of content: messages up, then down."""
        weights, parent, n = self.weights, page.parent, len(page.tag)
        log, exp, own = math.log, math.exp, page.chars
        odds = [max(-30.0, min(30.0, sum(weights.get(x, 0.0) for x in f))) for f in features(page)]
        tables = [None, *(self.edges.get(edge_kind(page, i), FLAT) for i in range(1, n))]
        # logarithms: beliefs from below; products of the children's messages to a parent that is boilerplate, to one
        # that is content, and to one that is content by children that are all boilerplate
        b0, b1, low, any_, none = ([0.0] * n for _ in range(5))
        up: list[tuple[float, float, float]] = [(0.0, 0.0, 0.0)] * n

        def some(all_ways: float, without: float) -> float:
            return all_ways + log(max(TINY, -math.expm1(min(0.0, without - all_ways))))

        for i in range(n - 1, -1, -1):
            b0[i], b1[i] = low[i], odds[i] + (any_[i] if own[i] else some(any_[i], none[i]))
            top = max(b0[i], b1[i])
            b0[i], b1[i] = b0[i] - top, b1[i] - top
            if i:
                (t00, t01), (t10, t11) = tables[i]
                x0, x1 = exp(b0[i]), exp(b1[i])
                up[i] = m0, m1, z = log(t00 * x0 + t01 * x1 + TINY), log(t10 * x0 + t11 * x1 + TINY), log(t10 * x0 + TINY)
                p = parent[i]
                low[p], any_[p], none[p] = low[p] + m0, any_[p] + m1, none[p] + z
        out, above = [0.0] * n, [(0.0, 0.0)] * n
        out[0] = 1 / (1 + exp(min(700.0, b0[0] - b1[0])))
        for i in range(1, n):
            (t00, t01), (t10, t11) = tables[i]
            p, (m0, m1, z) = parent[i], up[i]
            a0, a1 = above[p]
            free = a1 + odds[p] + any_[p] - m1  # the parent is content, and so is this child, or need not be
            bound = free if own[p] else a1 + odds[p] + some(any_[p] - m1, none[p] - z)
            boiler = a0 + low[p] - m0
            top = max(free, bound, boiler)
            f0, f1, f2 = exp(boiler - top), exp(bound - top), exp(free - top)
            c0, c1 = f0 * t00 + f1 * t10 + TINY, f0 * t01 + f2 * t11 + TINY
            above[i] = log(c0), log(c1)
            d0, d1 = c0 * exp(b0[i]), c1 * exp(b1[i])
            out[i] = d1 / (d0 + d1) if d0 + d1 else 0.0
        return out

    def text(self, html: str) -> tuple[str, int]:
        """The main text, blocks joined by blank lines, and the number of blocks."""
        if not html:
            return "", 0
        page = Page(html)
        if not page.runs:
            return "", 0
        p = self.marginals(page)
        blocks = [text for node, text in page.runs if p[node] >= 0.5]
        return "\n\n".join(blocks), len(blocks)


def labels(page: Page) -> np.ndarray:
    """Content: nodes whose subtree holds the mark."""
    out = np.zeros(len(page.tag), np.int64)
    for node, text in page.runs:
        if MARK in text:
            while node >= 0 and not out[node]:
                out[node] = 1
                node = page.parent[node]
    return out


class Forest:
    """All training pages as one forest, level by level: the messages of a level are one step over arrays."""

    def __init__(self, pages: list[Page]):
        sizes = np.array([len(p.tag) for p in pages])
        first = np.cumsum(sizes) - sizes
        self.parent = np.concatenate([np.where(np.array(p.parent) < 0, -1, np.array(p.parent) + f) for p, f in zip(pages, first, strict=True)])
        self.names: dict[str, int] = {}
        rows = [[self.names.setdefault(x, len(self.names)) for x in f] for p in pages for f in features(p)]
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.column = np.fromiter((x for r in rows for x in r), np.int64, len(self.row))
        self.kinds: dict[str, int] = {}
        self.kind = np.array([self.kinds.setdefault(edge_kind(p, i), len(self.kinds)) if i else 0 for p in pages for i in range(len(p.tag))])
        self.y = np.concatenate([labels(p) for p in pages])
        self.own = np.concatenate([np.array(p.chars) > 0 for p in pages])
        depth = np.zeros(len(self.parent), np.int64)
        for i, p in enumerate(self.parent.tolist()):  # parents come first
            depth[i] = depth[p] + 1 if p >= 0 else 0
        self.levels = [np.flatnonzero(depth == d) for d in range(1, depth.max() + 1)]

    def expected(self, node: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of content by node; and, by edge kind, the expected numbers of (parent, child) labels."""
        some = lambda all_ways, without: all_ways + np.log(np.maximum(-np.expm1(np.minimum(without - all_ways, 0.0)), TINY))
        below, up, sums, above = (np.zeros((len(node), k)) for k in (2, 3, 3, 2))

        def settle(i: np.ndarray) -> None:
            low, any_, none = sums[i].T
            below[i] = np.stack([low, node[i] + np.where(self.own[i], any_, some(any_, none))], axis=1)

        for level in reversed(self.levels):
            settle(level)
            t = edge[self.kind[level]] + below[level][:, None, :]
            both = np.logaddexp(t[:, :, 0], t[:, :, 1])
            up[level] = np.column_stack([both, t[:, 1, 0]])
            np.add.at(sums, self.parent[level], up[level])
        settle(np.flatnonzero(self.parent < 0))
        pairs = np.zeros_like(edge)
        for level in self.levels:
            p = self.parent[level]
            low, any_, none = (sums[p] - up[level]).T
            boiler, free = above[p, 0] + low, above[p, 1] + node[p] + any_
            bound = np.where(self.own[p], free, above[p, 1] + node[p] + some(any_, none))
            t = edge[self.kind[level]] + np.stack([np.stack([boiler, boiler], axis=1), np.stack([bound, free], axis=1)], axis=1)
            above[level] = np.logaddexp(t[:, 0], t[:, 1])
            above[level] -= above[level].max(axis=1, keepdims=True)
            t = t + below[level][:, None, :]
            q = np.exp(t - t.max(axis=(1, 2), keepdims=True))
            q /= q.sum(axis=(1, 2), keepdims=True)
            np.add.at(pairs, self.kind[level], q)
        whole = below + above
        return 1 / (1 + np.exp(np.clip(whole[:, 0] - whole[:, 1], -700, 700))), pairs


@lru_cache(maxsize=4)
def made_model(n_train: int = N_TRAIN, seed: int = 7) -> Model:
    """The model fitted to made pages."""
    return fit(labelled_pages(n_train, seed))


def fit(pages: Sequence[str], rounds: int = 150, rate: float = 0.15, ridge: float = 2e-5) -> Model:
    """Potentials of greatest conditional likelihood over labelled pages, in which main text is marked.

    Steps are scaled by each parameter's past gradients (Adam), so that rare names learn as fast as common tags.
    """
    if not pages:
        raise ValueError("there are no labelled pages")
    forest = Forest([Page(h) for h in pages])
    n = len(forest.parent)
    n_w, shape = len(forest.names), (len(forest.kinds), 2, 2)
    x, mean, square = (np.zeros(n_w + 4 * len(forest.kinds)) for _ in range(3))
    child = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros(shape)
    np.add.at(seen, (forest.kind[child], forest.y[forest.parent[child]], forest.y[child]), 1)
    for step in range(1, rounds + 1):
        w, edge = x[:n_w], x[n_w:].reshape(shape)
        p, pairs = forest.expected(np.bincount(forest.row, w[forest.column], n), edge)
        slope = np.concatenate([np.bincount(forest.column, (forest.y - p)[forest.row], n_w), (seen - pairs).reshape(-1)]) / n - ridge * x
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        x = x + rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    w, edge = x[:n_w], x[n_w:].reshape(shape)
    tables = np.exp(edge - edge.max(axis=(1, 2), keepdims=True))
    return Model({k: float(w[i]) for k, i in forest.names.items()}, {k: tuple(tuple(map(float, row)) for row in tables[i]) for k, i in forest.kinds.items()})


def main_text(df: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, n_blocks of each row, by a fitted model, or else by that of made pages.

    Models are fitted on the driver, and broadcast: their size is that of the words and tags known."""
    spark = prepare(df.sparkSession)
    model = spark.sparkContext.broadcast(model or made_model())

    def make():
        find = model.value.text

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [find(h or "") for h in batch.column(2).to_pylist()]
            text = [t for t, _ in found]
            return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["page_id", "url", "text", "n_chars", "n_blocks"])

        return step

    return map_arrow(df.select(df[id_col].cast("long").alias("page_id"), df[url_col].cast("string").alias("url"), df[html_col].cast("string").alias("html")), make, SCHEMA)
