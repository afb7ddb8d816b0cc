"""Main text of web pages by a tree-structured graphical model.

Each block element of a page is a node with two states, content or not. A node's
potential comes from its tag, its names, its text and its links; a potential on each
parent-child pair ties the states together. Sum-product messages pass up the tree and
down again and give each node's exact probability of being content. All weights are
trained together, by the gradient of the likelihood of labelled pages.

The labelled pages are made here (``labelled_pages``): pages in many layouts whose parts
are known, so that no page to be extracted is ever needed for training. Messages of a
batch of pages are passed together, level by level.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sonagrid.llm.dom import BLOCK, Page

_TAGS = {t: k for k, t in enumerate(sorted(BLOCK))}
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Names that the made pages give to their parts.
CONTENT_NAMES = ["article", "content", "post", "entry", "story", "main", "body", "text", "article body", "post content", "entry content", "story body", "page content", "main text"]
OTHER_NAMES = {
    "nav": ["nav", "menu", "navbar", "main menu", "navigation", "breadcrumb", "breadcrumbs", "topnav", "site nav", "links", "pagination", "toc", "tabs", "skip link"],
    "header": ["header", "site header", "masthead", "top bar", "topbar", "banner", "page header", "branding", "logo"],
    "footer": ["footer", "site footer", "bottom", "copyright", "colophon", "legal", "page footer", "credits"],
    "aside": ["sidebar", "side", "aside", "widget", "rail", "related", "related posts", "recommended", "trending", "popular", "more stories", "tags", "share", "social", "author box", "read next"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promo", "promotion", "adbox", "ad slot", "banner ad", "adsense", "commercial", "partner", "advertorial"],
    "notice": ["notice", "cookie", "cookie notice", "cookie banner", "consent", "gdpr", "alert", "popup", "modal", "overlay", "paywall", "disclaimer", "message", "announcement", "toast", "warning", "info bar"],
    "form": ["form", "search", "newsletter", "subscribe", "signup", "login", "contact form", "search form", "feedback", "poll", "survey"],
    "comments": ["comments", "comment", "comment list", "comments area", "respond", "discussion", "replies", "reader comments", "disqus", "comment thread", "user comments", "reply", "responses"],
}
FEATURES = 1 << 12
_REAL = 8
#: Groups of child tags with a pair potential of their own.
_PAIRS = {"nav": 1, "header": 2, "footer": 2, "aside": 1, "form": 1, "p": 3, "h1": 4, "h2": 4, "h3": 4, "h4": 4, "h5": 4, "h6": 4, "ul": 5, "ol": 5, "dl": 5, "li": 6, "dt": 6, "dd": 6, "div": 7, "section": 7, "article": 8, "main": 8, "table": 9, "tr": 9, "td": 9, "th": 9}
PAIR_GROUPS = 10


@lru_cache(maxsize=65536)
def _name_features(hints: str) -> tuple[int, ...]:
    """Feature numbers of the words in class, id and role."""
    found = set()
    for word in _NAME.findall(hints):
        low = word.lower().rstrip("s") or "s"
        h = 2166136261
        for c in low.encode():
            h = (h ^ c) * 16777619 & 0xFFFFFFFF
        found.add(len(_TAGS) * 2 + _REAL + h % (FEATURES - len(_TAGS) * 2 - _REAL))
    return tuple(found)


class Batch:
    """The nodes of some pages with their features, in arrays."""

    def __init__(self, pages: list[Page]) -> None:
        begin = np.cumsum([0] + [len(p.tag) for p in pages])
        self.begin = begin
        self.parent = np.concatenate([np.where(np.array(p.parent) < 0, -1, np.array(p.parent) + b) for p, b in zip(pages, begin[:-1], strict=True)])
        self.depth = np.concatenate([p.depth for p in pages])
        n = int(begin[-1])
        tag = np.array([_TAGS[t] for p in pages for t in p.tag])
        self.pair = np.array([_PAIRS.get(t, 0) for p in pages for t in p.tag])
        own, marks = np.zeros(n), np.zeros(n)
        for p, b in zip(pages, begin[:-1].tolist(), strict=True):
            for block, text in p.pieces:
                own[b + block] += len(text)
                marks[b + block] += text.count(".") + text.count(",")
        links = np.array([x for p in pages for x in p.linked], float)
        below, linked = own.copy(), links.copy()
        order = np.argsort(self.depth, kind="stable")
        #: Nodes of each depth from 1 on; those of one parent follow each other.
        self.levels = np.split(order, np.searchsorted(self.depth[order], np.arange(1, int(self.depth.max(initial=0)) + 1)))[1:]
        self.levels = [level[np.argsort(self.parent[level], kind="stable")] for level in self.levels]
        self.runs = [np.flatnonzero(np.diff(self.parent[level], prepend=-1)) for level in self.levels]
        for level, run in zip(reversed(self.levels), reversed(self.runs), strict=True):
            up = self.parent[level[run]]
            below[up] += np.add.reduceat(below[level], run)
            linked[up] += np.add.reduceat(linked[level], run)
        self.real = np.column_stack((np.ones(n), np.log1p(own) / 5, own > 0, np.minimum(1, links / np.maximum(own, 1)), np.log1p(below) / 8, np.minimum(1, linked / np.maximum(below, 1)), np.minimum(1, 20 * marks / np.maximum(own, 20)), self.depth / 10))
        above = np.where(self.parent >= 0, tag[self.parent], len(_TAGS) - 1)
        names = [(k, f) for k, hints in enumerate(h for p in pages for h in p.hints) if hints for f in _name_features(hints)]
        node = np.arange(n)
        self.row = np.concatenate((node, node, np.array([x[0] for x in names], np.int64)))
        self.col = np.concatenate((tag, len(_TAGS) + above, np.array([x[1] for x in names], np.int64)))

    def unary(self, weights: np.ndarray) -> np.ndarray:
        """The log-odds of content of each node, taken alone."""
        at = 2 * len(_TAGS)
        return np.bincount(self.row, weights[self.col], len(self.parent)) + self.real @ weights[at : at + _REAL]

    def marginals(self, weights: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(each node's probability of content, each node's joint with its parent as
        [parent state, own state]), by messages up the tree and down again."""
        n = len(self.parent)
        belief = np.zeros((n, 2))
        belief[:, 1] = self.unary(weights)
        potential = pairs[self.pair]  # node, parent state, own state
        up = np.zeros((n, 2))
        for level, run in zip(reversed(self.levels), reversed(self.runs), strict=True):
            message = np.logaddexp(*np.moveaxis(potential[level] + belief[level][:, None, :], 2, 0))
            up[level] = message
            belief[self.parent[level[run]]] += np.add.reduceat(message, run, axis=0)
        joint = np.zeros((n, 2, 2))
        full = belief.copy()
        for level in self.levels:
            rest = full[self.parent[level]] - up[level]
            pair = rest[:, :, None] + potential[level] + belief[level][:, None, :]
            pair -= pair.max(axis=(1, 2), keepdims=True)
            pair = np.exp(pair)
            joint[level] = pair / pair.sum(axis=(1, 2), keepdims=True)
            full[level] = belief[level] + np.logaddexp(*np.moveaxis(potential[level] + rest[:, :, None], 1, 0))
        return 1 / (1 + np.exp(np.clip(full[:, 0] - full[:, 1], -60, 60))), joint


class Model:
    def __init__(self, weights: np.ndarray, pairs: np.ndarray) -> None:
        self.weights, self.pairs = weights, pairs

    def texts(self, sources: list[str]) -> list[str]:
        pages = [Page(s) for s in sources]
        batch = Batch(pages)
        content, _ = batch.marginals(self.weights, self.pairs)
        out = []
        for p, b in zip(pages, batch.begin[:-1].tolist(), strict=True):
            head = [False] * len(p.tag)
            for k in range(1, len(p.tag)):
                head[k] = p.tag[k] == "head" or head[p.parent[k]]
            kept = (" ".join(text.split()) for block, text in p.pieces if content[b + block] >= 0.5 and not head[block])
            out.append("\n".join(t for t in kept if t))
        return out


def _words(rng: random.Random, n: int) -> str:
    out = ["".join(rng.choice(("ba", "ke", "li", "mo", "nu", "ter", "sa", "ren", "do", "vi", "el", "an", "ö", "é")) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    for k in range(0, n, rng.randint(6, 14)):
        out[k] = out[k].capitalize()
        if k:
            out[k - 1] += rng.choice(".,")
    return " ".join(out) + rng.choice((".", ".", "", "!"))


def labelled_pages(count: int, seed: int = 11) -> list[tuple[str, list[str]]]:
    """(source, content blocks) of made pages."""
    rng = random.Random(seed)
    pages = []
    for _ in range(count):
        content: list[str] = []
        named = rng.random() < 0.6

        def name(kind: str, always: bool = False, named: bool = named) -> str:
            if not always and not named:
                return ""
            found = rng.choice(CONTENT_NAMES if kind == "content" else OTHER_NAMES[kind])
            sep = rng.choice("-_ ")
            return f' {rng.choice(("class", "class", "id"))}="{found.replace(" ", sep)}"'

        def link_list() -> str:
            return "<ul>" + "".join(f'<li><a href="/{k}">{_words(rng, rng.randint(1, 3))}</a></li>' for k in range(rng.randint(2, 8))) + "</ul>"

        def paragraph(n: int) -> str:
            text = _words(rng, n)
            content.append(text)
            if rng.random() < 0.2:
                cut = text.find(" ")
                return f"<p><b>{text[: cut + 1]}</b>{text[cut + 1 :]}</p>" if cut > 0 else f"<p>{text}</p>"
            if rng.random() < 0.1:
                cut = text.find(" ")
                return f'<p>{text[: cut + 1]}<a href="/x">{text[cut + 1 :]}</a></p>' if 0 < cut and n < 6 else f"<p><b>{text}<br>"
            return f"<p>{text}</p>"

        def plain(n: int) -> str:
            return rng.choice(("<p>{}</p>", "{}", "<div>{}</div>", "<span>{}</span>")).format(_words(rng, n))

        def box(kind: str, semantic: str, inner: str) -> str:
            if semantic and rng.random() < 0.6:
                return f"<{semantic}{name(kind)}>{inner}</{semantic}>"
            return f"<div{name(kind, True)}>{inner}</div>"

        def block(kind: str) -> str:
            if kind == "nav":
                return box("nav", "nav", link_list())
            if kind == "header":
                return box("header", "header", plain(rng.randint(1, 6)) + (link_list() if rng.random() < 0.5 else ""))
            if kind == "footer":
                return box("footer", "footer", f"&copy; site.example &middot; {plain(rng.randint(2, 40))}" + (link_list() if rng.random() < 0.4 else ""))
            if kind == "aside":
                return box("aside", "aside", f"<h3>{_words(rng, 2)}</h3>" * (rng.random() < 0.6) + (link_list() if rng.random() < 0.6 else plain(rng.randint(3, 40))))
            if kind == "ad":
                return f"<div{name('ad', True)}>{plain(rng.randint(2, 60))}</div>"
            if kind == "notice":
                role = ' role="alert"' * (rng.random() < 0.3)
                return f"<{(t := rng.choice(('div', 'p', 'section')))}{name('notice', True)}{role}>{_words(rng, rng.randint(3, 40))}</{t}>"
            if kind == "form":
                return box("form", "form", f"<label>{_words(rng, 2)}</label><input name=q><button>{_words(rng, 1)}</button>" + plain(rng.randint(1, 12)) * (rng.random() < 0.5))
            one = lambda: rng.choice((f"<div{name('comments', True)}><p>{_words(rng, rng.randint(3, 60))}</p></div>", f"<li>{plain(rng.randint(3, 50))}</li>", f"<p>{_words(rng, rng.randint(3, 60))}</p>", f"<article{name('comments', True)}><p>{_words(rng, rng.randint(3, 60))}</p></article>"))
            return f"<{(t := rng.choice(('section', 'div', 'ol', 'ul')))}{name('comments', True)}>" + f"<h3>{_words(rng, 2)}</h3>" * (rng.random() < 0.5) + "".join(one() for _ in range(rng.randint(1, 5))) + f"</{t}>"

        before = [block(k) for k in ("header", "nav", "notice", "ad", "form", "aside") if rng.random() < 0.45]
        rng.shuffle(before)
        body = []
        if rng.random() < 0.85:
            content.append(_words(rng, rng.randint(2, 14)))
            body.append(f"<h1>{content[-1]}</h1>")
        for _ in range(rng.randint(1, 9) if rng.random() < 0.95 else 0):
            body.append(paragraph(rng.choice((1, 2, 4, 8, 15, 30, 60, 90))))
            if rng.random() < 0.08:
                content.append(_words(rng, rng.randint(1, 6)))
                body.append(f"<h2>{content[-1]}</h2>")
            if rng.random() < 0.06:
                items = [_words(rng, rng.randint(1, 12)) for _ in range(rng.randint(2, 5))]
                content.extend(items)
                body.append("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>")
            if rng.random() < 0.04:
                content.append(_words(rng, rng.randint(8, 40)))
                body.append(f"<blockquote>{content[-1]}</blockquote>")
            if rng.random() < 0.04:
                items = [_words(rng, rng.randint(1, 4)) for _ in range(4)]
                content.extend(items)
                body.append("<table><tr><td>{}</td><td>{}</td></tr><tr><td>{}</td><td>{}</td></tr></table>".format(*items))
            if rng.random() < 0.08:
                body.append(block(rng.choice(("ad", "notice", "aside", "form"))))
        inner = "".join(body)
        main = rng.choice(("<article{}>{}</article>", "<article{}>{}</article>", "<main{}>{}</main>", "<main><article{}>{}</article></main>", "<section{}>{}</section>", None))
        main = main.format(name("content"), inner) if main else f"<div{name('content', True)}>{inner}</div>"
        after = [block(k) for k in ("ad", "comments", "aside", "nav", "form", "footer", "notice") if rng.random() < 0.4]
        middle = "".join(before) + main + "".join(after[:-1])
        if rng.random() < 0.3:
            middle = f"<div{rng.choice(('', ' class=wrapper', ' id=page', ' class=container'))}>{middle}</div>"
        pages.append((f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{_words(rng, 4)}</title><style>p{{margin:0}}</style></head><body>{middle}{"".join(after[-1:])}<script>var x="<p>";</script></body></html>', content))
    return pages


@lru_cache(maxsize=1)
def trained(count: int = 700, steps: int = 160) -> Model:
    """Gradient ascent (Adam) on the likelihood of made pages, with a small ridge."""
    made = labelled_pages(count)
    pages = [Page(s) for s, _ in made]
    batch = Batch(pages)
    y = np.zeros(len(batch.parent))
    for p, b, (_, content) in zip(pages, batch.begin[:-1], made, strict=True):
        wanted = [" ".join(c.split()) for c in content]
        at = 0
        for block, text in p.pieces:
            if at < len(wanted) and " ".join(text.split()) == wanted[at]:
                y[b + block] = 1
                at += 1
        if at != len(wanted):
            raise AssertionError("a made page was read differently from how it was written")
    for level in reversed(batch.levels):
        np.maximum.at(y, batch.parent[level], y[level])
    inner = batch.parent >= 0
    rng = np.random.default_rng(3)
    weights, pairs = rng.normal(0, 0.01, FEATURES), np.zeros((PAIR_GROUPS, 2, 2))
    true = np.zeros((len(y), 2, 2))
    at = np.flatnonzero(inner)
    true[at, y[batch.parent[at]].astype(int), y[at].astype(int)] = 1
    moments = [np.zeros_like(x) for x in (weights, pairs) for _ in (0, 1)]
    real = 2 * len(_TAGS)
    for step in range(1, steps + 1):
        p, joint = batch.marginals(weights, pairs)
        off = y - p
        g = np.bincount(batch.col, off[batch.row], FEATURES)
        g[real : real + _REAL] += batch.real.T @ off
        gp = np.zeros_like(pairs)
        np.add.at(gp, batch.pair[inner], (true - joint)[inner])
        for k, (x, grad) in enumerate(((weights, g / count - 2e-3 * weights), (pairs, gp / count - 2e-3 * pairs))):
            m, v = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (grad - m)
            v += 0.01 * (grad**2 - v)
            x += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(weights, pairs)


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extracted(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            sources = batch.column(2)
            at = 0
            while at < batch.num_rows:
                end, size = at, 0
                while end < batch.num_rows and (end == at or size < 1 << 20):
                    size += len(sources[end].as_py() or "") if sources[end].is_valid else 0
                    end += 1
                texts = model.texts([x or "" for x in sources.slice(at, end - at).to_pylist()])
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=_OUT)
                at = end

    return run


def extract(pages: DataFrame, model: Model | None = None, source: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars. Blocks of content in page order,
    one a line, each with its white space turned into single spaces.

    A null or empty page, and one without content, gives an empty text; repeated rows
    stay, null ids and urls pass through, other columns are not looked at."""
    sent = pages.sparkSession.sparkContext.broadcast(model or trained())
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(source).alias("html"))
    return rows.mapInArrow(_extracted(sent), "page_id long, url string, text string, n_chars long")
