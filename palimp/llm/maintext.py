"""The main text of web pages: a linear-chain conditional random field over the leaf blocks of the page's tree.

A page is read once from left to right with a stack of open elements; text between two starts or ends of block elements is
a leaf block. A block's features are its tag, the tags, class words, id words and roles of its ancestors, and what its
text looks like (length, share of links, punctuation). The field has two labels, main text and the rest; it is trained by
gradient ascent on the log-likelihood of labelled pages, all pages at once, and a page's labels are the most likely
sequence (Viterbi). `labelled_pages` makes labelled pages of many layouts by rule; other pages with labels do as well.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from palimp.functions.markup import INLINE, Markup
from palimp.llm.durable import few_at_once

_ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)", re.IGNORECASE)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_END = re.compile(r"[.!?…:;。！？][\"'”’»)\]]*$")


@dataclass
class Block:
    """A leaf block: its text, white space made one space, and its features."""

    text: str
    features: list[str]


class _Page(Markup):
    """The blocks of a page, with the features that the open elements and the text give them. Each step costs the same at any depth."""

    def __init__(self) -> None:
        super().__init__()
        self.known: Counter = Counter()  # features of the open elements
        self.own: list[list[str]] = []
        self.block: list[str] = ["body"]
        self.said: list[str] = []
        self.linked: list[str] = []
        self.blocks: list[Block] = []

    def text(self, plain: str) -> None:
        self.said.append(plain)
        if self.tags["a"]:
            self.linked.append(plain)

    def edge(self) -> None:
        text = " ".join("".join(self.said).split())
        if text:
            looks = _looks(text, len(" ".join("".join(self.linked).split())))
            self.blocks.append(Block(text, [f"own={self.block[-1]}", *self.known, *looks]))
        self.said, self.linked = [], []

    def opened(self, tag: str, attributes: str) -> None:
        if tag not in INLINE:
            self.block.append(tag)
        self.own.append(_element(tag, attributes))
        self.known.update(self.own[-1])

    def closed(self, tag: str) -> None:
        if tag not in INLINE:
            self.block.pop()
        for f in self.own.pop():
            self.known[f] -= 1
            if not self.known[f]:
                del self.known[f]


def _element(tag: str, attributes: str) -> list[str]:
    """Features that an open element gives to the blocks inside it."""
    features = [f"in={tag}"] if tag not in INLINE else []
    if attributes and tag not in ("html", "body"):
        for name, *values in _ATTRIBUTE.findall(attributes):
            value = next((v for v in values if v), "")
            name = name.lower()
            if name in ("class", "id", "role"):
                features += {f"word={w.lower()}" for w in _WORDS.findall(value)}
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                features.append("hidden")
    return features


def _looks(text: str, linked: int) -> list[str]:
    words = text.count(" ") + 1
    share = linked / len(text)
    out = [f"words={min(words.bit_length(), 7)}", f"links={0 if share == 0 else 1 if share < 0.4 else 2 if share < 0.9 else 3}"]
    if _END.search(text):
        out.append("ended")
    if "," in text:
        out.append("comma")
    if text.startswith("©"):
        out.append("copyright")
    return out


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in page order; in time that grows with the page's length, whatever its markup."""
    state = _Page()
    state.feed(page)
    return state.blocks


@dataclass
class Field:
    """The trained field: a weight for main text (against the rest) of each feature, and for label pairs."""

    weights: dict[str, float]
    start: np.ndarray
    steps: np.ndarray

    def scores(self, page: list[Block]) -> np.ndarray:
        known = self.weights
        return np.array([known["bias"] + sum(known.get(f, 0.0) for f in b.features) for b in page])

    def labels(self, page: list[Block]) -> list[bool]:
        """The most likely labels of a page's blocks."""
        if not page:
            return []
        scores = self.scores(page).tolist()
        (aa, ab), (ba, bb) = self.steps.tolist()
        rest, main = self.start.tolist()
        main += scores[0]
        back: list[tuple[bool, bool]] = []
        for s in scores[1:]:
            to_rest, to_main = main + ba > rest + aa, main + bb >= rest + ab
            rest, main = max(main + ba, rest + aa), max(main + bb, rest + ab) + s
            back.append((to_rest, to_main))
        out = [main >= rest]
        for before in reversed(back):
            out.append(before[out[-1]])
        return out[::-1]


def train(pages: Iterable[tuple[list[Block], list[bool]]], *, steps: int = 400, rate: float = 0.3, ridge: float = 1e-5) -> Field:
    """A field from (blocks, labels) of pages: Adam, with a falling rate, on the mean log-likelihood less `ridge` times the squared weights."""
    data = sorted(((b, y) for b, y in pages if b), key=lambda d: -len(d[0]))
    names = {"bias": 0}
    for page, _ in data:
        for block in page:
            for f in block.features:
                names.setdefault(f, len(names))
    n, k = len(data), len(names)
    lengths = np.array([len(b) for b, _ in data], int)
    longest = int(lengths.max(initial=1))
    there = np.arange(longest) < lengths[:, None]
    still = there.sum(0)  # pages that have a block at each place; the longest come first
    x = np.zeros((int(lengths.sum()), k), np.float32)
    y = np.zeros((n, longest), int)
    row = 0
    for i, (page, labels) in enumerate(data):
        y[i, : len(page)] = labels
        for block in page:
            x[row, [0, *{names[f] for f in block.features}]] = 1
            row += 1
    total = max(row, 1)
    pair = there[:, 1:]
    seen = np.concatenate((y[there].astype(np.float32) @ x, np.bincount(y[:, 0], minlength=2)[:2], np.bincount((2 * y[:, :-1] + y[:, 1:])[pair], minlength=4)))
    theta, m, v = np.zeros((3, k + 6))
    for step in range(1, steps + 1 if n else 1):
        emit = np.zeros((n, longest, 2))
        emit[there, 1] = x @ theta[:k].astype(np.float32)
        move = theta[-4:].reshape(2, 2)
        forward, backward = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        forward[:, 0] = emit[:, 0] + theta[k : k + 2]
        for t in range(1, longest):
            s = still[t]
            before = forward[:s, t - 1]
            forward[:s, t] = np.logaddexp(before[:, :1] + move[0], before[:, 1:] + move[1]) + emit[:s, t]
        for t in range(longest - 2, -1, -1):
            s = still[t + 1]
            after = emit[:s, t + 1] + backward[:s, t + 1]
            backward[:s, t] = np.logaddexp(after[:, :1] + move[:, 0], after[:, 1:] + move[:, 1])
        ends = forward[np.arange(n), lengths - 1]
        all_of = np.logaddexp(ends[:, 0], ends[:, 1])
        main = np.exp(forward[:, :, 1] + backward[:, :, 1] - all_of[:, None])[there]
        both = np.exp(forward[:, :-1, :, None] + move + (emit[:, 1:] + backward[:, 1:])[:, :, None, :] - all_of[:, None, None, None])[pair].sum(0)
        first = np.exp(forward[:, 0] + backward[:, 0] - all_of[:, None]).sum(0)
        gradient = (seen - np.concatenate((main.astype(np.float32) @ x, first, both.reshape(-1)))) / total - ridge * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta = theta + rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Field({f: float(theta[i]) for f, i in names.items()}, theta[k : k + 2], theta[-4:].reshape(2, 2))


#: How pages name the containers of their main text, and of what isn't part of it.
MAIN = "<article>|<main>|<div class='content'>|<div id='content'>|<div class='post-body'>|<section class='entry-content'>|<div class='article-text'>|<div role='main'>|<div class='story'>|<article class='post'>|<article class='entry'>|<div itemprop='articleBody' class='article-body'>".split("|")
MENUS = "<nav>|<div class='nav'>|<div id='menu'>|<ul class='menu'>|<div class='navbar'>|<div role='navigation'>|<nav class='breadcrumb'>|<div class='breadcrumbs'>|<ol class='pagination'>|<div class='pager'>|<div class='toolbar'>|<div class='tabs'>|<div class='skip-links'>|<menu>".split("|")
HEADS = "<header>|<div class='header'>|<div id='masthead'>|<div class='site-header'>|<div class='top-bar'>|<div role='banner'>|<div class='logo'>".split("|")
FEET = "<footer>|<div class='footer'>|<div id='footer'>|<div role='contentinfo'>|<div class='copyright'>|<div class='site-footer'>|<div class='bottom'>|<div class='legal'>".split("|")
SIDES = "<aside>|<div class='sidebar'>|<div id='sidebar'>|<div role='complementary'>|<div class='widget'>|<div class='related'>|<section class='related-posts'>|<div class='recommended'>|<div class='trending'>|<div class='popular'>|<div class='most-read'>|<div class='side'>|<div class='rail'>|<div class='author-bio'>|<div class='tags'>|<div class='share'>|<div class='social'>".split("|")
NOTICES = "<div class='cookie'>|<div class='cookie-notice'>|<div id='cookies'>|<div class='consent'>|<div class='gdpr'>|<div class='notice'>|<div class='alert'>|<div class='popup'>|<div class='modal'>|<div role='dialog'>|<dialog>|<div class='paywall'>|<div class='disclaimer'>|<div class='privacy-banner'>|<div role='alert'>|<div class='message'>|<div class='overlay'>".split("|")
ADVERTS = "<div class='ad'>|<div class='ads'>|<div class='advert'>|<div class='advertisement'>|<div id='ad-top'>|<aside class='sponsored'>|<div class='sponsor'>|<div class='promo'>|<div class='banner-ad'>|<section class='promotion'>|<div class='adsense'>|<div class='commercial'>|<div class='teaser'>|<div class='partner'>".split("|")
FORMS = "<form>|<form class='search'>|<form class='newsletter'>|<div class='subscribe'>|<div class='login'>|<div class='signup'>|<fieldset>|<div role='search'>|<div role='form'>|<form class='contact'>|<div class='search-box'>|<div class='poll'>".split("|")
COMMENTS = "<div class='comments'>|<section id='comments'>|<div id='comments'>|<ol class='comment-list'>|<section class='comments'>|<div class='comment'>|<div id='disqus'>|<div class='reviews'>|<div class='replies'>|<div class='discussion'>|<div class='responses'>|<section class='user-comments'>|<div class='reply'>|<div class='feedback'>|<div class='guestbook'>|<div class='respond'>|<article class='comment'>".split("|")
WRAPS = "<div>|<div class='wrapper'>|<div class='container'>|<div id='page'>|<section>|<div class='row'>|<div class='inner'>|<div class='layout'>".split("|")


def labelled_pages(n: int, seed: int = 0) -> Iterator[tuple[str, list[bool]]]:
    """n pages (html, whether each leaf block is main text) of invented words: containers of all the kinds above around
    and inside the article, articles of one to thirty blocks, and pages whose article has no telling container."""
    rng = random.Random(seed)

    def words(a: int, b: int) -> str:
        return " ".join("".join(rng.choice("aeiou") + rng.choice("bcdfglmnprstvz") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(a, b)))

    def prose(a: int = 3, b: int = 60) -> str:
        text = words(a, b).capitalize()
        if rng.random() < 0.6:
            text = text.replace(" ", ", ", 1)
        if rng.random() < 0.1:
            text = text.replace(" ", rng.choice((" | ", " *** ", "%%% ", "### ", " 12 ", " &copy; ")))
        return text + rng.choice(["."] * 8 + ["", "?", "!"])

    def link() -> str:
        return f"<a href='/{rng.randint(1, 99)}'>{words(1, 4).capitalize()}</a>"

    def close(opened: str) -> str:
        return f"</{re.match(r'<(\w+)', opened)[1]}>"

    def around(opened: str, inner: list[tuple[str, bool | None]]) -> list[tuple[str, bool | None]]:
        return [(opened, None), *inner, (close(opened), None)]

    def listed(opened: str) -> list:
        items = [(f"<li>{link()}</li>", False) for _ in range(rng.randint(1, 8))]
        return around(opened, items if opened[1:3] in ("ul", "ol", "me") else around("<ul>", items) if rng.random() < 0.7 else [(f"<p>{link()}</p>", False) for _ in items])

    def told(opened: str, heading: float = 0.4, most: int = 4) -> list:
        inner = [(f"<h{rng.randint(2, 5)}>{words(1, 5)}</h{0}>".replace("</h0>", "</h3>"), False)] if rng.random() < heading else []
        for _ in range(rng.randint(1, most)):
            shape = rng.random()
            inner.append((f"<p>{prose(2, 40)}</p>" if shape < 0.6 else f"<div>{prose(2, 25)}</div>" if shape < 0.8 else f"<span>{words(1, 8)}</span><br><div></div>", False))
        if opened.startswith("<ol"):
            inner = around("<li>", inner)
        return around(opened, inner)

    def form(opened: str) -> list:
        return around(opened, [(f"<label>{words(1, 4)}</label><input>", False), *([(f"<p>{prose(2, 15)}</p>", False)] if rng.random() < 0.6 else []), (f"<button>{words(1, 2)}</button>", False)])

    def copyright() -> list:
        return around(rng.choice(FEET), [(f"<p>&copy; {words(1, 4)} &middot; {words(2, 9)}</p>" if rng.random() < 0.5 else f"&copy; {words(1, 4)} | {prose(2, 9)}", False), *([(f"<p>{link()} {link()}</p>", False)] if rng.random() < 0.5 else [])])

    def aside() -> list:
        kind = rng.random()
        if kind < 0.2:
            return listed(rng.choice(MENUS))
        if kind < 0.4:
            return listed(rng.choice(SIDES)) if rng.random() < 0.5 else told(rng.choice(SIDES))
        if kind < 0.55:
            return told(rng.choice(NOTICES), 0.3, 2)
        if kind < 0.7:
            # Adverts often have their text in the container itself.
            opened = rng.choice(ADVERTS)
            return told(opened, 0.2, 2) if rng.random() < 0.5 else [(f"{opened}{prose(2, 30)}{close(opened)}", False)]
        if kind < 0.85:
            return form(rng.choice(FORMS))
        return told(rng.choice(COMMENTS), 0.5, 6)

    def article() -> list:
        inner = [(f"<h1>{words(1, 12).capitalize() if rng.random() < 0.7 else prose(2, 12)}</h1>", True)] if rng.random() < 0.8 else []
        for _ in range(rng.choice((0, 1, 2, 3, 5, 8, 12, 20, 30))):
            kind = rng.random()
            if kind < 0.7:
                body = prose(1, 60) if rng.random() < 0.8 else f"{words(2, 20)} {link()} {prose(1, 20)}"
                inner.append((f"<p>{body}</p>", True))
            elif kind < 0.76:
                inner.append((f"<h{(h := rng.randint(2, 4))}>{words(1, 8).capitalize()}</h{h}>", True))
            elif kind < 0.82:
                inner += around(rng.choice(("<ul>", "<ol>")), [(f"<li>{words(1, 20)}</li>", True) for _ in range(rng.randint(1, 5))])
            elif kind < 0.86:
                inner += around("<blockquote>", [(f"<p>{prose()}</p>", True)])
            elif kind < 0.89:
                inner.append((f"<pre>{words(2, 30)}</pre>", True))
            elif kind < 0.92:
                inner += around("<figure>", [(f"<figcaption>{words(2, 12)}</figcaption>", True)])
            elif kind < 0.95:
                inner += [("<table><tr>", None), *[(f"<td>{words(1, 4)}</td>", True) for _ in range(rng.randint(1, 4))], ("</tr></table>", None)]
            else:
                inner.append((f"<div>{prose(4, 60)}</div>", True))
            if rng.random() < 0.06:
                inner += aside()
        return inner or [(f"<p>{prose(10, 60)}</p>", True)]

    for _ in range(n):
        opened = rng.choice(MAIN) if rng.random() < 0.9 else rng.choice(WRAPS)
        if rng.random() < 0.45:
            opened = "<article>"
        parts = listed(rng.choice(MENUS)) if rng.random() < 0.7 else []
        if rng.random() < 0.5:
            parts = around(rng.choice(HEADS), [*([(f"<h1>{words(1, 4)}</h1>" if rng.random() < 0.3 else f"<p>{words(1, 9)}</p>" if rng.random() < 0.5 else f"<a href='/'>{words(1, 3)}</a><div></div>", False)]), *parts]) if rng.random() < 0.6 else [*parts, *told(rng.choice(HEADS), 0.5, 1)]
        for _ in range(rng.choice((0, 1, 1, 2))):
            parts += aside()
        body = around(opened, article())
        if rng.random() < 0.3:
            body = around(rng.choice(("<main>", "<div id='main'>", "<div class='content-area'>")), [*body, *(told(rng.choice(COMMENTS), 0.5, 6) if rng.random() < 0.5 else aside())])
        parts += body
        for _ in range(rng.choice((0, 0, 1, 2))):
            parts += aside()
        parts += copyright() if rng.random() < 0.85 else []
        for _ in range(rng.randint(0, 2)):
            parts = around(rng.choice(WRAPS), parts)
        page = "".join(p for p, _ in parts)
        yield f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title></head><body>{page}</body></html>", [y for _, y in parts if y is not None]


#: Pages that the field is trained on by default.
TRAIN_PAGES = 600


@lru_cache(maxsize=4)
def trained(n: int = TRAIN_PAGES, seed: int = 0) -> Field:
    """A field from n labelled pages made by rule."""
    return train((blocks(page), labels) for page, labels in labelled_pages(n, seed))


def extract(pages: DataFrame, model: Field | None = None, *, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns `keep` and text: the main blocks of each page in page order, joined by line feeds.

    Inside a block character references are decoded and white space (Unicode's) becomes one space. Nothing is shuffled,
    and no page is cut. A null or empty page, or one without main text, gives an empty text; repeated rows give a row each,
    an empty table none. Only `keep` and `html` are read, so other columns cannot clash; `keep` must not name "text".
    """
    field = model or trained()
    kinds = pages.select(*(F.col(f"`{c}`").alias(c) for c in keep)).schema
    schema = T.StructType([*kinds.fields, T.StructField("text", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(schema)
        for batch in batches:
            texts = []
            for x in batch.column(len(keep)):
                found = blocks(x.as_py())
                texts.append("\n".join([b.text for b, main in zip(found, field.labels(found), strict=True) if main]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, types.field("text").type)], schema=types)

    source = few_at_once(pages).select(*(F.col(f"`{c}`").alias(c) for c in keep), F.col(f"`{html}`").cast("string").alias("__html"))
    return source.mapInArrow(work, schema)
