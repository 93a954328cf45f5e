"""Main text of web pages by a recurrent block labeller in numpy.

A page is cut into leaves: runs of text between block-level tags.  A bidirectional LSTM reads the
sequence of leaves, each as a vector of its tag path (tags and the words of class, id and role, hashed),
its hashed words and a few figures, and labels every leaf as main text or not with the whole page as
context.  It is trained here, on pages that ``training_page`` composes from a seed: articles between menus,
headers, sidebars, notices, adverts, forms, comments and footers in many styles of markup.  Weights
depend on nothing but that seed, so every run labels alike; they are kept as a table in the shared folder.

Comments, scripts and styles hold no text.  Character references are decoded, white space in a leaf becomes
one space, leaves are trimmed, empty ones dropped, and the kept ones joined by one line feed.  Null and
empty pages give an empty text; broken markup is read as far as it goes and never raises; repeated rows
give the same text; extra columns are carried along, replaced where they share a result's name.
"""

from __future__ import annotations

import hashlib
import html
import inspect
import re
import sys
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import tables
from .words import ALNUM, U64, Words, by_bytes

PATH_PLACES = 96
WORD_PLACES = 32
FIGURES = 6
HIDDEN = 20
WIDTH = PATH_PLACES + WORD_PLACES + FIGURES

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style)\b[^>]*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>"
    r"|<[!?][^>]*+>"
    r"|[^<]++|<",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|\bhidden\b|aria-hidden\s*=\s*.?true", re.I)
_NAME = re.compile(r"[a-z]+")

# How elements behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIER = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}


class Leaf:
    __slots__ = ("links", "path", "text")

    def __init__(self, path: tuple[str, ...], text: str, links: int) -> None:
        self.path, self.text, self.links = path, text, links


def leaves(page: str) -> list[Leaf]:
    """The page's runs of text in order, each with the words of its open tags."""
    out: list[Leaf] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    linked = in_link = 0

    def flush() -> None:
        nonlocal held, linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                path = tuple(w for name, words in stack if name not in INLINE for w in words)
                out.append(Leaf(path, text, min(linked, len(text))))
            held, linked = [], 0

    for m in _TOKEN.finditer(page):
        name = m[3] or m[6]
        if name is None:
            piece = m[0]
            if m[1] or (piece[0] == "<" and len(piece) > 1):
                continue
            piece = html.unescape(piece)
            held.append(piece)
            if in_link:
                linked += len(piece)
            continue
        name = name.lower()
        closing = m[2] or m[5]
        if name == "br":
            held.append("\n")
            continue
        inline = name in INLINE
        if not inline:
            flush()
        if name == "a":
            in_link = 0 if closing else 1
        if closing:
            if any(n == name for n, _ in stack):
                while stack and stack.pop()[0] != name:
                    pass
            continue
        if not inline:
            in_link = 0
        if name in CLOSES_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    del stack[k:]
                    break
                if stack[k][0] not in INLINE:
                    break
        if name in SAME:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in SAME[name]:
                    del stack[k:]
                    break
                if stack[k][0] in BARRIER[name]:
                    break
        if name in VOID or (m[4] or m[7] or "").endswith("/"):
            continue
        said = m[4] or m[7] or ""
        words = [name]
        if said and not inline:
            for a in _ATTRIBUTE.finditer(said):
                words += _NAME.findall((a[1] or a[2] or a[3] or "").lower())
            if _HIDDEN.search(said):
                words.append("hidden")
        stack.append((name, tuple(words)))
    flush()
    return out


# ---- vectors


@cache
def _place(word: str) -> tuple[int, float]:
    h = zlib.crc32(word.encode())
    return h % PATH_PLACES, 1.0 if h >> 16 & 1 else -1.0


_paths: dict[tuple[str, ...], np.ndarray] = {}


def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    got = _paths.get(path)
    if got is None:
        if len(_paths) > 50_000:
            _paths.clear()
        got = np.zeros(PATH_PLACES, np.float32)
        for word in set(path):
            for salt in "xy":
                at, sign = _place(salt + word)
                got[at] += sign
        _paths[path] = got
    return got


def vectors(some: list[Leaf]) -> np.ndarray:
    """One row a leaf: path, hashed words, figures."""
    out = np.zeros((len(some), WIDTH), np.float32)
    if not some:
        return out
    words = Words([leaf.text.encode("utf-8", "surrogatepass") for leaf in some], ALNUM)
    at = words.texts_of() * WORD_PLACES + (words.hashes % U64(WORD_PLACES)).astype(np.int64)
    bag = np.bincount(at, minlength=len(some) * WORD_PLACES).reshape(-1, WORD_PLACES)
    out[:, PATH_PLACES : PATH_PLACES + WORD_PLACES] = np.log1p(bag) * 0.3
    for k, leaf in enumerate(some):
        out[k, :PATH_PLACES] = _path_vector(leaf.path)
    size = np.array([len(leaf.text) for leaf in some], np.float32)
    out[:, -6] = np.log1p(size) / 6
    out[:, -5] = np.array([leaf.links for leaf in some], np.float32) / size
    out[:, -4] = np.log1p(words.counts) / 5
    out[:, -3] = [leaf.text[-1] in ".!?:;" for leaf in some]
    out[:, -2] = np.array([len(leaf.path) for leaf in some], np.float32) / 10
    out[:, -1] = 1
    return out


# ---- the network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM and one output unit; sequences are batches padded at the end."""

    def __init__(self, seed: int = 10) -> None:
        rng = np.random.default_rng(seed)
        wide = WIDTH + HIDDEN
        self.w = {d: (rng.standard_normal((wide, 4 * HIDDEN)) / np.sqrt(wide)).astype(np.float32) for d in "fb"}
        self.w |= {f"{d}0": np.zeros(4 * HIDDEN, np.float32) for d in "fb"}
        self.w["o"] = (rng.standard_normal(2 * HIDDEN) / np.sqrt(2 * HIDDEN)).astype(np.float32)
        self.w["o0"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states over time of one direction.  x: time, batch, width."""
        steps, batch, _ = x.shape
        inner = x @ self.w[d][:WIDTH] + self.w[f"{d}0"]
        h, c = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
        out = np.zeros((steps, batch, HIDDEN), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            gates = inner[t] + h @ self.w[d][WIDTH:]
            i, f, o = (_sigmoid(gates[:, k * HIDDEN : (k + 1) * HIDDEN] + (k == 1)) for k in range(3))
            g = np.tanh(gates[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            before = (h, c)
            new = f * c + i * g
            th = np.tanh(new)
            h, c = np.where(m, o * th, h), np.where(m, new, c)
            out[t] = h
            if keep is not None:
                keep.append((t, i, f, o, g, th, *before))
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        h = np.concatenate([self._run(x, mask, d) for d in "fb"], axis=2)
        return h @ self.w["o"] + self.w["o0"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        kept: dict[str, list] = {"f": [], "b": []}
        h = np.concatenate([self._run(x, mask, d, kept[d]) for d in "fb"], axis=2)
        p = _sigmoid(h @ self.w["o"] + self.w["o0"])
        n = mask.sum()
        loss = -float((np.log(np.where(y > 0, p, 1 - p) + 1e-9) * mask).sum() / n)
        e = ((p - y) * mask / n).astype(np.float32)
        grad = {"o": np.einsum("tb,tbh->h", e, h), "o0": e.sum(keepdims=True).reshape(1)}
        for k, d in enumerate("fb"):
            into = e[:, :, None] * self.w["o"][k * HIDDEN : (k + 1) * HIDDEN]
            gw, gb = np.zeros_like(self.w[d]), np.zeros_like(self.w[f"{d}0"])
            dh = np.zeros((x.shape[1], HIDDEN), np.float32)
            dc = np.zeros_like(dh)
            for t, i, f, o, g, th, h0, c0 in reversed(kept[d]):
                m = mask[t][:, None]
                dh = dh + into[t]
                a, b = dh * m, dc * m
                b = b + a * o * (1 - th * th)
                gates = np.concatenate([b * g * i * (1 - i), b * c0 * f * (1 - f), a * th * o * (1 - o), b * i * (1 - g * g)], axis=1)
                gw[:WIDTH] += x[t].T @ gates
                gw[WIDTH:] += h0.T @ gates
                gb += gates.sum(0)
                dh = gates @ self.w[d][WIDTH:].T + dh * ~m
                dc = b * f + dc * ~m
            grad |= {d: gw, f"{d}0": gb}
        return loss, grad

    def label(self, pages: list[np.ndarray], cells: int = 40_000) -> list[np.ndarray]:
        """For every page's leaves, whether they are main text.  Pages of like length run together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and len(pages[order[to]]) * (to + 1 - at) <= cells:
                to += 1
            x, mask = padded([pages[k] for k in order[at:to]])
            logit = self.logits(x, mask)
            for j, k in enumerate(order[at:to]):
                out[k] = logit[: len(pages[k]), j] > 0
            at = to
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), WIDTH), np.float32), np.zeros((steps, len(pages)), bool)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, True
    return x, mask


# ---- pages to learn from

_SYLLABLES = "an er th on in re ou es ti ing at ed is it al ar le or be sch keit ung lich que eau ment ción ado".split()
_BOXES = {
    "nav": (["<nav>", '<div class="nav">', '<ul class="menu">', '<div id="navigation">', '<div class="breadcrumb">', '<div role="navigation">', '<nav class="site-nav">'], "links"),
    "header": (["<header>", '<div class="header">', '<div id="masthead">', '<div class="site-header">', '<div class="topbar">'], "short"),
    "ad": (['<div class="ad">', '<div class="advert">', '<div class="ads">', '<aside class="sponsored">', '<div id="banner">', '<div class="promo">', '<div class="advertisement">'], "any"),
    "side": (["<aside>", '<div class="sidebar">', '<div id="sidebar">', '<div class="related">', '<div class="widget">', '<section class="related">', '<div class="share">', '<div class="newsletter">'], "mixed"),
    "notice": (['<div class="notice">', '<div class="cookie">', '<div id="cookie-banner">', '<div class="alert">', '<div class="consent">', '<div role="alert">', '<div class="popup">', "<noscript>", '<div class="paywall">'], "any"),
    "form": (["<form>", '<form class="search">', '<div class="subscribe"><form>', '<form id="login">'], "form"),
    "comments": (['<div class="comments">', '<section id="comments">', '<div id="disqus">', '<ol class="comment-list">', '<section class="comments">', '<div class="responses">'], "comments"),
    "footer": (["<footer>", '<div class="footer">', '<div id="footer">', '<div class="copyright">', '<footer class="site-footer">'], "short"),
}
_MAIN = ["<article>", "<main>", '<div class="content">', '<div id="content">', '<div class="post-body">', '<article class="post">', '<div class="entry-content">', "<main><article>", '<div class="article-body">', '<section class="story">', '<div role="main">', "<main><div>"]
_END = re.compile(r"<([a-z]+)")


def training_page(rng: np.random.Generator) -> str:
    """One page; every leaf of main text ends with the mark \\x01, which the trainer takes off."""
    pick = lambda some: some[int(rng.integers(len(some)))]
    word = lambda: "".join(pick(_SYLLABLES) for _ in range(rng.integers(1, 4)))

    def say(low: int, high: int) -> str:
        few = [word() for _ in range(rng.integers(1, 4))] if rng.random() < 0.1 else None  # a text may say the same over and over
        text = " ".join(pick(few) if few else word() for _ in range(int(rng.integers(low, high))))
        return (text.capitalize() if rng.random() < 0.8 else text.upper()) + pick([".", ".", ".", "", "!", " | ", "?"])

    def close(opening: str) -> str:
        return "".join(f"</{n}>" for n in reversed(_END.findall(opening)))

    def filler(kind: str) -> str:
        if kind == "links":
            items = [f'<a href="/{word()}">{say(1, 4)}</a>' for _ in range(rng.integers(2, 9))]
            return pick(["<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", " ".join(items), "".join(f"<div>{x}</div>" for x in items)])
        if kind == "form":
            return f'<label>{say(1, 3)}</label><input name="q"><p>{say(2, 12)}</p><button>{say(1, 3)}</button>'
        if kind == "comments":
            return "".join(f'<div class="comment"><b>{word()}</b><p>{say(3, 40)}</p></div>' if rng.random() < 0.6 else f"<p>{say(3, 40)}</p>" for _ in range(rng.integers(1, 6)))
        if kind == "short":
            return pick([f"&copy; {word()} {say(1, 8)}", f"<p>{say(1, 12)}</p>", f"<div>{say(1, 6)}</div>" + filler("links"), f"<h2>{say(1, 5)}</h2><p>{say(2, 15)}</p>"])
        if kind == "mixed":
            return "".join(filler(pick(["links", "short", "any"])) for _ in range(rng.integers(1, 4)))
        return pick([say(2, 30), f"<p>{say(2, 40)}</p>", f"<div><p>{say(2, 20)}</p><p>{say(2, 20)}</p></div>"])

    def box(kind: str) -> str:
        opening = pick(_BOXES[kind][0])
        body = filler(_BOXES[kind][1])
        return opening + body + close(opening)

    def paragraph() -> str:
        r = rng.random()
        text = say(1, 90)
        if r < 0.55:
            return f"<p>{text}\x01</p>"
        if r < 0.65:
            return f"<p><b>{text}\x01<br>"
        if r < 0.70:
            return f"<p>{say(3, 20)} <a href='/x'>{say(1, 4)}</a> {say(2, 20)}\x01</p>"
        if r < 0.76:
            return "<ul>" + "".join(f"<li>{say(2, 20)}\x01</li>" for _ in range(rng.integers(1, 5))) + "</ul>"
        if r < 0.82:
            return f"<h2>{say(1, 8)}\x01</h2>"
        if r < 0.86:
            return f"<blockquote>{text}\x01</blockquote>"
        if r < 0.90:
            return f"<div>{text}\x01</div>"
        if r < 0.94:
            return "<table><tr>" + "".join(f"<td>{say(1, 5)}\x01</td>" for _ in range(3)) + "</tr></table>"
        return pick([f"<pre>{text}\x01</pre>", f"<figure><figcaption>{text}\x01</figcaption></figure>", f"<section><h3>{say(1, 6)}\x01</h3><p>{text}\x01</p></section>"])

    main = pick(_MAIN)
    body = f"<h1>{say(1, 14)}\x01</h1>" if rng.random() < 0.8 else ""
    for _ in range(int(rng.integers(1, 14))):
        body += paragraph() if rng.random() < 0.85 else f"<p>{say(1, 7)}\x01</p>" * int(rng.integers(2, 22))
        if rng.random() < 0.1:
            body += box(pick(["ad", "side", "notice", "nav", "form"]))
    inside = box("comments") if rng.random() < 0.2 else ""
    before = "".join(box(k) for k in ("notice", "header", "nav", "ad", "form", "side") if rng.random() < (0.7 if k in ("nav", "ad") else 0.3))
    after = "".join(box(k) for k in ("ad", "side", "comments", "form", "nav", "notice", "footer") if rng.random() < (0.75 if k == "footer" else 0.25))
    opening = pick(["<body>", "<body>", '<body><div id="page">', '<body class="single"><div class="wrapper">', '<body><div class="container">'])
    return f"<html><head><title>{say(1, 12)}</title></head>{opening}{before}{main}{body}{inside}{close(main)}{after}"


@cache
def trained(seed: int = 10, pages: int = 1000, epochs: int = 9) -> Labeller:
    """The labeller, fitted with Adam.  A run takes seconds and gives the same weights again."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for _ in range(pages):
        some = leaves(training_page(rng))
        ys.append(np.array([leaf.text.endswith("\x01") for leaf in some], np.float32))
        for leaf in some:
            leaf.text = leaf.text.rstrip("\x01") or "."
        xs.append(vectors(some))
    net = Labeller(seed)
    first = {k: np.zeros_like(v) for k, v in net.w.items()}
    second = {k: np.zeros_like(v) for k, v in net.w.items()}
    step, batch = 0, 30
    for epoch in range(epochs):
        order = rng.permutation(pages)
        for at in range(0, pages, batch):
            chosen = order[at : at + batch]
            x, mask = padded([xs[k] for k in chosen])
            y = np.zeros(mask.shape, np.float32)
            for j, k in enumerate(chosen):
                y[: len(ys[k]), j] = ys[k]
            _, grad = net.gradients(x, mask, y)
            step += 1
            rate = 0.01 if epoch < epochs - 3 else 0.002
            for k, g in grad.items():
                g = np.clip(g, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                net.w[k] = (net.w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def weights(spark: SparkSession, seed: int = 10, pages: int = 1000, epochs: int = 9) -> dict[str, np.ndarray]:
    """The weights of trained(), learnt once for a shared folder: stored there under a name that tells of this file's own text, seed and sizes.

    The table is one file, so it is there whole or not at all; whoever comes second reads it, and both have learnt the same."""
    own = hashlib.sha256(f"{inspect.getsource(sys.modules[__name__])} {seed} {pages} {epochs}".encode()).hexdigest()[:24]
    path = f"{tables.shared_dir(spark)}/plumbline-labeller-{own}"
    schema = "name string, shape array<int>, body binary"
    try:
        rows = spark.read.schema(schema).parquet(path).collect()
    except AnalysisException:  # not there yet
        rows = []
    if rows:
        return {r["name"]: np.frombuffer(r["body"], np.float32).reshape(r["shape"]) for r in rows}
    made = trained(seed, pages, epochs).w
    spark.createDataFrame([(k, list(v.shape), v.astype(np.float32).tobytes()) for k, v in made.items()], schema).coalesce(1).write.mode("overwrite").parquet(path)
    return made


def extract(pages: list[str | None], net: Labeller) -> list[str]:
    cut = [leaves(p or "") for p in pages]
    flat = vectors([leaf for own in cut for leaf in own])
    ends = np.cumsum([len(own) for own in cut])
    kept = net.label([flat[b - len(own) : b] for own, b in zip(cut, ends.tolist(), strict=True)])
    return ["\n".join(leaf.text for leaf, ok in zip(own, k, strict=True) if ok) for own, k in zip(cut, kept, strict=True)]


def extract_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages without the html, with text and n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(weights(pages.sparkSession))
    kept = [f for f in pages.schema if f.name not in (column, "text", "n_chars")]
    added = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in kept] + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Labeller()
        net.w = shared.value
        for batch in by_bytes(batches, column, 2 << 20):
            texts = extract(batch.column(column).to_pylist(), net)
            columns = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema.names)

    return pages.select(*[f.name for f in kept], column).mapInArrow(run, schema)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return extract_text(tables.read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
