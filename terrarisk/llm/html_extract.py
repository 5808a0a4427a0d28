"""Main text of HTML pages by a recurrent block labeller.

A page is cut into leaf blocks (texts between block-level tags) in page order. Every block becomes a vector: hashed tags,
classes and ids of its tag path, hashed words, and its length, link share and punctuation. A bidirectional LSTM in numpy
reads all blocks of the page, so that each decision uses the whole document, and labels every block as main text or not.

The labeller is trained here, once in a process, on pages that a seeded generator writes with known labels: many layouts
of article, menu, header, footer, sidebar, notice, advert, form and comment blocks, with invented words. It is sent to
the workers as a closure (some hundred KB, of fixed size).

Defined results: null or empty html gives an empty text; a page without main blocks gives an empty text; text outside
any tag is a block; unclosed and stray tags are tolerated; repeated rows get equal results; no block is cut or left out
for its length; a column of the pages that is called text or n_chars is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Cache, map_batches, text_batches, with_columns

PATH_DIM, WORD_DIM, EXTRA = 96, 16, 6
HIDDEN = 20
TRAIN_PAGES = 700
EPOCHS = 14
#: Blocks that pass through the network at once; longer pages go alone.
BATCH_BLOCKS = 20_000

_BEGIN = re.compile(r"<(?:(!--)|[!?]|(/?)([A-Za-z][^\s/>]*))")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTRIBUTE = re.compile(r"(?i)\b(class|id|role|type|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_RAW = {"script", "style", "noscript", "template", "svg", "iframe", "object", "textarea", "math"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "input", "picture", "source"}
_ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul", "figure"}
_SAME = {"li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    out = [tag]
    if attributes:
        for key, a, b, c in _ATTRIBUTE.findall(attributes):
            out += [t for t in re.split(r"[^a-z]+", (a or b or c).lower()) if len(t) > 1] if key.lower() != "role" else [f"role-{(a or b or c).lower()}"]
    return tuple(out)


class Place:
    """A place in the tag tree: the sum of its ancestors' hashed names, its own included, and its own as a leaf."""

    __slots__ = ("path", "leaf")

    def __init__(self, path: np.ndarray, leaf: np.ndarray):
        self.path, self.leaf = path, leaf

    def vector(self) -> np.ndarray:
        return np.clip(self.path + self.leaf, -2, 2)


def _hashed(keys: list[str]) -> np.ndarray:
    out = np.zeros(PATH_DIM, np.float32)
    for key in keys:
        h = zlib.crc32(key.encode())
        out[h % PATH_DIM] += 1.0 if h >> 20 & 1 else -1.0
    return out


def _own(key: tuple[str, str]) -> tuple[np.ndarray, np.ndarray]:
    names = _names(*key)
    return _hashed([f"any {x}" for x in names]), _hashed([f"leaf {x}" for x in names])


_node = Cache(_own, __name__, 5000)
_ROOT = Place(np.zeros(PATH_DIM, np.float32), np.zeros(PATH_DIM, np.float32))


def blocks(page: str) -> list[tuple[Place, str, float]]:
    """(place, text, share of its characters in links) of every block that isn't blank, in page order.

    The time is linear in the page: open tags are known by their places, and after one tag with an unclosed quote, tags
    end at the next ">" whatever is quoted. A "<" without a ">" after it is text.
    """
    out: list = []
    stack: list[tuple[str, Place]] = []
    where: dict[str, list[int]] = {}  # the places of each open tag in the stack
    parts: list[str] = []
    linked, at, begin, loose, in_link = 0, 0, 0, False, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            out.append((stack[-1][1] if stack else _ROOT, text, min(1.0, linked / len(text))))
        parts.clear()
        linked = 0

    def cut(k: int) -> None:
        while len(stack) > k:
            where[stack.pop()[0]].pop()

    def last(tags: set[str]) -> int:
        return max((where[t][-1] for t in tags if where.get(t)), default=-1)

    def close(tags: set[str], stop: set[str]) -> None:
        k = last(tags)
        if k >= 0 and k > last(stop - tags):
            cut(k)

    _node.ready()
    while m := _BEGIN.search(page, begin):
        tag = m[3].lower() if m[3] else None
        given = ""
        if m[1]:
            k = page.find("-->", m.end())
            end = k + 3 if k >= 0 else len(page)
        else:
            rest = None if loose or not tag else _REST.match(page, m.end())
            loose = loose or (rest is None and tag is not None)
            end = rest.end() if rest else page.find(">", m.end()) + 1
            if not end:
                break
            given = page[m.end() : end - 1]
        if m.start() > at:
            piece = page[at : m.start()]
            parts.append(piece)
            if in_link:
                linked += len(piece)
        at = begin = end
        if tag is None:
            continue
        if m[2]:
            if tag not in _INLINE:
                flush()
            if tag == "a":
                in_link = 0
            if where.get(tag):
                cut(where[tag][-1])
            continue
        if tag in _RAW and not given.endswith("/"):
            over = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = begin = over.end() if over else len(page)
            if tag not in _INLINE:
                flush()
            continue
        if tag == "br":
            parts.append(" ")
        elif tag not in _INLINE:
            flush()
            if tag in _ENDS_P:
                close({"p"}, {"table", "td", "button"})
            if tag in _SAME:
                close(_SAME[tag], {"ul", "ol", "table", "select", "dl"})
        if tag not in _VOID:
            above = stack[-1][1] if stack else _ROOT
            if tag in _INLINE:
                place = above
            else:
                path, leaf = _node[(tag, given)] if len(given) < 200 else _own((tag, given))
                place = Place(above.path + path, leaf)
            where.setdefault(tag, []).append(len(stack))
            stack.append((tag, place))
            if tag == "a":
                in_link = 1
    parts.append(page[at:])
    flush()
    return out


_word = Cache(lambda w: zlib.crc32(w.encode()) % WORD_DIM, __name__)


def block_vectors(found: list) -> np.ndarray:
    out = np.zeros((len(found), PATH_DIM + WORD_DIM + EXTRA), np.float32)
    _word.ready()
    for i, (place, text, linked) in enumerate(found):
        words = text.split()
        out[i, :PATH_DIM] = place.vector()
        out[i, PATH_DIM : PATH_DIM + WORD_DIM] = np.bincount(np.fromiter(map(_word.__getitem__, words), np.int64, len(words)), minlength=WORD_DIM) / len(words)
        ends = text.count(".") + text.count("!") + text.count("?") + text.count(",")
        out[i, PATH_DIM + WORD_DIM :] = (np.log1p(len(words)) / 4, min(2.0, len(text) / 400), linked, min(1.0, ends / len(words)), text[-1] in ".!?\"'”", i / max(1, len(found) - 1))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Lstm:
    """One direction, over batches padded to [time, page, feature]; mask is 1 where there is a block."""

    def __init__(self, size: int, hidden: int, rng: np.random.Generator):
        self.w = (rng.standard_normal((size + hidden, 4 * hidden)) / np.sqrt(size + hidden)).astype(np.float32)
        self.b = np.zeros(4 * hidden, np.float32)
        self.b[hidden : 2 * hidden] = 1
        self.size = size

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        steps, pages = x.shape[:2]
        n = self.b.size // 4
        given = x.reshape(-1, self.size) @ self.w[: self.size] + self.b
        given = given.reshape(steps, pages, -1)
        h, c = np.zeros((pages, n), np.float32), np.zeros((pages, n), np.float32)
        out = np.empty((steps, pages, n), np.float32)
        for t in range(steps):
            z = given[t] + h @ self.w[self.size :]
            i, f, o = np.split(_sigmoid(z[:, : 3 * n]), 3, 1)
            g = np.tanh(z[:, 3 * n :])
            m = mask[t][:, None]
            new_c = f * c + i * g
            tanh_c = np.tanh(new_c)
            if keep is not None:
                keep.append((h, c, i, f, o, g, tanh_c, m))
            c = m * new_c + (1 - m) * c
            h = m * (o * tanh_c) + (1 - m) * h
            out[t] = h
        return out

    def backward(self, x: np.ndarray, d_out: np.ndarray, keep: list) -> tuple[np.ndarray, np.ndarray]:
        dw, db = np.zeros_like(self.w), np.zeros_like(self.b)
        dh_next, dc_next = 0.0, 0.0
        for t in range(len(keep) - 1, -1, -1):
            h, c, i, f, o, g, tanh_c, m = keep[t]
            dh = d_out[t] + dh_next
            d_new = dh * m
            dc = d_new * o * (1 - tanh_c**2) + dc_next * m
            dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), d_new * tanh_c * o * (1 - o), dc * i * (1 - g**2)], 1)
            dw[: self.size] += x[t].T @ dz
            dw[self.size :] += h.T @ dz
            db += dz.sum(0)
            dh_next = dz @ self.w[self.size :].T + dh * (1 - m)
            dc_next = dc * f + dc_next * (1 - m)
        return dw, db


@dataclass
class Labeller:
    ahead: Lstm
    back: Lstm
    out: np.ndarray  # the last weight is the bias

    def probabilities(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page, the probability that each of its blocks is main text."""
        result: list = [np.zeros(0)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        group: list[int] = []
        for k in [*order, None]:
            if k is None or (group and len(pages[k]) * (len(group) + 1) > BATCH_BLOCKS):
                if group:
                    x, mask = padded([pages[j] for j in group])
                    p = _sigmoid(self.states(x, mask) @ self.out[:-1] + self.out[-1])
                    for col, j in enumerate(group):
                        result[j] = p[: len(pages[j]), col]
                group = []
            if k is not None:
                group.append(k)
        return result

    def states(self, x: np.ndarray, mask: np.ndarray, keep: tuple[list, list] | None = None) -> np.ndarray:
        a = self.ahead.forward(x, mask, keep[0] if keep else None)
        b = self.back.forward(x[::-1], mask[::-1], keep[1] if keep else None)[::-1]
        return np.concatenate([a, b], 2)


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x = np.zeros((steps, len(pages), pages[0].shape[1]), np.float32)
    mask = np.zeros((steps, len(pages)), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, 1
    return x, mask


# Names that pages commonly give to their parts.
MAIN_NAMES = "content post entry article story body main text page news prose copy".split()
ASIDE_NAMES = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs toc links tabs pagination".split(),
    "header": "header masthead banner top topbar branding logo tagline site hero".split(),
    "footer": "footer foot copyright legal bottom colophon imprint".split(),
    "sidebar": "sidebar aside side widget related recommended popular trending more rail teaser secondary".split(),
    "notice": "notice cookie cookies consent alert warning gdpr banner popup modal overlay disclaimer paywall message toast".split(),
    "ad": "ad ads advert advertisement sponsored sponsor promo promotion banner adsbox commercial".split(),
    "form": "form search login signup newsletter subscribe contact register subscription".split(),
    "comments": "comments comment replies reply discussion disqus responses thread commentlist reader feedback review".split(),
    "share": "share social sharing tags meta byline author buttons tools toolbar".split(),
}


def made_page(r: random.Random) -> tuple[str, list[bool]]:
    """A page and, for each of its blocks in order, whether it is main text."""
    syllables = [r.choice("bcdfghjklmnprstvwz") + r.choice(["a", "e", "i", "o", "u", "en", "er", "an"]) for _ in range(30)]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    labels: list[bool] = []

    def sentence(low: int, high: int) -> str:
        w = [word() for _ in range(r.randint(low, high))]
        return " ".join([w[0].capitalize(), *w[1:]]) + r.choice(["."] * 6 + ["!", "?", ""])

    def prose(sentences: int) -> str:
        return " ".join(sentence(3, 16) for _ in range(r.randint(1, sentences)))

    def block(tag: str, text: str, main: bool, extra: str = "") -> str:
        labels.append(main)
        end = f"</{tag}>" if r.random() < 0.93 or tag not in ("p", "li", "td") else ""
        return f"<{tag}{extra}>{text}{end}"

    def named(kind: str) -> str:
        names = ASIDE_NAMES[kind]
        how = r.random()
        if how < 0.2:
            return ""
        value = r.choice(names) if how < 0.6 else f"{r.choice(['site', 'page', 'block', 'box', 'wrap', 'c', 'l'])}-{r.choice(names)}"
        return f' {r.choice(["class", "class", "id"])}="{value}"'

    def wrapped(tag: str, attributes: str, inner: list[str]) -> str:
        return f"<{tag}{attributes}>{''.join(inner)}</{tag}>"

    def links(n: int) -> list[str]:
        return ["<ul>", *[block("li", f'<a href="/{word()}">{word()}</a>', False) for _ in range(n)], "</ul>"] if r.random() < 0.8 else [block("div", " ".join(f'<a href="/{word()}">{word()}</a>' for _ in range(n)), False)]

    def aside(kind: str) -> str:
        tag = {"nav": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}.get(kind)
        attributes = named(kind)
        if not tag or (attributes and r.random() < 0.5):
            tag = r.choice(["div", "section"]) if tag is None or attributes else tag
            while not attributes:
                attributes = named(kind)
        if kind == "nav":
            inner = links(r.randint(2, 9))
        elif kind == "form":
            inner = [block("p", sentence(1, 6), False), block("div", f"<label>{word()}</label><input type=text> <span>{word()}</span>", False), block("button", word(), False)]
        elif kind == "comments":
            inner = [block("h3", word(), False)] + [block(r.choice(["p", "div", "li"]), prose(r.choice([1, 3, 6])), False) for _ in range(r.randint(1, 6))]
        elif kind == "footer":
            bare = r.random() < 0.5
            if bare:
                labels.append(False)
            inner = [f"&copy; {word()}.example &middot; {prose(2)}"] if bare else [block("p", f"&copy; {prose(2)}", False), *links(r.randint(1, 4))]
        elif kind == "sidebar":
            inner = [block("h3", sentence(1, 4), False), *links(r.randint(2, 5))] if r.random() < 0.5 else [block("h4", word(), False), block("p", prose(4), False)]
        else:
            bare = r.random() < 0.5
            if bare:
                labels.append(False)
            inner = [prose(3)] if bare else [block(r.choice(["p", "span", "div", "h2"]) if kind != "share" else "div", prose(2), False) for _ in range(r.randint(1, 2))]
            if not bare:
                labels[:] = labels  # spans stand alone in their box: one block each is forced by the wrapper below
                inner = [f"<div>{x}</div>" for x in inner]
        return wrapped(tag, attributes, inner)

    def article() -> str:
        inner = []
        if r.random() < 0.8:
            inner.append(block("h1", sentence(3, 12), True))
        for _ in range(r.choice([1, 2, 3, 5, 8, 14])):
            k = r.random()
            if k < 0.72:
                text = prose(r.choice([1, 1, 2, 4, 8]))
                text = f"<b>{text}<br>" if r.random() < 0.15 else text if r.random() < 0.8 else f'{text} <a href="/x">{word()}</a> {word()} <em>{word()}</em>.'
                inner.append(block("p", text, True))
            elif k < 0.82:
                inner.append(block(r.choice(["h2", "h3"]), sentence(1, 7), True))
            elif k < 0.9:
                tag = r.choice(["ul", "ol"])
                inner.append(f"<{tag}>" + "".join(block("li", sentence(2, 12), True) for _ in range(r.randint(1, 5))) + f"</{tag}>")
            elif k < 0.94:
                inner.append("<blockquote>" + block("p", prose(3), True) + "</blockquote>")
            elif k < 0.97:
                inner.append(block("pre", " ".join(word() for _ in range(9)), True))
            else:
                inner.append(aside(r.choice(["ad", "share", "notice"])))
        how = r.random()
        if how < 0.55:
            return wrapped("article", f' class="{r.choice(MAIN_NAMES)}"' if r.random() < 0.3 else "", inner)
        if how < 0.7:
            return wrapped("main", "", inner)
        return wrapped(r.choice(["div", "section"]), f' {r.choice(["class", "id"])}="{r.choice(MAIN_NAMES)}{r.choice(["", "-" + r.choice(MAIN_NAMES)])}"', inner)

    labels.append(False)
    head = f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{sentence(3, 10)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>'
    before = [k for k in ("header", "nav", "notice", "ad", "form") if r.random() < 0.4]
    r.shuffle(before)
    after = [k for k in ("comments", "sidebar", "ad", "form", "share", "nav", "notice") if r.random() < 0.35]
    r.shuffle(after)
    page = [aside(k) for k in before]
    body = article()
    page.append(f"<div class=\"{r.choice(['wrap', 'container', 'row', 'layout'])}\">{body}</div>" if r.random() < 0.2 else body)
    page += [aside(k) for k in after]
    if r.random() < 0.8:
        page.append(aside("footer"))
    return head + "<!-- ad 1 -->" * (r.random() < 0.3) + "".join(page) + "</body></html>", labels


def train(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = 11) -> Labeller:
    r, rng = random.Random(seed), np.random.default_rng(seed)
    data = []
    while len(data) < pages:
        page, labels = made_page(r)
        found = blocks(page)
        if len(found) == len(labels):  # pages on which markup joined blocks teach nothing certain
            data.append((block_vectors(found), np.array(labels, np.float32)))
    size = PATH_DIM + WORD_DIM + EXTRA
    model = Labeller(Lstm(size, HIDDEN, rng), Lstm(size, HIDDEN, rng), np.zeros(2 * HIDDEN + 1, np.float32))
    weights = [model.ahead.w, model.ahead.b, model.back.w, model.back.b, model.out]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    model.out[:-1] = rng.standard_normal(2 * HIDDEN) * 0.1
    step = 0
    for epoch in range(epochs):
        for group in np.array_split(rng.permutation(len(data)), max(1, len(data) // 32)):
            x, mask = padded([data[k][0] for k in group])
            y = np.zeros_like(mask)
            for col, k in enumerate(group):
                y[: len(data[k][1]), col] = data[k][1]
            keep: tuple[list, list] = ([], [])
            s = model.states(x, mask, keep)
            d = (_sigmoid(s @ model.out[:-1] + model.out[-1]) - y) * mask / mask.sum()
            ds = d[..., None] * model.out[:-1]
            gradients = [*model.ahead.backward(x, ds[..., :HIDDEN], keep[0]), *model.back.backward(x[::-1], ds[::-1, :, HIDDEN:], keep[1]), np.append(np.tensordot(d, s, ([0, 1], [0, 1])), d.sum())]
            step += 1
            rate = 0.01 if epoch < epochs * 2 // 3 else 0.003
            for w, g, a, b in zip(weights, gradients, first, second):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                w -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return model


@lru_cache(1)
def labeller() -> Labeller:
    return train()


def extract_texts(pages: list[str | None], model: Labeller) -> list[str]:
    found = [blocks(p) if p else [] for p in pages]
    chances = model.probabilities([block_vectors(f) for f in found])
    return ["\n\n".join(text for (_, text, _), p in zip(f, c) if p >= 0.5) for f, c in zip(found, chances)]


def extract_main_text(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """pages (with html) plus text and n_chars, without html."""
    text_batches(pages.sparkSession)
    model = model or labeller()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        column = batch.column("html").to_pylist()
        for k in range(0, len(column), 500):
            texts += extract_texts(column[k : k + 500], model)
        return with_columns(batch, {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    kept = [f for f in pages.schema if f.name not in ("text", "n_chars")]
    return map_batches(pages, run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "text string, n_chars long"])).drop("html")
