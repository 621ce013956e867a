"""Main text of web pages by a recurrent labeller of blocks.

A page is cut into blocks: runs of text between block-level tags, in page order, with the tags and the
class, id and role words above them.  A block's vector holds the hashed path, its hashed words and a few
figures (length, share of links, place in the page).  A bidirectional LSTM in numpy reads all blocks of
the document in both directions and labels each as main text or not; the main blocks are joined by line
breaks.

The network is trained at the start on generated pages, whose labels are known by construction: many
layouts, with and without telling tags, filled with words of a bounded sample of the table
(``SAMPLE_PAGES`` pages).  Training is seeded and single-threaded per page batch, so reruns agree.

Text in head, title, script, style, noscript, template, textarea, select, datalist, svg, canvas, iframe
and comments is never a block.  Script, style, textarea and title without an end tag run to the end of
the page; the others end with their parent, and a paragraph, list or the like also ends select, datalist
and svg.  Null and empty html give an empty text; broken markup is read as far as it goes.  Repeated rows
and ids are rows of their own, an empty table gives no rows, and only id, url and html are read, so further
columns and their names don't matter.  Pages of any length and depth are read whole, in time and memory in
proportion to them; memory is bounded by a group of pages of about ``GROUP_BLOCKS`` blocks or the longest page.
"""

from __future__ import annotations

import html as entities
import math
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jaccard import word_hashes

SAMPLE_PAGES = 64
TRAIN_PAGES = 800
EPOCHS = 16
HIDDEN = 24
GROUP_BLOCKS = 4000

# --- Blocks -------------------------------------------------------------------------------------

RAW = frozenset("script style textarea title".split())
SKIPPED = frozenset("noscript template select datalist svg canvas iframe".split())
#: Of these, what cannot hold a block; an opening block ends it.
BLOCKLESS = frozenset("select datalist svg".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code del dfn em font i img input ins kbd label mark meter nobr output q s samp "
    "small span strike strong sub sup time tt u var wbr data ruby rt rp link meta object "
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose mfenced msub msup msubsup "
    "munder mover munderover mmultiscripts mprescripts none mtable mtr mlabeledtr mtd maction semantics annotation annotation-xml".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()
)
# An opening tag ends open elements of these names, up to the nearest of the second list.
IMPLIED = {
    "li": ("li", "ul ol menu"),
    "dt": ("dt dd", "dl"),
    "dd": ("dt dd", "dl"),
    "tr": ("tr td th", "table"),
    "td": ("td th", "tr table"),
    "th": ("td th", "tr table"),
    "option": ("option", "select"),
}

# Quotes count only directly behind an equals sign; elsewhere they are letters of a name or value.
_VALUE = r"""(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*+)"""
_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    rf"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+{_VALUE})?+)*+)(?:>|\Z)"
    r"|<[a-zA-Z/!?][^>]*(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*+)))?+""")
_PART = re.compile(r"[a-z]+")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


PATH_CELLS = 256
_END_OF = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in RAW}
_BEHIND_HEAD = re.compile(r"</head\s*>|<body[\s>]", re.I)


@lru_cache(maxsize=20_000)
def _cell(word: str) -> int:
    return zlib.crc32(word.encode()) % PATH_CELLS


class Element:
    """An open element.  Elements below share it, so a path costs one step however deep it is.

    ``mask`` holds the hash cells of all words on the path as bits, ``last`` its last two words.
    """

    __slots__ = ("name", "parent", "words", "mask", "last", "link")

    def __init__(self, name: str, parent: Element | None, words: tuple[str, ...] = (), link: bool = False):
        self.name, self.parent, self.link = name, parent, link
        self.words = () if name in ("html", "body") else (name, *words)
        self.mask, self.last = (parent.mask, parent.last) if parent else (0, ())
        for word in self.words:
            self.mask |= 1 << _cell(word)
        self.last = (*self.last, *self.words)[-2:]

    @property
    def path(self) -> tuple[str, ...]:
        found, element = [], self
        while element:
            found.append(element.words)
            element = element.parent
        return tuple(word for words in reversed(found) for word in words)


class Open:
    """The stack of open elements, with the places of each name, so that no search walks the stack."""

    def __init__(self) -> None:
        self.stack: list[Element] = []
        self.places: dict[str, list[int]] = {}
        self.block_places: list[int] = []
        self.links = 0

    @property
    def top(self) -> Element:
        return self.stack[-1] if self.stack else ROOT

    def push(self, name: str, words: tuple[str, ...] = (), link: bool = False) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        if name not in INLINE:
            self.block_places.append(len(self.stack))
        self.stack.append(Element(name, self.top, words, link))
        self.links += link

    def pop_to(self, index: int) -> None:
        while len(self.stack) > index:
            element = self.stack.pop()
            self.places[element.name].pop()
            if element.name not in INLINE:
                self.block_places.pop()
            self.links -= element.link

    def last(self, *names: str) -> int:
        """Place of the innermost element of these names, -1 if none is open."""
        return max((own[-1] for name in names if (own := self.places.get(name))), default=-1)

    def first_behind(self, place: int, *names: str) -> int:
        """Place of the outermost element of these names behind ``place``, -1 if there is none."""
        found = []
        for name in names:
            own = self.places.get(name, [])
            at = bisect_right(own, place)
            found += own[at : at + 1]
        return min(found, default=-1)

    @property
    def last_block(self) -> int:
        return self.block_places[-1] if self.block_places else -1


ROOT = Element("html", None)


@dataclass
class Block:
    element: Element
    text: str
    linked: int  # characters inside links

    @property
    def path(self) -> tuple[str, ...]:
        return self.element.path


def _words_of_attributes(rest: str) -> tuple[str, ...]:
    if not rest or rest.isspace():
        return ()
    found = []
    for m in _ATTRIBUTE.finditer(rest):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            found += [f".{w}" for w in _PART.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())]
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDING.search(value)):
            found.append(".hidden")
    return tuple(found)


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order."""
    out: list[Block] = []
    opened = Open()
    parts: list[str] = []
    element = ROOT  # of the text gathered so far
    linked = 0
    skip: int | None = None  # place in the stack of the outermost skipped element
    at, size, heads = 0, len(page), True

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append(Block(element, text, linked))
            parts.clear()
        linked = 0

    def pop_to(index: int) -> None:
        nonlocal skip
        if skip is not None and index <= skip:
            skip = None
        opened.pop_to(index)

    while at < size:
        m = _TOKEN.match(page, at)
        at = m.end()
        if (text := m["text"]) is not None:
            if skip is not None:
                continue
            if not parts:
                element = opened.top
            parts.append(text)
            if opened.links:
                linked += len(text)
            continue
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["close"]:
            inline = name in INLINE
            found = opened.last(*HEADINGS) if name in HEADINGS else opened.last(name)
            if inline and found < opened.last_block:
                found = -1
            inside = skip is not None and (found < 0 or found >= skip)
            if not inline and not inside:
                flush()
            if found >= 0:
                pop_to(found)
            continue
        if name in RAW:
            end = _END_OF[name].search(page, at)
            at = end.end() if end else size
            continue
        if skip is not None and opened.stack[skip].name in BLOCKLESS and name in CLOSES_PARAGRAPH - {"hr"}:
            if opened.last("foreignobject") < skip:
                pop_to(skip)
        if skip is not None or name in SKIPPED:
            if skip is not None and name in IMPLIED:
                # A cell, row or item that ends one around the skipped element ends that as well.
                own, limits = (x.split() for x in IMPLIED[name])
                outer = opened.last(*own)
                if opened.last(*limits) < outer < skip and opened.stack[skip].name in BLOCKLESS:
                    flush()
                    pop_to(skip)
            if skip is not None or name in SKIPPED:
                if name not in VOID and not m["rest"].endswith("/"):
                    if skip is None:
                        skip = len(opened.stack)
                    opened.push(name)
                continue
        if name == "head":
            # A head that never ends holds only what may stand in a head.
            end = _BEHIND_HEAD.search(page, at) if heads else None
            heads = end is not None
            if end:
                at = end.start()
            continue
        if name == "br":
            if not parts:
                element = opened.top
            parts.append(" ")
            continue
        if name not in INLINE:
            flush()
            if name in CLOSES_PARAGRAPH and (last := opened.last_block) >= 0 and opened.stack[last].name == "p":
                pop_to(last)
            if name in IMPLIED:
                own, limits = (x.split() for x in IMPLIED[name])
                limit = opened.last(*limits)
                ended = opened.first_behind(limit, *own) if name == "tr" else opened.last(*own)
                if ended > limit:
                    pop_to(ended)
        if name in VOID or m["rest"].endswith("/"):
            continue
        opened.push(name, _words_of_attributes(m["rest"]), name == "a")
    flush()
    return out


# --- Vectors ------------------------------------------------------------------------------------

LAST_CELLS, WORD_CELLS, FIGURES = 64, 64, 9
WIDTH = PATH_CELLS + LAST_CELLS + WORD_CELLS + FIGURES


def _path_row(element: Element, row: np.ndarray) -> None:
    row[:PATH_CELLS] = np.unpackbits(np.frombuffer(element.mask.to_bytes(PATH_CELLS // 8, "little"), dtype=np.uint8), bitorder="little")
    for word in element.last:
        row[PATH_CELLS + zlib.crc32(word.encode() + b"!") % LAST_CELLS] = 1


def vectors_of(pages: list[list[Block]]) -> list[np.ndarray]:
    """A matrix of block vectors for every page."""
    flat = [block for page in pages for block in page]
    out = np.zeros((len(flat), WIDTH), dtype=np.float32)
    if flat:
        hashes, counts = word_hashes([block.text for block in flat])
        owner = np.repeat(np.arange(len(flat)), counts)
        cells = owner * WORD_CELLS + (hashes >> np.uint64(58)).astype(np.int64)
        bags = np.bincount(cells, minlength=len(flat) * WORD_CELLS).reshape(len(flat), WORD_CELLS)
        out[:, PATH_CELLS + LAST_CELLS : -FIGURES] = np.log1p(bags) / np.sqrt(1 + counts)[:, None]
    at = 0
    for page in pages:
        for k, block in enumerate(page):
            row = out[at]
            _path_row(block.element, row)
            size, text = len(block.text), block.text
            row[-FIGURES:] = (
                math.log1p(size) / 8, min(1.0, block.linked / size), k / max(1, len(page) - 1), 1 / (k + 1), len(page) / (len(page) + 30),
                text[-1] in ".!?:…。", size < 40, any(c in text for c in "©·|»"), sum(c.isdigit() for c in text) / size,
            )
            at += 1
    cuts = np.cumsum([len(page) for page in pages])
    return np.split(out, cuts[:-1]) if pages else []


# --- Network ------------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Labeller:
    """Two LSTMs, one for each direction, and a logistic layer on both states."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int = 0) -> Labeller:
        rng = np.random.default_rng(seed)
        weights = {}
        for side in "lr":
            weights[f"x{side}"] = rng.normal(0, 0.1, (WIDTH, 4 * HIDDEN)).astype(np.float32)
            weights[f"h{side}"] = rng.normal(0, 1 / math.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            weights[f"b{side}"] = np.zeros(4 * HIDDEN, dtype=np.float32)
            weights[f"b{side}"][HIDDEN : 2 * HIDDEN] = 1
        weights["out"] = rng.normal(0, 0.1, (2 * HIDDEN, 1)).astype(np.float32)
        weights["direct"] = np.zeros((WIDTH, 1), dtype=np.float32)
        weights["bias"] = np.zeros(1, dtype=np.float32)
        return cls(weights)

    @staticmethod
    def stack(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Blocks by step and page, and for each step the step it has when read backwards."""
        longest = max(len(p) for p in pages)
        x = np.zeros((longest, len(pages), WIDTH), dtype=np.float32)
        mirror = np.tile(np.arange(longest)[:, None], (1, len(pages)))
        for k, page in enumerate(pages):
            x[: len(page), k] = page
            mirror[: len(page), k] = np.arange(len(page))[::-1]
        return x, mirror

    def _read(self, x: np.ndarray, side: str, keep: bool = True):
        projected = x @ self.weights[f"x{side}"] + self.weights[f"b{side}"]
        recurrent, n = self.weights[f"h{side}"], HIDDEN
        h = np.zeros((x.shape[1], n), dtype=np.float32)
        c = np.zeros_like(h)
        states = np.empty((len(x), x.shape[1], n), dtype=np.float32)
        kept = []
        for t in range(len(x)):
            z = projected[t] + h @ recurrent
            gates = _sigmoid(z)
            new = np.tanh(z[:, 2 * n : 3 * n])
            before = c
            c = gates[:, n : 2 * n] * before + gates[:, :n] * new
            bent = np.tanh(c)
            if keep:
                kept.append((h, before, gates, new, bent))
            h = gates[:, 3 * n :] * bent
            states[t] = h
        return states, kept

    def _read_back(self, x: np.ndarray, kept, slope: np.ndarray, side: str, grads: dict[str, np.ndarray]) -> None:
        recurrent, n = self.weights[f"h{side}"], HIDDEN
        dz = np.empty((len(x), x.shape[1], 4 * n), dtype=np.float32)
        dh_next = np.zeros((x.shape[1], n), dtype=np.float32)
        dc_next = np.zeros_like(dh_next)
        grad_h = np.zeros_like(recurrent)
        for t in range(len(x) - 1, -1, -1):
            h, before, gates, new, bent = kept[t]
            i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 3 * n :]
            dh = slope[t] + dh_next
            dc = dc_next + dh * o * (1 - bent * bent)
            step = dz[t]
            step[:, :n] = dc * new * i * (1 - i)
            step[:, n : 2 * n] = dc * before * f * (1 - f)
            step[:, 2 * n : 3 * n] = dc * i * (1 - new * new)
            step[:, 3 * n :] = dh * bent * o * (1 - o)
            grad_h += h.T @ step
            dh_next = step @ recurrent.T
            dc_next = dc * f
        grads[f"x{side}"] = x.reshape(-1, WIDTH).T @ dz.reshape(-1, 4 * n)
        grads[f"h{side}"] = grad_h
        grads[f"b{side}"] = dz.sum(axis=(0, 1))

    def logits(self, x: np.ndarray, mirror: np.ndarray):
        columns = np.arange(x.shape[1])
        left, kept_left = self._read(x, "l")
        turned = x[mirror, columns]
        right, kept_right = self._read(turned, "r")
        both = np.concatenate([left, right[mirror, columns]], axis=2)
        score = both @ self.weights["out"] + x @ self.weights["direct"] + self.weights["bias"]
        return score[..., 0], (both, turned, kept_left, kept_right)

    def page_logits(self, page: np.ndarray) -> np.ndarray:
        """Of one page, in memory of a few figures a block."""
        x = page[:, None]
        both = np.concatenate([self._read(x, "l", False)[0], self._read(x[::-1], "r", False)[0][::-1]], axis=2)[:, 0]
        return (both @ self.weights["out"] + page @ self.weights["direct"] + self.weights["bias"])[:, 0]

    def train(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int, seed: int = 0, batch: int = 32) -> None:
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(w) for k, w in self.weights.items()}
        second = {k: np.zeros_like(w) for k, w in self.weights.items()}
        turn, turns = 0, epochs * -(-len(pages) // batch)
        by_length = sorted(range(len(pages)), key=lambda k: len(pages[k]))
        batches = [by_length[k : k + batch] for k in range(0, len(by_length), batch)]
        for _ in range(epochs):
            for number in rng.permutation(len(batches)):
                chosen = batches[number]
                x, mirror = self.stack([pages[k] for k in chosen])
                want, weigh = np.zeros(x.shape[:2], dtype=np.float32), np.zeros(x.shape[:2], dtype=np.float32)
                for column, k in enumerate(chosen):
                    want[: len(labels[k]), column] = labels[k]
                    weigh[: len(labels[k]), column] = 1
                # Some path words are left out, so that no single one decides.
                x[:, :, : PATH_CELLS + LAST_CELLS] *= rng.random((1, x.shape[1], PATH_CELLS + LAST_CELLS)) > 0.1
                score, (both, turned, kept_left, kept_right) = self.logits(x, mirror)
                slope = (_sigmoid(score) - want) * weigh / weigh.sum()
                grads = {
                    "out": (both * slope[..., None]).sum(axis=(0, 1))[:, None],
                    "direct": (x.reshape(-1, WIDTH).T @ slope.reshape(-1, 1)) + 1e-5 * self.weights["direct"],
                    "bias": np.array([slope.sum()], dtype=np.float32),
                }
                states = slope[..., None] * self.weights["out"][:, 0]
                columns = np.arange(x.shape[1])
                self._read_back(x, kept_left, states[..., :HIDDEN], "l", grads)
                self._read_back(turned, kept_right, states[..., HIDDEN:][mirror, columns], "r", grads)
                turn += 1
                rate = 0.01 * (1 - turn / (turns + 1)) + 1e-4
                norm = math.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                for k, g in grads.items():
                    g = g * min(1.0, 5.0 / (norm + 1e-9))
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.weights[k] = (
                        self.weights[k] - rate * (first[k] / (1 - 0.9**turn)) / (np.sqrt(second[k] / (1 - 0.999**turn)) + 1e-8)
                    ).astype(np.float32)

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Probability that a block is main text, for every block of every page."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        group: list[int] = []
        for place, k in enumerate(order):
            group.append(k)
            following = len(pages[order[place + 1]]) if place + 1 < len(order) else 0
            if len(group) == 1 and (not following or following * 2 > GROUP_BLOCKS):
                out[k] = _sigmoid(self.page_logits(pages[k]))
                group = []
            elif not following or following * (len(group) + 1) > GROUP_BLOCKS:
                x, mirror = self.stack([pages[j] for j in group])
                score, _ = self.logits(x, mirror)
                for column, j in enumerate(group):
                    out[j] = _sigmoid(score[: len(pages[j]), column])
                group = []
        return out


# --- Pages to learn from --------------------------------------------------------------------------

_MARK = "\ue000"  # stands in front of main text while training pages are made

_COMMON = {
    "menu": "home about contact news products services login register search blog help shop archive sitemap".split(),
    "footer": "copyright all rights reserved privacy policy terms imprint contact powered by".split(),
    "notice": "we use cookies to improve this site accept decline settings subscribe newsletter consent agree".split(),
    "ad": "advertisement sponsored buy now offer sale discount click here".split(),
    "comment": "reply posted on said comments leave a comment report like".split(),
    "form": "name email password submit send your message search go".split(),
    "side": "related recent popular posts tags categories follow us share more read next".split(),
}
_NAMES = {
    "main": ("content", "main", "main-content", "post", "post-body", "entry", "entry-content", "article", "article-body", "story", "text", "body-text", "page-content"),
    "menu": ("nav", "menu", "navbar", "main-menu", "topnav", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager"),
    "head": ("header", "site-header", "masthead", "top", "banner", "branding", "topbar"),
    "footer": ("footer", "site-footer", "bottom", "copyright", "legal", "colophon", "foot"),
    "notice": ("cookie", "cookie-banner", "notice", "alert", "consent", "gdpr", "newsletter", "popup", "modal", "subscribe", "paywall", "message"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "promotion", "banner-ad", "adbox", "sponsor"),
    "comment": ("comments", "comment", "comment-list", "commentlist", "responses", "replies", "disqus", "discussion", "reader-comments"),
    "side": ("sidebar", "side", "aside", "widget", "related", "recommended", "rail", "widgets", "share", "social", "tags", "author-box", "meta"),
    "form": ("search", "login", "signup", "contact-form", "form"),
}


class PageMaker:
    """Makes pages of many layouts, main text marked."""

    def __init__(self, words: list[str], seed: int):
        self.rng = np.random.default_rng(seed)
        self.words = words or [w for group in _COMMON.values() for w in group]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def pick(self, items):
        return items[int(self.rng.integers(len(items)))]

    def say(self, low: int, high: int, group: str | None = None) -> str:
        size = int(np.exp(self.rng.uniform(np.log(low), np.log(high + 1))))
        own = _COMMON.get(group or "", self.words)
        words = [self.pick(own if group and self.chance(0.3) else self.words) for _ in range(max(1, size))]
        text = " ".join(words)
        if self.chance(0.6):
            text = text[:1].upper() + text[1:]
        return entities.escape(text + (self.pick([".", ".", "!", "?", ""]) if self.chance(0.75) else ""))

    def attribute(self, group: str, p: float = 0.85) -> str:
        if not self.chance(p):
            return ""
        key = self.pick(["class", "class", "id", "role"]) if group != "ad" else self.pick(["class", "class", "id"])
        extra = f" {self.pick(['clearfix', 'row', 'col', 'box', 'wrap', 'inner', 'block'])}" if self.chance(0.3) else ""
        return f' {key}="{self.pick(_NAMES[group])}{extra}"'

    def links(self, group: str, mark: str = "") -> str:
        items = [f'<li{"" if self.chance(0.9) else " class=item"}><a href="/x">{self.say(1, 3, group)}</a></li>' for _ in range(int(self.rng.integers(2, 9)))]
        return f"<ul>{''.join(items)}</ul>"

    def menu(self) -> str:
        if self.chance(0.6):
            return f"<nav{self.attribute('menu', 0.4)}>{self.links('menu')}</nav>"
        if self.chance(0.3):
            return f"<div{self.attribute('menu', 1)}>" + self.pick([" | ", " &raquo; ", " "]).join(f'<a href="/">{self.say(1, 2, "menu")}</a>' for _ in range(5)) + "</div>"
        return f"<div{self.attribute('menu', 1)}>{self.links('menu')}</div>"

    def head(self) -> str:
        tag = self.pick(["header", "header", "div"])
        inner = self.pick([f"<a href='/'>{self.say(1, 4)}</a>", f"<h1>{self.say(1, 4)}</h1>", f"<div>{self.say(1, 3)}</div>"])
        inner += f"<p>{self.say(2, 10)}</p>" if self.chance(0.4) else ""
        inner += self.menu() if self.chance(0.4) else ""
        return f"<{tag}{self.attribute('head', 0.4 if tag == 'header' else 1)}>{inner}{self.form() if self.chance(0.2) else ''}</{tag}>"

    def footer(self) -> str:
        tag = self.pick(["footer", "footer", "div"])
        sign = self.pick(["&copy; ", "&copy; 2020 ", "Copyright ", ""])
        inner = sign + self.say(1, 4) + self.pick([" &middot; ", " | ", " "]) + self.say(1, 30, "footer")
        inner = inner if self.chance(0.5) else f"<p>{inner}</p>"
        inner += self.links("footer") if self.chance(0.4) else ""
        return f"<{tag}{self.attribute('footer', 0.4 if tag == 'footer' else 1)}>{inner}</{tag}>"

    def notice(self) -> str:
        tag = self.pick(["div", "div", "section", "aside"])
        return f"<{tag}{self.attribute('notice', 1)}><p>{self.say(3, 30, 'notice')}</p><button>{self.say(1, 2, 'notice')}</button></{tag}>"

    def ad(self) -> str:
        tag = self.pick(["div", "div", "aside", "section", "p"])
        inner = self.pick([self.say(2, 25), self.say(2, 25, "ad"), f'<a href="http://x">{self.say(2, 12, "ad")}</a>'])
        return f"<{tag}{self.attribute('ad', 1)}>{inner if self.chance(0.6) or tag == 'p' else f'<p>{inner}</p>'}</{tag}>"

    def form(self) -> str:
        rows = "".join(f"<label>{self.say(1, 3, 'form')}</label><input type=text>" for _ in range(int(self.rng.integers(1, 4))))
        return f"<form{self.attribute('form', 0.4)}>{'<p>' + self.say(2, 12, 'form') + '</p>' if self.chance(0.4) else ''}{rows}<button>{self.say(1, 2, 'form')}</button></form>"

    def side(self) -> str:
        tag = self.pick(["aside", "aside", "div", "section"])
        parts = [self.pick([f"<h3>{self.say(1, 4, 'side')}</h3>", f"<h2>{self.say(1, 4, 'side')}</h2>", ""]), self.pick([self.links("side"), f"<p>{self.say(4, 50)}</p>", f"<div>{self.say(3, 40)}</div>"])]
        return f"<{tag}{self.attribute('side', 0.4 if tag == 'aside' else 1)}>{''.join(parts) * int(self.rng.integers(1, 3))}</{tag}>"

    def comments(self) -> str:
        def one() -> str:
            who = self.pick([f"<h4>{self.say(1, 2)}</h4>", f"<cite>{self.say(1, 2)}</cite>", f"<span class=author>{self.say(1, 3, 'comment')}</span>", ""])
            tag = self.pick(["div", "li", "article"]) if self.chance(0.8) else "p"
            own = f' class="{self.pick(["comment", "reply", "comment-body", "response"])}"' if self.chance(0.8) else ""
            body = self.say(3, 60) if tag == "p" or self.chance(0.4) else "".join(f"<p>{self.say(3, 60)}</p>" for _ in range(int(self.rng.integers(1, 3))))
            return f"<{tag}{own}>{who}{body}</{tag}>"

        tag = self.pick(["section", "div", "div", "ol"])
        title = f"<h3>{self.say(1, 4, 'comment')}</h3>" if self.chance(0.6) else ""
        return f"<{tag}{self.attribute('comment', 1)}>{title}{''.join(one() for _ in range(int(self.rng.integers(1, 6))))}{self.form() if self.chance(0.3) else ''}</{tag}>"

    def main(self) -> str:
        out = []
        if self.chance(0.85):
            out.append(f"<h1>{_MARK}{self.say(1, 14)}</h1>")
        for _ in range(int(np.exp(self.rng.uniform(0, np.log(24))))):
            r = self.rng.random()
            if r < 0.74:
                text = _MARK + self.say(1, 120)
                if self.chance(0.15):
                    text = self.pick(["<b>{}", "<b>{}<br>", "<strong>{}</strong>", "<em>{}</em>"]).format(text)
                if self.chance(0.15):
                    text += f' <a href="/y">{self.say(1, 4)}</a> {self.say(1, 20)}'
                out.append(f"<p>{text}" + ("</p>" if self.chance(0.85) else ""))
            elif r < 0.82:
                out.append(f"<h{int(self.rng.integers(2, 4))}>{_MARK}{self.say(1, 8)}</h2>")
            elif r < 0.88:
                tag = self.pick(["ul", "ol"])
                out.append(f"<{tag}>" + "".join(f"<li>{_MARK}{self.say(1, 25)}</li>" for _ in range(int(self.rng.integers(2, 6)))) + f"</{tag}>")
            elif r < 0.92:
                out.append(f"<blockquote>{_MARK}{self.say(4, 50)}</blockquote>")
            elif r < 0.94:
                out.append(f"<pre>{_MARK}{self.say(2, 30)}</pre>")
            elif r < 0.97:
                out.append("<table><tr>" + "".join(f"<td>{_MARK}{self.say(1, 6)}</td>" for _ in range(3)) + "</tr></table>")
            else:
                out.append(f"<div>{_MARK}{self.say(3, 60)}</div>")
            if self.chance(0.05):
                out.append(self.pick([self.ad, self.side, self.notice])())
        tag = self.pick(["article", "article", "article", "main", "div", "div", "section", "td"])
        if self.chance(0.15):
            out.append(self.comments())
        if tag == "td":
            return f"<table><tr><td>{self.links('menu')}</td><td{self.attribute('main', 0.7)}>{''.join(out)}</td></tr></table>"
        body = f"<{tag}{self.attribute('main', 0.3 if tag in ('article', 'main') else 0.9)}>{''.join(out)}</{tag}>"
        return f"<main>{body}</main>" if tag == "article" and self.chance(0.3) else body

    def page(self) -> str:
        before = [f() for f, p in ((self.notice, 0.25), (self.head, 0.5), (self.menu, 0.6), (self.ad, 0.4), (self.side, 0.2), (self.form, 0.1)) if self.chance(p)]
        after = [f() for f, p in ((self.ad, 0.2), (self.comments, 0.3), (self.side, 0.4), (self.menu, 0.15), (self.form, 0.1), (self.footer, 0.75), (self.notice, 0.15)) if self.chance(p)]
        body = "".join([*before, self.main(), *after])
        for _ in range(int(self.rng.integers(0, 3))):
            body = f'<div{self.pick(["", " id=page", " class=wrapper", " class=container", " id=root"])}>{body}</div>'
        return f"<html><head><title>{self.say(1, 6)}</title></head><body>{body}" + ("</body></html>" if self.chance(0.9) else "")


def fit(words: list[str], pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = 0) -> Labeller:
    """A labeller trained on generated pages that use these words."""
    maker = PageMaker(words, seed)
    cut = [blocks_of(maker.page()) for _ in range(pages)]
    labels = [np.array([_MARK in b.text for b in page], dtype=np.float32) for page in cut]
    for page in cut:
        for block in page:
            block.text = block.text.replace(_MARK, "") or "."
    model = Labeller.fresh(seed)
    model.train(vectors_of(cut), labels, epochs, seed)
    return model


def sample_words(pages: DataFrame, page_id: str = "page_id", html: str = "html", most_pages: int = SAMPLE_PAGES) -> list[str]:
    """Words of about ``most_pages`` pages, chosen by a hash of their id."""
    million = 1_000_000
    count = pages.select(page_id).count()
    share = min(million, -(-2 * most_pages * million // max(1, count)))
    order = F.xxhash64(F.lit("blocks"), F.col(page_id).cast("string"))
    rows = (
        pages.where(F.pmod(order, F.lit(million)) < share)
        .select(order.alias("place"), F.col(html).cast("string").alias("html"))
        .orderBy("place", "html")
        .limit(most_pages)
        .collect()
    )
    return sorted({word for r in rows for block in blocks_of(r.html or "") for word in block.text.split() if len(word) < 25})


def main_texts(pages: list[str], model: Labeller) -> Iterator[str]:
    cut = [blocks_of(page) for page in pages]
    chance = model.label(vectors_of(cut))
    for page, p in zip(cut, chance):
        yield "\n".join(block.text for block, x in zip(page, p) if x >= 0.5)


def extract(pages: DataFrame, model: Labeller, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    source = pages.select(F.col(page_id).alias("a"), F.col(url).alias("b"), F.col(html).cast("string").alias("c"))
    kinds = [f.dataType.simpleString() for f in source.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str] = []
            held, size = [], 0
            for page in batch.column(2).to_pylist():
                held.append(page or "")
                size += len(held[-1])
                if size >= 1_000_000:
                    texts.extend(main_texts(held, model))
                    held, size = [], 0
            texts.extend(main_texts(held, model))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    found = source.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
    return found.withColumnsRenamed({"page_id": page_id, "url": url})
