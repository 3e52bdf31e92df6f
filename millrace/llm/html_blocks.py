"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks: stretches of text between the borders of block elements, each
with the path of open elements above it. A bidirectional LSTM in numpy reads, per block, hashed vectors of the
path (tags, classes, ids, roles), hashed vectors of all its words and a few figures, and labels every block with the
whole page as context.

Pages carry no labels, so the network learns from a teacher: structural rules on a bounded sample of pages
(SAMPLE_PAGES, none above SAMPLE_CHARS unless all are), and as many pages composed of the sample's blocks with parts that the sample may
lack (side bars, notices, forms, comments). Weights are small and go to the tasks; every page is then labelled whole.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import fresh, slices
from millrace.llm.words import word_hashes

SAMPLE_PAGES = 240
SAMPLE_CHARS = 200_000
PATH_SIZE = 192
WORD_SIZE = 48
FIGURES = 6
INPUT = PATH_SIZE + WORD_SIZE + FIGURES + 1
HIDDEN = 20
EPOCHS = 7
PAGES_PER_STEP = 16
BATCH_BYTES = 2 << 20
SEED = 3

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main menu nav noscript ol"
    " optgroup option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul".split()
)
RAW = frozenset("script style".split())
#: A start tag ends an open element of these.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead"}, "tfoot": {"tr", "td", "th", "tbody"}, "body": {"head"},
}
#: Elements that such a start tag doesn't reach beyond.
# All of them are block elements.
SCOPE = frozenset("ul ol dl table select menu article section div body main".split())
NOTHING: frozenset[str] = frozenset(())
_RAW_END = {tag: re.compile(f"</{tag}", re.IGNORECASE) for tag in RAW}

#: Composed pages are made of these if the sample has no text.
SPARE_TEXTS = tuple(
    " ".join(f"{a}{b}" for a in "bdfgklmn"[: 1 + k % 8] for b in ("a", "en", "ir", "ost", "u")[: 1 + k % 5]) for k in range(40)
)

# The teacher's words.
AWAY_TAGS = frozenset(
    "head title nav header footer aside form button select option textarea label legend fieldset noscript template iframe"
    " menu dialog search".split()
)
AWAY_WORDS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promoted banner cookie cookies consent notice alert sidebar"
    " side rail widget nav navbar navigation menu breadcrumb breadcrumbs footer header masthead comment comments disqus reply"
    " replies respond share sharing social related recommended newsletter subscribe subscription signup login popup modal"
    " overlay toolbar pagination pager copyright legal hidden search form contentinfo complementary dialog".split()
)
MAIN_TAGS = frozenset("article main".split())
MAIN_WORDS = frozenset("article main content post entry story".split())

_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
_UNQUOTED = re.compile(r"[^\"'>]*+(?:(?:\"[^\"]*+\"|'[^']*+')[^\"'>]*+)*+")
_QUOTED = re.compile(r"\"[^\"]*+\"|'[^']*+'")
_ATTRIBUTE = re.compile(r"\b(class|id|role|style|aria-hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+")


@lru_cache(maxsize=50_000)
def _facts(mark: str) -> tuple[str, int, bool, bool, bool]:
    """Tag, places, and whether it is apart from main text (but for a header), a header, or main text."""
    tag, *words = mark.split(".")
    places = 0
    for name in (f"t {tag}", *(f"w {w}" for w in words)):
        places |= 1 << zlib.crc32(name.encode()) % PATH_SIZE
    away = tag not in ("html", "body") and (tag in AWAY_TAGS and tag != "header" or bool(AWAY_WORDS.intersection(words)))
    return tag, places, away, tag == "header", tag != "body" and (tag in MAIN_TAGS or bool(MAIN_WORDS.intersection(words)))


class Node:
    """An open element: a link to its parent, and what is true of the whole path down to it, so that a path of any depth costs
    one step. places: bits of the path's hashed marks."""

    __slots__ = ("parent", "mark", "tag", "depth", "places", "away", "header", "main")

    def __init__(self, parent: "Node | None", mark: str):
        self.parent, self.mark = parent, mark
        self.tag, places, away, header, main = _facts(mark)
        if parent is None:
            self.depth, self.places, self.away, self.header, self.main = 1, places, away, header, main
        else:
            self.depth, self.places = parent.depth + 1, parent.places | places
            self.away, self.header, self.main = parent.away or away, parent.header or header, parent.main or main

    def path(self) -> tuple[str, ...]:
        marks, node = [], self
        while node is not None:
            marks.append(node.mark)
            node = node.parent
        return tuple(reversed(marks))

    def cells(self) -> list[int]:
        """Places of the path, its last tag and its last two tags in a feature row."""
        pair = f"{self.parent.tag} {self.tag}" if self.parent else self.tag
        bits = self.places | 1 << zlib.crc32(f"leaf {self.tag}".encode()) % PATH_SIZE | 1 << zlib.crc32(f"pair {pair}".encode()) % PATH_SIZE
        return [k for k in range(PATH_SIZE) if bits >> k & 1]


@dataclass
class Block:
    text: str
    node: Node | None
    linked: int = 0

    @property
    def path(self) -> tuple[str, ...]:
        return self.node.path() if self.node else ()


class _Reader:
    """State of one pass over a page. Places of open elements are kept by tag, and of those that bound a scope, so that
    closing one looks at no other."""

    def __init__(self):
        self.stack: list[Node] = []
        self.places: dict[str, list[int]] = {}
        self.bounds: dict[int, list[int]] = {id(BLOCK): [], id(SCOPE): [], id(NOTHING): []}
        self.pieces: list[str] = []
        self.linked = 0
        self.blocks: list[Block] = []
        self.node: Node | None = None

    def open(self, mark: str) -> None:
        node = Node(self.stack[-1] if self.stack else None, mark)
        self.places.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCK:
            self.bounds[id(BLOCK)].append(len(self.stack))
            if node.tag in SCOPE:
                self.bounds[id(SCOPE)].append(len(self.stack))
        self.stack.append(node)

    def text(self, raw: str) -> None:
        if not raw:
            return
        said = entities.unescape(raw) if "&" in raw else raw
        if not self.pieces or self.node is None:
            self.node = self.stack[-1] if self.stack else None
        self.pieces.append(said)
        if self.places.get("a"):
            self.linked += len(said.strip())

    def flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                self.blocks.append(Block(text, self.node, self.linked))
        self.pieces, self.linked, self.node = [], 0, None

    def close(self, names: set[str] | frozenset[str], within: frozenset[str]) -> None:
        """Close the last open element of `names`, unless one of `within` was opened after it."""
        last = max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)
        bounds = self.bounds[id(within)]
        if last < 0 or bounds and bounds[-1] > last:
            return
        while len(self.stack) > last:
            node = self.stack.pop()
            self.places[node.tag].pop()
            if node.tag in BLOCK:
                self.bounds[id(BLOCK)].pop()
                if node.tag in SCOPE:
                    self.bounds[id(SCOPE)].pop()


class _Tags:
    """Tags of a page, each found in one step from where the last ended.

    A tag ends at the first > outside quotes, or at the first one if a quote never closes. Stretches that are known to run into
    a quote that never closes are remembered with their quoted parts: a tag that starts in one isn't followed again.
    """

    def __init__(self, page: str):
        self.page = page
        self.dead: list[tuple[int, int, list[int], list[int]]] = []
        self.last = page.rfind(">")

    def end(self, place: int) -> int:
        """Place of the > that ends a tag whose name ends at `place`."""
        for start, stop, opens, closes in self.dead:
            if start <= place < stop:
                k = bisect_right(opens, place) - 1
                if k < 0 or place >= closes[k]:
                    return self.page.find(">", place)
        stop = _UNQUOTED.match(self.page, place).end()
        if self.page[stop : stop + 1] == ">":
            return stop
        spans = [m.span() for m in _QUOTED.finditer(self.page, place, stop)]
        self.dead.append((place, stop, [a for a, _ in spans], [b for _, b in spans]))
        return self.page.find(">", place)

    def next(self, place: int) -> tuple[int, int, str, bool, str] | None:
        """(start, end, name, whether it closes, attributes) of the next tag; comments and declarations have no name."""
        page = self.page
        while 0 <= (at := page.find("<", place)):
            if page.startswith("<!--", at):
                stop = page.find("-->", at + 4)
                return at, len(page) if stop < 0 else stop + 3, "", False, ""
            if page[at + 1 : at + 2] in ("!", "?"):
                stop = page.find(">", at)
                return at, len(page) if stop < 0 else stop + 1, "", False, ""
            if at > self.last:
                return None
            name = _NAME.match(page, at + 1)
            if name:
                stop = self.end(name.end())
                return at, stop + 1, name[1].lower(), page[at + 1] == "/", page[name.end() : stop]
            place = at + 1
        return None


def _mark(tag: str, attributes: str, known: dict[str, str]) -> str:
    """Path entry of an element: its tag and the words of its class, id and role."""
    if not attributes.strip():
        return tag
    words = known.get(attributes)
    if words is None:
        found = []
        for m in _ATTRIBUTE.finditer(attributes):
            value = (m[2] or m[3] or m[4] or "").lower()
            name = (m[1] or m[5]).lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "none" in value:
                found.append("hidden")
            elif name in ("class", "id", "role"):
                found += _WORDS.findall(value)
        words = "".join(f".{w}" for w in dict.fromkeys(found))
        if len(known) > 50_000:
            known.clear()
        known[attributes] = words
    return tag + words


def blocks_of(page: str, known: dict[str, str] | None = None) -> list[Block]:
    """Leaf blocks of a page in order; white space is one space, character references are decoded."""
    known = {} if known is None else known
    r, tags, place = _Reader(), _Tags(page), 0
    while (found := tags.next(place)) is not None:
        start, end, tag, closes, attributes = found
        r.text(page[place:start])
        place = end
        if not tag:
            continue
        if closes:
            if tag in BLOCK:
                r.flush()
            r.close({tag}, NOTHING if tag in BLOCK else BLOCK)
            continue
        if tag in RAW:
            end = _RAW_END[tag].search(page, place)
            if end is None:
                place = len(page)
                break
            close = page.find(">", end.start())
            place = len(page) if close < 0 else close + 1
            continue
        if tag in BLOCK:
            r.flush()
            r.close({"p"}, SCOPE)
            if tag in CLOSES:
                r.close(CLOSES[tag], SCOPE)
        if tag == "br":
            r.text(" ")
        if tag not in VOID:
            r.open(_mark(tag, attributes, known))
    r.text(page[place:])
    r.flush()
    return r.blocks


def teacher(blocks: list[Block]) -> np.ndarray:
    """1 for blocks of the main text by structural rules, 0 for others."""
    nodes = [b.node for b in blocks]
    away = [bool(n) and (n.away or n.header) for n in nodes]
    main = [bool(n) and n.main for n in nodes]
    if not any(m and not a for m, a in zip(main, away)):
        main = [b.linked < 0.5 * len(b.text) for b in blocks]
    # a header within the article holds its heading
    away = [a and not (m and n and n.tag in ("h1", "h2") and n.header and not n.away) for a, m, n in zip(away, main, nodes)]
    return np.array([m and not a for m, a in zip(main, away)], float)


# Features

class Features:
    """Input rows of blocks; remembers the places of paths it has seen."""

    def __init__(self):
        self.known: dict[tuple[int, str, str], list[int]] = {}

    def __call__(self, pages: list[list[Block]]) -> tuple[np.ndarray, np.ndarray]:
        """(rows of all blocks, number of blocks per page)."""
        blocks = [b for page in pages for b in page]
        sizes = np.array([len(p) for p in pages], np.int64)
        x = np.zeros((len(blocks), INPUT), np.float32)
        if not blocks:
            return x, sizes
        if len(self.known) > 50_000:
            self.known.clear()
        for k, b in enumerate(blocks):
            if b.node is None:
                continue
            key = (b.node.places, b.node.tag, b.node.parent.tag if b.node.parent else "")
            places = self.known.get(key)
            if places is None:
                places = self.known[key] = b.node.cells()
            x[k, places] = 1
        texts = [b.text.encode() for b in blocks]
        hashes, first, _ = word_hashes(texts)
        count = np.diff(first)
        owner = np.repeat(np.arange(len(blocks)), count)
        cells = owner * WORD_SIZE + (hashes % np.uint64(WORD_SIZE)).astype(np.int64)
        words = np.bincount(cells, minlength=len(blocks) * WORD_SIZE).reshape(len(blocks), WORD_SIZE)
        x[:, PATH_SIZE : PATH_SIZE + WORD_SIZE] = np.sqrt(words) / np.sqrt(np.maximum(count, 1))[:, None]
        length = np.array([len(b.text) for b in blocks], float)
        place = np.arange(len(blocks)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        x[:, PATH_SIZE + WORD_SIZE : INPUT - 1] = np.column_stack([
            np.log1p(length) / 8, np.minimum(1, np.array([b.linked for b in blocks]) / np.maximum(length, 1)),
            np.log1p(count) / 6, np.array([b.text[-1] in ".!?:;" for b in blocks]),
            (place + 1) / np.repeat(np.maximum(sizes, 1), sizes), np.array([b.node.depth if b.node else 0 for b in blocks]) / 16,
        ])
        x[:, -1] = 1
        return x, sizes


# Network

def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Direction:
    """One direction of the LSTM over packed sequences: longest first, each step takes those still running."""

    def __init__(self, rng: np.random.Generator):
        self.w = rng.normal(0, 0.1, (INPUT, 4 * HIDDEN)).astype(np.float32)
        self.u = rng.normal(0, 0.15, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
        self.w[-1, HIDDEN : 2 * HIDDEN] += 1  # remember at first

    def forward(self, x: np.ndarray, rows: list[np.ndarray], keep: bool = False) -> np.ndarray:
        """Hidden state of each input row; rows: of each step, the input rows in the order of the sequences."""
        z = x @ self.w
        out = np.zeros((len(x), HIDDEN), np.float32)
        h = c = np.zeros((len(rows[0]) if rows else 0, HIDDEN), np.float32)
        self.steps = []
        for r in rows:
            h, c = h[: len(r)], c[: len(r)]
            gates = z[r] + h @ self.u
            i, f, o = (_sigmoid(gates[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(gates[:, 3 * HIDDEN :])
            before, old = c, h
            c = f * c + i * g
            t = np.tanh(c)
            h = o * t
            out[r] = h
            if keep:
                self.steps.append((r, i, f, o, g, before, old, t))
        return out

    def backward(self, x: np.ndarray, dout: np.ndarray) -> list[np.ndarray]:
        dz = np.zeros((len(x), 4 * HIDDEN), np.float32)
        du = np.zeros_like(self.u)
        dh = dc = np.zeros((0, HIDDEN), np.float32)
        for r, i, f, o, g, before, old, t in reversed(self.steps):
            pad = ((0, len(r) - len(dh)), (0, 0))
            dh = np.pad(dh, pad) + dout[r]
            dc = np.pad(dc, pad) + dh * o * (1 - t * t)
            d = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * t * o * (1 - o), dc * i * (1 - g * g)], 1)
            dz[r] = d
            du += old.T @ d
            dh, dc = d @ self.u.T, dc * f
        return [x.T @ dz, du]


def _rows(sizes: np.ndarray, reverse: bool) -> list[np.ndarray]:
    """Input rows of each step for pages of these sizes that lie one after the other."""
    start = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    size, start = sizes[order], start[order]
    return [
        (start[:n] + size[:n] - 1 - t) if reverse else start[:n] + t
        for t in range(int(size[0]) if len(size) else 0)
        for n in (int(np.searchsorted(-size, -t, side="left")),)
    ]


class Labeller:
    def __init__(self):
        rng = np.random.default_rng(SEED)
        self.ahead, self.back = Direction(rng), Direction(rng)
        self.v = rng.normal(0, 0.2, 2 * HIDDEN + 1).astype(np.float32)

    def logits(self, x: np.ndarray, sizes: np.ndarray, keep: bool = False) -> np.ndarray:
        h = [d.forward(x, _rows(sizes, back), keep) for d, back in ((self.ahead, False), (self.back, True))]
        self.h = np.column_stack([*h, np.ones(len(x), np.float32)])
        return self.h @ self.v

    def labels(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return self.logits(x, sizes) > 0

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]]) -> "Labeller":
        """Adam on the logistic loss; pages: (rows, labels)."""
        rng = np.random.default_rng(SEED)
        weights = [self.ahead.w, self.ahead.u, self.back.w, self.back.u, self.v]
        mean = [np.zeros_like(w) for w in weights]
        square = [np.zeros_like(w) for w in weights]
        step = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(pages))
            for a in range(0, len(order), PAGES_PER_STEP):
                some = [pages[k] for k in order[a : a + PAGES_PER_STEP]]
                x = np.concatenate([p[0] for p in some])
                y = np.concatenate([p[1] for p in some])
                sizes = np.array([len(p[0]) for p in some])
                error = ((_sigmoid(self.logits(x, sizes, keep=True)) - y) / len(y)).astype(np.float32)
                dh = error[:, None] * self.v[:-1]
                grads = [*self.ahead.backward(x, dh[:, :HIDDEN]), *self.back.backward(x, dh[:, HIDDEN:]), self.h.T @ error]
                step += 1
                rate = 0.02 * (1 - epoch / EPOCHS) + 0.002
                for w, g, m, s in zip(weights, grads, mean, square):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        self.ahead.steps = self.back.steps = []
        self.h = None
        return self


def _composed(texts: list[str], rng: np.random.Generator) -> str:
    """A page of sampled texts with parts that main text never has, in the usual mark-up."""
    def say(n: int = 1) -> str:
        return " ".join(entities.escape(texts[k]) for k in rng.integers(0, len(texts), n))

    def short() -> str:
        return " ".join(say().split()[: int(rng.integers(1, 5))])

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="#">{short()}</a></li>' for _ in range(k)) + "</ul>"

    def pick(*options: str) -> str:
        return options[int(rng.integers(0, len(options)))]

    article = f"<h1>{short()}</h1>" + "".join(
        pick("<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<h2>{}</h2>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<p><b>{}<br>").format(say())
        for _ in range(int(rng.integers(1, 9)))
    )
    inner = pick("", f'<div class="ad">{say()}</div>', f'<aside>{say()}</aside>', f'<div class="share">{links(2)}</div>')
    main = pick("<article>{}</article>", "<main>{}</main>", '<main><article>{}</article></main>', '<div class="content">{}</div>', '<div id="main-content">{}</div>')
    before = "".join(p for p in (
        f"<nav>{links(int(rng.integers(2, 8)))}</nav>", f"<header><h1>{short()}</h1>{links(3)}</header>",
        f'<div class="{pick("cookie-notice", "notice", "banner", "alert")}"><p>{say()}</p></div>', f'<div class="ad">{say()}</div>',
        f'<div class="menu">{links(4)}</div>', f'<form action="#"><label>{short()}</label><input name="q"><button>{short()}</button></form>',
    ) if rng.random() < 0.5)
    c = pick("section", "div")
    after = "".join(p for p in (
        f'<aside class="sidebar"><h3>{short()}</h3><p>{say()}</p>{links(3)}</aside>', f'<div class="{pick("sidebar", "related", "widget")}"><p>{say()}</p>{links(3)}</div>',
        f'<{c} {pick("class", "id")}="comments"><h2>{short()}</h2><div class="comment"><p>{say()}</p></div><p>{say(2)}</p></{c}>',
        f'<div class="advert">{say()}</div>', f'<form class="newsletter"><p>{say()}</p><button>{short()}</button></form>',
        f"<footer><p>{say()}</p>{links(2)}</footer>", f"<footer>&copy; {short()}</footer>",
    ) if rng.random() < 0.5)
    return f"<html><head><title>{short()}</title><script>var a=1;</script></head><body>{before}{main.format(article + inner)}{after}</body></html>"


def fit(pages: DataFrame, html: str = "html") -> Labeller:
    """A labeller taught on a bounded sample of `pages`, the first by a hash of their content, copies counted once.

    If no page of up to SAMPLE_CHARS has text, the shortest of the longer ones are taken, up to the same sum of
    characters, one at least. Composed pages are always added, so that a table without text teaches too.
    """
    mark, size = F.xxhash64(html), F.length(html)

    def blocks(some: DataFrame, marks: list[int]) -> list[list[Block]]:
        chosen = some.where(mark.isin(marks)).groupBy(mark.alias("mark")).agg(F.first(html).alias(html))
        return [blocks_of(page) for _, page in sorted(map(tuple, chosen.collect()))]

    short = pages.where(size.between(1, SAMPLE_CHARS))
    seen = blocks(short, [r[0] for r in short.select(mark.alias("mark")).distinct().orderBy("mark").limit(SAMPLE_PAGES).collect()])
    if not any(seen):
        long = pages.where(size > SAMPLE_CHARS)
        marks, left = [], SAMPLE_PAGES * SAMPLE_CHARS
        for n, m in long.select(size.alias("size"), mark.alias("mark")).distinct().orderBy("size", "mark").limit(SAMPLE_PAGES).collect():
            left -= n
            if left >= 0 or not marks:
                marks.append(m)
        seen = blocks(long, marks) if marks else seen
    texts = sorted({b.text for page in seen for b in page}) or list(SPARE_TEXTS)
    rng = np.random.default_rng(SEED)
    seen += [blocks_of(_composed(texts, rng)) for _ in range(SAMPLE_PAGES)]
    features = Features()
    return Labeller().fit([(features([page])[0], teacher(page)) for page in seen if page])


def main_text(pages: DataFrame, model: Labeller, html: str = "html", text: str = "text") -> DataFrame:
    """`pages` with the main text of each whole page in the column `text`, other columns as they are.

    Blocks labelled as main text are joined by a line end. Null, empty and text-free pages get an empty string.
    Each row is a page of its own, so repeated rows get equal texts; a column named like `text` is replaced. An
    empty table gives an empty one. A long page is alone in its batch.
    """
    kept = pages.drop(text)
    (out,) = fresh(kept, text)
    schema = kept.withColumn(out, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, known = Features(), {}
        for batch in batches:
            for part in slices(batch, html, BATCH_BYTES):
                found = [blocks_of(p or "", known) for p in part.column(html).to_pylist()]
                x, sizes = features(found)
                labels = model.labels(x, sizes) if len(x) else np.zeros(0, bool)
                texts, a = [], 0
                for page in found:
                    chosen = labels[a : a + len(page)]
                    a += len(page)
                    texts.append("\n".join(b.text for b, keep in zip(page, chosen) if keep))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, out])

    return kept.mapInArrow(run, schema)
