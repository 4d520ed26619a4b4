"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags. Each block is read as the mean embedding of
its hashed tag path (tags and class, id and role tokens of its open elements), the embedding of its own tag, the
mean embedding of its hashed words and a few measures. A bidirectional LSTM in NumPy runs over the blocks of the
whole page, so every block is judged with what stands before and after it; blocks over one half are kept.

The weights are trained by :mod:`codicil.llm.html_train` on pages that it composes; they are a small file here.

Edge cases: a null or empty page gives an empty text, as does one without text. Unclosed, stray and cut-off tags
are taken as browsers do: they end nothing and stay open to the end. Rows with a null id or rows that repeat are
read like others. Other columns are kept out of the result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache
from html import unescape
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codicil.llm.scratch import small_batches

PATHS, WORDS, LEAVES = 1024, 2048, 64
PATH_DIM, WORD_DIM, LEAF_DIM, MEASURES, HIDDEN = 24, 8, 8, 9, 24
WEIGHTS = Path(__file__).with_name("html_blocks.npz")
#: Blocks of all pages run through the network together, at most (more only for one longer page).
TOGETHER = 20_000

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I | re.S)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter picture q ruby rb rp rt s samp small source span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never text of the page.
_RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
#: What an opening tag ends, if open within the element that holds it.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HOLDERS = frozenset("ul ol dl table tbody thead tfoot select div section article main body".split())

Block = tuple[tuple[str, ...], str, int]  # path items from the root, text, characters inside links


def blocks(html: str) -> list[Block]:
    """Leaf blocks of a page in order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked, in_link, at = 0, False, 0

    def flush() -> None:
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            out.append((tuple(x for _, items in stack for x in items), text, linked))
        parts, linked = [], 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            raw = unescape(raw) if "&" in raw else raw
            parts.append(raw)
            if in_link:
                linked += len(raw)

    n = len(html)
    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            add(html[at:])
            break
        add(html[at : m.start()])
        at = m.end()
        closing, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            parts.append(" ")
        elif name in _INLINE:
            if name == "a":
                in_link = not closing
        elif closing:
            flush()
            in_link = False
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
        elif name in _RAW:
            flush()
            end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(html, at)
            at = end.end() if end else n
        else:
            flush()
            in_link = False
            if name in _VOID:
                continue
            if stack and stack[-1][0] == "p":
                stack.pop()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in _ENDS.get(name, ()):
                    del stack[i:]
                    break
                if stack[i][0] in _HOLDERS:
                    break
            if not rest.rstrip().endswith("/") or name in _HOLDERS:
                stack.append((name, _items(name, rest)))
    flush()
    return out


@cache
def _tokens(value: str) -> tuple[str, ...]:
    return tuple(t.lower() for t in _TOKEN.findall(value))


def _items(name: str, attributes: str) -> tuple[str, ...]:
    if not attributes or "=" not in attributes:
        return (f"<{name}",)
    return (f"<{name}", *(t for _, v in _ATTRIBUTE.findall(attributes) for t in _tokens(v)[:12]))


class _Hashed(dict):
    """Feature of a string, kept until there are many."""

    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def __missing__(self, text: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[text] = h = zlib.crc32(text.encode()) % self.size
        return h


_PATH, _WORD, _LEAF = _Hashed(PATHS), _Hashed(WORDS), _Hashed(LEAVES)


def features(pages: list[list[Block]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all blocks of all pages: path features and bounds, word features and bounds, leaf features, measures, page bounds."""
    path: list[int] = []
    word: list[int] = []
    path_at, word_at, leaf, measure, page_at = [0], [0], [], [], [0]
    for own in pages:
        for i, (items, text, linked) in enumerate(own):
            words = text.split(" ")
            path.extend(map(_PATH.__getitem__, items or ("<none",)))
            word.extend(map(_WORD.__getitem__, words))
            path_at.append(len(path))
            word_at.append(len(word))
            leaf.append(_LEAF[next((x for x in reversed(items) if x[0] == "<"), "<none")])
            n, c = len(words), len(text)
            stops = text.count(".") + text.count(",")
            measure.append((min(np.log1p(n), 6) / 3, linked / c, (c - n + 1) / n / 10, stops / n, text[-1] in ".!?\"", i / len(own), (len(own) - i) / len(own), np.log1p(len(own)) / 5, text[0].isupper()))
        page_at.append(len(leaf))
    ints = lambda x: np.array(x, np.int64)
    return ints(path), ints(path_at), ints(word), ints(word_at), ints(leaf), np.array(measure, np.float32).reshape(-1, MEASURES), ints(page_at)


def means(table: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Mean row of the table for each (non-empty) run of ids."""
    return np.add.reduceat(table[ids], bounds[:-1], axis=0) / np.diff(bounds)[:, None]


def lstm(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Hidden states of a batch (pages, steps, inputs); padded steps keep the state."""
    pages, steps, _ = x.shape
    h = c = np.zeros((pages, HIDDEN), np.float32)
    out = np.empty((pages, steps, HIDDEN), np.float32)
    z_in = x @ w + b
    for t in range(steps):
        z = z_in[:, t] + h @ u
        gate = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
        i, f, o = np.split(gate, 3, axis=1)
        new = f * c + i * np.tanh(z[:, 3 * HIDDEN :])
        on = mask[:, t, None]
        c = np.where(on, new, c)
        h = np.where(on, o * np.tanh(new), h)
        out[:, t] = h
    return out


def inputs(p: dict[str, np.ndarray], f: tuple) -> np.ndarray:
    return np.hstack([means(p["path"], f[0], f[1]), means(p["word"], f[2], f[3]), p["leaf"][f[4]], f[5]]).astype(np.float32)


def padded(x: np.ndarray, page_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(batch, mask, page of each block, step of each block)."""
    n = np.diff(page_at)
    page = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(x)) - page_at[:-1][page]
    batch = np.zeros((len(n), max(1, int(n.max(initial=0))), x.shape[1]), np.float32)
    mask = np.zeros(batch.shape[:2], bool)
    batch[page, step] = x
    mask[page, step] = True
    return batch, mask, page, step


def chances(p: dict[str, np.ndarray], pages: list[list[Block]]) -> np.ndarray:
    """Chance of each block of all pages to be main text."""
    f = features(pages)
    if not len(f[4]):
        return np.empty(0)
    batch, mask, page, step = padded(inputs(p, f), f[6])
    forth = lstm(batch, p["w_f"], p["u_f"], p["b_f"], mask)
    back = lstm(batch[:, ::-1], p["w_b"], p["u_b"], p["b_b"], mask[:, ::-1])[:, ::-1]
    z = np.concatenate([forth, back], axis=2)[page, step] @ p["v"] + p["c"]
    return 1 / (1 + np.exp(-z[:, 0]))


@cache
def weights() -> dict[str, np.ndarray]:
    with np.load(WEIGHTS) as f:
        return dict(f)


def texts(htmls: list[str | None], p: dict[str, np.ndarray] | None = None) -> list[str]:
    """Main text of each page."""
    p = p or weights()
    pages = [blocks(h or "") for h in htmls]
    out = [""] * len(pages)
    order = sorted(range(len(pages)), key=lambda i: len(pages[i]))  # pages of like length pad little
    group: list[int] = []
    for k, i in enumerate(order):
        group.append(i)
        longest = len(pages[order[k + 1]]) if k + 1 < len(order) else 0
        if k + 1 == len(order) or longest * (len(group) + 1) > TOGETHER:
            good = iter(chances(p, [pages[j] for j in group]) >= 0.5)
            for j in group:
                out[j] = " ".join([text for _, text, _ in pages[j] if next(good)])
            group = []
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html)."""
    schema = "page_id long, url string, text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = texts(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    small_batches(pages.sparkSession)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(run, schema)
