"""Words of whole Arrow string batches as 64-bit hashes, computed with NumPy.

A word is a maximal run of bytes outside space and \\t\\n\\v\\f\\r, the class ``[^\\x20\\x09-\\x0D]+``;
in UTF-8 these bytes never occur inside another character. Nothing is done per word in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes hashed at once; bounds memory to about 40 times this, whatever a text's length.
SEGMENT = 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    folded = values.copy()
    folded[65:91] = values[97:123]
    space = np.zeros(256, bool)
    space[[32, 9, 10, 11, 12, 13]] = True
    return values, folded, space


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    p = int(_ODD)
    inverse = pow(p, -1, 2**64)
    up, down = (np.cumprod(np.full(SEGMENT, x, np.uint64)) for x in (p, inverse))
    one = np.ones(1, np.uint64)
    return np.concatenate([one, up]), np.concatenate([one, down])


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its len+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    if len(offsets) == 0:
        return data[:0], np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _segment(data: np.ndarray, breaks: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of one piece; breaks: positions where a text begins."""
    _, _, space = _tables()
    n = len(data)
    solid = ~space[data]
    edge = np.zeros(n + 1, bool)
    edge[breaks] = True
    edge[0] = edge[n] = True
    left = edge[:n].copy()
    left[1:] |= ~solid[:-1]
    right = edge[1:].copy()
    right[:-1] |= ~solid[1:]
    starts = np.flatnonzero(solid & left)
    ends = np.flatnonzero(solid & right) + 1
    sums = np.zeros(n + 1, np.uint64)
    if n <= SEGMENT:
        up, down = _powers()
        np.cumsum(values[data] * up[:n], out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * down[starts]
    else:  # one word longer than a segment
        hashes = np.array([_long(data[a:b], values) for a, b in zip(starts, ends, strict=True)], np.uint64)
    return mix(hashes ^ (ends - starts).astype(np.uint64)), starts, ends


def _long(word: np.ndarray, values: np.ndarray) -> int:
    up, _ = _powers()
    total, scale, step = 0, 1, pow(int(_ODD), SEGMENT, 2**64)
    for i in range(0, len(word), SEGMENT):
        part = word[i : i + SEGMENT]
        total += int((values[part] * up[: len(part)]).sum(dtype=np.uint64)) * scale
        scale = scale * step % 2**64
    return total % 2**64


def hash_words(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, bounds, starts, ends): words of text i are bounds[i]:bounds[i+1]; starts and ends are byte places.

    fold: A-Z count as a-z.
    """
    plain, folded, space = _tables()
    values = folded if fold else plain
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + SEGMENT)
        if end < n:
            gaps = np.flatnonzero(space[data[at:end]])
            edges = offsets[np.searchsorted(offsets, end, side="right") - 1]
            end = max(at + (gaps[-1] + 1 if len(gaps) else 0), edges)
            while end <= at:  # a word that no segment holds: go on to its end
                more = np.flatnonzero(space[data[at + SEGMENT :]])
                stop = at + SEGMENT + (more[0] + 1 if len(more) else n)
                later = offsets[offsets > at]
                end = int(min(stop, n, later[0] if len(later) else n))
        inside = offsets[(offsets >= at) & (offsets < end)] - at
        h, s, e = _segment(data[at:end], inside, values)
        out.append((h, s + at, e + at))
        at = end
    if not out:
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64), none, none
    hashes, starts, ends = (np.concatenate(x) for x in zip(*out, strict=True))
    return hashes, np.searchsorted(starts, offsets), starts, ends


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text; a shorter text is one shingle, an empty one none."""
    joined = hashes
    for j in range(1, k):
        joined = mix(joined[:-1] * _ODD + hashes[j:]) if len(hashes) > j else joined[:0]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= k:
            yield np.unique(joined[a : b - k + 1])
        elif b > a:
            whole = hashes[a : a + 1]
            for j in range(a + 1, b):
                whole = mix(whole * _ODD + hashes[j : j + 1])
            yield mix(whole + np.uint64(b - a))
        else:
            yield hashes[:0]
