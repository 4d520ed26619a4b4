"""Toxicity by compression distance: two zstandard dictionaries and calibrated thresholds.

One dictionary is trained on what sets toxic training texts apart (words and six-byte fragments with a high
likelihood ratio), the other on ordinary text. A window is a short run of a text; its distance is the number of
bytes it takes beyond the one dictionary less those beyond the other. Windows are set between fixed carriers
that both dictionaries hold: without them zstandard stores so short an input raw and the lengths tell nothing.
A text's largest distances and its counts of windows over two thresholds go through a logistic calibration
fitted on training texts that neither dictionary saw.

Only rows with ``crc32(doc_id as text) mod 4 <> 2`` teach. At most ``SAMPLE_TOXIC`` toxic and ``SAMPLE_ORDINARY``
other labelled texts, those least by a hash of their id, are used; every text is scored whole.

Edge cases: null, empty and white-space-only texts have no window and get the calibrated score of none. Without
labels of both kinds (a document with both labels counts as toxic) every score is the share of toxic labels (0 without labels). Rows with a null id are never
held out. Rows that repeat an id are scored alike if their texts are. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codicil.llm import worker
from codicil.llm.scratch import small_batches

#: Bounds of the training sample, and bytes of a dictionary.
SAMPLE_TOXIC, SAMPLE_ORDINARY, DICTIONARY = 3000, 6000, 1 << 16
#: Longest window in bytes; a longer run of text without white space becomes windows of this with half overlap.
WINDOW = 48
#: Thresholds on a window's distance, in bytes.
THRESHOLDS = (3, 5)
#: Least score that is predicted toxic.
DECISION = 0.3
#: Distances kept per worker; older ones go when twice as many are held.
KEPT = 200_000
HEAD, TAIL = bytes(range(1, 9)) + bytes(range(14, 32)), bytes(range(128, 152))
FRAGMENT = 6
_MARKS = b".,;:!?#$%&*|\"()[]{}<>"
_FOLD = bytes.maketrans(bytes(range(65, 91)) + _MARKS, bytes(range(97, 123)) + b" " * len(_MARKS))


def windows(text: str | None) -> list[bytes]:
    """Windows of a whole text: its words, with marks as white space and A-Z as a-z."""
    words = (text or "").encode().translate(_FOLD).split()
    if all(len(w) <= WINDOW for w in words):
        return words
    step = WINDOW // 2
    return [p for w in words for p in ([w] if len(w) <= WINDOW else [w[i : i + WINDOW] for i in range(0, len(w) - step, step)])]


def fragments(word: bytes) -> list[bytes]:
    word = b" " + word
    return [word[i : i + FRAGMENT] for i in range(max(1, len(word) - FRAGMENT + 1))]


def _distinct(toxic: Counter, other: Counter, n_toxic: int, n_other: int, least: float) -> dict[bytes, float]:
    """Likelihood ratio statistics of items clearly more frequent in toxic texts."""
    out = {}
    for x, p in toxic.items():
        n = other[x]
        if p >= 3 and p / n_toxic > 25 * (n + 0.1) / n_other:
            t = (p + n) / (n_toxic + n_other)
            g = 2 * (p * math.log(p / n_toxic / t) + (n * math.log(n / n_other / t) if n else 0))
            if g >= least:
                out[x] = g
    return out


def dictionaries(texts: Iterable[tuple[str | None, int]]) -> tuple[bytes, bytes]:
    """Contents of the toxic and the ordinary dictionary, learned from (text, label) pairs; the best stands last."""
    words, frags, n = (Counter(), Counter()), (Counter(), Counter()), [0, 0]
    known: dict[bytes, list[bytes]] = {}
    for text, label in texts:
        own = set(windows(text))
        words[label].update(own)
        pieces = set()
        for w in own:
            pieces.update(known[w] if w in known else known.setdefault(w, fragments(w)))
        frags[label].update(pieces)
        n[label] += 1
    good_words = _distinct(words[1], words[0], n[1], n[0], 10)
    good_frags = _distinct(frags[1], frags[0], n[1], n[0], 15)
    value = dict(good_words)
    for w in words[1]:
        if best := max((good_frags[x] for x in known[w] if x in good_frags), default=0):
            value[w] = max(value.get(w, 0), best)
    usual = [w for w, c in words[0].items() if c >= 2 and w not in value]
    join = lambda items: b"".join(b" " + w + b" " for w in items)[-DICTIONARY:] + HEAD + TAIL
    return join(sorted(value, key=lambda w: (value[w], w))), join(sorted(usual, key=lambda w: (words[0][w], w)))


class Distances(dict):
    """Window -> bytes by which the toxic dictionary compresses it better than the ordinary one."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        super().__init__()
        self.old: dict = {}
        make = lambda d: zstandard.ZstdCompressor(
            dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
            compression_params=zstandard.ZstdCompressionParameters(compression_level=6, window_log=17, hash_log=15, chain_log=15, search_log=6, min_match=3, strategy=zstandard.STRATEGY_BTLAZY2, target_length=32, write_content_size=False, write_checksum=False, write_dict_id=False),
        ).compress
        self.toxic, self.ordinary = make(toxic), make(ordinary)

    def __missing__(self, window: bytes) -> int:
        d = self.old.get(window)
        if d is None:
            x = HEAD + b" " + window + b" " + TAIL
            d = len(self.ordinary(x)) - len(self.toxic(x))
        if len(self) >= KEPT:
            self.old = dict(self)
            self.clear()
        self[window] = d
        return d

    def features(self, text: str | None) -> np.ndarray:
        """What the calibration reads of one text."""
        own = windows(text)
        d = np.fromiter(map(self.__getitem__, own), np.int32, len(own))
        if not len(d):
            return np.zeros(7)
        top = np.sort(np.partition(d, -3)[-3:] if len(d) > 3 else d)
        low, high = (int((d >= t).sum()) for t in THRESHOLDS)
        return np.array([1, max(top[-1], 0), max(top.mean(), 0), math.log1p(low), math.log1p(high), 100 * high / (len(d) + 20), math.log1p(len(d))])


@cache
def _distances(toxic: bytes, ordinary: bytes) -> Distances:
    worker.keep("toxicity", _distances.cache_clear)
    return Distances(toxic, ordinary)


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    weights: list[float] | None
    share: float

    def scores(self, texts: Iterable[str | None]) -> list[float]:
        if self.weights is None:
            return [self.share for _ in texts]
        d, w = _distances(self.toxic, self.ordinary), np.array(self.weights)
        return [float(1 / (1 + math.exp(-max(-60, min(60, d.features(t) @ w[1:] + w[0]))))) for t in texts]


def calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a small quadratic penalty, by Newton's method; the bias comes first."""
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], 0.3)
    penalty[0] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(rows: list[tuple[int, str | None, int]]) -> Model:
    """Model of (id, text, label) rows: two thirds make the dictionaries, one third the calibration."""
    share = sum(r[2] for r in rows) / len(rows) if rows else 0.0
    if share in (0.0, 1.0):
        return Model(b"", b"", None, share)
    apart = [r for r in rows if zlib.crc32(b"calibrate %d" % r[0]) % 3 == 0]
    if len({r[2] for r in apart}) < 2 or sum(r[2] for r in apart) < 4:
        apart = rows
    seen = {id(r) for r in apart} if len(apart) < len(rows) else set()
    toxic, ordinary = dictionaries((t, y) for r in rows if id(r) not in seen for _, t, y in [r])
    d = Distances(toxic, ordinary)
    x = np.array([d.features(t) for _, t, _ in apart])
    return Model(toxic, ordinary, calibrate(x, np.array([r[2] for r in apart], float)).tolist(), share)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether a row is kept for testing and never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Model learned from the bounded sample of labelled training rows."""
    small_batches(docs.sparkSession)
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    own = own.where("doc_id is not null and toxic in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = lambda y, n: own.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    sample = pick(1, SAMPLE_TOXIC).unionByName(pick(0, SAMPLE_ORDINARY))
    # the sample has at most SAMPLE_TOXIC + SAMPLE_ORDINARY rows of two numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").collect()
    return learn(sorted({(r["doc_id"], r["text"] or "", r["toxic"]) for r in rows}))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text)."""
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.start("toxicity")
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(part.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= DECISION).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose text isn't predicted toxic, with all their columns."""
    model = fit(docs, labels)

    @F.pandas_udf("double")
    def of(text: pd.Series) -> pd.Series:
        worker.start("toxicity")
        return pd.Series(model.scores(text), dtype="float64")

    return docs.where(of(F.col("text").cast("string")) < DECISION)
