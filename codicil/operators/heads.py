"""Multi-label heads, linear or with one hidden layer, trained by gradient descent whose sums tasks make.

Every step sends the parameters to the tasks; each multiplies its own rows and returns one gradient, Spark adds these up by place, and
the driver takes one Adam step. What the driver holds is the parameters (vocabulary times hidden units or labels), whatever the number of documents.
The loss is the logistic one with a weight for rare positives, which is capped so that one rare label cannot lead a step. Hidden units are
dropped at random while training; a unit's fate follows from the document and the step, so partitions change no result but by rounding.
"""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codicil.operators.priors import multi_hot
from codicil.sources.staged import write_once
from codicil.sources.working import Tables

KINDS = ("linear", "mlp")
#: Most weight of a positive, share of hidden units dropped, and Adam's constants.
POSITIVE_MOST, DROPPED = 20.0, 0.1
BETA_1, BETA_2, TINY = 0.9, 0.999, 1e-8
#: Documents that are multiplied at once.
BLOCK = 512


def rows_for(weights: DataFrame, terms: DataFrame, labels: DataFrame, names: list[str]) -> DataFrame:
    """(doc, places, values, y) of weights (doc, token, weight) over the terms, which are numbered by their order, and labels (doc, labels).

    A document without a term has empty arrays.
    """
    numbered = terms.select("token", (F.row_number().over(Window.orderBy("token")) - 1).alias("place"))  # a bounded vocabulary
    sparse = weights.join(F.broadcast(numbered), "token").groupBy("doc").agg(F.sort_array(F.collect_list(F.struct(F.col("place").cast("int").alias("place"), "weight"))).alias("s"))
    joined = labels.select("doc", _multi_hot(names).alias("y")).join(sparse, "doc", "left")
    none = F.array().cast("array<struct<place:int,weight:double>>")
    return joined.withColumn("s", F.coalesce("s", none)).select("doc", F.col("s.place").alias("places"), F.col("s.weight").alias("values"), "y")


def rows_of_words(words: DataFrame, terms: DataFrame, n_docs: int, names: list[str]) -> DataFrame:
    """The rows of rows_for, from words (doc, labels, t, n) with a row for each document: weights are those of priors.tfidf, and nothing is shuffled."""
    held = sorted((r.token, r.df) for r in terms.select("token", "df").collect())  # a bounded vocabulary
    idf = np.log((1 + n_docs) / (1 + np.array([df for _, df in held], float))) + 1
    numbers = [t for t, _ in held]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(numbers, pa.string())
        for b in batches:
            place = pc.fill_null(pc.index_in(b.column("t").flatten(), value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column("t")).to_numpy())
            known = np.flatnonzero(place >= 0)
            known = known[np.lexsort((place[known], row[known]))]
            row, place = row[known], place[known]
            weight = (1 + np.log(b.column("n").flatten().to_numpy()[known])) * idf[place]
            weight /= np.sqrt(np.bincount(row, weight * weight, b.num_rows))[row]
            ends = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=b.num_rows))), pa.int32())
            places, values = pa.ListArray.from_arrays(ends, pa.array(place, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(weight, pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("doc"), places, values, b.column("y")], ["doc", "places", "values", "y"])

    kind = dict(words.dtypes)["doc"]
    return words.select("doc", _multi_hot(names).alias("y"), "t", "n").mapInArrow(run, f"doc {kind}, places array<int>, values array<double>, y array<int>")


def _multi_hot(names: list[str]) -> Column:
    return multi_hot(F.col("labels"), names) if names else F.array().cast("array<int>")


def _blocks(batches: Iterator[pa.RecordBatch], terms: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Some documents at a time, and their values as a matrix."""
    for b in batches:
        for at in range(0, b.num_rows, BLOCK):
            part = b.slice(at, BLOCK)
            x = np.zeros((part.num_rows, terms))
            row = np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column("places")).to_numpy())
            x[row, part.column("places").flatten().to_numpy()] = part.column("values").flatten().to_numpy()
            yield part, x


def _mask(docs: np.ndarray, hidden: int, step: int) -> np.ndarray:
    """1 / (1 - DROPPED) for units that stay, by a hash of document, unit and step."""
    h = (docs.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)) ^ (np.arange(hidden, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(step * 0xA0761D6478BD642F % 2**64))
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(11)).astype(float) / 2.0**53 >= DROPPED) / (1 - DROPPED)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


@dataclass
class Head:
    """Parameters of a head: weights and biases of its one or two layers."""

    kind: str
    parts: list[np.ndarray]
    names: list[str]
    losses: list[float] = field(default_factory=list)

    @classmethod
    def begin(cls, kind: str, terms: int, names: list[str], hidden: int, seed: int) -> Head:
        """Uniform within the inverse root of a layer's inputs."""
        if kind not in KINDS:
            raise ValueError(f"{kind} isn't one of {', '.join(KINDS)}")
        rng = np.random.default_rng(seed)
        sizes = [(terms, len(names))] if kind == "linear" else [(terms, hidden), (hidden, len(names))]
        parts = []
        for a, b in sizes:
            bound = 1 / np.sqrt(max(a, 1))
            parts += [rng.uniform(-bound, bound, (a, b)), rng.uniform(-bound, bound, b)]
        return cls(kind, parts, names)

    def logits(self, x: np.ndarray, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Logits, and what the last layer was given."""
        if self.kind == "linear":
            return x @ self.parts[0] + self.parts[1], x
        inner = np.maximum(x @ self.parts[0] + self.parts[1], 0)
        inner = inner if mask is None else inner * mask
        return inner @ self.parts[2] + self.parts[3], inner

    def gradient(self, x: np.ndarray, y: np.ndarray, positive: np.ndarray, mask: np.ndarray | None) -> tuple[list[np.ndarray], float]:
        """Sums over the rows of the loss and of its gradients."""
        z, inner = self.logits(x, mask)
        soft = np.logaddexp(0, -z)
        loss = float((positive * y * soft + (1 - y) * (z + soft)).sum())
        d = _sigmoid(z) * (1 + (positive - 1) * y) - positive * y
        if self.kind == "linear":
            return [x.T @ d, d.sum(0)], loss
        below = (d @ self.parts[2].T) * (inner > 0) * (mask if mask is not None else 1)
        return [x.T @ below, below.sum(0), inner.T @ d, d.sum(0)], loss

    def save(self, folder: str, name: str) -> None:
        """Write the parameters as one file, once."""
        out = io.BytesIO()
        np.savez(out, names=np.array(self.names), kind=np.array(self.kind), **{f"p{i}": p for i, p in enumerate(self.parts)})
        write_once(folder, name, out.getvalue())

    @classmethod
    def load(cls, data: bytes) -> Head:
        f = np.load(io.BytesIO(data))
        return cls(str(f["kind"]), [f[f"p{i}"] for i in range(sum(k.startswith("p") for k in f.files))], [str(n) for n in f["names"]])


def fit(rows: DataFrame, terms: int, names: list[str], kind: str, epochs: int = 40, hidden: int = 64, rate: float = 0.05, decay: float = 0.0, seed: int = 7) -> Head:
    """A head for rows (doc, places, values, y) with the labels names, after so many steps over all of them."""
    return fit_kinds(rows, terms, names, (kind,), epochs, hidden, rate, decay, seed)[kind]


def fit_kinds(
    rows: DataFrame, terms: int, names: list[str], kinds: Sequence[str] = KINDS, epochs: int = 40, hidden: int = 64, rate: float = 0.05, decay: float = 0.0, seed: int = 7
) -> dict[str, Head]:
    """A head of each kind, as fit gives it; a step of all of them is one pass over the rows."""
    tables = Tables(rows.sparkSession, "head")
    rows = tables.save(rows, "rows")
    heads = [Head.begin(kind, terms, names, hidden, seed) for kind in kinds]
    sums = rows.select(F.posexplode("y").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("n")).orderBy("k").collect()  # a row for each label
    total = rows.count()
    if not total or not names:
        return dict(zip(kinds, heads, strict=True))
    held = np.maximum(np.array([s["n"] for s in sums], float), 1)
    positive = np.minimum((total - held) / held, POSITIVE_MOST)
    parts = [p for head in heads for p in head.parts]
    sizes = [p.size for p in parts]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]

    for epoch in range(1, epochs + 1):

        def step(batches: Iterator[pa.RecordBatch], heads: list[Head] = heads, epoch: int = epoch) -> Iterator[pa.RecordBatch]:
            sums, losses = np.zeros(sum(sizes)), np.zeros(len(heads))
            for part, x in _blocks(batches, terms):
                y = part.column("y").flatten().to_numpy().reshape(len(x), -1).astype(float)
                own = []
                for i, head in enumerate(heads):
                    mask = _mask(part.column("doc").to_numpy(), hidden, epoch) if head.kind == "mlp" else None
                    gradients, loss = head.gradient(x, y, positive, mask)
                    own += [g.ravel() for g in gradients]
                    losses[i] += loss
                sums += np.concatenate(own)
            out = np.append(sums, losses)
            yield pa.RecordBatch.from_pydict({"place": pa.array(np.arange(len(out)), pa.int32()), "v": out})

        added = rows.mapInArrow(step, "place int, v double").groupBy("place").agg(F.sum("v").alias("v")).toPandas()  # as many rows as parameters
        flat = added.sort_values("place")["v"].to_numpy() / (total * len(names))
        for head, loss in zip(heads, flat[sum(sizes) :], strict=True):
            head.losses.append(float(loss))
        at = 0
        for i, p in enumerate(parts):
            g = flat[at : at + sizes[i]].reshape(p.shape) + decay * p
            at += sizes[i]
            first[i] = BETA_1 * first[i] + (1 - BETA_1) * g
            second[i] = BETA_2 * second[i] + (1 - BETA_2) * g * g
            p -= rate * (first[i] / (1 - BETA_1**epoch)) / (np.sqrt(second[i] / (1 - BETA_2**epoch)) + TINY)
    if not all(np.isfinite(p).all() for p in parts):
        raise ValueError("the head's parameters are not finite")
    return dict(zip(kinds, heads, strict=True))


def scores(head: Head, rows: DataFrame, terms: int) -> DataFrame:
    """(doc, label, score): the probability of each label for each document; no unit is dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, terms):
            p = _sigmoid(head.logits(x)[0])
            docs = part.column("doc").take(pa.array(np.repeat(np.arange(len(x)), len(head.names))))
            yield pa.RecordBatch.from_arrays([docs, pa.array(head.names * len(x), pa.string()), pa.array(p.ravel())], ["doc", "label", "score"])

    kind = dict(rows.dtypes)["doc"]
    return rows.select("doc", "places", "values").mapInArrow(run, f"doc {kind}, label string, score double")
