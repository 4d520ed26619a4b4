"""Vectors of sections and queries through an embedder that each task loads once.

Sections whose stored vector is missing or of another content are embedded in batches; the others are passed over. How many were
embedded, passed over and longer than the embedder takes are metrics that the run observes as it goes, not a second pass.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from codicil.functions.text import embedding_key, embedding_text

#: Texts that an embedder gets at once.
AT_ONCE = 64


class Embedder(Protocol):
    """What a model has to offer."""

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...

    def truncated(self, texts: Sequence[str]) -> list[bool]:
        """Whether each text is longer than the model reads."""
        ...


class HashedWords:
    """An embedder without a model: signed counts of hashed words at unit length; it reads the first ``limit`` words."""

    def __init__(self, size: int = 64, limit: int = 256):
        self.size, self.limit = size, limit

    def _words(self, text: str) -> list[str]:
        return re.findall("[a-z0-9]+", text.lower())

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.size))
        for row, text in zip(out, texts, strict=True):
            for word in self._words(text)[: self.limit]:
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % self.size] += 1 if h >> 63 else -1
        return (out / np.maximum(np.linalg.norm(out, axis=1), 1e-12)[:, None]).tolist()

    def truncated(self, texts: Sequence[str]) -> list[bool]:
        return [len(self._words(t)) > self.limit for t in texts]


def _vectors(rows: DataFrame, make: Callable[[], Embedder], kept: list[str]) -> DataFrame:
    """rows (kept columns, body, todo) with embedding (null unless todo) and truncated."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embedder = make()
        for f in frames:
            for at in range(0, len(f), AT_ONCE):
                part = f.iloc[at : at + AT_ONCE]
                texts = part["body"].fillna("").tolist()
                asked = [t for t, todo in zip(texts, part["todo"], strict=True) if todo]
                made = iter(embedder.embed(asked) if asked else [])
                vectors = [next(made) if todo else None for todo in part["todo"]]
                yield part[kept].assign(embedding=vectors, truncated=embedder.truncated(texts), todo=part["todo"])

    types = dict(rows.dtypes)
    fields = ", ".join(f"`{c}` {types[c]}" for c in kept)
    return rows.select(*kept, "body", "todo").mapInPandas(run, f"{fields}, embedding array<double>, truncated boolean, todo boolean")


def embed_sections(sections: DataFrame, stored: DataFrame, make: Callable[[], Embedder], model: str, only_missing: bool = False) -> tuple[DataFrame, Observation]:
    """(section_id, model_id, content_sha256, embedding) to be stored, and the run's metrics embedded, skipped and truncated.

    sections: section_id, heading, text; stored: section_id, model_id, content_sha256. Vectors of other models don't count. The metrics
    are there once the rows were computed.
    """
    old = stored.where(F.col("model_id") == model).select("section_id", F.col("content_sha256").alias("_old"), F.lit(True).alias("_there"))
    rows = sections.select("section_id", embedding_text(F.col("heading"), F.col("text")).alias("body"), embedding_key(F.col("heading"), F.col("text")).alias("content_sha256")).join(old, "section_id", "left")
    todo = F.col("_there").isNull() if only_missing else ~F.col("content_sha256").eqNullSafe(F.col("_old"))
    made = _vectors(rows.withColumn("todo", todo), make, ["section_id", "content_sha256"])
    seen = Observation()
    made = made.observe(seen, F.count_if("todo").alias("embedded"), F.count_if(~F.col("todo")).alias("skipped"), F.count_if("truncated").alias("truncated"))
    return made.where("todo").select("section_id", F.lit(model).alias("model_id"), "content_sha256", "embedding"), seen


def query_vectors(queries: DataFrame, make: Callable[[], Embedder]) -> DataFrame:
    """(query_id, as_of, query_embedding) of queries (query_id, text, as_of)."""
    rows = queries.select("query_id", "as_of", F.col("text").alias("body"), F.lit(True).alias("todo"))
    return _vectors(rows, make, ["query_id", "as_of"]).select("query_id", "as_of", F.col("embedding").alias("query_embedding"))


def filled(sections: DataFrame, stored: DataFrame, make: Callable[[], Embedder], model: str) -> DataFrame:
    """(section_id, embedding) of all sections: the stored vector of their content, else one that is made on the fly."""
    new, _ = embed_sections(sections, stored.select("section_id", "model_id", "content_sha256"), make, model)
    current = sections.select("section_id", embedding_key(F.col("heading"), F.col("text")).alias("content_sha256"))
    old = stored.where(F.col("model_id") == model).join(current, ["section_id", "content_sha256"]).select("section_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return old.unionByName(new.select("section_id", "embedding"))
