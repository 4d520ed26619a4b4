"""Approximate nearest vectors: an inverted file of coarse cells with residual codes, and exact scores for the best candidates.

Vectors are taken at unit length, so that the cosine is a product. Coarse centres come from Spark's distributed k-means over all vectors;
each vector goes to its nearest centre, and what is left of it is coded by one byte for each subspace, the nearest of its code words. A query
looks into its nearest cells, adds up products with code words from a table that it makes once, keeps the best candidates, and
scores these exactly. How many cells are nearest enough is measured: as many as hold the share ``REACHED`` of the true neighbours of ``TRIED``
indexed vectors, which are searched exactly once. Cells with more than ``CELL_ROWS`` rows are dealt over parts, so that no task holds a whole popular cell.

Rows with one vector and window are one row of the index, that of the least id; a found row stands for its copies, of which as many as are
wanted take part. A query's own direction is always a candidate, and a query with fewer rows than it wants (its nearest cells
hold few that are in force) looks into all cells.

Code words are fitted on at most ``SAMPLE`` vectors, taken by their hash; every vector is indexed. Vectors that are null, empty, zero or
of another length than the index are not indexed, as they are near to nothing. The exact search is :func:`codicil.operators.retrieval.vector_scores`.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codicil.config import SCORE_DIGITS
from codicil.functions.vectors import cosine
from codicil.operators import best
from codicil.sources.working import Tables, few

#: Most rows of a part of a cell, and vectors on which code words are fitted.
CELL_ROWS, SAMPLE = 20_000, 16_384
SUBSPACES, WORDS, CELLS_MOST = 16, 256, 4_096
ROUNDS = 12
#: Vectors whose true neighbours decide how many cells a query looks into, their number of neighbours, and the share to be reached.
TRIED, NEIGHBOURS, REACHED = 64, 10, 0.97
#: Candidates scored exactly for each wanted row.
CANDIDATES_EACH = 16
#: Copies of one vector that can be among a query's best; a query wants no more rows.
COPIES = 1_000
#: Days that stand for open bounds.
FIRST, LAST = -(2**31), 2**31 - 1


def unit(vector: Column) -> Column:
    """The vector at unit length, null where it has none."""
    v = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm))


def code_words(vectors: np.ndarray, seed: int = 7) -> list[np.ndarray]:
    """Code words of each subspace by Lloyd's rounds over the sample."""
    rng, out = np.random.default_rng(seed), []
    for part in np.array_split(vectors, min(SUBSPACES, vectors.shape[1]), axis=1):
        points = np.unique(part, axis=0)
        words = points[rng.permutation(len(points))[:WORDS]]
        for _ in range(ROUNDS):
            near = nearest(part, words)
            sums = np.zeros_like(words)
            np.add.at(sums, near, part)
            n = np.bincount(near, minlength=len(words))[:, None]
            words = np.where(n > 0, sums / np.maximum(n, 1), words)
        out.append(words)
    return out


def nearest(points: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Index of the nearest word of each point."""
    out = np.empty(len(points), np.int64)
    for at in range(0, len(points), 4096):
        block = points[at : at + 4096]
        out[at : at + 4096] = ((words * words).sum(1) - 2 * block @ words.T).argmin(1)
    return out


class VectorIndex:
    """Cells of coded vectors. rows: (cell, part, id, code, opens, closes); cells: (cell, centre, parts); copies: (id, copy, nth); units: (id, v, opens, closes)."""

    def __init__(self, tables: Tables, rows: DataFrame, cells: DataFrame, words: list[np.ndarray], d: int, copies: DataFrame, units: DataFrame):
        self.tables, self.rows, self.cells, self.words, self.d, self.copies, self.units = tables, rows, cells, words, d, copies, units
        self.n_cells = self.probed = cells.count()

    @classmethod
    def build(cls, vectors: DataFrame, cells: int | None = None) -> VectorIndex | None:
        """Index vectors (id, embedding, and days effective_from and effective_to where they have them); none where there is none."""
        tables = Tables(vectors.sparkSession, "vectors")
        day = lambda c, else_: F.coalesce(F.unix_date(c), F.lit(else_)) if c in vectors.columns else F.lit(else_)
        known = vectors.select("id", unit(F.col("embedding")).alias("v"), day("effective_from", FIRST).alias("opens"), day("effective_to", LAST).alias("closes"))
        known = tables.save(known.where("v IS NOT NULL"), "every")
        alike = ["v", "opens", "closes"]
        first = tables.save(known.groupBy(*alike).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "first")
        # copies move only where a vector has some; null ids have none
        more = known.join(first.where("n > 1").drop("n"), alike).select(F.col("first").alias("id"), F.col("id").alias("copy"))
        copies = tables.save(more.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("copy"))).where(F.col("nth") <= COPIES), "copies")
        known = tables.save(first.where("first IS NOT NULL").select(F.col("first").alias("id"), *alike), "unit")
        sizes = known.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        if sizes is None:
            return None
        d = sizes["d"]
        known = known.where(F.size("v") == d)
        k = cells or int(min(CELLS_MOST, max(1, round(sizes["count"] ** 0.5))))
        points = known.withColumn("features", array_to_vector("v"))
        model = KMeans(k=max(2, k), seed=7, maxIter=10).fit(points) if k > 1 and sizes["count"] > 1 else None
        centres = [c.tolist() for c in model.clusterCenters()] if model else [[0.0] * d]
        placed = model.transform(points).withColumnRenamed("prediction", "cell") if model else points.withColumn("cell", F.lit(0))
        centre_rows = vectors.sparkSession.createDataFrame(list(enumerate(centres)), "cell int, centre array<double>")  # CELLS_MOST rows at most
        rest = F.zip_with("v", "centre", lambda a, b: a - b)
        placed = tables.save(placed.drop("features").join(F.broadcast(centre_rows), "cell").select("cell", "id", rest.alias("rest"), "opens", "closes"), "placed")
        sample = placed.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("rest").toPandas()
        words = code_words(np.array(sample["rest"].tolist()))

        def code(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                parts = np.array_split(np.array(f.pop("rest").tolist()).reshape(-1, d), len(words), axis=1)
                codes = np.stack([nearest(p, w) for p, w in zip(parts, words, strict=True)], axis=1).astype(np.uint8)
                yield f.assign(code=[c.tobytes() for c in codes])

        sizes_by_cell = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).cast("int").alias("parts"))
        cell_rows = tables.save(centre_rows.join(sizes_by_cell, "cell"), "cells")
        coded = placed.mapInPandas(code, "cell int, id long, opens int, closes int, code binary").join(F.broadcast(cell_rows.drop("centre")), "cell")
        coded = coded.withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).drop("parts")
        index = cls(tables, tables.save(coded, "rows", "cell"), cell_rows, words, d, copies, known)
        index.calibrate(known)
        return index

    def calibrate(self, known: DataFrame) -> None:
        """Set how many cells a query looks into (known: id and unit vectors v)."""
        tried = self.tables.save(known.orderBy(F.xxhash64("id"), "id").limit(TRIED).select(F.col("id").alias("query_id"), F.col("v").alias("query_embedding")), "tried")
        rows = known.select("id", F.lit(FIRST).cast("long").alias("opens"), F.lit(LAST).cast("long").alias("closes"), F.col("v").alias("embedding"))
        exact = best.vector_best(tried.withColumn("day", F.lit(0)), rows, NEIGHBOURS, [F.col("id").asc()], ["id"])
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id"))
        true = exact.withColumn("n", nth).where(F.col("n") <= NEIGHBOURS).join(self.rows.select("id", F.col("cell").alias("own")), "id")
        order = self.probes(tried, self.n_cells).groupBy("query_id", F.col("cell").alias("own")).agg(F.max("nth").alias("nth"))
        ranks = true.join(order, ["query_id", "own"]).groupBy("nth").count().orderBy("nth").collect()  # a row for each cell at most
        total, met = sum(r["count"] for r in ranks), 0
        for r in ranks:
            met += r["count"]
            if met >= REACHED * total:
                self.probed = r["nth"]
                return

    def probes(self, queries: DataFrame, probed: int) -> DataFrame:
        """(query_id, as_of day, v, near, cell, part, nth) of the cells that each query looks into."""
        day = F.unix_date("as_of") if "as_of" in queries.columns else F.lit(None).cast("int")
        q = queries.select("query_id", day.alias("day"), unit(F.col("query_embedding")).alias("v")).where(F.size("v") == self.d)
        dot = F.aggregate(F.zip_with("v", "centre", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        length = F.aggregate("centre", F.lit(0.0), lambda a, x: a + x * x)
        met = q.crossJoin(F.broadcast(self.cells)).withColumn("near", dot)  # cells are CELLS_MOST at most
        nearest_first = Window.partitionBy("query_id").orderBy((length - 2 * dot).asc(), "cell")
        met = met.withColumn("nth", F.row_number().over(nearest_first)).where(F.col("nth") <= probed)
        return met.select("query_id", "day", "v", "near", "cell", "nth", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def candidates(self, queries: DataFrame, each: int, probed: int | None = None) -> DataFrame:
        """(query_id, id): for each query (query_id, query_embedding, as_of if dated) the best by codes; dates are tested before."""
        words = self.words

        def search(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
            if rows.empty or asked.empty:
                return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "id": pd.Series(dtype="int64"), "guess": pd.Series(dtype="float64")})
            codes = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), len(words))
            out = []
            for q in asked.itertuples(index=False):
                table = [w @ p for w, p in zip(words, np.array_split(np.array(q.v), len(words)), strict=True)]
                guess = q.near + sum(t[codes[:, m]] for m, t in enumerate(table))
                if not pd.isna(q.day):
                    guess = np.where((rows["opens"] <= q.day) & (rows["closes"] > q.day), guess, -np.inf)
                first = np.argsort(-guess, kind="stable")[:each]
                first = first[np.isfinite(guess[first])]
                out.append(pd.DataFrame({"query_id": q.query_id, "id": rows["id"].to_numpy()[first], "guess": guess[first]}))
            return pd.concat(out)

        asked = self.probes(queries, probed or self.probed)
        found = self.rows.groupBy("cell", "part").cogroup(asked.groupBy("cell", "part")).applyInPandas(search, "query_id long, id long, guess double")
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("guess"), "id"))
        return found.withColumn("nth", nth).where(F.col("nth") <= each).select("query_id", "id")

    def alike(self, queries: DataFrame) -> DataFrame:
        """(query_id, id): indexed rows of each query's own direction."""
        asked = queries.select("query_id", unit(F.col("query_embedding")).alias("v"), *([F.unix_date("as_of").alias("day")] if "as_of" in queries.columns else [])).where("v IS NOT NULL")
        met = self.units.join(asked, "v")
        return (met.where("day IS NULL OR opens <= day AND closes > day") if "as_of" in queries.columns else met).select("query_id", "id")

    def search(self, queries: DataFrame, vectors: DataFrame, k: int, probed: int | None = None) -> DataFrame:
        """query_id, id, score, rank: the k best candidates by their exact cosine with vectors (id, embedding)."""
        if k > COPIES:
            raise ValueError(f"a search may want {COPIES} rows")
        found = self.tables.save(self._scored(queries, vectors, k, probed), f"found-{uuid.uuid4().hex[:8]}")
        if (probed or self.probed) < self.n_cells:
            enough = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
            short = queries.join(few(enough), "query_id", "left_anti")
            more = self._scored(short, vectors, k, self.n_cells)
            found = found.join(few(enough), "query_id", "left_semi").unionByName(more)
        return found

    def _scored(self, queries: DataFrame, vectors: DataFrame, k: int, probed: int | None) -> DataFrame:
        found = self.candidates(queries, k * CANDIDATES_EACH, probed).union(self.alike(queries)).distinct()
        copied = found.join(self.copies.where(F.col("nth") <= k), "id").select("query_id", F.col("copy").alias("id"))
        found = found.union(copied).distinct()
        scored = vectors.select("id", "embedding").join(found, "id").join(few(queries.select("query_id", "query_embedding")), "query_id")
        scored = scored.select("query_id", "id", F.round(cosine(F.col("embedding"), F.col("query_embedding")), SCORE_DIGITS).alias("score"))
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        return scored.withColumn("rank", nth).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id, wanted, met: how many of the exact rows (query_id, id) were found."""
    hit = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("met"))
