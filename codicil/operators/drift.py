"""Drift of label shares and of principal directions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codicil.config import PSI_FLOOR, PSI_THRESHOLD


def population_stability(reference: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """psi and drifted of two tables' shares by key: floored, scaled to one again; uniform if a side has no rows."""
    a = reference.groupBy(key).agg(F.count(F.lit(1)).alias("a"))
    b = current.groupBy(key).agg(F.count(F.lit(1)).alias("b"))
    both = a.join(b, key, "full_outer").select(F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    rows = F.collect_list(F.struct("a", "b"))  # a row for each label
    packed = both.agg(rows.alias("r"), F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    floored = lambda x, total: F.greatest(F.when(total > 0, x / total).otherwise(1.0 / F.size("r")), F.lit(PSI_FLOOR))
    one = packed.select(F.transform("r", lambda x: F.struct(floored(x["a"], F.col("sa")).alias("a"), floored(x["b"], F.col("sb")).alias("b"))).alias("r"))
    total = lambda side: F.aggregate("r", F.lit(0.0), lambda s, x: s + x[side])
    two = one.select("r", total("a").alias("ta"), total("b").alias("tb"))
    term = lambda x: (x["b"] / F.col("tb") - x["a"] / F.col("ta")) * F.log((x["b"] / F.col("tb")) / (x["a"] / F.col("ta")))
    psi = F.aggregate("r", F.lit(0.0), lambda s, x: s + term(x))
    return two.select(psi.alias("psi"), (psi > PSI_THRESHOLD).alias("drifted"))


def moments(rows: DataFrame, column: str, size: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, sums and the matrix of summed products of vectors, added up in the cluster."""

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, p = 0, np.zeros(size), np.zeros((size, size))
        for f in frames:
            if len(f):
                x = np.stack(f[column].to_numpy()).astype(float)
                n, s, p = n + len(x), s + x.sum(0), p + x.T @ x
        yield pd.DataFrame({"i": np.arange(size), "n": n, "s": s, "p": list(p)})

    parts = rows.select(column).mapInPandas(partial, "i int, n long, s double, p array<double>")
    cells = [F.sum(F.get("p", F.lit(j))).alias(f"p{j}") for j in range(size)]
    got = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), *cells).orderBy("i").collect()  # size rows
    if not got:
        return 0, np.zeros(size), np.zeros((size, size))
    return int(got[0]["n"]), np.array([r["s"] for r in got]), np.array([r[3:] for r in got])


def principal_shift(reference: DataFrame, current: DataFrame, column: str, size: int, components: int = 2, steps: int = 30) -> tuple[float, list[float]]:
    """Distance between both means along the reference's principal directions, and the share of variance that each explains.

    Directions come from power iteration with deflation on the reference's covariance, from a fixed start.
    """
    n, s, p = moments(reference, column, size)
    m, t, _ = moments(current, column, size)
    if not n or not m:
        return 0.0, []
    mean = s / n
    cov = p / n - np.outer(mean, mean)
    shift, explained, whole = [], [], cov.copy()
    for _ in range(components):
        v = np.ones(size) / np.sqrt(size)
        for _ in range(steps):
            w = cov @ v
            length = np.linalg.norm(w)
            if length == 0:
                break
            v = w / length
        value = float(v @ cov @ v)
        explained.append(float(v @ whole @ v) / float(np.trace(whole)) if np.trace(whole) > 0 else 0.0)
        shift.append(float(v @ (t / m - mean)))
        cov = cov - value * np.outer(v, v)
    return float(np.linalg.norm(shift)), explained
