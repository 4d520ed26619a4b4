"""Ranking quality, percentiles, round-robin samples and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codicil.functions.vectors import discounted_gain
from codicil.sources.working import Tables

#: Cells that a group's distinct values are dealt to when exact percentiles are looked for.
CELLS = 256


def relevant(section: Column, document: Column, gold_sections: Column, gold_documents: Column) -> Column:
    """Gold sections decide; gold documents only where there are none."""
    return F.when(F.size(gold_sections) > 0, F.array_contains(gold_sections, section)).when(F.size(gold_documents) > 0, F.array_contains(gold_documents, document)).otherwise(F.lit(False))


def number_matches(ref: Column, prefixes: list[str]) -> Column:
    """Whether a reference is one of the numbers, or one with a # or ~ suffix; never a longer number."""
    match = F.lit(False)
    for p in prefixes:
        match = match | (ref == p) | F.startswith(ref, F.lit(p + "#")) | F.startswith(ref, F.lit(p + "~"))
    return match


def query_metrics(judged: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 5, 10), k: int = 10) -> DataFrame:
    """judged: (query_id, rank, hit); gold: (query_id, n). A row for each gold query with recall, mrr and ndcg."""
    hit_at = F.min(F.when(F.col("hit"), F.col("rank")))
    per = judged.groupBy("query_id").agg(hit_at.alias("first"), F.sum(F.when(F.col("hit") & (F.col("rank") <= k), discounted_gain(F.col("rank"))).otherwise(0.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + discounted_gain(i))
    rows = gold.join(per, "query_id", "left")
    recalls = [F.when(F.col("first") <= x, 1.0).otherwise(0.0).alias(f"recall_{x}") for x in ks]
    return rows.select("query_id", *recalls, F.when(F.col("first") <= k, 1.0 / F.col("first")).otherwise(0.0).alias("mrr"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"))


def mean_metrics(metrics: DataFrame) -> DataFrame:
    """Means over queries; null without queries."""
    return metrics.agg(F.count(F.lit(1)).alias("queries"), *(F.avg(c).alias(c) for c in metrics.columns if c != "query_id"))


def percentiles(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Exact interpolated percentiles, bounds and mean of each group; a null group is one, null values don't count.

    Equal values become one row with their number. Cuts, a group's values that are least by hash, make cells, whose
    running counts say in which cells the wanted ranks lie; only these are ordered, each by itself. Cuts decide on the
    size of cells alone: any give the same percentiles, if only they are the same wherever the plan uses them.
    """
    at = {"p50": 0.5, "p95": 0.95}
    same = F.col("_g").eqNullSafe(F.col("_of"))
    own = rows.select(F.col(by).alias("_g"), F.col(value).alias("_v"))
    # written once: cuts, cells and ranks all read it
    held = Tables(rows.sparkSession, "percentiles").save(own.where(F.col("_v").isNotNull()).groupBy("_g", "_v").agg(F.count(F.lit(1)).alias("_n")), "held")
    turn = F.row_number().over(Window.partitionBy("_g").orderBy(F.xxhash64("_v"), "_v"))
    cuts = held.select("_g", "_v", turn.alias("_turn")).where(F.col("_turn") < CELLS)
    cuts = cuts.groupBy(F.col("_g").alias("_of")).agg(F.sort_array(F.collect_list("_v")).alias("_cuts"))  # fewer than CELLS
    cell = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
    dealt = held.join(cuts, same).select("_g", "_v", "_n", cell.alias("_cell"))
    group = Window.partitionBy("_of")  # at most CELLS rows
    sizes = dealt.groupBy(F.col("_g").alias("_of"), F.col("_cell").alias("_at")).agg(F.sum("_n").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(group.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("_before", before).withColumn("_last", F.sum("_rows").over(group) - 1)
    ends = {c: (F.floor(p * F.col("_last")), F.ceil(p * F.col("_last"))) for c, p in at.items()}
    inside = F.exists(F.array(*(r for pair in ends.values() for r in pair)), lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_rows")))
    found = dealt.join(sizes.where(inside), same & (F.col("_cell") == F.col("_at")))
    found = found.withColumn("_upto", F.col("_before") + F.sum("_n").over(Window.partitionBy("_g", "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    holds = lambda r: F.max(F.when((r < F.col("_upto")) & (r >= F.col("_upto") - F.col("_n")), F.col("_v").cast("double")))
    ranked = found.groupBy(F.col("_g").alias("_of")).agg(F.max("_last").alias("_last"), *(holds(r).alias(f"_{c}_{i}") for c, pair in ends.items() for i, r in enumerate(pair)))

    def between(name: str, p: float) -> Column:
        low, high, place = F.col(f"_{name}_0"), F.col(f"_{name}_1"), p * F.col("_last")
        return F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    facts = own.groupBy("_g").agg(F.min("_v").alias("least"), F.max("_v").alias("most"), F.avg("_v").alias("mean"))
    return facts.join(ranked, same, "left").select(F.col("_g").alias(by), *(between(c, p).alias(c) for c, p in at.items()), "least", "most", "mean")


def round_robin(rows: DataFrame, group: str, key: Column, n: int) -> DataFrame:
    """The first n rows taken in turn from the groups, each ordered by key."""
    turn = rows.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(key))).where(F.col("turn") <= n)
    return turn.orderBy("turn", group).limit(n)


def seeded_sample(rows: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))).limit(n)


def summary(rows: DataFrame) -> DataFrame:
    """rows (category, passed, error): counts, rounded pass rate and failed reasons of each category."""
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("passed"), F.round(F.avg(F.col("passed").cast("int")), 3).alias("rate"))


def reasons(rows: DataFrame) -> DataFrame:
    """How often each error code, the text before a colon, occurs in errors arrays."""
    codes = rows.select(F.explode("errors").alias("e")).select(F.split_part("e", F.lit(":"), F.lit(1)).alias("code"))
    return codes.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
