"""Which windows hold which dates: a range join through day spans that both sides share.

Days from the first to the last date form a tree of spans of 1, 2, 4, 8, ... days. A half-open window is the union of at
most two spans of each size, none within another; a date lies in one span of each size. So a window holds a date exactly if they
share one span, and they share at most one: an equal join on the span finds every pair once, whatever the windows' lengths.
A span that many dates share is dealt over salts, to which its windows are copied, so that open windows do not meet all dates in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codicil.sources.working import few

#: Dates of one span that meet its windows in one task.
SPAN_DATES = 5_000
#: Sizes of spans: 2**0 to 2**LEVELS days, more than any two dates are apart.
LEVELS = 22


def window_spans(start: Column, end: Column) -> Column:
    """Spans (size, place) that the window of day numbers [start, end) is made of."""
    span = lambda size, place: F.array(F.struct(size.alias("size"), place.cast("long").alias("place")))
    none = F.array().cast("array<struct<size:int,place:bigint>>")
    begin = F.struct(start.cast("long").alias("a"), end.cast("long").alias("b"), none.alias("spans"))

    def step(state: Column, size: Column) -> Column:
        a, b = state["a"], state["b"]
        left, right = (a < b) & (a % 2 == 1), (a < b) & (b % 2 == 1)
        first = F.when(left, span(size, a)).otherwise(none)
        # one day that is both ends is one span
        last = F.when(right & ~(left & (a + 1 >= b)), span(size, b - 1)).otherwise(none)
        return F.struct(F.shiftright(F.when(left, a + 1).otherwise(a), 1).alias("a"), F.shiftright(F.when(right, b - 1).otherwise(b), 1).alias("b"), F.concat(state["spans"], first, last).alias("spans"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), begin, step, lambda state: state["spans"])


def date_spans(day: Column) -> Column:
    """The span of each size in which a day number lies."""
    return F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda size: F.struct(size.alias("size"), F.call_function("shiftright", day.cast("long"), size).alias("place")))


def applicable(cases: DataFrame, policies: DataFrame, kept: tuple[str, ...] = ("policy_id",)) -> DataFrame:
    """(case_id, kept columns) for each case (case_id, case_date) and each policy whose half-open window holds its date.

    Null bounds are open. Cases without a date have no row.
    """
    dated = cases.where("case_date IS NOT NULL").select("case_id", F.unix_date("case_date").alias("_day"))
    edges = dated.agg(F.min("_day").alias("first"), F.max("_day").alias("last")).first()
    first, last = (edges["first"] or 0), (edges["last"] or 0)
    spans = dated.select("case_id", F.explode(date_spans(F.col("_day") - first)).alias("s"))
    start = F.greatest(F.coalesce(F.unix_date("effective_from"), F.lit(first)), F.lit(first)) - first
    end = F.least(F.coalesce(F.unix_date("effective_to"), F.lit(last + 1)), F.lit(last + 1)) - first
    windows = policies.select(*kept, F.explode(window_spans(start, end)).alias("s"))
    used = windows.select("s").distinct()
    spans = spans.join(few(used), "s", "left_semi")  # dates move only for spans that some window has
    salts = few(spans.groupBy("s").agg(F.ceil(F.count(F.lit(1)) / SPAN_DATES).cast("int").alias("salts")).where("salts > 1"))
    salted = spans.join(salts, "s", "left").withColumn("salt", F.pmod(F.xxhash64("case_id"), F.coalesce("salts", F.lit(1))).cast("int"))
    copied = windows.join(salts, "s", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    return salted.drop("salts").join(copied.drop("salts"), ["s", "salt"]).select("case_id", *kept)


def applicable_sums(cases: DataFrame, policies: DataFrame, by: str) -> DataFrame:
    """(case_id, by, policies, first_policy, policy_sum): number, least id and sum of ids of the policies whose windows hold a case's date.

    Policies of one window and value of by are summed up before dates meet them, and cases of one date are one date, so what
    is joined is bounded by days and values, whatever the numbers of cases and policies.
    """
    window = policies.groupBy(by, "effective_from", "effective_to").agg(F.count(F.lit(1)).alias("n"), F.min("policy_id").alias("least"), F.sum("policy_id").alias("ids"))
    days = cases.where("case_date IS NOT NULL").select("case_date").distinct().select(F.unix_date("case_date").alias("case_id"), "case_date")
    sums = applicable(days, window, (by, "n", "least", "ids")).groupBy("case_id", by).agg(F.sum("n").alias("policies"), F.min("least").alias("first_policy"), F.sum("ids").alias("policy_sum"))
    dated = cases.where("case_date IS NOT NULL").select("case_id", F.unix_date("case_date").alias("_day"))
    sums = few(sums.withColumnRenamed("case_id", "_day"))  # a row for each day and value
    return dated.groupBy("case_id", "_day").agg(F.count(F.lit(1)).alias("_times")).join(sums, "_day").groupBy("case_id", by).agg(
        F.sum(F.col("policies") * F.col("_times")).alias("policies"), F.min("first_policy").alias("first_policy"), F.sum(F.col("policy_sum") * F.col("_times")).alias("policy_sum")
    )
