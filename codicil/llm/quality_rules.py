"""Quality rules: text statistics and a learned decision list, all in DataFrame expressions.

Statistics of each text come from array functions inside one projection, without a shuffle. A decision list is
grown by sequential covering over the labelled rows: each rule is a conjunction of thresholds that adds, one at
a time, the condition of greatest information gain on the growing rows, and is then cut back to the prefix that
does best on the pruning rows. Candidates are read off histograms (feature, bin, label counts) that Spark
aggregates over all labelled rows; only these counts, at most features x bins rows, reach the driver. The list
becomes one ordered ``when`` expression.

Words are runs of ``[^\\x20\\x09-\\x0D]``. Repeated words are those in five-word windows found twice or more in
their text; windows are compared by 64-bit hashes of their words' hashes.

Edge cases: a null text counts as empty; texts without words fail the base rule (n_words < 10). Without labels
of both kinds the list is empty and only the base rule decides. A document with both labels counts as bad. Rows with a null id take no part in learning but
are judged. Rows that repeat an id are judged each by its own text. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codicil.llm.scratch import Scratch

WINDOW = 5
#: Thresholds tried for each feature, conditions in a rule, rules in a list.
BINS, CONDITIONS, RULES = 32, 3, 8
#: Least precision of a rule on the pruning rows, and least rejected rows there.
PRECISION, SUPPORT = 0.9, 2
SPACE = " \t\n\x0b\f\r"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What rules may test, from the statistics of a row.
FEATURES = {
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "words": "cast(n_words as double)",
}


def _repeated(grams: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more; grams: hash of the window at each place."""
    pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = lambda s: F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
    places = lambda s: F.sort_array(F.transform(twice(s), lambda x: x["i"]))
    # each place covers its window or, if the next place is nearer, up to that
    cover = lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b)
    once = lambda value, then: F.element_at(F.transform(F.array(value), then), 1)  # evaluates value one time
    return once(pairs, lambda s: once(places(s), cover)).cast("long")


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with BASE and the counts that FEATURES need, prefixed as they are named."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    df = docs.withColumn("_words", F.array_remove(F.split(F.translate(t, SPACE[1:], " " * 5), " ", -1), ""))
    df = df.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    h = F.col("_hashes")
    n_grams = F.size(h) - (WINDOW - 1)
    window = lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, WINDOW)))
    df = df.withColumn("_grams", F.when(n_grams > 1, F.transform(F.slice(h, 1, F.greatest(n_grams, F.lit(0))), window)).otherwise(F.array().cast("array<bigint>")))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0)
    df = df.withColumn("_lines", lines)
    g = F.col("_grams")
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("long")
    out = {
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": count("[#*$%&|<>]"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.when(F.size(F.array_distinct(g)) < F.size(g), _repeated(g)).otherwise(F.lit(0).cast("long")),
        "n_lines": F.size("_lines").cast("long"),
        "n_upper": count(r"\p{Lu}"),
        "n_marks": count("[!?.,;:]"),
        "n_digits": count("[0-9]"),
        "n_distinct": F.size(F.array_distinct("_hashes")).cast("long"),
    }
    # a generator, so that no filter on the statistics is moved below them and computes them again
    row = F.inline(F.array(F.struct(*(c.alias(name) for name, c in out.items()))))
    return df.select(*(F.col(f"`{c}`") for c in docs.columns), row)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


Condition = tuple[str, str, float]  # feature, ">=" or "<", threshold


def _test(rule: list[Condition], columns: dict[str, Column]) -> Column:
    test = F.lit(True)
    for feature, op, at in rule:
        test = test & ((columns[feature] >= F.lit(at)) if op == ">=" else (columns[feature] < F.lit(at)))
    return test


def _bin(value: Column, cuts: list[float]) -> Column:
    """How many of the cuts the value reaches."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= value))


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _best_condition(rows: DataFrame, cuts: dict[str, list[float]]) -> tuple[Condition | None, float, float]:
    """Condition of greatest gain for bad rows, with bad and good rows that it covers."""
    names = list(cuts)
    bins = F.posexplode(F.array(*(F.col(f"bin_{f}") for f in names))).alias("f", "bin")
    hist = rows.select("bad", bins).groupBy("f", "bin").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()
    best: tuple[float, Condition | None, float, float] = (1e-9, None, 0, 0)
    for i, f in enumerate(names):
        own = {r["bin"]: (r["p"], r["n"]) for r in hist if r["f"] == i}
        p0, n0 = (sum(x[k] for x in own.values()) for k in (0, 1))
        if not p0:
            return None, 0, 0
        p = n = 0
        for k, cut in enumerate(cuts[f]):  # bin k holds values under cut k, and no smaller bin's
            p, n = p + own.get(k, (0, 0))[0], n + own.get(k, (0, 0))[1]
            for op, a, b in (("<", p, n), (">=", p0 - p, n0 - n)):
                best = max(best, (_gain(a, b, p0, n0), (f, op, cut), a, b), key=lambda x: x[0])
    return best[1], best[2], best[3]


def learn(stats: DataFrame, labels: DataFrame, scratch: Scratch) -> list[list[Condition]]:
    """Ordered rules that reject, from statistics with doc_id and labels (doc_id, quality: 0 is bad)."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (1 - F.col("quality").cast("int")).alias("bad"))
    own = own.where("doc_id is not null and bad in (0, 1)").groupBy("doc_id").agg(F.max("bad").alias("bad"))
    rows = stats.where(~base_failed()).join(own, "doc_id").select("doc_id", "bad", *(F.expr(e).alias(f) for f, e in FEATURES.items()))
    rows = scratch.save(rows, "labelled")
    shares = [i / BINS for i in range(1, BINS)]
    # cuts come from both kinds, so that the few bad rows have theirs
    found = rows.groupBy("bad").agg(*(F.percentile_approx(f, shares, 2000).alias(f) for f in FEATURES)).collect()
    if len(found) < 2:
        return []
    cuts = {f: sorted({float(x) for r in found for x in r[f] or []}) for f in FEATURES}
    binned = {f"bin_{f}": _bin(F.col(f), c) for f, c in cuts.items()}
    rows = scratch.save(rows.withColumns(binned).withColumn("prune", F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0), "binned")
    columns = {f: F.col(f) for f in FEATURES}
    rules: list[list[Condition]] = []
    while len(rules) < RULES:
        left = rows
        for r in rules:
            left = left.where(~_test(r, columns))
        rule: list[Condition] = []
        while len(rule) < CONDITIONS:
            condition, p, n = _best_condition(left.where("not prune").where(_test(rule, columns)), cuts)
            if condition is None:
                break
            rule.append(condition)
            if not n:
                break
        if not rule:
            break
        sums = [F.sum(F.when(_test(rule[:k], columns), x)) for k in range(1, len(rule) + 1) for x in (F.col("bad"), 1 - F.col("bad"))]
        got = [x or 0 for x in left.where("prune").agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).first()]
        worth = [((got[2 * k] - got[2 * k + 1]) / max(1, got[2 * k] + got[2 * k + 1]), -k) for k in range(len(rule))]
        k = -max(worth)[1]
        p, n = got[2 * k], got[2 * k + 1]
        if p < SUPPORT or p / (p + n) < PRECISION:
            break
        rules.append(rule[: k + 1])
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """Whether a row with statistics is kept: the base rule, then the list's first rule that holds."""
    columns = {f: F.expr(e) for f, e in FEATURES.items()}
    list_ = F.when(base_failed(), False)
    for r in rules:
        list_ = list_.when(_test(r, columns), False)
    return list_.otherwise(True)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, BASE, base_failed and kept for each row of docs (doc_id, text)."""
    with Scratch(docs.sparkSession, "quality") as scratch:
        stats = scratch.save(statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("text"), "stats")
        rules = learn(stats, labels, scratch)
        return scratch.result(stats.select("doc_id", *BASE, base_failed().alias("base_failed"), verdict(rules).alias("kept")))


def kept_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all their columns.

    Rows are written once beside their statistics, so no text is shuffled and no statistic computed twice.
    """
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("text"))
    lasting = Scratch(docs.sparkSession, "judged")
    judged = lasting.save(statistics(row).drop("text"), "rows")
    lasting.close_at_exit()
    with Scratch(docs.sparkSession, "quality") as scratch:
        rules = learn(judged.select(F.col("_row.doc_id").cast("long").alias("doc_id"), *(c for c in judged.columns if c != "_row")), labels, scratch)
    return judged.where(verdict(rules)).select("_row.*")
