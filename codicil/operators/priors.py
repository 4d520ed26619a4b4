"""Class prior by naive Bayes on token sets, TF-IDF, splits, rankings and the promotion gate."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codicil.config import PSI_THRESHOLD
from codicil.functions.text import FORM_SETS, TOKEN, synonym_tokens
from codicil.sources.working import Tables, few


#: Texts whose tokens a task holds at once.
AT_ONCE = 512


def word_counts(rows: DataFrame, kept: list[str]) -> DataFrame:
    """kept columns, t, n, more: the distinct tokens of each text, how often each comes, and the tokens of its synonyms' forms, null or empty if it has none.

    A text is split once, by its task; as an expression below an explode it would be split again to look for empty lists. Forms are looked for in
    texts only that have all words of one.
    """
    fields = [f"`{c}` {dict(rows.dtypes)[c]}" for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(TOKEN).findall
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                words, times, ends, held = [], [], [0], []
                for text in part.column(len(kept)).to_pylist():
                    own = Counter(find(text or ""))
                    words += own
                    times += own.values()
                    ends.append(len(words))
                    held.append(text if any(own.keys() >= form for form in FORM_SETS) else None)
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), v) for v in (pa.array(words, pa.string()), pa.array(times, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *lists, pa.array(held, pa.string())], [*kept, "t", "n", "held"])

    split = rows.select(*kept, F.lower("text").alias("_text")).mapInArrow(run, ", ".join([*fields, "t array<string>", "n array<int>", "held string"]))
    return split.select(*kept, "t", "n", F.when(F.col("held").isNotNull(), synonym_tokens(F.col("held"))).alias("more"))


def _expanded() -> Column:
    """The tokens of word_counts with those of synonyms."""
    return F.when(F.col("more").isNull(), F.col("t")).otherwise(F.array_union("t", "more"))


def fit_prior(examples: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Token counts by label, (label, total tokens, documents), and the size of the vocabulary."""
    return fit_counts(word_counts(examples.where("label <> ''"), ["label"]))


def fit_counts(words: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """fit_prior for words (label, t, more)."""
    # a row without a token counts a text
    split = words.where(F.size("t") > 0).select("label", F.concat(_expanded(), F.array(F.lit(None).cast("string"))).alias("t"))
    counted = split.select("label", F.explode("t").alias("token")).groupBy("label", "token").agg(F.count(F.lit(1)).alias("n"))
    counted = Tables(words.sparkSession, "prior").save(counted, "counts")
    counts = counted.where("token IS NOT NULL")
    totals = counted.groupBy("label").agg(F.sum(F.when(F.col("token").isNotNull(), F.col("n"))).alias("total"), F.max(F.when(F.col("token").isNull(), F.col("n"))).alias("docs"))
    return counts, totals, counts.agg(F.count_distinct("token").alias("vocabulary"))


def predict_prior(queries: DataFrame, counts: DataFrame, totals: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """query_id, label, probability: softmax of log prior and add-one smoothed log likelihoods of the query's tokens."""
    asked = Tables(queries.sparkSession, "prior").save(word_counts(queries, ["query_id"]), "asked")  # read twice
    return predict_counts(asked, counts, totals, vocabulary)


def predict_counts(words: DataFrame, counts: DataFrame, totals: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """predict_prior for words (query_id, t, more).

    Unseen tokens give every label its smoothed floor, so only tokens that a label has are joined: the floor is
    counted once for each token, and a seen token adds ln(n + 1).
    """
    q = words.where(F.size("t") > 0).select("query_id", _expanded().alias("t"))
    size = q.groupBy("query_id").agg(F.sum(F.size("t")).alias("m"))
    seen = q.select("query_id", F.explode("t").alias("token")).join(counts, "token").groupBy("query_id", "label").agg(F.sum(F.log(F.col("n") + 1.0)).alias("gain"))
    labels = few(totals.crossJoin(vocabulary))  # a row for each label
    all_docs = F.sum("docs").over(Window.partitionBy("query_id"))
    base = size.crossJoin(labels).join(seen, ["query_id", "label"], "left")
    score = F.log(F.col("docs") / all_docs) + F.coalesce("gain", F.lit(0.0)) - F.col("m") * F.log(F.col("total") + F.col("vocabulary"))
    scored = base.withColumn("score", score)
    own = Window.partitionBy("query_id")
    e = scored.withColumn("e", F.exp(F.col("score") - F.max("score").over(own)))
    return e.select("query_id", "label", (F.col("e") / F.sum("e").over(own)).alias("probability"))


def document_frequency(docs: DataFrame) -> DataFrame:
    """token, df of docs (doc, text)."""
    return word_frequency(word_counts(docs, []))


def word_frequency(words: DataFrame) -> DataFrame:
    """token, df of words (t)."""
    return words.select(F.explode("t").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def vocabulary(df: DataFrame, least: int, most: int) -> DataFrame:
    return df.where(F.col("df") >= least).orderBy(F.col("df").desc(), F.col("token").asc()).limit(most)


def term_counts(docs: DataFrame) -> DataFrame:
    """(doc, token, n) with repeats counted."""
    each = word_counts(docs, ["doc"]).select("doc", F.inline(F.arrays_zip(F.col("t").alias("token"), F.col("n").alias("times"))))
    return each.groupBy("doc", "token").agg(F.sum("times").alias("n"))


def tfidf(docs: DataFrame, terms: DataFrame, n_docs: Column) -> DataFrame:
    """(doc, token, weight): 1 + ln(count) times ln((1 + N) / (1 + df)) + 1, with unit length by document."""
    weight = (1 + F.log("n")) * (F.log((1 + n_docs) / (1 + F.col("df"))) + 1)
    rows = term_counts(docs).join(F.broadcast(terms), "token").withColumn("w", weight)  # terms: a bounded vocabulary
    return rows.select("doc", "token", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc")))).alias("weight"))


def time_split(examples: DataFrame, cutoff: Column, at: str = "published") -> DataFrame:
    return examples.withColumn("part", F.when(F.col(at) < cutoff, "train").otherwise("test"))


def supported_labels(train: DataFrame, least: int) -> DataFrame:
    """label, support of exploded labels in train."""
    return train.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= least)


def restricted(examples: DataFrame, labels: list[str]) -> DataFrame:
    kept = examples.withColumn("labels", F.array_intersect("labels", F.array(*map(F.lit, labels)).cast("array<string>")))
    return kept.where(F.size("labels") > 0)


def ranked_labels(scores: DataFrame) -> DataFrame:
    """scores (doc, label, score) with rank: score down, label up."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("doc").orderBy(F.col("score").desc(), F.col("label").asc())))


def hit_rates(ranked: DataFrame, gold: DataFrame, docs: DataFrame, k: int = 3) -> DataFrame:
    """top1 and recall over all docs (doc): gold (doc, label); a document without labels adds 0."""
    hits = ranked.where(F.col("rank") <= k).join(gold, ["doc", "label"], "left_semi").groupBy("doc").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("found"))
    n = gold.groupBy("doc").agg(F.count(F.lit(1)).alias("gold"))
    rows = docs.select("doc").join(hits, "doc", "left").join(n, "doc", "left")
    top1 = F.avg(F.when(F.col("first") == 1, 1.0).otherwise(0.0))
    return rows.agg(top1.alias("top1"), F.avg(F.coalesce(F.col("found") / F.col("gold"), F.lit(0.0))).alias("recall"))


def multi_hot(labels: Column, names: list[str]) -> Column:
    return F.array(*(F.array_contains(labels, n).cast("int") for n in names))


def promoted(report: DataFrame) -> Column:
    """Whether the candidate is no worse than each other model on both metrics and its labels are stable.

    report: a row with arrays top1, recall of the others, candidate_top1, candidate_recall, psi.
    """
    no_worse = F.forall("top1", lambda x: F.col("candidate_top1") >= x) & F.forall("recall", lambda x: F.col("candidate_recall") >= x)
    return F.coalesce(no_worse & (F.col("psi") <= PSI_THRESHOLD), F.lit(False))
