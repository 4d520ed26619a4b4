"""Corpora for evaluation and training: scans with reasons, counts, curated sets, staging lines and fallback modes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codicil.functions.text import document_text
from codicil.operators.evaluate import number_matches
from codicil.operators.retrieval import order

SEMANTIC = ("vector", "embedding", "hybrid")


def training_scan(policies: DataFrame, text_limit: int) -> DataFrame:
    """A row for each policy (published, labels, title, content): its training text and, if it is skipped, why."""
    text = document_text(F.col("title"), F.col("content"), text_limit)
    reason = F.when(F.col("published").isNull(), "without_date").when(F.size("labels") == 0, "without_labels").when(F.coalesce(F.regexp_replace(text, r"(?U)\s+", ""), F.lit("")) == "", "without_text")
    return policies.withColumn("text", text).withColumn("skipped", reason)


def type_and_part_counts(documents: DataFrame) -> DataFrame:
    """(kind, name, n): documents by type, unknown where there is none, and by each part that they name."""
    kinds = documents.select(F.lit("type").alias("kind"), F.coalesce(F.nullif("document_type", F.lit("")), F.lit("unknown")).alias("name"))
    parts = documents.select(F.lit("part").alias("kind"), F.explode("parts").alias("name")).where("name <> ''")
    return kinds.unionByName(parts).groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"))


def nested(policies: DataFrame, sections: DataFrame) -> DataFrame:
    """policies with their sections as an array in order; an empty one where there are none."""
    own = sections.groupBy("policy_id").agg(F.array_sort(F.collect_list(F.struct("position", "section_ref", "text"))).alias("sections"))  # the sections of one policy
    none = F.array().cast("array<struct<position:int,section_ref:string,text:string>>")
    return policies.join(own, "policy_id", "left").withColumn("sections", F.coalesce("sections", none))


@dataclass(frozen=True)
class Spec:
    """What a curated query accepts: every part that is given must hold, and one must be given."""

    name: str
    prefixes: tuple[str, ...] = ()
    numbers: tuple[str, ...] = ()
    title_contains: tuple[str, ...] = ()

    def matches(self, ref: Column, number: Column, title: Column) -> Column:
        parts = []
        if self.prefixes:
            parts.append(number_matches(ref, list(self.prefixes)))
        if self.numbers:
            parts.append(number.isin(*self.numbers))
        if self.title_contains:
            folded, any_of = F.lower(F.coalesce(title, F.lit(""))), F.lit(False)
            for phrase in self.title_contains:
                any_of = any_of | F.contains(folded, F.lit(phrase.lower()))
            parts.append(any_of)
        good = F.lit(bool(parts))
        for p in parts:
            good = good & F.coalesce(p, F.lit(False))
        return good


def curated(sections: DataFrame, specs: list[Spec]) -> DataFrame:
    """(spec, policy_id, section_ref) of sections (policy_id, section_ref, number, title) that a spec accepts, in one scan."""
    names = F.array_compact(F.array(*(F.when(s.matches(F.col("section_ref"), F.col("number"), F.col("title")), F.lit(s.name)) for s in specs)))
    return sections.select(F.explode(names).alias("spec"), "policy_id", "section_ref")


def clear_of_forbidden(found: Column, forbidden: Column) -> Column:
    """Whether no forbidden document was returned."""
    return ~F.coalesce(F.arrays_overlap(found, forbidden), F.lit(False))


def with_mode(requests: DataFrame, has_vectors: Column, full_text: bool) -> DataFrame:
    """requests (mode or null) with the mode that runs, and for a fallback the one it replaces and the reason."""
    lexical = "fulltext" if full_text else "keyword"
    wanted = F.coalesce("mode", F.when(has_vectors, "hybrid").otherwise(lexical))
    missing = wanted.isin(*SEMANTIC) & ~has_vectors
    return requests.select("*", F.when(missing, lexical).otherwise(wanted).alias("runs"), F.when(missing, wanted).alias("fallback_from"), F.when(missing, "no vectors are stored for the model").alias("fallback_reason"))


def numbered(ranked: DataFrame) -> DataFrame:
    """ranked rows with the number, from 1, under which an answer cites them."""
    return ranked.withColumn("source", F.row_number().over(Window.partitionBy("query_id").orderBy(*order())))


def staging_lines(documents: DataFrame, columns: list[str]) -> DataFrame:
    """A JSON line for each row, members by name, nulls kept; write with ``.write.text``."""
    return documents.select(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}).alias("value"))
