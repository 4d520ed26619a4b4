"""Policies in force and their sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_force(as_of: Column, start: str = "effective_from", end: str = "effective_to") -> Column:
    """Half-open window; a null bound is open."""
    return (F.col(start).isNull() | (F.col(start) <= as_of)) & (F.col(end).isNull() | (F.col(end) > as_of))


def flat_sections(policies: DataFrame, sections: DataFrame) -> DataFrame:
    """Active policies with their sections; a policy without any is one section of its whole content.

    text is what is shown, body what is searched (heading and text). Both sides keep their partitioning by
    policy; the optimiser broadcasts policies where they are small.
    """
    heading = F.col("heading") if "heading" in sections.columns else F.lit(None).cast("string")
    own = sections.select("policy_id", F.col("section_ref").alias("_ref"), heading.alias("_heading"), F.col("text").alias("_text"), F.col("position").alias("_position"))
    joined = policies.where("status = 'ACTIVE'").join(own, "policy_id", "left")
    whole = F.col("_ref").isNull()
    return joined.select(
        *policies.columns,
        F.coalesce("_ref", F.lit("document")).alias("section_ref"),
        F.when(whole, F.col("name")).otherwise(F.col("_heading")).alias("heading"),
        F.coalesce("_text", "content").alias("text"),
        F.when(whole, F.concat_ws(" ", "name", "content")).otherwise(F.concat_ws(" ", F.nullif("_heading", F.lit("")), "_text")).alias("body"),
        F.coalesce("_position", F.lit(0)).alias("position"),
    ).drop("content")


def text_only(flat: DataFrame) -> DataFrame:
    """flat_sections as full text searches it: of a section-less policy only the content, not its name."""
    return flat.withColumn("body", F.when(F.col("section_ref") == "document", F.col("text")).otherwise(F.col("body")))


def eligible_sections(policies: DataFrame, sections: DataFrame, as_of: Column) -> DataFrame:
    return flat_sections(policies.where(in_force(as_of)), sections)


def sectionless(policies: DataFrame, sections: DataFrame) -> DataFrame:
    return policies.where("status = 'ACTIVE'").join(sections.select("policy_id"), "policy_id", "left_anti")


def corpus_status(policies: DataFrame, sections: DataFrame) -> DataFrame:
    """Counts and bounds of the corpus in one pass over each table."""
    p = policies.agg(F.count(F.lit(1)).alias("policies"), F.count_if(F.col("status") == "ACTIVE").alias("active"), F.min("effective_from").alias("first_from"), F.max("effective_from").alias("last_from"))
    return p.crossJoin(sections.agg(F.count(F.lit(1)).alias("sections")))  # one row each


def active_prompts(activations: DataFrame) -> DataFrame:
    """The last activated version of each prompt name (name, version, at)."""
    return activations.groupBy("name").agg(F.max_by("version", F.struct("at", "version")).alias("version"))


def add_policies(current: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Arrivals (name, version, content) that the catalogue lacks, with their content hash."""
    new = arrivals.join(current.select("name", "version"), ["name", "version"], "left_anti")
    return new.withColumn("content_hash", F.sha2("content", 256))
