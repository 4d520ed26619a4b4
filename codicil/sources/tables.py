"""Policies, sections and queries adapted from the test tables, and the same adapters in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as policies with a status and an effective window; open bounds are null."""
    d = F.col("doc_id")
    start = F.when(d % 7 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (d % 365).cast("int")))
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        d.alias("policy_id"),
        F.concat(F.lit("doc-"), F.lpad(d.cast("string"), 7, "0")).alias("name"),
        F.lit(1).alias("version"),
        F.when(d % 10 == 0, "DRAFT").when(d % 10 == 1, "RETIRED").otherwise("ACTIVE").alias("status"),
        start.alias("effective_from"),
        F.when(d % 3 == 0, F.date_add(start, 180)).alias("effective_to"),
        "lang",
        "source",
        F.col("text").alias("content"),
    )


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as sections; every fifth document has none."""
    docs = table(spark, sf_dir, "documents").where(F.col("doc_id") % 5 != 0)
    lines = docs.select(F.col("doc_id").alias("policy_id"), F.posexplode(F.split("text", "\n")).alias("position", "text"))
    return lines.where(F.trim("text") != "").select("policy_id", F.concat(F.lit("L"), F.col("position").cast("string")).alias("section_ref"), "text", "position")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as queries with a date each."""
    items = table(spark, sf_dir, "benchmark")
    return items.select(F.col("item_id").alias("query_id"), "text", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("item_id") % 365).cast("int")).alias("as_of"))


#: The adapters for an engine that reads the same tables.
SQL = r"""
policies AS (
  SELECT doc_id AS policy_id, 'doc-' || lpad(CAST(doc_id AS VARCHAR), 7, '0') AS name, 1 AS version,
    CASE WHEN doc_id % 10 = 0 THEN 'DRAFT' WHEN doc_id % 10 = 1 THEN 'RETIRED' ELSE 'ACTIVE' END AS status,
    CASE WHEN doc_id % 7 <> 0 THEN DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) END AS effective_from,
    CASE WHEN doc_id % 3 = 0 AND doc_id % 7 <> 0 THEN DATE '2024-01-01' + CAST(doc_id % 365 + 180 AS INTEGER) END AS effective_to,
    lang, source, text AS content
  FROM documents),
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place
  FROM documents WHERE doc_id % 5 <> 0),
sections AS (
  SELECT doc_id AS policy_id, 'L' || CAST(place AS VARCHAR) AS section_ref, line AS text, CAST(place AS INTEGER) AS position
  FROM lines WHERE trim(line, ' ') <> ''),
items AS (
  SELECT item_id AS query_id, text, DATE '2024-01-01' + CAST(item_id % 365 AS INTEGER) AS as_of FROM benchmark),
flat AS (
  SELECT p.policy_id, p.name, p.version, p.status, p.effective_from, p.effective_to, p.lang, p.source,
    coalesce(s.section_ref, 'document') AS section_ref, coalesce(s.text, p.content) AS text,
    CASE WHEN s.section_ref IS NULL THEN p.name || ' ' || p.content ELSE s.text END AS body,
    coalesce(s.position, 0) AS position
  FROM policies p LEFT JOIN sections s USING (policy_id)),
"""
#: Condition of flat row f being in force for query q.
IN_FORCE = "f.status = 'ACTIVE' AND (f.effective_from IS NULL OR f.effective_from <= q.as_of) AND (f.effective_to IS NULL OR f.effective_to > q.as_of)"
ORDER = "score DESC, name, version DESC, position, section_ref"
