"""Queries of whole loads: two runs over the documents, and what they leave."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codicil.operators import load
from codicil.plans.search import ORACLES, QUERIES, query
from codicil.sources.tables import sections, table
from codicil.sources.working import Tables

__all__ = ["ORACLES", "QUERIES"]

_TWO_RUNS = r"""lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM documents WHERE doc_id % 5 <> 0),
first AS (SELECT doc_id, sha256(string_agg(line, chr(10) || chr(10) ORDER BY place)) AS h, count(*) AS n FROM lines WHERE trim(line, ' ') <> '' AND doc_id % 4 <> 0 GROUP BY 1),
second AS (SELECT doc_id, sha256(string_agg(line || CASE WHEN doc_id % 3 = 0 THEN '.' ELSE '' END, chr(10) || chr(10) ORDER BY place)) AS h, count(*) AS n FROM lines WHERE trim(line, ' ') <> '' GROUP BY 1),
changed AS (SELECT s.*, f.doc_id IS NOT NULL AS known FROM second s LEFT JOIN first f USING (doc_id) WHERE f.h IS NULL OR f.h <> s.h)"""


def _two_runs(spark: SparkSession, sf_dir: str) -> load.Corpus:
    """A first load of three quarters of the documents, and one of all in which every third text changed; the third run is blocked."""
    corpus = load.Corpus(spark, Tables(spark, "corpus").root)
    d = table(spark, sf_dir, "documents")
    number = F.concat(F.lit("n"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("document_number")
    day = F.lit("2024-01-01").cast("date")
    documents = d.select(number, "doc_id", F.coalesce("source", F.lit("x")).alias("title"), F.lit("Rule").alias("document_type"), day.alias("publication_date"), F.lit(None).cast("string").alias("parse_error"), F.sha2("text", 256).alias("source_xml_sha256"), F.lit(0).alias("n_residual"))
    rows = sections(spark, sf_dir).select(F.col("policy_id").alias("doc_id"), F.concat(F.lit("n"), F.lpad(F.col("policy_id").cast("string"), 9, "0")).alias("document_number"), "section_ref", F.lit(None).cast("string").alias("heading"), "text", "position")
    window = {"since": date(2024, 1, 1), "until": date(2024, 12, 31), "query": {"type": "RULE"}, "source": "test"}
    corpus.run("one", documents.where("doc_id % 4 <> 0"), rows.where("doc_id % 4 <> 0"), **window)
    corpus.run("two", documents, rows.withColumn("text", F.concat("text", F.when(F.col("doc_id") % 3 == 0, ".").otherwise(""))), **window)
    corpus.run("three", documents.withColumn("parse_error", F.when(F.col("doc_id") % 2 == 0, "broken")), rows, **window)
    return corpus


@query(f"""WITH {_TWO_RUNS}
SELECT 'n' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS document_number, 1 AS version, f.h AS content_hash, CASE WHEN c.doc_id IS NOT NULL THEN 'RETIRED' ELSE 'ACTIVE' END AS status FROM first f LEFT JOIN changed c USING (doc_id)
UNION ALL SELECT 'n' || lpad(CAST(doc_id AS VARCHAR), 9, '0'), CASE WHEN known THEN 2 ELSE 1 END, h, 'ACTIVE' FROM changed""")
def loaded_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current snapshot after two loads and a blocked one."""
    return _two_runs(spark, sf_dir).current().select("document_number", "version", "content_hash", "status")


@query(f"""WITH {_TWO_RUNS}
SELECT 'one' AS run_id, 'SUCCEEDED' AS status, (SELECT count(*) FROM documents WHERE doc_id % 4 <> 0) AS documents, CAST(0 AS BIGINT) AS parse_failures, count(*) AS inserted, CAST(0 AS BIGINT) AS unchanged, CAST(sum(n) AS BIGINT) AS sections, NULL AS error, DATE '2024-01-01' AS watermark FROM first
UNION ALL SELECT 'two', 'SUCCEEDED', (SELECT count(*) FROM documents), 0, count(*), (SELECT count(*) FROM second) - count(*), sum(n), NULL, DATE '2024-01-01' FROM changed
UNION ALL SELECT 'three', 'FAILED', count(*), count(*) FILTER (doc_id % 2 = 0), 0, 0, 0, 'xml_parse_failure_rate', NULL FROM documents""")
def load_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, counts and error of each run."""
    counts = F.from_json("counts", "documents long, parse_failures long, inserted long, unchanged long, sections long")
    return _two_runs(spark, sf_dir).runs().select("run_id", "status", counts.alias("c"), "error", "watermark").select("run_id", "status", "c.*", "error", "watermark")
