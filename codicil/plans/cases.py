"""Queries of cases and questions that a model looks at in rounds."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codicil.functions.privacy import INJECTIONS
from codicil.operators import attempts, retrieval
from codicil.plans.search import ORACLES, QUERIES, WHOLE, query, scores_sql, top_sql, whole
from codicil.sources.tables import SQL, table

__all__ = ["ORACLES", "QUERIES"]

ABSENT = "these words are certainly in no source of this case"


def _quote(content: str) -> str:
    text = " ".join(content.split(None, 241)[:241])  # longer than 240 if the content's is
    return text if len(text) <= 240 else text[:240].rsplit(" ", 1)[0]


def _analyst() -> attempts.Provider:
    """A stand-in for a model whose answers follow from the case's id and the feedback: one kind for each way a case can end."""

    def answer(request: dict) -> str:
        kind, first, source = request["id"] % 6, request["attempt"] == 1, request["sources"][0]
        if kind == 4:
            raise ValueError("no connection")
        if kind == 2 or kind == 1 and not request["feedback"]:
            raise attempts.Unreadable
        lost = kind == 3 and not any(f.startswith("citation_not_retrieved") for f in request["feedback"]) and first
        cited = {"policy_id": "none" if lost else source["policy_id"], "policy_version": 1, "section_ref": source["section_ref"], "quote": ABSENT if kind == 5 else _quote(source["content"]) or "-"}
        return json.dumps({"outcome": "compliant", "confidence": 0.5 if kind == 5 else 0.9, "rationale": "Due within 15 days." if kind == 5 else "The source says so.", "citations": [cited]})

    return answer


def _cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Users' turns as cases, the best policy in force for each as its source, and the policies' texts."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    asked = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 365).cast("int")).alias("as_of"))
    w = whole(spark, sf_dir)
    policy = F.col("policy_id").cast("string")
    best = retrieval.keyword(asked, w, 1).select(F.col("query_id").alias("case_id"), "rank", policy.alias("policy_id"), F.lit(1).alias("policy_version"), "section_ref", policy.alias("text_key"))
    return asked, best, w.select(policy.alias("text_key"), F.col("text").alias("content"))


_ASKED = "asked AS (SELECT conv_id * 1000 + turn AS query_id, text, DATE '2024-01-01' + CAST(conv_id % 365 AS INTEGER) AS as_of FROM conversations WHERE role = 'user'),"
_SIGNAL = " OR ".join(f"regexp_matches(text, '(?i){p}')" for p in INJECTIONS.values())


@query(rf"""WITH {SQL} {WHOLE} {_ASKED} {scores_sql('whole', 'asked')} {top_sql('scores', k=1)},
s AS (SELECT b.query_id, b.policy_id, b.section_ref, trim(regexp_replace(w.text, '\s+', ' ', 'g'), ' ') AS clean FROM best b JOIN whole w USING (policy_id)),
q AS (SELECT *, policy_id || ':1:' || section_ref AS ref, CASE WHEN length(clean) > 240 THEN regexp_replace(clean[:240], ' [^ ]*$', '') ELSE clean END AS quote FROM s),
r AS (SELECT a.query_id, a.query_id % 6 AS kind, ref, length(CASE WHEN quote = '' THEN '-' ELSE quote END) < 20 AS short, {_SIGNAL} AS signal FROM asked a LEFT JOIN q USING (query_id)),
e AS (SELECT *, CASE WHEN ref IS NULL THEN ['no_relevant_source'] WHEN kind = 4 THEN [] WHEN kind = 2 THEN ['malformed_model_output']
  WHEN kind = 5 THEN ['confidence_below_review_threshold', 'citation_quote_not_found:' || ref, 'rationale_temporal_claim_not_cited:within 15 days']
  WHEN short THEN ['citation_quote_too_short:' || ref] ELSE [] END AS found,
  CASE WHEN ref IS NULL THEN 0 WHEN kind = 4 THEN 1 WHEN kind = 0 AND NOT short THEN 1 ELSE 2 END AS attempts FROM r)
SELECT query_id AS case_id, CASE WHEN ref IS NOT NULL AND kind = 4 THEN 'FAILED' ELSE 'REVIEW_REQUIRED' END AS status,
  CASE WHEN ref IS NULL THEN 'no_relevant_source' WHEN kind = 4 THEN 'model_analysis_failed' WHEN kind = 2 THEN 'malformed_model_output' END AS error_code,
  array_to_string(CASE WHEN signal AND (ref IS NULL OR kind NOT IN (2, 4)) THEN list_append(found, 'prompt_injection_signal_requires_review') ELSE found END, '|') AS findings,
  CAST(attempts AS INTEGER) AS provider_attempts,
  array_to_string(list_append(list_transform(range(attempts), lambda i: 'analysis_attempted'), CASE WHEN ref IS NOT NULL AND kind = 4 THEN 'analysis_failed' ELSE 'analysis_completed' END), ',') AS events FROM e""")
def case_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' turns as cases, looked at in at most two rounds with feedback; what they end with."""
    asked, sources, texts = _cases(spark, sf_dir)
    out = attempts.analyse_cases(asked.withColumnRenamed("query_id", "case_id"), sources, _analyst, texts=texts)
    return out.select("case_id", "status", "error_code", F.array_join("validation_errors", "|").alias("findings"), "provider_attempts", F.array_join("audit_events", ",").alias("events"))


def _answerer() -> attempts.Provider:
    """The same for questions: refuses, cites nothing, cites a missing source, fails, or quotes its source at once or once it was told."""

    def answer(request: dict) -> str:
        kind, source = request["id"] % 7, request["sources"][0]
        if kind == 6:
            raise OSError("no connection")
        good = {"source": 1, "quote": _quote(source["content"]) or "-"}
        told = " ".join(request["feedback"])
        cited = {1: [], 2: [{"source": 2, "quote": good["quote"]}], 3: [good] if "Copy the words exactly" in told else [{"source": 1, "quote": ABSENT}]}.get(kind, [good])
        return json.dumps({"supported": kind != 4, "answer": "It is so for 3 days." if kind == 5 else "It is so.", "citations": cited})

    return answer


@query(rf"""WITH {SQL} {WHOLE} {_ASKED} {scores_sql('whole', 'asked')} {top_sql('scores', k=1)},
s AS (SELECT b.query_id, trim(regexp_replace(w.text, '\s+', ' ', 'g'), ' ') AS clean FROM best b JOIN whole w USING (policy_id)),
q AS (SELECT *, CASE WHEN clean = '' THEN '-' WHEN length(clean) > 240 THEN regexp_replace(clean[:240], ' [^ ]*$', '') ELSE clean END AS quote FROM s),
r AS (SELECT a.query_id, a.query_id % 7 AS kind, quote, length(quote) < 20 AS short, regexp_matches(quote, '(^|\W)3 days(\W|$)') AS holds FROM asked a LEFT JOIN q USING (query_id)),
e AS (SELECT *, CASE WHEN quote IS NULL THEN ['no_relevant_source'] WHEN kind = 6 THEN [] WHEN kind = 4 THEN ['model_reported_insufficient_sources'] WHEN kind = 1 THEN ['answer_without_citation']
  WHEN kind = 2 THEN ['citation_not_retrieved:2'] ELSE list_concat(CASE WHEN short THEN ['citation_quote_too_short:1'] ELSE [] END,
    CASE WHEN kind = 5 AND (short OR NOT holds) THEN ['answer_temporal_claim_not_cited:for 3 days'] ELSE [] END) END AS found FROM r)
SELECT query_id AS case_id, CASE WHEN quote IS NOT NULL AND kind = 6 THEN 'FAILED' WHEN len(found) > 0 THEN 'UNANSWERED' ELSE 'ANSWERED' END AS status,
  CASE WHEN quote IS NOT NULL AND kind = 6 THEN 'model_answer_failed' END AS error_code, array_to_string(found, '|') AS findings,
  CAST(CASE WHEN quote IS NULL THEN 0 WHEN kind IN (4, 6) THEN 1 WHEN kind = 3 OR len(found) > 0 THEN 2 ELSE 1 END AS INTEGER) AS provider_attempts,
  CASE WHEN kind <> 6 AND len(found) = 0 THEN quote END AS quote FROM e""")
def question_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' turns as questions, answered in at most two rounds with feedback."""
    asked, sources, texts = _cases(spark, sf_dir)
    given = sources.select("case_id", F.col("rank").alias("source"), "text_key")
    out = attempts.answer_questions(asked.withColumnRenamed("query_id", "case_id"), given, _answerer, texts=texts)
    return out.select("case_id", "status", "error_code", F.array_join("validation_errors", "|").alias("findings"), "provider_attempts", F.get("citations", F.lit(0))["quote"].alias("quote"))
