"""Checks of model output against its sources, and the deterministic answerer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codicil.config import MIN_QUOTE_CHARS
from codicil.functions.privacy import holds_quote, temporal_claims
from codicil.functions.text import leading_passage, squeezed, without_code_fence

ANALYSIS = "outcome string, confidence double, rationale string, citations array<struct<policy_id:string,policy_version:int,section_ref:string,quote:string>>"


def quote_verdict(content: Column, quote: Column) -> Column:
    """not_retrieved, too_short or not_found of a cited quote; null if it is in its source."""
    return _verdict(squeezed(content), quote)


def _verdict(clean: Column, quote: Column) -> Column:
    q = squeezed(quote)
    return F.when(clean.isNull(), "citation_not_retrieved").when(F.length(q) < MIN_QUOTE_CHARS, "citation_quote_too_short").when(~holds_quote(clean, q), "citation_quote_not_found")


def with_text(rows: DataFrame, texts: DataFrame, column: str, by: str) -> DataFrame:
    """rows (text_key, copies) with a column of their texts (text_key, copies), null where there is none; a text's rows are dealt over its copies by a column.

    Rows without a text are dealt over all tasks.
    """
    spread = F.xxhash64(by)
    dealt = rows.withColumn("_copy", F.coalesce(F.pmod(spread, F.col("copies")), spread))
    copied = texts.select("text_key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("_copy"), column)
    return dealt.join(copied, ["text_key", "_copy"], "left").drop("_copy", "text_key", "copies")


def checked_citations(citations: DataFrame, sources: DataFrame, keys: list[str], texts: DataFrame | None = None) -> DataFrame:
    """citations (case_id, ord, keys, ref, quote) with code (null if accepted): one left join by the keys and case.

    texts (text_key, copies, clean): the sources' squeezed texts, where sources hold text_key and copies instead of a content.
    """
    if texts is None:
        joined = citations.join(sources.select("case_id", *keys, "content"), ["case_id", *keys], "left")
        return joined.withColumn("code", quote_verdict(F.col("content"), F.col("quote"))).drop("content")
    joined = with_text(citations.join(sources.select("case_id", *keys, "text_key", "copies"), ["case_id", *keys], "left"), texts, "clean", "case_id")
    return joined.withColumn("code", _verdict(F.col("clean"), F.col("quote"))).drop("clean")


def errors(outputs: DataFrame, citations: DataFrame, sources: DataFrame, keys: list[str], text: str = "rationale", prefix: str = "rationale", threshold: float | None = None, texts: DataFrame | None = None) -> DataFrame:
    """case_id, errors in order: low confidence, citations in their order, uncited claims in theirs.

    Only quotes that were accepted support a claim. texts: as for checked_citations.
    """
    cited = checked_citations(citations, sources, keys, texts).withColumn("error", F.when(F.col("code").isNotNull(), F.concat_ws(":", "code", F.col("ref").cast("string"))))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("ord", "error", F.when(F.col("code").isNull(), squeezed(F.col("quote"))).alias("quote")))), lambda x: x)
    per = cited.groupBy("case_id").agg(in_order.alias("c"))  # the citations of one output
    rows = outputs.join(per, "case_id", "left").withColumn("claims", temporal_claims(F.col(text)))
    quotes = F.coalesce(F.filter(F.transform("c", lambda x: x["quote"]), lambda q: q.isNotNull()), F.array().cast("array<string>"))
    rows = rows.withColumn("quotes", quotes)
    loose = F.filter("claims", lambda claim: ~F.exists("quotes", lambda q: holds_quote(q, claim)))
    none = F.array().cast("array<string>")
    first = F.when(F.col("confidence") < threshold, F.array(F.lit("confidence_below_review_threshold"))).otherwise(none) if threshold is not None else none
    middle = F.coalesce(F.filter(F.transform("c", lambda x: x["error"]), lambda e: e.isNotNull()), none)
    last = F.transform(loose, lambda claim: F.concat(F.lit(f"{prefix}_temporal_claim_not_cited:"), claim))
    return rows.select("case_id", F.concat(first, middle, F.coalesce(last, none)).alias("errors"))


def parsed_output(text: Column) -> Column:
    """Model output as ANALYSIS, null where it isn't that: fenced or bare JSON with a confidence of 0 to 1."""
    value = F.from_json(without_code_fence(text), ANALYSIS)
    good = value["outcome"].isNotNull() & value["rationale"].isNotNull() & value["confidence"].between(0, 1)
    return F.when(good, value)


def deterministic_answers(questions: DataFrame, ranked: DataFrame) -> DataFrame:
    """Answer that quotes the first source; unsupported without one. ranked: (query_id, rank, name, section_ref, text), or with the text's leading passage as quote."""
    quote = F.col("quote") if "quote" in ranked.columns else leading_passage(F.col("text")).alias("quote")
    first = ranked.where("rank = 1").select("query_id", "name", "section_ref", quote)
    rows = questions.join(first, "query_id", "left")
    return rows.select("query_id", F.col("quote").isNotNull().alias("supported"), "name", "section_ref", "quote", F.when(F.col("quote").isNotNull(), F.lit(0.65)).otherwise(0.0).alias("confidence"))


def outcome(errors_: Column, has_source: Column, malformed: Column, signals: Column) -> Column:
    """Status, error code and findings of a case after its attempts."""
    findings = F.concat(errors_, F.transform(signals, lambda s: F.concat(F.lit("injection_signal:"), s)))
    code = F.when(~has_source, "no_relevant_source").when(malformed, "malformed_model_output")
    return F.struct(F.lit("REVIEW_REQUIRED").alias("status"), code.alias("error_code"), F.when(code.isNull(), findings).otherwise(F.array().cast("array<string>")).alias("findings"))


def retried(errors_: Column, fixable: list[str]) -> Column:
    """Distinct codes that a second attempt may mend."""
    return F.array_distinct(F.filter(F.transform(errors_, lambda e: F.split_part(e, F.lit(":"), F.lit(1))), lambda c: c.isin(fixable)))
