"""Queries of labels, leases, reviews, corpora for evaluation, and what surrounds ingestion and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codicil.config import CANDIDATES, MAX_ATTEMPTS, PRIOR_WEIGHT, QUESTION_LIMIT, SCORE_DIGITS
from codicil.functions import labels, text
from codicil.operators import catalog, collect, evaluate, fulltext, ingest, priors, retrieval, review, workflow
from codicil.plans import search
from codicil.plans.search import CONTENT, DOCS, ORACLES, QUERIES, SEARCHES, WHOLE, flat, fulltext_sql, fused_sql, prior_sql, query, ranked, scores_sql, semantic_sql, top_sql, whole
from codicil.sources.tables import SQL, policies, queries, sections, table

__all__ = ["ORACLES", "QUERIES"]

_JSON = """CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN '{"title": 40, "part": "1"}' WHEN doc_id % 17 = 0 THEN 'no json' ELSE
  concat('[{"title": ', doc_id % 3 + 39, ', "part": "', doc_id % 7, '"}, {"title": "40", "part": ', doc_id % 5, '}, {"title": true, "part": "1"}, {"title": ',
    doc_id % 3 + 39, ', "part": " ', doc_id % 7, ' "}, 7, "x", {"title": 40, "part": " "}, {"title": 40}, {"title": 1.5, "part": "2"}]') END"""


@query(f"""WITH r AS (SELECT doc_id, {_JSON} AS js FROM documents),
a AS (SELECT doc_id, CASE WHEN js LIKE '[%' THEN json_extract(js, '$[*]') ELSE [] END AS items FROM r),
l AS (SELECT doc_id, list_transform(list_filter(items, lambda x: json_type(x, '$.title') IN ('UBIGINT', 'BIGINT', 'VARCHAR') AND json_type(x, '$.part') IN ('UBIGINT', 'BIGINT', 'VARCHAR')
  AND trim(json_extract_string(x, '$.part')) <> ''), lambda x: json_extract_string(x, '$.title') || ':' || trim(json_extract_string(x, '$.part'))) AS l FROM a),
d AS (SELECT doc_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM l)
SELECT doc_id, array_to_string(l, ',') AS labels, coalesce(list_filter(l, lambda x: starts_with(x, '40:'))[1], l[1], 'other') AS preferred FROM d""")
def cfr_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of loosely typed references, and the preferred one of each document."""
    own = table(spark, sf_dir, "documents").select("doc_id", labels.part_labels(F.expr(_JSON)).alias("l"))
    return own.select("doc_id", F.array_join("l", ",").alias("labels"), labels.preferred_label(F.col("l")).alias("preferred"))


_COUNTS = """CASE WHEN doc_id % 9 = 0 THEN '[1]' ELSE concat('{"a": ', doc_id, ', "b": true, "c": "x", "d": 2.5, "e": -', doc_id % 4 + 1, ', "f": null}') END"""


@query("SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 0 ELSE 2 END AS members, CASE WHEN doc_id % 9 <> 0 THEN doc_id END AS a, CASE WHEN doc_id % 9 <> 0 THEN -(doc_id % 4 + 1) END AS e FROM documents")
def count_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-number members of JSON objects."""
    m = table(spark, sf_dir, "documents").select("doc_id", labels.count_map(F.expr(_COUNTS)).alias("m"))
    return m.select("doc_id", F.size("m").alias("members"), F.try_element_at("m", F.lit("a")).alias("a"), F.try_element_at("m", F.lit("e")).alias("e"))


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN DATE '2024-01-01' + CAST(doc_id % 90 AS INTEGER) END AS e, CASE WHEN doc_id % 7 <> 0 THEN DATE '2023-06-01' + CAST(doc_id % 50 AS INTEGER) END AS p FROM documents)
SELECT doc_id, coalesce(e, p) AS effective_from, CASE WHEN e IS NOT NULL THEN 'effective_on' WHEN p IS NOT NULL THEN 'publication_date' END AS source FROM d""")
def effective_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effective dates with their source, out of texts that are dates, moments or neither."""
    d = F.col("doc_id")
    day = lambda start, n: F.date_add(F.lit(start).cast("date"), (d % n).cast("int")).cast("string")
    effective = labels.as_date(F.when(d % 3 == 0, F.concat(day("2024-01-01", 90), F.lit("T08:00:00"))).when(d % 3 == 1, "soon"))
    e = labels.effective_from(effective, labels.as_date(F.when(d % 7 != 0, day("2023-06-01", 50))))
    return table(spark, sf_dir, "documents").select("doc_id", e.alias("e")).select("doc_id", F.col("e.date").alias("effective_from"), "e.source")


@query("""WITH d AS (SELECT CASE WHEN doc_id % 6 = 0 THEN NULL WHEN doc_id % 6 = 1 THEN '' ELSE lang END AS t, source, CAST(doc_id % 4 AS VARCHAR) AS p FROM documents)
SELECT 'type' AS kind, coalesce(nullif(t, ''), 'unknown') AS name, count(*) AS n FROM d GROUP BY 2 UNION ALL SELECT 'part', x, count(*) FROM (SELECT unnest([source, p]) AS x FROM d) WHERE x <> '' GROUP BY 2""")
def type_part_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select(F.when(d % 6 == 1, "").when(d % 6 > 1, F.col("lang")).alias("document_type"), F.array("source", (d % 4).cast("string")).alias("parts"))
    return collect.type_and_part_counts(docs)


@query(f"""WITH {SQL} n AS (SELECT policy_id, count(*) AS n, string_agg(section_ref, ',' ORDER BY position) AS refs FROM sections GROUP BY 1)
SELECT p.policy_id, CAST(coalesce(n, 0) AS INTEGER) AS n, coalesce(refs, '') AS refs FROM policies p LEFT JOIN n USING (policy_id)""")
def nested_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies with their sections as arrays in order."""
    rows = collect.nested(policies(spark, sf_dir).select("policy_id"), sections(spark, sf_dir))
    return rows.select("policy_id", F.size("sections").alias("n"), F.array_join(F.transform("sections", lambda s: s["section_ref"]), ",").alias("refs"))


@query(f"WITH {SQL} {scores_sql('flat')} {top_sql('scores', k=QUESTION_LIMIT)} SELECT query_id, rank AS source, name, section_ref FROM best")
def numbered_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of each question, numbered as an answer cites them."""
    best = retrieval.keyword(queries(spark, sf_dir), flat(spark, sf_dir), QUESTION_LIMIT)
    return collect.numbered(best).select("query_id", "source", "name", "section_ref")


@query("SELECT user_id, max_by(event_id, (ts, event_id)) AS run_id, max(ts) AS ts FROM events WHERE event_type = 'purchase' GROUP BY 1")
def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last succeeded run of each user; purchases are the runs that succeed."""
    e = table(spark, sf_dir, "events")
    runs = e.select("user_id", F.col("event_id").alias("run_id"), "ts", F.when(F.col("event_type") == "purchase", "succeeded").otherwise("failed").alias("status"))
    return review.latest_succeeded(runs, "user_id")


SPECS = [
    collect.Spec("first lines", prefixes=("L0",)),
    collect.Spec("numbered", prefixes=("L1", "L2"), numbers=("doc-0000002", "doc-0000003", "doc-0000004")),
    collect.Spec("titled", prefixes=("L3",), title_contains=("EN", "de")),
    collect.Spec("empty"),
]


@query(f"""WITH {SQL} s AS (SELECT s.*, p.name AS number, lang AS title FROM sections s JOIN policies p USING (policy_id))
SELECT 'first lines' AS spec, policy_id, section_ref FROM s WHERE section_ref = 'L0' OR section_ref LIKE 'L0#%' OR section_ref LIKE 'L0~%'
UNION ALL SELECT 'numbered', policy_id, section_ref FROM s WHERE section_ref IN ('L1', 'L2') AND number IN ('doc-0000002', 'doc-0000003', 'doc-0000004')
UNION ALL SELECT 'titled', policy_id, section_ref FROM s WHERE section_ref = 'L3' AND (contains(lower(title), 'en') OR contains(lower(title), 'de'))""")
def curated_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections that curated specifications accept."""
    named = policies(spark, sf_dir).select("policy_id", F.col("name").alias("number"), F.col("lang").alias("title"))
    return collect.curated(sections(spark, sf_dir).join(named, "policy_id"), SPECS)


@query(f"""WITH {SQL} {scores_sql('flat')} {top_sql('scores')}
SELECT query_id, NOT list_has_any(list(name), ['doc-0000005', 'doc-' || lpad(CAST(query_id AS VARCHAR), 7, '0'), 'doc-0000012']) AS excluded FROM best GROUP BY 1""")
def excluded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each ranking is free of the documents that its query forbids."""
    best = retrieval.keyword(queries(spark, sf_dir), flat(spark, sf_dir)).groupBy("query_id").agg(F.collect_list("name").alias("found"))  # five a query
    own = F.concat(F.lit("doc-"), F.lpad(F.col("query_id").cast("string"), 7, "0"))
    return best.select("query_id", collect.clear_of_forbidden(F.col("found"), F.array(F.lit("doc-0000005"), own, F.lit("doc-0000012"))).alias("excluded"))


@query("""WITH r AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'hybrid' WHEN 'click' THEN 'vector' WHEN 'purchase' THEN 'keyword' WHEN 'signup' THEN NULL ELSE 'fulltext' END AS mode, event_id % 3 = 0 AS v FROM events),
w AS (SELECT *, coalesce(mode, CASE WHEN v THEN 'hybrid' ELSE 'fulltext' END) AS wanted FROM r)
SELECT event_id, CASE WHEN NOT v AND wanted IN ('hybrid', 'vector') THEN 'fulltext' ELSE wanted END AS runs, CASE WHEN NOT v AND wanted IN ('hybrid', 'vector') THEN wanted END AS fallback_from,
  CASE WHEN NOT v AND wanted IN ('hybrid', 'vector') THEN 'no vectors are stored for the model' END AS fallback_reason FROM w""")
def retrieval_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mode that each search request runs in, where only some models have vectors."""
    kind = F.col("event_type")
    mode = F.when(kind == "view", "hybrid").when(kind == "click", "vector").when(kind == "purchase", "keyword").when(kind == "signup", None).otherwise("fulltext")
    rows = table(spark, sf_dir, "events").select("event_id", mode.alias("mode"))
    return collect.with_mode(rows, F.col("event_id") % 3 == 0, full_text=True).drop("mode")


_BONUS = """
best_prior AS (SELECT r.query_id, p.policy_id, r.probability FROM prior r JOIN policies p ON p.lang = r.label),"""


def _prior(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Probabilities of classes, which are languages, and each policy's class."""
    prior = priors.predict_prior(queries(spark, sf_dir), *priors.fit_prior(search._examples(spark, sf_dir)))
    return prior, policies(spark, sf_dir).select("policy_id", F.array("lang").alias("labels"))


def _biased_sql(cut: str, name: str = "biased") -> str:
    return f"{name} AS (SELECT c.* EXCLUDE (score, rank), round(score + {PRIOR_WEIGHT} * coalesce(probability, 0), {SCORE_DIGITS}) AS score FROM {cut} c LEFT JOIN best_prior USING (query_id, policy_id)),"


@query(f"""WITH {SQL} {WHOLE} {DOCS} {prior_sql('docs', 'items')} {_BONUS} {scores_sql('whole')} {top_sql('scores', 'cut', CANDIDATES)}, {_biased_sql('cut')}
{top_sql('biased')} SELECT query_id, policy_id, section_ref, round(score, 6) AS score, rank FROM best""")
def keyword_two_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred best by keywords, ranked again with the class prior."""
    scores = retrieval.best_by_keywords(queries(spark, sf_dir), whole(spark, sf_dir), CANDIDATES)
    return ranked(retrieval.two_phase(scores, *_prior(spark, sf_dir), 5)).withColumn("score", F.round("score", 6))


_COVERED = f"{CONTENT} {SEARCHES} {fulltext_sql('content')} {top_sql('covered', 'cut', CANDIDATES)}, {_biased_sql('cut', 'lexical')}"


def _lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best by full text as far as the prior's bonus can count."""
    return fulltext.fulltext_scores(search._searches(spark, sf_dir), catalog.text_only(whole(spark, sf_dir)), best=CANDIDATES)


@query(f"""WITH {SQL} {WHOLE} {DOCS} {prior_sql('docs', 'items')} {_BONUS} {_COVERED}
{top_sql('lexical')} SELECT query_id, policy_id, section_ref, round(score, 6) AS score, rank FROM best""")
def fulltext_two_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred best by full text, ranked again with the class prior."""
    return ranked(retrieval.two_phase(_lexical(spark, sf_dir), *_prior(spark, sf_dir), 5)).withColumn("score", F.round("score", 6))


@query(f"""WITH {SQL} {WHOLE} {DOCS} {prior_sql('docs', 'items')} {_BONUS} {_COVERED} {semantic_sql(False)}
{fused_sql('lexical', 'semantic', CANDIDATES)} SELECT query_id, policy_id, section_ref, round(score, 6) AS score, rank FROM best""")
def hybrid_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion of the hundred best of full text, ranked with the class prior, and of vectors; nothing is added after it."""
    lexical = retrieval.two_phase(_lexical(spark, sf_dir), *_prior(spark, sf_dir), CANDIDATES).drop("rank")
    return ranked(retrieval.fused(lexical, search._semantic(spark, sf_dir, False, CANDIDATES), 5, CANDIDATES)).withColumn("score", F.round("score", 6))


@query(f"""WITH {SQL} p AS (SELECT policy_id, effective_from AS published, lang, source, content FROM policies),
r AS (SELECT policy_id, CASE WHEN published IS NULL THEN 'without_date' WHEN policy_id % 8 = 1 THEN 'without_labels' WHEN regexp_replace(concat_ws(chr(10), nullif(CASE WHEN policy_id % 4 = 0 THEN '' ELSE source END, ''), nullif(left(content, 400), '')), '\\s+', '', 'g') = '' THEN 'without_text' END AS skipped,
  length(concat_ws(chr(10), nullif(CASE WHEN policy_id % 4 = 0 THEN '' ELSE source END, ''), nullif(left(content, 400), ''))) AS chars FROM p)
SELECT coalesce(skipped, 'kept') AS reason, count(*) AS n, CAST(sum(chars) AS BIGINT) AS chars FROM r GROUP BY 1""")
def training_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies that a training corpus keeps, and why others are skipped."""
    d = F.col("policy_id")
    none = F.array().cast("array<string>")
    rows = policies(spark, sf_dir).select(d, F.col("effective_from").alias("published"), F.when(d % 8 == 1, none).otherwise(F.array("lang")).alias("labels"), F.when(d % 4 == 0, "").otherwise(F.col("source")).alias("title"), "content")
    scan = collect.training_scan(rows, 400)
    return scan.groupBy(F.coalesce("skipped", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case for each event: worker, token, attempts and a lease of its own."""
    i = F.col("event_id")
    status = F.when(i % 5 == 0, review.QUEUED).when(i % 5 == 1, review.WAITING).otherwise(review.HELD)
    return table(spark, sf_dir, "events").select(i.alias("case_id"), status.alias("status"), F.concat(F.lit("w"), (i % 3).cast("string")).alias("worker_id"), (i % 4).alias("token"), (i % 5).alias("attempts"), F.timestamp_seconds(1_700_000_000 + (i % 200)).alias("lease_end"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, sf_dir, "events").where("event_id % 2 = 0").select(i.alias("case_id"), F.concat(F.lit("w"), (i % 6 % 4).cast("string")).alias("worker_id"), (i % 8).alias("token"))


_CASES = """c AS (SELECT event_id AS case_id, CASE event_id % 5 WHEN 0 THEN 'QUEUED' WHEN 1 THEN 'REVIEW_REQUIRED' ELSE 'ANALYZING' END AS status, event_id % 5 AS attempts, 1700000000 + event_id % 200 AS lease_end,
  event_id % 2 = 0 AND event_id % 5 >= 2 AND event_id % 3 = event_id % 6 % 4 AND event_id % 4 = event_id % 8 AS mine FROM events)"""


@query(f"WITH {_CASES} SELECT case_id, mine AND lease_end > 1700000100 AS renewed, CASE WHEN mine AND lease_end > 1700000100 THEN 1700000160 ELSE lease_end END AS lease_end FROM c")
def lease_renewals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leases after the renewals that workers ask for at one moment."""
    rows = review.renewed(_cases(spark, sf_dir), _asked(spark, sf_dir), F.timestamp_seconds(F.lit(1_700_000_100)))
    return rows.select("case_id", "renewed", F.unix_timestamp("lease_end").alias("lease_end"))


@query(f"""WITH {_CASES} SELECT case_id, CASE WHEN NOT mine THEN status WHEN attempts >= {MAX_ATTEMPTS} THEN 'FAILED' ELSE 'QUEUED' END AS status,
  CASE WHEN NOT mine THEN NULL WHEN attempts >= {MAX_ATTEMPTS} THEN 'analysis_abandoned' ELSE 'analysis_requeued' END AS event, CASE WHEN mine AND attempts >= {MAX_ATTEMPTS} THEN 'analysis_worker_error' END AS error_code FROM c""")
def released_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases after their workers' errors."""
    return review.released(_cases(spark, sf_dir), _asked(spark, sf_dir)).select("case_id", "status", "event", "error_code")


@query("""WITH r AS (SELECT user_id AS case_id, event_type AS reviewer_id, CASE WHEN event_id % 3 = 0 THEN 'reject' ELSE 'approve' END AS decision, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS nth FROM events)
SELECT case_id, reviewer_id, decision, nth, nth = 1 AND case_id % 4 <> 0 AS accepted, CASE WHEN nth = 1 AND case_id % 4 <> 0 THEN CASE decision WHEN 'approve' THEN 'APPROVED' ELSE 'REJECTED' END END AS status,
  CASE WHEN nth = 1 AND case_id % 4 <> 0 THEN sha256('{"confidence": 0.5, "outcome": "c' || case_id || '"}') END AS analysis_hash FROM r""")
def case_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews with the hash of what was reviewed; users' events are the reviews."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("case_id") % 4 == 0, review.HELD).otherwise(review.WAITING)
    analysis = F.concat(F.lit('{"outcome":"c'), F.col("case_id").cast("string"), F.lit('","confidence":0.5}'))
    cases = e.select(F.col("user_id").alias("case_id")).distinct().select("case_id", status.alias("status"), analysis.alias("analysis"))
    rows = e.select(F.col("user_id").alias("case_id"), F.col("event_type").alias("reviewer_id"), F.when(F.col("event_id") % 3 == 0, "reject").otherwise("approve").alias("decision"), "ts", F.col("event_id").alias("seq"))
    return review.reviewed(cases, rows)


@query("SELECT event_type AS kind, count(*) AS n FROM (SELECT event_type FROM events UNION ALL SELECT 'case_reviewed' FROM events WHERE event_id % 10 = 0) GROUP BY 1")
def audit_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by kind after an audit log was added to."""
    log = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"), "ts")
    more = log.where("event_id % 10 = 0").withColumn("kind", F.lit("case_reviewed"))
    return review.audited(log, more).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","missing":null,"source":"' || source || '"}') AS line FROM documents""")
def staged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of the JSON lines of a staging file."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.lit(None).cast("string").alias("missing"))
    lines = collect.staging_lines(d, ["doc_id", "lang", "source", "missing"])
    return lines.select(F.get_json_object("value", "$.doc_id").cast("long").alias("doc_id"), F.sha2("value", 256).alias("line"))


@query("SELECT event_type AS name, max_by(event_id, (ts, event_id)) AS version FROM events GROUP BY 1")
def active_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version of each prompt that was activated last."""
    return catalog.active_prompts(table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("event_id").alias("version"), F.col("ts").alias("at")))


@query("SELECT doc_id AS policy, sha256(text) AS content_hash FROM documents WHERE doc_id % 4 <> 0")
def added_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies that a catalogue of every fourth one lacks."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), F.lit(1).alias("version"), F.col("text").alias("content"))
    return catalog.add_policies(d.where("name % 4 = 0"), d).select(F.col("name").alias("policy"), "content_hash")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic FROM labels")
def upserted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels after every fifth one was replaced."""
    rows = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("long").alias("toxic"))
    return ingest.upserted(rows, rows.where("doc_id % 5 = 0").withColumn("toxic", 1 - F.col("toxic")), ["doc_id"])


@query("""SELECT event_id AS record FROM events WHERE (event_id % 3 = 0 AND 1700000000 + event_id % 200 <= 1700000100) OR (event_id % 3 = 1 AND 1700000000 + event_id % 150 <= 1700000100)""")
def claimable_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outbox rows that are due, or whose delivery was lost."""
    i = F.col("event_id")
    status = F.when(i % 3 == 0, "PENDING").when(i % 3 == 1, "DELIVERING").otherwise("DELIVERED")
    rows = table(spark, sf_dir, "events").select(i.alias("record"), status.alias("status"), F.timestamp_seconds(1_700_000_000 + i % 200).alias("available_at"), F.timestamp_seconds(1_700_000_000 + i % 150).alias("lease_end"))
    return workflow.claimable(rows, F.timestamp_seconds(F.lit(1_700_000_100))).select("record")


@query("SELECT event_id AS record FROM events WHERE event_type = 'signup' ORDER BY ts, event_id LIMIT 25")
def first_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 oldest queued records."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("event_id").alias("record"), F.col("ts").alias("created_at"), F.when(F.col("event_type") == "signup", "queued").otherwise("done").alias("status"))
    return workflow.first_claims(rows, 25).select("record")


@query(r"""SELECT page_id, coalesce(nullif(left(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 48), ''), 'section') AS slug,
  regexp_replace('https://user:key@' || page_id || '.example/' || url, '://[^@/]*@', '://', 'g') AS plain_url FROM pages""")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outline labels of addresses, and addresses without credentials."""
    secret = F.concat(F.lit("https://user:key@"), F.col("page_id").cast("string"), F.lit(".example/"), F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", text.slug(F.col("url")).alias("slug"), text.without_credentials(secret).alias("plain_url"))


@query("SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id) LIMIT 50")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty documents that a seed chooses."""
    return evaluate.seeded_sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 7, 50)


@query(f"SELECT count(*) AS queries, round(avg(recall_1), 6) AS recall_1, round(avg(recall_5), 6) AS recall_5, round(avg(recall_10), 6) AS recall_10, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM ({ORACLES['retrieval_metrics']})")
def mean_retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the keyword ranking's quality."""
    m = evaluate.mean_metrics(search.retrieval_metrics(spark, sf_dir))
    return m.select("queries", *(F.round(c, 6).alias(c) for c in ("recall_1", "recall_5", "recall_10", "mrr", "ndcg")))


@query("SELECT doc_id AS doc, array_to_string(list_filter([lang, source], lambda x: x IN ('en', 'de', 'web')), ',') AS labels FROM documents WHERE lang IN ('en', 'de', 'web') OR source IN ('en', 'de', 'web')")
def restricted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples with only the labels that a model knows."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.array("lang", "source").alias("labels"))
    return priors.restricted(d, ["en", "de", "web"]).select("doc", F.array_join("labels", ",").alias("labels"))


@query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS width FROM embeddings")
def checked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors whose width is that of the first one; another width is an error."""
    e = table(spark, sf_dir, "embeddings")
    size = e.select(F.size("embedding")).first()
    return e.select("vec_id", F.size(labels.of_width(F.col("embedding"), size[0] if size else 0)).alias("width"))
