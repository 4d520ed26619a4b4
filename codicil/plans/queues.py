"""Queries of queues, deliveries, audit trails and summaries over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codicil.config import MAX_ATTEMPTS
from codicil.operators import evaluate, workflow
from codicil.plans.search import ORACLES, QUERIES, query
from codicil.sources.tables import table
from codicil.streaming import claims

__all__ = ["ORACLES", "QUERIES"]

#: Leases long enough for the test events, which are hours apart for a record.
LEASE = 12 * 3600

LOG = f"""log AS (SELECT user_id AS record, event_id AS seq, ts, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'claimed' WHEN 'click' THEN 'renewed'
  WHEN 'purchase' THEN 'finalised' ELSE 'failed' END AS kind FROM events),
marked AS (SELECT *, count(*) FILTER (kind = 'claimed') OVER (PARTITION BY record ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS token FROM log),
anchored AS (SELECT *, coalesce(token > 0 AND ts < max(CASE WHEN kind IN ('claimed', 'renewed') THEN ts END) OVER b + INTERVAL {LEASE} SECOND, false) AS held,
  coalesce(bool_or(kind IN ('finalised', 'failed')) OVER b, false) AS ended
  FROM marked WINDOW b AS (PARTITION BY record, token ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fenced AS (SELECT *, kind IN ('queued', 'claimed') OR (held AND NOT ended AND NOT coalesce(bool_or(kind = 'renewed' AND NOT held) OVER b, false)) AS valid
  FROM anchored WINDOW b AS (PARTITION BY record, token ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
state AS (SELECT record, max_by(kind, (ts, seq)) FILTER (valid) AS state, max(token) AS token, count(*) FILTER (NOT valid) AS stale,
  max(ts) FILTER (valid AND kind IN ('claimed', 'renewed')) AS held_at FROM fenced GROUP BY 1)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.from_events(table(spark, sf_dir, "events"))


@query(f"WITH {LOG} SELECT record, state, token, stale FROM state")
def queue_current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State, token and stale events of each record, from the whole log."""
    return workflow.current_state(log(spark, sf_dir), LEASE)


@query(f"""WITH {LOG}, now AS (SELECT max(ts) AS now FROM events)
SELECT record, CASE WHEN token >= {MAX_ATTEMPTS} THEN 'failed' ELSE 'queued' END AS status, token AS attempts FROM state, now
WHERE state IN ('claimed', 'renewed') AND held_at + INTERVAL {LEASE} SECOND <= now""")
def queue_reap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims whose lease has ended at the log's last moment."""
    rows = log(spark, sf_dir)
    ends = workflow.fenced(rows, LEASE).groupBy("record").agg(F.max("lease_end").alias("lease_end"))
    state = workflow.current_state(rows, LEASE).join(ends, "record").select("record", F.when(F.col("state") == "renewed", "claimed").otherwise(F.col("state")).alias("status"), F.col("token").alias("attempts"), "lease_end")
    now = rows.agg(F.max("ts").alias("now"))
    held = state.crossJoin(F.broadcast(now))  # one row
    return workflow.reaped(held, F.col("now")).select("record", "status", "attempts")


@query(f"""SELECT event_id AS record, n AS attempts, CASE WHEN event_type = 'purchase' THEN 'DELIVERED' WHEN n >= {MAX_ATTEMPTS} THEN 'DEAD' ELSE 'PENDING' END AS status,
  CAST(epoch(ts) AS BIGINT) AS asked, CAST(CASE WHEN event_type <> 'purchase' AND n < {MAX_ATTEMPTS} THEN epoch(date_trunc('second', ts)) + least(pow(2, n), 300) ELSE epoch(date_trunc('second', ts)) END AS BIGINT) AS available
FROM (SELECT *, CAST(event_id % 3 + 1 AS INTEGER) AS n, date_trunc('second', ts) AS ts FROM (SELECT event_id, event_type, ts AS ts0, date_trunc('second', ts) AS ts FROM events))""")
def outbox_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outbox rows after one more attempt at their own time."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.date_trunc("second", F.col("ts").cast("timestamp")))
    rows = e.select(F.col("event_id").alias("record"), (F.col("event_id") % 3).cast("int").alias("attempts"), F.lit("DELIVERING").alias("status"), "ts", F.col("ts").alias("available_at"), "event_type")
    after = workflow.after_delivery(rows, F.col("event_type") == "purchase", F.col("ts"))
    return after.select("record", "attempts", "status", F.unix_timestamp("ts").alias("asked"), F.unix_timestamp("available_at").alias("available"))


@query(f"WITH {LOG} SELECT record, seq, kind, CAST(row_number() OVER w AS INTEGER) AS nth, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap FROM log WINDOW w AS (PARTITION BY record ORDER BY ts, seq)")
def audit_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.timeline(log(spark, sf_dir)).select("record", "seq", "kind", "nth", "gap")


@query("SELECT user_id, event_type, min((ts, event_id))[2] AS seq, count(*) - 1 AS repeats FROM events GROUP BY 1, 2")
def idempotent_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first request of each user and type; the others repeat it."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", F.col("event_id").alias("seq"))
    return workflow.idempotent(e, ["user_id", "event_type"]).select("user_id", "event_type", "seq", "repeats")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = evaluate.percentiles(table(spark, sf_dir, "events"), "event_type", "value")
    return p.withColumns({c: F.round(c, 6) for c in ("p50", "p95", "mean")})


@query("SELECT event_type AS category, count(*) AS n, count(*) FILTER (value > 10) AS passed, round(avg(CAST(value > 10 AS INTEGER)), 3) AS rate FROM events GROUP BY 1")
def answer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.summary(table(spark, sf_dir, "events").select(F.col("event_type").alias("category"), (F.col("value") > 10).alias("passed")))


@query("SELECT split_part(e, ':', 1) AS code, count(*) AS n FROM (SELECT unnest([event_type || ':' || CAST(event_id AS VARCHAR), 'total']) AS e FROM events) GROUP BY 1")
def failure_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.array(F.concat("event_type", F.lit(":"), F.col("event_id").cast("string")), F.lit("total"))
    return evaluate.reasons(table(spark, sf_dir, "events").select(named.alias("errors")))


@query("""WITH a AS (SELECT user_id AS case_id, sum(event_id % 700) AS input_tokens, sum(event_id % 90) AS output_tokens, sum(event_id % 1000) AS latency_ms FROM events GROUP BY 1)
SELECT case_id, CAST(input_tokens AS BIGINT) AS input_tokens, CAST(output_tokens AS BIGINT) AS output_tokens, CAST(latency_ms AS BIGINT) AS latency_ms, round((input_tokens * 3.0 + output_tokens * 15.0) / 1e6, 9) AS cost FROM a""")
def usage_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    rows = e.select(F.col("user_id").alias("case_id"), (i % 700).alias("input_tokens"), (i % 90).alias("output_tokens"), (i % 1000).alias("latency_ms"))
    return workflow.usage(rows, 3.0, 15.0).withColumn("cost", F.round("cost", 9))


@query()
def signed_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as canonical bodies with their signatures."""
    return workflow.signed(table(spark, sf_dir, "events").select("event_id", F.col("props").alias("payload")), "test-key")


#: Leases of the claims below: three days.
CLAIM_LEASE = 3 * 86_400

_CLAIMS = f"""ev AS (SELECT user_id AS record, epoch_us(ts) AS moment, event_id AS seq, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'claimed' WHEN 'click' THEN 'renewed'
  WHEN 'purchase' THEN CASE WHEN event_id % 4 = 0 THEN 'finalised' ELSE 'claimed' END ELSE 'released' END AS kind, 'w' || event_id % 2 AS worker, 1 + event_id % 2 AS asked,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
walk(record, n, status, worker, token, attempts, lease_end, counted) AS (
  SELECT record, CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0 FROM (SELECT DISTINCT record FROM ev)
  UNION ALL
  SELECT record, n, CASE WHEN kind = 'queued' AND s IS NULL THEN 'queued' WHEN kind = 'claimed' AND s = 'queued' THEN 'claimed' WHEN mine AND kind = 'finalised' THEN 'finalised'
      WHEN mine AND kind = 'released' THEN CASE WHEN attempts >= {MAX_ATTEMPTS} THEN 'failed' ELSE 'queued' END ELSE s END,
    CASE WHEN kind = 'claimed' AND s = 'queued' THEN asker WHEN mine AND kind = 'released' AND attempts < {MAX_ATTEMPTS} THEN NULL ELSE w END,
    token + CASE WHEN kind = 'claimed' AND s = 'queued' THEN 1 ELSE 0 END, attempts + CASE WHEN kind = 'claimed' AND s = 'queued' THEN 1 ELSE 0 END,
    CASE WHEN kind = 'claimed' AND s = 'queued' OR mine AND kind = 'renewed' THEN moment + {CLAIM_LEASE}000000 ELSE lease_end END,
    counted + CASE WHEN kind = 'queued' AND s IS NULL OR kind = 'claimed' AND s = 'queued' OR mine AND kind IN ('renewed', 'finalised', 'released') THEN 1 ELSE 0 END
  FROM (SELECT *, coalesce(s = 'claimed' AND w = asker AND token = asked, false) AS mine FROM (
    SELECT r.record, e.n, e.kind, e.moment, e.worker AS asker, e.asked, r.token, r.attempts, r.lease_end, r.counted,
      CASE WHEN r.status = 'claimed' AND r.lease_end <= e.moment THEN CASE WHEN r.attempts >= {MAX_ATTEMPTS} THEN 'failed' ELSE 'queued' END ELSE r.status END AS s,
      CASE WHEN r.status = 'claimed' AND r.lease_end <= e.moment AND r.attempts < {MAX_ATTEMPTS} THEN NULL ELSE r.worker END AS w
    FROM walk r JOIN ev e ON e.record = r.record AND e.n = r.n + 1))),
ended AS (SELECT * FROM walk QUALIFY n = max(n) OVER (PARTITION BY record)), till AS (SELECT max(moment) AS till FROM ev)"""


def claim_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test events as requests of two workers with tokens."""
    i, kind = F.col("event_id"), F.col("event_type")
    named = F.when(kind == "signup", "queued").when(kind == "view", "claimed").when(kind == "click", "renewed").when((kind == "purchase") & (i % 4 == 0), "finalised").when(kind == "purchase", "claimed").otherwise("released")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("record"), F.col("ts").cast("timestamp").alias("ts"), i.alias("seq"), named.alias("kind"), F.concat(F.lit("w"), (i % 2).cast("string")).alias("worker"), (1 + i % 2).alias("token"))


@query(f"""WITH RECURSIVE {_CLAIMS}
SELECT record, CASE WHEN status = 'claimed' AND lease_end <= till THEN CASE WHEN attempts >= {MAX_ATTEMPTS} THEN 'failed' ELSE 'queued' END ELSE status END AS status,
  CASE WHEN status = 'claimed' AND lease_end <= till AND attempts < {MAX_ATTEMPTS} THEN NULL ELSE worker END AS worker, token, attempts, CAST(counted AS BIGINT) AS counted
FROM ended, till WHERE counted > 0""")
def claim_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record after all requests and the reaping of leases between them, and how many requests counted."""
    return claims.states_in_batch(claim_events(spark, sf_dir), CLAIM_LEASE).where("record IS NOT NULL")
