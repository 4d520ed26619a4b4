"""Leases asked for by workers, failed work handed back, and reviews: state tables joined with requests."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from codicil.config import LEASE_SECONDS, MAX_ATTEMPTS

#: States of a case.
QUEUED, HELD, FAILED, WAITING, APPROVED, REJECTED = "QUEUED", "ANALYZING", "FAILED", "REVIEW_REQUIRED", "APPROVED", "REJECTED"


def _owned(cases: DataFrame, requests: DataFrame) -> tuple[DataFrame, Column]:
    """cases with their request, and whether it comes from the worker and token that hold the case."""
    asked = requests.select("case_id", F.col("worker_id").alias("_worker"), F.col("token").alias("_token"), F.lit(True).alias("_asked"))
    mine = F.col("_asked") & (F.col("status") == HELD) & (F.col("worker_id") == F.col("_worker")) & (F.col("token") == F.col("_token"))
    return cases.join(asked, "case_id", "left"), F.coalesce(mine, F.lit(False))


def renewed(cases: DataFrame, requests: DataFrame, now: Column, lease_seconds: int = LEASE_SECONDS) -> DataFrame:
    """cases (case_id, status, worker_id, token, lease_end, ...) after requests (case_id, worker_id, token), and renewed.

    A live lease of the same worker and token ends later then; the token stays. A request of another changes nothing.
    """
    rows, mine = _owned(cases, requests)
    live = mine & F.coalesce(F.col("lease_end") > now, F.lit(False))
    end = F.when(live, now + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(lease_seconds))).otherwise(F.col("lease_end"))
    return rows.withColumn("renewed", live).withColumn("lease_end", end).drop("_worker", "_token", "_asked")


def released(cases: DataFrame, requests: DataFrame, most: int = MAX_ATTEMPTS) -> DataFrame:
    """cases (case_id, status, worker_id, token, attempts, lease_end) after workers' errors, and the audit event of each.

    A case goes back to the queue, or fails once its attempts are used up; a worker that lost it changes nothing.
    """
    rows, mine = _owned(cases, requests)
    done = mine & (F.col("attempts") >= most)
    event = F.when(done, "analysis_abandoned").when(mine, "analysis_requeued")
    error = F.when(done, "analysis_worker_error")
    status = F.when(done, FAILED).when(mine, QUEUED).otherwise(F.col("status"))
    worker, end = F.when(~mine | done, F.col("worker_id")), F.when(~mine, F.col("lease_end"))
    return rows.withColumns({"event": event, "error_code": error, "status": status, "worker_id": worker, "lease_end": end}).drop("_worker", "_token", "_asked")


@F.pandas_udf(StringType())
def snapshot_hash(analysis: pd.Series) -> pd.Series:
    """Hash of a JSON object written with sorted names and the usual spaces."""
    return analysis.map(lambda a: hashlib.sha256(json.dumps(json.loads(a), sort_keys=True).encode()).hexdigest(), na_action="ignore")


def reviewed(cases: DataFrame, reviews: DataFrame) -> DataFrame:
    """Review records: (case_id, reviewer_id, decision, status, analysis_hash, accepted, nth) of reviews by time.

    cases: (case_id, status, analysis: JSON); reviews: (case_id, reviewer_id, decision, ts, seq). The first review of a
    case that waits for one is accepted and sets its status; later ones, and those of other cases, change nothing.
    """
    nth = F.row_number().over(Window.partitionBy("case_id").orderBy("ts", "seq"))  # the reviews of one case
    rows = reviews.withColumn("nth", nth).join(cases.select("case_id", F.col("status").alias("_was"), "analysis"), "case_id")
    good = (F.col("_was") == WAITING) & (F.col("nth") == 1)
    status = F.when(good & (F.col("decision") == "approve"), APPROVED).when(good, REJECTED)
    return rows.select("case_id", "reviewer_id", "decision", status.alias("status"), F.when(good, snapshot_hash("analysis")).alias("analysis_hash"), good.alias("accepted"), "nth")


def audited(log: DataFrame, events: DataFrame) -> DataFrame:
    """The audit log with further events; it is only ever added to."""
    return log.unionByName(events.select(*log.columns))


def latest_succeeded(runs: DataFrame, by: str) -> DataFrame:
    """The last succeeded run (status, ts, run_id) of each key."""
    return runs.where("status = 'succeeded'").groupBy(by).agg(F.max_by("run_id", F.struct("ts", "run_id")).alias("run_id"), F.max("ts").alias("ts"))
