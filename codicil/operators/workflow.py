"""Queues as an append-only log of events, replayed to the current state; deliveries and reviews.

A claim event takes a record with the next fencing token and a lease; a renewal in time moves the lease's end and
keeps the token. A later event of the holder counts only if it comes before the lease's end, and a finalised or
failed event ends the lease. Log rows may name the token that they act for; those of another token don't count.
"""

from __future__ import annotations

import hashlib
import hmac
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codicil.config import LEASE_SECONDS, MAX_ATTEMPTS
from codicil.functions.vectors import back_off


def from_events(events: DataFrame) -> DataFrame:
    """The test events as queue events: record, seq, ts, kind (queued, claimed, renewed, finalised, failed)."""
    kind = F.col("event_type")
    named = F.when(kind == "signup", "queued").when(kind == "view", "claimed").when(kind == "click", "renewed").when(kind == "purchase", "finalised").otherwise("failed")
    return events.select(F.col("user_id").alias("record"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), named.alias("kind"))


def fenced(log: DataFrame, lease_seconds: int = LEASE_SECONDS) -> DataFrame:
    """log with token (claims so far), lease_end after the event, and whether the event counts.

    Within the time of one token, claim and renewals are a chain that breaks where a renewal comes too late.
    """
    lease = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(lease_seconds))
    kind = F.col("kind")
    rows = log.withColumn("token", F.count_if(kind == "claimed").over(Window.partitionBy("record").orderBy("ts", "seq")))
    own = Window.partitionBy("record", "token").orderBy("ts", "seq")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    held = F.col("ts") < F.last(F.when(kind.isin("claimed", "renewed"), F.col("ts")), True).over(before) + lease
    if "acts_for" in log.columns:
        held = held & F.coalesce(F.col("acts_for") == F.col("token"), F.lit(True))
    rows = rows.withColumn("_held", F.coalesce(held, F.lit(False)) & (F.col("token") > 0))
    broken = F.coalesce(F.max((kind == "renewed") & ~F.col("_held")).over(before), F.lit(False))
    ended = F.coalesce(F.max(kind.isin("finalised", "failed")).over(before), F.lit(False))
    rows = rows.withColumn("valid", kind.isin("queued", "claimed") | (F.col("_held") & ~broken & ~ended))
    anchor = F.when(kind.isin("claimed", "renewed") & F.col("valid"), F.col("ts"))
    return rows.withColumn("lease_end", F.last(anchor, True).over(own) + lease).drop("_held")


def current_state(log: DataFrame, lease_seconds: int = LEASE_SECONDS) -> DataFrame:
    """Last counting event of each record, its token and the events that came too late."""
    rows = fenced(log, lease_seconds)
    return rows.groupBy("record").agg(F.max_by(F.when(F.col("valid"), F.col("kind")), F.when(F.col("valid"), F.struct("ts", "seq"))).alias("state"), F.max("token").alias("token"), F.count_if(~F.col("valid")).alias("stale"))


def reaped(state: DataFrame, now: Column, most: int = MAX_ATTEMPTS) -> DataFrame:
    """Records whose lease has ended: back to the queue, or failed once their attempts are used up. state: (record, status, attempts, lease_end)."""
    expired = state.where((F.col("status") == "claimed") & (F.col("lease_end") <= now))
    return expired.withColumn("status", F.when(F.col("attempts") >= most, "failed").otherwise("queued"))


def claimable(outbox: DataFrame, now: Column) -> DataFrame:
    due = ((F.col("status") == "PENDING") & (F.col("available_at") <= now)) | ((F.col("status") == "DELIVERING") & (F.col("lease_end") <= now))
    return outbox.where(due)


def after_delivery(outbox: DataFrame, delivered: Column, now: Column, most: int = MAX_ATTEMPTS) -> DataFrame:
    """State of outbox rows after one more attempt: delivered, dead, or pending until a longer wait is over."""
    attempts = F.col("attempts") + 1
    status = F.when(delivered, "DELIVERED").when(attempts >= most, "DEAD").otherwise("PENDING")
    return outbox.withColumns({"attempts": attempts, "status": status, "available_at": F.when(status == "PENDING", F.timestamp_seconds(F.unix_timestamp(now) + back_off(attempts))).otherwise(F.col("available_at"))})


def first_claims(queue: DataFrame, n: int = 1) -> DataFrame:
    """Oldest queued records."""
    return queue.where("status = 'queued'").orderBy("created_at", "record").limit(n)


def idempotent(requests: DataFrame, keys: list[str]) -> DataFrame:
    """The earliest request of each key set, and how many repeated it."""
    first = F.min(F.struct("ts", "seq")).alias("f")
    return requests.groupBy(*keys).agg(first, (F.count(F.lit(1)) - 1).alias("repeats")).select(*keys, F.col("f.ts").alias("ts"), F.col("f.seq").alias("seq"), "repeats")


def timeline(log: DataFrame) -> DataFrame:
    """Events of each record with the time since the one before."""
    past = Window.partitionBy("record").orderBy("ts", "seq")
    return log.withColumn("nth", F.row_number().over(past)).withColumn("gap", F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(past)))


def usage(attempts: DataFrame, input_price: float, output_price: float) -> DataFrame:
    """Summed tokens, latency and cost of each case over its attempts; prices for a million tokens."""
    sums = attempts.groupBy("case_id").agg(*(F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "latency_ms")))
    return sums.withColumn("cost", (F.col("input_tokens") * input_price + F.col("output_tokens") * output_price) / 1e6)


def canonical(value: dict) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def signature(body: str, secret: str) -> str:
    return hmac.new(secret.encode(), body.encode(), hashlib.sha256).hexdigest()


def signed(outbox: DataFrame, secret: str) -> DataFrame:
    """Outbox rows (payload: JSON) with the canonical body and its signature."""

    @F.pandas_udf("struct<body:string,signature:string>")
    def sign(payload: pd.Series) -> pd.DataFrame:
        bodies = [canonical(json.loads(p)) for p in payload]
        return pd.DataFrame({"body": bodies, "signature": [signature(b, secret) for b in bodies]})

    return outbox.withColumn("_s", sign("payload")).select("*", "_s.body", "_s.signature").drop("_s")
