"""Claims on a stream: one winner for each record, leases that timers end, and an outbox that is delivered once.

``claims`` keeps each record's status, holder, fencing token, attempts and lease in a state of its own. Requests to queue, claim, renew,
finish or release come as events; what a stale token asks is refused. A timer at the lease's end reaps the record: back
to the queue, or failed once its attempts are used up. Time is event time, so a replay of the same events gives the same result, and
state that a batch has worked out before (``initial``) is where the stream goes on.

``deliver_once`` sends each micro-batch's rows under their keys. Keys that were sent are a table, which a batch that is repeated after a failure
looks into before it sends anything, and each batch writes its own part of it once. What failed waits longer after every attempt,
until it is dead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from codicil.config import LEASE_SECONDS, MAX_ATTEMPTS
from codicil.functions.vectors import back_off

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: An event: (record, ts, seq, kind, worker, token); kind is queued, claimed, renewed, finalised or released.
STATE = "status string, worker string, token long, attempts long, lease_end long"
OUTPUT = "record long, ts timestamp, seq long, kind string, accepted boolean, status string, worker string, token long, attempts long"
#: A record at the end, its Arrow types, and rows that a task gives at once.
FINAL = "record long, status string, worker string, token long, attempts long, counted long"
ARROW, GIVEN = {"long": "int64", "string": "string", "boolean": "bool_"}, 8_192
#: What the log has for a lease that ended: the event's kind, and its number before all of the same moment.
REAPED, REAPED_SEQ = "reaped", -1
MICROS = 1_000_000


def step(state: tuple, kind: str, at: int | None, worker: str | None, token: int | None, lease: int, most: int) -> tuple[tuple, bool]:
    """The state after an event at a moment (microseconds), and whether it counted. A lease that has ended was reaped before."""
    status, holder, current, attempts, end = state
    held = None if at is None else at + lease  # without a moment, a lease has no end
    if kind == "queued":
        return ("queued", None, current, attempts, 0) if status is None else state, status is None
    if kind == "claimed":
        if status != "queued":
            return state, False
        return ("claimed", worker, current + 1, attempts + 1, held), True
    if status != "claimed" or worker != holder or token != current:
        return state, False
    if kind == "renewed":
        return ("claimed", holder, current, attempts, held), True
    if kind == "finalised":
        return ("finalised", holder, current, attempts, 0), True
    return (reap(state, most), True) if kind == "released" else (state, False)


def reap(state: tuple, most: int) -> tuple:
    """The state once its holder has lost it."""
    _, holder, current, attempts, _ = state
    return ("failed", holder, current, attempts, 0) if attempts >= most else ("queued", None, current, attempts, 0)


NEW = (None, None, 0, 0, 0)


def replay(events: pd.DataFrame, state: tuple, lease: int, most: int) -> tuple[list[tuple], tuple]:
    """Log rows (moment, seq, kind, accepted, state) of one record's events in order, leases that end between them included."""
    out = []
    for e in events.itertuples(index=False):
        state = _until(e.at, state, most, out)
        state, good = step(state, e.kind, e.at, e.worker, e.token, lease, most)
        out.append((e.at, e.seq, e.kind, good, state))
    return out, state


def _until(at: int | None, state: tuple, most: int, out: list[tuple]) -> tuple:
    """The state after a lease that ended at or before a moment."""
    if state[0] == "claimed" and at is not None and state[4] is not None and state[4] <= at:
        end, state = state[4], reap(state, most)
        out.append((end, REAPED_SEQ, REAPED, True, state))
    return state


def _frame(record: int, rows: list[tuple]) -> pd.DataFrame:
    data = [(record, pd.Timestamp(at, unit="us"), seq, kind, good, s[0], s[1], s[2], s[3]) for at, seq, kind, good, s in rows]
    return pd.DataFrame(data, columns=["record", "ts", "seq", "kind", "accepted", "status", "worker", "token", "attempts"])


def _micros(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    rows = pd.concat(list(frames))
    rows["at"] = rows["ts"].astype("datetime64[us]").astype("int64")
    return rows.astype({"worker": object, "token": object}).where(lambda x: x.notna(), None).sort_values(["at", "seq"])


class Claims(StatefulProcessor):
    """State and timer of one record. Timers count milliseconds, leases microseconds; a timer fires at or after its lease's end."""

    def __init__(self, lease_seconds: int, most: int):
        self.lease, self.most = lease_seconds * MICROS, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("claim", STATE)

    def _write(self, state: tuple) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.state.update(state)
        if state[0] == "claimed":
            self.handle.registerTimer(-(-state[4] // 1000))

    def _read(self) -> tuple:
        return tuple(self.state.get()) if self.state.exists() else NEW

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:
        r = initialState.iloc[0]
        worker = None if pd.isna(r["worker"]) else r["worker"]
        self._write((r["status"], worker, int(r["token"]), int(r["attempts"]), int(r["lease_end"])))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        out, state = replay(_micros(rows), self._read(), self.lease, self.most)
        self._write(state)
        yield _frame(key[0], out)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        state = _until(expiredTimerInfo.getExpiryTimeInMs() * 1000, self._read(), self.most, out)
        if out:
            self._write(state)
        yield _frame(key[0], out)

    def close(self) -> None:
        pass


def claims(events: DataFrame, late: str = "0 seconds", lease_seconds: int = LEASE_SECONDS, most: int = MAX_ATTEMPTS, initial: DataFrame | None = None) -> DataFrame:
    """The log of a stream of events (record, ts, seq, kind, worker, token): each event with whether it counted, and each reaping.

    late: how much later than newer ones of its record an event may come; those of a micro-batch are taken in order. initial: (record,
    status, worker, token, attempts, lease_end in microseconds) with which the stream's first batch begins. Needs the RocksDB state store.
    """
    grouped = events.withWatermark("ts", late).groupBy("record")
    begin = initial.groupBy("record") if initial is not None else None
    return grouped.transformWithStateInPandas(Claims(lease_seconds, most), OUTPUT, "Append", "eventTime", initialState=begin)


def _rows(batches: Iterator[pa.RecordBatch], end: int, lease: int, most: int, log: bool) -> Iterator[tuple]:
    """The log of a partition's sorted events or, without it, a row for each record of which a request counted. What is held is one record's state."""
    record, state, counted, begun = None, NEW, 0, False

    def ended() -> list[tuple]:
        out: list[tuple] = []
        last = _until(end, state, most, out)
        if log:
            return [(record, *r[:4], *r[4][:4]) for r in out]
        return [(record, *last[:4], counted)] if counted else []

    for batch in batches:
        for own, at, seq, kind, worker, token in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not begun or own != record:
                if begun:
                    yield from ended()
                record, state, counted, begun = own, NEW, 0, True
            out: list[tuple] = []
            state = _until(at, state, most, out)
            state, good = step(state, kind, at, worker, token, lease, most)
            counted += good
            if log:
                yield from ((record, *r[:4], *r[4][:4]) for r in out)
                yield (record, at, seq, kind, good, *state[:4])
    if begun:
        yield from ended()


def _gone_over(events: DataFrame, lease_seconds: int, most: int, until: str | None, log: bool) -> DataFrame:
    """Events with those of a record in one partition and in order, those without a moment last, gone over as they come: no group is held whole."""
    end = events.agg(F.unix_micros(F.max("ts")).alias("end") if until is None else F.unix_micros(F.lit(until).cast("timestamp")).alias("end")).first()["end"]
    order = [F.col(c).asc_nulls_last() for c in ("at", "seq")]
    rows = events.select(F.col("record").cast("long"), F.unix_micros("ts").alias("at"), F.col("seq").cast("long"), "kind", "worker", F.col("token").cast("long"))
    schema = OUTPUT.replace("ts timestamp", "at long") if log else FINAL
    types = [getattr(pa, ARROW[field.split(" ")[1]])() for field in schema.split(", ")]
    names = [field.split(" ")[0] for field in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _rows(batches, end if end is not None else 0, lease_seconds * MICROS, most, log)
        while part := list(islice(made, GIVEN)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)], names)

    return rows.repartition("record").sortWithinPartitions("record", *order).mapInArrow(run, schema)


def claims_in_batch(events: DataFrame, lease_seconds: int = LEASE_SECONDS, most: int = MAX_ATTEMPTS, until: str | None = None) -> DataFrame:
    """The same log of events at hand; until: moment up to which leases that nothing followed are reaped, the last event's by default."""
    log = _gone_over(events, lease_seconds, most, until, log=True)
    return log.withColumn("at", F.timestamp_micros("at")).withColumnRenamed("at", "ts")


def states_in_batch(events: DataFrame, lease_seconds: int = LEASE_SECONDS, most: int = MAX_ATTEMPTS, until: str | None = None) -> DataFrame:
    """record, status, worker, token, attempts after the log of claims_in_batch, and how many requests counted, where any did. No log is made."""
    return _gone_over(events, lease_seconds, most, until, log=False)


def final_states(log: DataFrame) -> DataFrame:
    """record, status, worker, token, attempts after the last row of a log that counted."""
    last = F.max_by(F.struct("status", "worker", "token", "attempts"), F.struct("ts", "seq"))
    return log.where("accepted").groupBy("record").agg(last.alias("s")).select("record", "s.*")


#: Deliveries that one call of a sender takes.
SENT_AT_ONCE = 500
SENT = "key string, status string, attempts int, available_at timestamp"


class Outbox:
    """Deliveries and what became of them, as tables below a shared folder."""

    def __init__(self, spark: SparkSession, folder: str, most: int = MAX_ATTEMPTS):
        self.spark, self.folder, self.most = spark, folder, most
        spark.createDataFrame([], f"{SENT}, batch long").write.mode("ignore").partitionBy("batch").parquet(f"{folder}/sent")

    def log(self) -> DataFrame:
        """A row for each attempt: key, status (DELIVERED, PENDING, DEAD), attempts, available_at, and the batch that made it."""
        return self.spark.read.schema(f"{SENT}, batch long").parquet(f"{self.folder}/sent")

    def states(self) -> DataFrame:
        """The last state of each key."""
        last = F.max_by(F.struct("status", "attempts", "available_at"), "attempts")
        return self.log().groupBy("key").agg(last.alias("s")).select("key", "s.*")

    def due(self, rows: DataFrame, now: str) -> DataFrame:
        """Rows (key, ...) never tried, or pending until now at the latest, with the attempts so far; each key once."""
        known = self.states()
        fresh = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("key").orderBy(F.lit(1)))).where("_nth = 1").drop("_nth")
        joined = fresh.join(known.withColumnRenamed("attempts", "_tried"), "key", "left")
        wait = F.col("status").isNull() | (F.col("status") == "PENDING") & (F.col("available_at") <= F.lit(now).cast("timestamp"))
        return joined.where(wait).withColumn("_tried", F.coalesce("_tried", F.lit(0))).drop("status", "available_at")

    def attempt(self, rows: DataFrame, batch: int, now: str, send: Callable[[list[dict]], list[bool]]) -> None:
        """Send what is due and write the outcome as the batch's own part, once.

        A sender gets rows with their keys and says which were taken; what it raises is a failure of all it was given.
        """
        if self.log().where(F.col("batch") == batch).limit(1).count():
            return  # this batch was sent and written down
        due = self.due(rows, now)
        kept = [c for c in due.columns if c != "_tried"]

        def tried(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                some = iter(f.to_dict("records"))
                while part := list(islice(some, SENT_AT_ONCE)):
                    try:
                        taken = send([{k: r[k] for k in kept} for r in part])
                    except (OSError, ValueError):
                        taken = [False] * len(part)
                    yield pd.DataFrame({"key": [r["key"] for r in part], "delivered": taken, "attempts": [r["_tried"] + 1 for r in part]})

        n = F.col("attempts")
        status = F.when(F.col("delivered"), "DELIVERED").when(n >= self.most, "DEAD").otherwise("PENDING")
        again = F.when(status == "PENDING", F.timestamp_seconds(F.unix_timestamp(F.lit(now).cast("timestamp")) + back_off(n)))
        out = due.mapInPandas(tried, "key string, delivered boolean, attempts int")
        out = out.select("key", status.alias("status"), "attempts", again.alias("available_at"), F.lit(batch).cast("long").alias("batch"))
        out.write.mode("append").partitionBy("batch").parquet(f"{self.folder}/sent")


def deliver_once(outbox: DataFrame, store: Outbox, send: Callable[[list[dict]], list[bool]], checkpoint: str, now: Callable[[], str]) -> StreamingQuery:
    """Send each micro-batch of outbox (key, ...), and rows of earlier ones whose wait is over.

    A row is sent before it is written down, so a receiver may see a key again after a crash between both and has to know its keys; a
    batch that was written down is never sent again.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.withColumn("key", F.col("key").cast("string"))
        rows.write.mode("overwrite").parquet(f"{store.folder}/rows/batch={number}")
        every = rows.sparkSession.read.schema(StructType([*rows.schema.fields, StructField("batch", LongType())])).parquet(f"{store.folder}/rows")
        pending = store.states().where("status = 'PENDING'").select("key")
        waiting = every.where(F.col("batch") < number).join(pending, "key", "left_semi")
        store.attempt(rows.unionByName(waiting.select(*rows.columns)), number, now(), send)

    return outbox.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
