"""Claims and deliveries on streams: equal to the batch, across restarts, with stale tokens, failures and repeated batches."""

from __future__ import annotations

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from codicil.plans import queues
from codicil.streaming import claims, queue

SCHEMA = "record long, s long, seq long, kind string, worker string, token long"
NAMES = ("record", "ts", "seq", "kind", "accepted", "status", "worker", "token", "attempts")


@pytest.fixture(scope="module", autouse=True)
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, claims.PROVIDER)
    yield
    spark.conf.set(name, before)


def requests(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).select("record", F.timestamp_seconds("s").alias("ts"), "seq", "kind", "worker", "token")


def listed(df):
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=repr)


def run(spark, folder, schema, files, name, initial=None, lease=60):
    """Run the stream over what the folder holds now and stop, as a restart does; the log so far."""
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
    out = claims.claims(events, lease_seconds=lease, initial=initial).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/{name}")
    out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def test_stream_of_claims_equals_batch(spark, tmp_path):
    rng = random.Random(1)
    kinds = ["queued", "claimed", "claimed", "renewed", "finalised", "released", "unknown"]
    rows = [(rng.randrange(12), 1_700_000_000 + i * 7, i, rng.choice(kinds), rng.choice("ab"), rng.randrange(1, 4)) for i in range(400)]
    df = requests(spark, rows)
    for k in range(4):
        df.where(f"seq div 100 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if k in (1, 3):  # the stream stops after half of the files and goes on from its checkpoint
            got = run(spark, tmp_path, df.schema, 1, "cp")
    want = claims.claims_in_batch(df)
    assert listed(got) == listed(want)
    kinds_of = {r.kind: r.accepted for r in got.collect()}
    assert kinds_of["reaped"] and not kinds_of["unknown"]


def test_lease_ends_without_another_event(spark, tmp_path):
    rows = [(1, 1000, 0, "queued", None, None), (1, 1010, 1, "claimed", "a", None), (2, 1011, 2, "queued", None, None), (2, 5000, 3, "claimed", "b", None)]
    requests(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/in")
    got = run(spark, tmp_path, requests(spark, rows).schema, 1, "cp")
    assert [(r.record, r.status, r.worker, r.ts.timestamp()) for r in got.where("kind = 'reaped'").collect()] == [(1, "queued", None, 1070.0)]


def test_stale_tokens_and_initial_state(spark, tmp_path):
    begin = spark.createDataFrame([(7, "claimed", "a", 3, 3, 2_000 * 10**6), (8, "queued", None, 1, 1, 0)], "record long, status string, worker string, token long, attempts long, lease_end long")
    rows = [
        (7, 1900, 0, "finalised", "a", 2), (7, 1901, 1, "finalised", "b", 3), (7, 1902, 2, "renewed", "a", 3), (7, 1903, 3, "claimed", "b", None),
        (8, 1904, 4, "claimed", "b", None), (8, 1905, 5, "claimed", "a", None), (8, 1906, 6, "finalised", "b", 2), (7, 2500, 7, "finalised", "a", 3),
    ]
    requests(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/in")
    got = {r.seq: (r.accepted, r.status, r.token) for r in run(spark, tmp_path, requests(spark, rows).schema, 1, "cp", begin).where("kind <> 'reaped'").collect()}
    assert got == {
        0: (False, "claimed", 3), 1: (False, "claimed", 3), 2: (True, "claimed", 3), 3: (False, "claimed", 3),
        4: (True, "claimed", 2), 5: (False, "claimed", 2), 6: (True, "finalised", 2), 7: (False, "failed", 3),  # its lease ended at 1962, with no attempt left
    }


def test_claims_of_test_events_on_a_stream(spark, sf_dir, tmp_path):
    df = queues.claim_events(spark, sf_dir)
    df.repartitionByRange(3, "ts").write.parquet(f"{tmp_path}/all")
    parts = sorted(Path(f"{tmp_path}/all").glob("*.parquet"))
    Path(f"{tmp_path}/in").mkdir()
    for p in parts:  # by time
        p.rename(f"{tmp_path}/in/{p.name}")
        got = run(spark, tmp_path, df.schema, 1, "cp", lease=queues.CLAIM_LEASE)
    want = claims.claims_in_batch(df, queues.CLAIM_LEASE)
    assert listed(got.where("kind <> 'reaped'")) == listed(want.where("kind <> 'reaped'"))
    assert claims.claims_in_batch(df.limit(0)).count() == 0


# deliveries


def sender(log, fails):
    """Writes each key it is given; refuses those of fails as often as they say."""

    def send(rows):
        taken = []
        for r in rows:
            with open(log, "a", encoding="utf-8") as f:
                f.write(json.dumps(r["key"]) + "\n")
            n = sum(json.loads(x) == r["key"] for x in open(log, encoding="utf-8"))
            if fails.get(r["key"]) == "raises":
                raise OSError("unreachable")
            taken.append(n > fails.get(r["key"], 0))
        return taken

    return send


def test_deliveries_are_sent_and_counted_once(spark, tmp_path):
    log, now = str(tmp_path / "sent"), ["2026-01-01 00:00:00"]
    store = claims.Outbox(spark, str(tmp_path / "outbox"))
    send = sender(log, {"b": 1, "d": 9})
    times = lambda: {k: sum(json.loads(x) == k for x in open(log, encoding="utf-8")) for k in "abcde"}

    def deliver(keys):
        spark.createDataFrame([(k, "{}") for k in keys], "key string, payload string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        rows = spark.readStream.schema("key string, payload string").parquet(f"{tmp_path}/in")
        claims.deliver_once(rows, store, send, f"{tmp_path}/cp", lambda: now[0]).awaitTermination()
        return {r.key: (r.status, r.attempts) for r in store.states().collect()}

    assert deliver("abcda") == {"a": ("DELIVERED", 1), "b": ("PENDING", 1), "c": ("DELIVERED", 1), "d": ("PENDING", 1)}
    assert deliver("e") == {"a": ("DELIVERED", 1), "b": ("PENDING", 1), "c": ("DELIVERED", 1), "d": ("PENDING", 1), "e": ("DELIVERED", 1)}  # too early for b and d
    now[0] = "2026-01-01 01:00:00"
    assert deliver("a")["b"] == ("DELIVERED", 2)
    for day in range(2, 6):
        now[0] = f"2026-01-0{day} 00:00:00"
        last = deliver("a")
    assert last["d"] == ("DEAD", 3) and times() == {"a": 1, "b": 2, "c": 1, "d": 3, "e": 1}
    rows = spark.createDataFrame([("a", "{}"), ("z", "{}")], "key string, payload string")
    store.attempt(rows, 0, now[0], send)  # batch 0 comes again, as after a crash of the driver: nothing is sent
    assert "z" not in open(log, encoding="utf-8").read()
    assert store.log().where("status = 'DELIVERED'").groupBy("key").count().where("count > 1").count() == 0


def test_a_raising_sender_is_a_failure(spark, tmp_path):
    store = claims.Outbox(spark, str(tmp_path / "outbox"))
    rows = spark.createDataFrame([("x", 1)], "key string, n int")
    store.attempt(rows, 0, "2026-01-01 00:00:00", sender(str(tmp_path / "log"), {"x": "raises"}))
    state = store.states().first()
    assert (state.status, state.attempts) == ("PENDING", 1) and state.available_at.timestamp() > 0


def test_windowed_counts(spark, tmp_path):
    rows = [(1, 1000, 0, "queued", None, None), (1, 1500, 1, "claimed", "a", None), (2, 90_000, 2, "queued", None, None)]
    requests(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = queue.windowed_counts(spark.readStream.schema(requests(spark, rows).schema).parquet(f"{tmp_path}/in"))
    stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.window.start.timestamp(), r.kind, r.n) for r in spark.table("windows").collect()) == [(0.0, "claimed", 1), (0.0, "queued", 1), (86_400.0, "queued", 1)]


def test_batch_goes_over_sorted_events(spark):
    rng = random.Random(2)
    kinds = ["queued", "claimed", "claimed", "renewed", "finalised", "released"]
    rows = [(rng.choice([5, 5, 5, *range(40), None]), rng.choice([1_700_000_000 + i * 9, None]) if i % 50 == 0 else 1_700_000_000 + i * 9, i, rng.choice(kinds), rng.choice(["a", "b", None]), rng.randrange(1, 3)) for i in range(3000)]
    df = requests(spark, rows)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # a record's events come in more than one batch
    try:
        log = claims.claims_in_batch(df, 60).localCheckpoint()
        got = {r.record: tuple(r)[1:] for r in claims.states_in_batch(df, 60).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    plan = claims.states_in_batch(df, 60)._jdf.queryExecution().toString()
    assert "FlatMapGroups" not in plan  # no call for each record
    assert log.where("seq >= 0").count() == len(rows)
    for record in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == record), key=lambda r: (r[1] is None, r[1] or 0, r[2]))
        out, state = [], claims.NEW
        counted = 0
        for _, s, _, kind, worker, token in own:
            at = None if s is None else s * claims.MICROS
            state = claims._until(at, state, claims.MAX_ATTEMPTS, out)
            state, good = claims.step(state, kind, at, worker, token, 60 * claims.MICROS, claims.MAX_ATTEMPTS)
            counted += good
        state = claims._until(max(r[1] or 0 for r in rows) * claims.MICROS, state, claims.MAX_ATTEMPTS, out)
        assert got.get(record) == ((*state[:4], counted) if counted else None)
        assert log.where(F.col("record").eqNullSafe(F.lit(record)) & F.col("accepted") & (F.col("kind") != "reaped")).count() == counted


def test_batch_knows_no_time_zone(spark):
    rows = [(1, 1_700_000_000, 0, "queued", None, None), (1, 1_700_000_010, 1, "claimed", "a", None), (2, 1_700_000_300, 2, "queued", None, None)]
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")  # shows moments hours later than UTC
    try:
        got = {r.seq: r.at for r in claims.claims_in_batch(requests(spark, rows)).select("seq", F.unix_seconds("ts").alias("at")).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == {0: 1_700_000_000, 1: 1_700_000_010, 2: 1_700_000_300, claims.REAPED_SEQ: 1_700_000_070}
