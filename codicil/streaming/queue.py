"""Queue replay and windowed counts on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codicil.config import LEASE_SECONDS

OUTPUT = "record long, state string, token long, stale long"
STATE = "state string, token long, stale long, lease_end double"


def replayed(log: DataFrame, lease_seconds: int = LEASE_SECONDS) -> DataFrame:
    """State of each record after each micro-batch of log (record, seq, ts, kind).

    One state per record with its token and lease, so a claim has one winner however many ask; an event of an
    older token or after the lease's end is counted as stale. Events of a batch are taken in order.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kind, token, stale, end = state.get if state.exists else (None, 0, 0, -1.0)
        rows = pd.concat(list(frames)).sort_values(["ts", "seq"])
        for event, at in zip(rows["kind"], rows["ts"].astype("datetime64[us]").astype("int64") / 1e6, strict=True):
            if event == "claimed":
                kind, token, end = event, token + 1, at + lease_seconds
            elif event == "queued":
                kind = event
            elif token and at < end:
                kind, end = event, at + lease_seconds if event == "renewed" else -1.0
            else:
                stale += 1
        state.update((kind, token, stale, end))
        yield pd.DataFrame({"record": [key[0]], "state": [kind], "token": [token], "stale": [stale]})

    return log.groupBy("record").applyInPandasWithState(step, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def windowed_counts(log: DataFrame, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Events of each kind by event-time window, with a watermark that drops later ones (an addition of this engine)."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", width), "kind").agg(F.count(F.lit(1)).alias("n"))
