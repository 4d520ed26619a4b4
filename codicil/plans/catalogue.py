"""All queries and the SQL that checks them, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codicil.plans import cases, corpus, loads, queues, records, search


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(search.QUERIES) | corpus.QUERIES | queues.QUERIES | records.QUERIES | cases.QUERIES | loads.QUERIES


def oracle_sql() -> dict[str, str]:
    return dict(search.ORACLES) | corpus.ORACLES | queues.ORACLES | records.ORACLES | cases.ORACLES | loads.ORACLES
