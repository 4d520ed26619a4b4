"""Staged JSON lines as a Spark data source whose writes are visible whole or not at all.

``df.write.format("staged_lines").mode("append").option("path", folder).option("run", name).save()``: every task writes a file of its own, and
only the commit, one small file that is renamed into place, lists them with their rows and hashes. What a killed or repeated task left is
listed nowhere; an aborted write removes its files. A run is committed once.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "staged_lines"


@dataclass
class Part(WriterCommitMessage):
    """A task's file: its place below the folder, rows and SHA-256."""

    path: str
    rows: int
    sha256: str


def _plain(value: object) -> object:
    """A value as JSON has it."""
    if isinstance(value, Row):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return value.isoformat() if isinstance(value, (date, datetime)) else value


def write_once(folder: str, path: str, data: bytes) -> None:
    """A file that appears whole; fails if it is there already."""
    store, root = pafs.FileSystem.from_uri(folder)
    target, temporary = f"{root}/{path}", f"{root}/{path}.{uuid.uuid4().hex}"
    store.create_dir(target.rpartition("/")[0], recursive=True)
    if store.get_file_info(target).type != pafs.FileType.NotFound:
        raise ValueError(f"{path} is there already")
    with store.open_output_stream(temporary) as f:
        f.write(data)
    store.move(temporary, target)


class StagedWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.folder, self.run = options["path"], options["run"]

    def write(self, iterator: Iterator[Row]) -> Part:
        store, root = pafs.FileSystem.from_uri(self.folder)
        path = f"staging/{self.run}/{uuid.uuid4().hex}.jsonl"
        store.create_dir(f"{root}/staging/{self.run}", recursive=True)
        rows, digest = 0, hashlib.sha256()
        with store.open_output_stream(f"{root}/{path}") as f:
            for row in iterator:
                line = (json.dumps(_plain(row), ensure_ascii=False) + "\n").encode()
                f.write(line)
                digest.update(line)
                rows += 1
        return Part(path, rows, digest.hexdigest())

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m and m.rows), key=lambda m: m.path)
        body = {"run": self.run, "files": [{"path": m.path, "rows": m.rows, "sha256": m.sha256} for m in parts]}
        write_once(self.folder, f"commits/{self.run}.json", json.dumps(body).encode())

    def abort(self, messages: list[Part | None]) -> None:
        store, root = pafs.FileSystem.from_uri(self.folder)
        for m in messages:
            if m:
                store.delete_file(f"{root}/{m.path}")


class StagedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "value string"

    def writer(self, schema: object, overwrite: bool) -> StagedWriter:
        return StagedWriter(dict(self.options))


def stage(rows: DataFrame, folder: str, run: str) -> list[dict]:
    """Write rows as a run; its files (path, rows, sha256)."""
    rows.sparkSession.dataSource.register(StagedLines)
    rows.write.format(FORMAT).mode("append").option("path", folder).option("run", run).save()
    return committed(folder, run)


def committed(folder: str, run: str) -> list[dict]:
    """Files of a run, none if it was not committed."""
    store, root = pafs.FileSystem.from_uri(folder)
    path = f"{root}/commits/{run}.json"
    if store.get_file_info(path).type == pafs.FileType.NotFound:
        return []
    with store.open_input_file(path) as f:
        return json.loads(f.read())["files"]


def staged(spark: SparkSession, folder: str, run: str, schema: str) -> DataFrame:
    """Rows of a run as a table; empty if it was not committed."""
    files = committed(folder, run)
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json([f"{folder}/{f['path']}" for f in files])


def streamed_hash(lines: DataFrame, folder: str, name: str, head: str, tail: str) -> str:
    """SHA-256 of head, all lines (value: text without line ends, but with its separator) in their order, and tail.

    Lines are written by all tasks in order; one task then reads them as a stream, so it holds a block and not the whole text.
    """
    target = f"{folder}/{name}"
    lines.write.mode("overwrite").text(target)

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        for _ in frames:
            store, root = pafs.FileSystem.from_uri(target)
            digest = hashlib.sha256(head.encode())
            for info in sorted(store.get_file_info(pafs.FileSelector(root)), key=lambda i: i.base_name):
                if info.base_name.startswith("part-"):
                    with store.open_input_stream(info.path) as f:
                        while block := f.read(1 << 20):
                            digest.update(block.replace(b"\n", b""))
            digest.update(tail.encode())
            yield pd.DataFrame({"sha256": [digest.hexdigest()]})

    return lines.sparkSession.range(1).select(F.col("id")).coalesce(1).mapInPandas(run, "sha256 string").first()["sha256"]
