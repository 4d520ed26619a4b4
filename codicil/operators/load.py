"""Loads as transactions: status rows, quality gate, staging, manifest, and snapshots of which one is current.

A :class:`Corpus` is a folder with an append-only table of run states, staged files, manifests and snapshots. A run stages its sections
through a committed write, derives the version from the canonical manifest, writes the next snapshot, and makes it current by one renamed
file; whatever fails before that leaves the snapshot before it current and the run marked as failed.
"""

from __future__ import annotations

import json
from datetime import date, timedelta

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codicil.operators import ingest
from codicil.sources import staged
from codicil.sources.working import Tables

RUNNING, SUCCEEDED, FAILED = "RUNNING", "SUCCEEDED", "FAILED"
RUNS = "run_id string, step int, status string, at timestamp, params string, counts string, dataset_version string, watermark date, error string"
SNAPSHOT = "document_number string, version int, content_hash string, status string, dataset_version string"
SECTIONS = "document_number string, section_ref string, heading string, text string, position int"
ERROR_CHARS = 240


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


class Corpus:
    """Runs and snapshots below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.tables = Tables(spark, "load")

    def runs(self) -> DataFrame:
        """The last state of each run."""
        log = self.log()
        last = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("step")))
        return log.withColumn("_nth", last).where("_nth = 1").drop("_nth")

    def log(self) -> DataFrame:
        store, root = pafs.FileSystem.from_uri(self.folder)
        if store.get_file_info(f"{root}/runs").type == pafs.FileType.NotFound:
            return self.spark.createDataFrame([], RUNS)
        return self.spark.read.schema(RUNS).parquet(f"{self.folder}/runs")

    def _mark(self, run: str, step: int, status: str, params: dict, counts: dict, version: str | None = None, watermark: date | None = None, error: str | None = None) -> None:
        row = self.spark.createDataFrame([(run, step, status, None, canonical(params), canonical(counts), version, watermark, error[:ERROR_CHARS] if error else None)], RUNS)
        row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.folder}/runs")

    def head(self) -> int:
        """Number of the current snapshot, 0 if there is none."""
        store, root = pafs.FileSystem.from_uri(self.folder)
        found = store.get_file_info(pafs.FileSelector(f"{root}/heads", allow_not_found=True))
        return max((int(i.base_name[:-5]) for i in found if i.base_name.endswith(".json")), default=0)

    def current(self) -> DataFrame:
        """(document_number, version, content_hash, status, dataset_version) of the current snapshot."""
        head = self.head()
        if not head:
            return self.spark.createDataFrame([], SNAPSHOT)
        return self.spark.read.schema(SNAPSHOT).parquet(f"{self.folder}/snapshots/{head}")

    def watermark(self) -> date | None:
        """Last day that a successful run covered."""
        return self.log().where(F.col("status") == SUCCEEDED).agg(F.max_by("watermark", "at")).first()[0]

    def run(self, run: str, documents: DataFrame, sections: DataFrame, since: date, until: date, query: dict[str, str], source: str, incremental: bool = False, code: str | None = None) -> str:
        """Load the documents of a window; the run's status.

        documents: document_number, title, document_type, publication_date, parse_error, source_xml_sha256, n_residual; sections: document_number,
        section_ref, heading, text, position. Incremental runs begin a day after the last successful run's watermark.
        """
        last = self.watermark() if incremental else None
        if last is not None and last >= since:
            since = last + timedelta(days=1)
        params = {**query, "since": since.isoformat(), "until": until.isoformat(), "incremental": incremental}
        self._mark(run, 0, RUNNING, params, {"documents": 0})
        if since > until:
            self._mark(run, 1, SUCCEEDED, params, {"documents": 0, "inserted": 0})
            return SUCCEEDED
        try:
            counts, version, reached, blocked = self._load(run, documents, sections, since, until, params, source, code)
        except Exception as e:
            self._mark(run, 1, FAILED, params, {"documents": 0}, error=str(e))
            raise
        if blocked:
            self._mark(run, 1, FAILED, params, counts, error=", ".join(blocked.split(",")))
            return FAILED
        self._mark(run, 1, SUCCEEDED, params, counts, version, reached)
        return SUCCEEDED

    def _load(self, run: str, documents: DataFrame, sections: DataFrame, since: date, until: date, params: dict, source: str, code: str | None) -> tuple[dict, str | None, date | None, str]:
        inside = F.col("publication_date").isNull() | F.col("publication_date").between(F.lit(since), F.lit(until))
        chunks = sections.select(*(c.split()[0] for c in SECTIONS.split(", ")))
        hashes = ingest.content_hash(chunks.withColumnRenamed("document_number", "doc"))
        rows = documents.where(inside).join(hashes.withColumnRenamed("doc", "document_number"), "document_number", "left")
        rows = self.tables.save(rows.withColumn("n_chunks", F.coalesce("sections", F.lit(0))), f"{run}-documents")
        report = ingest.gate(rows).first()
        counts = {"documents": report["documents"], "parse_failures": report["parse_failures"], "inserted": 0, "unchanged": 0, "sections": 0}
        if report["blocking"]:
            return counts, None, None, report["reasons"]
        good = self.tables.save(ingest.passed(rows).select("document_number", "document_type", "publication_date", "content_sha256", "source_xml_sha256", F.col("sections").alias("section_count")), f"{run}-good")
        own = chunks.join(good.select("document_number"), "document_number", "left_semi").repartitionByRange("document_number", "position").sortWithinPartitions("document_number", "position")
        files = staged.stage(own, self.folder, run)
        version = self.manifest(run, good, params, files, source, code)
        head, before = self.head(), self.current()
        incoming = good.select("document_number", F.col("content_sha256").alias("content_hash"), ingest.status_for(F.col("document_type")).alias("status"))
        after = ingest.versioned_load(before.select("document_number", "version", "content_hash", "status"), incoming)
        known = before.select("document_number", "version", F.col("dataset_version").alias("_old"))
        after = after.join(known, ["document_number", "version"], "left").withColumn("dataset_version", F.coalesce("_old", F.lit(version))).drop("_old")
        after.select(*(c.split()[0] for c in SNAPSHOT.split(", "))).write.mode("overwrite").parquet(f"{self.folder}/snapshots/{head + 1}")
        written = self.spark.read.schema(SNAPSHOT).parquet(f"{self.folder}/snapshots/{head + 1}")
        new = written.join(before.select("document_number", "version"), ["document_number", "version"], "left_anti").join(good.select("document_number", "section_count"), "document_number")
        sums = new.agg(F.count(F.lit(1)).alias("inserted"), F.coalesce(F.sum("section_count"), F.lit(0)).alias("sections")).first()
        total = good.agg(F.count(F.lit(1)).alias("n"), F.max("publication_date").alias("last")).first()
        counts |= {"inserted": sums["inserted"], "unchanged": total["n"] - sums["inserted"], "sections": sums["sections"]}
        # the load becomes visible here, whole; of two runs that began from one snapshot the later one fails
        staged.write_once(self.folder, f"heads/{head + 1}.json", canonical({"run": run, "dataset_version": version}).encode())
        return counts, version, total["last"], ""

    def manifest(self, run: str, good: DataFrame, params: dict, files: list[dict], source: str, code: str | None) -> str:
        """Version of a load: the first digits of its canonical manifest's hash. Documents are lines in their order, written by all tasks."""
        member = F.struct("content_sha256", "document_number", F.col("section_count").cast("long").alias("section_count"), "source_xml_sha256")
        ordered = good.repartitionByRange("document_number").sortWithinPartitions("document_number")
        first = good.agg(F.min("document_number")).first()[0]
        comma = F.when(F.col("document_number") == F.lit(first), "").otherwise(",")
        lines = ordered.select(F.concat(comma, F.to_json(member, {"ignoreNullFields": "false"})).alias("value"))
        sums = good.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("section_count"), F.lit(0)).alias("s")).first()
        listed = [{"path": f["path"], "sha256": f["sha256"]} for f in files]
        rest = {"files": listed, "git_sha": code, "query": params, "section_count": int(sums["s"]), "source": source}
        head, tail = f'{{"document_count":{sums["n"]},"documents":[', "]," + canonical(rest)[1:]
        version = staged.streamed_hash(lines, f"{self.folder}/manifests", run, head, tail)[:12]
        staged.write_once(self.folder, f"manifests/{run}.json", canonical({"head": head, "lines": run, "tail": tail, "dataset_version": version}).encode())
        return version
