"""Size-tiered compaction of immutable shards under versioned manifests.

``append`` writes arrivals as small Parquet shards and commits a manifest that lists them. ``compact`` looks for
runs of at least FANOUT shards of like size (each within a factor of FANOUT of the mean of the smaller ones), merges neighbours
in them into files of about the target size in one Spark job, and commits the next manifest; it repeats until no run is
full. A manifest ``v<number>.json`` is written under a temporary name and renamed without overwriting, so a version
exists whole or not at all and of two writers one must try again. Shards are never changed; those that no manifest
lists any more are removed by ``vacuum``.

A merge streams row batches from its inputs, so its memory is bounded by one batch. No shuffle is needed and no
key matters, so a source that holds a third of all rows is like any other.

Edge cases: rows are kept as they are with nulls, repeats and all columns. An empty arrival adds no shard. An
empty store reads as an empty table of the schema that its reader names, and without one as only the columns shard and tier.
"""

from __future__ import annotations

import json
import math
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codicil.llm.scratch import Scratch

#: Shards of like size that a merge takes, bytes of a finished file, bytes under which all sizes are alike.
FANOUT, TARGET, LEAST = 4, 128 << 20, 64 << 10
#: Most tasks that read footers.
TASKS = 256


@dataclass(frozen=True)
class Entry:
    """A shard in a manifest."""

    path: str
    rows: int
    bytes: int


def tier(size: int) -> int:
    """What is shown of a size: 0 for the smallest shards, and one more for each factor of FANOUT. Merges don't go by it."""
    return max(0, math.floor(math.log(max(size, 1) / LEAST, FANOUT)))


def like_sized(entries: list[Entry]) -> list[list[Entry]]:
    """Shards by size, in runs in which none is more than FANOUT times the mean of those before it.

    Sizes are compared with one another and not with fixed bounds, so shards of about one size are always of one run.
    """
    out: list[list[Entry]] = []
    total = 0
    for e in sorted(entries, key=lambda e: e.bytes):
        size = max(e.bytes, LEAST)
        if not out or size * len(out[-1]) > FANOUT * total:
            out.append([])
            total = 0
        out[-1].append(e)
        total += size
    return out


def runs(entries: list[Entry], target: int) -> list[list[Entry]]:
    """Groups of shards to merge: of each run of at least FANOUT like-sized shards, neighbours up to the target's size."""
    place = {e.path: i for i, e in enumerate(entries)}
    out = []
    for own in like_sized([e for e in entries if e.bytes < target * 3 // 4]):
        if len(own) < FANOUT:
            continue
        group: list[Entry] = []
        for e in sorted(own, key=lambda e: place[e.path]):
            if group and sum(x.bytes for x in group) + e.bytes > target * 5 // 4:
                out.append(group)
                group = []
            group.append(e)
        out.append(group)
    return [g for g in out if len(g) > 1]


class Store:
    """A table kept as shards below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, target: int = TARGET):
        self.spark, self.folder, self.target = spark, folder, target
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(folder).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(folder).toUri(), conf)
        self._fs.mkdirs(self._path(f"{folder}/manifest"))

    def version(self) -> int:
        """Number of the newest manifest, 0 if there is none."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/manifest"))]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> list[Entry]:
        """Shards of a version."""
        version = self.version() if version is None else version
        if not version:
            return []
        text = self.spark.read.text(f"{self.folder}/manifest/v{version}.json", wholetext=True).first()[0]
        return [Entry(**e) for e in json.loads(text)["shards"]]

    def commit(self, entries: list[Entry], after: int) -> int:
        """Make entries the version that follows ``after``; fails if another writer has made one."""
        version = after + 1
        temporary = self._path(f"{self.folder}/manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(temporary, True)
        out.write(bytearray(json.dumps({"version": version, "shards": [asdict(e) for e in entries]}).encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self._context.rename(temporary, self._path(f"{self.folder}/manifest/v{version}.json"), none)
        return version

    def _sizes(self, folder: str) -> list[Entry]:
        """Shards that Spark wrote below folder, with their rows from the files' own footers, which tasks read."""
        store, root = pafs.FileSystem.from_uri(folder)
        found = [(i.path, i.size) for i in store.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)) if i.base_name.endswith(".parquet")]
        if not found:
            return []

        def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, _ = pafs.FileSystem.from_uri(folder)
            for batch in batches:
                rows = [pq.read_metadata(p, filesystem=store).num_rows for p in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.int64()), batch.column(1)], names=["path", "rows", "bytes"])

        files = self.spark.createDataFrame(sorted(found), "path string, bytes long").repartition(min(len(found), TASKS))
        return sorted((Entry(*r) for r in files.mapInArrow(footers, "path string, rows long, bytes long").collect()), key=lambda e: e.path)  # a row a file

    def append(self, arrivals: DataFrame, by: str | None = None) -> int:
        """Write arrivals as shards and commit them; with ``by``, each value of that column is a commit of its own."""
        folder = f"{self.folder}/data/{uuid.uuid4().hex}"
        (arrivals.write.partitionBy(by) if by else arrivals.write).parquet(folder)
        groups: dict[str, list[Entry]] = defaultdict(list)
        for e in self._sizes(folder):
            if e.rows:
                groups[e.path.split("/")[-2] if by else ""].append(e)
        version = self.version()
        entries = self.manifest(version)
        for _, own in sorted(groups.items()):
            entries = entries + own
            version = self.commit(entries, version)
        return version

    def compact(self) -> int:
        """Merge full runs until there are none; the number of the last version."""
        version = self.version()
        entries = self.manifest(version)
        while groups := runs(entries, self.target):
            folder = f"{self.folder}/data"
            plan = [(f"{uuid.uuid4().hex}", [e.path for e in g]) for g in groups]

            def merge(batches: Iterator[pa.RecordBatch], folder: str = folder) -> Iterator[pa.RecordBatch]:
                store, root = pafs.FileSystem.from_uri(folder)
                for batch in batches:
                    for name, paths in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                        path = f"{root}/{name}-{uuid.uuid4().hex[:8]}.parquet"  # a retry writes another file
                        schema, rows, writer = pq.read_schema(paths[0], filesystem=store), 0, None
                        with store.open_output_stream(path) as out:
                            writer = pq.ParquetWriter(out, schema, compression="snappy")
                            for p in paths:
                                with store.open_input_file(p) as f:
                                    for rows_of in pq.ParquetFile(f).iter_batches(4096):
                                        writer.write_batch(rows_of.cast(schema) if rows_of.schema != schema else rows_of, row_group_size=65536)
                                        rows += rows_of.num_rows
                            writer.close()
                        size = store.get_file_info(path).size
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([path]), pa.array([rows], pa.int64()), pa.array([size], pa.int64())], names=["name", "path", "rows", "bytes"])

            # one task a merge: the jobs are laid out by their index, as hashes would put several in one task
            jobs = self.spark.createDataFrame([(i, *p) for i, p in enumerate(plan)], "job int, name string, paths array<string>")
            jobs = jobs.repartitionByRange(len(plan), "job").select("name", "paths")
            done = {r["name"]: Entry(r["path"], r["rows"], r["bytes"]) for r in jobs.mapInArrow(merge, "name string, path string, rows long, bytes long").collect()}  # a row a file
            gone = {e.path: name for (name, _), g in zip(plan, groups, strict=True) for e in g}
            merged, seen = [], set()
            for e in entries:  # a merged file stands where its first input stood
                name = gone.get(e.path)
                if name is None:
                    merged.append(e)
                elif name not in seen:
                    seen.add(name)
                    merged.append(done[name])
            entries = merged
            version = self.commit(entries, version)
        return version

    def vacuum(self) -> int:
        """Remove shards that the newest manifest doesn't list; how many."""
        live = {e.path for e in self.manifest()}
        store, root = pafs.FileSystem.from_uri(f"{self.folder}/data")
        old = [i.path for i in store.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)) if i.base_name.endswith(".parquet") and i.path not in live]
        for p in old:
            store.delete_file(p)
        return len(old)

    def read(self, schema: str | None = None, version: int | None = None) -> DataFrame:
        """Rows of a version, with the number of their shard in it and its tier."""
        entries = self.manifest(version)
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        if not entries:
            return self.spark.createDataFrame([], f"{schema}, shard long, tier int" if schema else "shard long, tier int")
        root = pafs.FileSystem.from_uri(self.folder)[1].rstrip("/")
        names = [("/".join(e.path.split("/")[-2:]), i, tier(e.bytes)) for i, e in enumerate(entries)]
        listed = self.spark.createDataFrame(names, "file string, shard long, tier int")  # a row a file
        rows = reader.parquet(*(self.folder.rstrip("/") + e.path[len(root) :] for e in entries)).withColumn("file", F.substring_index(F.col("_metadata.file_path"), "/", -2))
        return rows.join(F.broadcast(listed), "file").drop("file")


def shard_and_read(docs: DataFrame, arrivals: int = 6, target: int = 32 << 20) -> DataFrame:
    """Append docs in that many arrivals, compact, and return where each row is: doc_id, shard, tier, text_bytes, text_crc32."""
    spark = docs.sparkSession
    with Scratch(spark, "shards") as scratch:
        store = Store(spark, scratch.path("store"), target)
        own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        store.append(own.withColumn("arrival", F.pmod(F.xxhash64("doc_id"), F.lit(arrivals))), by="arrival")
        store.compact()
        store.vacuum()
        rows = store.read("doc_id long, text string")
        raw = F.encode("text", "UTF-8")
        return scratch.result(rows.select("doc_id", "shard", "tier", F.octet_length("text").cast("long").alias("text_bytes"), F.crc32(raw).alias("text_crc32")))
