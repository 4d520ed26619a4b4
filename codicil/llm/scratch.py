"""Working tables in the folder that driver and executors share.

Lineage is cut by writing a table under ``spark.checkpoint.dir`` and reading it back, so a lost
executor costs a re-read and not a recomputation. The setting is read from the session; only where
it is unset (local tests) does this module choose a folder of its own.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Rows of a batch that Spark hands to Python where the session has no setting of its own; texts are long, so Spark's default is much.
BATCH_ROWS = 1024


def qualified(spark: SparkSession, path: str) -> str:
    """Full URI of ``path``, resolved by Hadoop's configuration on the driver."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(hadoop).makeQualified(p).toString()
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only for local masters."""
    path = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not path:
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            if spark.sparkContext.master.startswith("local"):
                _OWN[app] = tempfile.mkdtemp(prefix="codicil-")
            else:
                _OWN[app] = spark.conf.get("spark.sql.warehouse.dir") + "/_codicil"
        path = _OWN[app]
    return qualified(spark, path)


def small_batches(spark: SparkSession) -> None:
    """Bound the rows that a Python worker and its executor hold at once, unless the session says how many."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) == 10_000:
        spark.conf.set(name, BATCH_ROWS)


def delete(spark: SparkSession, path: str) -> None:
    """Remove ``path`` and everything below it, on whatever store holds it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """A set of working tables that live until ``close`` or the end of the ``with`` block."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        small_batches(spark)
        self.root = f"{shared_dir(spark)}/codicil/{name}-{uuid.uuid4().hex[:12]}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *exc: object) -> None:
        self.close()

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and read it back with the same schema."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        delete(self.spark, self.path(name))

    def result(self, df: DataFrame) -> DataFrame:
        """Write a (small) result beside the working tables, so that these can go.

        The result stays until the driver's interpreter ends.
        """
        lasting = Scratch(self.spark, "result")
        lasting.close_at_exit()
        return lasting.save(df, "rows")

    def close_at_exit(self) -> None:
        """Keep the tables until the driver's interpreter ends."""

        def clean() -> None:
            with contextlib.suppress(Exception):
                self.close()

        atexit.register(clean)

    def close(self) -> None:
        delete(self.spark, self.root)
