"""Working tables below the folder that driver and executors share.

The folder is ``spark.checkpoint.dir``; only where the session has none it is one of the package's own. Tables cut
lineage: what a lost executor held is read again and not computed again.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a side that is broadcast.
BROADCAST_ROWS = 500_000
_OWN: dict[str, str] = {}


def few(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """rows, broadcast where they were counted and are at most this many; else they are joined by a shuffle."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def shared_folder(spark: SparkSession) -> str:
    """URI of the shared folder."""
    path = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not path:
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            local = spark.sparkContext.master.startswith("local")
            _OWN[app] = tempfile.mkdtemp(prefix="codicil-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/_codicil"
        path = _OWN[app]
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


class Tables:
    """Named tables that stay until ``close`` or the end of the driver's interpreter."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/codicil/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._quietly)

    def save(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Write df as Parquet, sorted by a column within its files where one is named, and read it back."""
        (df.sortWithinPartitions(by) if by else df).write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def close(self) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def _quietly(self) -> None:
        with contextlib.suppress(Exception):
            self.close()
