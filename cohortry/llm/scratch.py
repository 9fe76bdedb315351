"""Intermediate tables in the folder that the cluster shares.

Tables are written as Parquet below ``spark.checkpoint.dir`` and read again: that cuts lineage, and the
files outlive any executor.  Only where the setting is absent (tests, notebooks) is a folder chosen here.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables whose rows were counted before have a partition for so many rows, and so many partitions at least.
PART_ROWS, LEAST_PARTS = 2000, 12


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; an own temporary one only if the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="cohortry-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """A folder of intermediate tables for one run of an operator."""

    def __init__(self, spark: SparkSession, label: str):
        # what a finished job shuffled is never read again: later steps start from the written tables
        spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
        # rows with whole texts or sets: few to a batch, so that Python workers stay small
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
        self.spark, self.root = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def parts(self, rows: int) -> int:
        """Partitions that so many rows need."""
        return max(LEAST_PARTS, -(-rows // PART_ROWS))

    def keep(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """Write the table once and go on from the files; rows: about how many it takes in, where so few need no more tasks."""
        if rows is not None:
            df = df.coalesce(self.parts(rows))
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        """Delete one table, or all of them, once nothing reads them any more."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
