"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where none is set and all runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder as a URI of the file system that Spark itself resolves it against, for other readers and writers of it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    named = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"file://{named.removeprefix('file:')}" if named.startswith("file:/") and not named.startswith("file://") else named


class Staged:
    """Written tables of one operator run: each cuts the lineage and survives lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.written = 0

    def write(self, df: DataFrame, *partition_by: str) -> DataFrame:
        """The rows of df, written once and read again."""
        path = self.folder()
        df.write.partitionBy(*partition_by).parquet(path)
        fields = [f for f in df.schema.fields if f.name not in partition_by]
        fields += [df.schema[name] for name in partition_by]
        return self.spark.read.schema(type(df.schema)(fields)).parquet(path)

    def write_counted(self, df: DataFrame, what: Column) -> tuple[DataFrame, int]:
        """The rows of df, written once, and for how many of them `what` holds, without another job."""
        seen = Observation()
        written = self.write(df.observe(seen, F.count_if(what).alias("n")))
        return written, seen.get["n"]

    def folder(self) -> str:
        self.written += 1
        return f"{self.root}/{self.written:04d}"

    def drop(self, number: int, part: str = "") -> None:
        """Removes the table (or a partition) that was written as that number from 1, once nothing reads it."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{number:04d}/{part}".rstrip("/"))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows at most for what runs inside, whose rows hold whole texts or sets: JVM and Python worker each hold a batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
