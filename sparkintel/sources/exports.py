"""Exports: JSON, guarded CSV, their manifest, and versions of tables that are published as one."""

from __future__ import annotations

import json
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from sparkintel.functions.strings import csv_safe


def export_json(tables: dict[str, DataFrame], folder: str, version: int = 1) -> None:
    """Each table as JSON lines, every line with the version of the format."""
    for name, df in tables.items():
        df.select(F.lit(version).alias("schema_version"), F.struct(*df.columns).alias(name)).write.mode("overwrite").json(f"{folder}/{name}")


def csv_ready(df: DataFrame) -> DataFrame:
    """All columns as guarded text, nested ones as JSON."""
    nested = lambda f: isinstance(f.dataType, ArrayType | MapType | StructType)
    return df.select(*[csv_safe(F.to_json(f.name) if nested(f) else F.col(f.name).cast("string")).alias(f.name) for f in df.schema.fields])


def export_csv(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        csv_ready(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{folder}/{name}")


def export_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """name, sha256 and bytes of every file written below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share, below spark.checkpoint.dir; a temporary one only where all runs on this machine."""
    named, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not named and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    named = named or tempfile.mkdtemp(prefix="spark-")
    return f"{named.rstrip('/')}/scratch-{uuid.uuid4().hex[:12]}"


def written_once(df: DataFrame) -> DataFrame:
    """The same rows, written and read again, for what several tables are made of: it is computed once, and its plan ends there."""
    folder = scratch(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


class Conflict(Exception):
    """Another version was published since the one that this one builds on."""


def _path(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, root: str) -> int:
    """The number of the last version that was published below root, 0 if there is none."""
    path, fs = _path(spark, f"{root}/versions")
    names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
    return max((int(n) for n in names if n.isdigit()), default=0)


def describe_version(spark: SparkSession, root: str, number: int | None = None) -> dict:
    """What was published with a version (the last): `folder` and the writer's own facts."""
    number = current_version(spark, root) if number is None else number
    if not number:
        raise LookupError(f"nothing is published below {root}")
    return json.loads(spark.read.text(f"{root}/versions/{number:010d}", wholetext=True).first()[0])


def publish(spark: SparkSession, root: str, folder: str, after: int, facts: dict | None = None) -> int:
    """Names a written folder as the version after `after`.

    The entry is written under another name and then renamed, which fails where its number is taken. So of
    two writers one gets Conflict, and readers, who take the greatest number, see the version before or
    all of this one. Nothing is ever replaced, so that readers of older versions go on.
    """
    context, number = spark.sparkContext._jvm.org.apache.hadoop.fs, after + 1
    if current_version(spark, root) != after:
        raise Conflict(f"version {number} is there already")
    made, fs = _path(spark, f"{root}/versions/.{uuid.uuid4().hex}")
    out = fs.create(made, False)
    out.write(bytearray(json.dumps({"folder": folder, **(facts or {})}, sort_keys=True).encode()))
    out.close()
    target, _ = _path(spark, f"{root}/versions/{number:010d}")
    files = context.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        files.rename(made, target, spark.sparkContext._gateway.new_array(context.Options.Rename, 0))
    except (Py4JJavaError, PySparkException) as error:
        fs.delete(made, False)
        if "FileAlreadyExists" in str(error):
            raise Conflict(f"version {number} is there already") from None
        raise
    return number


def remove(spark: SparkSession, folder: str) -> None:
    """Takes away a folder that was not published."""
    path, fs = _path(spark, folder)
    fs.delete(path, True)


def write_version(spark: SparkSession, root: str, tables: dict[str, DataFrame], dry_run: bool = False, after: int | None = None, facts: dict | None = None) -> dict[str, int]:
    """Writes all tables and then publishes them as one version; rows by table. A dry run only counts.

    after: the version that the tables build on, by default the last. What fails before the end publishes
    nothing and leaves nothing.
    """
    if dry_run:
        return {name: df.count() for name, df in tables.items()}
    after = current_version(spark, root) if after is None else after
    folder = f"{root}/data/{uuid.uuid4().hex}"
    try:
        for name, df in tables.items():
            df.write.parquet(f"{folder}/{name}")
        counts = {name: spark.read.schema(df.schema).parquet(f"{folder}/{name}").count() for name, df in tables.items()}
        publish(spark, root, folder, after, {"rows": counts, **(facts or {})})
    except BaseException:
        remove(spark, folder)
        raise
    return counts


def read_version(spark: SparkSession, root: str, name: str, number: int | None = None) -> DataFrame:
    """A table of a version, by default the last."""
    return spark.read.parquet(f"{describe_version(spark, root, number)['folder']}/{name}")
