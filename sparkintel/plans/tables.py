"""The inputs of the registered queries, derived from the given tables by columns alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages as one corpus of files: path, text."""
    docs = read(spark, sf_dir, "documents").select(F.concat(F.lit("documents/"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    pages = read(spark, sf_dir, "pages").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string")).alias("path"), F.coalesce("html", F.lit("")).alias("text"))
    return docs.union(pages)


def event_ips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An address for each event: event_id, user_id, event_type, ts, ip."""
    octets = [1 + F.col("user_id") % 223, F.col("event_id") % 7, F.col("user_id") % 251, 1 + F.col("event_id") % 5]
    return read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", F.concat_ws(".", *[o.cast("string") for o in octets]).alias("ip"))


def repository_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four spellings of a repository address for each document: doc_id, url."""
    owner, name = F.concat(F.lit("Owner"), F.col("source")), F.concat(F.lit("repo-"), (F.col("doc_id") % 50).cast("string"))
    kind = F.col("doc_id") % 5
    url = (
        F.when(kind == 0, F.concat(F.lit("https://github.com/"), owner, F.lit("/"), name, F.lit(".git")))
        .when(kind == 1, F.concat(F.lit("git@github.com:"), owner, F.lit("/"), name))
        .when(kind == 2, F.concat(F.lit("ssh://git@github.com:22/"), owner, F.lit("/"), name, F.lit(".git")))
        .when(kind == 3, F.concat(F.lit("github.com/"), owner, F.lit("/"), name, F.lit("/")))
        .otherwise(F.concat(F.lit("https://github.com/"), owner, F.lit("/"), name, F.lit("/issues")))
    )
    return read(spark, sf_dir, "documents").select("doc_id", url.alias("url"))
