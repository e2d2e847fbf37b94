"""Indicator observations: per file and capture, singular files, caps, evidence and traversal order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def traversal_key(path: Column) -> Column:
    """Orders paths as a walk does: a directory's files before its subdirectories, names by code point."""
    parts = F.split(path, "/")
    return F.transform(parts, lambda name, n: F.struct((n < F.size(parts) - 1).alias("is_dir"), name.alias("name")))


def singular_files(obs: DataFrame, file_cols: list[str], value: str, threshold: int = 20) -> DataFrame:
    """Files with more distinct values than the threshold: file columns, distinct_at_least."""
    counted = obs.groupBy(*file_cols).agg(F.countDistinct(value).alias("n"))
    return counted.where(F.col("n") > threshold).select(*file_cols, F.lit(threshold + 1).alias("distinct_at_least"))


def without_singular(obs: DataFrame, file_cols: list[str], value: str, threshold: int = 20) -> DataFrame:
    """Observations of the other files."""
    return obs.join(singular_files(obs, file_cols, value, threshold), file_cols, "left_anti")


def cap_observations(obs: DataFrame, capture: str, order: list[Column], cap: int) -> DataFrame:
    """The first `cap` observations of each capture, with `truncated` for captures that reach it.

    Numbers run inside hash slices of a capture's range only where Spark can keep the order: one window
    by capture, over observations that are already distinct.
    """
    numbered = obs.withColumn("ordinal", F.row_number().over(Window.partitionBy(capture).orderBy(*order)))
    kept = numbered.where(F.col("ordinal") <= cap)
    full = kept.groupBy(capture).agg((F.max("ordinal") >= cap).alias("truncated"))
    return kept.join(full, capture)


def evidence_paths(obs: DataFrame, keys: list[str], path: str = "path") -> DataFrame:
    """Sorted distinct source paths of each indicator, their number and the first."""
    paths = F.sort_array(F.collect_set(path))
    return obs.groupBy(*keys).agg(paths.alias("paths")).select(*keys, F.size("paths").cast("long").alias("n_paths"), F.element_at("paths", 1).alias("first_path"), F.array_join("paths", ",").alias("paths"))


def repo_observations(tokens: DataFrame, file_cols: list[str]) -> DataFrame:
    """Occurrences of each repository in each file: count, first offset, and the last spelling."""
    return tokens.groupBy(*file_cols, "identity_key").agg(
        F.count(F.lit(1)).alias("occurrence_count"), F.min("offset").alias("first_offset"), F.max_by("spelling", "offset").alias("spelling")
    )


def dedupe_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the last in the order."""
    rest = [c for c in df.columns if c not in keys]
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last"))
    return last.select(*[F.col(c) if c in keys else F.col(f"last.{c}") for c in df.columns])
