"""Latest-version views, corrections, numbering and the project card."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkintel.functions.strings import capture_label, sanitize_name, staging_stamp


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that is greatest in the order; partial maxima before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("best"))
    return best.select(*[F.col(c) if c in keys else F.col(f"best.{c}") for c in df.columns])


def effective_corrections(corrections: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """The last correction of each field as a column: keys..., corrected_<field>."""
    last = corrections.groupBy(*keys, "field_path").agg(F.max_by("replacement", "id").alias("replacement"))
    return last.groupBy(*keys).agg(*[F.max(F.when(F.col("field_path") == f, F.col("replacement"))).alias(f"corrected_{f}") for f in fields])


def overlay(cards: DataFrame, corrections: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Cards with their corrected values in place."""
    joined = cards.join(effective_corrections(corrections, keys, fields), keys, "left")
    return joined.select(*[F.coalesce(f"corrected_{c}", c).alias(c) if c in fields else F.col(c) for c in cards.columns])


def supersedes(corrections: DataFrame, keys: list[str]) -> DataFrame:
    """Each correction with the id of the one of its field before it."""
    return corrections.withColumn("supersedes_id", F.lag("id").over(Window.partitionBy(*keys, "field_path").orderBy("id")))


def assign_versions(existing: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """New rows of each key numbered on from its greatest version."""
    top = existing.groupBy(key).agg(F.max("version").alias("top"))
    number = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return new.join(top, key, "left").withColumn("version", F.coalesce("top", F.lit(0)) + number).drop("top")


def seen_bounds(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))


def dedupe_names(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Names made different: the second of one name gets -2, the third -3."""
    number = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return df.withColumn("unique_name", F.when(number == 1, F.col(name)).otherwise(F.concat_ws("-", name, number)))


def capture_names(captures: DataFrame, name: str, started: str, order: list[str]) -> DataFrame:
    """Captures with `capture_name`: an archive's label and when it came, in the order of their coming, with -2, -3 for those of one name."""
    base = F.concat(sanitize_name(capture_label(F.col(name))), F.lit("-"), staging_stamp(F.col(started)))
    return dedupe_names(captures.withColumn("base_name", base), "base_name", order).withColumnRenamed("unique_name", "capture_name").drop("base_name")


def project_cards(repositories: DataFrame, current: DataFrame, findings: DataFrame, snapshots: DataFrame, people: DataFrame) -> DataFrame:
    """One card for each repository: its current finding, latest snapshot, people and state.

    ready: the current finding was enriched; deterministic-only: it was not; not-enriched: there is none.
    """
    finding = current.join(findings.withColumnRenamed("id", "finding_id").drop("repository_id"), "finding_id").select("repository_id", "finding_id", "summary", "provenance")
    latest = latest_by(snapshots.select("repository_id", "captured_at", "id", "owner_login", "owner_type", "stars_count"), ["repository_id"], ["captured_at", "id"])
    names = people.groupBy("repository_id").agg(F.array_sort(F.collect_set("display_name")).alias("names"))
    state = F.when(F.col("finding_id").isNull(), "not-enriched").when(F.col("provenance") == "deterministic", "deterministic-only").otherwise("ready")
    joined = repositories.join(finding, "repository_id", "left").join(latest.drop("id"), "repository_id", "left").join(names, "repository_id", "left")
    return joined.select("repository_id", "identity_key", "summary", "owner_login", "owner_type", "stars_count", F.coalesce(F.array_join("names", ","), F.lit("")).alias("people"), state.alias("status"))


def is_completed(results: DataFrame, key: str, providers: list[str]) -> DataFrame:
    """Keys for which every provider has completed."""
    done = results.where(F.col("provider_status").isin("success", "not_found") & F.col("provider").isin(providers))
    return done.groupBy(key).agg(F.countDistinct("provider").alias("n")).where(F.col("n") == len(providers)).select(key)


def new_units(current: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    return current.select(*keys).distinct().join(known.select(*keys), keys, "left_anti")


def pending_units(current: DataFrame, seen: DataFrame, retry: DataFrame, keys: list[str]) -> DataFrame:
    """What is new, and what is there and to be tried again."""
    there = current.select(*keys).distinct()
    return there.join(seen.select(*keys), keys, "left_anti").union(there.join(retry.select(*keys), keys, "left_semi")).distinct()


def due_lookups(files: DataFrame, lookups: DataFrame, now: Column, ok_days: int | None, fail_hours: int) -> DataFrame:
    """Files to look up again: never tried, or the last completed try is older than its time to live.

    A success lasts ok_days, or for ever if that is None; anything else lasts fail_hours.
    """
    last = lookups.where("completed_at IS NOT NULL").groupBy("file_id", "provider").agg(F.max_by(F.struct("status", "completed_at"), F.struct("completed_at", "id")).alias("last"))
    until = F.when(F.col("last.status") == "success", (F.col("last.completed_at") + F.make_dt_interval(F.lit(ok_days))) if ok_days is not None else F.to_timestamp(F.lit("9999-12-31"))).otherwise(F.col("last.completed_at") + F.make_dt_interval(F.lit(0), F.lit(fail_hours)))
    return files.join(last, ["file_id", "provider"], "left").where(F.col("last").isNull() | (until <= now)).select("file_id", "provider")
