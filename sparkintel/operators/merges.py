"""Snapshot merges that give the same table whatever the number of partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkintel.functions.strings import normalize_hash


def ranked_verdict(c: Column, order: list[str]) -> Column:
    """Rank of a verdict, the first of the order being the greatest; 0 for anything else."""
    return F.coalesce(F.array_position(F.array(*[F.lit(v) for v in reversed(order)]), c), F.lit(0))


def max_verdict(c: Column, order: list[str]) -> Column:
    """Aggregate: the greatest verdict of the order, null if there is none."""
    rank = F.max(ranked_verdict(c, order))
    return F.when(rank > 0, F.element_at(F.array(*[F.lit(v) for v in reversed(order)]), F.when(rank > 0, rank).cast("int")))


def timestamp_key(c: Column) -> Column:
    """Orders ISO timestamps by instant, and whatever is none below them by text."""
    at = F.try_to_timestamp(c)
    return F.struct(at.isNotNull().alias("valid"), at.alias("at"), F.when(at.isNull(), c).alias("text"))


def earliest(c: Column) -> Column:
    return F.min_by(c, timestamp_key(c))


def latest(c: Column) -> Column:
    return F.max_by(c, timestamp_key(c))


def merge_ip_snapshots(rows: DataFrame, scalars: tuple[str, ...] = ("country_code",)) -> DataFrame:
    """Entities after their snapshots in order of import: ip, scalars..., malicious, first_seen, last_updated, n_snapshots.

    A row that is newer than all before it gives its values where it has any, an older one only fills
    blanks. So a value is that of the last row that was newer and had one, else the first that there was.
    Verdicts take the greatest, first_seen the least, last_updated the greatest.
    """
    before = F.max("last_updated").over(Window.partitionBy("ip").orderBy("import_seq").rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("newer", F.col("last_updated").isNotNull() & (before.isNull() | (F.col("last_updated") > before)))
    blank = lambda c: F.nullif(c, F.lit(""))

    def held(c: str) -> Column:
        there = blank(F.col(c)).isNotNull()
        last = F.max_by(c, F.when(F.col("newer") & there, F.col("import_seq")))
        return F.coalesce(F.when(F.count_if(F.col("newer") & there) > 0, last), F.min_by(c, F.when(there, F.col("import_seq")))).alias(c)

    return marked.groupBy("ip").agg(
        *[held(c) for c in scalars], max_verdict(F.col("malicious"), ["Yes", "No"]).alias("malicious"), F.min("first_seen").alias("first_seen"), F.max("last_updated").alias("last_updated"), F.count(F.lit(1)).alias("n_snapshots")
    )


def union_ignore(dst: DataFrame, src: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of dst, and those of src whose key is not there yet (one for each key); null keys are equal."""
    same = F.lit(True)
    there = dst.select(*[F.col(k).alias(f"there_{k}") for k in keys])
    for k in keys:
        same = same & src[k].eqNullSafe(F.col(f"there_{k}"))
    fresh = src.join(there, same, "left_anti")
    rest = [c for c in dst.columns if c not in keys]
    if not rest:
        return dst.union(fresh.select(*keys).distinct())
    one = fresh.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("one"))
    return dst.unionByName(one.select(*keys, "one.*").select(*dst.columns))


def add_versions(dst: DataFrame, src: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Snapshots or source versions of both, one for each key: what is there stays, of new ones the first in the order."""
    rest = [c for c in dst.columns if c not in keys]
    first = src.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("one")).select(*keys, "one.*")
    return union_ignore(dst, first.select(*dst.columns), keys)


def merge_first_seen(dst: DataFrame, src: DataFrame, keys: list[str]) -> DataFrame:
    """Set rows of both sides, each with its earliest first_seen."""
    return dst.unionByName(src).groupBy(*keys).agg(F.min("first_seen").alias("first_seen"))


#: The states of a watched directory, from the least.
WATCH_STATES = ["failed", "new", "scanning", "scanned"]


def merge_watch(dst: DataFrame, src: DataFrame, keys: list[str]) -> DataFrame:
    """Watched directories of both; the source's state wins only if it is strictly higher."""
    rank = lambda c: F.array_position(F.array(*[F.lit(s) for s in WATCH_STATES]), c)
    a, b = dst.select(*keys, F.col("status").alias("old")), src.select(*keys, F.col("status").alias("new"))
    joined = a.join(b, keys, "full_outer")
    higher = F.col("old").isNull() | (rank(F.col("new")) > rank(F.col("old")))
    return joined.select(*keys, F.when(F.coalesce(higher, F.lit(False)), F.col("new")).otherwise(F.col("old")).alias("status"), F.coalesce(F.col("old") != F.col("new"), F.lit(False)).alias("conflict"))


def current_findings(rows: DataFrame) -> DataFrame:
    """Pointer of each repository: the finding of the greatest created_at; of equals the destination's.

    rows: repository_id, finding_id, created_at, is_dst.
    """
    return rows.groupBy("repository_id").agg(F.max_by("finding_id", F.struct("created_at", "is_dst", "finding_id")).alias("finding_id"))


def complete_findings(findings: DataFrame, evidence: DataFrame, versions: DataFrame) -> DataFrame:
    """Findings all of whose evidence cites a source version that is there."""
    broken = evidence.join(versions.select("source_version_id"), "source_version_id", "left_anti").select("finding_id").distinct()
    return findings.join(broken, "finding_id", "left_anti")


def not_imported(snapshots: DataFrame, ledger: DataFrame) -> DataFrame:
    return snapshots.join(ledger.select("source_sha256"), "source_sha256", "left_anti")


def prune_placeholders(files: DataFrame, observations: DataFrame, tags: DataFrame, names: DataFrame) -> DataFrame:
    """Files without those that are unknown, without magic, and have no observation, tag or name."""
    held = observations.select("file_id").union(tags.select("file_id")).union(names.select("file_id")).distinct().withColumn("held", F.lit(True))
    return files.join(held, "file_id", "left").where((F.col("malicious") != "unknown") | F.col("magic").isNotNull() | F.col("held")).drop("held")


class HashConflict(ValueError):
    """A provider's SHA-256 of a file is not the file's own."""


def apply_file_results(files: DataFrame, results: DataFrame, tags: DataFrame, names: DataFrame, at: Column) -> dict[str, DataFrame]:
    """files, tags and names after provider results: what files have stays, blanks are filled, verdicts rise, children are added where they are new.

    files: file_id, sha256, md5, magic, malicious, updated_at; results: file_id, seq, provider, sha256, md5,
    magic, malicious, tags, names (arrays); tags (file_id, tag, source, first_seen) and names (file_id,
    name, source, first_seen). The first result by `seq` that has a value fills it. A result for no file, or
    with another SHA-256 than its file's (or an earlier result's), refuses the whole batch.
    """
    order = ["yes", "no", "unknown"]
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    sha, md5 = normalize_hash(F.col("sha256")), normalize_hash(F.col("md5"))
    clean = results.select("file_id", "seq", "provider", sha.alias("sha256"), md5.alias("md5"), blank("magic").alias("magic"), "malicious", "tags", "names")
    told = clean.groupBy("file_id").agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"new_{c}") for c in ("sha256", "md5", "magic")], max_verdict(F.col("malicious"), order).alias("new_verdict"),
        F.min("sha256").alias("least_sha"), F.max("sha256").alias("most_sha"),
    )
    joined = files.withColumn("sha256", sha).withColumn("md5", md5).join(told, "file_id", "full_outer")
    known = files.select("file_id").withColumn("known", F.lit(True))
    checked = joined.join(known, "file_id", "left")
    wrong = checked.where("known IS NULL OR least_sha <> most_sha OR (sha256 IS NOT NULL AND (least_sha <> sha256 OR most_sha <> sha256))")
    if odd := wrong.select("file_id", "known").limit(1).collect():
        raise HashConflict(f"file {odd[0]['file_id']}: " + ("a provider's SHA-256 is another" if odd[0]["known"] else "there is no such file"))
    best = F.greatest(ranked_verdict(F.col("malicious"), order), ranked_verdict(F.col("new_verdict"), order), F.lit(1))
    verdict = F.element_at(F.array(*[F.lit(v) for v in reversed(order)]), best.cast("int"))
    touched = F.col("least_sha").isNotNull() | F.col("new_verdict").isNotNull() | F.col("new_md5").isNotNull() | F.col("new_magic").isNotNull()
    merged = joined.select("file_id", *[F.coalesce(blank(c), F.col(f"new_{c}")).alias(c) for c in ("sha256", "md5", "magic")], verdict.alias("malicious"), F.when(touched, at).otherwise(F.col("updated_at")).alias("updated_at"))
    child = lambda values, column: clean.select("file_id", F.explode(values).alias(column), F.col("provider").alias("source")).where(F.trim(column) != "").distinct().withColumn("first_seen", at)
    return {"files": merged, "tags": union_ignore(tags, child("tags", "tag"), ["file_id", "tag", "source"]), "names": union_ignore(names, child("names", "name"), ["file_id", "name", "source"])}
