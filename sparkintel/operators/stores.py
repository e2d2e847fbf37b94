"""Stores under change: provider records, observations, discoveries, findings, file identities, states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkintel.functions.strings import unique_clean
from sparkintel.operators.exchange import MOST_BYTES, MOST_ITEMS
from sparkintel.operators.folds import fitting_in_order
from sparkintel.operators.merges import max_verdict, ranked_verdict, union_ignore
from sparkintel.sources.exports import written_once


def apply_ip_results(entities: DataFrame, records: DataFrame) -> DataFrame:
    """Entities after provider records: ip, country_code, malicious, last_updated.

    Values of the records win where they have any, the last by `seq`; verdicts take the greatest.
    """
    last = records.groupBy("ip").agg(F.max_by("country_code", F.struct(F.col("country_code").isNotNull(), "seq")).alias("new_country"), max_verdict(F.col("malicious"), ["Yes", "No"]).alias("new_verdict"), F.max("at").alias("at"))
    joined = entities.join(last, "ip", "full_outer")
    rank = F.greatest(ranked_verdict(F.col("malicious"), ["Yes", "No"]), ranked_verdict(F.col("new_verdict"), ["Yes", "No"]))
    return joined.select("ip", F.coalesce("new_country", "country_code").alias("country_code"), F.when(rank == 2, "Yes").when(rank == 1, "No").alias("malicious"), F.coalesce("at", "last_updated").alias("last_updated"))


def apply_file_observations(files: DataFrame, observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files after observations, and the SHA-256 values that came with several MD5 values.

    A file keeps the MD5 and magic that it has; the first of the batch by `seq` fills what is blank.
    """
    filled = lambda c: F.min_by(c, F.struct(F.nullif(c, F.lit("")).isNull(), "seq"))
    first = observations.groupBy("sha256").agg(filled("md5").alias("new_md5"), filled("magic").alias("new_magic"), F.countDistinct(F.nullif("md5", F.lit(""))).alias("different"))
    joined = files.join(first, "sha256", "full_outer")
    held = lambda old, new: F.coalesce(F.nullif(old, F.lit("")), F.nullif(new, F.lit("")))
    merged = joined.select("sha256", held("md5", "new_md5").alias("md5"), held("magic", "new_magic").alias("magic"), F.coalesce("malicious", F.lit("unknown")).alias("malicious"))
    clash = (F.col("different") > 1) | (F.nullif("md5", F.lit("")) != F.nullif("new_md5", F.lit("")))
    return merged, joined.where(clash).select("sha256")


def promote_findings(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Findings to add, with their versions: those whose (repository, fingerprint, provenance) is not there."""
    keys = ["repository_id", "fingerprint", "provenance"]
    fresh = new.join(existing.select(*keys), keys, "left_anti").groupBy(*keys).agg(F.min("seq").alias("seq"))
    top = existing.groupBy("repository_id").agg(F.max("version").alias("top"))
    number = F.row_number().over(Window.partitionBy("repository_id").orderBy("seq"))
    return fresh.join(top, "repository_id", "left").select(*keys, "seq", (F.coalesce("top", F.lit(0)) + number).alias("version"))


def move_pointers(current: DataFrame, findings: DataFrame) -> DataFrame:
    """The current finding of each repository after new ones: repository_id, finding_id, provenance.

    The newest of the new ones is pointed to, but a deterministic one never replaces one that was enriched.
    current: repository_id, finding_id, provenance; findings: the same and seq.
    """
    last = findings.groupBy("repository_id").agg(F.max_by(F.struct("finding_id", "provenance"), F.struct(F.col("provenance") != "deterministic", "seq")).alias("new"))
    joined = current.select("repository_id", F.struct("finding_id", "provenance").alias("old")).join(last, "repository_id", "full_outer")
    moves = F.col("old").isNull() | (F.col("new").isNotNull() & ((F.col("new.provenance") != "deterministic") | (F.col("old.provenance") == "deterministic")))
    return joined.select("repository_id", F.when(moves, F.col("new")).otherwise(F.col("old")).alias("f")).select("repository_id", "f.*")


def replace_remotes(remotes: DataFrame, copies: DataFrame, found: DataFrame) -> DataFrame:
    """Remotes after a discovery: those of the copies that were found again are replaced by what was found.

    remotes and found: root, path_key, remote, direction, url; copies: root, path_key of what was found.
    """
    return remotes.join(copies.select("root", "path_key").distinct(), ["root", "path_key"], "left_anti").unionByName(found.select(*remotes.columns))


def append_corrections(corrections: DataFrame, new: DataFrame, fields: list[str]) -> DataFrame:
    """Corrections with new ones added: each gets the next id of all and the id of the one of its field before it.

    corrections: id, repository_id, field_path, replacement, rationale, supersedes_id; new: the same without
    ids, and seq, by which they follow each other. What `correction_violations` finds wrong is left out, and
    all rows of a seq that comes twice. Ids go on without gaps.
    """
    wrong = correction_violations(new.withColumn("id", F.col("seq")), fields).select(F.col("id").alias("seq"))
    twice = new.groupBy("seq").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1 OR seq IS NULL").select("seq")
    good = written_once(new.join(wrong.union(twice).distinct(), "seq", "left_anti").where("seq IS NOT NULL").repartitionByRange("seq").sortWithinPartitions("seq").withColumn("mark", F.monotonically_increasing_id()))
    # Ranks by partitions: rows of one, and how many rows the ones before it have; one row a partition.
    part, within = F.expr("shiftright(mark, 33)"), F.col("mark").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = good.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"))
    before = sizes.withColumn("before", F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).select("part", "before")
    top = corrections.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))  # one row
    numbered = good.withColumn("part", part).join(F.broadcast(before), "part").crossJoin(F.broadcast(top)).withColumn("id", F.col("top") + F.col("before") + within + 1)
    last = corrections.groupBy("repository_id", "field_path").agg(F.max("id").alias("last"))
    earlier = F.lag("id").over(Window.partitionBy("repository_id", "field_path").orderBy("id"))
    linked = numbered.join(last, ["repository_id", "field_path"], "left").withColumn("supersedes_id", F.coalesce(earlier, "last"))
    return corrections.unionByName(linked.select(*corrections.columns))


def remap_root(copies: DataFrame, old: str, new: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """Copies of one root under another, and the event that says so: old_root, new_root, n_copies, at."""
    moved = copies.withColumn("root", F.when(F.col("root") == old, F.lit(new)).otherwise(F.col("root")))
    event = copies.where(F.col("root") == old).agg(F.count(F.lit(1)).alias("n_copies")).select(F.lit(old).alias("old_root"), F.lit(new).alias("new_root"), "n_copies", at.alias("at"))
    return moved, event


def apply_children(children: DataFrame, records: DataFrame, column: str, at: Column) -> DataFrame:
    """Child values of addresses (ip, value, first_seen) with those of provider records (ip, array of values) added where they are new."""
    told = records.select("ip", F.explode(unique_clean(F.col(f"{column}s"))).alias(column)).distinct().withColumn("first_seen", at)
    return union_ignore(children, told, ["ip", column])


def apply_discovery(copies: DataFrame, found: DataFrame, at: Column) -> DataFrame:
    """Local copies after a discovery: root, path_key, first_seen, last_seen, missing_at.

    Paths are one in any case. What is found again loses `missing_at`; what is not found gets it.
    """
    seen = found.select("root", F.lower("path").alias("path_key")).distinct().withColumn("here", F.lit(True))
    joined = copies.join(seen, ["root", "path_key"], "full_outer")
    return joined.select("root", "path_key", F.coalesce("first_seen", at).alias("first_seen"), F.when(F.col("here"), at).otherwise(F.col("last_seen")).alias("last_seen"), F.when(F.col("here"), None).otherwise(F.coalesce("missing_at", at)).alias("missing_at"))


def transition(rows: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """Rows with their last event's state, how many attempts there were, and the last error."""
    last = events.groupBy(key).agg(F.max_by("state", "seq").alias("new_state"), F.count_if(F.col("state") == "running").alias("tries"), F.max_by("error", "seq").alias("error"))
    joined = rows.join(last, key, "left")
    return joined.select(key, F.coalesce("new_state", "state").alias("state"), (F.col("attempts") + F.coalesce("tries", F.lit(0))).alias("attempts"), "error")


def run_status(items: DataFrame, run: str = "run_id") -> DataFrame:
    """Progress and status of each run: complete, failed if any item failed, else interrupted."""
    done = F.col("state").isin("complete", "skipped_reuse")
    per = items.groupBy(run).agg(F.count_if(done).alias("completed"), F.count(F.lit(1)).alias("total"), F.bool_or(F.col("state") == "failed").alias("failed"))
    return per.select(run, "completed", "total", F.when(F.col("completed") == F.col("total"), "complete").when(F.col("failed"), "failed").otherwise("interrupted").alias("status"))


def worklist(repositories: DataFrame, items: DataFrame) -> DataFrame:
    """Repositories of a run whose items still want work."""
    return repositories.join(items.where("state NOT IN ('complete', 'skipped_reuse')"), "repository_id")


def select_repositories(repositories: DataFrame, wanted: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The wanted repositories in order of identity, and the keys that are not there."""
    kept = repositories.join(wanted.select("identity_key"), "identity_key", "left_semi").orderBy("identity_key")
    missing = wanted.select("identity_key").distinct().join(repositories.select("identity_key"), "identity_key", "left_anti")
    return (kept if limit is None else kept.limit(limit)), missing


def eligible_subjects(people: DataFrame, owners: DataFrame) -> DataFrame:
    """The one documented person of each repository whose owner is not an organisation."""
    one = people.groupBy("repository_id").agg(F.countDistinct("person").alias("n"), F.min("person").alias("person")).where("n = 1")
    return one.join(owners, "repository_id", "left").where("owner_type IS NULL OR owner_type <> 'Organization'").select("repository_id", "person")


def cached_findings(cache: DataFrame, attempts: DataFrame, findings: DataFrame, keys: list[str]) -> DataFrame:
    """Cached findings of each set of version keys, that of the newest attempt."""
    joined = cache.join(attempts, "attempt_id").join(findings.select("finding_id"), "finding_id", "left_semi")
    return joined.groupBy(*keys).agg(F.max_by("finding_id", F.struct("completed_at", "attempt_id")).alias("finding_id"))


def remap(child: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """Children with a reference replaced through a table of (old_id, new_id); those without one go."""
    return child.join(mapping, child[column] == mapping["old_id"]).drop("old_id", column).withColumnRenamed("new_id", column)


def correction_violations(corrections: DataFrame, fields: list[str], most: int = 30) -> DataFrame:
    """What is wrong with corrections: field, blank value, rationale, list length."""
    wrong = F.array(
        F.when(~F.coalesce(F.col("field_path").isin(fields), F.lit(False)), "field"), F.when(F.coalesce(F.trim("replacement"), F.lit("")) == "", "blank"), F.when(~F.coalesce(F.length("rationale").between(1, 2000), F.lit(False)), "rationale"),
        F.when(F.size(F.from_json("replacement", "array<string>")) > most, "items"),
    )
    return corrections.select("id", F.explode(F.array_compact(wrong)).alias("violation"))


def quarantine_plan(items: DataFrame, each: int, whole: int) -> DataFrame:
    """Which items of a source fit: none above `each`, and in order as long as their sum stays within `whole`.

    An item that does not fit takes nothing, so that each decision needs the one before: one fold a source.
    """
    return fitting_in_order(items, "source", "size", whole, "kept", each)


def write_bundle(files: DataFrame, ips: DataFrame, repositories: DataFrame, header: dict[str, Column], most: int = MOST_ITEMS, spread: int | None = None) -> DataFrame:
    """Bundles of indicators as canonical JSON: bundle, body, sha256, n_files, n_ips, n_repositories.

    Indicators are distinct and sorted in each list. They are dealt by hash over as many bundles as keep
    each below `most` items (or over `spread`), so that a bundle, which is one row, is bounded. One that
    still passes the limits of items or bytes is refused when it is made.
    """
    as_row = lambda df, kind, value, body: df.select(F.lit(kind).alias("kind"), value.alias("value"), body.alias("body")).distinct()
    items = as_row(files, "files", F.col("sha256"), F.to_json(F.struct("md5", "sha256"), {"ignoreNullFields": "false"})).union(as_row(ips, "ips", F.col("ip"), F.to_json(F.array("ip"))))
    items = items.union(as_row(repositories, "repositories", F.col("identity_key"), F.to_json(F.struct(F.concat(F.lit("https://"), F.col("identity_key")).alias("canonical_url"), "identity_key"))))
    many = spread or -(-items.count() * 5 // (4 * most)) or 1
    dealt = items.withColumn("bundle", F.pmod(F.xxhash64("value"), F.lit(many)).cast("int"))
    one = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("value", "body"))))
    lists = dealt.groupBy("bundle").agg(*[one(k).alias(k) for k in ("files", "ips", "repositories")])
    bare = lambda x: F.substr(x["body"], F.lit(2), F.length(x["body"]) - 2)  # noqa: E731  without the brackets
    text = {k: F.concat(F.lit("["), F.array_join(F.transform(k, bare if k == "ips" else lambda x: x["body"]), ","), F.lit("]")) for k in ("files", "ips", "repositories")}
    counts = F.to_json(F.struct(*[F.size(k).alias(k) for k in ("files", "ips", "repositories")]))
    parts = {"counts": counts, **text, **{k: F.to_json(F.array(v)) for k, v in header.items()}}
    body = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), F.substr(v, F.lit(2), F.length(v) - 2) if k in header else v) for k, v in sorted(parts.items())]), F.lit("}"))
    out = lists.select("bundle", body.alias("body"), *[F.size(k).cast("long").alias(f"n_{k}") for k in ("files", "ips", "repositories")])
    fits = (F.col("n_files") + F.col("n_ips") + F.col("n_repositories") <= most) & (F.octet_length("body") <= MOST_BYTES)
    return out.select("bundle", F.when(fits, F.col("body")).otherwise(F.raise_error(F.lit("a bundle passes its limits"))).alias("body"), "n_files", "n_ips", "n_repositories").withColumn("sha256", F.sha2("body", 256))


def read_bundle(bundles: DataFrame) -> DataFrame:
    """files, ips and keys of repositories of bundles (bundle_id, body, sha256) whose checksum and counts are right."""
    schema = "struct<counts:struct<files:int,ips:int,repositories:int>,files:array<struct<sha256:string,md5:string>>,ips:array<string>,repositories:array<struct<identity_key:string>>>"
    good = bundles.where(F.sha2("body", 256) == F.col("sha256")).select("bundle_id", F.from_json("body", schema).alias("b"))
    right = good.where("size(b.files) = b.counts.files AND size(b.ips) = b.counts.ips AND size(b.repositories) = b.counts.repositories")
    return right.select("bundle_id", "b.ips", F.col("b.repositories.identity_key").alias("repositories"), F.col("b.files.sha256").alias("files"))

