"""Snapshots of whole stores merged into a store, each once: addresses, files and repositories by their natural keys.

A store is a dict of DataFrames. A merge gives the store after it, what changed as counts, and warnings;
what it refuses, it refuses before anything is written. `operators.import_sets` applies a set of stores
whole or not at all.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkintel.functions.addresses import canonical_ip, ip_version
from sparkintel.functions.repositories import repository_key_lenient
from sparkintel.functions.strings import normalize_hash
from sparkintel.operators.file_identity import FILE_VERDICTS, assign_files, file_warnings, merge_files
from sparkintel.operators.merges import add_versions, complete_findings, current_findings, merge_first_seen, merge_ip_snapshots, not_imported, union_ignore
from sparkintel.operators.versions import assign_versions
from sparkintel.sources.exports import written_once

Store = dict[str, DataFrame]


@dataclass
class Merged:
    """A store after a merge. counts: one row; warnings: kind, key."""

    store: Store
    counts: DataFrame
    warnings: DataFrame | None = None
    notes: list[str] = field(default_factory=list)


def fresh_snapshots(snapshots: DataFrame, ledger: DataFrame) -> DataFrame:
    """Snapshots (source_sha256, import_seq) that are not recorded yet, each digest once, at its first place."""
    return not_imported(snapshots.groupBy("source_sha256").agg(F.min("import_seq").alias("import_seq")), ledger)


def set_digest(digests: dict[str, str]) -> str:
    """One digest of a set of stores' snapshots, whatever the order in which they are named."""
    return hashlib.sha256("\n".join(f"{name} {digests[name]}" for name in sorted(digests)).encode()).hexdigest()


def noncanonical_entities(entities: DataFrame) -> DataFrame:
    """Address entities whose key is not the canonical form of an address, or whose version is not its own."""
    return entities.where(~F.coalesce((canonical_ip(F.col("ip")) == F.col("ip")) & (ip_version(F.col("ip")) == F.col("ip_version")), F.lit(False)))


def _refuse(rows: DataFrame, why: str) -> None:
    if odd := rows.limit(1).collect():
        raise ValueError(f"{why}: {odd[0].asDict()}")


def _counts(spark_rows: dict[str, DataFrame]) -> DataFrame:
    """One row of counts; each table gives one number."""
    out = None
    for name, df in spark_rows.items():
        one = df.agg(F.count(F.lit(1)).alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out


#: Children of an address and their columns.
IP_CHILDREN = {"reverse_dns": "domain", "related_iocs": "ioc", "related_actors": "actor"}
IP_SCALARS = ("country_code", "whois")


def merge_ip(store: Store, snapshots: Store) -> Merged:
    """Address snapshots into a store.

    store: entities (ip, ip_version, country_code, whois, malicious, first_seen, last_updated), the tables
    of IP_CHILDREN (ip, value, first_seen), runs (source_sha256, run_id, input_file, ...), results
    (source_sha256, run_id, ip, provider_status, ...) and ledger (source_sha256). snapshots: the same
    tables, each with source_sha256, and `snapshots` (source_sha256, import_seq). A key that is not
    canonical refuses the whole merge. Children keep the first_seen that is there. Runs and results are
    all added, without the path of their input.
    """
    fresh = fresh_snapshots(snapshots["snapshots"], store["ledger"])
    carried = {name: df.join(fresh, "source_sha256") for name, df in snapshots.items() if name != "snapshots"}
    _refuse(noncanonical_entities(carried["entities"]), "noncanonical address entity")
    columns = ["ip", "import_seq", *IP_SCALARS, "malicious", "first_seen", "last_updated"]
    known = store["entities"].withColumn("import_seq", F.lit(None).cast("long"))
    # What is there comes before all that is imported.
    rows = known.select(*columns).union(carried["entities"].select(*columns)).withColumn("import_seq", F.coalesce("import_seq", F.lit(-(1 << 62))))
    merged = merge_ip_snapshots(rows, IP_SCALARS).drop("n_snapshots").withColumn("ip_version", ip_version(F.col("ip")))
    out = {"entities": merged.select(*store["entities"].columns), "ledger": store["ledger"].select("source_sha256").union(fresh.select("source_sha256"))}
    for name, column in IP_CHILDREN.items():
        out[name] = add_versions(store[name].select("ip", column, "first_seen"), carried[name], ["ip", column], ["import_seq", "first_seen"])
    out["runs"] = store["runs"].unionByName(carried["runs"].withColumn("input_file", F.lit(None).cast("string")).select(*store["runs"].columns))
    out["results"] = store["results"].unionByName(carried["results"].select(*store["results"].columns))
    new = carried["entities"].select("ip").distinct().join(store["entities"].select("ip"), "ip", "left_anti")
    counts = _counts({"snapshots_imported": fresh, "entities_inserted": new, "entity_rows": carried["entities"], "provider_results_copied": carried["results"]})
    return Merged(out, counts.select("snapshots_imported", "entities_inserted", (F.col("entity_rows") - F.col("entities_inserted")).alias("entities_merged"), "provider_results_copied"))


def merge_file_store(store: Store, snapshots: Store, intelligence_only: bool = False) -> Merged:
    """File snapshots into a store.

    store: files (row_id, import_seq, sha256, md5, magic, malicious, created_at, updated_at), file_names and
    tags (row_id, value, source, first_seen), observations (row_id, path), lookups (row_id, provider,
    status, completed_at, raw_path) and ledger; snapshots: the same with source_sha256, and `snapshots`.
    The store after it names files by `group` in all tables, with the row and import that made each, and can be
    merged into again. A store that is given in part has `tops` (top), the greatest import_seq of the whole.
    Only for intelligence, local observations and paths stay behind and the ledger guards. Warnings tell of MD5 values that a row brings where they are another file's or not its file's, and of
    files with a row whose magic was another and not newer.
    """
    fresh = fresh_snapshots(snapshots["snapshots"], store["ledger"])
    carried = {name: df.join(fresh.select("source_sha256"), "source_sha256") for name, df in snapshots.items() if name != "snapshots"}
    by_group = "group" in store["files"].columns
    there = F.concat(F.lit("t:"), F.col("group" if by_group else "row_id").cast("string"))
    told = F.concat("source_sha256", F.lit(":"), F.col("row_id").cast("string"))
    named = F.concat(F.lit("r:"), F.col("row_id").cast("string"))

    def rows_of(df: DataFrame, uid: Column, known_as: Column, old: bool) -> DataFrame:
        verdict = F.when(F.col("malicious").isin(FILE_VERDICTS), F.col("malicious")).otherwise("unknown")
        return df.select(uid.alias("row_id"), "import_seq", F.col("row_id").alias("place"), normalize_hash(F.col("sha256")).alias("sha256"), normalize_hash(F.col("md5")).alias("md5"), F.nullif(F.trim("magic"), F.lit("")).alias("magic"), verdict.alias("malicious"), "created_at", "updated_at", F.lit(old).alias("there"), known_as.alias("known_as"))

    rows = rows_of(store["files"], there, F.col("group") if by_group else named, True).union(rows_of(carried["files"], told, named, False))
    files = written_once(assign_files(rows))  # every table is named by it
    groups = files.select("row_id", "group")
    per = rows.join(groups, "row_id").groupBy("group").agg(F.bool_or("there").alias("known"), F.count_if(~F.col("there")).alias("rows"), F.min(F.struct((~F.col("there")).alias("new"), "import_seq", "place")).alias("born"))
    top = store["tops"] if "tops" in store else store["files"].agg(F.coalesce(F.max("import_seq"), F.lit(-1)).alias("top"))  # one row
    born = per.crossJoin(top).select("group", F.col("born.place").alias("row_id"), (F.col("born.import_seq") + F.when(F.col("born.new"), F.col("top") + 1).otherwise(0)).alias("import_seq"))
    out: Store = {"files": merge_files(rows, files).join(born, "group"), "ledger": store["ledger"].select("source_sha256").union(fresh.select("source_sha256"))}

    def of(df: DataFrame, *columns: str, old: bool = False) -> DataFrame:
        return df.withColumn("row_id", there if old else told).drop("group").join(groups, "row_id").select("group", *columns)

    for name in ("file_names", "tags"):
        columns = ["value", "source", "first_seen"]
        out[name] = merge_first_seen(of(store[name], *columns, old=True), of(carried[name], *columns), ["group", "value", "source"])
    kept = of(store["observations"], "path", old=True)
    out["observations"] = kept if intelligence_only else kept.union(of(carried["observations"], "path"))
    lookups = carried["lookups"].withColumn("raw_path", F.lit(None).cast("string") if intelligence_only else F.col("raw_path"))
    columns = ["provider", "status", "completed_at", "raw_path"]
    out["lookups"] = of(store["lookups"], *columns, old=True).union(of(lookups, *columns))
    changed = per.where("rows > 0")
    told_of = file_warnings(rows, files).join(rows.select("row_id", "md5"), "row_id").join(groups, "row_id")
    warnings = told_of.select("kind", F.when(F.col("kind") == "md5_conflict", F.col("md5")).otherwise(F.col("group")).alias("key")).distinct()
    counts = changed.agg(F.count_if(~F.col("known")).alias("files_inserted"), F.sum(F.col("rows") - F.when(F.col("known"), 0).otherwise(1)).alias("files_merged")).na.fill(0)
    notes = ["local observations and paths stay behind"] if intelligence_only else []
    return Merged(out, counts.crossJoin(_counts({"lookups_copied": carried["lookups"], "warnings": warnings})), warnings, notes)


def empty_file_store(spark: SparkSession) -> Store:
    """A store of files without any, whose tables are those that a merge gives."""
    child = "group string, value string, source string, first_seen string"
    tables = {
        "files": "group string, sha256 string, md5 string, magic string, malicious string, created_at string, updated_at string, n_rows long, row_id long, import_seq long", "file_names": child, "tags": child,
        "observations": "group string, path string", "lookups": "group string, provider string, status string, completed_at string, raw_path string", "ledger": "source_sha256 string",
    }
    return {name: spark.createDataFrame([], schema) for name, schema in tables.items()}


DOCUMENT = ["identity_key", "kind", "locator"]
VERSION = [*DOCUMENT, "content_hash"]
FINDING = ["identity_key", "fingerprint", "provenance"]
PERSON = ["normalized_name", "login"]


def merge_repos(store: Store, snapshots: Store) -> Merged:
    """Repository snapshots into a store, by natural keys; local material never comes along.

    Tables: repositories (identity_key, owner, name, canonical_url, node_id, updated_at), documents (DOCUMENT,
    origin), versions (VERSION, captured_at), snapshots (identity_key, metadata_hash, captured_at), people
    (PERSON, display_name), roles (identity_key, PERSON, role, and a version's key or nulls), findings
    (FINDING, version, created_at, summary), evidence (FINDING, field_path, VERSION's kind, locator and
    content_hash, quote), inferences (FINDING, category), current (FINDING) and ledger (source_sha256).
    Those of snapshots also have source_sha256, and `imports` lists (source_sha256, import_seq).

    A newer row gives a repository's names, and its node where it has one. Of documents, only those that
    come from the provider are carried; a finding only if all of its evidence is. A finding that is there is
    used again, others are numbered on. The current finding is that of the greater created_at; of equals
    the store's.
    """
    fresh = fresh_snapshots(snapshots["imports"], store["ledger"])
    src = {name: df.join(fresh, "source_sha256") for name, df in snapshots.items() if name != "imports"}
    _refuse(src["repositories"].where(~F.coalesce(repository_key_lenient(F.col("canonical_url")) == F.col("identity_key"), F.lit(False))), "noncanonical repository")
    out: Store = {"ledger": store["ledger"].select("source_sha256").union(fresh.select("source_sha256"))}
    out["repositories"] = _newer_names(store["repositories"], src["repositories"])
    documents = src["documents"].where("origin = 'github'")
    out["documents"] = union_ignore(store["documents"], documents.select(*store["documents"].columns), DOCUMENT)
    versions = src["versions"].join(documents.select("source_sha256", *DOCUMENT).distinct(), ["source_sha256", *DOCUMENT])
    out["versions"] = add_versions(store["versions"], versions, VERSION, ["import_seq"])
    out["snapshots"] = add_versions(store["snapshots"], src["snapshots"], ["identity_key", "metadata_hash"], ["import_seq"])
    out["people"] = add_versions(store["people"], src["people"], PERSON, ["import_seq"])
    # A finding without all of its evidence would be stripped: it stays behind.
    name = lambda df, columns, alias: df.withColumn(alias, F.sha2(F.to_json(F.struct(*columns)), 256))
    held = name(versions, ["source_sha256", *VERSION], "source_version_id")
    cited = name(name(src["evidence"], ["source_sha256", *VERSION], "source_version_id"), ["source_sha256", *FINDING], "finding_id")
    whole = written_once(complete_findings(name(src["findings"], ["source_sha256", *FINDING], "finding_id"), cited, held))  # five tables are made of it
    first = whole.groupBy(*FINDING).agg(F.min_by(F.struct("import_seq", "version", "created_at", "summary"), F.struct("import_seq", "version")).alias("f")).select(*FINDING, "f.*")
    fresh_findings = first.join(store["findings"].select(*FINDING), FINDING, "left_anti")
    numbered = written_once(assign_versions(store["findings"].select("identity_key", "version"), fresh_findings.drop("version"), "identity_key", ["import_seq", "created_at", "fingerprint", "provenance"]))
    out["findings"] = store["findings"].unionByName(numbered.select(*store["findings"].columns))
    carried = whole.select("source_sha256", *FINDING).distinct()
    evidence = src["evidence"].join(carried, ["source_sha256", *FINDING])
    out["evidence"] = union_ignore(store["evidence"], evidence.select(*store["evidence"].columns), [*FINDING, "field_path", "kind", "locator", "content_hash", "quote"])
    roles = src["roles"].join(held.select("source_sha256", *VERSION, F.lit(True).alias("held")).distinct(), ["source_sha256", *VERSION], "left").where("content_hash IS NULL OR held")
    out["roles"] = union_ignore(store["roles"], roles.select(*store["roles"].columns), store["roles"].columns)
    out["inferences"] = add_versions(store["inferences"], src["inferences"].join(carried, ["source_sha256", *FINDING]), FINDING, ["import_seq"])
    made = out["findings"].select(*FINDING, "created_at")
    pointed = lambda df, is_dst: df.join(made, FINDING).select(F.col("identity_key").alias("repository_id"), F.struct("fingerprint", "provenance").alias("finding_id"), "created_at", F.lit(is_dst).alias("is_dst"))
    both = pointed(store["current"], True).union(pointed(src["current"].join(carried, ["source_sha256", *FINDING]).select(*FINDING).distinct(), False))
    out["current"] = current_findings(both).select(F.col("repository_id").alias("identity_key"), "finding_id.fingerprint", "finding_id.provenance")
    new = src["repositories"].select("identity_key").distinct().join(store["repositories"].select("identity_key"), "identity_key", "left_anti")
    snaps = src["snapshots"].select("identity_key", "metadata_hash").distinct().join(store["snapshots"].select("identity_key", "metadata_hash"), ["identity_key", "metadata_hash"], "left_anti")
    return Merged(out, _counts({"snapshots_imported": fresh, "repositories_inserted": new, "snapshots_copied": snaps, "findings_copied": fresh_findings}))


def _newer_names(dst: DataFrame, src: DataFrame) -> DataFrame:
    """Repositories of both: names of the row that was newer than all before it, of equals the first; a node where one was told by such a row."""
    seq = F.lit(-1).cast("long")
    rows = dst.withColumn("import_seq", seq).select(*dst.columns, "import_seq").union(src.select(*dst.columns, "import_seq"))
    before = F.max("updated_at").over(Window.partitionBy("identity_key").orderBy("import_seq").rowsBetween(Window.unboundedPreceding, -1))
    newer = rows.withColumn("newer", before.isNull() | (F.col("updated_at") > before)).where("newer")
    last: Column = F.max_by(F.struct("owner", "name", "canonical_url", "updated_at"), "import_seq")
    node = F.max_by("node_id", F.when(F.col("node_id").isNotNull(), F.col("import_seq")))
    return newer.groupBy("identity_key").agg(last.alias("r"), F.when(F.count("node_id") > 0, node).alias("node_id")).select("identity_key", "r.*", "node_id").select(*dst.columns)
