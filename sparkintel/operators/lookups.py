"""Indicators against intelligence: hit, miss, ambiguous, unavailable or error."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkintel.functions.addresses import ip_version

VERDICTS = ("Yes", "No")
PROVIDER_STATES = ("success", "not_found", "failed")


def missing_columns(df: DataFrame, needed: StructType) -> list[str]:
    """Columns that a table lacks; others may be there too."""
    return [f.name for f in needed.fields if f.name not in df.columns]


#: What a table of intelligence must have, by kind.
INTEL = {
    "ip": "ip string, ip_version int, country_code string, whois string, malicious string",
    "file": "file_id long, sha256_hash string, md5_hash string, malicious string",
    "repository": "identity_key string, status string, tool_types_json string",
}


def load_intel(spark: SparkSession, folder: str, kind: str) -> tuple[DataFrame | None, str | None]:
    """A table of intelligence, or None and why it is unavailable: no table, or columns that it lacks.

    Only its schema is read. Columns that are there besides the needed ones don't matter. Other failures
    than that nothing is there are raised.
    """
    try:
        df = spark.read.parquet(f"{folder}/{kind}")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None, f"no table: {e.getCondition()}"
    lacking = missing_columns(df, _parse(spark, INTEL[kind]))
    return (None, f"missing columns: {', '.join(lacking)}") if lacking else (df.select(*[f.split()[0] for f in INTEL[kind].split(", ")]), None)


def _parse(spark: SparkSession, fields: str) -> StructType:
    return spark.createDataFrame([], fields).schema


def nest(child: DataFrame, key: str, columns: list[str], name: str, order: list[Column] | None = None) -> DataFrame:
    """One row for each key with its children as an ordered array of structs, or of values for one column."""
    keyed = F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order or [F.col(c) for c in columns])], F.struct(*columns).alias("child"))
    nested = child.groupBy(key).agg(F.sort_array(F.collect_list(keyed)).alias("all"))
    taken = F.transform("all", lambda x: x["child"][columns[0]] if len(columns) == 1 else x["child"])
    return nested.select(key, taken.alias(name))


def lookup_ips(observed: DataFrame, entities: DataFrame | None, providers: DataFrame | None = None, children: dict[str, DataFrame] | None = None) -> DataFrame:
    """Status of each distinct observed ip, with the entity of a hit.

    No table is unavailable, never a miss. Several rows of one address, a version that does not fit it
    or a verdict outside the domain are an error. An entity whose providers never succeeded and that
    says nothing itself is a miss. children: tables (ip, value) whose rows are intelligence too.
    """
    asked = observed.select("ip").distinct()
    if entities is None:
        return asked.select("ip", F.lit("unavailable").alias("status"), F.lit(None).cast("string").alias("country_code"), F.lit(None).cast("string").alias("malicious"))
    one = entities.groupBy("ip").agg(F.count(F.lit(1)).alias("same"), F.min_by(F.struct("ip_version", "country_code", "whois", "malicious"), F.struct("ip_version", "country_code", "malicious")).alias("e"))
    joined = asked.join(one, "ip", "left")
    says = F.coalesce(F.nullif(F.col("e.country_code"), F.lit("")), F.nullif(F.col("e.whois"), F.lit("")), F.nullif(F.col("e.malicious"), F.lit(""))).isNotNull()
    tried = worked = bad_state = F.lit(False)
    if providers is not None:
        told = providers.groupBy("ip").agg(F.count(F.lit(1)).alias("tries"), F.count_if(F.col("provider_status") == "success").alias("works"), F.count_if(~F.col("provider_status").isin(*PROVIDER_STATES)).alias("odd"))
        joined = joined.join(told, "ip", "left")
        tried, worked, bad_state = (F.coalesce(F.col(c), F.lit(0)) > 0 for c in ("tries", "works", "odd"))
    for name, child in (children or {}).items():
        joined = joined.join(child.select("ip").distinct().withColumn(f"has_{name}", F.lit(True)), "ip", "left")
        says = says | F.coalesce(f"has_{name}", F.lit(False))
    status = (
        F.when(F.col("same").isNull(), "miss")
        .when((F.col("same") > 1) | ~F.col("e.ip_version").eqNullSafe(ip_version(F.col("ip"))) | F.coalesce(~F.col("e.malicious").isin(*VERDICTS), F.lit(False)) | bad_state, "error")
        .when(tried & ~worked & ~says, "miss")
        .otherwise("hit")
    )
    hit = F.col("status") == "hit"
    return joined.withColumn("status", status).select("ip", "status", F.when(hit, F.col("e.country_code")).alias("country_code"), F.when(hit, F.col("e.malicious")).alias("malicious"))


def lookup_files(observed: DataFrame, files: DataFrame | None) -> DataFrame:
    """Files by SHA-256 and, only where that is unknown, by MD5.

    observed: sha256, md5. files: file_id, sha256_hash, md5_hash, malicious. Several rows of one MD5 are
    ambiguous, as is one row that has another SHA-256; candidate ids are sorted. No table is unavailable,
    never a miss.
    """
    asked = observed.select("sha256", "md5").distinct()
    none = F.lit(None).cast("string")
    if files is None:
        return asked.select("sha256", "md5", F.lit("unavailable").alias("status"), *[none.alias(c) for c in ("match_type", "reason", "file_ids", "malicious")])
    by_sha = files.where("sha256_hash IS NOT NULL").select(F.col("sha256_hash").alias("sha256"), F.col("file_id").alias("sha_id"), F.col("malicious").alias("sha_verdict"))
    first = asked.join(by_sha, "sha256", "left")
    found = first.where("sha_id IS NOT NULL").select("sha256", "md5", F.lit("hit").alias("status"), F.lit("sha256").alias("match_type"), F.lit(None).cast("string").alias("reason"), F.col("sha_id").cast("string").alias("file_ids"), F.col("sha_verdict").alias("malicious"))
    by_md5 = files.where("md5_hash IS NOT NULL").groupBy(F.col("md5_hash").alias("md5")).agg(F.sort_array(F.collect_set("file_id")).alias("ids"), F.max("sha256_hash").alias("other"), F.max("malicious").alias("verdict"))
    second = first.where("sha_id IS NULL").select("sha256", "md5").join(by_md5, "md5", "left")
    several, conflict = F.size("ids") > 1, F.coalesce(F.col("other") != F.col("sha256"), F.lit(False))
    status = F.when(F.col("ids").isNull(), "miss").when(several | conflict, "ambiguous").otherwise("hit")
    rest = second.withColumn("status", status).select(
        "sha256", "md5", "status", F.when(F.col("status") == "hit", "md5").alias("match_type"), F.when(F.col("status") == "ambiguous", F.when(several, "multiple_md5_rows").otherwise("conflicting_sha256")).alias("reason"),
        F.array_join("ids", ",").alias("file_ids"), F.when(F.col("status") == "hit", F.col("verdict")).alias("malicious"),
    )
    return found.unionByName(rest)


def lookup_repositories(observed: DataFrame, cards: DataFrame | None, states: list[str]) -> DataFrame:
    """Repositories by identity key; a card whose lists are no JSON lists or whose state is unknown is an error, no table is unavailable."""
    if cards is None:
        return observed.select("identity_key").distinct().select("identity_key", F.lit("unavailable").alias("status"), F.lit(None).cast("string").alias("tool_types"))
    joined = observed.select("identity_key").distinct().join(cards, "identity_key", "left")
    parsed = F.from_json("tool_types_json", "array<string>")
    status = F.when(F.col("status").isNull() & F.col("tool_types_json").isNull(), "miss").when(parsed.isNull() | ~F.coalesce(F.col("status").isin(states), F.lit(False)), "error").otherwise("hit")
    return joined.withColumn("lookup", status).select("identity_key", F.col("lookup").alias("status"), F.when(F.col("lookup") == "hit", F.array_join(parsed, ",")).alias("tool_types"))


def nest_file_children(names: DataFrame, tags: DataFrame, lookups: DataFrame, observations: DataFrame) -> DataFrame:
    """Children of each file as ordered arrays: file_id, file_names, tags, provider_lookups, historical_observations.

    Names and tags by value and source; lookups the newest first, then by provider; observations the newest
    first, then by path.
    """
    down = lambda c: -F.unix_micros(F.col(c).cast("timestamp"))
    parts = [
        nest(names, "file_id", ["file_name", "source"], "file_names"), nest(tags, "file_id", ["tag", "source"], "tags"), nest(lookups, "file_id", ["provider", "status", "completed_at"], "provider_lookups", [down("completed_at"), F.col("provider")]),
        nest(observations, "file_id", ["path", "observed_at"], "historical_observations", [down("observed_at"), F.col("path")]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "file_id", "full_outer")
    return out


def files_of_job(files: DataFrame, observations: DataFrame, job: int) -> DataFrame:
    """The files that a scan job has observed, each once."""
    return files.join(observations.where(F.col("scan_job_id") == job).select("file_id").distinct(), "file_id", "left_semi")


def needs_enrichment(repositories: DataFrame, current: DataFrame, policy: str) -> DataFrame:
    """Repositories to enrich: all of them, or by the policy `reuse` those without a current finding."""
    return repositories.join(current.select("repository_id"), "repository_id", "left_anti") if policy == "reuse" else repositories


def all_records(records: dict[str, DataFrame]) -> DataFrame:
    """Records of several kinds in one table, with their `type`; columns that a kind lacks are null."""
    out = None
    for kind, df in records.items():
        typed = df.withColumn("type", F.lit(kind))
        out = typed if out is None else out.unionByName(typed, allowMissingColumns=True)
    return out


def lookup_counts(statuses: DataFrame, *groups: str) -> DataFrame:
    """Counters by status."""
    return statuses.groupBy(*groups).agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("hit", "miss", "ambiguous", "unavailable", "error")])


def adapter_status(errors: DataFrame, adapters: list[str], most: int = 32) -> DataFrame:
    """State of each adapter: failed, degraded by any code, else success; its codes sorted, at most `most`."""
    per = errors.groupBy("adapter").agg(F.bool_or(F.col("severity").isin("failed", "report_error")).alias("failed"), F.slice(F.sort_array(F.collect_set("code")), 1, most).alias("codes"))
    literal = errors.sparkSession.createDataFrame([(a,) for a in adapters], "adapter string")
    joined = literal.join(per, "adapter", "left")
    state = F.when(F.col("failed"), "failed").when(F.size("codes") > 0, "degraded").otherwise("success")
    return joined.select("adapter", state.alias("state"), F.coalesce(F.array_join("codes", ","), F.lit("")).alias("codes"))


def hash_conflicts(obs: DataFrame) -> DataFrame:
    """SHA-256 values that come with several MD5 values."""
    return obs.groupBy("sha256").agg(F.countDistinct("md5").alias("n")).where("n > 1")


def missing_indicators(observed: DataFrame, statuses: DataFrame, key: str) -> DataFrame:
    """Observed indicators without a hit."""
    return observed.select(key).distinct().join(statuses.where("status = 'hit'").select(key), key, "left_anti")


def assert_complete(statuses: DataFrame) -> None:
    """Refuses statuses other than hit and miss; looks at one offending row at most."""
    if odd := statuses.where(~F.col("status").isin("hit", "miss")).limit(1).collect():
        raise ValueError(f"lookups are not complete: {odd[0].asDict()}")


def rank_verdicts(df: DataFrame, order: list[str], *then: Column) -> DataFrame:
    """Rows by verdict rank (`order` lists verdicts, null as ''), rows without a hit last."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(v) for v in order]), F.coalesce("malicious", F.lit(""))), F.lit(0))
    place = F.when(F.col("status") == "hit", F.when(rank == 0, len(order) + 1).otherwise(rank)).otherwise(len(order) + 2)
    return df.withColumn("rank", place.cast("int")).orderBy("rank", *then)
