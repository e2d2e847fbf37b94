"""Structured answers and configuration text as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkintel.functions.repositories import repository_key_lenient
from sparkintel.functions.strings import normalize_hash, unique_clean


def actor_labels(actors: Column) -> Column:
    """`(CC)name/alias` for each actor of an array of country, name, aliases."""
    return F.transform(actors, lambda a: F.concat(F.when(F.coalesce(a["country"], F.lit("")) != "", F.concat(F.lit("("), a["country"], F.lit(")"))).otherwise(""), F.array_join(F.array_compact(F.concat(F.array(a["name"]), F.coalesce(a["aliases"], F.array().cast("array<string>")))), "/")))


def normalize_ip_reports(reports: DataFrame) -> DataFrame:
    """Address reports in JSON (ip, body) as rows; a body that is no JSON has the state `failed`."""
    schema = "struct<detect:string,country:string,whois:string,reverse_dns:array<string>,iocs:array<string>,actors:array<struct<country:string,name:string,aliases:array<string>>>>"
    parsed = reports.select("ip", F.from_json("body", schema).alias("r"), F.try_parse_json("body").isNull().alias("bad"))
    verdict = F.when(F.coalesce(F.col("r.detect"), F.lit("")).isin("", "normal"), "No").otherwise("Yes")
    return parsed.select(
        "ip", F.when(F.col("bad"), "failed").otherwise("success").alias("provider_status"), F.when(~F.col("bad"), verdict).alias("malicious"), F.col("r.country").alias("country_code"), F.col("r.whois").alias("whois"),
        unique_clean(F.col("r.reverse_dns")).alias("reverse_dns"), unique_clean(F.col("r.iocs")).alias("related_iocs"), actor_labels(F.col("r.actors")).alias("related_actors"),
    )


def normalize_file_reports(reports: DataFrame) -> DataFrame:
    """File reports in JSON (query_hash, body): state, hashes, verdict, tags with threat types."""
    schema = "struct<result_code:int,data:struct<sha256:string,md5:string,detect:string,tags:array<string>,threat_types:array<string>>>"
    r = reports.select("query_hash", F.from_json("body", schema).alias("r"))
    state = F.when(~F.coalesce(F.col("r.result_code") == 200, F.lit(False)), "provider_error").when(F.col("r.data").isNull(), "not_found").otherwise("success")
    verdict = F.when(F.col("r.data.detect").isNull(), "unknown").when(F.col("r.data.detect") == "normal", "no").otherwise("yes")
    none = F.array().cast("array<string>")
    tags = unique_clean(F.concat(F.coalesce("r.data.tags", none), F.coalesce("r.data.threat_types", none)))
    return r.select("query_hash", state.alias("status"), normalize_hash(F.col("r.data.sha256")).alias("sha256"), normalize_hash(F.col("r.data.md5")).alias("md5"), F.when(state == "success", verdict).alias("malicious"), F.when(state == "success", tags).alias("tags"))


def normalize_repo_metadata(answers: DataFrame) -> DataFrame:
    """Repository answers in JSON (repository_id, body) as snapshots, keyed by the hash of their content."""
    v = F.try_parse_json("body")
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    stars = get("$.stargazers_count", "long")
    return answers.select(
        "repository_id", get("$.owner.login", "string").alias("owner_login"), get("$.owner.type", "string").alias("owner_type"), F.when(stars >= 0, stars).alias("stars_count"), get("$.license.spdx_id", "string").alias("license_spdx"),
        get("$.fork", "boolean").alias("is_fork"), get("$.parent.full_name", "string").alias("parent_full_name"), F.sha2(F.to_json(v), 256).alias("metadata_hash"),
    )


def readme_versions(answers: DataFrame) -> DataFrame:
    """README answers (repository_id, content in base64) as texts with their hash; bad base64 is left out."""
    data = F.try_to_binary("content", F.lit("base64"))
    return answers.select("repository_id", data.alias("bytes")).where("bytes IS NOT NULL").select("repository_id", F.decode("bytes", "UTF-8").alias("text"), F.sha2("bytes", 256).alias("content_hash"), F.octet_length("bytes").alias("byte_count"))


def git_remotes(configs: DataFrame) -> DataFrame:
    """Remotes of git configuration texts (copy_id, text): copy_id, remote, direction, url, ordinal, identity_key.

    A line's section is the last one that opens before it. Continued lines are joined first; comments
    and quotes are taken off; includes are left out.
    """
    joined = F.regexp_replace("text", r"\\\r?\n", "")
    lines = configs.select("copy_id", F.posexplode(F.split(joined, r"\r?\n")).alias("n", "line"))
    header = F.regexp_extract("line", r"^\s*\[\s*([^\]]*?)\s*\]", 1)
    window = Window.partitionBy("copy_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    inside = lines.withColumn("section", F.last(F.when(header != "", header), ignorenulls=True).over(window))
    remote = F.regexp_extract("section", r'^remote\s+"([^"]*)"$', 1)
    bare = F.regexp_replace(F.regexp_extract("line", r'(?i)^\s*(?:url|pushurl)\s*=\s*((?:"[^"]*"|[^#;])*)', 1), '"', "")
    key = F.lower(F.regexp_extract("line", r"(?i)^\s*(url|pushurl)\s*=", 1))
    urls = inside.select("copy_id", "n", remote.alias("remote"), F.when(key == "url", "fetch").when(key == "pushurl", "push").alias("direction"), F.trim(bare).alias("url")).where("remote <> '' AND direction IS NOT NULL AND url <> ''")
    ordinal = F.row_number().over(Window.partitionBy("copy_id", "remote", "direction").orderBy("n")) - 1
    return urls.select("copy_id", "remote", "direction", "url", ordinal.alias("ordinal"), repository_key_lenient(F.col("url")).alias("identity_key"))


def primary_remote(remotes: DataFrame) -> DataFrame:
    """The repository of each copy: the only valid origin, else the only valid remote if no origin is valid."""
    valid = remotes.where("direction = 'fetch' AND identity_key IS NOT NULL")
    per = valid.groupBy("copy_id").agg(F.count_if(F.col("remote") == "origin").alias("origins"), F.count(F.lit(1)).alias("all"), F.max_by("identity_key", F.col("remote") == "origin").alias("best"))
    return per.where("origins = 1 OR (origins = 0 AND all = 1)").select("copy_id", F.col("best").alias("identity_key"))
