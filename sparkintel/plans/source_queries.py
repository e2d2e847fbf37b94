"""Registered queries: archives, inventories, tuples, configuration and provider answers, made of the given tables."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkintel.functions.addresses import ip_number, networks_of
from sparkintel.operators import indicators, signatures, versions
from sparkintel.plans.queries import query
from sparkintel.plans.tables import event_ips, read
from sparkintel.sources import captures, documents, exports


def _archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in archives of up to fifty: path, content. Every third is a tar in a zip, every third a tar alone; each has a member that is unsafe."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for number, group in pdf.groupby("number"):
                members = [(f"d{k}", (t or "").encode()) for k, t in zip(group["doc_id"], group["text"], strict=True)] + [("../up", b"x")]
                tar, out = io.BytesIO(), io.BytesIO()
                with tarfile.open(fileobj=tar, mode="w:gz") as archive:
                    for name, data in members:
                        info = tarfile.TarInfo(name)
                        info.size = len(data)
                        archive.addfile(info, io.BytesIO(data))
                if number % 3 == 0:
                    rows.append((f"a{number}.tgz", tar.getvalue()))
                    continue
                with zipfile.ZipFile(out, "w") as archive:
                    for name, data in members if number % 3 == 1 else [("in.tar.gz", tar.getvalue())]:
                        archive.writestr(name, data)
                rows.append((f"a{number}.zip", out.getvalue()))
            yield pd.DataFrame(rows, columns=["path", "content"])

    d = read(spark, sf_dir, "documents").select("doc_id", "text", F.floor(F.col("doc_id") / 50).alias("number"))
    return d.groupBy("number").applyInPandas(lambda pdf: next(pack(iter([pdf]))), "path string, content binary")


_BOX = "'a' || (doc_id // 50) || CASE doc_id // 50 % 3 WHEN 0 THEN '.tgz' WHEN 1 THEN '.zip' ELSE '.zip!in.tar.gz' END"


@query(
    f"""WITH d AS (SELECT doc_id, {_BOX} AS box, doc_id // 50 AS k, coalesce(text, '') AS text FROM documents)
    SELECT box || '!d' || doc_id AS path, sha256(text) AS sha256, CAST(NULL AS VARCHAR) AS error FROM d UNION ALL SELECT DISTINCT box || '!../up', NULL, 'unsafe_path' FROM d"""
)
def expanded_archives(spark, sf_dir):
    """Members of all archives and of archives in them, with what is wrong; archives themselves are left out."""
    found = captures.expand_archives(_archives(spark, sf_dir)).where(~F.endswith("path", F.lit("in.tar.gz")))
    return found.select("path", F.sha2("content", 256).alias("sha256"), "error")


@query(
    """WITH d AS (SELECT doc_id // 50 AS k, count(*) AS n, sum(octet_length(encode(coalesce(text, '')))) AS bytes FROM documents GROUP BY 1)
    SELECT 'a' || k || CASE k % 3 WHEN 0 THEN '.tgz' ELSE '.zip' END AS path, n + 1 AS n_files, CAST(bytes + 1 AS BIGINT) AS n_bytes FROM d WHERE k % 3 < 2"""
)
def estimated_archives(spark, sf_dir):
    """Members and bytes of archives by their headers; nested ones have one member."""
    return captures.estimate_archives(_archives(spark, sf_dir)).where("n_files > 1").drop("error")


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a manifest for each source; by its number an entry has a bad path, type, size or digest, or comes twice."""
    k = F.col("doc_id") % 50
    rows = read(spark, sf_dir, "documents").select(
        F.coalesce("source", F.lit("none")).alias("capture_id"), F.concat(F.when(k == 1, "/").otherwise(""), F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.when(k == 2, "link").when(k == 5, "directory").otherwise("file").alias("type"),
        F.when(k == 3, -1).otherwise(F.octet_length(F.coalesce("text", F.lit("")))).cast("long").alias("size"), F.when(k == 4, "x").otherwise(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("sha256"), k.alias("k"),
    )
    return rows.union(rows.where("k = 6")).drop("k")


@query(
    """WITH d AS (SELECT coalesce(source, 'none') AS capture_id, doc_id, doc_id % 50 AS k FROM documents)
    SELECT capture_id, CASE WHEN k = 1 THEN '/' ELSE '' END || 'd' || doc_id AS path, CASE k WHEN 1 THEN 'path' WHEN 2 THEN 'type' WHEN 3 THEN 'size' WHEN 6 THEN 'duplicate' ELSE 'digest' END AS violation FROM d WHERE k BETWEEN 1 AND 6
    UNION ALL SELECT capture_id, 'd' || doc_id, 'digest' FROM d WHERE k = 2"""
)
def inventory_violations(spark, sf_dir):
    return captures.inventory_violations(_manifest(spark, sf_dir))


@query(
    """WITH d AS (SELECT coalesce(source, 'none') AS capture_id, sha256('{"doc_id":' || doc_id || ',"sha":"' || sha256(coalesce(text, '')) || '"}') AS line FROM documents)
    SELECT capture_id, sha256(string_agg(line, '' ORDER BY line)) AS digest FROM d GROUP BY capture_id"""
)
def manifest_digests(spark, sf_dir):
    """One digest for each source over its sorted rows."""
    rows = read(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("none")).alias("capture_id"), "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    return captures.manifest_digest(rows, "capture_id", ["doc_id", "sha"])


@query(
    """WITH c AS (SELECT event_id, 'in ' || event_type || CASE event_id % 3 WHEN 0 THEN '.enc' WHEN 1 THEN '.EN_DEC' ELSE '.zip' END AS name, ts FROM events),
    b AS (SELECT event_id, replace('in ' || split_part(split_part(name, 'in ', 2), '.', 1) || CASE WHEN name LIKE '%.zip' THEN '.zip' ELSE '' END, ' ', '_') || '-' || strftime(date_trunc('hour', ts), '%y%m%d-%H%M%S') AS base FROM c),
    n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY event_id) AS k FROM b)
    SELECT event_id, base || CASE WHEN k = 1 THEN '' ELSE '-' || k END AS capture_name FROM n"""
)
def captured_names(spark, sf_dir):
    """Names of staged archives: label, hour of coming, and a number for those that share both."""
    n = F.col("event_id")
    name = F.concat(F.lit("in "), "event_type", F.when(n % 3 == 0, ".enc").when(n % 3 == 1, ".EN_DEC").otherwise(".zip"))
    e = read(spark, sf_dir, "events").select("event_id", name.alias("name"), F.date_trunc("hour", "ts").alias("ts"))
    return versions.capture_names(e, "name", "ts", ["event_id"]).select("event_id", "capture_name")


_LOW = "(s_suppkey * 7919 % 223 * 16777216 + s_suppkey * 104729 % 65536 * 256)"


@query(
    f"""WITH n AS (SELECT s_suppkey AS network, {_LOW} AS low, {_LOW} + CASE s_suppkey % 3 WHEN 0 THEN 255 WHEN 1 THEN 1048575 ELSE 50331647 END AS high FROM supplier),
    i AS (SELECT DISTINCT ((1 + user_id % 223) * 256 + event_id % 7) * 65536 + user_id % 251 * 256 + 1 + event_id % 5 AS number FROM events)
    SELECT number, network FROM i JOIN n ON number BETWEEN low AND high"""
)
def network_matches(spark, sf_dir):
    """Addresses of events in a table of networks, one for each supplier."""
    k = F.col("s_suppkey").cast("long")
    low = k * 7919 % 223 * 16_777_216 + k * 104_729 % 65_536 * 256
    networks = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("network"), low.alias("low"), (low + F.when(k % 3 == 0, 255).when(k % 3 == 1, 1_048_575).otherwise(50_331_647)).alias("high"))
    ips = event_ips(spark, sf_dir).select(ip_number(F.col("ip")).alias("number")).distinct()
    return networks_of(ips, "number", networks)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_ips(spark, sf_dir)
    return e.select(F.concat(F.when(F.col("event_id") % 9 == 0, "bad").otherwise(""), "ip", F.when(F.col("event_id") % 10 == 0, " ").otherwise("; "), "event_type").alias("value"), "ip", "event_id")


_GOOD = "SELECT concat_ws('.', 1 + user_id % 223, event_id % 7, user_id % 251, 1 + event_id % 5) AS ip, event_type, event_id, user_id FROM events"


@query(f"SELECT DISTINCT ip, event_type AS path FROM ({_GOOD}) WHERE event_id % 9 <> 0 AND event_id % 10 <> 0")
def ip_tuples(spark, sf_dir):
    """Addresses with their paths of lines `ip; path`; what can't be read is left out."""
    return captures.read_ip_tuples(_lines(spark, sf_dir).select("value"))


@query(
    f"""WITH g AS (SELECT *, CASE WHEN event_id % 9 = 0 THEN 'bad' ELSE '' END || ip || CASE WHEN event_id % 10 = 0 THEN ' ' ELSE '; ' END || event_type AS value, event_id % 9 <> 0 AND event_id % 10 <> 0 AS good FROM ({_GOOD}))
    SELECT value FROM g WHERE NOT good OR ip NOT IN (SELECT ip FROM g WHERE user_id % 2 = 0)"""
)
def remaining_tuples(spark, sf_dir):
    """Lines whose address is not completed, and all that can't be read."""
    done = event_ips(spark, sf_dir).where("user_id % 2 = 0").select("ip").distinct()
    return captures.remaining_tuples(_lines(spark, sf_dir).select("value"), done)


@query(f"SELECT ip FROM (SELECT DISTINCT ip FROM ({_GOOD})) ORDER BY CAST(split_part(ip, '.', 1) AS INT), CAST(split_part(ip, '.', 2) AS INT), CAST(split_part(ip, '.', 3) AS INT), CAST(split_part(ip, '.', 4) AS INT) LIMIT 25")
def first_ips(spark, sf_dir):
    return captures.first_ips(event_ips(spark, sf_dir), 25)


@query(
    """SELECT doc_id AS copy_id, 'origin' AS remote, 'fetch' AS direction, 'https://github.com/Owner/R' || (doc_id % 30) AS url, 0 AS ordinal, 'github.com/owner/r' || (doc_id % 30) AS identity_key FROM documents
    UNION ALL SELECT doc_id, 'origin', 'push', 'git@github.com:Owner/P.git', 0, 'github.com/owner/p' FROM documents WHERE doc_id % 2 = 0
    UNION ALL SELECT doc_id, 'up stream', 'fetch', 'https://example.com/x', 0, NULL FROM documents WHERE doc_id % 3 = 0
    UNION ALL SELECT doc_id, 'origin', 'fetch', 'ssh://git@github.com/Owner/Two', 1, 'github.com/owner/two' FROM documents WHERE doc_id % 5 = 0"""
)
def git_remotes(spark, sf_dir):
    """Remotes of configuration texts: sections, quotes, comments and continued lines."""
    return documents.git_remotes(_configs(spark, sf_dir)).withColumn("ordinal", F.col("ordinal").cast("int"))


def _configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, text = F.col("doc_id"), F.lit
    parts = [
        text('[core]\n\turl = https://github.com/not/this\n[remote "origin"]\n\turl = "https://github.com/Owner/R'), (k % 30).cast("string"), text('" ; a comment\n'),
        F.when(k % 2 == 0, "\tpushurl = git@github.com:\\\nOwner/P.git\n").otherwise(""), F.when(k % 3 == 0, '[remote "up stream"]\n\turl = https://example.com/x # there\n').otherwise(""), F.when(k % 5 == 0, '[remote "origin"]\n\tURL = ssh://git@github.com/Owner/Two\n').otherwise(""),
    ]
    return read(spark, sf_dir, "documents").select(k.alias("copy_id"), F.concat(*parts).alias("text"))


@query("SELECT doc_id AS copy_id, 'github.com/owner/r' || (doc_id % 30) AS identity_key FROM documents WHERE doc_id % 5 <> 0")
def primary_remotes(spark, sf_dir):
    """The repository of each copy that has exactly one valid origin."""
    return documents.primary_remote(documents.git_remotes(_configs(spark, sf_dir)))


@query(
    """SELECT concat_ws('.', 1 + user_id % 223, event_id % 7, user_id % 251, 1 + event_id % 5) AS ip, event_id, CASE WHEN event_id % 6 = 5 THEN 'failed' ELSE 'success' END AS provider_status, CASE WHEN event_id % 6 = 5 THEN NULL WHEN event_id % 6 IN (0, 1) THEN 'No' ELSE 'Yes' END AS malicious,
    CASE WHEN event_id % 6 <> 5 THEN event_type END AS country_code, CASE WHEN event_id % 6 <> 5 THEN 'a.b,c' END AS reverse_dns, CASE WHEN event_id % 6 <> 5 THEN '(KR)n/x/y,m' END AS related_actors FROM events"""
)
def normal_ip_reports(spark, sf_dir):
    """Address reports of a provider as rows; a body that is no JSON has failed."""
    n = F.col("event_id")
    detect = F.when(n % 6 == 0, '"normal"').when(n % 6 == 1, "null").otherwise('"odd"')
    body = F.concat(F.when(n % 6 == 5, "{").otherwise(""), F.lit('{"detect":'), detect, F.lit(',"country":"'), "event_type", F.lit('","whois":"w","reverse_dns":[" a.b ","c","a.b",""],"iocs":[],"actors":[{"country":"KR","name":"n","aliases":["x","y"]},{"country":"","name":"m"}]}'))
    reports = event_ips(spark, sf_dir).select(F.concat_ws("/", F.col("event_id").cast("string"), "ip").alias("ip"), body.alias("body"))
    rows = documents.normalize_ip_reports(reports)
    return rows.select(F.substring_index("ip", "/", -1).alias("ip"), F.substring_index("ip", "/", 1).cast("long").alias("event_id"), "provider_status", "malicious", "country_code", F.array_join("reverse_dns", ",").alias("reverse_dns"), F.array_join("related_actors", ",").alias("related_actors"))


@query(
    """SELECT event_id AS query_hash, CASE WHEN event_id % 5 = 0 THEN 'provider_error' WHEN event_id % 5 = 1 THEN 'not_found' ELSE 'success' END AS status, CASE WHEN event_id % 5 > 1 THEN 'ab' || event_id END AS sha256,
    CASE event_id % 5 WHEN 2 THEN 'unknown' WHEN 3 THEN 'no' WHEN 4 THEN 'yes' END AS malicious, CASE WHEN event_id % 5 > 1 THEN 't,u,v' END AS tags FROM events"""
)
def normal_file_reports(spark, sf_dir):
    """File reports of a provider as rows: states, hashes, verdicts and tags."""
    n = F.col("event_id")
    detect = F.when(n % 5 == 2, "null").when(n % 5 == 3, '"normal"').otherwise('"bad"')
    data = F.when(n % 5 < 2, F.lit("null")).otherwise(F.concat(F.lit('{"sha256":" AB'), n.cast("string"), F.lit('","md5":"None","detect":'), detect, F.lit(',"tags":["t"," u"],"threat_types":["u","v"]}')))
    body = F.concat(F.lit('{"result_code":'), F.when(n % 5 == 0, "500").otherwise("200"), F.lit(',"data":'), data, F.lit("}"))
    rows = documents.normalize_file_reports(read(spark, sf_dir, "events").select(n.alias("query_hash"), body.alias("body")))
    return rows.select("query_hash", "status", "sha256", "malicious", F.array_join("tags", ",").alias("tags"))


@query("SELECT event_id AS repository_id, 'o' || user_id AS owner_login, 'User' AS owner_type, CASE WHEN event_id % 3 > 0 THEN event_id % 3 * 10 END AS stars_count, 'MIT' AS license_spdx, event_id % 2 = 0 AS is_fork, CASE WHEN event_id % 2 = 0 THEN 'a/b' END AS parent_full_name FROM events")
def repository_snapshots(spark, sf_dir):
    """Answers about repositories as snapshots; stars that are no number are none."""
    n, text = F.col("event_id"), F.lit
    stars = F.when(n % 3 == 0, "-4").otherwise(((n % 3) * 10).cast("string"))
    body = F.concat(text('{"owner":{"login":"o'), F.col("user_id").cast("string"), text('","type":"User"},"stargazers_count":'), stars, text(',"license":{"spdx_id":"MIT"},"fork":'), (n % 2 == 0).cast("string"), F.when(n % 2 == 0, ',"parent":{"full_name":"a/b"}').otherwise(""), text("}"))
    return documents.normalize_repo_metadata(read(spark, sf_dir, "events").select(n.alias("repository_id"), body.alias("body"))).drop("metadata_hash")


@query("SELECT doc_id AS repository_id, coalesce(text, '') AS text, sha256(coalesce(text, '')) AS content_hash, octet_length(encode(coalesce(text, ''))) AS byte_count FROM documents WHERE doc_id % 10 > 0")
def readme_versions(spark, sf_dir):
    """README answers in base64 as texts; what is no base64 is left out."""
    encoded = F.when(F.col("doc_id") % 10 == 0, "%%%").otherwise(F.base64(F.coalesce("text", F.lit("")).cast("binary")))
    rows = documents.readme_versions(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("repository_id"), encoded.alias("content")))
    return rows.withColumn("byte_count", F.col("byte_count").cast("long"))


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, CASE WHEN event_id % 3 = 0 THEN '''=' ELSE '' END || event_type AS event_type, '[' || user_id || ',' || event_id || ']' AS nested FROM events")
def csv_rows(spark, sf_dir):
    """Rows as they go into a CSV: text that no spreadsheet takes for a formula, nested values as JSON."""
    n = F.col("event_id")
    return exports.csv_ready(read(spark, sf_dir, "events").select("event_id", F.concat(F.when(n % 3 == 0, "=").otherwise(""), "event_type").alias("event_type"), F.array("user_id", n).alias("nested")))


@query(
    """WITH p AS (SELECT doc_id, ['a/b/c.txt', '.h/x', 'y/.z', 'top', 'a/b/c/d/e'][1 + doc_id % 5] AS path FROM documents)
    SELECT doc_id, path, doc_id % 5 NOT IN (1, 2, 4) AS plain, doc_id % 5 NOT IN (2, 4) AS by_name, doc_id % 5 IN (3, 4) AND path = 'top' AS is_top, false AS archive FROM p"""
)
def eligible_paths(spark, sf_dir):
    """Paths within a depth of three and without hidden parts, by both rules."""
    k = (F.col("doc_id") % 5).cast("int")
    path = F.get(F.array(*[F.lit(p) for p in ("a/b/c.txt", ".h/x", "y/.z", "top", "a/b/c/d/e")]), k)
    d = read(spark, sf_dir, "documents").select("doc_id", path.alias("path"))
    return d.select("doc_id", "path", captures.eligible(F.col("path"), 3, False).alias("plain"), captures.eligible(F.col("path"), 3, False, name_only=True).alias("by_name"), captures.eligible(F.col("path"), 0).alias("is_top"), captures.is_archive(F.col("path")).alias("archive"))


@query(
    """WITH s AS (SELECT event_id % 200 AS m, event_type AS identifier, event_id AS place_of FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY place_of, identifier) AS place, count(*) OVER (PARTITION BY m) > 8 AS truncated FROM s)
    SELECT m, identifier, place_of AS "offset", place, truncated FROM r WHERE place <= 8"""
)
def capped_strings(spark, sf_dir):
    """The first eight strings of each match, and whether there were more."""
    s = read(spark, sf_dir, "events").select((F.col("event_id") % 200).alias("m"), F.col("event_type").alias("identifier"), F.col("event_id").alias("offset"))
    return signatures.cap_strings(s, ["m"], 8).withColumn("place", F.col("place").cast("long"))


@query(
    """WITH p AS (SELECT DISTINCT chr(97 + CAST(doc_id % 3 AS INT)) || '/' || chr(97 + CAST(doc_id % 5 AS INT)) || CASE WHEN doc_id % 2 = 0 THEN '/f' || (doc_id % 9) ELSE '' END AS path FROM documents),
    k AS (SELECT path, split_part(path, '/', 1) AS a, split_part(path, '/', 3) <> '' AS deep, split_part(path, '/', 2) AS b, split_part(path, '/', 3) AS c FROM p)
    SELECT path, row_number() OVER (ORDER BY a, deep, b, c) AS place FROM k"""
)
def traversal_places(spark, sf_dir):
    """Paths as a walk meets them: a directory's files before its subdirectories. The paths are as many as their rule makes, whatever the input."""
    k = F.col("doc_id")
    letter = lambda c: F.char(97 + c)
    path = F.concat(letter(k % 3), F.lit("/"), letter(k % 5), F.when(k % 2 == 0, F.concat(F.lit("/f"), (k % 9).cast("string"))).otherwise(""))
    d = read(spark, sf_dir, "documents").select(path.alias("path")).distinct()
    return d.select("path", F.row_number().over(Window.orderBy(indicators.traversal_key(F.col("path")))).cast("long").alias("place"))
