"""Registered queries: reports, store summaries, records and small functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkintel.functions import repositories, strings
from sparkintel.operators import lookups, reports, signatures
from sparkintel.plans.queries import query
from sparkintel.plans.tables import event_ips, read


def _pick(values: list[str], c: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), c.cast("int"))


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of events as lookups: capture (type of event), ip, status, error_code, malicious, country_code, reverse_dns, paths. The first event of an address speaks for it."""
    e = event_ips(spark, sf_dir).withColumn("k", F.col("user_id") % 9)
    per = e.groupBy(F.col("event_type").alias("capture"), "ip").agg(F.min_by("k", F.struct("event_id", "k")).alias("k"), F.array_sort(F.collect_set(F.concat(F.lit("f"), (F.col("event_id") % 5).cast("string")))).alias("paths"))
    status = F.when(F.col("k") < 5, "hit").when(F.col("k") < 7, "miss").when(F.col("k") == 7, "unavailable").otherwise("error")
    return per.select(
        "capture", "ip", status.alias("status"), F.when(F.col("k") == 8, "bad_version").alias("error_code"), F.when(F.col("k") < 2, "Yes").when(F.col("k") == 2, "No").alias("malicious"), F.lit("C*").alias("country_code"), F.when(F.col("k") == 0, F.array(F.lit("a<b"), F.lit("c"))).otherwise(F.array().cast("array<string>")).alias("reverse_dns"), "paths"
    )


_NUM = "(" + " + ".join(f"CAST(split_part(ip, '.', {k}) AS BIGINT) * {256 ** (4 - k)}" for k in range(1, 5)) + ")"
_SEEN = f"""
    e AS (SELECT event_type AS capture, concat_ws('.', 1 + user_id % 223, event_id % 7, user_id % 251, 1 + event_id % 5) AS ip, user_id % 9 AS k, 'f' || (event_id % 5) AS path FROM events),
    p AS (SELECT capture, ip, any_value(k) AS k, list_sort(list(DISTINCT path)) AS paths FROM e GROUP BY capture, ip),
    l AS (SELECT *, CASE WHEN k < 5 THEN 'hit' WHEN k < 7 THEN 'miss' WHEN k = 7 THEN 'unavailable' ELSE 'error' END AS status, array_to_string(paths, '; ') AS links, CASE WHEN k > 4 THEN 3 WHEN k < 2 THEN 0 WHEN k = 2 THEN 2 ELSE 1 END AS rank, {_NUM} AS num FROM p)"""


@query(
    rf"""WITH {_SEEN},
    lines AS (
        SELECT capture, 1 AS section_no, rank, num, '| ' || ip || ' | ' || CASE WHEN k < 2 THEN 'Yes' WHEN k = 2 THEN 'No' ELSE 'not recorded' END || ' | C\* | ' || CASE WHEN k = 0 THEN 'a&lt;b; c' ELSE 'None' END || ' | ' || links || ' |' AS line FROM l WHERE status = 'hit'
        UNION ALL SELECT capture, 2, rank, num, '| ' || ip || ' | ' || links || ' |' FROM l WHERE status = 'miss'
        UNION ALL SELECT capture, 3, rank, num, '| ' || ip || ' | ' || status || ' | ' || CASE WHEN k = 8 THEN 'bad\_version' ELSE 'not recorded' END || ' | ' || links || ' |' FROM l WHERE k > 6
        UNION ALL SELECT capture, 6, rank, num, '### ' || ip || ': IPv4, ' || status || CASE WHEN k = 8 THEN ', bad\_version' ELSE '' END || ', ' || links FROM l
        UNION ALL SELECT capture, 0, n, 0, '- ' || label || ': ' || value FROM (SELECT capture, unnest([1, 2, 3, 4, 5]) AS n,
            unnest(['Unique IPs found', 'IPs with local intelligence', 'IPs without local DB records', 'IPs with incomplete lookups', 'Lookup hits / misses / unavailable / errors']) AS label,
            unnest([CAST(count(*) AS VARCHAR), CAST(count(*) FILTER (k < 5) AS VARCHAR), CAST(count(*) FILTER (k IN (5, 6)) AS VARCHAR), CAST(count(*) FILTER (k > 6) AS VARCHAR), concat_ws(' / ', count(*) FILTER (k < 5), count(*) FILTER (k IN (5, 6)), count(*) FILTER (k = 7), count(*) FILTER (k = 8))]) AS value FROM l GROUP BY capture))
    SELECT capture, section_no, row_number() OVER (PARTITION BY capture, section_no ORDER BY rank, num) AS row_no, line FROM lines"""
)
def ip_report_sections(spark, sf_dir):
    """The report of each capture's addresses, all sections with their lines in order."""
    seen = _seen(spark, sf_dir)
    none = seen.select("capture", F.lit("").alias("path"), F.lit(20).alias("threshold"), F.lit("").alias("code"), F.lit("").alias("message")).where("false")
    return reports.ip_report(seen, none, none).drop("section")


def _file_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of documents as files: capture (source), sha256, md5, status and what a hit says."""
    d = read(spark, sf_dir, "documents").select("source", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    k = F.col("first") % 7
    per = d.groupBy(F.col("source").alias("capture"), F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5")).agg(F.min("doc_id").alias("first"), F.array_sort(F.collect_set(F.concat(F.lit("d"), F.col("doc_id").cast("string")))).alias("paths"))
    status = F.when(k < 3, "hit").when(k == 3, "ambiguous").when(k == 4, "error").otherwise("miss")
    listed = lambda v: F.array(F.lit(v))
    return per.select("capture", "sha256", "md5", status.alias("status"), F.when(k == 4, "odd").alias("error_code"), F.when(k == 0, "sha256").otherwise("md5").alias("match_type"), F.when(k == 3, "multiple_md5_rows").alias("reason"), F.lit("1,2").alias("file_ids"), _pick(["yes", "unknown", "no"], k).alias("malicious"), listed("t").alias("tags"), listed("n").alias("names"), listed("data").alias("magics"), "paths")


@query(
    """WITH p AS (SELECT source AS capture, sha256(coalesce(text, '')) AS sha, md5(coalesce(text, '')) AS md5, min(doc_id) % 7 AS k, list_sort(list(DISTINCT 'd' || doc_id)) AS paths FROM documents GROUP BY source, coalesce(text, '')),
    l AS (SELECT *, array_to_string(paths, '; ') AS links FROM p),
    lines AS (
        SELECT capture, 1 AS section_no, k AS rank, sha, '| ' || sha || ' | ' || md5 || ' | ' || CASE WHEN k = 0 THEN 'SHA-256' ELSE 'MD5 (weak)' END || ' | ' || ['yes', 'unknown', 'no'][k + 1] || ' | t | n | ' || links || ' |' AS line FROM l WHERE k < 3
        UNION ALL SELECT capture, 2, 3, sha, '| ' || sha || ' | ' || md5 || ' | data | ' || links || ' |' FROM l WHERE k > 4
        UNION ALL SELECT capture, 3, 3, sha, '| ' || md5 || ' | ' || sha || ' | 1,2 | multiple\\_md5\\_rows | ' || links || ' |' FROM l WHERE k = 3
        UNION ALL SELECT capture, 4, 3, sha, '| ' || sha || ' | ' || md5 || ' | error | odd | ' || links || ' |' FROM l WHERE k = 4)
    SELECT capture, section_no, row_number() OVER (PARTITION BY capture, section_no ORDER BY rank, sha) AS row_no, line FROM lines"""
)
def file_report_sections(spark, sf_dir):
    """The tables of each source's report of files."""
    files = _file_lookups(spark, sf_dir)
    none = files.select("capture", F.lit("").alias("path"), F.lit("").alias("code"), F.lit("").alias("message")).where("false")
    return reports.file_report(files, none).where("section_no BETWEEN 1 AND 4").drop("section")


@query("SELECT 'p' || user_id AS provider_name, 'failed' AS provider_status, event_type AS error_summary, ts AS fetched_at FROM events WHERE event_type = 'error' ORDER BY ts DESC, 1 LIMIT 5")
def recent_failures(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return reports.recent_failures(e.select(F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("provider_name"), F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("provider_status"), F.col("event_type").alias("error_summary"), F.col("ts").alias("fetched_at")))


@query(
    """SELECT 'files' AS measure, count(*) AS value FROM documents UNION ALL SELECT 'malicious', count(*) FILTER (doc_id % 3 = 0) FROM documents UNION ALL SELECT 'tags', count(*) FROM labels UNION ALL SELECT 'scans', count(*) FROM pages
    UNION ALL SELECT 'visits ' || event_type, count(*) FROM events GROUP BY event_type"""
)
def summary_counts(spark, sf_dir):
    files = read(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "yes").otherwise("no").alias("malicious"))
    return reports.summary_counts(files, read(spark, sf_dir, "labels"), read(spark, sf_dir, "pages"), read(spark, sf_dir, "events").select(F.col("event_type").alias("status")))


@query(
    """SELECT 'ip' AS type, event_id AS id, value, CAST(NULL AS VARCHAR) AS status FROM events WHERE event_type = 'view'
    UNION ALL SELECT 'lookup', event_id, NULL, event_type FROM events WHERE event_type <> 'view'"""
)
def all_records(spark, sf_dir):
    """Records of two kinds in one table."""
    e = read(spark, sf_dir, "events")
    one, other = e.where("event_type = 'view'").select(F.col("event_id").alias("id"), "value"), e.where("event_type <> 'view'").select(F.col("event_id").alias("id"), F.col("event_type").alias("status"))
    return lookups.all_records({"ip": one, "lookup": other})


@query("SELECT DISTINCT doc_id AS file_id FROM documents WHERE doc_id IN (SELECT user_id FROM events WHERE event_id % 4 = 1)")
def files_of_job(spark, sf_dir):
    observations = read(spark, sf_dir, "events").select(F.col("user_id").alias("file_id"), (F.col("event_id") % 4).alias("scan_job_id"))
    return lookups.files_of_job(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id")), observations, 1)


@query("SELECT DISTINCT user_id AS repository_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND event_id % 40 = 0)")
def enrichment_candidates(spark, sf_dir):
    """Repositories without a current finding."""
    e = read(spark, sf_dir, "events").withColumnRenamed("user_id", "repository_id")
    return lookups.needs_enrichment(e.select("repository_id").distinct(), e.where("event_type = 'error' AND event_id % 40 = 0"), "reuse")


@query(
    """SELECT user_id AS file_id, array_to_string(list(provider || '@' || seen ORDER BY seen DESC, provider), ',') AS lookups, array_to_string(list(DISTINCT tag ORDER BY tag), ',') AS tags
    FROM (SELECT user_id, event_type AS provider, max(epoch_us(ts)) AS seen, 't' || event_type AS tag FROM events GROUP BY user_id, event_type) GROUP BY user_id"""
)
def file_children(spark, sf_dir):
    """Children of files as arrays: tags ascending, lookups from the newest."""
    e = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("file_id"), F.col("event_type").alias("provider")).agg(F.max("ts").alias("completed_at"))
    tags = e.select("file_id", F.concat(F.lit("t"), "provider").alias("tag"), F.lit("s").alias("source"))
    names = tags.withColumnRenamed("tag", "file_name").where("false")
    seen = e.select("file_id", F.col("provider").alias("path"), F.col("completed_at").alias("observed_at")).where("false")
    nested = lookups.nest_file_children(names, tags, e.withColumn("status", F.lit("success")), seen)
    told = lambda x: F.concat_ws("@", x["provider"], F.unix_micros(x["completed_at"].cast("timestamp")).cast("string"))
    return nested.select("file_id", F.array_join(F.transform("provider_lookups", told), ",").alias("lookups"), F.array_join("tags.tag", ",").alias("tags"))


_PATHS = ["a/run.exe", "b/.profile", "c/tool", "d/x.PS1", "e.tar.gz", "f/lib.so", "g/notes.txt", "h/app.apk", "i/.hidden.dll", "j/script.py", "k/m.bin"]
_PATH_SQL = "[" + ", ".join(f"'{p}'" for p in _PATHS) + "][1 + doc_id % 11]"
_DESCRIBED = ["PE32+ executable", "ASCII text, with long lines", "JPEG image data", "", "Zip archive data, at least v2.0", "Bourne-Again shell script, ASCII text executable", "data"]
_DESCRIBED_SQL = "[" + ", ".join(f"'{p}'" for p in _DESCRIBED) + "][1 + doc_id % 7]"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: doc_id, path, content (some with a header before the text), description."""
    head = F.when(F.col("doc_id") % 5 == 0, F.unhex(F.lit("4D5A"))).when(F.col("doc_id") % 5 == 1, F.unhex(F.lit("23212F62696E2F7368200A"))).when(F.col("doc_id") % 5 == 2, F.unhex(F.lit("232120200A"))).otherwise(F.unhex(F.lit("")))
    text = F.when(F.col("doc_id") % 5 == 2, F.lit("")).otherwise(F.coalesce("text", F.lit(""))).cast("binary")
    return read(spark, sf_dir, "documents").select("doc_id", _pick(_PATHS, F.col("doc_id") % 11).alias("path"), F.concat(head, text).alias("content"), _pick(_DESCRIBED, F.col("doc_id") % 7).alias("description"))


@query(f"SELECT doc_id, doc_id % 5 < 2 OR starts_with(coalesce(CASE WHEN doc_id % 5 = 2 THEN '' ELSE text END, ''), 'MZ') OR regexp_matches(lower({_PATH_SQL}), '[^/][.](exe|dll|sys|ocx|msi|so|dylib|app|dex|apk|ps1|sh|bash)$') AS candidate FROM documents WHERE NOT starts_with(coalesce(text, ''), '#!')")
def exec_candidates(spark, sf_dir):
    f = _files(spark, sf_dir).join(read(spark, sf_dir, "documents").where(~F.startswith(F.coalesce("text", F.lit("")), F.lit("#!"))).select("doc_id"), "doc_id", "left_semi")
    return f.select("doc_id", signatures.is_exec_candidate(F.col("content"), F.col("path")).alias("candidate"))


@query(
    f"""WITH d AS (SELECT doc_id, {_PATH_SQL} AS path, lower({_DESCRIBED_SQL}) AS t FROM documents),
    x AS (SELECT doc_id, t, '.' || regexp_extract(lower(path), '[^/][.]([^./]+)$', 1) AS ext FROM d),
    y AS (SELECT *, CASE WHEN contains(t, 'pe32') THEN 'magic: pe32' WHEN contains(t, 'bourne-again shell script') THEN 'magic: bourne-again shell script' END AS told, ext IN ('.exe', '.dll', '.so', '.apk', '.ps1') AS named FROM x)
    SELECT doc_id, coalesce(told, CASE WHEN named AND (trim(split_part(t, ',', 1)) IN ('', 'data', 'ascii text') OR (ext = '.apk' AND starts_with(t, 'zip archive data'))) THEN 'extension fallback: ' || ext END) AS strict, coalesce(told, CASE WHEN named THEN 'extension fallback: ' || ext END) AS loose FROM y"""
)
def exec_classes(spark, sf_dir):
    """Why files are taken for executables: by description, then extension, strictly and loosely."""
    return _files(spark, sf_dir).select("doc_id", signatures.classify_exec(F.col("description"), F.col("path")).alias("strict"), signatures.classify_exec_loose(F.col("description"), F.col("path")).alias("loose"))


@query(
    f"""WITH d AS (SELECT doc_id, {_PATH_SQL} AS path, CASE WHEN doc_id % 5 = 2 THEN '' ELSE coalesce(text, '') END AS text FROM documents)
    SELECT doc_id FROM d WHERE regexp_full_match(split_part(path, '/', -1), '[a-z]+[.].*|tool') AND regexp_matches(path, '^[a-h]/')
    AND (doc_id % 5 IN (0, 1) OR starts_with(text, 'MZ') OR regexp_matches(lower(path), '[^/][.](ps1|bat|cmd|sh|py|pl|php|rb|js|vbs|exe|dll|sys|bin|elf|so|dylib)$'))"""
)
def scan_candidates(spark, sf_dir):
    """Files for the scanner: executables of which the name fits a glob and the path a regular expression."""
    d = read(spark, sf_dir, "documents")
    files = _files(spark, sf_dir).withColumn("size", F.octet_length("content"))
    kept = signatures.match_candidates(files, "path", "size", ["[a-z]*.*", "tool"], ["^[a-h]/"], selector="exec-only")
    return kept.join(d.select("doc_id"), "doc_id", "left_semi").select("doc_id")


@query(
    r"""WITH p AS (SELECT p_partkey, ['a b/c', '..', '.x.', 'ok-1', '__', 'é'][1 + p_partkey % 6] || CASE WHEN p_partkey % 6 IN (1, 4) THEN '' ELSE p_name END AS v FROM part), n AS (SELECT *, regexp_replace(v, '[^A-Za-z0-9._-]', '_', 'g') AS s, regexp_replace(regexp_replace(v, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS t FROM p)
    SELECT p_partkey, CASE WHEN s IN ('', '.', '..') THEN 'capture' ELSE s END AS label, CASE WHEN t = '' THEN 'scan' ELSE t END AS part, 'x' || p_partkey AS archive, CASE WHEN contains(v, '/') THEN v ELSE '/base/' || v END AS shown FROM n"""
)
def file_names(spark, sf_dir):
    """Names made safe by both rules, archive labels and shown paths."""
    k = F.col("p_partkey")
    v = F.concat(_pick(["a b/c", "..", ".x.", "ok-1", "__", "é"], k % 6), F.when((k % 6).isin(1, 4), "").otherwise(F.col("p_name")))
    archive = F.concat(F.lit("x"), k.cast("string"), _pick([".en_dec", ".ENC", ""], k % 3))
    shown = F.concat(F.when(F.contains(v, F.lit("/")), "/root/base/").otherwise("/base/"), v)
    return read(spark, sf_dir, "part").select("p_partkey", strings.sanitize_name(v).alias("label"), strings.safe_part(v).alias("part"), strings.capture_label(archive).alias("archive"), strings.display_path(shown, "/root/base").alias("shown"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN 'github.com/owner/r' || (doc_id % 40) END AS identity_key FROM documents")
def repository_references(spark, sf_dir):
    """Repositories by address, by `owner/name`, and by neither."""
    k = F.col("doc_id")
    name = F.concat(F.lit("Owner/R"), (k % 40).cast("string"))
    ref = F.when(k % 3 == 0, F.concat(F.lit("/"), name, F.lit("/"))).when(k % 3 == 1, F.concat(F.lit("https://github.com/"), name, F.lit(".git"))).otherwise(F.concat(name, F.lit("/more")))
    return read(spark, sf_dir, "documents").select("doc_id", repositories.repo_ref(ref).alias("identity_key"))


@query("SELECT event_id, event_id % 3 <> 1 AS good_id, event_id % 4 <> 2 AS good_time, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS told, strftime(ts, '%y%m%d-%H%M%S') AS stamp, user_id || ' / ' || event_id AS shares FROM events")
def stamps_and_checks(spark, sf_dir):
    """Canonical UUIDs and times, and the stamps of reports and staged archives."""
    n = F.col("event_id")
    name = F.concat(F.lit("0000000a-0000-0000-0000-"), F.lpad(n.cast("string"), 12, "0"))
    time = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), _pick(["Z", ".5Z", "+00:00", "Z"], n % 4))
    return read(spark, sf_dir, "events").select("event_id", strings.is_uuid(F.when(n % 3 == 1, F.upper(name)).otherwise(name)).alias("good_id"), strings.is_utc_time(time).alias("good_time"), strings.utc_stamp(F.col("ts")).alias("told"), strings.staging_stamp(F.col("ts")).alias("stamp"), strings.outcome_shares(F.col("user_id"), n).alias("shares"))


@query(
    r"""WITH r AS (SELECT *, CASE p_partkey % 6 WHEN 1 THEN p_name || '<*>"' WHEN 2 THEN p_name || chr(10) WHEN 3 THEN p_name || '&\' WHEN 4 THEN chr(8238) || p_name || chr(133) || chr(8203) WHEN 5 THEN '[' || p_name || '](x' || chr(39) || 'y)' || chr(8233) END AS raw FROM part),
    e AS (SELECT *, replace(replace(replace(replace(replace(raw, chr(10), '\u000a'), chr(8238), '\u202e'), chr(133), '\u0085'), chr(8203), '\u200b'), chr(8233), '\u2029') AS spelled FROM r)
    SELECT p_partkey, coalesce(replace(replace(replace(replace(replace(regexp_replace(spelled, '([\\`*_{}\[\]()#+\-.!|~])', '\\\1', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;'), 'not recorded') AS shown,
    CASE p_partkey % 3 WHEN 0 THEN 'ab' || p_partkey END AS hash, 'https://host/' || p_partkey AS url, CASE p_partkey % 2 WHEN 0 THEN 'a ' || p_name ELSE '' END AS terms FROM e"""
)
def text_guards(spark, sf_dir):
    """Escapes for Markdown, hashes in one form, addresses without credentials, and terms of JSON lists."""
    k, name = F.col("p_partkey"), F.col("p_name")
    shown = F.when(k % 6 == 1, F.concat(name, F.lit('<*>"'))).when(k % 6 == 2, F.concat(name, F.lit("\n"))).when(k % 6 == 3, F.concat(name, F.lit("&\\")))
    shown = shown.when(k % 6 == 4, F.concat(F.lit("\u202e"), name, F.lit("\x85\u200b"))).when(k % 6 == 5, F.concat(F.lit("["), name, F.lit("](x'y)\u2029")))
    digest = F.when(k % 3 == 0, F.concat(F.lit(" AB"), k.cast("string"), F.lit(" "))).when(k % 3 == 1, F.lit("None")).otherwise(F.lit(" "))
    listed = F.when(k % 2 == 0, F.to_json(F.array(F.lit("a"), name))).otherwise("[broken")
    return read(spark, sf_dir, "part").select("p_partkey", strings.md_escape(shown).alias("shown"), strings.normalize_hash(digest).alias("hash"), strings.redact_url(F.concat(F.lit("https://u:p@host/"), k.cast("string"))).alias("url"), strings.terms(listed).alias("terms"))
