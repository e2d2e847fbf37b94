"""Registered queries over the given tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkintel.functions.addresses import RESERVED, extract_ips, extract_ips_loose, ip_number
from sparkintel.functions.repositories import repository_key, repository_key_lenient, repository_tokens
from sparkintel.operators import indicators, lookups, versions
from sparkintel.plans.tables import event_ips, read, repository_urls, texts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}"


def _number(ip: str) -> str:
    return "(" + " + ".join(f"CAST(split_part({ip}, '.', {k}) AS BIGINT) * {256 ** (4 - k)}" for k in range(1, 5)) + ")"


_NETWORKS = [ipaddress.ip_network(n) for n in RESERVED]
_RESERVED = lambda ip: "(" + " OR ".join(f"{_number(ip)} BETWEEN {int(n.network_address)} AND {int(n.broadcast_address)}" for n in _NETWORKS) + ")"
_TEXTS = "SELECT 'documents/' || doc_id AS path, coalesce(text, '') AS text FROM documents UNION ALL SELECT 'pages/' || page_id, coalesce(html, '') FROM pages"
_STRICT = rf"""
    files AS ({_TEXTS}),
    tokens AS (SELECT path, unnest(regexp_extract_all(text, '[0-9A-Za-z:.%\[\]_-]+')) AS t FROM files),
    bodies AS (SELECT path, regexp_replace(t, '\]$', '') AS b FROM tokens WHERE length(t) <= 110),
    found AS (SELECT DISTINCT path, split_part(b, ':', 1) AS ip FROM bodies
              WHERE regexp_full_match(b, '{_V4}') OR (regexp_full_match(b, '{_V4}:[0-9]{{1,5}}') AND TRY_CAST(split_part(b, ':', 2) AS INT) BETWEEN 1 AND 65535)),
    observed AS (SELECT path, ip FROM found WHERE NOT {_RESERVED('ip')})"""
_EVENT_IPS = "SELECT event_id, user_id, event_type, ts, concat_ws('.', 1 + user_id % 223, event_id % 7, user_id % 251, 1 + event_id % 5) AS ip FROM events"


@query(f"WITH {_STRICT} SELECT path, ip, {_number('ip')} AS ip_num FROM observed")
def ip_observations(spark, sf_dir):
    """Strict addresses of every file, of both versions, reserved networks left out; ip_num is null for v6, which the SQL does not know."""
    df = texts(spark, sf_dir)
    return extract_ips(df, F.col("text"), F.col("path"), v6=True).select("path", "ip", ip_number(F.col("ip")).alias("ip_num"))


def _intel(spark, sf_dir):
    """Entities of every third user's addresses: the last event of each address speaks for it."""
    e = event_ips(spark, sf_dir).where("user_id % 3 = 0")
    last = e.groupBy("ip").agg(F.max("event_id").alias("event_id"))
    country = F.when(F.col("event_id") % 4 == 0, "").otherwise(F.concat(F.lit("C"), (F.col("event_id") % 9).cast("string")))
    verdict = F.when(F.col("event_id") % 5 == 0, "Yes").when(F.col("event_id") % 5 == 1, "No").when(F.col("event_id") % 50 == 2, "Maybe")
    return last.select("ip", F.when(F.col("event_id") % 40 == 3, 6).otherwise(4).alias("ip_version"), country.alias("country_code"), F.lit("").alias("whois"), verdict.alias("malicious"), "event_id")


_INTEL = f"""
    ev AS ({_EVENT_IPS}),
    last AS (SELECT ip, max(event_id) AS event_id FROM ev WHERE user_id % 3 = 0 GROUP BY ip),
    intel AS (SELECT ip, CASE WHEN event_id % 40 = 3 THEN 6 ELSE 4 END AS ip_version, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'C' || (event_id % 9) END AS country_code,
                     CASE WHEN event_id % 5 = 0 THEN 'Yes' WHEN event_id % 5 = 1 THEN 'No' WHEN event_id % 50 = 2 THEN 'Maybe' END AS malicious, event_id FROM last),
    providers AS (SELECT ip, CASE WHEN event_id % 7 = 0 THEN 'failed' WHEN event_id % 7 = 1 THEN 'not_found' ELSE 'success' END AS state FROM ev),
    told AS (SELECT ip, bool_or(state = 'success') AS works FROM providers GROUP BY ip),
    judged AS (SELECT a.ip, CASE WHEN i.ip IS NULL THEN 'miss' WHEN i.ip_version <> 4 OR i.malicious = 'Maybe' THEN 'error'
                      WHEN NOT works AND nullif(i.country_code, '') IS NULL AND i.malicious IS NULL THEN 'miss' ELSE 'hit' END AS status, country_code, malicious
               FROM (SELECT DISTINCT ip FROM ev) a LEFT JOIN intel i USING (ip) LEFT JOIN told USING (ip))"""


def _ip_statuses(spark, sf_dir):
    e = event_ips(spark, sf_dir)
    state = F.when(F.col("event_id") % 7 == 0, "failed").when(F.col("event_id") % 7 == 1, "not_found").otherwise("success")
    return lookups.lookup_ips(e, _intel(spark, sf_dir), e.select("ip", state.alias("provider_status")))


@query(f"WITH {_INTEL} SELECT ip, status, CASE WHEN status = 'hit' THEN country_code END AS country_code, CASE WHEN status = 'hit' THEN malicious END AS malicious FROM judged")
def ip_lookup(spark, sf_dir):
    """Distinct observed addresses against intelligence, with all outcomes."""
    return _ip_statuses(spark, sf_dir)


@query(f"WITH {_INTEL} SELECT count(*) FILTER (status = 'hit') AS hit, count(*) FILTER (status = 'miss') AS miss, count(*) FILTER (status = 'ambiguous') AS ambiguous, count(*) FILTER (status = 'unavailable') AS unavailable, count(*) FILTER (status = 'error') AS error FROM judged")
def ip_lookup_counts(spark, sf_dir):
    return lookups.lookup_counts(_ip_statuses(spark, sf_dir))


@query(
    f"""WITH {_INTEL} SELECT ip, status, row_number() OVER (ORDER BY CASE WHEN status <> 'hit' THEN 4 WHEN malicious = 'Yes' THEN 1 WHEN malicious IS NULL THEN 2 ELSE 3 END, {_number('ip')}) AS line FROM judged
    QUALIFY line <= 50"""
)
def ip_report_top(spark, sf_dir):
    """The first 50 lines of the report: by verdict, then by number. Top-k, so no full sort."""
    ranked = lookups.rank_verdicts(_ip_statuses(spark, sf_dir), ["Yes", "", "No"], ip_number(F.col("ip"))).limit(50)
    return ranked.select("ip", "status", F.row_number().over(Window.orderBy("rank", ip_number(F.col("ip")))).cast("long").alias("line"))


@query(f"WITH {_INTEL} SELECT ip FROM judged WHERE status <> 'hit'")
def missing_ips(spark, sf_dir):
    return lookups.missing_indicators(event_ips(spark, sf_dir), _ip_statuses(spark, sf_dir), "ip")


@query(
    rf"""WITH files AS ({_TEXTS}),
    tokens AS (SELECT path, unnest(regexp_extract_all(text, '[A-Za-z0-9_.:%-]+')) AS t FROM files),
    pieces AS (SELECT path, unnest(regexp_split_to_array(t, '[^0-9A-Za-z_.]')) AS p FROM tokens),
    found AS (SELECT DISTINCT path, unnest(regexp_extract_all(' ' || replace(p, '.', ' . ') || ' ', ' {_OCTET} \. {_OCTET} \. {_OCTET} \. {_OCTET} ')) AS m FROM pieces)
    SELECT DISTINCT path, replace(replace(m, ' ', ''), '..', '.') AS ip FROM found WHERE NOT {_RESERVED("replace(m, ' ', '')")}"""
)
def ip_observations_loose(spark, sf_dir):
    """Addresses of the loose dialect."""
    df = texts(spark, sf_dir).where(F.col("text").rlike("[0-9][.][0-9]"))
    return df.select("path", F.explode(extract_ips_loose(F.col("text"))).alias("ip"))


@query(f"SELECT user_id, 4 AS distinct_at_least FROM ({_EVENT_IPS}) GROUP BY user_id HAVING count(DISTINCT ip) > 3")
def ip_singularities(spark, sf_dir):
    return indicators.singular_files(event_ips(spark, sf_dir), ["user_id"], "ip", 3)


@query(f"WITH e AS (SELECT *, event_id % 17 AS part FROM ({_EVENT_IPS})) SELECT event_id, ip FROM e WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.user_id = e.user_id AND x.part = e.part GROUP BY x.user_id HAVING count(DISTINCT x.ip) > 3)")
def ip_observations_without_singular(spark, sf_dir):
    """Observations of the files (users, in seventeen parts) that have three addresses at most."""
    e = event_ips(spark, sf_dir).withColumn("part", F.col("event_id") % 17)
    return indicators.without_singular(e, ["user_id", "part"], "ip", 3).select("event_id", "ip")


@query(
    f"""WITH e AS (SELECT DISTINCT event_type, user_id % 50 AS file, ip FROM ({_EVENT_IPS})),
    n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY file, {_number('ip')}) AS ordinal FROM e)
    SELECT event_type, file, ip, ordinal, max(ordinal) OVER (PARTITION BY event_type) >= 100 AS truncated FROM n WHERE ordinal <= 100"""
)
def capped_observations(spark, sf_dir):
    """A hundred observations of each capture in traversal order."""
    e = event_ips(spark, sf_dir).select("event_type", (F.col("user_id") % 50).alias("file"), "ip").distinct()
    return indicators.cap_observations(e, "event_type", [F.col("file"), ip_number(F.col("ip"))], 100).select("event_type", "file", "ip", F.col("ordinal").cast("long"), "truncated")


@query(f"SELECT ip, count(DISTINCT event_type) AS n_paths, min(event_type) AS first_path, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS paths FROM ({_EVENT_IPS}) GROUP BY ip")
def evidence_paths(spark, sf_dir):
    return indicators.evidence_paths(event_ips(spark, sf_dir), ["ip"], "event_type")


@query(f"SELECT ip, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM ({_EVENT_IPS}) GROUP BY ip")
def last_observation(spark, sf_dir):
    return indicators.dedupe_last(event_ips(spark, sf_dir).select("ip", "event_id", "event_type"), ["ip"], ["event_id"])


_KEY = "'github.com/owner' || source || '/repo-' || (doc_id % 50)"


_PART = "[A-Za-z0-9][A-Za-z0-9_.-]{0,99}"
_URL = """'Owner' || source AS o, 'repo-' || (doc_id % 50) AS r"""
_SPELLED = "CASE doc_id % 5 WHEN 0 THEN 'https://github.com/' || o || '/' || r || '.git' WHEN 1 THEN 'git@github.com:' || o || '/' || r WHEN 2 THEN 'ssh://git@github.com:22/' || o || '/' || r || '.git' WHEN 3 THEN 'github.com/' || o || '/' || r || '/' ELSE 'https://github.com/' || o || '/' || r || '/issues' END"
_STRICT_FORM = f"(?:https?://github[.]com/|git@github[.]com:|ssh://git@github[.]com(?::[0-9]{{1,5}})?/|github[.]com/)({_PART})/({_PART}?)(?:[.]git)?/?"
_LENIENT_FORM = f"(?:https?://github[.]com/|git@github[.]com:|ssh://git@github[.]com(?::(?:22|80|443))?/)({_PART})/({_PART}?)(?:[.]git)?/?"


def _keyed(form: str) -> str:
    return f"CASE WHEN regexp_full_match(url, '{form}') THEN lower('github.com/' || regexp_extract(url, '^{form}$', 1) || '/' || regexp_extract(url, '^{form}$', 2)) END"


@query(f"WITH n AS (SELECT doc_id, {_URL} FROM documents), u AS (SELECT doc_id, {_SPELLED} AS url FROM n) SELECT doc_id, {_keyed(_STRICT_FORM)} AS strict_key, {_keyed(_LENIENT_FORM)} AS lenient_key FROM u")
def repository_keys(spark, sf_dir):
    urls = repository_urls(spark, sf_dir)
    return urls.select("doc_id", repository_key(F.col("url")).alias("strict_key"), repository_key_lenient(F.col("url")).alias("lenient_key"))


@query(
    f"""WITH u AS (SELECT source, doc_id, {_KEY} AS identity_key, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE doc_id % 5 < 4)
    SELECT source, identity_key, count(*) AS occurrence_count, min(doc_id) AS first_doc FROM u GROUP BY source, identity_key"""
)
def repository_observations(spark, sf_dir):
    """Occurrences of each repository in each source; each document's address stands in a text of its own."""
    urls = repository_urls(spark, sf_dir).join(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    found = repository_tokens(urls.withColumn("text", F.concat(F.lit("see "), F.col("url"), F.lit(" !"))), F.col("text"), F.col("source"), F.col("doc_id"))
    per = indicators.repo_observations(found.withColumn("offset", F.col("doc_id") * 100 + F.col("offset")), ["source"])
    return per.select("source", "identity_key", "occurrence_count", F.floor(F.col("first_offset") / 100).alias("first_doc"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha256, md5(coalesce(text, '')) AS md5, octet_length(encode(coalesce(text, ''))) AS size FROM documents")
def file_hashes(spark, sf_dir):
    content = F.coalesce("text", F.lit("")).cast("binary")
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(content, 256).alias("sha256"), F.md5(content).alias("md5"), F.octet_length(content).cast("long").alias("size"))


@query(
    """WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS sha256, md5(coalesce(text, '')) AS md5 FROM documents),
    files AS (SELECT DISTINCT ON (sha256) doc_id AS file_id, sha256 AS h, md5 AS m FROM d ORDER BY sha256, doc_id),
    known AS (SELECT file_id, h AS sha256_hash, m AS md5_hash FROM files WHERE file_id % 3 = 0
              UNION ALL SELECT file_id + 1000000, NULL, m FROM files WHERE file_id % 3 = 1 AND file_id % 7 < 5
              UNION ALL SELECT file_id + 2000000, CASE WHEN file_id % 2 = 0 THEN sha256('x' || file_id) END, m FROM files WHERE file_id % 3 = 1 AND file_id % 7 IN (0, 5)),
    asked AS (SELECT DISTINCT sha256, md5 FROM d),
    one AS (SELECT a.*, k.file_id AS sha_id FROM asked a LEFT JOIN known k ON k.sha256_hash = a.sha256),
    by_md5 AS (SELECT md5_hash, count(DISTINCT file_id) AS n, string_agg(DISTINCT CAST(file_id AS VARCHAR), ',' ORDER BY CAST(file_id AS VARCHAR)) AS ids, max(sha256_hash) AS other FROM known GROUP BY md5_hash)
    SELECT sha256, md5, CASE WHEN sha_id IS NOT NULL THEN 'hit' WHEN n IS NULL THEN 'miss' WHEN n > 1 OR other <> sha256 THEN 'ambiguous' ELSE 'hit' END AS status,
           CASE WHEN sha_id IS NOT NULL THEN NULL WHEN n > 1 THEN 'multiple_md5_rows' WHEN other <> sha256 THEN 'conflicting_sha256' END AS reason
    FROM one LEFT JOIN by_md5 ON by_md5.md5_hash = md5"""
)
def file_lookup(spark, sf_dir):
    """Files by SHA-256, then by MD5, with ambiguity. Known files are made of the corpus itself."""
    d = file_hashes(spark, sf_dir)
    files = d.groupBy("sha256", "md5").agg(F.min("doc_id").alias("file_id"))
    none = F.lit(None).cast("string")
    known = (
        files.where("file_id % 3 = 0").select("file_id", F.col("sha256").alias("sha256_hash"), F.col("md5").alias("md5_hash"))
        .union(files.where("file_id % 3 = 1 AND file_id % 7 < 5").select(F.col("file_id") + 1000000, none, "md5"))
        .union(files.where("file_id % 3 = 1 AND file_id % 7 IN (0, 5)").select(F.col("file_id") + 2000000, F.when(F.col("file_id") % 2 == 0, F.sha2(F.concat(F.lit("x"), F.col("file_id").cast("string")), 256)), "md5"))
    )
    return lookups.lookup_files(d, known.withColumn("malicious", F.lit("unknown"))).select("sha256", "md5", "status", "reason")


@query("SELECT sha256(coalesce(text, '')) AS sha256, count(*) AS n_paths, min('documents/' || lpad(CAST(doc_id AS VARCHAR), 12, '0')) AS first_path FROM documents GROUP BY 1")
def file_evidence(spark, sf_dir):
    """Paths of each distinct file, without gathering them: the number and the first."""
    path = F.concat(F.lit("documents/"), F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    return read(spark, sf_dir, "documents").groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256")).agg(F.count(F.lit(1)).alias("n_paths"), F.min(path).alias("first_path"))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def latest_snapshot(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return versions.latest_by(e, ["user_id"], ["ts", "event_id"]).drop("ts")


@query(
    """SELECT user_id, arg_max(props, event_id) FILTER (event_type = 'click') AS corrected_click, arg_max(props, event_id) FILTER (event_type = 'view') AS corrected_view FROM events
    GROUP BY user_id"""
)
def corrections_overlay(spark, sf_dir):
    """The last correction of each field of each repository, as columns."""
    e = read(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("field_path"), F.col("props").alias("replacement"), F.col("event_id").alias("id"))
    return versions.effective_corrections(e, ["user_id"], ["click", "view"])


@query("SELECT event_id AS id, coalesce(lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY event_id), -1) AS supersedes_id FROM events")
def superseded_corrections(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("field_path"), F.col("event_id").alias("id"))
    return versions.supersedes(e, ["user_id"]).select("id", F.coalesce("supersedes_id", F.lit(-1)).alias("supersedes_id"))


@query(
    """WITH old AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version FROM events WHERE event_type = 'view'),
    top AS (SELECT user_id, max(version) AS top FROM old GROUP BY user_id)
    SELECT event_id, coalesce(top, 0) + row_number() OVER (PARTITION BY e.user_id ORDER BY event_id) AS version FROM events e LEFT JOIN top USING (user_id) WHERE event_type = 'click'"""
)
def assigned_versions(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    old = e.where("event_type = 'view'").withColumn("version", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    return versions.assign_versions(old, e.where("event_type = 'click'"), "user_id", ["event_id"]).select("event_id", F.col("version").cast("long"))


@query("SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY user_id")
def seen_bounds(spark, sf_dir):
    return versions.seen_bounds(read(spark, sf_dir, "events"), ["user_id"], "ts")


@query(
    """WITH f AS (SELECT event_id AS finding_id, user_id AS repository_id, 's' || event_id AS summary, CASE WHEN event_type = 'view' THEN 'deterministic' ELSE 'model' END AS provenance FROM events WHERE event_type IN ('view', 'click')),
    cur AS (SELECT repository_id, max(finding_id) AS finding_id FROM f GROUP BY repository_id),
    snap AS (SELECT user_id AS repository_id, arg_max('o' || (event_id % 5), (ts, event_id)) AS owner_login, arg_max(event_id % 100, (ts, event_id)) AS stars_count FROM events WHERE event_type = 'purchase' GROUP BY user_id),
    people AS (SELECT user_id AS repository_id, string_agg(DISTINCT 'p' || (event_id % 4), ',' ORDER BY 'p' || (event_id % 4)) AS people FROM events WHERE event_type = 'signup' GROUP BY user_id)
    SELECT r.repository_id, 'k/' || r.repository_id AS identity_key, summary, owner_login, stars_count, coalesce(people, '') AS people,
           CASE WHEN cur.finding_id IS NULL THEN 'not-enriched' WHEN provenance = 'deterministic' THEN 'deterministic-only' ELSE 'ready' END AS status
    FROM (SELECT DISTINCT user_id AS repository_id FROM events) r LEFT JOIN cur USING (repository_id) LEFT JOIN f USING (finding_id) LEFT JOIN snap ON snap.repository_id = r.repository_id LEFT JOIN people ON people.repository_id = r.repository_id"""
)
def project_cards(spark, sf_dir):
    """Cards of users as repositories: their events are findings, snapshots and people."""
    e = read(spark, sf_dir, "events")
    repos = e.select(F.col("user_id").alias("repository_id")).distinct().withColumn("identity_key", F.concat(F.lit("k/"), F.col("repository_id").cast("string")))
    findings = e.where("event_type IN ('view', 'click')").select(F.col("event_id").alias("id"), F.col("user_id").alias("repository_id"), F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("summary"), F.when(F.col("event_type") == "view", "deterministic").otherwise("model").alias("provenance"))
    current = findings.groupBy("repository_id").agg(F.max("id").alias("finding_id"))
    snaps = e.where("event_type = 'purchase'").select(F.col("user_id").alias("repository_id"), F.col("ts").alias("captured_at"), F.col("event_id").alias("id"), F.concat(F.lit("o"), (F.col("event_id") % 5).cast("string")).alias("owner_login"), F.lit("User").alias("owner_type"), (F.col("event_id") % 100).alias("stars_count"))
    people = e.where("event_type = 'signup'").select(F.col("user_id").alias("repository_id"), F.concat(F.lit("p"), (F.col("event_id") % 4).cast("string")).alias("display_name"))
    return versions.project_cards(repos, current, findings, snaps, people).drop("owner_type")


@query("WITH r AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_type IN ('view', 'click', 'purchase')) SELECT user_id FROM r GROUP BY user_id HAVING count(*) = 3")
def completed_by_all(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("provider"), F.lit("success").alias("provider_status"))
    return versions.is_completed(e, "user_id", ["view", "click", "purchase"])


@query("SELECT user_id, event_id % 40 AS unit FROM events WHERE event_type = 'view' EXCEPT SELECT user_id, event_id % 40 FROM events WHERE event_type = 'click'")
def new_units(spark, sf_dir):
    """Units (users, in forty parts) that are there and not known."""
    e = read(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 40).alias("unit"), "event_type")
    return versions.new_units(e.where("event_type = 'view'"), e.where("event_type = 'click'"), ["user_id", "unit"])


@query("WITH c AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'view') SELECT user_id FROM c WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'click') OR user_id IN (SELECT user_id FROM events WHERE event_type = 'error')")
def pending_units(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return versions.pending_units(e.where("event_type = 'view'"), e.where("event_type = 'click'"), e.where("event_type = 'error'"), ["user_id"])


@query(
    """WITH l AS (SELECT user_id AS file_id, event_type AS provider, CASE WHEN event_id % 2 = 0 THEN 'success' ELSE 'failed' END AS status, ts, event_id FROM events),
    last AS (SELECT file_id, provider, arg_max(status, (ts, event_id)) AS status, max(ts) AS ts FROM l GROUP BY file_id, provider)
    SELECT file_id, provider FROM last WHERE ts + CASE WHEN status = 'success' THEN INTERVAL 7 DAY ELSE INTERVAL 12 HOUR END <= (SELECT max(ts) FROM events)"""
)
def due_lookups(spark, sf_dir):
    """Lookups whose time to live has ended by the time of the last event."""
    e = read(spark, sf_dir, "events")
    tries = e.select(F.col("user_id").alias("file_id"), F.col("event_type").alias("provider"), F.when(F.col("event_id") % 2 == 0, "success").otherwise("failed").alias("status"), F.col("ts").alias("completed_at"), F.col("event_id").alias("id"))
    now = e.agg(F.max("ts")).first()[0]
    return versions.due_lookups(tries.select("file_id", "provider").distinct(), tries, F.lit(now), 7, 12)
