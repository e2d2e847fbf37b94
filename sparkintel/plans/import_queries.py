"""Registered queries: whole stores merged, versions, pointers and corrections."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkintel.operators import change_sets, import_sets, imports, merges, stores
from sparkintel.plans.queries import ORACLE_SQL, query
from sparkintel.plans.tables import read
from sparkintel.sources.exports import describe_version, scratch


def _name(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), c.cast("string"))


def _digest(c: Column) -> Column:
    return F.sha2(_name("snapshot", c), 256)


def _ip_tables(spark: SparkSession, sf_dir: str) -> tuple[imports.Store, imports.Store]:
    """Addresses of users in a store (snapshot 0) and five snapshots, the second of which is recorded already, and the third comes twice."""
    e = read(spark, sf_dir, "events").withColumn("s", F.col("event_id") % 6)
    ip = F.concat_ws(".", *[x.cast("string") for x in (1 + F.col("user_id") % 200, F.col("user_id") % 7, F.col("user_id") % 11, F.lit(9))])
    at = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd HH:mm:ss")
    per = e.groupBy("s", ip.alias("ip")).agg(F.max("event_id").alias("n"))
    country = F.when(F.col("n") % 3 > 0, _name("C", F.col("n") % 9)).otherwise("")
    verdict = F.when(F.col("n") % 5 == 0, "Yes").when(F.col("n") % 5 == 1, "No")
    entities = per.select("s", "ip", F.lit(4).alias("ip_version"), country.alias("country_code"), F.when(F.col("n") % 4 == 0, _name("w", F.col("n"))).alias("whois"), verdict.alias("malicious"), at(F.col("n") % 1000).alias("first_seen"), at(F.col("n") * 7 % 5000).alias("last_updated"))
    dns = e.select("s", ip.alias("ip"), _name("d", F.col("event_id") % 4).alias("domain"), at(F.col("event_id")).alias("first_seen")).groupBy("s", "ip", "domain").agg(F.max("first_seen").alias("first_seen"))
    none = lambda c: dns.where("false").withColumnRenamed("domain", c)
    runs = e.select("s").distinct().select("s", F.lit(1).alias("run_id"), F.lit("/a/path").alias("input_file"))
    results = per.select("s", F.lit(1).alias("run_id"), "ip", F.lit("success").alias("provider_status"))
    tables = {"entities": entities, "reverse_dns": dns, "related_iocs": none("ioc"), "related_actors": none("actor"), "runs": runs, "results": results}
    store = {k: (df.where("s = 0") if k not in ("runs", "results") else df.where("s = 0").withColumn("source_sha256", _digest(F.col("s")))).drop("s") for k, df in tables.items()}
    store["ledger"] = spark.range(1).select(_digest(F.lit(2)).alias("source_sha256"))
    snapshots = {k: df.where("s > 0").withColumn("source_sha256", _digest(F.col("s"))).drop("s") for k, df in tables.items()}
    listed = e.select("s").distinct().where("s > 0")
    snapshots["snapshots"] = listed.select(_digest(F.col("s")).alias("source_sha256"), F.col("s").alias("import_seq")).union(listed.where("s = 3").select(_digest(F.col("s")), F.lit(9).cast("long")))
    return store, snapshots


_IP = """
    e AS (SELECT *, event_id % 6 AS s, concat_ws('.', 1 + user_id % 200, user_id % 7, user_id % 11, 9) AS ip FROM events),
    per AS (SELECT s, ip, max(event_id) AS n FROM e GROUP BY s, ip),
    ent AS (SELECT s, ip, CASE WHEN n % 3 > 0 THEN 'C' || (n % 9) END AS country, CASE WHEN n % 4 = 0 THEN 'w' || n END AS whois, CASE n % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS v, n % 1000 AS first_seen, n * 7 % 5000 AS updated,
                   row_number() OVER (PARTITION BY ip ORDER BY s) AS k FROM per WHERE s <> 2),
    f AS (SELECT ip, k, country, whois, updated FROM ent WHERE k = 1
          UNION ALL SELECT x.ip, x.k, CASE WHEN x.updated > f.updated THEN coalesce(x.country, f.country) ELSE coalesce(f.country, x.country) END, CASE WHEN x.updated > f.updated THEN coalesce(x.whois, f.whois) ELSE coalesce(f.whois, x.whois) END, greatest(x.updated, f.updated)
          FROM f JOIN (SELECT *, k - 1 AS prior FROM ent) x ON x.ip = f.ip AND x.prior = f.k)"""


def _stamp(c: str) -> str:
    return f"strftime(make_timestamp(CAST({c} AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S')"


@query(
    f"""WITH RECURSIVE {_IP},
    last AS (SELECT ip, arg_max(struct_pack(c := country, w := whois), k) AS x FROM f GROUP BY ip),
    rest AS (SELECT ip, max(v) AS v, min(first_seen) AS first_seen, max(updated) AS updated FROM ent GROUP BY ip)
    SELECT ip, x.c AS country_code, x.w AS whois, CASE v WHEN 2 THEN 'Yes' WHEN 1 THEN 'No' END AS malicious, {_stamp('first_seen')} AS first_seen, {_stamp('updated')} AS last_updated FROM last JOIN rest USING (ip)"""
)
def merged_ip_store(spark, sf_dir):
    """Addresses of a store after five snapshots, of which one is recorded already and one comes twice."""
    return imports.merge_ip(*_ip_tables(spark, sf_dir)).store["entities"].select("ip", F.nullif("country_code", F.lit("")).alias("country_code"), "whois", "malicious", "first_seen", "last_updated")


@query(f"WITH {_IP.split('ent AS')[0].rstrip().rstrip(',')}, d AS (SELECT s, ip, 'd' || (event_id % 4) AS domain, max(event_id) AS seen FROM e WHERE s <> 2 GROUP BY 1, 2, 3) SELECT ip, domain, {_stamp('arg_min(seen, s)')} AS first_seen FROM d GROUP BY ip, domain")
def merged_ip_children(spark, sf_dir):
    """Names of addresses after five snapshots; what is there keeps its time."""
    return imports.merge_ip(*_ip_tables(spark, sf_dir)).store["reverse_dns"]


@query(f"WITH {_IP.split('f AS (SELECT ip, k')[0].rstrip().rstrip(',')}, new AS (SELECT count(DISTINCT ip) AS n FROM ent WHERE s > 0 AND ip NOT IN (SELECT ip FROM ent WHERE s = 0)) SELECT (SELECT count(DISTINCT s) FROM ent WHERE s > 0) AS snapshots_imported, n AS entities_inserted, (SELECT count(*) FROM ent WHERE s > 0) - n AS entities_merged, (SELECT count(*) FROM ent WHERE s > 0) AS provider_results_copied FROM new")
def ip_import_counts(spark, sf_dir):
    return imports.merge_ip(*_ip_tables(spark, sf_dir)).counts


def _repo_tables(spark: SparkSession, sf_dir: str) -> tuple[imports.Store, imports.Store]:
    """Users as repositories in a store (snapshot 0) and three snapshots: their events are documents, findings, evidence and people."""
    e = read(spark, sf_dir, "events").withColumn("s", F.col("event_id") % 4).withColumn("identity_key", _name("github.com/owner/r", F.col("user_id") % 150))
    n = F.col("event_id")
    repositories = e.groupBy("s", "identity_key").agg(F.max("event_id").alias("n")).select("s", "identity_key", _name("o", F.col("n")).alias("owner"), _name("n", F.col("n")).alias("name"), F.concat(F.lit("https://"), "identity_key").alias("canonical_url"), F.when(F.col("n") % 3 == 0, _name("node", F.col("n"))).alias("node_id"), (F.col("n") * 7 % 900).alias("updated_at"))
    kind, locator, content = F.lit("readme"), _name("l", n % 3), _name("c", n % 4)
    documents = e.select("s", "identity_key", kind.alias("kind"), locator.alias("locator"), F.when(n % 3 == 2, "local").otherwise("github").alias("origin")).distinct()
    versions = e.select("s", "identity_key", kind.alias("kind"), locator.alias("locator"), content.alias("content_hash"), (n % 13).alias("captured_at")).groupBy("s", "identity_key", "kind", "locator", "content_hash").agg(F.min("captured_at").alias("captured_at"))
    snapshots = e.select("s", "identity_key", _name("m", n % 5).alias("metadata_hash"), (n % 17).alias("captured_at")).groupBy("s", "identity_key", "metadata_hash").agg(F.min("captured_at").alias("captured_at"))
    people = e.select("s", _name("p", n % 40).alias("normalized_name"), F.when(n % 2 == 0, _name("login", n % 40)).alias("login"), F.lit("P").alias("display_name")).distinct()
    roles = e.select("s", "identity_key", _name("p", n % 40).alias("normalized_name"), F.when(n % 2 == 0, _name("login", n % 40)).alias("login"), F.lit("author").alias("role"), F.when(n % 5 > 0, kind).alias("kind"), F.when(n % 5 > 0, locator).alias("locator"), F.when(n % 5 > 0, content).alias("content_hash")).distinct()
    key = [_name("f", n % 6).alias("fingerprint"), F.lit("model").alias("provenance")]
    findings = e.select("s", "identity_key", *key, "event_id").groupBy("s", "identity_key", "fingerprint", "provenance").agg(F.min("event_id").alias("version"), F.max("event_id").alias("created_at")).withColumn("summary", _name("about ", F.col("created_at")))
    evidence = e.select("s", "identity_key", *key, F.lit("summary").alias("field_path"), kind.alias("kind"), locator.alias("locator"), content.alias("content_hash"), _name("q", n % 2).alias("quote")).distinct()
    inferences = findings.select("s", "identity_key", "fingerprint", "provenance", _name("lang", F.col("s")).alias("category"))
    current = findings.groupBy("s", "identity_key").agg(F.max_by(F.struct("fingerprint", "provenance"), "created_at").alias("c")).select("s", "identity_key", "c.*")
    tables = {"repositories": repositories, "documents": documents, "versions": versions, "snapshots": snapshots, "people": people, "roles": roles, "findings": findings, "evidence": evidence, "inferences": inferences, "current": current}
    store = {k: df.where("s = 0").drop("s") for k, df in tables.items()} | {"ledger": spark.range(0).select(F.lit("").alias("source_sha256"))}
    listed = e.select("s").distinct().where("s > 0").select(_digest(F.col("s")).alias("source_sha256"), F.col("s").alias("import_seq"))
    return store, {k: df.where("s > 0").withColumn("source_sha256", _digest(F.col("s"))).drop("s") for k, df in tables.items()} | {"imports": listed}


_REPO = """
    e AS (SELECT *, event_id % 4 AS s, 'github.com/owner/r' || (user_id % 150) AS key, event_id AS n FROM events),
    fin AS (SELECT s, key, 'f' || (n % 6) AS fp, min(n) AS version, max(n) AS created FROM e GROUP BY 1, 2, 3),
    whole AS (SELECT * FROM fin WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.s = fin.s AND e.key = fin.key AND 'f' || (e.n % 6) = fin.fp AND e.n % 3 = 2)),
    old AS (SELECT key, fp, version, created FROM fin WHERE s = 0),
    fresh AS (SELECT key, fp, arg_min(created, s) AS created, min(s) AS s FROM whole w WHERE s > 0 AND NOT EXISTS (SELECT 1 FROM old WHERE old.key = w.key AND old.fp = w.fp) GROUP BY key, fp),
    added AS (SELECT f.key, fp, created, coalesce(top, 0) + row_number() OVER (PARTITION BY f.key ORDER BY s, created, fp) AS version FROM fresh f LEFT JOIN (SELECT key, max(version) AS top FROM old GROUP BY key) t ON t.key = f.key),
    every AS (SELECT key, fp, version, created FROM old UNION ALL SELECT key, fp, version, created FROM added)"""


@query(f"WITH {_REPO} SELECT key AS identity_key, fp AS fingerprint, version, created AS created_at, 'about ' || created AS summary FROM every")
def merged_repo_findings(spark, sf_dir):
    """Findings of a store after three snapshots: those whose evidence all came along, numbered on."""
    return imports.merge_repos(*_repo_tables(spark, sf_dir)).store["findings"].drop("provenance")


@query(
    f"""WITH {_REPO}, pts AS (SELECT s, key, arg_max(fp, created) AS fp FROM fin GROUP BY s, key),
    pointed AS (SELECT p.key, p.fp, x.created, true AS dst FROM pts p JOIN every x ON x.key = p.key AND x.fp = p.fp WHERE s = 0
             UNION SELECT p.key, p.fp, x.created, false FROM pts p JOIN every x ON x.key = p.key AND x.fp = p.fp JOIN whole w ON w.s = p.s AND w.key = p.key AND w.fp = p.fp WHERE p.s > 0)
    SELECT key AS identity_key, arg_max(fp, (created, dst, fp)) AS fingerprint FROM pointed GROUP BY key"""
)
def merged_repo_pointers(spark, sf_dir):
    return imports.merge_repos(*_repo_tables(spark, sf_dir)).store["current"].drop("provenance")


@query(f"WITH {_REPO} SELECT DISTINCT key AS identity_key, 'f' || (n % 6) AS fingerprint, 'l' || (n % 3) AS locator, 'c' || (n % 4) AS content_hash, 'q' || (n % 2) AS quote FROM e WHERE s = 0 OR EXISTS (SELECT 1 FROM whole w WHERE w.s = e.s AND w.key = e.key AND w.fp = 'f' || (e.n % 6))")
def merged_repo_evidence(spark, sf_dir):
    return imports.merge_repos(*_repo_tables(spark, sf_dir)).store["evidence"].select("identity_key", "fingerprint", "locator", "content_hash", "quote")


@query(
    """WITH r AS (SELECT event_id % 4 AS s, 'github.com/owner/r' || (user_id % 150) AS key, max(event_id) AS n FROM events GROUP BY 1, 2),
    o AS (SELECT *, n * 7 % 900 AS told, max(n * 7 % 900) OVER (PARTITION BY key ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r)
    SELECT key AS identity_key, 'o' || arg_max(n, s) AS owner, 'n' || arg_max(n, s) AS name, 'node' || arg_max(n, s) FILTER (n % 3 = 0) AS node_id, arg_max(told, s) AS updated_at FROM o WHERE before IS NULL OR told > before GROUP BY key"""
)
def merged_repositories(spark, sf_dir):
    return imports.merge_repos(*_repo_tables(spark, sf_dir)).store["repositories"].drop("canonical_url")


@query("WITH r AS (SELECT DISTINCT 'p' || (event_id % 40) AS normalized_name, CASE WHEN event_id % 2 = 0 THEN 'login' || (event_id % 40) END AS login FROM events) SELECT * FROM r")
def merged_people(spark, sf_dir):
    """People of a store and three snapshots; those without a login are one by name."""
    return imports.merge_repos(*_repo_tables(spark, sf_dir)).store["people"].drop("display_name")


def _file_tables(spark: SparkSession, sf_dir: str) -> tuple[imports.Store, imports.Store]:
    """Events as rows of files in a store (snapshot 0) and two snapshots, named by SHA-256, MD5 or both."""
    e = read(spark, sf_dir, "events").withColumn("s", F.col("event_id") % 3)
    n = F.col("event_id")
    sha, md5 = F.when(n % 4 != 0, F.sha2(_name("f", n % 900), 256)), F.when(n % 5 != 0, F.md5(_name("f", n % 900)))
    at = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    files = e.select("s", n.alias("row_id"), sha.alias("sha256"), md5.alias("md5"), F.when(n % 3 == 0, _name("magic", n % 11)).otherwise("").alias("magic"), F.when(n % 7 == 0, "yes").when(n % 7 == 1, "no").otherwise("unknown").alias("malicious"), at.alias("created_at"), at.alias("updated_at"))
    values = e.select("s", n.alias("row_id"), _name("v", n % 6).alias("value"), F.lit("local").alias("source"), at.alias("first_seen"))
    observations, lookups = e.select("s", n.alias("row_id"), _name("/p", n).alias("path")), e.select("s", n.alias("row_id"), F.lit("p").alias("provider"), F.lit("success").alias("status"), at.alias("completed_at"), F.lit("/raw").alias("raw_path"))
    tables = {"files": files, "file_names": values, "tags": values, "observations": observations, "lookups": lookups}
    store = {k: df.where("s = 0").drop("s") for k, df in tables.items()} | {"ledger": spark.range(0).select(F.lit("").alias("source_sha256"))}
    store["files"] = store["files"].withColumn("import_seq", F.lit(0).cast("long"))
    listed = e.select("s").distinct().where("s > 0").select(_digest(F.col("s")).alias("source_sha256"), F.col("s").alias("import_seq"))
    snapshots: dict[str, DataFrame] = {k: df.where("s > 0").withColumn("source_sha256", _digest(F.col("s"))) for k, df in tables.items()}
    snapshots["files"] = snapshots["files"].withColumn("import_seq", F.col("s"))
    return store, {k: df.drop("s") for k, df in snapshots.items()} | {"snapshots": listed}


_FILES = """
    r AS (SELECT event_id AS row_id, event_id % 3 AS s, CASE WHEN event_id % 4 <> 0 THEN sha256('f' || (event_id % 900)) END AS sha, CASE WHEN event_id % 5 <> 0 THEN md5('f' || (event_id % 900)) END AS md5, CASE WHEN event_id % 3 = 0 THEN 'magic' || (event_id % 11) END AS magic,
                 CASE event_id % 7 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS v, ts, 'v' || (event_id % 6) AS value FROM events),
    k AS (SELECT md5, count(DISTINCT sha) AS files, min(sha) AS only_one FROM r WHERE sha IS NOT NULL AND md5 IS NOT NULL GROUP BY md5),
    g AS (SELECT r.*, CASE WHEN sha IS NOT NULL THEN 's:' || sha WHEN files = 1 THEN 's:' || only_one WHEN r.md5 IS NOT NULL THEN 'm:' || r.md5 ELSE 'r:' || row_id END AS grp FROM r LEFT JOIN k ON k.md5 = r.md5)"""


@query(
    f"""WITH {_FILES} SELECT count(*) FILTER (NOT known) AS files_inserted, CAST(sum(n - CASE WHEN known THEN 0 ELSE 1 END) AS BIGINT) AS files_merged, (SELECT count(*) FROM r WHERE s > 0) AS lookups_copied
    FROM (SELECT grp, bool_or(s = 0) AS known, count(*) FILTER (s > 0) AS n FROM g GROUP BY grp) WHERE n > 0"""
)
def file_import_counts(spark, sf_dir):
    return imports.merge_file_store(*_file_tables(spark, sf_dir), intelligence_only=True).counts.drop("warnings")


@query(f"""WITH {_FILES} SELECT grp AS "group", value, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen FROM g GROUP BY grp, value""")
def merged_file_tags(spark, sf_dir):
    return imports.merge_file_store(*_file_tables(spark, sf_dir), intelligence_only=True).store["tags"].drop("source")


@query("SELECT user_id, event_type, arg_min(event_id, event_id) FILTER (event_id % 2 = 0) IS NOT NULL AS was_there, coalesce(min(event_id) FILTER (event_id % 2 = 0), min(event_id)) AS event_id FROM events GROUP BY user_id, event_type")
def added_versions(spark, sf_dir):
    """Versions by user and type of event: what is there stays, of new ones the first."""
    e = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", (F.col("event_id") % 2 == 0).alias("was_there"))
    old = e.where("was_there").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"), F.lit(True).alias("was_there"))
    return merges.add_versions(old, e.where("NOT was_there"), ["user_id", "event_type"], ["event_id"])


@query(
    """WITH c AS (SELECT user_id, min(event_id) AS id FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id), n AS (SELECT user_id, arg_max(event_id, (event_type <> 'error', event_id)) AS id, bool_or(event_type <> 'error') AS model FROM events WHERE event_type IN ('error', 'purchase') GROUP BY user_id)
    SELECT user_id AS repository_id, CASE WHEN c.id IS NULL OR (n.id IS NOT NULL AND (n.model OR c.id % 2 = 0)) THEN n.id ELSE c.id END AS finding_id FROM c FULL JOIN n USING (user_id)"""
)
def moved_pointers(spark, sf_dir):
    """Current findings after new ones: a deterministic one never replaces one that was enriched."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("repository_id"), F.col("event_id").alias("finding_id"), "event_type", F.col("event_id").alias("seq"))
    current = e.where("event_type IN ('view', 'click')").groupBy("repository_id").agg(F.min("finding_id").alias("finding_id")).withColumn("provenance", F.when(F.col("finding_id") % 2 == 0, "deterministic").otherwise("model"))
    new = e.where("event_type IN ('error', 'purchase')").select("repository_id", "finding_id", F.when(F.col("event_type") == "error", "deterministic").otherwise("model").alias("provenance"), "seq")
    return stores.move_pointers(current, new).drop("provenance")


@query(
    """WITH old AS (SELECT event_id // 3 + 1 AS id, user_id, event_type FROM events WHERE event_id % 3 = 0),
    new AS (SELECT (SELECT max(id) FROM old) + row_number() OVER (ORDER BY event_id) AS id, user_id, event_type FROM events WHERE event_id % 3 = 1 AND event_type <> 'error'),
    linked AS (SELECT n.id, n.user_id, n.event_type, coalesce(lag(n.id) OVER (PARTITION BY n.user_id, n.event_type ORDER BY n.id), o.last) AS before FROM new n LEFT JOIN (SELECT user_id, event_type, max(id) AS last FROM old GROUP BY 1, 2) o ON o.user_id = n.user_id AND o.event_type = n.event_type)
    SELECT id, user_id AS repository_id, event_type AS field_path, coalesce(before, -1) AS supersedes_id FROM linked"""
)
def appended_corrections(spark, sf_dir):
    """New corrections with their ids and what each supersedes; those of no known field are left out."""
    e = read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("repository_id"), F.col("event_type").alias("field_path"), F.lit("x").alias("replacement"), F.lit("why").alias("rationale"))
    ids = e.where("event_id % 3 = 0").withColumn("id", F.floor(F.col("event_id") / 3) + 1)
    old = ids.withColumn("supersedes_id", F.lit(None).cast("long")).drop("event_id")
    new = e.where("event_id % 3 = 1").withColumnRenamed("event_id", "seq")
    fields = ["view", "click", "purchase", "signup"]
    top = old.agg(F.max("id")).first()[0] or 0
    every = stores.append_corrections(old, new, fields)
    return every.where(F.col("id") > top).select("id", "repository_id", "field_path", F.coalesce("supersedes_id", F.lit(-1).cast("long")).alias("supersedes_id"))


@query("SELECT CASE user_id % 3 WHEN 1 THEN 'moved' ELSE 'root' || (user_id % 3) END AS root, 'p' || user_id AS path_key FROM (SELECT DISTINCT user_id FROM events)")
def remapped_copies(spark, sf_dir):
    copies = read(spark, sf_dir, "events").select("user_id").distinct().select(_name("root", F.col("user_id") % 3).alias("root"), _name("p", F.col("user_id")).alias("path_key"))
    return stores.remap_root(copies, "root1", "moved", F.current_timestamp())[0]


_SET_FILES = """
    w AS (SELECT event_id AS row_id, event_id % 3 AS fs, CASE WHEN event_id % 4 <> 0 THEN 's:' || sha256('f' || (event_id % 900)) WHEN event_id % 5 <> 0 THEN 'm:' || md5('f' || (event_id % 900)) ELSE 'r:' || event_id END AS grp FROM events WHERE event_id % 3 > 0)"""


@query(
    f"""WITH {_IP.split('f AS (SELECT ip, k')[0].rstrip().rstrip(',')}, {_SET_FILES}
    SELECT store, name, n, 1::BIGINT AS version FROM (
        SELECT 'addresses' AS store, 'entities' AS name, count(DISTINCT ip) AS n FROM ent UNION ALL SELECT 'addresses', 'reverse_dns', count(*) FROM (SELECT DISTINCT ip, event_id % 4 FROM e WHERE s <> 2)
        UNION ALL SELECT 'addresses', 'ledger', count(DISTINCT s) FROM e WHERE s > 0
        UNION ALL SELECT 'files', 'files', count(DISTINCT grp) FROM w UNION ALL SELECT 'files', 'tags', count(*) FROM (SELECT DISTINCT grp, row_id % 6 FROM w) UNION ALL SELECT 'files', 'ledger', count(DISTINCT fs) FROM w
        UNION ALL SELECT 'files', 'lookups', count(*) FROM w)"""
)
def imported_set(spark, sf_dir):
    """Tables of a store of addresses and one of files after their snapshots were imported as a set, twice; the second import publishes nothing."""
    ip, file = _ip_tables(spark, sf_dir), _file_tables(spark, sf_dir)
    only = lambda store, snapshots: imports.merge_file_store(store, snapshots, intelligence_only=True)
    parts = {
        "addresses": import_sets.Part(imports.merge_ip, ip[1], ip[0], checks=[import_sets.one_row_a_key("entities", "ip")]),
        "files": import_sets.Part(only, file[1], imports.empty_file_store(spark), checks=[import_sets.one_row_a_key("files", "group"), import_sets.refers("tags", "files", "group")]),
    }
    root = scratch(spark)
    import_sets.import_set(spark, root, parts)
    version = import_sets.import_set(spark, root, parts)["version"]
    folder = describe_version(spark, root)["folder"]
    tables = [("addresses", "entities"), ("addresses", "reverse_dns"), ("addresses", "ledger"), ("files", "files"), ("files", "tags"), ("files", "ledger"), ("files", "lookups")]
    counts = [spark.read.parquet(f"{folder}/{store}/{name}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(store).alias("store"), F.lit(name).alias("name"), "n") for store, name in tables]
    return reduce(DataFrame.union, counts).withColumn("version", F.lit(version).cast("long"))


def _in_two_imports(spark: SparkSession, name: str, part: import_sets.Part, layout: change_sets.Layout) -> imports.Store:
    """A store after the first of its snapshots, and then all, were imported bucket by bucket."""
    root, every, layout = scratch(spark), part.snapshots[part.listing], replace(layout, buckets=16)
    early = import_sets.Part(part.merge, part.snapshots | {part.listing: every.where("import_seq <= 1")}, part.empty, part.listing, part.checks)
    for one in (early, part):
        change_sets.import_changes(spark, root, {name: one}, {name: layout})
    return change_sets.open_kept(spark, root, name, part, layout)


@query(ORACLE_SQL["merged_ip_store"])
def changed_ip_store(spark, sf_dir):
    """Addresses as in `merged_ip_store`, by two imports of which the second touches buckets of the first."""
    store, snapshots = _ip_tables(spark, sf_dir)
    part = import_sets.Part(imports.merge_ip, snapshots, store, checks=[import_sets.one_row_a_key("entities", "ip")])
    entities = _in_two_imports(spark, "addresses", part, change_sets.IP_LAYOUT)["entities"]
    return entities.select("ip", F.nullif("country_code", F.lit("")).alias("country_code"), "whois", "malicious", "first_seen", "last_updated")


@query(ORACLE_SQL["merged_repo_findings"])
def changed_repo_findings(spark, sf_dir):
    """Findings as in `merged_repo_findings`, by two imports."""
    store, snapshots = _repo_tables(spark, sf_dir)
    part = import_sets.Part(imports.merge_repos, snapshots, store, "imports", [import_sets.one_row_a_key("findings", *imports.FINDING), import_sets.refers("evidence", "findings", *imports.FINDING)])
    return _in_two_imports(spark, "repositories", part, change_sets.REPO_LAYOUT)["findings"].drop("provenance")


@query(ORACLE_SQL["merged_file_tags"].replace("FROM g GROUP", "FROM g WHERE s > 0 GROUP").replace("FROM r WHERE sha", "FROM r WHERE s > 0 AND sha"))
def changed_file_tags(spark, sf_dir):
    """Tags of files by two imports into an empty store: a file is found by its hashes, an MD5 by the index of the store."""
    part = import_sets.Part(change_sets.merge_indexed_files, _file_tables(spark, sf_dir)[1], change_sets.empty_indexed_store(spark), checks=[import_sets.one_row_a_key("files", "group"), import_sets.refers("tags", "files", "group")])
    return _in_two_imports(spark, "files", part, change_sets.FILE_LAYOUT)["tags"].drop("source")
