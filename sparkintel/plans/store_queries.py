"""Registered queries: stores under change."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkintel.operators import file_identity, stores
from sparkintel.plans.queries import _EVENT_IPS, query
from sparkintel.plans.tables import event_ips, read


@query(
    f"""WITH e AS ({_EVENT_IPS}),
    old AS (SELECT ip, 'C' || (min(event_id) % 9) AS country, CASE min(event_id) % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS v, min(event_id) AS at FROM e WHERE event_type = 'view' GROUP BY ip),
    new AS (SELECT ip, arg_max('N' || (event_id % 9), event_id) FILTER (event_id % 2 = 0) AS country, max(CASE event_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END) AS v, max(event_id) AS at FROM e WHERE event_type = 'click' GROUP BY ip)
    SELECT ip, coalesce(new.country, old.country) AS country_code, CASE greatest(coalesce(old.v, 0), coalesce(new.v, 0)) WHEN 2 THEN 'Yes' WHEN 1 THEN 'No' END AS malicious, coalesce(new.at, old.at) AS last_updated FROM old FULL JOIN new USING (ip)"""
)
def applied_ip_results(spark, sf_dir):
    e = event_ips(spark, sf_dir)
    verdict = lambda c: F.when(c % 3 == 0, "Yes").when(c % 3 == 1, "No")
    name = lambda p, c: F.concat(F.lit(p), (c % 9).cast("string"))
    old = e.where("event_type = 'view'").groupBy("ip").agg(F.min("event_id").alias("last_updated"))
    old = old.select("ip", name("C", F.col("last_updated")).alias("country_code"), verdict(F.col("last_updated")).alias("malicious"), "last_updated")
    new = e.where("event_type = 'click'").select("ip", F.when(F.col("event_id") % 2 == 0, name("N", F.col("event_id"))).alias("country_code"), verdict(F.col("event_id")).alias("malicious"), F.col("event_id").alias("seq"), F.col("event_id").alias("at"))
    return stores.apply_ip_results(old, new)


_SNAPS = """
    SELECT event_id AS row_id, CASE WHEN event_id % 4 <> 0 THEN sha256('f' || (event_id % 700)) END AS sha256, CASE WHEN event_id % 5 <> 0 THEN md5('f' || (event_id % 650)) END AS md5,
           CASE WHEN event_id % 3 = 0 THEN 'magic' || (event_id % 11) ELSE '' END AS magic, CASE event_id % 7 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'unknown' END AS malicious, strftime(ts, '%Y-%m-%d %H:%M:%S') AS tm FROM events"""


@query(
    f"""WITH RECURSIVE r AS (SELECT *, event_comp AS comp, row_number() OVER (PARTITION BY event_comp ORDER BY row_id) AS i FROM (SELECT *, row_id % 50 AS event_comp FROM ({_SNAPS}))),
    turn AS (
        SELECT comp, 0::BIGINT AS i, []::STRUCT(sha VARCHAR, md5 VARCHAR, magic VARCHAR, v INT, born VARCHAR, seen VARCHAR, n BIGINT)[] AS files FROM (SELECT DISTINCT comp FROM r)
        UNION ALL
        SELECT comp, i, CASE WHEN k IS NULL THEN list_append(files, {{'sha': sha, 'md5': md5, 'magic': m, 'v': v, 'born': tm, 'seen': tm, 'n': 1::BIGINT}})
            ELSE list_concat(list_concat(files[:k - 1], [{{'sha': coalesce(f.sha, sha), 'md5': coalesce(f.md5, md5), 'magic': CASE WHEN f.magic IS NULL OR (m IS NOT NULL AND tm > f.seen) THEN m ELSE f.magic END,
                'v': greatest(f.v, v), 'born': least(f.born, tm), 'seen': greatest(f.seen, tm), 'n': f.n + 1}}]), files[k + 1:]) END AS files
        FROM (
            SELECT *, files[k] AS f FROM (
                SELECT *, CASE WHEN s IS NOT NULL THEN s WHEN p IS NOT NULL AND (sha IS NULL OR files[p].sha IS NULL) THEN p END AS k FROM (
                    SELECT t.comp, r.i, t.files, r.sha256 AS sha, r.md5, nullif(r.magic, '') AS m, CASE r.malicious WHEN 'yes' THEN 3 WHEN 'no' THEN 2 ELSE 1 END AS v, r.tm,
                           CASE WHEN r.sha256 IS NOT NULL THEN nullif(list_position(list_transform(t.files, lambda x: coalesce(x.sha, '')), r.sha256), 0) END AS s,
                           CASE WHEN r.md5 IS NOT NULL THEN nullif(list_position(list_transform(t.files, lambda x: coalesce(x.md5, '')), r.md5), 0) END AS p
                    FROM turn t JOIN r ON r.comp = t.comp AND r.i = t.i + 1)))),
    last AS (SELECT comp, unnest(files) AS f FROM turn SEMI JOIN (SELECT comp, max(i) AS i FROM r GROUP BY comp) USING (comp, i))
    SELECT f.sha AS sha256, f.md5 AS md5, f.magic AS magic, CASE f.v WHEN 3 THEN 'yes' WHEN 2 THEN 'no' ELSE 'unknown' END AS malicious, f.born AS created_at, f.seen AS updated_at, f.n AS n_rows FROM last"""
)
def merged_files(spark, sf_dir):
    """Files of many snapshots by SHA-256 and MD5, as one import after the other leaves them."""
    e = read(spark, sf_dir, "events")
    n = lambda k: F.concat(F.lit("f"), (F.col("event_id") % k).cast("string"))
    at = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    rows = e.select(
        F.col("event_id").alias("row_id"), F.col("event_id").alias("import_seq"), F.when(F.col("event_id") % 4 != 0, F.sha2(n(700), 256)).alias("sha256"), F.when(F.col("event_id") % 5 != 0, F.md5(n(650))).alias("md5"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("magic"), (F.col("event_id") % 11).cast("string"))).otherwise("").alias("magic"), F.when(F.col("event_id") % 7 == 0, "yes").when(F.col("event_id") % 7 == 1, "no").otherwise("unknown").alias("malicious"), at.alias("created_at"), at.alias("updated_at"),
    )
    return file_identity.merge_files(rows).drop("group")


@query(
    """WITH ex AS (SELECT user_id AS repository_id, 'f' || (event_id % 20) AS fingerprint, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version FROM events WHERE event_type = 'view'),
    nw AS (SELECT user_id AS repository_id, 'f' || (event_id % 20) AS fingerprint, min(event_id) AS seq FROM events WHERE event_type = 'click' GROUP BY 1, 2),
    fresh AS (SELECT nw.* FROM nw ANTI JOIN ex USING (repository_id, fingerprint)), top AS (SELECT repository_id, max(version) AS top FROM ex GROUP BY 1)
    SELECT repository_id, fingerprint, seq, coalesce(top, 0) + row_number() OVER (PARTITION BY repository_id ORDER BY seq) AS version FROM fresh LEFT JOIN top USING (repository_id)"""
)
def promoted_findings(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("repository_id"), F.concat(F.lit("f"), (F.col("event_id") % 20).cast("string")).alias("fingerprint"), F.lit("p").alias("provenance"), F.col("event_id").alias("seq"), "event_type")
    old = e.where("event_type = 'view'").withColumn("version", F.row_number().over(Window.partitionBy("repository_id").orderBy("seq")))
    return stores.promote_findings(old, e.where("event_type = 'click'")).drop("provenance").withColumn("version", F.col("version").cast("long"))


@query(
    """WITH c AS (SELECT 'root' || (user_id % 3) AS root, 'p' || user_id AS path_key, min(event_id) AS a, max(event_id) AS b FROM events WHERE event_type = 'view' GROUP BY 1, 2),
    f AS (SELECT DISTINCT 'root' || (user_id % 3) AS root, 'p' || user_id AS path_key FROM events WHERE event_type = 'signup')
    SELECT root, path_key, coalesce(a, 999999999) AS first_seen, CASE WHEN f.root IS NOT NULL THEN 999999999 ELSE b END AS last_seen, f.root IS NULL AS missing FROM c FULL JOIN f USING (root, path_key)"""
)
def discovered_copies(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("root", F.concat(F.lit("root"), (F.col("user_id") % 3).cast("string")))
    copies = e.where("event_type = 'view'").groupBy("root", F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("path_key")).agg(F.min("event_id").alias("first_seen"), F.max("event_id").alias("last_seen")).withColumn("missing_at", F.lit(None).cast("long"))
    found = e.where("event_type = 'signup'").select("root", F.concat(F.lit("P"), F.col("user_id").cast("string")).alias("path"))
    after = stores.apply_discovery(copies, found, F.lit(999_999_999).cast("long"))
    return after.select("root", "path_key", "first_seen", "last_seen", F.col("missing_at").isNotNull().alias("missing"))


@query("""SELECT user_id % 97 AS run_id, count(*) FILTER (event_type IN ('view', 'click')) AS completed, count(*) AS total, CASE WHEN count(*) FILTER (event_type IN ('view', 'click')) = count(*) THEN 'complete' WHEN bool_or(event_type = 'error') THEN 'failed' ELSE 'interrupted' END AS status FROM events GROUP BY 1""")
def run_progress(spark, sf_dir):
    state = F.when(F.col("event_type") == "view", "complete").when(F.col("event_type") == "click", "skipped_reuse").when(F.col("event_type") == "error", "failed").otherwise("pending")
    return stores.run_status(read(spark, sf_dir, "events").select((F.col("user_id") % 97).alias("run_id"), state.alias("state")))


@query("""SELECT user_id, arg_max(event_type, event_id) AS state, 3 + count(*) FILTER (event_type = 'view') AS attempts FROM events GROUP BY user_id""")
def item_transitions(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    state = F.when(F.col("event_type") == "view", "running").otherwise(F.col("event_type"))
    events = e.select("user_id", state.alias("state"), F.col("event_id").alias("seq"), F.lit(None).cast("string").alias("error"))
    rows = e.select("user_id").distinct().select("user_id", F.lit("pending").alias("state"), F.lit(3).cast("long").alias("attempts"))
    after = stores.transition(rows, events, "user_id")
    return after.select("user_id", F.when(F.col("state") == "running", "view").otherwise(F.col("state")).alias("state"), "attempts")


@query(
    """WITH RECURSIVE i AS (SELECT event_type || '/' || (user_id % 30) AS source, event_id AS id, event_id % 1200 AS size, row_number() OVER (PARTITION BY event_type || '/' || (user_id % 30) ORDER BY event_id) AS n FROM events),
    f AS (SELECT source, CAST(-1 AS BIGINT) AS id, CAST(0 AS BIGINT) AS size, CAST(0 AS BIGINT) AS n, false AS kept, CAST(0 AS BIGINT) AS used FROM i WHERE n = 1
          UNION ALL SELECT i.source, i.id, i.size, i.n, i.size <= 1000 AND used + i.size <= 50000, used + CASE WHEN i.size <= 1000 AND used + i.size <= 50000 THEN i.size ELSE 0 END FROM f JOIN (SELECT *, n - 1 AS prior FROM i) i ON i.source = f.source AND i.prior = f.n)
    SELECT source, id, size, kept FROM f WHERE n > 0"""
)
def quarantined_items(spark, sf_dir):
    """Items that fit the budgets of their source; each decision needs the one before."""
    items = read(spark, sf_dir, "events").select("event_type", F.col("event_id").alias("id"), (F.col("event_id") % 1200).alias("size"), "user_id")
    return stores.quarantine_plan(items.select(F.concat_ws("/", "event_type", (F.col("user_id") % 30).cast("string")).alias("source"), "id", "size"), 1000, 50_000)
