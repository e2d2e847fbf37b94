"""Registered queries: conflicts, provenance, references, work lists, subjects, cards in full, bounds and generations."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkintel.functions import repositories, strings
from sparkintel.operators import answers, evidence, lookups, merges, signatures, stores
from sparkintel.plans.queries import query
from sparkintel.plans.stream_queries import event_stream
from sparkintel.plans.tables import read
from sparkintel.sources.exports import scratch
from sparkintel.streaming.captures import generations, run_once, unit_stream


def _named(prefix, c):
    return F.concat(F.lit(prefix), c.cast("string"))


@query("SELECT sha256('f' || user_id) AS sha256, count(DISTINCT event_type) AS n FROM events GROUP BY user_id HAVING count(DISTINCT event_type) > 1")
def hash_conflicts(spark, sf_dir):
    """SHA-256 values (of users) that come with several MD5 values (of types of events)."""
    e = read(spark, sf_dir, "events").select(F.sha2(_named("f", F.col("user_id")), 256).alias("sha256"), F.md5("event_type").alias("md5"))
    return lookups.hash_conflicts(e)


@query(
    """WITH m AS (SELECT user_id AS path, event_id, event_id % 97 AS k, 'n' || (event_id % 97) AS namespace FROM events), bad AS (SELECT DISTINCT path FROM m WHERE k = 13)
    SELECT path, event_id, namespace, 'origin ' || k AS source, '' AS code FROM m WHERE path NOT IN (SELECT path FROM bad) UNION ALL SELECT path, -1, '', '', 'integrity' FROM bad"""
)
def matches_with_provenance(spark, sf_dir):
    """Matches with the origin of their rules; files with a match of unknown origin have an error instead."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("path"), "event_id", _named("n", F.col("event_id") % 97).alias("namespace"))
    manifest = spark.range(97).where("id <> 13").select(_named("n", F.col("id")).alias("namespace"), _named("origin ", F.col("id")).alias("source"))
    good, bad = signatures.attach_provenance(e, manifest, "path")
    told = bad.select("path", F.lit(-1).cast("long").alias("event_id"), F.lit("").alias("namespace"), F.lit("").alias("source"), "code")
    return good.select("path", "event_id", "namespace", "source", F.lit("").alias("code")).unionByName(told)


@query("SELECT event_id, user_id * 10 AS user_id FROM events WHERE user_id % 3 <> 1")
def remapped_children(spark, sf_dir):
    """Events under the new numbers of their users; those of users without one go."""
    e = read(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("long").alias("user_id"))
    mapping = e.where("user_id % 3 <> 1").select(F.col("user_id").alias("old_id"), (F.col("user_id") * 10).alias("new_id")).distinct()
    return stores.remap(e, mapping, "user_id").select("event_id", "user_id")


@query(
    """WITH item AS (SELECT user_id, arg_max(event_type, event_id) AS last FROM events GROUP BY user_id)
    SELECT user_id AS repository_id, CASE last WHEN 'purchase' THEN 'complete' WHEN 'signup' THEN 'skipped_reuse' WHEN 'error' THEN 'failed' ELSE 'pending' END AS state FROM item WHERE last NOT IN ('purchase', 'signup')"""
)
def open_work(spark, sf_dir):
    """Repositories (users) whose items, in the state of their last event, still want work."""
    last = read(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last"))
    state = F.when(F.col("last") == "purchase", "complete").when(F.col("last") == "signup", "skipped_reuse").when(F.col("last") == "error", "failed").otherwise("pending")
    repositories_of = last.select(F.col("user_id").alias("repository_id"))
    return stores.worklist(repositories_of, last.select(F.col("user_id").alias("repository_id"), state.alias("state")))


@query("SELECT 'c' || k AS identity_key, k IN (SELECT c_custkey FROM customer) AS there FROM (SELECT DISTINCT o_custkey * 2 AS k FROM orders)")
def selected_repositories(spark, sf_dir):
    """Repositories (customers) that were asked for (by twice the number of a buyer), and the keys that are not there."""
    own = read(spark, sf_dir, "customer").select(_named("c", F.col("c_custkey")).alias("identity_key"))
    wanted = read(spark, sf_dir, "orders").select(_named("c", F.col("o_custkey") * 2).alias("identity_key"))
    kept, missing = stores.select_repositories(own, wanted)
    return kept.withColumn("there", F.lit(True)).union(missing.withColumn("there", F.lit(False)))


@query(
    """WITH p AS (SELECT o_custkey AS repository_id, 'p' || (o_orderkey % 3) AS person FROM orders), one AS (SELECT repository_id, min(person) AS person FROM p GROUP BY 1 HAVING count(DISTINCT person) = 1)
    SELECT one.* FROM one LEFT JOIN customer ON c_custkey = repository_id WHERE c_mktsegment IS NULL OR c_mktsegment <> 'BUILDING'"""
)
def eligible_subjects(spark, sf_dir):
    """The one person of each repository (customer) whose owner is no organisation (a market segment)."""
    people = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("repository_id"), _named("p", F.col("o_orderkey") % 3).alias("person"))
    owners = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("repository_id"), F.when(F.col("c_mktsegment") == "BUILDING", "Organization").otherwise("User").alias("owner_type"))
    return stores.eligible_subjects(people, owners)


@query(
    """SELECT p_partkey AS file_id FROM part WHERE p_partkey % 5 < 2 OR p_partkey % 7 < 2 OR p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) OR p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 7) OR p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.09 AND l_tax > 0.07)"""
)
def files_without_placeholders(spark, sf_dir):
    """Files (parts) that are known for something: a verdict, a magic, an observation, a tag or a name."""
    k, lines = F.col("p_partkey"), read(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "file_id")
    files = read(spark, sf_dir, "part").select(k.alias("file_id"), F.when(k % 5 < 2, "no").otherwise("unknown").alias("malicious"), F.when(k % 7 < 2, "PE").alias("magic"))
    return merges.prune_placeholders(files, lines.where("l_quantity > 49"), lines.where("l_linenumber = 7"), lines.where("l_discount > 0.09 AND l_tax > 0.07")).select("file_id")


@query(
    """WITH c AS (SELECT doc_id AS repository_id, CASE doc_id % 3 WHEN 0 THEN '  ANN   Lee ' WHEN 1 THEN 'bo' ELSE 'Nobody' END AS subject, CASE WHEN doc_id % 4 > 0 THEN left(text, 5) ELSE '' END AS quote, lang FROM documents WHERE text IS NOT NULL)
    SELECT repository_id, subject, CASE WHEN coalesce(quote, '') <> '' AND doc_id_ok THEN lang ELSE 'Unknown' END AS category FROM (SELECT *, (repository_id % 3 = 0 OR (repository_id % 3 = 1 AND repository_id % 2 = 0)) AS doc_id_ok FROM c) WHERE repository_id % 5 <> 3"""
)
def attributed_languages(spark, sf_dir):
    """Claims of languages (of documents), which hold with a quote and about a documented person; organisations get none."""
    d, n = read(spark, sf_dir, "documents").where("text IS NOT NULL"), F.col("doc_id")
    subject = F.when(n % 3 == 0, "  ANN   Lee ").when(n % 3 == 1, "bo").otherwise("Nobody")
    claims = d.select(n.alias("repository_id"), subject.alias("subject"), F.when(n % 4 > 0, F.left("text", F.lit(5))).otherwise("").alias("quote"), F.col("lang").alias("category"))
    people = d.select(n.alias("repository_id"), F.lit("Ann Lee").alias("person")).union(d.where(n % 2 == 0).select(n, F.lit("Bo")))
    owners = d.select(n.alias("repository_id"), F.when(n % 5 == 3, "Organization").when(n % 5 == 2, "User").alias("owner_type"))
    return answers.attribute_language(claims, people, owners)


@query(
    """SELECT 'u' || c_custkey AS login, left(concat_ws(chr(10), 'name: ' || nullif(c_name, ''), 'bio: ' || repeat(c_mktsegment || ' ', c_custkey % 900), 'location: ' || nullif(CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'n' || c_nationkey END, '')), 4000) AS text
    FROM customer WHERE c_custkey % 6 <> 0 AND c_custkey % 7 > 1"""
)
def profile_texts(spark, sf_dir):
    """Texts of profiles (customers) within their bound; organisations and those without a login have none."""
    k = F.col("c_custkey")
    profiles = read(spark, sf_dir, "customer").select(
        F.when(k % 6 == 0, "Organization").otherwise("User").alias("type"), F.when(k % 7 == 0, None).when(k % 7 == 1, "").otherwise(_named("u", k)).alias("login"), F.col("c_name").alias("name"),
        F.expr("repeat(concat(c_mktsegment, ' '), CAST(c_custkey % 900 AS INT))").alias("raw_bio"), F.when(k % 2 == 0, "").otherwise(_named("n", F.col("c_nationkey"))).alias("location"),
    )
    return answers.profile_text(profiles.withColumn("bio", F.col("raw_bio")))


@query("SELECT (SELECT count(*) FROM part) AS discovered, (SELECT count(*) FROM part WHERE p_size > 10) AS selected, (SELECT count(*) FROM part WHERE p_size > 20) AS scanned, (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_linenumber > 4) AS matched, (SELECT count(*) FROM lineitem WHERE l_linenumber > 4) AS matches, (SELECT count(*) FROM events WHERE event_type = 'error') AS errors, 'partial' AS status")
def scan_counts(spark, sf_dir):
    """What a scan found and did: parts as files, lines as matches, events as errors."""
    files = read(spark, sf_dir, "part").select((F.col("p_size") > 10).alias("selected"), (F.col("p_size") > 20).alias("scanned"))
    matches = read(spark, sf_dir, "lineitem").where("l_linenumber > 4").select(F.col("l_partkey").alias("path"))
    return answers.scan_metadata(files, matches, read(spark, sf_dir, "events").where("event_type = 'error'"))


@query(
    """WITH card AS (SELECT user_id AS repository_id, 'p' || min(event_id) AS purpose, 's' || max(event_id) AS status FROM events GROUP BY user_id),
    snap AS (SELECT user_id, arg_max('L' || (event_id % 5), (ts, event_id)) AS license, arg_max(CASE WHEN event_id % 3 = 0 THEN 'own/r' || event_id END, (ts, event_id)) AS some, max((ts, event_id)) AS top FROM events WHERE event_type = 'view' GROUP BY user_id),
    par AS (SELECT e.user_id, CASE WHEN e.event_id % 3 = 0 THEN 'https://github.com/own/r' || e.event_id END AS parent FROM events e JOIN snap s ON s.user_id = e.user_id AND s.top = (e.ts, e.event_id)),
    here AS (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click' AND event_id % 4 > 0 GROUP BY user_id),
    fetched AS (SELECT user_id, arg_max(CASE WHEN event_id % 2 = 0 THEN 'complete' ELSE 'failed' END, event_id) AS state FROM events WHERE event_type = 'purchase' GROUP BY user_id),
    fixed AS (SELECT user_id, arg_max('fixed ' || event_id, event_id) AS purpose FROM events WHERE event_type = 'error' GROUP BY user_id)
    SELECT card.repository_id, coalesce(fixed.purpose, card.purpose) AS purpose, card.status, license AS license_spdx, parent AS parent_url, coalesce(here.n, 0) AS n_copies, state AS fetch_state
    FROM card LEFT JOIN snap ON snap.user_id = repository_id LEFT JOIN par ON par.user_id = repository_id LEFT JOIN here ON here.user_id = repository_id LEFT JOIN fetched ON fetched.user_id = repository_id LEFT JOIN fixed ON fixed.user_id = repository_id"""
)
def cards_in_full(spark, sf_dir):
    """Cards of repositories (users) with their latest snapshot, copies that are present, last fetch and corrections."""
    e, n = read(spark, sf_dir, "events").withColumn("repository_id", F.col("user_id")), F.col("event_id")
    cards = e.groupBy("repository_id").agg(_named("p", F.min("event_id")).alias("purpose"), _named("s", F.max("event_id")).alias("status"))
    of = lambda kind: e.where(F.col("event_type") == kind)
    snapshots = of("view").select("repository_id", F.col("ts").alias("captured_at"), n.alias("id"), _named("L", n % 5).alias("license_spdx"), F.when(n % 3 == 0, _named("own/r", n)).otherwise("no parent").alias("parent_full_name"))
    copies = of("click").select("repository_id", F.when(n % 4 == 0, F.col("ts")).alias("missing_at"))
    runs = of("purchase").select("repository_id", F.lit("fetch").alias("kind"), F.when(n % 2 == 0, "complete").otherwise("failed").alias("state"), n.alias("run_id"))
    corrections = of("error").select("repository_id", n.alias("id"), F.lit("purpose").alias("field_path"), _named("fixed ", n).alias("replacement"))
    return answers.full_cards(cards, snapshots, copies, runs, corrections, ["purpose"])


@query("SELECT c_custkey AS repository_id, c_name AS person, CASE c_custkey % 4 WHEN 0 THEN 'Korean' WHEN 1 THEN 'Greek' END AS language FROM customer WHERE c_custkey % 4 < 2 AND c_custkey % 3 < 2")
def native_speakers(spark, sf_dir):
    """People (customers) of whom a source says that they are native speakers, by their own name and in any case."""
    k, c = F.col("c_custkey"), read(spark, sf_dir, "customer")
    language = F.when(k % 4 == 0, "Korean").when(k % 4 == 1, "Greek").when(k % 4 == 2, "Elvish").otherwise("")
    about = F.when(k % 3 == 2, "Someone else").otherwise(F.col("c_name"))
    sources = c.select(k.alias("repository_id"), k.alias("source_id"), F.concat(F.lit("By the way, "), about, F.lit("\tis a NATIVE "), language, F.lit(" speaker.")).alias("content"))
    return evidence.explicit_language(sources, c.select(k.alias("repository_id"), F.col("c_name").alias("person")), ["Korean", "Greek"])


@query(
    """WITH h AS (SELECT doc_id, encode(coalesce(text, '')) AS raw, (doc_id % 50)::INT AS n FROM documents)
    SELECT doc_id, coalesce(TRY(decode(raw[1:n])), TRY(decode(raw[1:n - 1])), TRY(decode(raw[1:n - 2])), TRY(decode(raw[1:n - 3]))) AS head FROM h"""
)
def text_heads(spark, sf_dir):
    """The head of each document within a number of bytes, of whole characters."""
    return read(spark, sf_dir, "documents").select("doc_id", strings.utf8_floor(F.coalesce("text", F.lit("")), F.col("doc_id") % 50).alias("head"))


@query(
    """SELECT p_partkey, left('name', 3) || '=' || left(p_name, 6) || ';' || left('brand', 3) || '=' || left(p_brand, 6) AS meta, 'own' || p_partkey || '/' || CASE p_partkey % 3 WHEN 0 THEN 'a/b' WHEN 1 THEN 'x y' ELSE 'tool' END AS full_name,
           CASE p_partkey % 3 WHEN 2 THEN 'https://github.com/own' || p_partkey || '/tool' ELSE '' END AS parent, p_partkey % 4 = 1 AS safe FROM part"""
)
def bounded_metadata(spark, sf_dir):
    """Metadata of rules (parts) within bounds of entries, keys and values; addresses of parents; names of files that are safe."""
    k = F.col("p_partkey")
    meta = strings.bound_meta(F.create_map(F.lit("name"), "p_name", F.lit("brand"), "p_brand", F.lit("type"), "p_type"), 3, 6, 2)
    shown = F.array_join(F.transform(F.map_entries(meta), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    full = F.concat(_named("own", k), F.lit("/"), F.when(k % 3 == 0, "a/b").when(k % 3 == 1, "x y").otherwise("tool"))
    name = F.when(k % 4 == 0, "..").when(k % 4 == 1, _named("file-", k)).when(k % 4 == 2, _named("a/", k)).otherwise(".partial")
    return read(spark, sf_dir, "part").select("p_partkey", shown.alias("meta"), full.alias("full_name"), F.coalesce(repositories.parent_url(full), F.lit("")).alias("parent"), strings.is_safe_name(name).alias("safe"))


@query(
    """WITH f AS (SELECT sha256('f' || user_id) AS sha256, CASE WHEN min(event_id) % 2 = 0 THEN 'm' || min(event_id) END AS md5, CASE WHEN min(event_id) % 3 = 0 THEN 'old' ELSE '' END AS magic, user_id % 3 AS v FROM events WHERE event_type = 'view' GROUP BY user_id),
    o AS (SELECT sha256('f' || user_id) AS sha256, arg_min('m' || event_id, event_id) FILTER (event_id % 4 > 0) AS md5, arg_min('new' || event_id, event_id) FILTER (event_id % 5 > 0) AS magic FROM events WHERE event_type = 'click' GROUP BY user_id)
    SELECT sha256, coalesce(f.md5, o.md5) AS md5, coalesce(nullif(f.magic, ''), o.magic) AS magic, CASE f.v WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'unknown' END AS malicious FROM f FULL JOIN o USING (sha256)"""
)
def observed_files(spark, sf_dir):
    """Files (users) after observations: what they have stays, the first that has any fills what is blank."""
    e, n = read(spark, sf_dir, "events").withColumn("sha256", F.sha2(_named("f", F.col("user_id")), 256)), F.col("event_id")
    first = e.where("event_type = 'view'").groupBy("sha256", "user_id").agg(F.min("event_id").alias("event_id"))
    verdict = F.when(F.col("user_id") % 3 == 0, "yes").when(F.col("user_id") % 3 == 1, "no").otherwise("unknown")
    files = first.select("sha256", F.when(n % 2 == 0, _named("m", n)).alias("md5"), F.when(n % 3 == 0, "old").otherwise("").alias("magic"), verdict.alias("malicious"))
    seen = e.where("event_type = 'click'").select("sha256", F.when(n % 4 > 0, _named("m", n)).alias("md5"), F.when(n % 5 > 0, _named("new", n)).otherwise("").alias("magic"), n.alias("seq"))
    return stores.apply_file_observations(files, seen)[0]


@query(
    """WITH f AS (SELECT user_id AS file_id, CASE WHEN user_id % 2 = 0 THEN 's' || user_id END AS sha, CASE WHEN user_id % 3 = 0 THEN 'old' END AS magic, user_id % 3 AS v FROM (SELECT DISTINCT user_id FROM events)),
    r AS (SELECT user_id AS file_id, arg_min('s' || user_id, event_id) FILTER (event_id % 4 > 0) AS sha, arg_min('m' || event_id, event_id) FILTER (event_id % 3 = 0) AS md5, arg_min('magic' || event_id, event_id) AS magic,
                 max(CASE event_id % 11 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END) AS v, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY user_id),
    t AS (SELECT user_id AS file_id, count(DISTINCT event_id % 4) AS tags FROM events WHERE event_type = 'view' GROUP BY user_id)
    SELECT file_id, coalesce(f.sha, r.sha, '') AS sha256, coalesce(r.md5, '') AS md5, coalesce(f.magic, r.magic, '') AS magic, CASE greatest(f.v, coalesce(r.v, 0)) WHEN 2 THEN 'yes' WHEN 1 THEN 'no' ELSE 'unknown' END AS malicious, coalesce(tags, 0) AS tags FROM f LEFT JOIN r USING (file_id) LEFT JOIN t USING (file_id)"""
)
def provider_file_results(spark, sf_dir):
    """Files (users) and the number of their tags after provider results (views)."""
    e, n, u = read(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id")
    verdict = lambda c, yes, no: F.when(c == yes, "yes").when(c == no, "no").otherwise("unknown")
    none = F.lit(None).cast("string")
    files = e.select("user_id").distinct().select(u.alias("file_id"), F.when(u % 2 == 0, _named("s", u)).alias("sha256"), none.alias("md5"), F.when(u % 3 == 0, "old").alias("magic"), verdict(u % 3, 2, 1).alias("malicious"), F.lit("t0").alias("updated_at"))
    results = e.where("event_type = 'view'").select(
        u.alias("file_id"), n.alias("seq"), F.lit("p").alias("provider"), F.when(n % 4 > 0, F.concat(F.lit(" "), F.upper(_named("s", u)))).alias("sha256"), F.when(n % 3 == 0, _named("M", n)).alias("md5"), _named("magic", n).alias("magic"),
        verdict(n % 11, 0, 1).alias("malicious"), F.array(_named("t", n % 4)).alias("tags"), F.array().cast("array<string>").alias("names"),
    )
    child = lambda c: spark.createDataFrame([], f"file_id {dict(e.dtypes)['user_id']}, {c} string, source string, first_seen string")
    done = merges.apply_file_results(files, results, child("tag"), child("name"), F.lit("t1"))
    tags = done["tags"].groupBy("file_id").agg(F.count(F.lit(1)).alias("tags"))
    blank = [F.coalesce(c, F.lit("")).alias(c) for c in ("sha256", "md5", "magic")]
    return done["files"].join(tags, "file_id", "left").select("file_id", *blank, "malicious", F.coalesce("tags", F.lit(0).cast("long")).alias("tags"))


@query("SELECT DISTINCT 'u' || user_id AS path, sha256(event_type) AS sha256 FROM events")
def stream_generations(spark, sf_dir):
    """Generations of files (users) as a stream: each content (type of event) once."""
    folder = scratch(spark)
    stream = event_stream(spark, sf_dir).select(_named("u", F.col("user_id")).alias("path"), F.col("event_type").cast("binary").alias("content"))
    run_once(generations(stream).select("path", "sha256"), f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out")


@query("SELECT DISTINCT '/root' AS root, event_type || '/u' || user_id AS unit, 2 AS depth, 'pending' AS status FROM events WHERE event_id % 3 > 0")
def stream_units(spark, sf_dir):
    """Directories two levels down, each once as its files (events) arrive; files above them and elsewhere make none."""
    folder, n = scratch(spark), F.col("event_id")
    deep = F.concat(F.lit("/root/"), "event_type", F.lit("/"), _named("u", F.col("user_id")), F.lit("/"), n.cast("string"))
    path = F.when(n % 3 > 0, deep).when(n % 2 == 0, F.concat(F.lit("/root/"), n.cast("string"))).otherwise(F.concat(F.lit("/elsewhere/a/b/"), n.cast("string")))
    run_once(unit_stream(event_stream(spark, sf_dir).select(path.alias("path"), F.col("ts").alias("modificationTime")), "/root", 2), f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out")
