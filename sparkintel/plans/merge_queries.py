"""Registered queries: merges, evidence, search, signatures, exchange, budgets and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkintel.functions import strings
from sparkintel.functions.scripts import script_counts
from sparkintel.operators import evidence, exchange, lookups, merges, search, signatures
from sparkintel.operators.versions import dedupe_names
from sparkintel.plans.queries import _EVENT_IPS, query
from sparkintel.plans.tables import event_ips, read


def _snapshots(spark, sf_dir):
    e = event_ips(spark, sf_dir)
    verdict = F.when(F.col("event_id") % 5 == 0, "Yes").when(F.col("event_id") % 5 < 3, "No")
    country = F.when(F.col("event_id") % 4 == 0, "").when(F.col("event_id") % 4 < 3, F.concat(F.lit("C"), (F.col("event_id") % 9).cast("string")))
    at = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return e.select("ip", F.col("event_id").alias("import_seq"), at.alias("last_updated"), at.alias("first_seen"), country.alias("country_code"), verdict.alias("malicious"))


@query(
    f"""WITH RECURSIVE s AS (
        SELECT ip, row_number() OVER (PARTITION BY ip ORDER BY event_id) AS n, strftime(ts, '%Y-%m-%d %H:%M:%S') AS tm,
               CASE WHEN event_id % 4 IN (1, 2) THEN 'C' || (event_id % 9) END AS country, CASE WHEN event_id % 5 = 0 THEN 2 WHEN event_id % 5 < 3 THEN 1 ELSE 0 END AS v FROM ({_EVENT_IPS})),
    fold AS (SELECT ip, n, tm, country FROM s WHERE n = 1
             UNION ALL SELECT s.ip, s.n, greatest(s.tm, f.tm), CASE WHEN s.tm > f.tm THEN coalesce(s.country, f.country) ELSE coalesce(f.country, s.country) END FROM fold f JOIN s ON s.ip = f.ip AND s.n = f.n + 1)
    SELECT ip, arg_max(f.country, n) AS country_code, any_value(a.malicious) AS malicious, any_value(a.first_seen) AS first_seen, any_value(a.last_updated) AS last_updated, max(n) AS n_snapshots
    FROM (SELECT ip, n, coalesce(country, chr(0)) AS country FROM fold) f
    JOIN (SELECT ip, CASE max(v) WHEN 2 THEN 'Yes' WHEN 1 THEN 'No' END AS malicious, min(tm) AS first_seen, max(tm) AS last_updated FROM s GROUP BY ip) a USING (ip) GROUP BY ip""".replace("arg_max(f.country, n) AS", "nullif(arg_max(f.country, n), chr(0)) AS")
)
def merged_ip_snapshots(spark, sf_dir):
    """Snapshots of each address folded in the order of import."""
    return merges.merge_ip_snapshots(_snapshots(spark, sf_dir))


@query(
    """SELECT user_id, CASE max(CASE WHEN event_id % 5 = 0 THEN 3 WHEN event_id % 5 = 1 THEN 2 WHEN event_id % 5 = 2 THEN 1 ELSE 0 END) WHEN 3 THEN 'yes' WHEN 2 THEN 'no' WHEN 1 THEN 'unknown' END AS malicious,
    arg_min(strftime(ts, '%Y-%m-%d %H:%M:%S'), ts) AS first_seen, arg_max(strftime(ts, '%Y-%m-%d %H:%M:%S'), ts) AS last_seen FROM events GROUP BY user_id"""
)
def verdict_lattice(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    verdict = F.when(F.col("event_id") % 5 == 0, "yes").when(F.col("event_id") % 5 == 1, "no").when(F.col("event_id") % 5 == 2, "unknown")
    at = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    rows = e.select("user_id", verdict.alias("v"), at.alias("at"))
    return rows.groupBy("user_id").agg(merges.max_verdict(F.col("v"), ["yes", "no", "unknown"]).alias("malicious"), merges.earliest(F.col("at")).alias("first_seen"), merges.latest(F.col("at")).alias("last_seen"))


@query("SELECT user_id, event_type AS tag, min(strftime(ts, '%Y-%m-%d %H:%M:%S')) AS first_seen FROM events GROUP BY user_id, event_type")
def merged_tags(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("tag"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("first_seen"), "event_id")
    return merges.merge_first_seen(e.where("event_id % 2 = 0").drop("event_id"), e.where("event_id % 2 = 1").drop("event_id"), ["user_id", "tag"])


@query(
    """WITH d AS (SELECT user_id, min(event_id) AS v FROM events WHERE event_type = 'view' GROUP BY user_id), s AS (SELECT user_id, max(event_id) AS v FROM events WHERE event_type = 'click' GROUP BY user_id),
    k AS (SELECT user_id, d.v % 4 AS o, s.v % 4 AS n FROM d FULL JOIN s USING (user_id))
    SELECT user_id, ['failed', 'new', 'scanning', 'scanned'][1 + CASE WHEN o IS NULL OR n > o THEN n ELSE o END] AS status, coalesce(o <> n, false) AS conflict FROM k"""
)
def merged_watch_directories(spark, sf_dir):
    states = F.array(*[F.lit(s) for s in merges.WATCH_STATES])
    e = read(spark, sf_dir, "events")
    old = e.where("event_type = 'view'").groupBy("user_id").agg(F.min("event_id").alias("v"))
    new = e.where("event_type = 'click'").groupBy("user_id").agg(F.max("event_id").alias("v"))
    named = lambda df: df.select("user_id", F.get(states, (F.col("v") % 4).cast("int")).alias("status"))
    return merges.merge_watch(named(old), named(new), ["user_id"])


@query("SELECT user_id AS repository_id, arg_max(event_id, (ts, event_id % 2 = 0, event_id)) AS finding_id FROM events GROUP BY user_id")
def current_findings(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return merges.current_findings(e.select(F.col("user_id").alias("repository_id"), F.col("event_id").alias("finding_id"), F.col("ts").alias("created_at"), (F.col("event_id") % 2 == 0).alias("is_dst")))


@query("WITH f AS (SELECT user_id * 100 + event_id % 30 AS finding_id, bool_or(event_type = 'error') AS broken FROM events GROUP BY 1) SELECT finding_id FROM f WHERE NOT broken")
def complete_findings(spark, sf_dir):
    """Findings (users, in thirty parts) none of whose evidence (events) cites a missing version (errors)."""
    e = read(spark, sf_dir, "events").select((F.col("user_id") * 100 + F.col("event_id") % 30).alias("finding_id"), F.col("event_type").alias("source_version_id"))
    return merges.complete_findings(e.select("finding_id").distinct(), e, e.where("source_version_id <> 'error'").select("source_version_id").distinct())


@query("SELECT event_id % 1000 AS k, min(event_id) AS v FROM events WHERE event_type = 'view' GROUP BY 1 UNION ALL SELECT event_id % 1000, min(event_id) FROM events WHERE event_type = 'click' AND event_id % 1000 NOT IN (SELECT event_id % 1000 FROM events WHERE event_type = 'view') GROUP BY 1")
def union_ignore(spark, sf_dir):
    e = read(spark, sf_dir, "events").select((F.col("event_id") % 1000).alias("k"), F.col("event_id").alias("v"), "event_type")
    dst = e.where("event_type = 'view'").groupBy("k").agg(F.min("v").alias("v"))
    return merges.union_ignore(dst, e.where("event_type = 'click'").select("k", "v"), ["k"])


@query(
    """WITH RECURSIVE v AS (
        SELECT source, doc_id, doc_id * 2 + (CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END) AS version_id, CASE WHEN doc_id % 5 = 0 THEN translate(coalesce(text, ''), 'eao', 'éäヶ') ELSE coalesce(text, '') END AS content FROM documents WHERE doc_id % 11 <> 0),
    o AS (SELECT source, version_id, content, row_number() OVER (PARTITION BY source ORDER BY doc_id % 3 DESC, (doc_id + 1) % 4, doc_id % 2 DESC, 'l' || doc_id) AS place FROM v WHERE content <> ''),
    turn AS (
        SELECT source, 0::BIGINT AS place, 0::BIGINT AS version_id, '' AS cut, 50001::BIGINT AS remaining FROM (SELECT DISTINCT source FROM o)
        UNION ALL
        SELECT source, place, version_id, cut, remaining - strlen(cut) FROM (
            SELECT o.source, o.place, o.version_id, t.remaining, CASE WHEN strlen(content) <= t.remaining THEN content ELSE coalesce(
                TRY(decode(encode(content)[1:t.remaining])), TRY(decode(encode(content)[1:t.remaining - 1])), TRY(decode(encode(content)[1:t.remaining - 2])), TRY(decode(encode(content)[1:t.remaining - 3])), '') END AS cut
            FROM turn t JOIN o ON o.source = t.source AND o.place = t.place + 1 WHERE t.remaining > 0))
    SELECT source AS repository_id, version_id, place, strlen(cut)::BIGINT AS kept, sha256(cut) AS sha256 FROM turn WHERE cut <> ''"""
)
def source_budget(spark, sf_dir):
    """Documents of each source within a budget of bytes: originals, their last versions, by priority, kind, origin and locator."""
    d, n = read(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit(""))), F.col("doc_id")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("readme", "authors", "maintainers", "other")]), ((n + 1) % 4 + 1).cast("int"))
    documents = d.select(n.alias("document_id"), F.col("source").alias("repository_id"), kind.alias("kind"), F.concat(F.lit("l"), n.cast("string")).alias("locator"), (n % 2).cast("string").alias("origin"), (n % 3).alias("priority"), (n % 11 == 0).alias("translation"))
    first = d.select((n * 2).alias("version_id"), n.alias("document_id"), F.col("text").alias("content"))
    second = d.where(n % 5 == 0).select((n * 2 + 1).alias("version_id"), n.alias("document_id"), F.translate("text", "eao", "éäヶ").alias("content"))
    versions = first.union(second).withColumn("content_hash", F.sha2("content", 256))
    chosen = evidence.select_evidence(documents, versions, 50_001)
    return chosen.select("repository_id", "version_id", F.col("place").cast("long").alias("place"), "kept", F.sha2("content", 256).alias("sha256"))


@query(
    """WITH q AS (SELECT doc_id AS quote_id, doc_id + (CASE WHEN doc_id % 10 = 0 THEN 3 WHEN doc_id % 10 = 1 THEN 100000000 ELSE 0 END) AS source_id, substr(coalesce(text, ''), 5, 12) AS quote FROM documents),
    j AS (SELECT q.*, d.doc_id, coalesce(d.text, '') AS content FROM q LEFT JOIN documents d ON d.doc_id = q.source_id)
    SELECT quote_id, source_id, CASE WHEN doc_id IS NULL THEN 'unknown_source' WHEN quote = '' OR NOT contains(content, quote) THEN 'not_in_source' ELSE 'valid' END AS state,
           CASE WHEN doc_id IS NOT NULL AND quote <> '' AND contains(content, quote) THEN strpos(content, quote) - 1 ELSE -1 END AS start_offset FROM j"""
)
def quote_validation(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    shift = F.when(F.col("doc_id") % 10 == 0, 3).when(F.col("doc_id") % 10 == 1, 100_000_000).otherwise(0)
    quotes = d.select(F.col("doc_id").alias("quote_id"), (F.col("doc_id") + shift).alias("source_id"), F.substring(F.coalesce("text", F.lit("")), 5, 12).alias("quote"))
    sources = d.select(F.col("doc_id").alias("source_id"), F.coalesce("text", F.lit("")).alias("content"))
    return evidence.validate_quotes(quotes, sources).select("quote_id", "source_id", "state", F.coalesce("start_offset", F.lit(-1)).alias("start_offset"))


#: Letters by script as SQL knows them; the given texts hold none that their names put elsewhere, but for the two ordinal signs.
_LETTERS = {"hangul": r"\p{Hangul}", "kana": r"\p{Hiragana}\p{Katakana}ー", "hebrew": r"\p{Hebrew}", "arabic": r"\p{Arabic}", "devanagari": r"\p{Devanagari}", "cyrillic": r"\p{Cyrillic}", "han": r"\p{Han}", "latin": r"\p{Latin}"}
_LENGTHS = ", ".join(f"length(regexp_replace(regexp_replace(t, '[^\\p{{L}}]|[ªº]', '', 'g'), '[^{c}]', '', 'g')) AS {n}" for n, c in _LETTERS.items())
_LENGTHS += f", length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) - length(regexp_replace(regexp_replace(t, '[^\\p{{L}}]|[ªº]', '', 'g'), '[^{''.join(_LETTERS.values())}]', '', 'g')) AS other"
#: Texts in other scripts: Latin letters turned into others, a letter each.
_ALPHABETS = {1: "абвгдежзийклмнопрстуфхцчшщ", 2: "あいうえおかきくけこさしすせそたちつてとなにぬねの", 3: "가나다라마바사아자차카타파하거너더러머버서어저처커터", 4: "的一是不了人我在有他这中大来上国个到说们为子和你地出", 5: "אבגדהוזחטיכלמנסעפצקרשתךםןף", 6: "ابتثجحخدذرزسشصضطظعغفقكلمنه", 7: "कखगघङचछजझञटठडढणतथदधनपफबभमय", 8: "αβγδεζηθικλμνξοπρστυφχψωϊϋ"}
_CODES = ["en", "ru", None, None, "zh", None, "ar", "hi", "el", "uk", "fr", "pl"]
_TOLD = "told AS (SELECT doc_id, CASE doc_id % 12 " + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(_CODES) if c) + " END AS code, CASE doc_id % 10 " + " ".join(f"WHEN {k} THEN translate(lower(coalesce(text, '')), 'abcdefghijklmnopqrstuvwxyz', '{a}')" for k, a in _ALPHABETS.items()) + " ELSE coalesce(text, '') END AS t FROM documents)"


def _told(spark, sf_dir):
    """Documents, most of them in the letters of another script, with a detector's code."""
    n, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    spelled, code = F.when(n % 10 == 0, text), F.lit(None).cast("string")
    for k, alphabet in _ALPHABETS.items():
        spelled = spelled.when(n % 10 == k, F.translate(F.lower(text), "abcdefghijklmnopqrstuvwxyz", alphabet))
    for k, name in enumerate(_CODES):
        code = F.when(n % 12 == k, F.lit(name)).otherwise(code)
    return read(spark, sf_dir, "documents").select("doc_id", code.alias("code"), spelled.otherwise(text).alias("t"))


@query(f"WITH {_TOLD} SELECT doc_id, {_LENGTHS} FROM told")
def script_histogram(spark, sf_dir):
    """Letters of each document by script, in the letters of nine scripts."""
    return _told(spark, sf_dir).select("doc_id", script_counts(F.col("t")).alias("s")).select("doc_id", "s.*")


@query(
    rf"""WITH {_TOLD}, clean AS (SELECT doc_id, code, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?s)```.*?```', ' ', 'g'), '(?m)^(?: {{4}}|\t).*$', ' ', 'g'), '`[^`\n]*`', ' ', 'g'), 'https?://[^\s\x1c-\x1f\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g') AS t FROM told),
    n AS (SELECT doc_id, code, {_LENGTHS} FROM clean),
    s AS (SELECT *, hangul + kana + hebrew + arabic + devanagari + cyrillic + han + latin + other AS letters, greatest(hangul, kana, hebrew, arabic, devanagari, cyrillic, han, latin, other) AS top FROM n),
    d AS (SELECT *, CASE top WHEN hangul THEN 'hangul' WHEN kana THEN 'kana' WHEN hebrew THEN 'hebrew' WHEN arabic THEN 'arabic' WHEN devanagari THEN 'devanagari' WHEN cyrillic THEN 'cyrillic' WHEN han THEN 'han' WHEN latin THEN 'latin' ELSE 'other' END AS dominant,
                 CASE WHEN code IN ('uk', 'be', 'bg', 'mk', 'sr', 'pl', 'cs', 'sk', 'sl', 'hr', 'bs') THEN 'Slavic-other' ELSE map {{'zh': 'Chinese', 'ru': 'Russian', 'ko': 'Korean', 'ja': 'Japanese', 'ar': 'Arabic', 'he': 'Hebrew', 'hi': 'Hindi', 'en': 'English'}}[code] END AS mapped FROM s),
    k AS (SELECT *, letters >= 100 AND top >= 0.2 * letters AS enough FROM d)
    SELECT doc_id, letters, dominant, CASE WHEN NOT enough THEN 'Unknown' WHEN dominant = 'hangul' THEN 'Korean' WHEN dominant = 'kana' THEN 'Japanese' WHEN dominant = 'hebrew' THEN 'Hebrew' WHEN dominant = 'other' THEN 'Unknown' ELSE coalesce(mapped, 'Unknown') END AS category,
        CASE WHEN enough AND dominant IN ('hangul', 'kana', 'hebrew') THEN 'unicode-script' WHEN enough AND dominant = 'latin' AND mapped IS NOT NULL THEN 'language-detector' ELSE 'combined' END AS method,
        coalesce(CASE WHEN enough AND dominant NOT IN ('hangul', 'kana', 'hebrew') THEN code END, '-') AS detected FROM k"""
)
def inferred_language(spark, sf_dir):
    """Language categories of all documents, code and links taken out, in nine scripts."""
    told = evidence.infer_language(_told(spark, sf_dir), F.col("t"), F.col("code"), F.col("doc_id"))
    return told.select("doc_id", "letters", "dominant", "category", "method", F.coalesce("detected", F.lit("-")).alias("detected"))


@query(
    r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
    c AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: x = 'apache')) AS b FROM t),
    s AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM c)
    SELECT doc_id, round(ln(1 + (docs - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean)) + ln(1 + (docs - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)), 6) AS score
    FROM c, s WHERE a > 0 AND b > 0 ORDER BY 2 DESC, 1 LIMIT 20"""
)
def bm25_top(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return search.bm25_search(d, "doc_id", "text", "the Apache", 20).withColumn("score", F.round("score", 6))


def _rules(spark, sf_dir):
    """A rule for each benchmark item, its whole text in literals of 40 characters: any of them, or all."""
    b = read(spark, sf_dir, "benchmark").where("length(text) > 0")
    pieces = b.select("item_id", "text", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 40))).alias("k"))
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    rows = pieces.select(name("ns", F.col("item_id") % 3).alias("namespace"), name("r", F.col("item_id")).alias("rule"), name("p", F.col("k")).alias("pattern_id"), F.substr("text", F.col("k") * 40 + 1, F.lit(40)).alias("pattern"), F.when(F.col("item_id") % 2 == 0, "any").otherwise("all").alias("condition"))
    return rows.where("length(pattern) >= 10")


_RULES = """
    p AS (SELECT item_id, substr(text, 1 + 40 * CAST(k AS BIGINT), 40) AS pattern FROM (SELECT item_id, text, unnest(range((length(text) + 39) // 40)) AS k FROM benchmark WHERE length(text) > 0)),
    q AS (SELECT * FROM p WHERE length(pattern) >= 10),
    h AS (SELECT doc_id, pattern, strpos(text, pattern) - 1 AS place FROM documents JOIN (SELECT DISTINCT pattern FROM q) ON contains(text, pattern)),
    m AS (SELECT doc_id, item_id, count(*) AS n, min(place) AS first_offset FROM h JOIN q USING (pattern) GROUP BY doc_id, item_id),
    found AS (SELECT doc_id, m.item_id, first_offset FROM m JOIN (SELECT item_id, count(*) AS k FROM q GROUP BY item_id) w ON w.item_id = m.item_id WHERE n >= CASE WHEN m.item_id % 2 = 0 THEN 1 ELSE k END)"""


@query(f"WITH {_RULES} SELECT doc_id, 'ns' || (item_id % 3) AS namespace, 'r' || item_id AS rule, first_offset FROM found")
def signature_matches(spark, sf_dir):
    """Rules of literals in all documents."""
    return signatures.match_signatures(read(spark, sf_dir, "documents"), "doc_id", "text", _rules(spark, sf_dir)).drop("n_strings")


@query(f"WITH {_RULES} SELECT doc_id, count(*) AS n_matches, string_agg(DISTINCT 't' || (item_id % 3), ',' ORDER BY 't' || (item_id % 3)) AS tags FROM found GROUP BY doc_id")
def match_summary(spark, sf_dir):
    found = signatures.match_signatures(read(spark, sf_dir, "documents"), "doc_id", "text", _rules(spark, sf_dir))
    return signatures.match_summary(found.withColumn("tags", F.array(F.concat(F.lit("t"), F.substring("namespace", 3, 1)))), "doc_id", "tags")


@query(
    r"""WITH r AS (SELECT * FROM (VALUES ('mail', 'any', '[a-z]+@[a-z0-9.]+'), ('keys', 'all', 'token = "[0-9a-f]{8}'), ('keys', 'all', '[0-9a-f]{32}'), ('years', '1', '(19|20)[0-9]{2}'), ('years', '1', 'the [A-Z]')) AS v(rule, condition, pattern)),
    h AS (SELECT doc_id, rule, condition, pattern, len(regexp_extract_all(text, pattern)) AS times FROM documents, r WHERE regexp_matches(text, pattern)),
    m AS (SELECT doc_id, rule, any_value(condition) AS condition, count(*) AS n, sum(times) AS n_strings FROM h GROUP BY doc_id, rule)
    SELECT doc_id, rule, CAST(n_strings AS BIGINT) AS n_strings FROM m WHERE n >= CASE WHEN condition = 'all' THEN 2 ELSE 1 END"""
)
def regex_matches(spark, sf_dir):
    """Rules of regular expressions in all documents."""
    rows = [("ns", "mail", "a", "[a-z]+@[a-z0-9.]+", "any", "regex"), ("ns", "keys", "a", 'token = "[0-9a-f]{8}', "all", "regex"), ("ns", "keys", "b", "[0-9a-f]{32}", "all", "regex"), ("ns", "years", "a", "(19|20)[0-9]{2}", "1", "regex"), ("ns", "years", "b", "the [A-Z]", "1", "regex")]
    rules = spark.createDataFrame(rows, "namespace string, rule string, pattern_id string, pattern string, condition string, kind string")
    return signatures.match_signatures(read(spark, sf_dir, "documents"), "doc_id", "text", rules).select("doc_id", "rule", "n_strings")


@query(
    f"""WITH {_RULES} SELECT 'documents/' || doc_id AS file_path, sha256(text) AS sha256, md5(text) AS md5, 'r' || item_id AS rule, 'ns' || (item_id % 3) AS namespace, '["t' || (item_id % 3) || '"]' AS tags, '{{"item":"' || item_id || '"}}' AS meta,
    '[{{"identifier":"$a","offset":' || first_offset || '}}]' AS strings FROM found JOIN documents USING (doc_id)"""
)
def match_report_rows(spark, sf_dir):
    """What the report of a scan has for each file and rule, its nested columns as JSON."""
    d = read(spark, sf_dir, "documents")
    found = signatures.match_signatures(d, "doc_id", "text", _rules(spark, sf_dir))
    path = F.concat(F.lit("documents/"), F.col("doc_id").cast("string")).alias("path")
    item = F.substring("rule", 2, 20)
    matches = found.select(path, "namespace", "rule", F.array(F.concat(F.lit("t"), F.substring("namespace", 3, 1))).alias("tags"), F.create_map(F.lit("item"), item).alias("meta"), F.array(F.struct(F.lit("$a").alias("identifier"), F.col("first_offset").alias("offset"))).alias("strings"))
    return signatures.match_rows(d.select(path, F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5")), matches)


def _requests(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("identity"), F.concat(F.lit("s"), (F.col("event_id") % 2).cast("string")).alias("source"), (F.col("event_id") * 7919 % 1009).alias("seq"), F.col("event_id").alias("import_seq"))


@query(
    """WITH RECURSIVE r AS (SELECT user_id AS identity, 's' || (event_id % 2) AS source, event_id * 7919 % 1009 AS seq, min(event_id) AS i FROM events GROUP BY 1, 2, 3),
    o AS (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY i) AS n FROM r),
    f AS (SELECT identity, n, source, seq, CAST(1 AS BIGINT) AS replaced FROM o WHERE n = 1
          UNION ALL SELECT o.identity, o.n, CASE WHEN o.source <> f.source OR o.seq > f.seq THEN o.source ELSE f.source END, CASE WHEN o.source <> f.source OR o.seq > f.seq THEN o.seq ELSE f.seq END,
                           f.replaced + CASE WHEN o.source <> f.source OR o.seq > f.seq THEN 1 ELSE 0 END FROM f JOIN o ON o.identity = f.identity AND o.n = f.n + 1)
    SELECT identity, max(n) AS request_count, arg_max(source, n) AS last_source, arg_max(seq, n) AS last_seq, arg_max(replaced, n) AS replaced FROM f GROUP BY identity"""
)
def imported_queue(spark, sf_dir):
    """The queue after bundles that come out of order and more than once."""
    return exchange.import_requests(_requests(spark, sf_dir))


_ITEMS = "SELECT user_id AS identity, count(*) AS attempts, max(event_id) AS token, max(ts) AS at, arg_max(event_type, event_id) AS kind FROM events GROUP BY user_id"


def _finished(spark, sf_dir):
    e = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("identity")).agg(F.count(F.lit(1)).alias("attempts"), F.max("event_id").alias("token"), F.max_by("event_type", "event_id").alias("kind"))
    items = e.select("identity", F.col("token").alias("lease_token"), "attempts", F.lit("leased").alias("status"))
    outcome = F.when(F.col("kind") == "view", "success").when(F.col("kind") == "click", "not_found").when(F.col("kind") == "error", "rate_limited").otherwise("failed")
    outcomes = e.where("identity % 4 <> 0").select("identity", (F.col("token") + F.when(F.col("identity") % 9 == 0, 1).otherwise(0)).alias("lease_token"), outcome.alias("outcome"))
    return exchange.finish_items(items, outcomes, F.timestamp_seconds(F.lit(1_700_000_000)))


@query(
    f"""WITH i AS ({_ITEMS}), o AS (SELECT *, CASE WHEN identity % 4 = 0 OR identity % 9 = 0 THEN NULL WHEN kind = 'view' THEN 'success' WHEN kind = 'click' THEN 'not_found' WHEN kind = 'error' THEN 'rate_limited' ELSE 'failed' END AS outcome FROM i)
    SELECT identity, CASE WHEN outcome IS NULL THEN 'leased' WHEN outcome = 'success' THEN 'resolved' ELSE 'pending' END AS status, attempts + CASE WHEN outcome IS NULL THEN 0 ELSE 1 END AS attempts,
           CASE WHEN outcome IS NOT NULL AND outcome <> 'success' THEN CAST(least(86400, CASE WHEN outcome IN ('not_found', 'rate_limited') THEN 3600 ELSE 300 END * power(2, least(attempts, 8))) AS BIGINT) ELSE 0 END AS wait_s FROM o"""
)
def finished_items(spark, sf_dir):
    after, _ = _finished(spark, sf_dir)
    return after.select("identity", "status", "attempts", F.coalesce(F.unix_timestamp("next_eligible_at") - 1_700_000_000, F.lit(0)).alias("wait_s"))


@query(
    """WITH r AS (SELECT user_id AS identity, max(event_id) AS last_seq, max(ts) AS last_requested_at FROM events GROUP BY user_id)
    SELECT identity, last_seq FROM r WHERE identity % 3 <> 0 ORDER BY last_seq DESC, last_requested_at DESC, identity LIMIT 100"""
)
def leased_items(spark, sf_dir):
    """The hundred items asked for last among those that are free."""
    items = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("identity")).agg(F.max("event_id").alias("last_seq"), F.max("ts").alias("last_requested_at"))
    items = items.withColumn("status", F.when(F.col("identity") % 3 == 0, "resolved").otherwise("pending")).withColumn("next_eligible_at", F.lit(None).cast("timestamp")).withColumn("lease_until", F.lit(None).cast("timestamp"))
    return exchange.lease(exchange.eligible_items(items, F.current_timestamp()), 100).select("identity", "last_seq")


@query("WITH v AS (SELECT user_id AS bundle_id, event_id AS place, CAST(round(value * 100) AS BIGINT) AS x FROM events), o AS (SELECT *, lag(x) OVER (PARTITION BY bundle_id ORDER BY place) AS b FROM v) SELECT bundle_id, place, 'order' AS violation FROM o WHERE b >= x UNION ALL SELECT bundle_id, place, 'form' FROM o WHERE x % 10 = 3")
def bundle_violations(spark, sf_dir):
    items = read(spark, sf_dir, "events").select(F.col("user_id").alias("bundle_id"), F.col("event_id").alias("place"), F.round(F.col("value") * 100).cast("long").alias("x"))
    return exchange.bundle_violations(items, "x", valid=F.col("x") % 10 != 3)


@query("""SELECT user_id AS bundle_id, count(DISTINCT event_type) AS n_items, sha256('[' || string_agg(DISTINCT '"' || event_type || '"', ',' ORDER BY '"' || event_type || '"') || ']') AS digest FROM events GROUP BY user_id""")
def bundle_digests(spark, sf_dir):
    return exchange.bundle_digest(read(spark, sf_dir, "events").select(F.col("user_id").alias("bundle_id"), "event_type"), "bundle_id", "event_type")


@query(
    """WITH RECURSIVE l AS (SELECT user_id % 20 AS run_id, user_id AS item, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, CASE WHEN event_type IN ('view', 'signup') THEN 'r' WHEN event_type IN ('click', 'purchase') THEN 'c' ELSE 'x' END AS kind, event_id % 100 AS cost FROM events),
    f AS (SELECT run_id, item, n, CASE WHEN kind = 'r' THEN [cost] ELSE [] END AS held, CAST(0 AS BIGINT) AS spent, kind <> 'r' AS bad FROM l WHERE n = 1
          UNION ALL SELECT l.run_id, l.item, l.n, CASE WHEN kind = 'r' THEN list_append(held, cost) ELSE held[1:len(held) - 1] END, spent + CASE WHEN kind = 'c' AND len(held) > 0 THEN cost ELSE 0 END, bad OR (kind <> 'r' AND len(held) = 0) FROM f JOIN l ON l.item = f.item AND l.n = f.n + 1),
    z AS (SELECT run_id, item, arg_max(coalesce(list_sum(held), 0) + spent, n) AS used, bool_or(bad) AS bad FROM f GROUP BY run_id, item)
    SELECT run_id, CAST(sum(used) AS BIGINT) AS used, bool_or(bad) AS malformed FROM z GROUP BY run_id"""
)
def budget_usage(spark, sf_dir):
    kind = F.when(F.col("event_type").isin("view", "signup"), "reserve").when(F.col("event_type").isin("click", "purchase"), "commit").otherwise("release")
    ledger = read(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("run_id"), F.col("user_id").alias("run_item_id"), F.col("event_id").alias("id"), kind.alias("kind"), (F.col("event_id") % 100).alias("cost"))
    return exchange.budget_usage(ledger)


@query(
    """WITH RECURSIVE i AS (SELECT user_id % 20 AS run_id, event_id AS id, event_id % 100 AS cost, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS n FROM events),
    f AS (SELECT run_id, CAST(-1 AS BIGINT) AS id, CAST(0 AS BIGINT) AS cost, CAST(0 AS BIGINT) AS n, false AS admitted, CAST(0 AS BIGINT) AS used FROM i WHERE n = 1
          UNION ALL SELECT i.run_id, i.id, i.cost, i.n, used + i.cost <= 5000, used + CASE WHEN used + i.cost <= 5000 THEN i.cost ELSE 0 END FROM f JOIN (SELECT *, n - 1 AS prior FROM i) i ON i.run_id = f.run_id AND i.prior = f.n)
    SELECT run_id, id, cost, admitted FROM f WHERE n > 0"""
)
def budget_admission(spark, sf_dir):
    """Requests that fit the cost of their run; each decision needs the one before."""
    return exchange.admit(read(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("run_id"), F.col("event_id").alias("id"), (F.col("event_id") % 100).alias("cost")), 5000)


@query("SELECT l_orderkey, l_linenumber, CAST(ceil(CAST(l_quantity AS DECIMAL(20, 0)) * CAST(l_tax AS DECIMAL(18, 4)) + CAST(l_extendedprice AS DECIMAL(20, 0)) * CAST(l_discount AS DECIMAL(18, 4))) AS BIGINT) AS cost FROM lineitem")
def token_costs(spark, sf_dir):
    """Exact cost, rounded up, with quantities and prices as tokens."""
    c = lambda n: F.col(n).cast("decimal(20,0)").cast("long")
    rate = lambda n: F.col(n).cast("decimal(18,4)")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", exchange.cost_micro_usd(c("l_quantity"), c("l_extendedprice"), rate("l_tax"), rate("l_discount")).alias("cost"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(v, '^[=+@-]') THEN '''' || v ELSE v END AS safe FROM (SELECT p_partkey, ['=', '+', '-', '@', ''][1 + p_partkey % 5] || p_name AS v FROM part)")
def csv_guard(spark, sf_dir):
    sign = F.get(F.array(*[F.lit(s) for s in ("=", "+", "-", "@", "")]), (F.col("p_partkey") % 5).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", strings.csv_safe(F.concat(sign, F.col("p_name"))).alias("safe"))


@query(r"SELECT doc_id, regexp_replace(left(source || '__' || 'p/' || doc_id || '.yar', 160), '[^A-Za-z0-9_]', '_', 'g') || '_' || left(sha256('p/' || doc_id || '.yar'), 12) AS namespace FROM documents")
def rule_namespaces(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", strings.rule_namespace(F.col("source"), F.concat(F.lit("p/"), F.col("doc_id").cast("string"), F.lit(".yar"))).alias("namespace"))


@query(
    """WITH e AS (SELECT 'a' || (user_id % 4) AS adapter, CASE WHEN user_id % 4 = 1 THEN 'failed' ELSE 'warning' END AS severity, 'c' || (event_id % 40 + 10) AS code FROM events WHERE event_type = 'error')
    SELECT a.adapter, CASE WHEN bool_or(severity = 'failed') THEN 'failed' WHEN count(code) > 0 THEN 'degraded' ELSE 'success' END AS state, coalesce(array_to_string(list_sort(list(DISTINCT code))[1:32], ','), '') AS codes
    FROM (SELECT unnest(['a0', 'a1', 'a2', 'a3', 'a9']) AS adapter) a LEFT JOIN e ON e.adapter = a.adapter GROUP BY a.adapter"""
)
def adapter_states(spark, sf_dir):
    """The state of each adapter and the first 32 of its codes."""
    e = read(spark, sf_dir, "events").where("event_type = 'error'")
    errors = e.select(F.concat(F.lit("a"), (F.col("user_id") % 4).cast("string")).alias("adapter"), F.when(F.col("user_id") % 4 == 1, "failed").otherwise("warning").alias("severity"), F.concat(F.lit("c"), (F.col("event_id") % 40 + 10).cast("string")).alias("code"))
    return lookups.adapter_status(errors, ["a0", "a1", "a2", "a3", "a9"])


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) % 3 = 0 THEN 'yes' WHEN CAST(json_extract(props, '$.k') AS BIGINT) % 3 = 1 THEN 'no' ELSE 'unknown' END AS verdict FROM events")
def provider_reports(spark, sf_dir):
    """Provider answers in JSON as rows."""
    k = F.variant_get(F.parse_json("props"), "$.k", "long")
    return read(spark, sf_dir, "events").select("event_id", k.alias("k"), F.when(k % 3 == 0, "yes").when(k % 3 == 1, "no").otherwise("unknown").alias("verdict"))


@query("SELECT source, count(*) AS files, CAST(sum(octet_length(encode(coalesce(text, '')))) AS BIGINT) AS bytes FROM documents GROUP BY source")
def inventory_totals(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("bytes"))


@query("SELECT c_custkey, c_mktsegment || CASE WHEN row_number() OVER (PARTITION BY c_mktsegment || c_nationkey ORDER BY c_custkey) = 1 THEN '' ELSE '-' || row_number() OVER (PARTITION BY c_mktsegment || c_nationkey ORDER BY c_custkey) END AS tail FROM customer")
def unique_names(spark, sf_dir):
    """Names made different by a number."""
    named = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("name"))
    made = dedupe_names(named, "name", ["c_custkey"])
    return made.select("c_custkey", F.concat("c_mktsegment", F.expr("substring(unique_name, length(name) + 1)")).alias("tail"))
