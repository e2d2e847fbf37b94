"""Registered queries: answers, evidence, summaries, nested children."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkintel.operators import answers, evidence, lookups
from sparkintel.plans.queries import _EVENT_IPS, query
from sparkintel.plans.tables import event_ips, read


@query(f"SELECT ip, string_agg(event_type || '@' || event_id, ',' ORDER BY event_type DESC, event_id) AS children FROM (SELECT DISTINCT ip, event_type, event_id FROM ({_EVENT_IPS})) GROUP BY ip")
def nested_children(spark, sf_dir):
    """Children of each address as an ordered array, the type descending and the number ascending."""
    e = event_ips(spark, sf_dir).select("ip", "event_type", "event_id").distinct()
    down = F.transform(F.split("event_type", ""), lambda c: -F.ascii(c))
    nested = lookups.nest(e, "ip", ["event_type", "event_id"], "children", [F.array_append(down, F.lit(1)), F.col("event_id")])
    return nested.select("ip", F.array_join(F.transform("children", lambda c: F.concat_ws("@", c["event_type"], c["event_id"].cast("string"))), ",").alias("children"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS leaf FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_leaf_rows(spark, sf_dir):
    return answers.json_leaves(read(spark, sf_dir, "events"), "event_id", "props")


@query(
    """WITH b AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '{"summary": "s", "extra": 1}' WHEN 1 THEN '{"summary": "  "}' ELSE CAST(json_object('summary', 'about ' || source) AS VARCHAR) END AS body FROM documents),
    j AS (SELECT doc_id, json_keys(body) AS keys, json_extract_string(body, '$.summary') AS summary FROM b)
    SELECT doc_id, 'unknown_field' AS violation FROM j WHERE len(list_filter(keys, lambda k: k NOT IN ('summary', 'tool_types', 'people'))) > 0 UNION ALL SELECT doc_id, 'blank' FROM j WHERE trim(summary) = ''"""
)
def answer_violations(spark, sf_dir):
    """Checks of structured answers made of documents."""
    body = F.when(F.col("doc_id") % 3 == 0, F.lit('{"summary": "s", "extra": 1}')).when(F.col("doc_id") % 3 == 1, F.lit('{"summary": "  "}')).otherwise(F.to_json(F.struct(F.concat(F.lit("about "), "source").alias("summary"))))
    return answers.answer_violations(read(spark, sf_dir, "documents").select("doc_id", body.alias("body")), "doc_id", "body")


_BLOCK = """'<source id="' || doc_id || '" locator="' || source || '/' || doc_id || '.md" untrusted="true">' || chr(10) || coalesce(text, '') || chr(10) || '</source>'"""


def _all_sources(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    locator = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return read(spark, sf_dir, "documents").select(F.col("source").alias("repository_id"), F.col("doc_id").alias("place"), F.col("doc_id").alias("version_id"), locator.alias("locator"), text.alias("content"), F.sha2(text, 256).alias("content_hash"))


@query(
    f"""SELECT source AS repository_id, sha256('[' || string_agg('{{"hash":"' || sha256(coalesce(text, '')) || '","version_id":' || doc_id || '}}', ',' ORDER BY doc_id) || ']') AS set_hash,
           length(string_agg({_BLOCK}, chr(10) || chr(10) ORDER BY doc_id)) AS n FROM documents GROUP BY source"""
)
def evidence_blocks(spark, sf_dir):
    """All documents of each source with their whole texts."""
    return evidence.evidence_blocks(_all_sources(spark, sf_dir))


@query(f"SELECT source AS repository_id, doc_id AS place, {_BLOCK} AS text FROM documents")
def evidence_block_rows(spark, sf_dir):
    """The blocks themselves, as rows to be read in order of place."""
    return evidence.evidence_rows(_all_sources(spark, sf_dir)).drop("entry")


@query("SELECT event_type AS metric, CAST(sum(event_id) AS BIGINT) AS value FROM events GROUP BY event_type")
def summed_metrics(spark, sf_dir):
    return answers.sum_metrics(read(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), F.col("event_id").alias("value")))


@query(f"WITH e AS ({_EVENT_IPS}) SELECT count(*) AS tuples, count(DISTINCT ip) AS ips, least(count(DISTINCT ip), 1000) AS selected, count(DISTINCT ip) FILTER (ip IN (SELECT ip FROM e WHERE event_type = 'view')) AS completed, count(DISTINCT ip) - count(DISTINCT ip) FILTER (ip IN (SELECT ip FROM e WHERE event_type = 'view')) AS remaining FROM e")
def enrich_summary(spark, sf_dir):
    e = event_ips(spark, sf_dir)
    return answers.enrich_summary(e.select("ip"), e.where("event_type = 'view'"), 1000).withColumn("selected", F.col("selected").cast("long"))


@query(r"SELECT c_custkey, trim(regexp_replace(lower('  ' || upper(c_name) || '  ' || chr(9) || ' X '), '\s+', ' ', 'g')) AS name FROM customer")
def normal_names(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", answers.normal_name(F.concat(F.lit("  "), F.upper("c_name"), F.lit("  \t X "))).alias("name"))
