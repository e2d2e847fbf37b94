"""Registered queries: the request queue, leases, bundles and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkintel.operators import exchange, stores
from sparkintel.plans.queries import query
from sparkintel.plans.tables import event_ips, read


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests of bundles of six: identity, payload, bundle_id, source, seq, created_at, import_seq.

    Every eleventh bundle is the one before it again; every fortieth has the sequence of an earlier one.
    """
    e = read(spark, sf_dir, "events").withColumn("place", F.floor(F.col("event_id") / 6))
    own = F.col("place") - F.when(F.col("place") % 11 == 10, 1).otherwise(0)
    e = e.withColumn("b", own)
    seq = F.floor(F.col("b") / 3) - F.when(F.col("b") % 40 == 39, 1).otherwise(0)
    text = lambda c: c.cast("string")
    return e.select((F.col("user_id") % 300).alias("identity"), F.concat(F.lit("p"), text(F.col("event_id"))).alias("payload"), F.concat(F.lit("b"), text(F.col("b"))).alias("bundle_id"), F.concat(F.lit("s"), text(F.col("b") % 3)).alias("source"), seq.alias("seq"), F.timestamp_seconds(F.col("b")).alias("created_at"), F.col("place").alias("import_seq"))


_REQUESTS = """
    placed AS (SELECT *, event_id // 6 AS place, event_id // 6 - CASE WHEN event_id // 6 % 11 = 10 THEN 1 ELSE 0 END AS b FROM events),
    requests AS (SELECT user_id % 300 AS identity, 'p' || event_id AS payload, 'b' || b AS bundle_id, 's' || (b % 3) AS source, b // 3 - CASE WHEN b % 40 = 39 THEN 1 ELSE 0 END AS seq, b, place AS import_seq FROM placed),
    ledger AS (SELECT DISTINCT bundle_id, source, seq FROM requests WHERE b % 50 = 0),
    once AS (SELECT bundle_id, any_value(source) AS source, any_value(seq) AS seq, min(import_seq) AS import_seq FROM requests WHERE bundle_id NOT IN (SELECT bundle_id FROM ledger) GROUP BY bundle_id),
    judged AS (SELECT o.*, first_value(o.bundle_id) OVER (PARTITION BY o.source, o.seq ORDER BY o.import_seq, o.bundle_id) AS first, l.bundle_id AS holder FROM once o LEFT JOIN ledger l ON l.source = o.source AND l.seq = o.seq)"""


def _bundles(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bundles to import, and those that conflict; every fiftieth is in the ledger."""
    bundles = requests.select("bundle_id", "source", "seq", "import_seq").distinct()
    ledger = bundles.where(F.substring("bundle_id", 2, 20).cast("long") % 50 == 0).select("bundle_id", "source", "seq").distinct()
    return exchange.new_bundles(bundles, ledger)


@query(f"WITH {_REQUESTS} SELECT bundle_id, source, seq, coalesce(holder, first) AS conflicts_with FROM judged WHERE holder IS NOT NULL OR first <> bundle_id")
def conflicting_bundles(spark, sf_dir):
    """Bundles that have the source and sequence of another: the one that is recorded, or came first, holds."""
    return _bundles(_requests(spark, sf_dir))[1]


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as they were before: every third identity, leased or waiting, some of them rate limited."""
    ids = read(spark, sf_dir, "events").select((F.col("user_id") % 300).alias("identity")).distinct().where("identity % 3 = 0")
    k, at = F.col("identity"), lambda s: F.timestamp_seconds(F.lit(s))
    values = {
        "payload": F.lit("old"), "first_requested_at": at(0), "last_requested_at": at(0), "last_source": F.concat(F.lit("s"), (k % 2).cast("string")), "last_seq": F.lit(40), "last_bundle_id": F.lit("b0"), "request_count": F.lit(2),
        "status": F.when(k % 2 == 0, "leased").otherwise("resolved"), "last_outcome": F.when(k % 4 == 0, "rate_limited").when(k % 4 == 1, "success"), "next_eligible_at": F.when(k % 4 == 0, at(500)).when(k % 4 == 2, at(600)),
        "lease_until": F.when(k % 2 == 0, at(700)), "lease_token": F.when(k % 2 == 0, F.lit("t")), "attempts": F.lit(1),
    }
    return ids.select("identity", *[values[f.split()[0]].cast(f.split()[1]).alias(f.split()[0]) for f in exchange.ITEM.split(", ")])


_ITEMS = """
    items AS (SELECT DISTINCT user_id % 300 AS identity FROM events WHERE user_id % 300 % 3 = 0),
    fresh AS (SELECT r.* FROM requests r JOIN (SELECT bundle_id, min(import_seq) AS i FROM judged WHERE holder IS NULL AND first = bundle_id GROUP BY 1) j ON j.bundle_id = r.bundle_id AND j.i = r.import_seq),
    asked AS (SELECT identity, bundle_id, any_value(source) AS source, any_value(seq) AS seq, min(payload) AS payload, any_value(import_seq) AS i, any_value(b) AS b FROM fresh GROUP BY identity, bundle_id),
    steps AS (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY i) AS n FROM asked),
    f AS (SELECT s.identity, 0 AS n, CASE WHEN i.identity IS NOT NULL THEN 's' || (s.identity % 2) END AS source, CASE WHEN i.identity IS NOT NULL THEN 40 END AS seq, CASE WHEN i.identity IS NOT NULL THEN 2 ELSE 0 END AS request_count, 'old' AS payload,
                 CASE WHEN s.identity % 2 = 0 THEN 'leased' ELSE 'resolved' END AS status, CASE s.identity % 4 WHEN 0 THEN 500 WHEN 2 THEN 600 END AS wait, 'b0' AS bundle
          FROM (SELECT DISTINCT identity FROM steps UNION SELECT identity FROM items) s LEFT JOIN items i ON i.identity = s.identity
          UNION ALL
          SELECT f.identity, s.n, CASE WHEN w THEN s.source ELSE f.source END, CASE WHEN w THEN s.seq ELSE f.seq END, f.request_count + 1, CASE WHEN w THEN s.payload ELSE f.payload END, CASE WHEN w THEN 'pending' ELSE f.status END,
                 CASE WHEN f.source IS NULL THEN NULL WHEN w AND f.identity % 4 <> 0 THEN NULL ELSE f.wait END, CASE WHEN w THEN s.bundle_id ELSE f.bundle END
          FROM f JOIN (SELECT *, n - 1 AS prior FROM steps) s ON s.identity = f.identity AND s.prior = f.n, LATERAL (SELECT coalesce(f.source <> s.source OR s.seq > f.seq, true) AS w))"""


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = _requests(spark, sf_dir)
    fresh, _ = _bundles(requests)
    asked = requests.join(fresh.select("bundle_id", "import_seq"), ["bundle_id", "import_seq"])
    one = asked.groupBy("identity", "bundle_id", "source", "seq", "created_at", "import_seq").agg(F.min("payload").alias("payload"))
    return exchange.import_bundles(_items(spark, sf_dir), one)


@query(
    f"""WITH RECURSIVE {_REQUESTS}, {_ITEMS}
    SELECT identity, arg_max(payload, n) AS payload, arg_max(source, n) AS last_source, arg_max(seq, n) AS last_seq, max(request_count) AS request_count, arg_max(status, n) AS status,
           arg_max(coalesce(wait, -1), n) AS wait_s, arg_max(status, n) = 'leased' AS leased FROM f GROUP BY identity"""
)
def imported_bundles(spark, sf_dir):
    """The queue after new bundles: payloads replaced, items pending again, leases and waits ended."""
    q = _queue(spark, sf_dir)
    return q.select("identity", "payload", "last_source", "last_seq", "request_count", "status", F.coalesce(F.unix_timestamp("next_eligible_at"), F.lit(-1)).alias("wait_s"), F.col("lease_token").isNotNull().alias("leased"))


@query(
    f"""WITH RECURSIVE {_REQUESTS}, {_ITEMS},
    q AS (SELECT identity, arg_max(seq, n) AS seq, arg_max(status, n) AS status, arg_max(coalesce(wait, -1), n) AS wait, arg_max(bundle, n) AS bundle FROM f GROUP BY identity)
    SELECT identity, CASE WHEN CAST(substr(bundle, 2) AS BIGINT) % 2 = 0 THEN 'missing' ELSE 'all' END AS selection FROM q WHERE status <> 'resolved' AND wait <= 550 AND status <> 'leased'
    ORDER BY seq DESC, CAST(substr(bundle, 2) AS BIGINT) DESC, identity LIMIT 40"""
)
def leased_with_selection(spark, sf_dir):
    """The forty free items asked for last, with what their bundle selects."""
    selection = F.when(F.substring("bundle_id", 2, 20).cast("long") % 2 == 0, "missing").otherwise("all")
    bundles = _requests(spark, sf_dir).select("bundle_id").distinct().withColumn("selection", selection)
    return exchange.lease_items(_queue(spark, sf_dir), bundles, 40, F.timestamp_seconds(F.lit(550))).select("identity", "selection")


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budget events of items with five measures; a release mostly has its reserve's value."""
    kind = F.when(F.col("event_type").isin("view", "signup"), "reserve").when(F.col("event_type").isin("click", "purchase"), "commit").otherwise("release")
    e = read(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("run_id"), F.col("user_id").alias("run_item_id"), F.col("event_id").alias("id"), kind.alias("kind"), "user_id")
    values = [F.lit(1), F.col("user_id") % 2, F.col("user_id") % 50 + F.when(F.col("id") % 400 == 0, 1).otherwise(0), F.col("user_id") % 7, F.col("user_id") % 900]
    return e.select("run_id", "run_item_id", "id", "kind", *[v.cast("long").alias(m) for m, v in zip(exchange.MEASURES, values, strict=True)])


_VALUES = "[1, user_id % 2, user_id % 50 + CASE WHEN event_id % 400 = 0 THEN 1 ELSE 0 END, user_id % 7, user_id % 900]"
_SUMS = ", ".join(f"CAST(sum(used[{k + 1}]) AS BIGINT) AS {m}" for k, m in enumerate(exchange.MEASURES))


@query(
    f"""WITH RECURSIVE l AS (SELECT user_id % 20 AS run_id, user_id AS item, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, CASE WHEN event_type IN ('view', 'signup') THEN 'r' WHEN event_type IN ('click', 'purchase') THEN 'c' ELSE 'x' END AS kind, {_VALUES} AS v FROM events),
    f AS (SELECT run_id, item, 0 AS n, CAST([] AS BIGINT[][]) AS held, CAST([0, 0, 0, 0, 0] AS BIGINT[]) AS spent, false AS bad FROM (SELECT DISTINCT run_id, item FROM l)
          UNION ALL SELECT l.run_id, l.item, l.n, CASE WHEN kind = 'r' THEN list_append(held, v) ELSE held[1:len(held) - 1] END,
                           CASE WHEN kind = 'c' AND len(held) > 0 THEN list_transform(list_zip(spent, v), lambda z: z[1] + z[2]) ELSE spent END,
                           bad OR (kind <> 'r' AND len(held) = 0) OR (kind = 'x' AND len(held) > 0 AND held[len(held)] <> v) FROM f JOIN (SELECT *, n - 1 AS prior FROM l) l ON l.item = f.item AND l.prior = f.n),
    z AS (SELECT run_id, item, arg_max([spent[1] + coalesce(list_sum(list_transform(held, lambda h: h[1])), 0), spent[2] + coalesce(list_sum(list_transform(held, lambda h: h[2])), 0), spent[3] + coalesce(list_sum(list_transform(held, lambda h: h[3])), 0),
                 spent[4] + coalesce(list_sum(list_transform(held, lambda h: h[4])), 0), spent[5] + coalesce(list_sum(list_transform(held, lambda h: h[5])), 0)], n) AS used, bool_or(bad) AS bad FROM f GROUP BY run_id, item)
    SELECT run_id, {_SUMS}, bool_or(bad) AS malformed FROM z GROUP BY run_id"""
)
def budget_measures(spark, sf_dir):
    """Use of each run by all five measures."""
    return exchange.budget_measures(_ledger(spark, sf_dir))


LIMITS = dict(zip(exchange.MEASURES, (60, 40, 2500, 180, 40_000), strict=True))


def _budget_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reserves, settlements of the value of the event before, and releases, of runs of users."""
    kind = F.when(F.col("event_type") == "click", "settle").when(F.col("event_type") == "error", "release").otherwise("reserve")
    value = lambda c: [F.lit(1), c % 2, c % 100, c % 7, c % 1500]
    e = read(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 40).alias("run_id"), F.col("event_id").alias("id"), kind.alias("kind"), *[v.alias(m) for m, v in zip(exchange.MEASURES, value(F.col("event_id")), strict=True)], *[v.alias(f"reserved_{m}") for m, v in zip(exchange.MEASURES, value(F.col("event_id") - 1), strict=True)])


_V = lambda c: f"[1, {c} % 2, {c} % 100, {c} % 7, {c} % 1500]"
_USED = ", ".join(f"used[{k + 1}] AS {m}" for k, m in enumerate(exchange.MEASURES))


@query(
    f"""WITH RECURSIVE e AS (SELECT user_id % 40 AS run_id, event_id AS id, CASE event_type WHEN 'click' THEN 'settle' WHEN 'error' THEN 'release' ELSE 'reserve' END AS kind, {_V('event_id')} AS v, {_V('(event_id - 1)')} AS r, row_number() OVER (PARTITION BY user_id % 40 ORDER BY event_id) AS n FROM events),
    f AS (SELECT run_id, CAST(-1 AS BIGINT) AS id, '' AS kind, 0 AS n, false AS allowed, CAST([0, 0, 0, 0, 0] AS BIGINT[]) AS used FROM (SELECT DISTINCT run_id FROM e)
          UNION ALL SELECT run_id, id, kind, n, good, CASE WHEN good THEN after ELSE used END FROM (
              SELECT e.run_id, e.id, e.kind, e.n, f.used, list_transform(list_zip(f.used, e.v, e.r), lambda z: CASE e.kind WHEN 'reserve' THEN z[1] + z[2] WHEN 'release' THEN z[1] - z[2] ELSE z[1] - z[3] + z[2] END) AS after,
                     list_min(after) >= 0 AND (e.kind = 'release' OR (after[1] <= {LIMITS['requests']} AND after[2] <= {LIMITS['repositories']} AND after[3] <= {LIMITS['input_tokens']} AND after[4] <= {LIMITS['output_tokens']} AND after[5] <= {LIMITS['cost_micro_usd']})) AS good
              FROM f JOIN (SELECT *, n - 1 AS prior FROM e) e ON e.run_id = f.run_id AND e.prior = f.n))
    SELECT run_id, id, kind, allowed, {_USED} FROM f WHERE n > 0"""
)
def admitted_reservations(spark, sf_dir):
    """Reserves, settlements and releases against five ceilings, each decided after the one before."""
    return exchange.admit_reservations(_budget_events(spark, sf_dir), LIMITS)


def _bundle_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle for each user as JSON; by its number one has too many fields, a wrong count, time, digest or sequence."""
    k = F.col("user_id")
    text: Column = F.concat(
        F.lit('{"schema_version":1,"bundle_id":"00000000-0000-0000-0000-'), F.lpad(k.cast("string"), 12, "0"), F.lit('","source_instance_id":"11111111-2222-3333-4444-555555555555","source_sequence":'), F.when(k % 7 == 1, "0").otherwise(F.lit("5")),
        F.lit(',"created_at":"2024-0'), F.when(k % 7 == 2, "2-31").otherwise(F.lit("2-29")), F.lit('T10:00:00Z","selection":"'), F.when(k % 7 == 3, "some").otherwise(F.lit("missing")), F.lit('","policy_sha256":"'), F.when(k % 7 == 4, "AB").otherwise(F.sha2(k.cast("string"), 256)),
        F.lit('","files":[],"ips":["1.1.1.1"],"repositories":[],"counts":{"files":0,"ips":'), F.when(k % 7 == 5, "2").otherwise(F.lit("1")), F.lit(',"repositories":0}'), F.when(k % 7 == 6, ',"more":1').otherwise(F.lit("")), F.lit("}"),
    )
    return read(spark, sf_dir, "events").select("user_id").distinct().select(k.cast("long").alias("bundle_id"), text.alias("body"))


@query("SELECT user_id AS bundle_id, ['sequence', 'time', 'selection', 'policy', 'counts', 'fields'][user_id % 7] AS violation FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 7 > 0")
def bundle_header_violations(spark, sf_dir):
    """What is wrong with whole bundles; each was given one fault, or none."""
    return exchange.header_violations(_bundle_bodies(spark, sf_dir))


@query(
    r"""WITH e AS (SELECT user_id, event_id, lag(event_id % 90) OVER w AS b, event_id % 90 AS v FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    i AS (SELECT user_id AS bundle_id, event_id AS place, '10.0.' || lpad(CAST(v AS VARCHAR), CASE WHEN v % 30 = 7 THEN 3 ELSE 1 END + CASE WHEN v > 9 AND v % 30 <> 7 THEN 1 ELSE 0 END, '0') || '.1' AS value FROM e),
    o AS (SELECT *, lag(value) OVER (PARTITION BY bundle_id ORDER BY place) AS before FROM i)
    SELECT bundle_id, 'ips' AS kind, place, 'order' AS violation FROM o WHERE before >= value
    UNION ALL SELECT bundle_id, 'ips', place, 'form' FROM o WHERE NOT regexp_full_match(value, '(0|[1-9][0-9]{0,2})(\.(0|[1-9][0-9]{0,2})){3}')"""
)
def indicator_violations(spark, sf_dir):
    """Addresses of bundles that do not ascend or are not canonical."""
    v = F.col("event_id") % 90
    octet = F.when(v % 30 == 7, F.lpad(v.cast("string"), 3, "0")).otherwise(v.cast("string"))
    items = read(spark, sf_dir, "events").select(F.col("user_id").alias("bundle_id"), F.lit("ips").alias("kind"), F.col("event_id").alias("place"), F.concat(F.lit("10.0."), octet, F.lit(".1")).alias("value"), F.lit(None).cast("string").alias("extra"))
    return exchange.indicator_violations(items)


@query("SELECT CAST(ceil((count(DISTINCT ip) + count(DISTINCT user_id) + count(DISTINCT event_type)) / 400000.0) AS INTEGER) AS bundles, count(DISTINCT ip) AS n_ips, count(DISTINCT user_id) AS n_files, count(DISTINCT event_type) AS n_repositories FROM (SELECT user_id, event_type, concat_ws('.', 1 + user_id % 223, event_id % 7, user_id % 251, 1 + event_id % 5) AS ip FROM events)")
def bundle_counts(spark, sf_dir):
    """All addresses, a file for each user and a repository for each type of event, in as many bundles as they need."""
    e = event_ips(spark, sf_dir)
    files = e.select(F.sha2(F.col("user_id").cast("string"), 256).alias("sha256"), F.md5(F.col("user_id").cast("string")).alias("md5"))
    repositories = e.select(F.concat(F.lit("github.com/owner/"), "event_type").alias("identity_key"))
    bundles = stores.write_bundle(files, e.select("ip"), repositories, {"schema_version": F.lit(1)})
    read_back = stores.read_bundle(bundles.select(F.col("bundle").alias("bundle_id"), "body", "sha256"))
    sizes = [F.sum(F.size(c)).alias(n) for c, n in (("ips", "n_ips"), ("files", "n_files"), ("repositories", "n_repositories"))]
    return read_back.agg(F.count(F.lit(1)).cast("int").alias("bundles"), *sizes)
