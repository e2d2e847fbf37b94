import itertools
import random
import re

from pyspark.sql import functions as F

from sparkintel.functions.literals import find_literals, parts_of
from sparkintel.operators import exchange, indicators, lookups, merges, signatures
from sparkintel.operators.signatures import attach_provenance, cap_strings, match_signatures


def test_lookup_outcomes(spark):
    entities = spark.createDataFrame([("8.8.8.8", 4, "US", "x", None), ("1.1.1.1", 4, None, None, None), ("2.2.2.2", 6, "US", None, "Yes"), ("3.3.3.3", 4, "US", None, "Yes"), ("3.3.3.3", 4, "DE", None, "No"), ("4.4.4.4", 4, "US", None, "odd")], "ip string, ip_version int, country_code string, whois string, malicious string")
    providers = spark.createDataFrame([("8.8.8.8", "failed"), ("1.1.1.1", "not_found"), ("1.1.1.1", "failed")], "ip string, provider_status string")
    seen = spark.createDataFrame([(f"{k}.{k}.{k}.{k}",) for k in (8, 1, 2, 3, 4, 5)], "ip string")
    got = {r["ip"][0]: r["status"] for r in lookups.lookup_ips(seen, entities, providers).collect()}
    assert got == {"8": "hit", "1": "miss", "2": "error", "3": "error", "4": "error", "5": "miss"}
    assert {r["status"] for r in lookups.lookup_ips(seen, None).collect()} == {"unavailable"}
    child = spark.createDataFrame([("1.1.1.1", "a.example")], "ip string, domain string")
    assert {r["ip"]: r["status"] for r in lookups.lookup_ips(seen, entities, providers, {"dns": child}).collect()}["1.1.1.1"] == "hit"


def test_file_ambiguity(spark):
    files = spark.createDataFrame([(1, "s1", "m1", "yes"), (2, None, "m2", "no"), (3, None, "m2", "no"), (4, "s9", "m4", "no"), (5, None, "m5", "no")], "file_id long, sha256_hash string, md5_hash string, malicious string")
    seen = spark.createDataFrame([("s1", "m1"), ("s2", "m2"), ("s4", "m4"), ("s5", "m5"), ("s6", "m6")], "sha256 string, md5 string")
    got = {r["sha256"]: (r["status"], r["match_type"], r["reason"], r["file_ids"]) for r in lookups.lookup_files(seen, files).collect()}
    assert got["s1"] == ("hit", "sha256", None, "1") and got["s5"] == ("hit", "md5", None, "5") and got["s6"][0] == "miss"
    assert got["s2"] == ("ambiguous", None, "multiple_md5_rows", "2,3") and got["s4"] == ("ambiguous", None, "conflicting_sha256", "4")


def test_singularity_starts_above_the_threshold(spark):
    rows = [("f", f"8.8.8.{k}") for k in range(1, 22)] + [("g", f"8.8.8.{k}") for k in range(1, 21)]
    obs = spark.createDataFrame(rows, "file string, ip string")
    assert [tuple(r) for r in indicators.singular_files(obs, ["file"], "ip").collect()] == [("f", 21)]
    assert {r["file"] for r in indicators.without_singular(obs, ["file"], "ip").collect()} == {"g"}


def fold_in_python(rows):
    at = country = None
    for _, updated, value in sorted(rows):
        newer = at is None or updated > at
        country = (value or country or None) if newer else (country or value or None)
        at = max(at or updated, updated)
    return country


def test_ip_merge_in_every_order(spark):
    base = [("1", "US"), ("3", ""), ("2", "GB"), ("4", None)]
    data, want = [], {}
    for n, order in enumerate(itertools.permutations(base)):
        rows = [(k, t, c) for k, (t, c) in enumerate(order)]
        want[f"ip{n}"] = fold_in_python(rows)
        data += [(f"ip{n}", k, t, t, c, None) for k, t, c in rows]
    random.Random(1).shuffle(data)
    df = spark.createDataFrame(data, "ip string, import_seq long, last_updated string, first_seen string, country_code string, malicious string")
    for parts in (1, 2, 8):
        got = {r["ip"]: r["country_code"] for r in merges.merge_ip_snapshots(df.repartition(parts)).collect()}
        assert got == want
    first = spark.createDataFrame([("a", 1, "1", "1", "US", "No"), ("a", 2, "3", "3", "", "Yes"), ("a", 3, "2", "2", "GB", None)], df.schema)
    row = merges.merge_ip_snapshots(first).first()
    assert (row["country_code"], row["malicious"], row["first_seen"], row["last_updated"]) == ("US", "Yes", "1", "3")


def test_verdicts_watch_and_timestamps(spark):
    df = spark.createDataFrame([("a", "yes", "2024-01-01T00:00:00Z"), ("a", "no", "bad"), ("b", "unknown", "2024-01-01T02:00:00+02:00"), ("b", "no", "2024-01-01T01:00:00Z"), ("c", None, None)], "k string, v string, t string")
    got = {r["k"]: tuple(r)[1:] for r in df.groupBy("k").agg(merges.max_verdict(F.col("v"), ["yes", "no", "unknown"]), merges.latest(F.col("t"))).collect()}
    assert got["a"] == ("yes", "2024-01-01T00:00:00Z") and got["b"] == ("no", "2024-01-01T01:00:00Z") and got["c"][0] is None
    a = spark.createDataFrame([("x", "scanned"), ("y", "new"), ("z", "new")], "d string, status string")
    b = spark.createDataFrame([("x", "new"), ("y", "scanning"), ("w", "failed")], "d string, status string")
    assert {tuple(r) for r in merges.merge_watch(a, b, ["d"]).collect()} == {("x", "scanned", True), ("y", "scanning", True), ("z", "new", False), ("w", "failed", False)}


def test_queue(spark):
    rows = [("1.1.1.1", "s", 1, 1), ("8.8.8.8", "s", 1, 1), ("1.1.1.1", "s", 1, 2), ("8.8.8.8", "s", 1, 2), ("1.1.1.1", "s", 3, 3), ("8.8.8.8", "s", 2, 4)]
    queue = exchange.import_requests(spark.createDataFrame(rows, "identity string, source string, seq long, import_seq long"))
    got = {r["identity"]: (r["request_count"], r["last_seq"]) for r in queue.collect()}
    assert got == {"1.1.1.1": (2, 3), "8.8.8.8": (2, 2)}
    asked = queue.withColumn("last_requested_at", F.lit(0))
    assert [r["identity"] for r in exchange.lease(asked, 2).collect()] == ["1.1.1.1", "8.8.8.8"]
    items = spark.createDataFrame([("a", "t1", 0, "leased"), ("b", "t2", 9, "leased"), ("c", "t3", 0, "leased")], "identity string, lease_token string, attempts long, status string")
    outcomes = spark.createDataFrame([("a", "t1", "rate_limited"), ("b", "t2", "failed"), ("c", "stale", "success")], "identity string, lease_token string, outcome string")
    after, pause = exchange.finish_items(items, outcomes, F.timestamp_seconds(F.lit(0)))
    waits = {r["identity"]: (r["status"], r["attempts"], r["w"]) for r in after.withColumn("w", F.unix_timestamp("next_eligible_at")).collect()}
    assert waits == {"a": ("pending", 1, 3600), "b": ("pending", 10, 76800), "c": ("leased", 0, None)}
    assert pause.select(F.unix_timestamp("paused_until")).first()[0] == 3600


def test_budgets(spark):
    requests = spark.createDataFrame([(1, 1, 600), (1, 2, 600), (1, 3, 400), (2, 1, 1001)], "run_id long, id long, cost long")
    assert {(r["run_id"], r["id"]): r["admitted"] for r in exchange.admit(requests, 1000).collect()} == {(1, 1): True, (1, 2): False, (1, 3): True, (2, 1): False}
    cost = spark.range(1).select(exchange.cost_micro_usd(F.lit(1), F.lit(1), F.lit("0.1"), F.lit("0.1"))).first()[0]
    assert cost == 1
    ledger = spark.createDataFrame([(1, 1, 1, "reserve", 10), (1, 1, 2, "reserve", 5), (1, 1, 3, "commit", 4), (1, 2, 4, "release", 3)], "run_id long, run_item_id long, id long, kind string, cost long")
    assert tuple(exchange.budget_usage(ledger).first()) == (1, 14, True)


def test_signatures(spark):
    files = spark.createDataFrame([(1, "xx needle and thread needle"), (2, "needle only"), (3, "none")], "id long, text string")
    rules = spark.createDataFrame([("ns", "any", "a", "needle", "any"), ("ns", "any", "b", "thread", "any"), ("ns", "both", "a", "needle", "all"), ("ns", "both", "b", "thread", "all"), ("zz", "n", "a", "needle", "1")], "namespace string, rule string, pattern_id string, pattern string, condition string")
    got = match_signatures(files, "id", "text", rules)
    assert sorted((r["id"], r["rule"], r["n_strings"], r["first_offset"]) for r in got.collect()) == [(1, "any", 3, 3), (1, "both", 3, 3), (1, "n", 2, 3), (2, "any", 1, 0), (2, "n", 1, 0)]
    manifest = spark.createDataFrame([("ns", "repo")], "namespace string, source string")
    kept, errors = attach_provenance(got, manifest, "id")
    assert kept.count() == 0 and sorted(r["id"] for r in errors.collect()) == [1, 2]
    strings = spark.createDataFrame([(1, "$b", 5), (1, "$a", 5), (1, "$c", 1)], "m int, identifier string, offset long")
    assert [(r["identifier"], r["truncated"]) for r in cap_strings(strings, ["m"], 2).orderBy("place").collect()] == [("$c", True), ("$a", True)]


def test_signatures_of_any_form(spark):
    """Literals with and without inner words, short, spaced and odd ones, and regular expressions, against brute force."""
    rng = random.Random(4)
    pieces = ["ab", "needle", " in a haystack ", r"x\E.y", "  ", "\n", "q", "tail end", "zz top", "(", "é"]
    texts = [(k, "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))) for k in range(60)] + [(60, None), (61, "")]
    literals = ["ab", "needle in a", " a haystack n", r"\E", r"x\E.y", " ", "q(", "need", "e", "top", "tail end tail", "b\n", "in a haystack  in"]
    rules = [("ns", f"r{k}", "a", p, "any") for k, p in enumerate(literals)] + [("ns", "two", "a", "needle", "all"), ("ns", "two", "b", "zz top", "all"), ("ns", "empty", "a", "", "any")]
    files = spark.createDataFrame(texts, "id long, text string").repartition(3)
    frame = spark.createDataFrame(rules, "namespace string, rule string, pattern_id string, pattern string, condition string")
    times = lambda t, p: sum(t.startswith(p, i) for i in range(len(t)))
    want = set()
    for k, t in texts:
        for name in {r[1] for r in rules}:
            own = [r for r in rules if r[1] == name]
            hits = [times(t or "", r[3]) if r[3] else 0 for r in own]
            if all(hits) if own[0][4] == "all" else any(hits):
                want.add((k, name, sum(hits), min((t or "").find(r[3]) for r, h in zip(own, hits, strict=True) if h)))
    got = lambda: {tuple(r) for r in match_signatures(files, "id", "text", frame).select("id", "rule", "n_strings", "first_offset").collect()}
    assert got() == want
    plan = match_signatures(files, "id", "text", frame)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert plan.count("MapInArrow") == 1
    spots = lambda most: {tuple(r) for r in find_literals(files, "id", "text", literals, most).collect()}
    assert spots(1 << 20) == spots(10) == {(k, p, t.find(p), times(t, p)) for k, t in texts if t for p in literals if p in t}
    assert parts_of(literals, 10) != [literals] and sum(parts_of(literals, 10), []) == literals
    expressions = frame.limit(0).withColumn("kind", F.lit("text")).union(spark.createDataFrame([("ns", "e", "a", "n[ei]+dle", "any", "regex"), ("ns", "e", "b", "^ab", "any", "regex"), ("ns", "e", "c", "zz top", "any", "text")], "namespace string, rule string, pattern_id string, pattern string, condition string, kind string"))
    found = {r["id"]: (r["n_strings"], r["first_offset"]) for r in match_signatures(files, "id", "text", expressions).collect()}
    tests = [re.compile("n[ei]+dle"), re.compile("^ab"), re.compile("zz top")]
    wanted = {k: (sum(len(p.findall(t or "")) for p in tests), min(m.start() for p in tests if (m := p.search(t or "")))) for k, t in texts if any(p.search(t or "") for p in tests)}
    assert found == wanted


def test_reports_of_matches(spark, tmp_path):
    files = spark.createDataFrame([("b", "s2", "m2"), ("a", "s1", "m1")], "path string, sha256 string, md5 string")
    matches = spark.createDataFrame([("a", "n", "r2", ["y", "x"], {"k": "v"}, [("$a", 3)]), ("a", "n", "r1", ["z"], {}, None)], "path string, namespace string, rule string, tags array<string>, meta map<string,string>, strings array<struct<identifier:string,offset:long>>")
    rows = signatures.match_rows(files, matches).collect()
    assert [(r["file_path"], r["rule"], r["tags"], r["meta"], r["strings"]) for r in rows] == [("a", "r1", '["z"]', "{}", "[]"), ("a", "r2", '["x","y"]', '{"k":"v"}', '[{"identifier":"$a","offset":3}]')]
    signatures.write_matches(files, matches, str(tmp_path / "j"), "json", spark.createDataFrame([(2, 1)], "scanned int, matched int"))
    signatures.write_matches(files, matches, str(tmp_path / "c"), "csv")
    assert [len(r["matches"]) for r in spark.read.json(f"{tmp_path}/j/matches").collect()] == [2]
    assert spark.read.json(f"{tmp_path}/j/metadata").first()["scan_metadata"]["scanned"] == 2
    assert sorted(r["tags"] for r in spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/c/matches").collect()) == ['["x","y"]', '["z"]']


def test_bundles_in_and_out_of_turn(spark):
    """A bundle again, a clash, an older one and one from elsewhere; leases and waits as the imports leave them."""
    requests = [("b1", "s", 5, 1, "x", "p1"), ("b1", "s", 5, 2, "x", "p1"), ("b2", "s", 5, 3, "x", "p2"), ("b3", "s", 4, 4, "x", "p3"), ("b4", "t", 1, 5, "y", "p4"), ("b5", "s", 9, 6, "y", "p5"), ("b0", "s", 1, 7, "x", "p0")]
    frame = spark.createDataFrame(requests, "bundle_id string, source string, seq long, import_seq long, identity string, payload string").withColumn("created_at", F.timestamp_seconds("import_seq"))
    ledger = spark.createDataFrame([("b0", "s", 1)], "bundle_id string, source string, seq long")
    fresh, clash = exchange.new_bundles(frame.select("bundle_id", "source", "seq", "import_seq").distinct(), ledger)
    assert [tuple(r) for r in clash.collect()] == [("b2", "s", 5, "b1")]
    assert sorted(tuple(r) for r in fresh.select("bundle_id", "import_seq").collect()) == [("b1", 1), ("b3", 4), ("b4", 5), ("b5", 6)]
    made = lambda k, status, outcome, wait: (k, "old", 0, 0, "s", 4, "b9", 1, status, outcome, wait, 99, "tok", 2)
    items = spark.createDataFrame([made("x", "leased", "error", 50), made("y", "resolved", "rate_limited", 60), made("z", "leased", None, None)], "identity string, payload string, a long, b long, last_source string, last_seq long, last_bundle_id string, request_count long, status string, last_outcome string, c long, d long, lease_token string, attempts long")
    items = items.select("*", F.timestamp_seconds("a").alias("first_requested_at"), F.timestamp_seconds("b").alias("last_requested_at"), F.timestamp_seconds("c").alias("next_eligible_at"), F.timestamp_seconds("d").alias("lease_until"))
    asked = frame.join(fresh.select("bundle_id", "import_seq"), ["bundle_id", "import_seq"])
    got = {r["identity"]: (r["payload"], r["request_count"], r["status"], r["wait"], r["lease_token"], r["attempts"], r["last_bundle_id"]) for r in exchange.import_bundles(items, asked).withColumn("wait", F.unix_timestamp("next_eligible_at")).collect()}
    assert got == {"x": ("p1", 3, "pending", None, None, 2, "b1"), "y": ("p5", 3, "pending", 60, None, 2, "b5"), "z": ("old", 1, "leased", None, "tok", 2, "b9")}
    assert exchange.import_bundles(items, asked.where("false")).count() == 3


def test_ceilings_and_settlements(spark):
    m = exchange.MEASURES
    row = lambda run, n, kind, cost, reserved=0: (run, n, kind, 1, 0, 0, 0, cost, *([1, 0, 0, 0, reserved] if kind == "settle" else [None] * 5))
    events = [row(1, 1, "reserve", 60), row(1, 2, "reserve", 50), row(1, 3, "settle", 20, 60), row(1, 4, "reserve", 50), row(1, 5, "settle", 200, 50), row(1, 6, "release", 50), row(1, 7, "release", 50), row(2, 1, "odd", 1)]
    frame = spark.createDataFrame(events, "run_id long, id long, kind string, " + ", ".join(f"{x} long" for x in m) + ", " + ", ".join(f"reserved_{x} long" for x in m))
    got = exchange.admit_reservations(frame, {"requests": 2, "repositories": 9, "input_tokens": 9, "output_tokens": 9, "cost_micro_usd": 100}).orderBy("run_id", "id").collect()
    assert [(r["allowed"], r["requests"], r["cost_micro_usd"]) for r in got] == [(True, 1, 60), (False, 1, 60), (True, 1, 20), (True, 2, 70), (False, 2, 70), (True, 1, 20), (False, 1, 20), (False, 0, 0)]
    ledger = [(1, 1, 1, "reserve", 1, 0, 5, 5, 9), (1, 1, 2, "reserve", 1, 0, 6, 6, 9), (1, 1, 3, "commit", 1, 1, 1, 2, 3), (2, 1, 1, "reserve", 1, 0, 0, 0, 4), (2, 1, 2, "release", 1, 0, 0, 0, 5), (3, None, 1, "reserve", 1, 0, 0, 0, 0)]
    used = {r["run_id"]: tuple(r)[1:] for r in exchange.budget_measures(spark.createDataFrame(ledger, "run_id long, run_item_id long, id long, kind string, " + ", ".join(f"{x} long" for x in m))).collect()}
    assert used == {1: (2, 1, 6, 7, 12, False), 2: (0, 0, 0, 0, 0, True), 3: (0, 0, 0, 0, 0, True)}
