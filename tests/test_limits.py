"""No limit drops anything in silence: large files, large rule sets, closed bundles, ids without gaps, absent tables."""

import json
import random
import re

import pytest

from pyspark.sql import functions as F

from sparkintel.operators import exchange, indicators, lookups, stores
from sparkintel.operators.folds import in_ranges, numbered_in_order
from sparkintel.operators.signatures import match_signatures
from sparkintel.sources import captures


def test_files_above_the_limit_are_told(spark, tmp_path):
    for name, size in (("small", 10), ("large", 5000)):
        (tmp_path / name).write_bytes(b"x" * size)
    got = {r["path"]: (r["length"], r["content"] and len(r["content"]), r["error"]) for r in captures.scan_capture(spark, str(tmp_path), max_bytes=100).collect()}
    assert got == {"small": (10, 10, None), "large": (5000, None, "too_large")}
    assert {r["error"] for r in captures.scan_capture(spark, str(tmp_path), content=False).collect()} == {None}


@pytest.mark.parametrize("slice_bytes", [64, 1000, 1 << 20])
def test_slices_of_files(spark, tmp_path, slice_bytes):
    """Together the bytes of a file; every token is whole in one slice, at its place."""
    rng = random.Random(slice_bytes)
    words = [bytes(rng.choice(b"0123456789.:abcdef") for _ in range(rng.randrange(1, 60))) for _ in range(900)] + [b"y" * 700]
    rng.shuffle(words)
    whole = b"".join(w + rng.choice([b" ", b"\n", b", ", b"\x00"]) for w in words)
    for name, data in (("a", whole), ("empty", b""), ("short", b"1.2.3.4")):
        (tmp_path / name).write_bytes(data)
    files = spark.createDataFrame([((tmp_path / name).as_uri(), (tmp_path / name).stat().st_size) for name in ("a", "empty", "short")], "uri string, length long")
    parts = {}
    for r in sorted(captures.read_slices(files, slice_bytes).collect(), key=lambda r: r["start"]):
        parts.setdefault(r["uri"].rsplit("/", 1)[1], []).append((r["start"], bytes(r["content"])))
    token = re.compile(rb"[0-9a-f.:]+")
    for name, data in (("a", whole), ("empty", b""), ("short", b"1.2.3.4")):
        assert b"".join(c for _, c in parts[name]) == data and [s for s, _ in parts[name]] == [sum(len(c) for _, c in parts[name][:k]) for k in range(len(parts[name]))]
        assert [(s + m.start(), m.group()) for s, c in parts[name] for m in token.finditer(c)] == [(m.start(), m.group()) for m in token.finditer(data)]
    assert max(len(c) for _, c in parts["a"]) <= slice_bytes + captures.OVERLAP


def test_many_regular_expressions(spark):
    """More than one column of them, some with classes that only Java has; counts and places as in brute force."""
    rng = random.Random(4)
    texts = [(k, " ".join(f"w{rng.randrange(900)}" for _ in range(40))) for k in range(30)] + [(99, None)]
    rules = [("n", f"r{k}", "a", f"w{k}\\b", "any", "regex") for k in range(650)] + [("n", "letters", "a", r"\p{javaLowerCase}\d{3}(?<!9)", "any", "regex")]
    got = match_signatures(spark.createDataFrame(texts, "id long, text string"), "id", "text", spark.createDataFrame(rules, "namespace string, rule string, pattern_id string, pattern string, condition string, kind string"))
    want = set()
    for key, text in texts:
        for _, rule, _, pattern, _, _ in rules:
            found = [m.start() for m in re.finditer(pattern.replace(r"\p{javaLowerCase}", "[a-z]"), text or "")]
            if found:
                want.add((key, rule, len(found), found[0]))
    assert {(r["id"], r["rule"], r["n_strings"], r["first_offset"]) for r in got.collect()} == want


def test_expressions_are_read_by_java(spark):
    files = spark.createDataFrame([(1, "x")], "id long, text string")
    rules = spark.createDataFrame([("n", "r", "a", "(?P<a>x)", "any", "regex")], "namespace string, rule string, pattern_id string, pattern string, condition string, kind string")
    with pytest.raises(ValueError, match="not a regular expression"):
        match_signatures(files, "id", "text", rules)


def bundle(**changed):
    body = {
        "schema_version": 1, "bundle_id": "0000000a-0000-0000-0000-000000000001", "source_instance_id": "0000000a-0000-0000-0000-000000000002", "source_sequence": 3, "created_at": "2026-01-02T03:04:05Z", "selection": "all",
        "policy_sha256": "a" * 64, "files": [{"sha256": "b" * 64, "md5": None}, {"sha256": "c" * 64, "md5": "d" * 32}], "ips": ["1.1.1.1"], "repositories": [{"identity_key": "github.com/a/b", "canonical_url": "https://github.com/a/b"}],
    }
    body |= changed
    body.setdefault("counts", {k: len(body[k]) if isinstance(body[k], list) else 0 for k in ("files", "ips", "repositories")})
    return json.dumps({k: v for k, v in body.items() if v != "gone"})


def test_bundles_are_closed(spark):
    twice = bundle()[:-1] + ', "selection": "all"}'
    cases = {
        bundle(): set(), bundle(ips=["1.1.1.1", 5]): {"items"}, bundle(files=[{"sha256": "b" * 64, "md5": None, "more": 1}]): {"items"}, bundle(files=[{"sha256": "b" * 64}]): {"items"}, bundle(files=["b" * 64]): {"items"},
        bundle(repositories=[{"identity_key": 1, "canonical_url": "u"}]): {"items"}, bundle(source_sequence="3"): {"types"}, bundle(schema_version=1.5): {"types"}, bundle(selection="some"): {"selection"}, bundle(extra=1): {"fields"},
        bundle(policy_sha256="gone"): {"fields", "policy", "types"}, bundle(counts={"files": 2, "ips": 1, "repositories": 1, "x": 0}): {"types"}, bundle(counts={"files": 1, "ips": 1, "repositories": 1}): {"counts"}, bundle(source_sequence=0): {"sequence"},
    }
    df = spark.createDataFrame([(str(k), body) for k, body in enumerate(cases)], "bundle_id string, body string")
    got = {str(k): set() for k in range(len(cases))}
    for r in exchange.header_violations(df).collect():
        got[r["bundle_id"]].add(r["violation"])
    assert list(got.values()) == list(cases.values())
    odd = spark.createDataFrame([("a", twice), ("b", "no json"), ("c", None), ("d", bundle(ips="1.1.1.1"))], "bundle_id string, body string")
    found = {}
    for r in exchange.header_violations(odd).collect():
        found.setdefault(r["bundle_id"], set()).add(r["violation"])
    assert all("json" in found[k] for k in "abc") and {"items", "counts"} <= found["d"]


def test_corrections_are_numbered_without_gaps(spark):
    old = spark.createDataFrame([(4, 1, "purpose", "p", "why", None), (9, 1, "status", "s", "why", None)], "id long, repository_id long, field_path string, replacement string, rationale string, supersedes_id long")
    new = [(70, 1, "purpose", "x", "why"), (3, 1, "purpose", "y", "why"), (5, 2, "purpose", None, "why"), (6, 2, "purpose", " ", "why"), (7, 2, "other", "z", "why"), (8, 2, "status", "a", "why"), (8, 3, "status", "b", "why"), (90, 2, "status", "c", None), (91, 2, "status", "d", "why")]
    df = spark.createDataFrame(new, "seq long, repository_id long, field_path string, replacement string, rationale string").repartition(4)
    got = sorted((r["id"], r["replacement"], r["supersedes_id"]) for r in stores.append_corrections(old, df, ["purpose", "status"]).collect())
    assert got == [(4, "p", None), (9, "s", None), (10, "y", 4), (11, "x", 10), (12, "d", None)]


def test_absent_tables_are_unavailable(spark, tmp_path):
    files = spark.createDataFrame([("a", "b"), ("a", "b")], "sha256 string, md5 string")
    assert [r["status"] for r in lookups.lookup_files(files, None).collect()] == ["unavailable"]
    assert [r["status"] for r in lookups.lookup_repositories(spark.createDataFrame([("k",)], "identity_key string"), None, []).collect()] == ["unavailable"]
    assert lookups.load_intel(spark, str(tmp_path), "file") == (None, "no table: PATH_NOT_FOUND")
    (tmp_path / "ip").mkdir()
    (tmp_path / "ip/part-0.parquet").write_bytes(b"no parquet")
    with pytest.raises(Exception, match="(?i)parquet|footer|read"):
        table, why = lookups.load_intel(spark, str(tmp_path), "ip")
        assert table is not None, why


def test_numbers_of_a_capture_with_most_rows(spark):
    """As by one window, but dealt over the tasks, and with nothing of a key in one of them."""
    rng = random.Random(9)
    rows = [("hot" if k % 3 else f"c{k % 7}", rng.randrange(400), f"line {k}") for k in range(3000)]
    df = spark.createDataFrame(rows, "capture string, v int, line string").repartition(6)
    parts = [in_ranges(df, F.col("capture"), F.col("v").desc(), F.col("line")).select("capture", F.lit(1).alias("section"), "line"), in_ranges(df.where("v > 100"), F.col("capture"), F.col("line")).select("capture", F.lit(2).alias("section"), "line")]
    got = numbered_in_order(parts, ["capture", "section"], "row_no").collect()
    want = set()
    for section, order, kept in ((1, lambda r: (-r[1], r[2]), rows), (2, lambda r: r[2], [r for r in rows if r[1] > 100])):
        for capture in {r[0] for r in kept}:
            want |= {(capture, section, k, r[2]) for k, r in enumerate(sorted([r for r in kept if r[0] == capture], key=order), 1)}
    assert {(r["capture"], r["section"], r["row_no"], r["line"]) for r in got} == want and len(got) == len(want)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or so small a table is one task
    try:
        ranges = parts[0].withColumn("task", F.spark_partition_id()).where("capture = 'hot'").groupBy("task").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(ranges) > 1 and max(r["count"] for r in ranges) < 2000


def test_the_first_rows_of_a_capture_are_limited_before_they_meet(spark):
    df = spark.createDataFrame([("hot", k) for k in range(500)], "capture string, n int")
    plan = indicators.cap_observations(df, "capture", [F.col("n")], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan.split("Exchange")[-1]  # below the shuffle
