import json

import pytest
from pyspark.sql import functions as F

from sparkintel.operators import answers, merges, stores


def test_observations_keep_what_is_there(spark):
    files = spark.createDataFrame([("a", "m1", "", "no"), ("b", None, "old", "yes")], "sha256 string, md5 string, magic string, malicious string")
    seen = spark.createDataFrame([("a", "m1", "new", 1), ("b", "m2", "x", 2), ("c", "m3", None, 3), ("d", "m4", None, 4), ("d", "m5", None, 5)], "sha256 string, md5 string, magic string, seq long")
    merged, clashes = stores.apply_file_observations(files, seen)
    assert {tuple(r) for r in merged.where("sha256 <> 'd'").collect()} == {("a", "m1", "new", "no"), ("b", "m2", "old", "yes"), ("c", "m3", None, "unknown")}
    assert [r["sha256"] for r in clashes.collect()] == ["d"]


def test_bundles(spark):
    ips = spark.createDataFrame([("2.2.2.2",), ("1.1.1.1",), ("1.1.1.1",)], "ip string")
    repos = spark.createDataFrame([("github.com/a/b",)], "identity_key string")
    files = spark.createDataFrame([("s", "m")], "sha256 string, md5 string")
    row = stores.write_bundle(files, ips, repos, {"schema_version": F.lit(1)}).first()
    assert (row["n_ips"], row["n_files"], row["n_repositories"]) == (2, 1, 1)
    bundles = spark.createDataFrame([(1, row["body"], row["sha256"]), (2, row["body"] + " ", row["sha256"])], "bundle_id long, body string, sha256 string")
    assert [tuple(r) for r in stores.read_bundle(bundles).collect()] == [(1, ["1.1.1.1", "2.2.2.2"], ["github.com/a/b"], ["s"])]
    body = json.loads(row["body"])
    assert body["repositories"] == [{"canonical_url": "https://github.com/a/b", "identity_key": "github.com/a/b"}] and body["files"] == [{"md5": "m", "sha256": "s"}] and body["schema_version"] == 1
    many = stores.write_bundle(files, spark.range(100).select(F.col("id").cast("string").alias("ip")), repos, {}, spread=7).collect()
    assert len(many) == 7 and sum(r["n_ips"] for r in many) == 100 and all(json.loads(r["body"])["ips"] == sorted(json.loads(r["body"])["ips"]) for r in many)
    with pytest.raises(Exception, match="passes its limits"):
        stores.write_bundle(files, ips, repos, {}, most=2, spread=1).collect()


def test_quarantine(spark):
    items = spark.createDataFrame([("a", 1, 60), ("a", 2, 101), ("a", 3, 50), ("a", 4, 40)], "source string, id long, size long")
    assert {r["id"]: r["kept"] for r in stores.quarantine_plan(items, 100, 100).collect()} == {1: True, 2: False, 3: False, 4: True}


def test_discovery_runs_and_work(spark):
    copies = spark.createDataFrame([("r", "a", 1, 1, None), ("r", "b", 1, 1, None)], "root string, path_key string, first_seen long, last_seen long, missing_at long")
    found = spark.createDataFrame([("r", "A"), ("r", "c")], "root string, path string")
    assert {tuple(r) for r in stores.apply_discovery(copies, found, F.lit(9).cast("long")).collect()} == {("r", "a", 1, 9, None), ("r", "b", 1, 1, 9), ("r", "c", 9, 9, None)}
    items = spark.createDataFrame([(1, 1, "complete"), (1, 2, "pending"), (2, 1, "skipped_reuse"), (3, 1, "failed")], "run_id long, repository_id long, state string")
    assert {r["run_id"]: r["status"] for r in stores.run_status(items).collect()} == {1: "interrupted", 2: "complete", 3: "failed"}
    repositories = spark.createDataFrame([(1, "k1"), (2, "k2")], "repository_id long, identity_key string")
    assert [r["repository_id"] for r in stores.worklist(repositories, items.where("run_id = 1")).collect()] == [2]
    kept, missing = stores.select_repositories(repositories, spark.createDataFrame([("k2",), ("k9",)], "identity_key string"))
    assert [r["identity_key"] for r in kept.collect()] == ["k2"] and [r["identity_key"] for r in missing.collect()] == ["k9"]


def test_language_claims(spark):
    claims = spark.createDataFrame([(1, "Ana  LIMA", "Portuguese", "quote"), (1, "Bob", "German", "quote"), (1, "Ana Lima", "Portuguese", ""), (2, "X", "Y", "q")], "repository_id long, subject string, category string, quote string")
    people = spark.createDataFrame([(1, "Ana Lima"), (2, "X")], "repository_id long, person string")
    owners = spark.createDataFrame([(1, "User"), (2, "Organization")], "repository_id long, owner_type string")
    assert sorted((r["subject"], r["category"]) for r in answers.attribute_language(claims, people, owners).collect()) == [("Ana  LIMA", "Portuguese"), ("Ana Lima", "Unknown"), ("Bob", "Unknown")]
    assert [r["person"] for r in stores.eligible_subjects(people, owners).collect()] == ["Ana Lima"]


def test_captured_sources(spark):
    rows = [("r", "README.md", b"x" * 50), ("r", "docs/README_ko.md", b"y" * 50), ("r", "AUTHORS", b"z" * 50), ("r", "setup.py", b"p"), ("r", "logo.png", b"q"), ("r", "readme.txt", b"a\x00b")]
    got = answers.capture_sources(spark.createDataFrame(rows, "repo string, path string, content binary"), "repo", 40, 90).collect()
    assert [(r["path"], r["kept"]) for r in got] == [("README.md", 40), ("docs/README_ko.md", 40), ("AUTHORS", 10)]
    assert {r["path"]: r["translation"] for r in got} == {"README.md": False, "docs/README_ko.md": True, "AUTHORS": False}


def test_names_and_leaves(spark):
    df = spark.createDataFrame([(1, "  ＡＢ  ß "), (2, "Plain  Name")], "k long, v string")
    assert [r["n"] for r in df.select(answers.normal_name(F.col("v")).alias("n")).collect()] == ["ab ss", "plain name"]
    body = spark.createDataFrame([(1, '{"a": [" x ", {"b": 2}], "c": null, "d": "x"}'), (2, "bad")], "k long, body string")
    assert sorted((r["k"], r["leaf"]) for r in answers.json_leaves(body, "k", "body").collect()) == [(1, "2"), (1, "x")]


def test_pointers_remotes_and_corrections(spark):
    current = spark.createDataFrame([(1, 10, "model"), (2, 20, "deterministic"), (3, 30, "model")], "repository_id long, finding_id long, provenance string")
    new = spark.createDataFrame([(1, 11, "deterministic", 1), (2, 21, "deterministic", 1), (3, 31, "model", 1), (3, 32, "deterministic", 2), (4, 41, "deterministic", 1)], "repository_id long, finding_id long, provenance string, seq long")
    assert {tuple(r)[:2] for r in stores.move_pointers(current, new).collect()} == {(1, 10), (2, 21), (3, 31), (4, 41)}
    remotes = spark.createDataFrame([("r", "a", "old"), ("r", "b", "kept")], "root string, path_key string, remote string")
    found = spark.createDataFrame([("r", "a", "new"), ("r", "a", "more")], "root string, path_key string, remote string")
    assert sorted(r["remote"] for r in stores.replace_remotes(remotes, found, found).collect()) == ["kept", "more", "new"]
    old = spark.createDataFrame([(4, 1, "summary", "a", "why", None)], "id long, repository_id long, field_path string, replacement string, rationale string, supersedes_id long")
    added = spark.createDataFrame([(1, 1, "summary", "b", "why"), (2, 1, "summary", "c", "why"), (3, 1, "odd", "d", "why"), (4, 1, "summary", " ", "why")], "seq long, repository_id long, field_path string, replacement string, rationale string")
    got = stores.append_corrections(old, added, ["summary"]).orderBy("id").collect()
    assert [(r["id"], r["replacement"], r["supersedes_id"]) for r in got] == [(4, "a", None), (5, "b", 4), (6, "c", 5)]
    children = spark.createDataFrame([("1.1.1.1", "a", "t0")], "ip string, domain string, first_seen string")
    records = spark.createDataFrame([("1.1.1.1", ["a", " b ", ""])], "ip string, domains array<string>")
    assert {tuple(r) for r in stores.apply_children(children, records, "domain", F.lit("t1")).collect()} == {("1.1.1.1", "a", "t0"), ("1.1.1.1", "b", "t1")}


def test_provider_results_of_files(spark):
    files = spark.createDataFrame([(1, "s1", None, "", "no", "t0"), (2, None, "m2", "old", "yes", "t0"), (3, "s3", None, None, "unknown", "t0")], "file_id long, sha256 string, md5 string, magic string, malicious string, updated_at string")
    tags = spark.createDataFrame([(1, "worm", "p", "t0")], "file_id long, tag string, source string, first_seen string")
    names = spark.createDataFrame([], "file_id long, name string, source string, first_seen string")
    schema = "file_id long, seq long, provider string, sha256 string, md5 string, magic string, malicious string, tags array<string>, names array<string>"
    told = [(1, 2, "p", " S1 ", "m9", "PE", "yes", ["worm", "new"], ["a.exe"]), (1, 1, "q", None, "m1", None, "unknown", [], ["a.exe", " "]), (2, 1, "p", "s2", "m8", "new", "no", None, None)]
    got = merges.apply_file_results(files, spark.createDataFrame(told, schema), tags, names, F.lit("t1"))
    assert {tuple(r) for r in got["files"].collect()} == {(1, "s1", "m1", "PE", "yes", "t1"), (2, "s2", "m2", "old", "yes", "t1"), (3, "s3", None, None, "unknown", "t0")}
    assert {tuple(r) for r in got["tags"].collect()} == {(1, "worm", "p", "t0"), (1, "new", "p", "t1")} and {tuple(r) for r in got["names"].collect()} == {(1, "a.exe", "p", "t1"), (1, "a.exe", "q", "t1")}
    for odd in ([(3, 1, "p", "s4", None, None, None, None, None)], [(2, 1, "p", "x", None, None, None, None, None), (2, 2, "q", "y", None, None, None, None, None)], [(9, 1, "p", None, None, None, None, None, None)]):
        with pytest.raises(merges.HashConflict):
            merges.apply_file_results(files, spark.createDataFrame(odd, schema), tags, names, F.lit("t1"))
