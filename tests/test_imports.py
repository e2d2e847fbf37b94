"""Whole stores merged: a second import changes nothing, and what is refused changes nothing either."""

import pytest
from pyspark.sql import functions as F

from sparkintel.operators import imports, lookups, reports
from sparkintel.plans.adapters import Adapter, Analysed, analyse, registry
from sparkintel.plans.import_queries import _file_tables, _ip_tables, _repo_tables

SF = "/root/testdata/sf0.001"


def rows(store):
    return {name: sorted((tuple(sorted(r.asDict().items(), key=str)) for r in df.collect()), key=str) for name, df in store.items()}


@pytest.mark.parametrize(("tables", "merge"), [(_ip_tables, imports.merge_ip), (_repo_tables, imports.merge_repos)])
def test_a_second_import_changes_nothing(spark, tables, merge):
    store, snapshots = tables(spark, SF)
    merged = merge(store, snapshots)
    first = {name: spark.createDataFrame(df.collect(), df.schema) for name, df in merged.store.items()}
    again = merge(first, snapshots)
    assert rows(again.store) == rows(first)
    assert set(again.counts.first().asDict().values()) == {0}
    assert sum(n > 0 for n in merged.counts.first().asDict().values()) >= 3


def test_noncanonical_snapshots_are_refused(spark):
    store, snapshots = _ip_tables(spark, SF)
    odd = snapshots["entities"].withColumn("ip", F.concat(F.lit("0"), "ip"))
    with pytest.raises(ValueError, match="noncanonical"):
        imports.merge_ip(store, snapshots | {"entities": odd})
    store, snapshots = _repo_tables(spark, SF)
    odd = snapshots["repositories"].withColumn("canonical_url", F.lit("https://example.com/a/b"))
    with pytest.raises(ValueError, match="noncanonical"):
        imports.merge_repos(store, snapshots | {"repositories": odd})


def test_local_material_stays_behind(spark):
    store, snapshots = _repo_tables(spark, SF)
    merged = imports.merge_repos(store, snapshots).store
    assert merged["documents"].where("origin = 'local'").count() == store["documents"].where("origin = 'local'").count()
    files, snaps = _file_tables(spark, SF)
    only, whole = imports.merge_file_store(files, snaps, intelligence_only=True), imports.merge_file_store(files, snaps)
    here = files["observations"].count()
    assert only.store["observations"].count() == here < whole.store["observations"].count() and only.notes
    assert only.store["lookups"].where("raw_path IS NOT NULL").count() == here < whole.store["lookups"].where("raw_path IS NOT NULL").count()
    assert rows({"f": only.store["files"]}) == rows({"f": whole.store["files"]})


def test_file_warnings_and_magic(spark):
    columns = "row_id long, import_seq long, sha256 string, md5 string, magic string, malicious string, created_at string, updated_at string"
    old = spark.createDataFrame([(1, 0, "s1", "m1", "old magic", "no", "2", "5"), (2, 0, "s2", "m2", "", "odd", "2", "5")], columns)
    new = spark.createDataFrame([(11, 1, " S1 ", "m1", "other", "yes", "1", "4"), (12, 1, "s2", "m2", "filled", "unknown", "3", "3"), (13, 1, "s9", "m1", None, "no", "1", "1")], columns).withColumn("source_sha256", F.lit("d"))
    empty = {"file_names": "row_id long, value string, source string, first_seen string", "tags": "row_id long, value string, source string, first_seen string", "observations": "row_id long, path string", "lookups": "row_id long, provider string, status string, completed_at string, raw_path string"}
    store = {"files": old, "ledger": spark.createDataFrame([], "source_sha256 string")} | {k: spark.createDataFrame([], v) for k, v in empty.items()}
    snapshots = {"files": new, "snapshots": spark.createDataFrame([("d", 1)], "source_sha256 string, import_seq long")} | {k: spark.createDataFrame([], f"{v}, source_sha256 string") for k, v in empty.items()}
    merged = imports.merge_file_store(store, snapshots)
    got = {r["sha256"]: (r["magic"], r["malicious"], r["created_at"], r["updated_at"]) for r in merged.store["files"].collect()}
    assert got == {"s1": ("old magic", "yes", "1", "5"), "s2": ("filled", "unknown", "2", "5"), "s9": (None, "no", "1", "1")}
    assert sorted(tuple(r) for r in merged.warnings.collect()) == [("magic_conflict", "s:s1"), ("md5_conflict", "m1")]
    assert merged.counts.first().asDict() == {"files_inserted": 1, "files_merged": 2, "lookups_copied": 0, "warnings": 2}


def test_digest_of_a_set():
    assert imports.set_digest({"a": "1", "b": "2"}) == imports.set_digest({"b": "2", "a": "1"}) != imports.set_digest({"a": "2", "b": "1"})


def test_unavailable_intelligence(spark, tmp_path):
    frame, why = lookups.load_intel(spark, str(tmp_path), "ip")
    assert frame is None and "no table" in why
    spark.createDataFrame([("1.1.1.1", 4)], "ip string, ip_version int").write.parquet(f"{tmp_path}/ip")
    frame, why = lookups.load_intel(spark, str(tmp_path), "ip")
    assert frame is None and why == "missing columns: country_code, whois, malicious"
    spark.createDataFrame([("k", "ready", "[]", 9)], "identity_key string, status string, tool_types_json string, more int").write.parquet(f"{tmp_path}/repository")
    frame, why = lookups.load_intel(spark, str(tmp_path), "repository")
    assert why is None and frame.columns == ["identity_key", "status", "tool_types_json"]


def test_adapters(spark):
    tables = {"files": spark.createDataFrame([("a", 1), ("b", 2)], "path string, size long")}
    small = Adapter("small", lambda t: Analysed({"small": t["files"].where("size < 2")}, spark.createDataFrame([("warning", "slow")], "severity string, code string"), spark.createDataFrame([("files", 2)], "metric string, value long")))
    after = Adapter("after", lambda t: Analysed({"again": t["small"].select("path")}, None, spark.createDataFrame([("files", 3)], "metric string, value long")), lambda t: "small" in t)
    never = Adapter("never", lambda t: 1 / 0, lambda t: "none" in t)
    records, states, metrics = analyse(tables, registry(never, small, after))
    assert sorted((r["type"], r["path"], r["size"]) for r in records.collect()) == [("again", "a", None), ("small", "a", 1)]
    assert sorted(tuple(r) for r in states.collect()) == [("after", "success", ""), ("small", "degraded", "slow")]
    assert [tuple(r) for r in metrics.collect()] == [("files", 5)]
    with pytest.raises(ValueError, match="one name"):
        registry(small, small)


def test_histories_and_match_reports(spark, tmp_path):
    states = spark.createDataFrame([("c1", 1, "2024", "p", "success"), ("c2", 1, "2024", "p", "failed")], "capture string, run_id long, started_at string, policy string, state string")
    for df in (states, states.where("capture = 'c1'").withColumn("run_id", F.lit(2).cast("long"))):
        reports.append_history(df, f"{tmp_path}/history")
    listed = reports.list_captures(spark.createDataFrame([("c1",), ("c2",), ("c3",)], "capture string"), spark.read.parquet(f"{tmp_path}/history"))
    assert {tuple(r) for r in listed.collect()} == {("c1", 2, "success"), ("c2", 1, "failed"), ("c3", None, "never")}
    audit = spark.createDataFrame([(1, "2024-01-02"), (2, "2024-01-03")], "id long, at string")
    reports.append_audit(audit, str(tmp_path), "runs")
    reports.append_audit(audit, str(tmp_path), "runs")
    assert spark.read.parquet(f"{tmp_path}/runs").groupBy("day").count().orderBy("day").collect()[0]["count"] == 2
    matches = spark.createDataFrame([("c", "b", "s", "m", "n", "r1", ["t"], "src"), ("c", "a", "s", "m", "n", "r2", ["u"], "src"), ("c", "a", "s", "m", "n", "r1", ["t", "u"], "src")], "capture string, path string, sha256 string, md5 string, namespace string, rule string, tags array<string>, source string")
    none = spark.createDataFrame([("c", "p", "code", "what")], "capture string, path string, code string, message string")
    got = [(r["section_no"], r["row_no"], r["line"]) for r in reports.match_report(matches, none).orderBy("section_no", "row_no").collect()]
    assert got[:4] == [(0, 1, "- Matched files: 2"), (0, 2, "- Rule matches: 3"), (1, 1, "| a | s | m | 2 | t, u |"), (1, 2, "| b | s | m | 1 | t |")]
    assert [line for no, _, line in got if no == 2] == ["### a: n/r1, src", "### a: n/r2, src", "### b: n/r1, src"] and got[-1] == (3, 1, "- code: p: what")
    repos = spark.createDataFrame([("c", "github.com/a/b", "hit", None, "ready", "tool", ["f"]), ("c", "github.com/a/c", "miss", None, None, None, ["g"])], "capture string, identity_key string, status string, error_code string, information_status string, purpose string, paths array<string>")
    lines = [r["line"] for r in reports.repository_report(repos, none).orderBy("section_no", "row_no").collect()]
    assert lines[2] == r"| [https://github\.com/a/b](<https://github.com/a/b>) | ready | tool | f |" and lines[3] == r"| https://github\.com/a/c | g |"
