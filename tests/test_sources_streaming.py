import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from sparkintel.operators.reports import capture_summary, report_lines, write_reports
from sparkintel.sources import captures, documents, exports
from sparkintel.streaming import captures as streams


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def tarred(members):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
        link = tarfile.TarInfo("link")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
        t.addfile(link)
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    for name, data in {"a.txt": b"1.1.1.1", "sub/.hidden": b"x", "sub/big.bin": b"y" * 5000, "one.zip": zipped({"in.txt": b"hello", "../evil": b"z", "deep.tar.gz": tarred({"leaf": b"leaf"})}), "bad.zip": b"nope"}.items():
        path = tmp_path / "capture" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return str(tmp_path / "capture")


def test_scan_and_archives(spark, folder):
    files = captures.scan_capture(spark, folder)
    assert {r["path"] for r in files.select("path").collect()} == {"a.txt", "sub/big.bin", "one.zip", "bad.zip"}
    assert {r["path"] for r in captures.scan_capture(spark, folder, max_depth=1, include_hidden=False, max_bytes=4000, content=False).where("error IS NULL").collect()} == {"a.txt", "one.zip", "bad.zip"}
    got = {r["path"]: (bytes(r["content"]) if r["content"] is not None else None, r["error"]) for r in captures.expand_archives(files).collect()}
    assert got["one.zip!in.txt"] == (b"hello", None) and got["one.zip!../evil"] == (None, "unsafe_path") and got["one.zip!deep.tar.gz!leaf"] == (b"leaf", None)
    assert got["one.zip!deep.tar.gz!link"][1] == "special_member" and got["bad.zip"][1] == "BadZipFile"
    assert {r["error"] for r in captures.expand_archives(files, max_files=1).where("path = 'one.zip'").collect()} == {"limit"}
    assert {r["path"]: (r["n_files"], r["error"]) for r in captures.estimate_archives(files).collect()} == {"one.zip": (3, None), "bad.zip": (0, "BadZipFile")}


def test_inventory(spark, folder):
    rows = captures.manifest(captures.scan_capture(spark, folder), F.lit("c"))
    assert captures.inventory_violations(rows).count() == 0
    assert captures.manifest_digest(rows, "capture_id", ["path", "size", "sha256"]).first()["digest"] == captures.manifest_digest(rows.repartition(5), "capture_id", ["path", "size", "sha256"]).first()["digest"]
    bad = rows.withColumn("size", -F.col("size")).union(rows)
    assert {r["violation"] for r in captures.inventory_violations(bad).collect()} == {"size", "duplicate"}


def test_ip_tuples(spark):
    lines = spark.createDataFrame([("8.8.8.8; a;b",), ("2001:DB8::1; x",), ("junk",), ("9.9.9.9; y",)], "value string")
    pairs = captures.read_ip_tuples(lines)
    assert [r["value"] for r in captures.ip_tuple_lines(pairs).collect()] == ["8.8.8.8; a;b", "9.9.9.9; y", "2001:db8::1; x"]
    left = captures.remaining_tuples(lines, spark.createDataFrame([("8.8.8.8",)], "ip string"))
    assert sorted(r["value"] for r in left.collect()) == ["2001:DB8::1; x", "9.9.9.9; y", "junk"]


def test_reports_in_json(spark):
    body = json.dumps({"detect": "malware", "country": "CN", "reverse_dns": [" a ", "", "a"], "iocs": ["x"], "actors": [{"country": "CN", "name": "Barium", "aliases": ["Wicked Spider"]}]})
    got = {r["ip"]: r for r in documents.normalize_ip_reports(spark.createDataFrame([("1", body), ("2", "{"), ("3", '{"detect": "normal"}')], "ip string, body string")).collect()}
    assert (got["1"]["malicious"], got["1"]["related_actors"], got["1"]["reverse_dns"]) == ("Yes", ["(CN)Barium/Wicked Spider"], ["a"])
    assert got["2"]["provider_status"] == "failed" and got["3"]["malicious"] == "No"
    file = json.dumps({"result_code": 200, "data": {"sha256": "AB", "md5": "CD", "detect": "bad", "tags": ["tag1"], "threat_types": ["downloader", "tag1"]}})
    r = {x["query_hash"]: x for x in documents.normalize_file_reports(spark.createDataFrame([("a", file), ("b", '{"result_code": 404}'), ("c", '{"result_code": 200}')], "query_hash string, body string")).collect()}
    assert (r["a"]["sha256"], r["a"]["malicious"], r["a"]["tags"]) == ("ab", "yes", ["tag1", "downloader"]) and r["b"]["status"] == "provider_error" and r["c"]["status"] == "not_found"
    meta = json.dumps({"stargazers_count": 5, "fork": False, "owner": {"login": "o", "type": "User"}, "parent": None, "license": {"spdx_id": "MIT"}})
    m = documents.normalize_repo_metadata(spark.createDataFrame([(1, meta), (2, '{"stargazers_count": -1}')], "repository_id long, body string")).orderBy("repository_id").collect()
    assert (m[0]["stars_count"], m[0]["license_spdx"], m[0]["is_fork"], m[1]["stars_count"]) == (5, "MIT", False, None)


def test_git_remotes(spark):
    text = '[include]\n path = other\n[remote "origin"]\n\turl = https://github.com/Owner/Repo.git ; note\n\tpushurl = git@github.com:Owner/\\\nRepo.git\n[remote "upstream"] \n url = "https://github.com/up/stream"\n[branch "x"]\n url = nope\n'
    remotes = documents.git_remotes(spark.createDataFrame([(1, text)], "copy_id long, text string"))
    assert sorted((r["remote"], r["direction"], r["identity_key"]) for r in remotes.collect()) == [("origin", "fetch", "github.com/owner/repo"), ("origin", "push", "github.com/owner/repo"), ("upstream", "fetch", "github.com/up/stream")]
    assert documents.primary_remote(remotes).first()["identity_key"] == "github.com/owner/repo"


def test_exports_and_versions(spark, tmp_path):
    table = spark.createDataFrame([(1, "=x", ["a"]), (2, None, [])], "id long, t string, l array<string>")
    exports.export_csv({"t": table}, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv/t")).orderBy("id").collect()
    assert [tuple(r) for r in back] == [("1", "'=x", '["a"]'), ("2", None, "[]")]
    assert exports.export_manifest(spark, str(tmp_path / "csv")).count() >= 1
    exports.export_json({"t": table}, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json/t")).select("t.id").count() == 2
    root = str(tmp_path / "store")
    assert exports.write_version(spark, root, {"t": table}) == {"t": 2}
    assert exports.write_version(spark, root, {"t": table.limit(1)}, dry_run=True) == {"t": 1}
    assert exports.read_version(spark, root, "t").count() == 2
    exports.write_version(spark, root, {"t": table.limit(1)})
    assert exports.read_version(spark, root, "t").count() == 1


def test_reports(spark, tmp_path):
    statuses = spark.createDataFrame([("c1", "8.8.8.8", "hit", "Yes", "a*b"), ("c1", "9.9.9.9", "miss", None, "p"), ("c2", "1.1.1.1", "hit", "No", "q")], "capture string, ip string, status string, malicious string, first_path string")
    lines = report_lines(statuses, "capture", "ip", [F.col("ip")])
    assert {(r["capture"], r["section"], r["row_no"]) for r in lines.collect()} == {("c1", "With intel", 1), ("c1", "Without intel", 1), ("c2", "With intel", 1)}
    write_reports(lines, "capture", str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).where("capture_name = 'c1'").count() == 2
    none = spark.createDataFrame([], "capture string, adapter string, state string, codes string")
    summary = capture_summary(spark.createDataFrame([("c1",)], "capture string"), none, none.select("capture", "adapter"), ["ip", "file"])
    assert {r["state"] for r in summary.collect()} == {"not_enabled"}


def test_stream_of_captures_equals_batch(spark, folder, tmp_path):
    stream = streams.generations(streams.capture_stream(spark, folder)).select("path", "sha256")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    streams.run_once(stream, out, state)
    batch = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.sha2("content", 256).alias("sha256"))
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, batch.collect()))
    streams.run_once(streams.generations(streams.capture_stream(spark, folder)).select("path", "sha256"), out, state)
    assert spark.read.parquet(out).count() == batch.count()


def test_stable_captures(spark, tmp_path):
    rows = [("a", "s1", 1), ("a", "s1", 2), ("b", "x", 1), ("b", "y", 2), ("b", "y", 3), ("a", "s1", 3), ("b", "z", 4)]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, "path string, signature string, seen long").write.parquet(source)
    streams.run_once(streams.stable(spark.readStream.schema("path string, signature string, seen long").parquet(source), 2), str(tmp_path / "o"), str(tmp_path / "s"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "o")).collect())) == [("a", "s1", 2), ("b", "y", 3)]


def test_queue_state(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [(1, "s", 1, 1), (2, "s", 1, 1), (1, "s", 1, 2), (1, "s", 3, 3), (2, "s", 2, 4), (2, "s", 1, 5)]
    schema, source = "identity long, source string, seq long, import_seq long", str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(source)
    query = streams.queue_stream(spark.readStream.schema(schema).parquet(source)).writeStream.format("memory").queryName("queue").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "s")).start()
    query.awaitTermination()
    assert {r["identity"]: (r["last_seq"], r["request_count"]) for r in spark.table("queue").collect()} == {1: (3, 2), 2: (2, 2)}
