"""Registered queries read all rows of their tables, compared with brute force."""

import hashlib
import ipaddress
import json
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("whole"))
    docs = [(k, f"text {k} of some length, more than 20 characters é" if k % 50 else None, "a" if k < 90 else "b") for k in range(120)] + [(500, "alone", None)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5).write.parquet(f"{folder}/documents.parquet")
    pages = [(0, "at ::1"), (1, "<p>[2001:DB8::1]:53 2001:db8:0::1 8.8.8.8:53 10.0.0.1 12:30:59 std::x a::b</p>"), (2, "fe80::1%eth0 1::2::3 ::ffff:1.2.3.4 9.9.9.9"), (3, None)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{folder}/pages.parquet")
    spark.range(4000).select(F.col("id").alias("event_id"), (F.col("id") % 37).alias("user_id"), F.when(F.col("id") % 3 > 0, "error").otherwise("view").alias("event_type"), F.timestamp_seconds("id").alias("ts"), F.lit("{}").alias("props")).repartition(3).write.parquet(f"{folder}/events.parquet")
    return folder


def rows_of(spark, sf_dir, name):
    return __spark_entry__.queries()[name](spark, sf_dir).collect()


def test_evidence_blocks_hold_all_documents_and_whole_texts(spark, sf_dir):
    own = defaultdict(list)
    for r in sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), key=lambda r: r["doc_id"]):
        own[r["source"]].append((r["doc_id"], r["text"] or ""))
    blocks = {s: [f'<source id="{k}" locator="{s}/{k}.md" untrusted="true">\n{t}\n</source>' for k, t in d] for s, d in own.items() if s}
    blocks |= {s: [None] * len(d) for s, d in own.items() if not s}  # no source, no locator
    listed = {s: json.dumps([{"version_id": k, "hash": hashlib.sha256(t.encode()).hexdigest()} for k, t in d], separators=(",", ":"), sort_keys=True) for s, d in own.items()}
    want = {s: (hashlib.sha256(listed[s].encode()).hexdigest(), len("\n\n".join(blocks[s])) if s else None) for s in own}
    assert sorted(len(d) for d in own.values()) == [1, 30, 90]
    got = rows_of(spark, sf_dir, "evidence_blocks")
    assert len(got) == 3 and {r["repository_id"]: (r["set_hash"], r["n"]) for r in got} == want
    parts = defaultdict(list)
    for r in sorted(rows_of(spark, sf_dir, "evidence_block_rows"), key=lambda r: r["place"]):
        parts[r["repository_id"]].append(r["text"])
    assert dict(parts) == blocks


def events_of(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").collect()


def address(e):
    return f"{1 + e['user_id'] % 223}.{e['event_id'] % 7}.{e['user_id'] % 251}.{1 + e['event_id'] % 5}"


@pytest.mark.parametrize("turned", [False, True])
def test_the_first_event_of_an_address_speaks_for_it_in_reports(spark, tmp_path, turned):
    users = [7, 7 + 223 * 251]  # of one address, but unavailable and a hit
    events = [(0, users[0], "view"), (35, users[1], "view"), (0, users[1], "error"), (35, users[0], "error"), (70, users[1], "click"), (70, users[0], "click")]
    spark.createDataFrame(events[::-1] if turned else events, "event_id long, user_id long, event_type string").withColumn("ts", F.timestamp_seconds("event_id")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    told = {(r["capture"], r["section_no"]): (r["row_no"], r["line"]) for r in rows_of(spark, str(tmp_path), "ip_report_sections") if r["section_no"]}
    hit = {1: "| 8.0.7.1 | Yes | C\\* | a&lt;b; c | f0 |", 6: "### 8.0.7.1: IPv4, hit, f0"}
    gone = {3: "| 8.0.7.1 | unavailable | not recorded | f0 |", 6: "### 8.0.7.1: IPv4, unavailable, f0"}
    # Of two events of one number, the smaller value speaks.
    assert told == {(c, n): (1, line) for c, lines in (("view", gone), ("error", hit), ("click", hit)) for n, line in lines.items()}


def test_children_of_all_users(spark, sf_dir):
    own = defaultdict(list)
    for e in sorted(events_of(spark, sf_dir), key=lambda e: (-ord(e["event_type"][0]), e["event_id"])):
        own[address(e)].append(f"{e['event_type']}@{e['event_id']}")
    assert {r["ip"]: r["children"] for r in rows_of(spark, sf_dir, "nested_children")} == {ip: ",".join(c) for ip, c in own.items()}


def test_adapters_report_at_most_32_of_all_their_codes(spark, sf_dir):
    codes = defaultdict(set)
    for e in events_of(spark, sf_dir):
        if e["event_type"] == "error":
            codes[f"a{e['user_id'] % 4}"].add(f"c{e['event_id'] % 40 + 10}")
    assert {a: len(c) for a, c in codes.items()} == {f"a{k}": 40 for k in range(4)}
    want = {a: ("failed" if a == "a1" else "degraded", ",".join(sorted(c)[:32])) for a, c in codes.items()} | {"a9": ("success", "")}
    assert {r["adapter"]: (r["state"], r["codes"]) for r in rows_of(spark, sf_dir, "adapter_states")} == want


def brute_addresses(text):
    for token in re.findall(r"[0-9A-Za-z:.%\[\]_-]+", text or ""):
        bare = re.sub(r"^\[(.*)\](:[0-9]+)?$", r"\1", token).partition("%")[0]
        try:
            found = ipaddress.ip_address(bare.partition(":")[0] if bare.count(":") == 1 else bare)
        except ValueError:
            continue
        if found.version == 6 or not found.is_private:
            yield str(found), None if found.version == 6 else int(found)


def test_addresses_of_both_versions(spark, sf_dir):
    want = {(f"pages/{r['page_id']}", *x) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect() for x in brute_addresses(r["html"])}
    got = [tuple(r) for r in rows_of(spark, sf_dir, "ip_observations")]
    assert set(got) == want and len(got) == len(want) == 7 and ("pages/0", "::1", None) in want


@pytest.mark.parametrize(("name", "flag", "size", "each", "whole"), [("budget_admission", "admitted", "cost", None, 5000), ("quarantined_items", "kept", "size", 1000, 50_000)])
def test_items_are_admitted_as_a_stream(spark, sf_dir, name, flag, size, each, whole):
    df = __spark_entry__.queries()[name](spark, sf_dir)
    assert "InPandas" not in df._jdf.queryExecution().toString()  # no frame of a whole group
    key, used = df.columns[0], defaultdict(int)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = sorted(df.collect(), key=lambda r: r["id"])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r["id"] for r in got] == list(range(4000)) and 0 < sum(r[flag] for r in got) < 4000
    for r in got:
        fits = (each is None or r[size] <= each) and used[r[key]] + r[size] <= whole
        used[r[key]] += r[size] if fits else 0
        assert r[flag] == fits
