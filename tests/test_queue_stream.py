"""The leased queue, its pause, directory units and replays as streams and jobs."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from sparkintel.plans.stream_queries import ROCKSDB
from sparkintel.sources import captures
from sparkintel.streaming.captures import EVENTS, TOLD, gate_leases, keep_pause, leased_queue, pause_stream, run_once, run_until, unit_stream

T0 = datetime.datetime(2100, 1, 1)  # timers are not due


def at(seconds):
    return T0 + datetime.timedelta(seconds=seconds)


def event(identity, kind, when, source=None, seq=None, token=None, until=None, outcome=None, wait=None):
    return (identity, kind, at(when), source, seq, token, None if until is None else at(until), outcome, wait)


@pytest.fixture
def changes(spark, tmp_path):
    """Batches of events, each a file and a trigger, and what the queue tells of them."""

    def run(*batches):
        told = 0
        for rows, more in batches:
            told += more
            spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = leased_queue(spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/in"))
            there = lambda: os.path.exists(f"{tmp_path}/out/_spark_metadata/0") and spark.read.schema(TOLD).parquet(f"{tmp_path}/out").count() >= told
            before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
            try:
                assert run_until(stream, f"{tmp_path}/out", f"{tmp_path}/state", there, 100)
            finally:
                spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
        return spark.read.schema(TOLD).parquet(f"{tmp_path}/out")

    return run


def test_requests_leases_and_outcomes(changes):
    got = changes(
        ([event("a", "request", 0, "s", 5), event("a", "request", 1, "s", 4), event("a", "lease", 2, token="t1", until=302), event("b", "request", 0, "s", 1), event("b", "lease", 1, token="t2", until=301), event("b", "outcome", 2, token="old", outcome="success")], 5),
        ([event("a", "outcome", 10, token="t1", outcome="rate_limited"), event("a", "request", 11, "t", 1), event("a", "lease", 20, token="t3", until=320), event("b", "outcome", 10, token="t2", outcome="error", wait=7), event("c", "lease", 1, token="x", until=2)], 3),
    )
    rows = [(r["identity"], r["why"], r["status"], r["request_count"], r["attempts"]) for r in got.orderBy("identity", "at", "request_count").collect() if not r["why"].endswith("over")]
    assert rows == [
        ("a", "new", "pending", 1, 0), ("a", "counted", "pending", 2, 0), ("a", "leased", "leased", 2, 0), ("a", "rate_limited", "pending", 2, 1), ("a", "asked again", "pending", 3, 1),
        ("b", "new", "pending", 1, 0), ("b", "leased", "leased", 1, 0), ("b", "error", "pending", 1, 1),
    ]
    waits = {(r["identity"], r["why"]): r["next_eligible_at"] for r in got.collect()}
    assert waits["a", "rate_limited"] == waits["a", "asked again"] == at(3610) and waits["b", "error"] == at(17)
    assert pause_stream(got).first()["paused_until"] == at(3610)


def test_timers_end_leases(changes):
    past = -3_000_000_000
    got = changes(([event("a", "request", past, "s", 1), event("a", "lease", past + 1, token="t", until=past + 60)], 3))
    told = [(r["why"], r["status"], r["lease_token"]) for r in got.orderBy("at").collect()]
    assert told == [("new", "pending", None), ("leased", "leased", "t"), ("lease over", "pending", None)]


def test_units_are_told_once(spark, tmp_path):
    schema = "path string, modificationTime timestamp"
    for paths in (["/root/a/x/1", "/root/a/x/2", "/root/b/1"], ["/root/a/y/1", "/root/c/d/e/1", "/elsewhere/a/b/1"]):
        spark.createDataFrame([(p, T0) for p in paths], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run_once(unit_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "/root", 2), f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted(r["unit"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a/x", "a/y", "c/d"]


def test_replay_of_a_retained_capture(spark):
    files = spark.createDataFrame([("a", b"one"), ("b", b"two")], "path string, content binary")
    rows = files.select(F.lit("c1").alias("capture_id"), "path", F.lit("file").alias("type"), F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"))
    digest = captures.manifest_digest(rows, "capture_id", ["path", "type", "size", "sha256"]).first()["digest"]
    listed = spark.createDataFrame([("c1", "ready", digest), ("c2", "partial", digest)], "capture_id string, status string, digest string")
    count = lambda df: df.agg(F.count(F.lit(1)).alias("n"))
    assert captures.replay(listed, rows, files, "c1", count).first()["n"] == 2
    for bad in (lambda: captures.replay(listed, rows, files, "c2", count), lambda: captures.replay(listed, rows.where("path = 'a'"), files, "c1", count), lambda: captures.replay(listed, rows, files.where("path = 'a'"), "c1", count)):
        with pytest.raises(ValueError):
            bad()


def test_requests_and_leases_that_come_again(changes):
    """Any order of one source's requests, with repeats within and across batches and a restart between, gives one state; a repeated lease is none."""
    asked = [event("a", "request", k, "s", k) for k in range(8)]
    rng = random.Random(2)
    got = changes(
        (rng.sample(asked[:6], 6) + asked[2:4] + [event("a", "lease", 50, token="t", until=90)] * 2, 7),
        (rng.sample(asked, 8) + [event("a", "lease", 95, token="t", until=190), event("a", "lease", 96, token="u", until=191)], 3),
    ).collect()
    told = [(r["why"], r["request_count"], r["lease_token"]) for r in sorted(got, key=lambda r: (r["request_count"], r["at"]))]
    assert max(r["request_count"] for r in got) == 8 and max(r["last_seq"] for r in got) == 7
    assert [t for t in told if t[0] == "leased"] == [("leased", 6, "t"), ("leased", 8, "u")]


def test_a_rate_limit_pauses_all_items(spark, tmp_path):
    """In the batch after it, and alike when that batch comes again later."""
    calls = lambda *seconds: spark.createDataFrame([(f"i{s}", at(s)) for s in seconds], "identity string, at timestamp")
    limits = lambda *seconds: spark.createDataFrame([("rate_limited", at(s)) for s in seconds], "why string, next_eligible_at timestamp")
    pauses, root = f"{tmp_path}/pause", f"{tmp_path}/gate"
    gate, keep = gate_leases(spark, pauses, root), keep_pause(spark, pauses)
    granted = lambda n: {r["identity"]: r["granted"] for r in spark.read.parquet(f"{root}/calls/batch_id={n}").collect()}
    gate(calls(0, 10), 0)
    keep(limits(100, 60), 0)
    gate(calls(20, 99, 100), 1)
    keep(limits(50), 1)  # moves nothing back
    gate(calls(70, 120), 2)
    keep(limits(500), 2)
    assert granted(0) == {"i0": True, "i10": True} and granted(1) == {"i20": False, "i99": False, "i100": True} and granted(2) == {"i70": False, "i120": True}
    for batch, seconds in ((0, (0, 10)), (1, (20, 99, 100)), (2, (70, 120))):
        was = granted(batch)
        gate(calls(*seconds), batch)
        assert granted(batch) == was
    keep(limits(500), 2)
    gate(calls(499, 500), 3)
    assert granted(3) == {"i499": False, "i500": True}
