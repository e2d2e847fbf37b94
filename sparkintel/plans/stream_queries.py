"""Registered queries that run as streams over the given tables until all is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkintel.plans.queries import query
from sparkintel.plans.tables import read
from sparkintel.sources.exports import scratch
from sparkintel.streaming.captures import gate_leases, keep_pause, once, queue_stream, run_batches, run_once, stable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query("SELECT DISTINCT user_id || '/' || event_type AS bundle_id FROM events")
def stream_once(spark, sf_dir):
    """Bundles that were not seen before, as they arrive."""
    folder = scratch(spark)
    stream = event_stream(spark, sf_dir).select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("bundle_id"))
    run_once(once(stream, "bundle_id"), f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out")


@query(
    """WITH s AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS run FROM events),
    n AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, run ORDER BY event_id) AS k FROM s)
    SELECT CAST(user_id AS VARCHAR) AS path, event_type AS signature, event_id AS seen FROM n WHERE k = 2"""
)
def stream_stable(spark, sf_dir):
    """Captures (users) whose signature (event type) came twice in a row, told at that listing."""
    folder = scratch(spark)
    stream = event_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("signature"), F.col("event_id").alias("seen"))
    run_once(stable(stream, 2), f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out")


@query(
    """WITH RECURSIVE r AS (SELECT user_id AS identity, 's' || (event_id % 2) AS source, event_id * 7919 % 1009 AS seq, min(event_id) AS i FROM events GROUP BY 1, 2, 3),
    o AS (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY i) AS n FROM r),
    f AS (SELECT identity, n, source, seq FROM o WHERE n = 1
          UNION ALL SELECT o.identity, o.n, CASE WHEN o.source <> f.source OR o.seq > f.seq THEN o.source ELSE f.source END, CASE WHEN o.source <> f.source OR o.seq > f.seq THEN o.seq ELSE f.seq END FROM f JOIN o ON o.identity = f.identity AND o.n = f.n + 1)
    SELECT identity, arg_max(source, n) AS last_source, arg_max(seq, n) AS last_seq, max(n) AS request_count FROM f GROUP BY identity"""
)
def stream_queue(spark, sf_dir):
    """The request queue as state of a stream; its last state of each identity."""
    folder, before = scratch(spark), spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    requests = event_stream(spark, sf_dir).select(F.col("user_id").alias("identity"), F.concat(F.lit("s"), (F.col("event_id") % 2).cast("string")).alias("source"), (F.col("event_id") * 7919 % 1009).alias("seq"), F.col("event_id").alias("import_seq"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        states = queue_stream(requests).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
        states.foreachBatch(lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{folder}/out")).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    every = spark.read.parquet(f"{folder}/out")
    last = every.groupBy("identity").agg(F.max_by(F.struct("last_source", "last_seq", "request_count"), "batch").alias("s"))
    return last.select("identity", "s.*")


@query(
    """WITH e AS (SELECT event_id, event_type, ts, ts + to_seconds(60 * (event_id % 300)) AS until, event_id % 6 AS b FROM events),
    p AS (SELECT b, max(until) FILTER (event_type = 'error') AS until FROM e GROUP BY b),
    before AS (SELECT b, max(until) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS paused FROM p)
    SELECT event_id, b::BIGINT AS batch, coalesce(ts >= paused, true) AS granted FROM e JOIN before USING (b) WHERE event_type = 'view'"""
)
def gated_leases(spark, sf_dir):
    """Calls for leases (views) in six batches, of which those are refused that fall into a pause by a rate limit (errors) of a batch before."""
    folder = scratch(spark)
    e = read(spark, sf_dir, "events")
    until = F.timestamp_seconds(F.unix_timestamp("ts") + 60 * (F.col("event_id") % 300))
    e = e.select("event_id", "event_type", "ts", until.alias("until"))
    for batch in range(6):
        e.where(F.col("event_id") % 6 == batch).write.parquet(f"{folder}/in/{batch}")
        files = spark.readStream.schema(e.schema).option("recursiveFileLookup", True).parquet(f"{folder}/in")
        run_batches(files.where("event_type = 'view'"), gate_leases(spark, f"{folder}/pause", f"{folder}/gate", "ts"), f"{folder}/state-gate")
        changes = files.where("event_type = 'error'").select(F.lit("rate_limited").alias("why"), F.col("until").alias("next_eligible_at"))
        run_batches(changes, keep_pause(spark, f"{folder}/pause"), f"{folder}/state-pause")
    return spark.read.parquet(f"{folder}/gate/calls").select("event_id", F.col("batch_id").cast("long").alias("batch"), "granted")
