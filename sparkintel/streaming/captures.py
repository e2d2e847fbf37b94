"""Captures as they arrive: streams of files, stability, generations, and the queue as state."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparkintel.sources.exports import current_version, describe_version, publish


BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def capture_stream(spark: SparkSession, folder: str, files_a_trigger: int = 1000) -> DataFrame:
    """New files of a folder, each once: path, length, modificationTime, content."""
    source = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_a_trigger)
    return source.load(folder)


def generations(stream: DataFrame, watermark: str | None = None) -> DataFrame:
    """Each (path, content) once: the same bytes again are dropped, changed ones are a new generation."""
    hashed = stream.withColumn("sha256", F.sha2("content", 256))
    if watermark is None:
        return hashed.dropDuplicates(["path", "sha256"])
    return hashed.withWatermark("modificationTime", watermark).dropDuplicatesWithinWatermark(["path", "sha256"])


def stable(listings: DataFrame, times: int) -> DataFrame:
    """Captures whose signature (count, bytes, mtime) was the same so many times in a row; each told once.

    listings: path, signature, seen (order of the listings). Bounded state: one signature a path.
    """

    def work(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        signature, repeats, told = state.get if state.exists else (None, 0, False)
        out = []
        for row in pd.concat(frames).sort_values("seen").itertuples():
            repeats = repeats + 1 if row.signature == signature else 1
            told = told and row.signature == signature
            signature = row.signature
            if repeats >= times and not told:
                told = True
                out.append((key[0], signature, int(row.seen)))
        state.update((signature, repeats, told))
        yield pd.DataFrame(out, columns=["path", "signature", "seen"])

    return listings.groupBy("path").applyInPandasWithState(work, "path string, signature string, seen long", "signature string, repeats int, told boolean", "append", GroupStateTimeout.NoTimeout)


class RequestQueue(StatefulProcessor):
    """One request item: the latest payload, how often it was asked for, and what was already seen.

    Late requests (a lower sequence of the same source) only count; a request that comes again does
    not even that. So any order of arrival of one source gives one state.
    """

    def __init__(self, remember: timedelta | None = None):
        self.remember = remember

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.item = handle.getValueState("item", "source string, seq long, requests long")
        # What was seen is forgotten after a while where the stream says so, so that state does not grow for ever.
        self.seen = handle.getMapState("seen", "source string, seq long", "one boolean", None if self.remember is None else int(self.remember.total_seconds() * 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        source, seq, requests = self.item.get() if self.item.exists() else (None, None, 0)
        for row in pd.concat(rows).sort_values("import_seq").itertuples():
            if self.seen.containsKey((row.source, int(row.seq))):
                continue
            self.seen.updateValue((row.source, int(row.seq)), (True,))
            requests += 1
            if source is None or row.source != source or row.seq > seq:
                source, seq = row.source, int(row.seq)
        self.item.update((source, seq, requests))
        yield pd.DataFrame([(key[0], source, seq, requests)], columns=["identity", "last_source", "last_seq", "request_count"])

    def close(self) -> None:
        pass


def queue_stream(requests: DataFrame, remember: timedelta | None = None) -> DataFrame:
    """The state of each identity after every batch; needs the RocksDB state store.

    A request that comes again counts once for as long as it is remembered, or for ever.
    """
    mode = "none" if remember is None else "processingTime"
    return requests.groupBy("identity").transformWithStateInPandas(RequestQueue(remember), "identity long, last_source string, last_seq long, request_count long", "update", mode)


EVENTS = "identity string, kind string, at timestamp, source string, seq long, lease_token string, lease_until timestamp, outcome string, retry_after_seconds long"
TOLD = "identity string, at timestamp, status string, last_source string, last_seq long, request_count long, attempts long, lease_token string, next_eligible_at timestamp, why string"


def _millis(at: datetime) -> int:
    """Since the epoch; moments without a zone are in UTC, as the session is."""
    return int(pd.Timestamp(at).tz_localize("UTC").timestamp() * 1000) if at.tzinfo is None else int(at.timestamp() * 1000)


class LeasedQueue(StatefulProcessor):
    """A request item with its lease and its waits: takes requests, leases and outcomes, and tells each change.

    A newer request makes the item pending and ends its lease and, unless it was rate limited, its wait; a
    late one only counts, and one that comes again, or a lease's token that does, is passed by for
    as long as it is remembered. A lease holds until its end, an outcome counts only with the lease's
    token. A lease that nobody ends and a wait that is over are told by timers.
    """

    def __init__(self, remember: timedelta | None = None):
        self.remember = remember

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", "source string, seq long, requests long, status string, last_outcome string, attempts long, lease_token string, lease_until timestamp, next_eligible_at timestamp")
        self.seen = handle.getMapState("seen", "kind string, name string, seq long", "one boolean", None if self.remember is None else int(self.remember.total_seconds() * 1000))

    def _again(self, row) -> bool:
        """Whether this request or lease came before; from now on it did."""
        name = ("request", row.source, int(row.seq)) if row.kind == "request" else ("lease", row.lease_token, 0)
        if self.seen.containsKey(name):
            return True
        self.seen.updateValue(name, (True,))
        return False

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        item = list(self.item.get()) if self.item.exists() else None
        told = []
        for row in pd.concat(rows).sort_values(["at", "kind", "seq"]).itertuples():
            if row.kind != "outcome" and (item is not None or row.kind == "request") and self._again(row):
                continue
            if row.kind == "request":
                item, why = self._request(item, row)
            elif item is None:
                continue
            elif row.kind == "lease":
                item, why = self._lease(item, row)
            else:
                item, why = self._outcome(item, row)
            if why:
                told.append(self._row(key[0], row.at, item, why))
        if item is not None:
            self.item.update(tuple(item))
            for at in (item[7], item[8]):
                if at is not None:
                    self.handle.registerTimer(_millis(at))
        yield pd.DataFrame(told, columns=[f.split()[0] for f in TOLD.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, told = expiredTimerInfo.getExpiryTimeInMs(), []
        if self.item.exists():
            item = list(self.item.get())
            at = pd.Timestamp(due, unit="ms")
            if item[3] == "leased" and item[7] is not None and _millis(item[7]) <= due:
                item[3], item[6], item[7] = "pending", None, None
                told.append(self._row(key[0], at, item, "lease over"))
            elif item[3] == "pending" and item[8] is not None and _millis(item[8]) <= due:
                item[8] = None
                told.append(self._row(key[0], at, item, "wait over"))
            self.item.update(tuple(item))
        yield pd.DataFrame(told, columns=[f.split()[0] for f in TOLD.split(", ")])

    @staticmethod
    def _request(item, row):
        if item is None:
            return [row.source, int(row.seq), 1, "pending", None, 0, None, None, None], "new"
        item[2] += 1
        if item[0] == row.source and row.seq <= item[1]:
            return item, "counted"
        item[0], item[1], item[3], item[6], item[7] = row.source, int(row.seq), "pending", None, None
        if item[4] != "rate_limited":
            item[8] = None
        return item, "asked again"

    @staticmethod
    def _lease(item, row):
        busy = (item[7] is not None and item[7] > row.at) or (item[8] is not None and item[8] > row.at)
        if item[3] == "resolved" or busy:
            return item, None
        item[3], item[6], item[7] = "leased", row.lease_token, row.lease_until.to_pydatetime()
        return item, "leased"

    @staticmethod
    def _outcome(item, row):
        if item[3] != "leased" or item[6] != row.lease_token:
            return item, None
        wait = None
        if row.outcome != "success":
            base = 3600 if row.outcome in ("not_found", "rate_limited") else 300
            wait = min(86_400, base << min(item[5], 8)) if pd.isna(row.retry_after_seconds) else int(row.retry_after_seconds)
        item[3], item[4], item[5] = "resolved" if wait is None else "pending", row.outcome, item[5] + 1
        item[6], item[7], item[8] = None, None, None if wait is None else (row.at + pd.Timedelta(seconds=wait)).to_pydatetime()
        return item, row.outcome

    @staticmethod
    def _row(key, at, item, why):
        return (key, at, item[3], item[0], item[1], item[2], item[5], item[6], item[8], why)

    def close(self) -> None:
        pass


def leased_queue(events: DataFrame, remember: timedelta | None = None) -> DataFrame:
    """Every change of every item, by the events of EVENTS (kind: request, lease, outcome); needs the RocksDB state store."""
    return events.groupBy("identity").transformWithStateInPandas(LeasedQueue(remember), TOLD, "append", "processingTime")


def pause_stream(changes: DataFrame) -> DataFrame:
    """Until when rate limits pause all items: one row, which only ever moves on. changes: rows of TOLD."""
    return changes.where("why = 'rate_limited'").groupBy(F.lit("all").alias("scope")).agg(F.max("next_eligible_at").alias("paused_until"))


def _pause(spark: SparkSession, root: str, number: int | None = None) -> datetime | None:
    """Until when all items are paused, by the last version of that one value (or by a version)."""
    at = current_version(spark, root) if number is None else number
    told = describe_version(spark, root, at)["paused_until"] if at else None
    return None if told is None else datetime.fromisoformat(told)


def keep_pause(spark: SparkSession, root: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over changes (rows of TOLD): publishes until when all items are paused, wherever a rate limit moves that on.

    A batch that comes again moves nothing on. Sessions and moments are in UTC.
    """

    def work(changes: DataFrame, _: int) -> None:
        after = current_version(spark, root)
        latest = pause_stream(changes).first()
        before = _pause(spark, root, after)
        if latest is not None and (before is None or latest["paused_until"] > before):
            publish(spark, root, "", after, {"paused_until": latest["paused_until"].isoformat()})

    return work


def gate_leases(spark: SparkSession, pauses: str, root: str, at: str = "at") -> Callable[[DataFrame, int], None]:
    """For foreachBatch over calls for leases: writes them to `calls` below root with `granted`, false while all items are paused.

    What a batch read of the pause is published before it is used, so that the batch decides alike if it comes
    again, though the pause may have moved on, and its calls are written once more over the same place. The
    rows granted are the lease events of `leased_queue`, which passes by a token that it has met.
    """

    def work(calls: DataFrame, batch: int) -> None:
        decided = f"{root}/decided"
        known = current_version(spark, decided)
        if known <= batch:
            paused = _pause(spark, pauses)
            publish(spark, decided, "", batch, {"paused_until": None if paused is None else paused.isoformat()})
        until = describe_version(spark, decided, batch + 1)["paused_until"]
        paused = F.lit(None).cast("timestamp") if until is None else F.lit(until).cast("timestamp")
        told = calls.withColumn("paused_until", paused).withColumn("granted", F.coalesce(F.col(at) >= F.col("paused_until"), F.lit(True)))
        told.write.mode("overwrite").parquet(f"{root}/calls/batch_id={batch}")

    return work


def run_batches(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Takes what is there now, batch by batch, and ends."""
    stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def unit_stream(stream: DataFrame, root: str, depth: int, watermark: str | None = None) -> DataFrame:
    """Directories at a depth below a root, each once as files of them arrive: root, unit, depth, status."""
    below = F.substring_index(F.col("path"), f"{root.rstrip('/')}/", -1)
    parts = F.split(below, "/")
    kept = stream if watermark is None else stream.withWatermark("modificationTime", watermark)
    units = kept.where(F.contains("path", F.lit(f"{root.rstrip('/')}/")) & (F.size(parts) > depth)).withColumn("unit", F.array_join(F.slice(parts, 1, depth), "/"))
    one = units.dropDuplicates(["unit"]) if watermark is None else units.dropDuplicatesWithinWatermark(["unit"])
    return one.select(F.lit(root).alias("root"), "unit", F.lit(depth).alias("depth"), F.lit("pending").alias("status"))


def once(stream: DataFrame, key: str, at: str | None = None, watermark: str | None = None) -> DataFrame:
    """Rows of keys that were not seen before; within the watermark of a time column where one is given, which bounds the state."""
    return stream.dropDuplicates([key]) if watermark is None else stream.withWatermark(at, watermark).dropDuplicatesWithinWatermark([key])


def run_until(stream: DataFrame, folder: str, checkpoint: str, done: Callable[[], bool], most: float = 120.0) -> bool:
    """Runs until done() or so many seconds are over; whether it was done.

    A stream with timers of the clock always has another batch to run, so that it never ends by itself.
    """
    query = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime="1 second").start()
    try:
        end = time.monotonic() + most
        while not (ended := done()) and time.monotonic() < end and query.isActive:
            time.sleep(0.5)
        return ended
    finally:
        query.stop()


def run_once(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> None:
    """Takes what is there now, writes it as Parquet, and ends."""
    query = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
