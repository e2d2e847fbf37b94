"""Captured files: scan, eligibility, inventory, archives, and address tuples."""

from __future__ import annotations

import io
import re
import tarfile
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkintel.functions.addresses import canonical_ip, ip_version, order_key
from sparkintel.functions.strings import is_safe_member
from sparkintel.operators.folds import running_digest

ARCHIVE_SUFFIXES = (".tar.gz", ".tgz", ".zip")
#: Bytes of members that are held at once, but for a single larger one.
FRAME_BYTES = 16 << 20


def eligible(path: Column, max_depth: int | None = None, include_hidden: bool = True, name_only: bool = False) -> Column:
    """Whether a relative path is within the depth and, if asked, has no hidden part (or name)."""
    parts = F.split(path, "/")
    tests = [] if max_depth is None else [F.size(parts) - 1 <= max_depth]
    if not include_hidden:
        tests.append(~F.startswith(F.element_at(parts, -1), F.lit(".")) if name_only else ~F.exists(parts, lambda p: F.startswith(p, F.lit("."))))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def scan_capture(spark: SparkSession, root: str, max_depth: int | None = None, include_hidden: bool = True, max_bytes: int | None = None, content: bool = True) -> DataFrame:
    """Files below a folder: path (relative), length, modificationTime, content where asked, and error.

    A file above the limit is a row with the error `too_large` and no content, and is not read, as the limit is a
    filter on `length`; `read_slices` reads such files in parts. Without content no file is opened at all.
    Spark's own listing leaves out names that start with a dot or an underscore; they are reached
    through archives and manifests.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    path = F.expr("substring(path, locate('{0}/', path) + {1})".format(base.replace("'", "\\'"), len(base) + 1))

    def named(df: DataFrame, read: bool, error: str | None) -> DataFrame:
        held = [(F.col("content") if read else F.lit(None).cast("binary")).alias("content")] if content else []
        return df.select(path.alias("path"), "length", "modificationTime", *held, F.lit(error).cast("string").alias("error"))

    if max_bytes is None:
        rows = named(files, True, None)
    else:
        rows = named(files.where(F.col("length") <= max_bytes), True, None).union(named(files.where(F.col("length") > max_bytes), False, "too_large"))
    return rows.where(eligible(F.col("path"), max_depth, include_hidden))


#: A token that a slice may cut is at most so long; longer runs are cut anywhere.
OVERLAP = 128
#: Bytes of which tokens consist; all others end one.
_TOKEN = bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + b".:%_-/@" + bytes(range(128, 256))
_ENDS = re.compile(b"[^" + re.escape(_TOKEN) + b"]")


def _cut(source, at: int, size: int) -> int:
    """Where the slices on both sides of a place part: after the first byte from the one before it on that is of no token, if one is near."""
    if at <= 0 or at >= size:
        return max(0, min(at, size))
    found = _ENDS.search(source.read_at(min(OVERLAP + 1, size - at + 1), at - 1))
    return at if found is None else at + found.start()


def read_slices(files: DataFrame, slice_bytes: int = 16 << 20) -> DataFrame:
    """Files (uri, length) in slices: uri, start, content; together the slices of a file are its bytes.

    Slices end between tokens of up to OVERLAP bytes, so that whatever is looked for in tokens is found in
    exactly one slice, at its place in the file less `start`. A task reads one slice at a time, so that
    a file of any size is neither a row nor a task. uri: qualified as by Spark's own listing.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, size, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, path = pafs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else f"file://{uri.removeprefix('file:')}")
                with fs.open_input_file(path) as source:
                    start, end = _cut(source, first, size), _cut(source, first + slice_bytes, size)
                    if end > start or size == 0:
                        yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([start], pa.int64()), pa.array([source.read_at(end - start, start)], pa.binary())], names=["uri", "start", "content"])

    places = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(slice_bytes).cast("long"))).alias("first")
    partitions = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Dealt out, as the list of a few large files lies in one partition.
    return files.select("uri", F.col("length").cast("long").alias("length"), places).repartition(partitions, "uri", "first").mapInArrow(work, "uri string, start long, content binary")


def manifest(files: DataFrame, capture_id: Column) -> DataFrame:
    """Rows of a capture's manifest: capture_id, path, type, size, sha256."""
    return files.select(capture_id.alias("capture_id"), "path", F.lit("file").alias("type"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def inventory_violations(rows: DataFrame, most: int = 200_000) -> DataFrame:
    """What is wrong in manifests: capture_id, path, violation."""
    file = F.col("type") == "file"
    wrong = F.array(
        F.when(~is_safe_member(F.col("path")), "path"), F.when(~F.col("type").isin("file", "directory"), "type"), F.when(F.col("size") < 0, "size"),
        F.when(file & ~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "digest"), F.when(~file & F.col("sha256").isNotNull(), "digest"),
    )
    each = rows.select("capture_id", "path", F.explode(F.array_compact(wrong)).alias("violation"))
    twice = rows.groupBy("capture_id", "path", "type").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("capture_id", "path", F.lit("duplicate").alias("violation"))
    many = rows.groupBy("capture_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("capture_id", F.lit(None).cast("string").alias("path"), F.lit("entries").alias("violation"))
    return each.union(twice).union(many)


def manifest_digest(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One digest for each key over its sorted rows; rows are hashed where they lie, and hashes read as a stream."""
    line = F.sha2(F.to_json(F.struct(*columns)), 256)
    return running_digest(rows.select(key, line.alias("line")), [key], F.col("line")).select(key, "digest")


def replay(captures: DataFrame, manifests: DataFrame, files: DataFrame, capture_id: str, analyse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The analysis of a retained capture again, with today's intelligence.

    captures: capture_id, status, digest; manifests: capture_id, path, type, size, sha256; files: path,
    content. Only a capture that is ready and whose manifest still has its digest is analysed, and only if
    every file of it is there unchanged.
    """
    row = captures.where(F.col("capture_id") == capture_id).limit(2).collect()
    own = manifests.where(F.col("capture_id") == capture_id)
    if len(row) != 1 or row[0]["status"] != "ready":
        raise ValueError(f"{capture_id} is no ready capture")
    told = manifest_digest(own, "capture_id", ["path", "type", "size", "sha256"]).first()
    if told is None or told["digest"] != row[0]["digest"]:
        raise ValueError(f"the manifest of {capture_id} has changed")
    hashed = files.select("path", "content", F.sha2("content", 256).alias("found"))
    joined = own.where("type = 'file'").select("path", "sha256").join(hashed, "path", "left")
    if odd := joined.where("found IS NULL OR found <> sha256").select("path").limit(1).collect():
        raise ValueError(f"{odd[0]['path']} is not what the manifest says")
    return analyse(joined.select("path", "content"))


def is_archive(path: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.endswith(F.lower(path), F.lit(s)) for s in ARCHIVE_SUFFIXES])


def _members(name: str, content: bytes) -> Iterator[tuple[str, int, bool, object]]:
    """(path, size, regular, opener) of an archive's members, from its headers."""
    if name.lower().endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for m in z.infolist():
                if not m.is_dir():
                    kind = m.external_attr >> 28 & 15
                    yield m.filename, m.file_size, not m.flag_bits & 1 and kind in (0, 8), lambda m=m: z.open(m)
    else:
        with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz") as t:
            for m in t:
                if not m.isdir():
                    yield m.name, m.size, m.isreg() and not m.issparse(), lambda m=m: t.extractfile(m)


def _safe(path: str) -> bool:
    return bool(path) and not path.startswith("/") and "\\" not in path and "\0" not in path and ".." not in path.split("/")


def estimate_archives(files: DataFrame) -> DataFrame:
    """Members and uncompressed bytes of each archive, from its headers: path, n_files, n_bytes, error."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    sizes = [size for _, size, _, _ in _members(path, bytes(content))]
                    rows.append((path, len(sizes), sum(sizes), None))
                except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError) as e:
                    rows.append((path, 0, 0, type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "n_files", "n_bytes", "error"])

    return files.where(is_archive(F.col("path"))).select("path", "content").mapInPandas(work, "path string, n_files long, n_bytes long, error string")


def expand_archives(files: DataFrame, max_files: int = 200_000, max_bytes: int = 1 << 31, max_depth: int = 2) -> DataFrame:
    """Members of archives, and of archives in them up to the depth: path (archive!member), content, error.

    What is wrong is a row with an error and no content: limits, unsafe paths, links and special or
    encrypted members, sizes that differ from the header's, archives that can't be read.
    """

    def members(path: str, content: bytes) -> Iterator[tuple[str, bytes | None, str | None]]:
        count = total = 0
        try:
            for name, size, regular, opened in _members(path, content):
                count, total = count + 1, total + size
                if count > max_files or total > max_bytes:
                    yield path, None, "limit"
                    return
                if not _safe(name):
                    yield f"{path}!{name}", None, "unsafe_path"
                elif not regular:
                    yield f"{path}!{name}", None, "special_member"
                else:
                    data = opened().read(size + 1)
                    yield f"{path}!{name}", data if len(data) == size else None, None if len(data) == size else "size_differs"
        except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, RuntimeError) as e:
            yield path, None, type(e).__name__

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                # By size, so that of a large archive only some members are held at once.
                rows, held = [], 0
                for row in nested(path, bytes(content), max_depth):
                    rows.append(row)
                    held += len(row[1] or b"")
                    if held >= FRAME_BYTES:
                        yield pd.DataFrame(rows, columns=["path", "content", "error"])
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=["path", "content", "error"])

    def nested(path: str, content: bytes, depth: int) -> Iterator[tuple[str, bytes | None, str | None]]:
        for row in members(path, content):
            yield row
            if depth > 1 and row[1] is not None and row[0].lower().endswith(ARCHIVE_SUFFIXES):
                yield from nested(row[0], row[1], depth - 1)

    archives = files.where(is_archive(F.col("path"))).select("path", "content")
    return archives.mapInPandas(work, "path string, content binary, error string")


def read_ip_tuples(lines: DataFrame) -> DataFrame:
    """Distinct (ip, path) of lines `ip; path`, addresses in canonical form; others are left out."""
    parts = F.split("value", ";", 2)
    return lines.select(canonical_ip(F.trim(F.get(parts, F.lit(0)))).alias("ip"), F.trim(F.get(parts, F.lit(1))).alias("path")).where("ip IS NOT NULL AND path IS NOT NULL").distinct()


def ip_tuple_lines(pairs: DataFrame) -> DataFrame:
    """Lines in the order of the file: v4 first, then by text."""
    return pairs.orderBy(ip_version(F.col("ip")) == 6, "ip", "path").select(F.concat_ws("; ", "ip", "path").alias("value"))


def remaining_tuples(lines: DataFrame, completed: DataFrame) -> DataFrame:
    """Lines whose address is not completed, and all that can't be read."""
    marked = lines.withColumn("ip", canonical_ip(F.trim(F.get(F.split("value", ";", 2), F.lit(0)))))
    return marked.join(completed.select("ip"), "ip", "left_anti").select("value")


def first_ips(pairs: DataFrame, n: int) -> DataFrame:
    """The first n addresses by version and number."""
    return pairs.select("ip").distinct().orderBy(order_key(F.col("ip"))).limit(n)
