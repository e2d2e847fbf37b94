"""Stores kept in buckets of their keys: an import reads and writes the buckets that its snapshots touch, and no others.

A version names, for each table, the folder that each bucket lies in. The next version takes over all
buckets but those that hold a key of its snapshots; these it reads, merges and writes anew. Tables that
only grow get one more folder a version. So an import costs what its snapshots bring and the buckets
around it, whatever the size of the store; versions before it stay readable.

What is collected is bounded by the number of buckets, which the layout states: their numbers, not their
keys. A bucket that holds a hot key is written by several tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkintel.functions.strings import normalize_hash
from sparkintel.operators.import_sets import Part, SetChanged, set_id
from sparkintel.operators.imports import Merged, Store, empty_file_store, fresh_snapshots, merge_file_store
from sparkintel.sources.exports import current_version, describe_version, publish, remove

#: From snapshots, and a reader of the store's rows near keys, to the keys touched, by key column.
Touches = Callable[[Store, Callable[[str, DataFrame], DataFrame]], dict[str, DataFrame]]


@dataclass
class Layout:
    """How a store lies: the key column of each table in buckets, and the tables that only grow; others are small and replaced whole.

    Rows of one key must depend on rows of that key alone, over all tables of one key column. touches: tells
    the touched keys where the snapshots' tables do not hold them as columns of the same name. buckets: a
    bucket is a folder, so that there should be as many as the store has files of a good size.
    """

    keys: dict[str, str]
    grows: tuple[str, ...] = ("ledger",)
    buckets: int = 64
    touches: Touches | None = None


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class KeptStore:
    """A store of a published version, of which tables are read by bucket."""

    def __init__(self, spark: SparkSession, name: str, part: Part, layout: Layout, facts: dict[str, Any]):
        self.spark, self.name, self.part, self.layout = spark, name, part, layout
        if (known := facts.get("layouts", {}).get(name, layout.buckets)) != layout.buckets:
            raise ValueError(f"{name} lies in {known} buckets")
        self.places: dict[str, dict[str, list[int]]] = facts.get("places", {}).get(name, {})

    def read(self, table: str, only: list[int] | None = None) -> DataFrame:
        """A table, or those of its buckets that are named."""
        schema, wanted = self.part.empty[table].schema, None if only is None else set(only)
        paths = []
        for folder, buckets in self.places.get(table, {}).items():
            at = f"{folder}/{self.name}/{table}"
            paths += [f"{at}/bucket={b}" for b in buckets if wanted is None or b in wanted] if table in self.layout.keys else [at]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def store(self, touched: dict[str, list[int]] | None = None) -> Store:
        """All tables; or the touched buckets, nothing of tables that only grow, and the small ones."""
        if touched is None:
            return {table: self.read(table) for table in self.part.empty}
        out = {}
        for table, df in self.part.empty.items():
            key = self.layout.keys.get(table)
            out[table] = self.spark.createDataFrame([], df.schema) if table in self.layout.grows else self.read(table, touched[key] if key else None)
        return out

    def near(self, table: str, keys: DataFrame) -> DataFrame:
        """The rows of a table in the buckets of keys, which are one column."""
        return self.read(table, self._buckets({"k": keys})["k"])

    def _buckets(self, keys: dict[str, DataFrame]) -> dict[str, list[int]]:
        of = [df.select(F.lit(column).alias("key"), bucket_of(F.col(df.columns[0]), self.layout.buckets).alias("bucket")) for column, df in keys.items()]
        found: dict[str, list[int]] = {column: [] for column in keys}
        for key, bucket in reduce(DataFrame.union, of).distinct().collect():  # as many as there are buckets, at most
            found[key].append(bucket)
        return {column: sorted(buckets) for column, buckets in found.items()}

    def touched(self, snapshots: Store) -> dict[str, list[int]]:
        """The buckets that keys of the snapshots fall into, by key column."""
        if self.layout.touches:
            return self._buckets(self.layout.touches(snapshots, self.near))
        columns = sorted(set(self.layout.keys.values()))
        tables = {c: [snapshots[t].select(c) for t, key in self.layout.keys.items() if key == c and t in snapshots] for c in columns}
        return self._buckets({c: reduce(DataFrame.union, dfs) for c, dfs in tables.items()})

    def write(self, tables: Store, folder: str, touched: dict[str, list[int]] | None) -> dict[str, dict[str, list[int]]]:
        """Writes what a merge gave, and says where all buckets lie then."""
        after: dict[str, dict[str, list[int]]] = {}
        for table, df in tables.items():
            key, at, before = self.layout.keys.get(table), f"{folder}/{self.name}/{table}", self.places.get(table, {})
            if key is None:
                df.write.parquet(at)
                after[table] = (before if table in self.layout.grows else {}) | {folder: []}
                continue
            # One task or, for a large bucket, several write a bucket.
            df.withColumn("bucket", bucket_of(F.col(key), self.layout.buckets)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(at)
            gone = set(range(self.layout.buckets) if touched is None else touched[key])
            left = {place: kept for place, buckets in before.items() if (kept := [b for b in buckets if b not in gone])}
            after[table] = left | ({folder: made} if (made := written_buckets(self.spark, at)) else {})
            if stray := set(made) - gone:
                raise ValueError(f"{self.name}/{table}: the merge gave rows of buckets that it did not read: {sorted(stray)[:3]}")
        return after


def written_buckets(spark: SparkSession, folder: str) -> list[int]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    names = [f.getPath().getName() for f in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)]
    return sorted(int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket="))


def open_kept(spark: SparkSession, root: str, name: str, part: Part, layout: Layout, number: int | None = None) -> Store:
    """All tables of a store in a published version, by default the last; before any, what it starts from."""
    number = current_version(spark, root) if number is None else number
    return KeptStore(spark, name, part, layout, describe_version(spark, root, number)).store() if number else part.empty


def import_changes(spark: SparkSession, root: str, parts: dict[str, Part], layouts: dict[str, Layout]) -> dict[str, Any]:
    """Imports the snapshots of all parts into the last version below root, bucket by bucket, and publishes the next.

    The first version is written whole, from what the parts start from. Later ones read and write only
    touched buckets; a part without new snapshots stays where it is. As in a set that is imported whole,
    what fails publishes nothing, another writer's version in the meantime is a conflict, and checks see
    the rows that were written. `touched` tells how many buckets of each key column were.
    """
    after = current_version(spark, root)
    facts = describe_version(spark, root, after) if after else {}
    digests = {name: part.digest() for name, part in parts.items()}
    told: dict[str, Any] = {"import_set_id": set_id(digests), "version": after}
    kept = {name: KeptStore(spark, name, part, layouts[name], facts) for name, part in parts.items()}
    fresh = {name: fresh_snapshots(part.snapshots[part.listing], kept[name].read("ledger") if after else part.empty["ledger"]) for name, part in parts.items()}
    new = [name for name in parts if not after or not fresh[name].isEmpty()]
    if not new:
        return told | {"already_imported": True}

    folder = f"{root}/data/{uuid.uuid4().hex}"
    places, applied, counted = dict(facts.get("places", {})), {}, {}
    try:
        for name in new:
            part, store, touched = parts[name], parts[name].empty, None
            snapshots = part.snapshots
            if after:
                listed = fresh[name].select("source_sha256")
                snapshots = {t: df.join(listed, "source_sha256", "left_semi") for t, df in snapshots.items() if t != part.listing} | {part.listing: fresh[name]}
                touched = kept[name].touched(snapshots)
                store = kept[name].store(touched)
            merged: Merged = part.merge(store, snapshots)
            places[name] = kept[name].write(merged.store, folder, touched)
            applied[name] = {k: int(v) for k, v in merged.counts.first().asDict().items()}
            counted[name] = {} if touched is None else {column: len(buckets) for column, buckets in touched.items()}
            written = KeptStore(spark, name, part, layouts[name], {"places": {name: {t: {f: b for f, b in at.items() if f == folder} for t, at in places[name].items()}}}).store()
            for check in part.checks:
                if odd := check(written).limit(1).collect():
                    raise ValueError(f"{name} is not sound after the import: {odd[0].asDict()}")
        if {name: part.digest() for name, part in parts.items()} != digests:
            raise SetChanged("snapshots changed during the import")
        layout = facts.get("layouts", {}) | {name: layouts[name].buckets for name in parts}
        receipt = told | {"sources": digests, "applied": applied, "touched": counted, "layouts": layout, "places": places}
        number = publish(spark, root, folder, after, receipt)
    except BaseException:
        remove(spark, folder)
        raise
    return receipt | {"version": number}


#: Addresses: everything hangs on the address; runs and results only grow.
IP_LAYOUT = Layout({"entities": "ip", "reverse_dns": "ip", "related_iocs": "ip", "related_actors": "ip"}, ("ledger", "runs", "results"))

#: Repositories: people have a key of their own.
REPO_LAYOUT = Layout({t: "identity_key" for t in ("repositories", "documents", "versions", "snapshots", "roles", "findings", "evidence", "inferences", "current")} | {"people": "normalized_name"})


def empty_indexed_store(spark: SparkSession) -> Store:
    """A store of files without any, with what `merge_indexed_files` keeps."""
    return empty_file_store(spark) | {"by_md5": spark.createDataFrame([], "md5 string, group string"), "tops": spark.createDataFrame([(-1,)], "top long")}


def merge_indexed_files(store: Store, snapshots: Store) -> Merged:
    """`merge_file_store` that keeps two more tables: by_md5 (md5, group), and tops (top), the greatest number of an import.

    The store may hold just the files of touched buckets: those with a hash that the snapshots bring.
    """
    merged = merge_file_store(store, snapshots)
    files = merged.store["files"]
    told = snapshots["files"].select(normalize_hash(F.col("md5")).alias("md5")).where("md5 IS NOT NULL").distinct()
    # Only the MD5 values that were brought can find other files than before.
    found = files.where("md5 IS NOT NULL").select("md5", "group").join(told, "md5", "left_semi")
    merged.store["by_md5"] = store["by_md5"].join(told, "md5", "left_anti").select("md5", "group").union(found)
    merged.store["tops"] = store["tops"].union(files.agg(F.max("import_seq").alias("top"))).agg(F.coalesce(F.max("top"), F.lit(-1).cast("long")).alias("top"))
    return merged


def touched_files(snapshots: Store, near: Callable[[str, DataFrame], DataFrame]) -> dict[str, DataFrame]:
    """Files that bear a hash of the snapshots: by its name, or as by_md5 says, which is read in the buckets of those values."""
    rows = snapshots["files"].select("row_id", normalize_hash(F.col("sha256")).alias("sha256"), normalize_hash(F.col("md5")).alias("md5"))
    md5 = rows.select("md5").where("md5 IS NOT NULL").distinct()
    own = F.array_compact(F.array(F.concat(F.lit("s:"), "sha256"), F.concat(F.lit("m:"), "md5"), F.concat(F.lit("r:"), F.col("row_id").cast("string"))))
    return {"group": rows.select(F.explode(own).alias("group")).union(near("by_md5", md5).join(md5, "md5", "left_semi").select("group")), "md5": md5}


#: Files: everything hangs on the file; an index leads from MD5 values to files.
FILE_LAYOUT = Layout({t: "group" for t in ("files", "file_names", "tags", "observations", "lookups")} | {"by_md5": "md5"}, touches=touched_files)
