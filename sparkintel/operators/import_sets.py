"""Snapshots of several stores imported as one set: previewed, written off-line, and published whole or not at all."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkintel.operators.imports import Merged, Store
from sparkintel.sources.exports import current_version, describe_version, publish, remove

Merge = Callable[[Store, Store], Merged]


class SetChanged(ValueError):
    """Snapshots changed while they were imported."""


@dataclass
class Part:
    """One store of a set: how its snapshots are merged, under which name they are listed, and what it is before any import."""

    merge: Merge
    snapshots: Store
    empty: Store
    listing: str = "snapshots"
    checks: list[Callable[[Store], DataFrame]] = field(default_factory=list)  # rows that must not be there after the merge

    def digest(self) -> str:
        """Of the digests of its snapshots, which stand for their content."""
        listed = sorted(r[0] for r in self.snapshots[self.listing].select("source_sha256").distinct().collect())
        return hashlib.sha256("\n".join(listed).encode()).hexdigest()


def set_id(digests: dict[str, str]) -> str:
    return hashlib.sha256(json.dumps(digests, sort_keys=True).encode()).hexdigest()


def open_store(spark: SparkSession, root: str, name: str, part: Part, number: int) -> Store:
    """A store of a published version, or what it is before any."""
    if not number:
        return part.empty
    folder = describe_version(spark, root, number)["folder"]
    return {table: spark.read.schema(df.schema).parquet(f"{folder}/{name}/{table}") for table, df in part.empty.items()}


def _row(counts: DataFrame) -> dict[str, int]:
    return {k: int(v) for k, v in counts.first().asDict().items()}


def import_set(spark: SparkSession, root: str, parts: dict[str, Part], dry_run: bool = False) -> dict[str, Any]:
    """Imports the snapshots of all parts into the last version below root, and publishes the next.

    Every part is merged first, which refuses what is not canonical before any table is written; a dry
    run ends there. Then all tables are written to a folder of their own, read back, held against each part's
    checks, and published under one number, if nobody else did in the meantime and the snapshots are
    still the same. A set whose snapshots are all recorded publishes nothing.
    """
    after = current_version(spark, root)
    digests = {name: part.digest() for name, part in parts.items()}
    stores = {name: open_store(spark, root, name, part, after) for name, part in parts.items()}
    told: dict[str, Any] = {"import_set_id": set_id(digests), "dry_run": dry_run, "version": after}
    fresh = [name for name, part in parts.items() if not part.snapshots[part.listing].select("source_sha256").join(stores[name]["ledger"], "source_sha256", "left_anti").isEmpty()]
    if not fresh and not dry_run:
        return told | {"already_imported": True}
    merged = {name: part.merge(stores[name], part.snapshots) for name, part in parts.items()}
    if dry_run:
        return told | {"previews": {name: _row(m.counts) for name, m in merged.items()}}

    folder = f"{root}/data/{uuid.uuid4().hex}"
    try:
        applied = {}
        for name, m in merged.items():
            for table, df in m.store.items():
                df.write.parquet(f"{folder}/{name}/{table}")
            applied[name] = _row(m.counts)
            back = {table: spark.read.schema(df.schema).parquet(f"{folder}/{name}/{table}") for table, df in m.store.items()}
            for check in parts[name].checks:
                if odd := check(back).limit(1).collect():
                    raise ValueError(f"{name} is not sound after the import: {odd[0].asDict()}")
        if {name: part.digest() for name, part in parts.items()} != digests:
            raise SetChanged("snapshots changed during the import")
        receipt = told | {"sources": digests, "applied": applied}
        number = publish(spark, root, folder, after, receipt)
    except BaseException:
        remove(spark, folder)
        raise
    return receipt | {"version": number}


def one_row_a_key(table: str, *keys: str) -> Callable[[Store], DataFrame]:
    """A check: keys that a table has more than once."""
    return lambda store: store[table].groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def refers(table: str, other: str, *keys: str) -> Callable[[Store], DataFrame]:
    """A check: rows of a table whose keys another has not."""
    return lambda store: store[table].join(store[other].select(*keys).distinct(), list(keys), "left_anti")
