"""Folds over ordered rows that keep a running state alone, whatever the size of a group."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from sparkintel.sources.exports import written_once

Step = Callable[[Any, tuple], tuple[Any, tuple | None]]


def fold_in_order(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], like: str, start: Callable[[], Any], step: Step, end: Callable[[Any], tuple | None] | None = None) -> DataFrame:
    """Folds the rows of each key in their order: keys..., and what `step` (for a row) or `end` (for a key) tells.

    step takes the state and the row's columns and gives the next state and a row to tell, or None; `like`
    names what is told. A key's rows are a stream that is sorted on disk, never one frame or array.
    """
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.select(*keys).schema)}, {like}"
    width = len(keys)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = state = None
        begun, told = False, []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*told, strict=True), arrow, strict=True)], schema=arrow)

        for each in batches:
            for row in zip(*(each.column(k).to_pylist() for k in range(each.num_columns)), strict=True):
                key = row[:width]
                if not begun or key != last:
                    if begun and end and (row_told := end(state)) is not None:
                        told.append((*last, *row_told))
                    last, state, begun = key, start(), True
                state, row_told = step(state, row[width:])
                if row_told is not None:
                    told.append((*key, *row_told))
            if told:
                yield batch()
                told = []
        if begun and end and (row_told := end(state)) is not None:
            told.append((*last, *row_told))
            yield batch()

    arrow = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)
    ordered = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    return ordered.select(*keys, *columns).mapInArrow(work, schema)


def numbered_in_order(parts: list[DataFrame], keys: list[str], name: str) -> DataFrame:
    """The rows of all parts with their number within their keys, from 1, as `name`.

    Each part is sorted by its keys and then by its own order, by ranges (`in_ranges`); a key is in one part.
    Numbers are those within a range and what the ranges before hold of the key, so that a key of very many rows
    is dealt over as many tasks as there are ranges of it, and none of them sees the others.
    """
    mark = F.monotonically_increasing_id()
    marked = written_once(reduce(DataFrame.unionByName, parts).withColumn("mark_of_row", mark)).withColumn("range_of_row", F.expr("shiftright(mark_of_row, 33)"))
    sizes = marked.groupBy(*keys, "range_of_row").agg(F.count(F.lit(1)).alias("rows_of_range"), F.min("mark_of_row").alias("first_of_range"))
    before = F.sum("rows_of_range").over(Window.partitionBy(*keys).orderBy("range_of_row")) - F.col("rows_of_range")  # one row a range
    starts = sizes.withColumn("before_range", before).drop("rows_of_range")
    number = F.col("mark_of_row") - F.col("first_of_range") + F.col("before_range") + 1
    columns = [c for c in parts[0].columns if c not in keys]
    return marked.join(starts, [*keys, "range_of_row"]).select(*keys, number.cast("long").alias(name), *columns)


def in_ranges(rows: DataFrame, *order: Column) -> DataFrame:
    """The rows dealt out and sorted by ranges of an order."""
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


def fitting_in_order(items: DataFrame, key: str, size: str, whole: int, name: str, each: int | None = None) -> DataFrame:
    """key, id, size and, as `name`, whether the item fits: none above `each`, and their sum in order of id within `whole`.

    An item that does not fit takes nothing.
    """

    def step(used: int, row: tuple) -> tuple[int, tuple]:
        number, n = row
        good = n is not None and (each is None or n <= each) and used + n <= whole
        return used + n if good else used, (number, n, good)

    rows = items.select(key, F.col("id").cast("long").alias("id"), F.col(size).cast("long").alias(size))
    return fold_in_order(rows, [key], ["id", size], ["id", size], f"id long, {size} long, {name} boolean", int, step)


def running_digest(rows: DataFrame, keys: list[str], line: Column, order: list[str] | None = None, between: str = "", around: tuple[str, str] = ("", "")) -> DataFrame:
    """The SHA-256 of each key's lines, one after the other in their order (by themselves without one), with text between and around them, and their number: keys..., digest, n.

    Lines are best hashes themselves: they alone are brought together, and read as a stream.
    """

    def step(state: list, row: tuple) -> tuple[list, None]:
        digest, n = state
        digest.update((between if n else around[0]).encode() + (row[0] or "").encode())
        return [digest, n + 1], None

    def end(state: list) -> tuple[str, int]:
        state[0].update(around[1].encode())
        return state[0].hexdigest(), state[1]

    named = rows.select(*rows.columns, line.alias("line_of_digest"))
    return fold_in_order(named, keys, [*(order or []), "line_of_digest"], ["line_of_digest"], "digest string, n long", lambda: [hashlib.sha256(), 0], step, end)
