"""Best-fit packing of token sequences by minimum bin slack.

Only lengths matter to the plan, and a length is at most the capacity, so the counts of pieces by
length (at most 2048 rows, however large the corpus) hold all that the plan needs. For each bin, a
bitset subset-sum dynamic programme over the lengths still available finds the fullest feasible
combination around the longest; the bin is then removed, at once as often as the counts allow.
Pieces are ranked within their length in salted buckets, and a rank's place in the plan is its
place in a bin.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkintel.llm.staging import Staged, batches_of
from sparkintel.llm.token_ids import encoder, ids_crc32
from sparkintel.llm.words import text_groups

CAPACITY = 2048
END_ID = 0
#: Whole texts that pass to Python at once, at most.
BATCH = 1000


def fullest(room: int, counts: dict[int, int], lengths: list[int]) -> list[tuple[int, int]]:
    """The (length, times) whose sum is the largest that is at most room; lengths descend."""
    reach, layers = 1, []
    within = (1 << (room + 1)) - 1
    for length in lengths:
        left = min(counts[length], room // length)
        if left <= 0:
            continue
        layers.append((length, reach))
        step = 1
        while left > 0:
            step = min(step, left)
            reach |= (reach << (step * length)) & within
            left -= step
            step *= 2
        if reach >> room:
            break
    total, chosen = reach.bit_length() - 1, []
    for length, before in reversed(layers):
        times = 0
        while not before >> total & 1:
            total -= length
            times += 1
        if times:
            chosen.append((length, times))
    return chosen


def slack_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(bins, combination) for all pieces: each combination fills so many bins."""
    counts, plan = {k: v for k, v in counts.items() if v > 0}, []
    lengths = sorted(counts, reverse=True)
    while lengths:
        longest = lengths[0]
        counts[longest] -= 1
        chosen = dict(fullest(capacity - longest, counts, lengths))
        counts[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        bins = min(counts[length] // times for length, times in chosen.items())
        for length, times in chosen.items():
            counts[length] -= bins * times
        plan.append((bins, sorted(chosen.items(), reverse=True)))
        lengths = [x for x in lengths if counts[x]]
    return plan


def piece_rows(tokenizer_path: str, capacity: int):
    """Arrow batches of (id, text) to rows of pieces; about a MB of texts at a time becomes Python objects."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = encoder(tokenizer_path).encode_all
        for batch in batches:
            for row, data, starts in text_groups(batch.column(1)):
                bounds = zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)
                rows: list[tuple] = []
                for k, found in enumerate(encode_all(data[a:b].tobytes() for a, b in bounds), row):
                    ids = np.append(found, np.uint32(END_ID))
                    rows += [(k, n, start, len(x := ids[start : start + capacity]), ids_crc32(x)) for n, start in enumerate(range(0, len(ids), capacity))]
                k, piece, start, length, crc = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(k, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["id", "piece", "start", "length", "ids_crc32"],
                )

    return work


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """id, piece, start, length, ids_crc32: the ids of each text and an end id, cut at the capacity."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return texts.mapInArrow(piece_rows(tokenizer_path, capacity), f"id {kind}, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one end id. A text of more than the capacity is cut into full pieces and a
    rest. Repeated rows are packed as often as they come. An empty table gives an empty result.
    """
    staged = Staged(docs.sparkSession, "packing")
    with batches_of(docs.sparkSession, BATCH):
        pieces = staged.write(token_pieces(docs, tokenizer_path, capacity, id_col, text_col))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    plan = slack_plan(counts, capacity)
    entries, used, sequence = [], dict.fromkeys(counts, 0), 0
    for bins, combination in plan:
        offset = 0
        for length, times in combination:
            entries.append((length, used[length], times, sequence, offset))
            used[length] += bins * times
            offset += length * times
        sequence += bins
    table = np.array(sorted(entries), np.int64).reshape(-1, 5)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = {length: np.flatnonzero(table[:, 0] == length) for length in counts}
        for pdf in batches:
            row = np.empty(len(pdf), np.int64)
            length, rank = pdf["length"].to_numpy(), pdf["rank"].to_numpy()
            for value in np.unique(length):
                here = length == value
                row[here] = first[value][0] + np.searchsorted(table[first[value], 1], rank[here], "right") - 1
            _, low, times, base, offset = table[row].T
            yield pdf.drop(columns="rank").assign(sequence_id=base + (rank - low) // times, offset=offset + (rank - low) % times * length)

    buckets = int(np.sqrt(max(counts.values(), default=0))) + 1
    salted = pieces.withColumn("hash", F.xxhash64("id", "piece")).withColumn("bucket", F.expr(f"pmod(hash, {buckets})"))
    sums = salted.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = salted.withColumn("within", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("hash", "id", "piece")))
    ranked = ranked.join(sums.select("length", "bucket", before.alias("before")), ["length", "bucket"])
    kind = docs.schema[id_col].dataType.simpleString()
    placed = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("within") - 1).alias("rank")).mapInPandas(
        place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
    return placed.withColumnRenamed("id", id_col)
