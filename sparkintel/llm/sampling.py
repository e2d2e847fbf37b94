"""Bounded samples that are the same whatever the partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lowest_hashes(rows: DataFrame, column: str, most: int, *ties: str, distinct: bool = False) -> DataFrame:
    """At most `most` rows, those of the lowest hashes in a column of 64 bits; equal rows once if asked.

    Rows are first cut at a hash below which about one and a half times as many lie, so that what is
    sorted is of the size of the sample and not of the table's partitions. Equal rows are made one before
    they are counted, and the cut is widened until enough of them lie below it.
    """
    if distinct:
        rows = rows.distinct()
    n, wide = rows.count(), 1.5
    while n > 2 * most:
        below = rows.where(F.col(column) <= F.lit(_cut(wide * most / n)))
        if not distinct or wide * most >= n or below.count() >= most:
            rows = below
            break
        wide *= 4
    return rows.orderBy(column, *ties).limit(most)


def _cut(share: float) -> int:
    """The hash below which about a share of all hashes lies."""
    return int(min(2**63 - 1, -(2**63) + 2**64 * share))


def even_shares(counts: dict[str, int], most: int) -> dict[str, int]:
    """How many of each label to take: `most` in all, dealt evenly, what the rare ones lack going to the others; one of each at least."""
    shares, left = {}, most
    for k, (label, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        shares[label] = min(n, max(1, left // (len(counts) - k)))
        left -= shares[label]
    return shares


def lowest_of_labels(rows: DataFrame, column: str, label: str, most: int) -> dict[str, int]:
    """For each label the greatest hash to take, so that its distinct hashes up to it are its even share of `most`.

    The driver sees the counts by label and about one and a half times the sample of hashes.
    """
    pairs = rows.select(column, label)
    counts = {r[label]: r["n"] for r in pairs.distinct().groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    shares, edges, wide = even_shares(counts, most), {}, 1.5
    while open_labels := sorted(counts.keys() - edges.keys()):
        cuts = rows.sparkSession.createDataFrame([(v, _cut((wide * shares[v] + 10) / counts[v])) for v in open_labels], f"{label} string, cut long")
        found: dict[str, list[int]] = {v: [] for v in open_labels}
        for r in pairs.join(F.broadcast(cuts), label).where(F.col(column) <= F.col("cut")).select(column, label).distinct().collect():
            found[r[label]].append(r[column])
        edges |= {v: sorted(hashes)[shares[v] - 1] for v, hashes in found.items() if len(hashes) >= shares[v]}
        wide *= 4
    return edges
