"""Rows of a table named by their id and text, and dealt out by name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_key(doc_id: Column, text: Column) -> Column:
    """Names a row: orders by id, nulls last; two hashes stand for the text, so that ids may repeat."""
    return F.struct(doc_id.isNull().alias("unnamed"), doc_id.alias("id"), F.xxhash64(text, F.lit(1)).alias("hash"), F.xxhash64(text, F.lit(2)).alias("again"))


def keyed(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """doc_row, text, and other columns by name."""
    return docs.select(row_key(docs[id_col], docs[text_col]).alias("doc_row"), docs[text_col].alias("text"), *[docs[c].alias(c) for c in more])


def deal_out(docs: DataFrame, times: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs as often as `times` (doc_row, times) says, with the columns of docs.

    What is said of a name is shared among the rows that bear it; names that are not there get nothing.
    Only rows that agree in id and text meet in one task.
    """
    marked = docs.select(row_key(docs[id_col], docs[text_col]).alias("doc_row"), F.struct(*[docs[c] for c in docs.columns]).alias("doc"))
    same = Window.partitionBy("doc_row")
    shared = marked.join(times, "doc_row").select("doc", "times", F.row_number().over(same.orderBy(F.lit(0))).alias("place"), F.count(F.lit(1)).over(same).alias("rows"))
    copies = F.floor(F.col("times") / F.col("rows")) + F.when(F.col("place") <= F.col("times") % F.col("rows"), 1).otherwise(0)
    dealt = shared.select("doc", copies.cast("int").alias("copies")).where("copies > 0")
    return dealt.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("doc.*")


def join_skewed(rows: DataFrame, facts: DataFrame, *keys: str, heavy: int = 256, sizes: DataFrame | None = None) -> DataFrame:
    """rows with the columns of facts, which has one row a key at most; a left join that no single key makes a single task.

    Keys with more than one of `heavy` equal parts of all rows are fewer than `heavy`, so that their facts
    are broadcast to rows that stay where they are, as do rows of null keys, which have no facts; the
    others are shuffled.
    sizes: keys and rows_of_key, where they are known already.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_of_key")) if sizes is None else sizes
    least = max(1, (rows.count() + heavy - 1) // heavy)
    hot = counts.where(F.col("rows_of_key") > least).select(*keys)
    marked = rows.join(F.broadcast(hot.withColumn("hot_key", F.lit(True))), list(keys), "left")
    few = facts.join(F.broadcast(hot), list(keys), "left_semi")
    stay = F.col("hot_key").isNotNull() | reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    one = marked.where(stay).drop("hot_key").join(F.broadcast(few), list(keys), "left")
    rest = marked.where(~stay).drop("hot_key").join(facts.hint("shuffle_hash"), list(keys), "left")
    return one.unionByName(rest)
