"""Exact deduplication by distributed MSD radix partitioning.

Documents are split by the length of their normalised text and then by its successive bytes, most
significant first. A round takes one digit (a slice of bytes, four times as wide as the last) of the
documents that still share a group, and splits each group by it. A document leaves when it is alone
or when its bytes have ended; those that end in one group are equal byte by byte, without a digest.
A group is only ever counted, with partial counts before the shuffle, and joined back to its
members, so that no task holds a whole group. Those joins are shuffled, hashed on the side of the
groups, so that texts are not sorted and adaptive execution can split the partition of a large group;
the last, to the row that stays, broadcasts it for the few largest groups.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkintel.llm.rows import deal_out, join_skewed, keyed
from sparkintel.llm.staging import Staged

#: The deleted characters, \x20 and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"
FIRST_DIGIT = 48
GROWTH = 4


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_digit: int = FIRST_DIGIT) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty, and all empty texts are one group. The row with the most code points in
    the original text stays, then the smallest id (a null id comes last); of rows that agree in both,
    one stays. Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    staged = Staged(spark, "exact-dedup")
    norm = normalised(docs[text_col])
    base = docs.select(docs[id_col].alias("id"), F.length(F.coalesce(docs[text_col], F.lit(""))).alias("points"), norm.alias("norm")).select(
        "id", "points", "norm", F.octet_length("norm").alias("size"), F.substring(F.col("norm").cast("binary"), 1, first_digit).alias("digit")
    )
    groups = _shared(base.groupBy("size", "digit"), staged)
    rows = base.join(groups.hint("shuffle_hash"), ["size", "digit"], "left")
    going_on = F.col("cell").isNotNull() & (F.col("size") > first_digit)
    rows = rows.select(
        F.monotonically_increasing_id().alias("uid"), "id", "points", F.sha2("norm", 256).alias("sha"), "size", F.lit(0).alias("round"), "cell",
        F.when(going_on, F.expr(f"substring(cast(norm AS binary), {first_digit + 1})")).alias("rest"), going_on.alias("open"),
    )
    table = staged.write(rows, "open")
    closed, done, width, number = [table.where(~F.col("open"))], first_digit, first_digit, 0
    while not (active := table.where("open")).isEmpty():
        number, width = number + 1, width * GROWTH
        split = active.select("uid", "id", "points", "sha", "size", "cell", F.expr(f"substring(rest, 1, {width})").alias("digit"), F.expr(f"substring(rest, {width + 1})").alias("rest")).withColumnRenamed("cell", "parent")
        groups = _shared(split.groupBy("parent", "digit"), staged)
        done += width
        going_on = F.col("cell").isNotNull() & (F.col("size") > done)
        table = staged.write(
            split.join(groups.hint("shuffle_hash"), ["parent", "digit"], "left").select(
                "uid", "id", "points", "sha", "size", F.lit(number).alias("round"), "cell", F.when(going_on, F.col("rest")).alias("rest"), going_on.alias("open")
            ),
            "open",
        )
        closed.append(table.where(~F.col("open")))
    ended = reduce(DataFrame.unionByName, closed).drop("rest", "open", "size")
    best = F.struct((-F.col("points")).alias("fewer"), F.col("id").isNull().alias("unnamed"), "id", "uid")
    stays = staged.write(ended.where("cell IS NOT NULL").groupBy("round", "cell").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("n")))
    sizes = stays.select("round", "cell", F.col("n").alias("rows_of_key"))
    return join_skewed(ended, stays, "round", "cell", sizes=sizes).select(
        F.col("id").alias(id_col),
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("best.uid") == F.col("uid"), F.lit(True)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def _shared(grouped, staged: Staged) -> DataFrame:
    """The groups of two or more, each with a number of its own, fixed by being written."""
    counted = grouped.agg(F.count(F.lit(1)).alias("members")).where("members > 1").drop("members")
    return staged.write(counted.withColumn("cell", F.monotonically_increasing_id()))


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the columns of docs."""
    kept = exact_dedup(keyed(docs, id_col, text_col), "doc_row", "text").where("kept")
    return deal_out(docs, kept.select("doc_row", F.lit(1).alias("times")), id_col, text_col)
