"""Near-duplicate groups: an exact Jaccard join on word shingles by grouped prefixes.

1.  Every text becomes its set of shingle hashes. Texts of one set are one node.
2.  Under the order of the hashes, two sets that link share at least ceil(t n) - n + p of the first p
    of n shingles. So each set's first p (a little more than the usual prefix) are dealt out by hash,
    each batch sending a shingle once, and only texts that share enough of them with others go on.
3.  For those, shingles that no other node has are dropped; a node that keeps less than t of its set
    links with nothing.
4.  Nodes of one minhash are held against the best of them, in a few rounds, and links found join
    components. This is a shortcut that leaves large groups of near copies as one component each.
5.  The grouped prefix join finds the links that are left, which can only lie between components.
    Shingles are ordered by the number of components that have them; those of one component alone
    come first and match nothing, so that nodes whose set is theirs drop out. Nodes of one prefix and
    one size are a group. Groups that share a prefix shingle and are of sizes near each other pass the size and position filters and
    are then expanded, and members of different components verified.

No list of a shingle is gathered: shared shingles are counted, pairs come from joins of filtered
prefixes. Components take the links of 4 and 5 together.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sparkintel.llm.components import connected_components
from sparkintel.llm.rows import deal_out, join_skewed, keyed
from sparkintel.llm.staging import Staged, batches_of
from sparkintel.llm.words import LOWER, mix, shingle_sets, text_groups

SHINGLE = 5
NUMERATOR, DENOMINATOR = 75, 100
SLACK = 0.1
KEYS, ROUNDS, BUCKETS = 4, 2, 4
_MANY = 0xFFFF


def _least(n):
    """The smallest overlap of a set of n with any that it links with: at least t of the larger."""
    return -(-NUMERATOR * n // DENOMINATOR)


def _digests(id_type: pa.DataType, buckets: int):
    """Arrow batches of (id, text) to rows of documents and rows of dealt shingles."""
    schema = pa.schema([("kind", pa.int32()), ("id", id_type), ("n", pa.int32()), ("sig", pa.binary()), ("doc", pa.int64()), ("near", pa.int32()), ("bucket", pa.int32()), ("tokens", pa.binary()), ("docs", pa.binary())])
    edges = np.array([(k << 48) // buckets for k in range(1, buckets)], np.uint64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() << 24) - 1
        for whole in batches:
            for batch in (whole.slice(at, 50_000) for at in range(0, whole.num_rows, 50_000)):
                number += 1
                sizes, sigs, tokens, docs = [], [], [], []
                for row, data, starts in text_groups(batch.column(1)):
                    for k, own in enumerate(shingle_sets(LOWER[data], starts, SHINGLE)):
                        n = len(own)
                        sizes.append(n)
                        sigs.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                        p = n - _least(n) + max(1, int(np.ceil(SLACK * n))) if n else 0
                        tokens.append(own[:p] >> np.uint64(16))
                        docs.append(np.full(len(tokens[-1]), row + k, np.uint16))
                rows, base = len(sizes), number << 16
                token = np.concatenate(tokens) if rows else np.zeros(0, np.uint64)
                doc = np.concatenate(docs) if rows else np.zeros(0, np.uint16)
                order = np.argsort(token, kind="stable")
                token, doc = token[order], doc[order]
                new = np.r_[True, token[1:] != token[:-1]] if len(token) else np.zeros(0, bool)
                single = new & np.r_[new[1:], True] if len(token) else new
                near = np.bincount(doc[~single], minlength=rows).astype(np.int32)
                token, doc = token[new], np.where(single, doc, _MANY)[new].astype("<u2")
                cuts = np.r_[0, np.searchsorted(token, edges), len(token)]
                parts = [(k, a, b) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
                six = np.ascontiguousarray(token.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6]
                none = [None] * len(parts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([0] * rows + [1] * len(parts), pa.int32()), pa.concat_arrays([batch.column(0), pa.nulls(len(parts), id_type)]), pa.array(sizes + none, pa.int32()), pa.array(sigs + none, pa.binary()),
                        pa.array([*range(base, base + rows), *[base] * len(parts)], pa.int64()), pa.array([*near.tolist(), *none], pa.int32()), pa.array([None] * rows + [k for k, _, _ in parts], pa.int32()),
                        pa.array([None] * rows + [six[a:b].tobytes() for _, a, b in parts], pa.binary()), pa.array([None] * rows + [doc[a:b].tobytes() for _, a, b in parts], pa.binary()),
                    ],
                    schema=schema,
                )

    return work


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of a document's dealt shingles other batches have too: a row for each batch of documents and bucket.

    Rows come in order of bucket; one bucket is held at once.
    """
    tokens, docs, bucket = [], [], None
    for batch in batches:
        for base, six, doc, own_bucket in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if own_bucket != bucket and tokens:
                yield from _met(tokens, docs)
                tokens, docs = [], []
            bucket = own_bucket
            wide = np.zeros((len(six) // 6, 8), np.uint8)
            wide[:, :6] = np.frombuffer(six, np.uint8).reshape(-1, 6)
            own = np.frombuffer(doc, "<u2").astype(np.int64)
            tokens.append(wide.view("<u8").ravel())
            docs.append(np.where(own == _MANY, -1, base + own))
    if tokens:
        yield from _met(tokens, docs)


def _met(tokens: list[np.ndarray], docs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    token, doc = np.concatenate(tokens), np.concatenate(docs)
    order = np.argsort(token)
    token, doc = token[order], doc[order]
    new = np.r_[True, token[1:] != token[:-1]]
    run = np.cumsum(new) - 1
    shared = np.bincount(run, np.where(doc < 0, 2, 1)) >= 2
    found, times = np.unique(doc[shared[run] & (doc >= 0)], return_counts=True)
    if not len(found):
        return
    base, first = np.unique(found >> 16, return_index=True)
    ends = [*first[1:].tolist(), len(found)]
    parts = [((found[a:b] & 0xFFFF).astype("<u2").tobytes(), times[a:b].astype("<u4").tobytes()) for a, b in zip(first.tolist(), ends, strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(base << 16), pa.array([d for d, _ in parts], pa.binary()), pa.array([t for _, t in parts], pa.binary())], names=["base", "docs", "times"])


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums what _meet has counted, for each batch of documents in turn: rows come in their order."""
    met, base = np.zeros(_MANY, np.int64), None

    def told() -> pa.RecordBatch:
        found = np.flatnonzero(met)
        return pa.RecordBatch.from_arrays([pa.array(base + found), pa.array(met[found])], names=["doc", "met"])

    for batch in batches:
        for own_base, docs, times in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if own_base != base and base is not None:
                yield told()
                met[:] = 0
            base = own_base
            np.add.at(met, np.frombuffer(docs, "<u2"), np.frombuffer(times, "<u4"))
    if base is not None:
        yield told()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, data, starts in text_groups(batch.column(0), 1 << 22):
            own = [x for x in shingle_sets(LOWER[data], starts, SHINGLE) if len(x)]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in own])].astype(np.int32)), pa.array(np.concatenate(own).view(np.int64) if own else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in own], pa.binary()), lists], names=["sig", "tokens"])


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _minhashes(seed: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _lists(batch.column(1))
            keys = [[int(mix(x.view(np.uint64) + np.uint64((seed + k) * 0x632BE59BD9B4E019 % (1 << 64))).view(np.int64).min()) for k in range(KEYS)] for x in own]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column(0).to_numpy(), KEYS)), pa.array(np.tile(np.arange(KEYS, dtype=np.int32), len(own))), pa.array([k for row in keys for k in row], pa.int64())], names=["node", "k", "key"]
            )

    return work


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with their sizes and shared shingles, those that link."""
    for batch in batches:
        left, right = _lists(batch.column("x")), _lists(batch.column("y"))
        sizes = batch.column("n").to_numpy().astype(np.int64) + batch.column("m").to_numpy()
        both = np.array([np.intersect1d(x, y, assume_unique=True).size for x, y in zip(left, right, strict=True)], np.int64)
        good = pa.array(DENOMINATOR * both >= NUMERATOR * (sizes - both))
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], names=["a", "b"])


def _linked(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that link; nodes: node, n, tokens."""
    left = nodes.select(F.col("node").alias("a"), "n", F.col("tokens").alias("x"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("tokens").alias("y"))
    near = (F.least("n", "m") * DENOMINATOR >= F.greatest("n", "m") * NUMERATOR)
    joined = pairs.join(left.hint("shuffle_hash"), "a").join(right.hint("shuffle_hash"), "b").where(near)
    return joined.select("a", "b", "n", "m", "x", "y").mapInArrow(_verify, "a long, b long")


def _survivors(docs: DataFrame, staged: Staged) -> tuple[DataFrame, DataFrame]:
    """All documents (id, n, sig, doc), and those of them that share enough to link with another."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = partitions * BUCKETS  # ranges of hashes, of which a task holds one at once
    id_field = docs.schema["id"]
    kind = id_field.dataType.simpleString()
    dealt = staged.write(docs.mapInArrow(_digests(to_arrow_type(id_field.dataType), buckets), f"kind int, id {kind}, n int, sig binary, doc long, near int, bucket int, tokens binary, docs binary"), "kind")
    rows = dealt.where("kind = 0").select("id", "n", "sig", "doc", "near")
    met = dealt.where("kind = 1").select("doc", "tokens", "docs", "bucket").repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(_meet, "base long, docs binary, times binary")
    counts = met.repartition(partitions, "base").sortWithinPartitions("base").mapInArrow(_total, "doc long, met long")
    needed = F.greatest(F.lit(1), F.ceil(F.lit(SLACK) * F.col("n")))
    some = rows.join(counts, "doc", "left").where((F.col("n") > 0) & (F.col("near") + F.coalesce("met", F.lit(0)) >= needed))
    return rows.select("id", "n", "sig"), some.select("id", "n", "sig")


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id, n_links.

    Null texts and texts without words have an empty set and link with nothing. Texts of one set are in
    one component whatever their ids, repeated rows too. component_id is the smallest id of the
    component (nulls aside); n_links is the number of links found from the row's set to others, which
    join the component. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    staged = Staged(spark, "near-dedup")
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    rows, some = _survivors(texts, staged)
    chosen = staged.write(some.groupBy("sig").agg(F.min("id").alias("one")).select(F.col("one").alias("one")).distinct())
    staged.drop(1, "kind=1")  # the dealt shingles have been met
    with batches_of(spark, 2000):
        own = texts.join(chosen.hint("shuffle_hash"), texts["id"].eqNullSafe(chosen["one"]), "left_semi").select("text").mapInArrow(_sets, "sig binary, tokens array<long>")
        sets = staged.write(own.dropDuplicates(["sig"]).withColumn("node", F.monotonically_increasing_id()).withColumn("n", F.size("tokens")))
        tokens = sets.select("node", F.explode("tokens").alias("token"))
        shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("having")).where("having > 1")
        kept = tokens.join(shared.select("token").hint("shuffle_hash"), "token", "left_semi").groupBy("node").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
        least = F.ceil(F.col("n") * NUMERATOR / DENOMINATOR)
        nodes = staged.write(kept.join(sets.select("node", "n"), "node").where(F.size("tokens") >= least))

        links: list[DataFrame] = []
        comps = None
        for turn in range(ROUNDS):
            keys = staged.write(nodes.select("node", "tokens").mapInArrow(_minhashes(1 + turn * KEYS), "node long, k int, key long").join(nodes.select("node", (F.size("tokens") / F.col("n")).alias("share")), "node"))
            best = staged.write(keys.groupBy("k", "key").agg(F.max(F.struct("share", (-F.col("node")).alias("less"))).alias("best"), F.count(F.lit(1)).alias("rows_of_key")).where("rows_of_key > 1").select("k", "key", (-F.col("best.less")).alias("b"), "rows_of_key"))
            met = join_skewed(keys.select(F.col("node").alias("a"), "k", "key"), best.drop("rows_of_key"), "k", "key", sizes=best.select("k", "key", "rows_of_key"))
            pairs = met.where("a <> b").select("a", "b").distinct()
            links.append(staged.write(_linked(_across(pairs, comps), nodes)))
            comps = connected_components(reduce(DataFrame.union, links), staged)
        links.append(staged.write(_linked(_prefix_pairs(nodes, comps, staged), nodes)))
        every = staged.write(reduce(DataFrame.union, links).distinct())
        comps = connected_components(every, staged)

    degree = every.select(F.col("a").alias("node")).union(every.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    named = sets.select("sig", "node").join(comps, "node").join(degree, "node", "left").select("sig", "comp", "links")
    smallest = rows.where("n > 0").groupBy("sig").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("rows_of_sig"))
    placed = staged.write(smallest.join(named, "sig", "left"))
    of_comp = staged.write(placed.where("comp IS NOT NULL").groupBy("comp").agg(F.min("low").alias("lowest"), F.count(F.lit(1)).alias("rows_of_key")))
    final = join_skewed(placed, of_comp.drop("rows_of_key"), "comp", sizes=of_comp.select("comp", "rows_of_key")).select("sig", F.coalesce("lowest", "low").alias("component"), "links", "rows_of_sig")
    final = staged.write(final)
    named_rows = rows.withColumn("sig", F.when(F.col("n") > 0, F.col("sig")))  # empty sets are no group
    return join_skewed(named_rows, final.drop("rows_of_sig"), "sig", sizes=final.select("sig", F.col("rows_of_sig").alias("rows_of_key"))).select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"), F.when(F.col("n") > 0, F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
    )


def _across(pairs: DataFrame, comps: DataFrame | None) -> DataFrame:
    """The pairs (a, b) whose nodes are not in one component."""
    if comps is None:
        return pairs
    left, right = comps.select(F.col("node").alias("a"), F.col("comp").alias("c")), comps.select(F.col("node").alias("b"), F.col("comp").alias("d"))
    both = pairs.join(left, "a", "left").join(right, "b", "left")
    return both.where(F.coalesce("c", "a") != F.coalesce("d", "b")).select("a", "b")


def _prefix_pairs(nodes: DataFrame, comps: DataFrame, staged: Staged) -> DataFrame:
    """Pairs of nodes of different components that may link, by the grouped prefix join."""
    members = nodes.join(comps, "node", "left").select("node", "n", F.coalesce("comp", "node").alias("comp"), "tokens")
    spread = members.select("node", "n", "comp", F.explode("tokens").alias("token"))
    having = spread.groupBy("token", "comp").agg(F.lit(1).alias("one")).groupBy("token").agg(F.count(F.lit(1)).alias("comps")).where("comps > 1")
    open_tokens = spread.join(having.hint("shuffle_hash"), "token").groupBy("node", "n", "comp").agg(F.sort_array(F.collect_list(F.struct("comps", "token"))).alias("ordered"))
    least = F.ceil(F.col("n") * NUMERATOR / DENOMINATOR)
    # What is not in `ordered` comes first in the order, so that the prefix has so much less of it.
    taken = F.col("n") - least + 1 - (F.col("n") - F.size("ordered"))
    prefixes = open_tokens.where(taken > 0).select("node", "n", "comp", (F.col("n") - F.size("ordered")).alias("alone"), F.slice(F.transform("ordered", lambda t: t["token"]), F.lit(1), taken.cast("int")).alias("prefix"))
    prefixes = staged.write(prefixes)
    groups = staged.write(
        prefixes.groupBy("prefix", "n").agg(F.min("alone").alias("alone"), F.min("comp").alias("low"), F.max("comp").alias("high")).withColumn("cell", F.monotonically_increasing_id())
    )
    in_group = staged.write(prefixes.join(groups.select("prefix", "n", "cell").hint("shuffle_hash"), ["prefix", "n"]).select("cell", "node", "comp"))
    # Sizes that can link differ by a third at most, so that a shingle's groups meet by bands of such sizes: each with its own and with the next.
    band = F.floor(F.log("n") / math.log(1.000001 * DENOMINATOR / NUMERATOR)).cast("int")
    posted = groups.select("cell", "n", "alone", "low", "high", band.alias("band"), F.posexplode("prefix").alias("place", "token"))
    facts = ("cell", "n", "alone", "place", "low", "high")
    left = posted.select("token", "band", *[F.col(c).alias(f"{c}_1") for c in facts])
    right = posted.select("token", F.explode(F.array("band", F.col("band") - 1)).alias("band"), *[F.col(c).alias(f"{c}_2") for c in facts])
    room = F.least(F.col("n_1") - F.col("alone_1") - F.col("place_1"), F.col("n_2") - F.col("alone_2") - F.col("place_2"))
    overlap = NUMERATOR * (F.col("n_1") + F.col("n_2")) <= (NUMERATOR + DENOMINATOR) * room
    apart = ~((F.col("low_1") == F.col("high_1")) & (F.col("low_2") == F.col("high_2")) & (F.col("low_1") == F.col("low_2")))
    turn = (F.col("n_1") < F.col("n_2")) | ((F.col("n_1") == F.col("n_2")) & (F.col("cell_1") <= F.col("cell_2")))
    sized = F.col("n_1") * DENOMINATOR >= F.col("n_2") * NUMERATOR
    cells = left.join(right, ["token", "band"]).where(turn & sized & overlap & apart).select("cell_1", "cell_2").distinct()
    first = in_group.select(F.col("cell").alias("cell_1"), F.col("node").alias("a"), F.col("comp").alias("c"))
    second = in_group.select(F.col("cell").alias("cell_2"), F.col("node").alias("b"), F.col("comp").alias("d"))
    pairs = cells.join(first, "cell_1").join(second, "cell_2").where((F.col("c") != F.col("d")) & ((F.col("cell_1") != F.col("cell_2")) | (F.col("a") < F.col("b"))))
    return staged.write(pairs.select("a", "b").distinct())


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay when each component keeps one row, that of its smallest id; columns of docs.

    Rows of an empty set all stay.
    """
    found = near_duplicate_components(keyed(docs, id_col, text_col), "doc_row", "text")
    stay = found.where((F.col("n_shingles") == 0) | (F.col("component_id") == F.col("doc_row")))
    times = stay.groupBy("doc_row").agg(F.when(F.max("n_shingles") == 0, F.count(F.lit(1))).otherwise(1).alias("times"))
    return deal_out(docs, times, id_col, text_col)
