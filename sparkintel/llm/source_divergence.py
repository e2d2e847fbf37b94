"""How far the sources of a language differ in their words, by count-level bitmaps.

The share of a term in a group depends on nothing but how often it occurs there. So the terms of a group
are kept as one bitmap for each count that occurs: (group, count) to a set of term numbers, as 64-bit
words. For two groups, AND and a population count of each pair of such bitmaps give the cells of their
joint table (how many terms occur a times here and b times there), and each cell is multiplied by the
distance of the two shares. Terms that do not occur in a group are what its bitmaps leave over.

Terms are numbered from frequent to rare, so that a word of rare terms has few levels. A task holds the
bitmaps of at most BLOCK_WORDS words for two blocks of at most SOURCE_BLOCK sources, whatever the table's size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkintel.llm.staging import Staged

LEAST_DOCS = 30
TOP_TERMS = 50
SCALE = 1_000_000_000
SMOOTHING = 5
#: A word holds 64 term numbers.
BLOCK_WORDS = 64
SOURCE_BLOCK = 64
#: Cells that are held at once in a task.
_CELLS = 1 << 21
#: Entries (terms of groups) that a task counts before it passes them on.
HELD = 200_000
_SLICE = 1 << 20
#: Bytes of terms in lower case; all others are blanks.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _slices(text: bytes) -> Iterator[bytes]:
    """The text in pieces of about _SLICE bytes, cut at blanks."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + _SLICE) if at + _SLICE < len(text) else -1
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def _counts(most: int):
    """lang, source, term, n, docs: partial counts, passed on when more than `most` are held; the empty term counts the documents of a group."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter[bytes], Counter[bytes]]] = {}
        entries = 0

        def passed_on() -> pa.RecordBatch:
            keys = [(lang, source, len(n)) for (lang, source), (n, _) in held.items()]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([x for lang, _, size in keys for x in repeat(lang, size)], pa.string()),
                    pa.array([x for _, source, size in keys for x in repeat(source, size)], pa.string()),
                    pa.array([t for n, _ in held.values() for t in n], pa.binary()),
                    pa.array([k for n, _ in held.values() for k in n.values()], pa.int64()),
                    pa.array([d[t] for n, d in held.values() for t in n], pa.int64()),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )

        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang, source, cell in zip(langs, sources, batch.column(2), strict=True):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                before, seen = len(n), set()
                for piece in _slices((cell.as_py() or b"").translate(_TERM_BYTES)):
                    words = piece.split()
                    seen.update(words)
                    n.update(words)
                docs.update(seen)
                n[b""] += 1
                entries += len(n) - before
                if entries > most:
                    yield passed_on()
                    held, entries = {}, 0
        if held:
            yield passed_on()

    return work


def _share(count: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (count + SMOOTHING) / (total + SMOOTHING * kept)), exact beyond 64 bits."""
    above = f"CAST({count} + {SMOOTHING} AS DECIMAL(20, 0)) * CAST({SCALE} AS DECIMAL(10, 0))"
    return F.expr(f"1 + ({above}) div CAST({total} + {SMOOTHING} * {kept} AS DECIMAL(20, 0))")


def joint_distance(full: np.ndarray, left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...]) -> np.ndarray:
    """Sum of |p - q| over the terms of each word and pair of groups, as a matrix of left by right groups.

    full: the terms of each word. A side is (word, group, share, bits) of its levels, by word and group,
    with a level of bits 0 for what does not occur; and how many groups it has.
    """
    sides = []
    for word, group, share, bits, n_groups in (left, right):
        # What no level of a group holds in a word is its level of count zero.
        cells = word * n_groups + group
        firsts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
        absent = full[word[firsts]] & ~np.bitwise_or.reduceat(bits, firsts)
        blank = np.zeros(len(bits), bool)
        blank[firsts] = True  # the level of count zero sorts first
        sides.append((word, group, share, np.where(blank, np.repeat(absent, np.diff(np.r_[firsts, len(cells)])), bits), n_groups))
    (wa, ga, pa_, ba, na), (wb, gb, pb, bb, nb) = sides
    out = np.zeros((na, nb), np.int64)
    for word in range(len(full)):
        a, b = slice(*np.searchsorted(wa, [word, word + 1])), slice(*np.searchsorted(wb, [word, word + 1]))
        inner = np.flatnonzero(np.r_[True, gb[b][1:] != gb[b][:-1]])
        step = max(1, _CELLS // (b.stop - b.start))
        for i in range(a.start, a.stop, step):
            rows = slice(i, min(i + step, a.stop))
            cells = np.bitwise_count(ba[rows, None] & bb[None, b]).astype(np.int64)
            cells *= np.abs(pa_[rows, None] - pb[None, b])
            np.add.at(out, ga[rows], np.add.reduceat(cells, inner, axis=1))
    return out


def _block(source_block: int):
    """Distances of the sources of one pair of source blocks over one block of terms.

    rows: levels (number: the source's, word, share, bits), one row of word -1 and share p(0) for each
    source, and the terms of each word under number -1.
    """

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        lang, low, high = rows["lang"].iloc[0], int(rows["low"].iloc[0]), int(rows["high"].iloc[0])
        words = rows[rows["number"] < 0]
        names, at = np.unique(words["word"].to_numpy(), return_inverse=True)
        full = np.zeros(len(names), np.uint64)
        np.bitwise_or.at(full, at, words["bits"].to_numpy().view(np.uint64))
        levels, sides, numbers = rows[rows["number"] >= 0], [], []
        for block in (low, high):
            own = levels[levels["number"] // source_block == block]
            zero = own[own["word"] < 0].sort_values("number")
            number, some = zero["number"].to_numpy(), own[own["word"] >= 0]
            word = np.r_[np.repeat(np.arange(len(names)), len(number)), np.searchsorted(names, some["word"].to_numpy())]
            group = np.r_[np.tile(np.arange(len(number)), len(names)), np.searchsorted(number, some["number"].to_numpy())]
            share = np.r_[np.tile(zero["share"].to_numpy(), len(names)), some["share"].to_numpy()]
            bits = np.r_[np.zeros(len(number) * len(names), np.int64), some["bits"].to_numpy()].view(np.uint64)
            order = np.lexsort((share, group, word))
            sides.append((word[order], group[order], share[order], bits[order], len(number)))
            numbers.append(number)
        found = joint_distance(full, *sides)
        i, j = np.nonzero(numbers[0][:, None] < numbers[1][None, :])
        return pd.DataFrame({"lang": lang, "one": numbers[0][i], "other": numbers[1][j], "part_value": found[i, j]})

    return work


def source_divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS, block_words: int = BLOCK_WORDS, source_block: int = SOURCE_BLOCK, held: int = HELD) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from its others, and its own terms.

    Terms are runs of ASCII letters and of characters beyond ASCII, with only A to Z lower-cased; a
    language keeps those that at least `least_docs` of its rows hold. Null texts, languages and sources
    are read as empty strings, and a repeated row counts again. Part `pair` has all other sources of the
    language; without kept terms their values are 0. Part `term` has the `top_terms` kept terms whose
    share is furthest above the language's. Ranks go by value, falling, then by the item's bytes.
    An empty table gives an empty result, a language of one source no part `pair`.
    """
    spark = docs.sparkSession
    staged = Staged(spark, "source-divergence")
    blank = F.lit("")
    fields = docs.select(F.coalesce(docs[lang_col], blank).alias("lang"), F.coalesce(docs[source_col], blank).alias("source"), docs[text_col].cast("binary").alias("text"))
    counted = fields.mapInArrow(_counts(held), "lang string, source string, term binary, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # Rare terms, which are most, end here: each term meets its sources once, and only kept ones are written.
    of_term = Window.partitionBy("lang", "term")
    counted = counted.withColumn("in_lang", F.sum("n").over(of_term)).withColumn("in_docs", F.sum("docs").over(of_term)).withColumn("term", F.col("term").cast("string"))
    counts = staged.write(counted.where((F.col("term") == "") | (F.col("in_docs") >= least_docs)).select("lang", "source", "term", "n", "in_lang"))
    real = counts.where("term <> ''")

    # Numbered from frequent to rare; the number is fixed by being written.
    kept = real.select("lang", "term", "in_lang").distinct()
    number = F.monotonically_increasing_id()
    terms = staged.write(kept.repartitionByRange("lang", F.desc("in_lang")).sortWithinPartitions("lang", F.desc("in_lang")).withColumn("number", number).withColumn("word", F.expr("shiftright(number, 6)")))
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("in_lang").alias("of_lang"))
    cells = staged.write(real.select("lang", "source", "term", "n").join(terms, ["lang", "term"]))
    sizes = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term = ''").select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept"), "of_lang")
    by_source = Window.partitionBy("lang").orderBy("source")
    groups = staged.write(groups.withColumn("number", (F.row_number().over(by_source) - 1).cast("long")))

    pairs = _pairs(groups, terms, cells, staged, block_words, source_block)
    shares = cells.join(groups.drop("number"), ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), (_share("n", "total", "kept") - _share("in_lang", "of_lang", "kept")).alias("value"))
    ranks = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    own = shares.where("value > 0").withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= top_terms)
    both = pairs.withColumn("rank", F.row_number().over(ranks)).withColumn("part", F.lit("pair")).unionByName(own.withColumn("part", F.lit("term")))
    return both.select(F.col("lang").alias(lang_col), F.col("source").alias(source_col), "part", "item", "value", "rank")


def _pairs(groups: DataFrame, terms: DataFrame, cells: DataFrame, staged: Staged, block_words: int, source_block: int) -> DataFrame:
    """lang, source, item, value for each ordered pair of the sources of a language."""
    facts = groups.where("kept > 0").select("lang", "source", "number", "total", "kept")
    bit = "shiftleft(1L, CAST(number & 63 AS INT))"
    levels = cells.withColumn("bit", F.expr(bit)).groupBy("lang", "source", "word", "n").agg(F.bit_or("bit").alias("bits"))
    bitmaps = staged.write(levels.join(facts, ["lang", "source"]).select("lang", "number", "word", _share("n", "total", "kept").alias("share"), "bits"))
    words = terms.withColumn("bit", F.expr(bit)).groupBy("lang", "word").agg(F.bit_or("bit").alias("bits"))
    block_of = F.floor(F.col("word") / block_words).cast("long")
    blocks = words.select("lang", block_of.alias("block")).distinct()
    # Each block of terms meets each pair of blocks of sources.
    n_sources = facts.groupBy("lang").agg(F.max("number").alias("last"))
    zeros = facts.select("lang", "number", F.lit(-1).cast("long").alias("word"), _share("0", "total", "kept").alias("share"), F.lit(0).cast("long").alias("bits")).join(blocks, "lang")
    own = bitmaps.withColumn("block", block_of).unionByName(zeros).join(n_sources, "lang")
    mine, last = F.floor(F.col("number") / source_block), F.floor(F.col("last") / source_block)
    own = own.withColumn("mine", mine).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    own = own.select("lang", "block", F.least("mine", "with").alias("low"), F.greatest("mine", "with").alias("high"), "number", "word", "share", "bits")
    span = F.sequence(F.lit(0).cast("long"), last.cast("long"))
    whole = words.withColumn("block", block_of).join(n_sources, "lang").withColumn("low", F.explode(span)).withColumn("high", F.explode(F.sequence(F.col("low"), last.cast("long"))))
    whole = whole.select("lang", "block", "low", "high", F.lit(-1).cast("long").alias("number"), "word", F.lit(0).cast("long").alias("share"), "bits")
    parts = own.unionByName(whole).groupBy("lang", "block", "low", "high").applyInPandas(_block(source_block), "lang string, one long, other long, part_value long")
    sums = staged.write(parts.groupBy("lang", "one", "other").agg(F.sum("part_value").alias("value")))
    both = sums.unionByName(sums.select("lang", F.col("other").alias("one"), F.col("one").alias("other"), "value"))
    names = groups.select("lang", "source", "number")
    left, right = names.withColumnRenamed("number", "one"), names.select("lang", F.col("source").alias("item"), F.col("number").alias("other"))
    return left.join(right, "lang").where("one <> other").join(both, ["lang", "one", "other"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
