"""Fingerprints of whole texts by context-triggered piecewise hashing, and how alike two are.

A rolling hash over the last WINDOW bytes ends a chunk where its low `level` bits are zero, so that the
places of chunks depend on the text around them alone, and those of a level are among those of the level
below. A text takes the lowest level of at most MOST_CHUNKS chunks, and the fingerprint
`level:signature:signature` holds one unit (two characters) for each chunk of that level and of the next.
A unit hashes its chunk and the WINDOW - 1 bytes before it, so that what has changed shows up to its
chunk's end and nowhere after. Fingerprints are compared at the levels that both have, by the edit
distance of their units, for very many pairs at once.

To meet its successor, each row is dealt by ranges of ids and read in order; only the first and the last
text of each range travel once more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkintel.llm.staging import Staged
from sparkintel.llm.words import mix

WINDOW = 7
MOST_CHUNKS = 64
UNIT = 2
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_UNITS = [a + b for a in _ALPHABET for b in _ALPHABET]
#: The level of a text's end, above all others.
_TOP = 64
_SEGMENT = 1 << 18
#: Chunk ends that are held while a text is read; above that, the lowest level goes.
_HELD = 1 << 14
_PAIRS = 2048
_U = np.uint64
_ROLL = [pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WINDOW)]
_BASE = 0xC2B2AE3D27D4EB4F
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = np.cumprod(np.r_[_U(1), np.full(_SEGMENT, _BASE, _U)])
_INVERSES = np.cumprod(np.r_[_U(1), np.full(_SEGMENT, _INVERSE, _U)])


def chunk_ends(text: bytes) -> tuple[int, tuple[np.ndarray, ...]]:
    """The lowest level that may be the text's, and the places at which a chunk of it or above may end, with their level, the rolling hash there and the polynomial sum up to there.

    The last place is the end of the text. A long text is read in segments; where very many ends are held, the
    lowest level goes, which has more than MOST_CHUNKS chunks and so is not the fingerprint's.
    """
    data, size, least, count, total = np.frombuffer(text, np.uint8), len(text), 0, 0, _U(0)
    held: list[tuple[np.ndarray, ...]] = []
    for first in range(0, size, _SEGMENT):
        lead = min(first, WINDOW - 1)
        some = data[first - lead : first + _SEGMENT].astype(_U) + _U(1)
        roll = np.zeros(len(some) - lead, _U)
        for back, factor in enumerate(_ROLL):
            shifted = some[max(0, lead - back) : max(0, len(some) - back)] * _U(factor)
            roll[len(roll) - len(shifted) :] += shifted
        roll = mix(roll)
        level = np.bitwise_count((roll & (~roll + _U(1))) - _U(1)).astype(np.int64)
        level[level >= _TOP] = _TOP - 1
        sums = np.cumsum(some[lead:] * _POWERS[: len(roll)] * _U(pow(_BASE, first, 1 << 64))) + total
        if first + len(roll) == size:
            level[-1] = _TOP
        ends = np.flatnonzero(level >= least)
        held.append((first + ends + 1, level[ends], roll[ends], sums[ends]))
        total, count = sums[-1], count + len(ends)
        while count > _HELD and least < _TOP - 1:
            least += 1
            held = [tuple(x[part[1] >= least] for x in part) for part in held]
            count = sum(len(part[0]) for part in held)
    if not held:
        return 0, tuple(np.zeros(0, kind) for kind in (np.int64, np.int64, _U, _U))
    return least, tuple(np.concatenate(x) for x in zip(*held, strict=True))


def fingerprint(text: bytes) -> str:
    """`level:units:units` of a UTF-8 text; an empty text has no units."""
    least, (places, levels, rolls, sums) = chunk_ends(text)
    counts = np.bincount(levels, minlength=_TOP + 1)[::-1].cumsum()[::-1]
    level = least + int(np.argmax(counts[least:] <= MOST_CHUNKS))
    parts = []
    for at in (level, min(level + 1, _TOP)):
        kept = levels >= at
        ends, upto, lead = places[kept], sums[kept], rolls[kept]
        if not len(ends):
            parts.append("")
            continue
        starts, zero = np.r_[0, ends[:-1]], np.zeros(1, _U)
        scale = _INVERSES[starts % _SEGMENT]
        if starts[-1] >= _SEGMENT:
            scale = scale * np.array([pow(_INVERSE, int(k), 1 << 64) for k in starts - starts % _SEGMENT], _U)
        chunks = (upto - np.r_[zero, upto[:-1]]) * scale
        units = mix(chunks + np.r_[zero, lead[:-1]] * _U(_ROLL[1])) & _U(len(_UNITS) - 1)
        parts.append("".join([_UNITS[u] for u in units.tolist()]))
    return f"{level}:{parts[0]}:{parts[1]}"


def _read(prints: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Levels, units (two signatures of MOST_CHUNKS places, 0 where there is none) and lengths."""
    split = [p.split(":", 1) for p in prints]
    levels = np.array([int(s[0]) for s in split], np.int64)
    units, sizes = np.zeros((2, len(prints), MOST_CHUNKS), np.int32), np.zeros((2, len(prints)), np.int64)
    for k, (_, rest) in enumerate(split):
        middle = rest.index(":")
        for side, part in enumerate((rest[:middle], rest[middle + 1 :])):
            raw = np.frombuffer(part.encode(), np.uint8).reshape(-1, UNIT).astype(np.int32)
            units[side, k, : len(raw)] = raw[:, 0] * 256 + raw[:, 1]
            sizes[side, k] = len(raw)
    return levels, units, sizes


def edit_distances(one: np.ndarray, other: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Insertions, deletions and replacements from row to row of two matrices of units, n and m of which count.

    Differences of neighbouring cells are bits, a column of the table one 64-bit word, for all rows at once.
    """
    up, down, score = np.full(len(n), ~_U(0)), np.zeros(len(n), _U), n.astype(np.int64)
    last = _U(1) << np.maximum(n - 1, 0).astype(_U)
    for k in range(int(m.max(initial=0))):
        same = np.packbits(one == other[:, k, None], axis=1, bitorder="little").view(_U)[:, 0]
        cross = same | down
        flat = (((same & up) + up) ^ up) | same
        rise, fall = down | ~(flat | up), up & flat
        live = k < m
        score += np.where(live & (rise & last != 0), 1, 0) - np.where(live & (fall & last != 0), 1, 0)
        rise, fall = rise << _U(1) | _U(1), fall << _U(1)
        up, down = fall | ~(cross | rise), rise & cross
    return np.where(n == 0, m, score)


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """From 0 to 1 for each pair of fingerprints: 1 less the edit distance over the longer's units, at the best level that both have; 0 where they share none."""
    out = np.zeros(len(left))
    for first in range(0, len(left), _PAIRS):
        a, ua, na = _read(left[first : first + _PAIRS])
        b, ub, nb = _read(right[first : first + _PAIRS])
        best = np.zeros(len(a))
        for i in (0, 1):
            for j in (0, 1):
                rows = np.flatnonzero(a + i == b + j)
                if len(rows):
                    n, m = na[i, rows], nb[j, rows]
                    found = 1 - edit_distances(ua[i, rows], ub[j, rows], n, m) / np.maximum(np.maximum(n, m), 1)
                    best[rows] = np.maximum(best[rows], found)
        out[first : first + _PAIRS] = best
    return out


def edited(text: bytes, following: bytes) -> tuple[int, bytes]:
    """The text's code points, and the text with its last third replaced by the first as many (or all) of the following one's."""
    starts = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    n = len(starts)
    cut = n // 3
    if not cut:
        return n, text
    # A code point has at most four bytes, so that those of the first ones lie within so many.
    theirs = np.flatnonzero((np.frombuffer(following[: 4 * cut + 4], np.uint8) & 0xC0) != 0x80)
    return n, text[: starts[n - cut]] + (following if len(theirs) <= cut else following[: theirs[cut]])


_FIELDS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _columns(rows: list[tuple[bytes, str, bytes, str]]) -> list[pa.Array]:
    """The columns of _FIELDS for texts and what follows each, with the fingerprints of both."""
    changed = [edited(text, following) for text, _, following, _ in rows]
    prints = [own if new is text else fingerprint(new) for (text, own, _, _), (_, new) in zip(rows, changed, strict=True)]
    own = [r[1] for r in rows]
    return [
        pa.array([n for n, _ in changed], pa.int64()), pa.array([hashlib.sha256(new).hexdigest() for _, new in changed]),
        pa.array(own, pa.string()), pa.array(prints, pa.string()), pa.array(likeness(own, prints), pa.float64()), pa.array(likeness(own, [r[3] for r in rows]), pa.float64()),
    ]


_NAMES = [f.split()[0] for f in _FIELDS.split(", ")]
#: Bytes of texts that are held at once, and one more text.
_GROUP = 1 << 22


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, list[bytes]]]:
    """Part, ids and texts of all batches in groups of about _GROUP bytes."""
    for batch in batches:
        texts, first, size = [], 0, 0
        for k, cell in enumerate(batch.column("text")):
            texts.append(cell.as_py() or b"")
            size += len(texts[-1])
            if size >= _GROUP or k + 1 == batch.num_rows:
                yield batch.column("part")[0].as_py(), batch.column("id").slice(first, len(texts)), texts
                texts, first, size = [], k + 1, 0


def _seam(kind: int, part: int, place: pa.Array, text: bytes, own: str) -> pa.RecordBatch:
    blank = {"n_chars": pa.int64(), "edited_sha256": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}
    facts = [pa.array([own]) if name == "fingerprint" else pa.nulls(1, blank[name]) for name in _NAMES]
    return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([part], pa.int32()), place, pa.array([text], pa.binary()), *facts], names=["kind", "part", "id", "text", *_NAMES])


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range in order. Kind 0: whole rows; 1 and 2: its first and last row with their texts, whose neighbours are elsewhere."""
    held = None
    for part, ids, texts in _groups(batches):
        prints = [fingerprint(t) for t in texts]
        if held is None:
            yield _seam(1, part, ids.slice(0, 1), texts[0], prints[0])
        else:
            ids, texts, prints = pa.concat_arrays([held[1], ids]), [held[2], *texts], [held[3], *prints]
        n = len(texts) - 1
        if n:
            rows = list(zip(texts[:-1], prints[:-1], texts[1:], prints[1:], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, part, np.int32)), ids.slice(0, n), pa.nulls(n, pa.binary()), *_columns(rows)], names=["kind", "part", "id", "text", *_NAMES])
        held = part, ids.slice(n), texts[-1], prints[-1]
    if held is not None:
        yield _seam(2, *held)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Last rows of ranges with the first of the range that follows."""
    for batch in batches:
        for k in range(batch.num_rows):
            one = [(c[k].as_py()) for c in batch.columns[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), *_columns([tuple(one)])], names=["id", *_NAMES])


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next row is that of the next smaller id, after the last the first, so that a single row follows
    itself; null ids come last, and rows of one id go by a hash of their text. The edited text is the text with
    its last third of code points replaced by as many (or all) of the next text's first. near_edited and
    near_next are the likeness of the row's fingerprint to that of the edited text and of the next row.
    Null texts are empty; empty texts are like each other and like nothing else. Equal texts have equal
    fingerprints. Other columns are ignored, and an empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    staged = Staged(docs.sparkSession, "fingerprints")
    # The last key is for rows that agree in all; which of them comes first changes no row of the result.
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).cast("binary").alias("text")).withColumn("hash", F.xxhash64("text")).withColumn("salt", F.rand(13))
    keys = [F.col("id").desc_nulls_last(), F.col("hash"), F.col("salt")]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select(F.spark_partition_id().alias("part"), "id", "text")
    done = staged.write(dealt.mapInArrow(_in_order, f"kind int, part int, id {kind}, text binary, {_FIELDS}"), "kind")
    firsts, lasts = done.where("kind = 1"), done.where("kind = 2")
    around = Window.orderBy("part")  # one row a range, without its text
    follows = firsts.select("part").withColumn("after", F.lead("part").over(around)).withColumn("first", F.min("part").over(Window.partitionBy()))
    follows = follows.select("part", F.coalesce("after", "first").alias("after"))
    nexts = firsts.select(F.col("part").alias("after"), F.col("text").alias("following"), F.col("fingerprint").alias("next_print"))
    seams = lasts.join(follows, "part").join(nexts, "after").select("id", "text", "fingerprint", "following", "next_print").mapInArrow(_across, f"id {kind}, {_FIELDS}")
    return done.where("kind = 0").select("id", *_NAMES).unionByName(seams).withColumnRenamed("id", id_col)
