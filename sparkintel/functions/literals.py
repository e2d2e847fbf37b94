"""Very many literals in very many texts, in one pass: an Aho-Corasick automaton over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters of literals that one automaton holds; a larger set takes as many passes as it fills automatons.
PART_CHARS = 1 << 20
#: Texts that are taken from a batch at once.
_SLICE = 64


def parts_of(literals: list[str], most: int = PART_CHARS) -> list[list[str]]:
    """The literals in parts of so many characters, or of one longer literal."""
    parts: list[list[str]] = []
    room = 0
    for literal in literals:
        if not parts or len(literal) > room:
            parts.append([])
            room = most
        parts[-1].append(literal)
        room -= len(literal)
    return parts


def _finder(key: str, literals: list[str]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for place, literal in enumerate(literals):
            automaton.add_word(literal, place)
        automaton.make_automaton()
        lengths = [len(literal) for literal in literals]
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                some = batch.slice(at, _SLICE)
                rows: list[int] = []
                places: list[int] = []
                offsets: list[int] = []
                times: list[int] = []
                for row, text in enumerate(some.column(1).to_pylist()):
                    found: dict[int, list[int]] = {}
                    for end, place in automaton.iter(text or ""):
                        if place in found:
                            found[place][1] += 1
                        else:
                            found[place] = [end - lengths[place] + 1, 1]
                    for place, (offset, n) in found.items():
                        rows.append(row)
                        places.append(place)
                        offsets.append(offset)
                        times.append(n)
                if rows:
                    keys = some.column(0).take(pa.array(rows, pa.int64()))
                    yield pa.RecordBatch.from_arrays([keys, pa.array([literals[p] for p in places]), pa.array(offsets, pa.int64()), pa.array(times, pa.int64())], names=[key, "pattern", "offset", "times"])

    return work


def find_literals(files: DataFrame, key: str, text: str, literals: list[str], most: int = PART_CHARS) -> DataFrame:
    """key, pattern, offset (of the first, in characters) and times (overlapping ones counted) of each literal that a text holds.

    Literals are distinct and not empty; null texts hold none. Each part of the literals is one pass over
    the texts, which stay where they are, and whatever a set's size, a task holds one automaton.
    """
    schema = f"`{key}` {files.schema[key].dataType.simpleString()}, pattern string, offset long, times long"
    rows = files.select(key, text)
    out = rows.where("false").selectExpr(f"`{key}`", "'' AS pattern", "0L AS offset", "0L AS times")
    for part in parts_of(literals, most):
        out = out.union(rows.mapInArrow(_finder(key, part), schema))
    return out
