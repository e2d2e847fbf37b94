"""Letters of a text by script, as the names of its characters tell.

The classes follow character names and not the script property, which puts some letters elsewhere, so
that no built-in pattern gives them: a table of one class a code point is looked up over Arrow batches.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a letter's name holds, in the order in which it is asked for; the rest is `other`.
NAMED = {
    "hangul": ["HANGUL"], "kana": ["HIRAGANA", "KATAKANA"], "hebrew": ["HEBREW"], "arabic": ["ARABIC"], "devanagari": ["DEVANAGARI"], "cyrillic": ["CYRILLIC"],
    "han": ["CJK UNIFIED IDEOGRAPH", "CJK COMPATIBILITY IDEOGRAPH"], "latin": ["LATIN"],
}
SCRIPTS = [*NAMED, "other"]


@functools.cache
def class_table() -> np.ndarray:
    """The class of each code point: 0 for what is no letter, else its place in SCRIPTS and 1."""
    table = np.zeros(0x110000, np.uint8)
    for code in range(0x110000):
        if chr(code).isalpha():
            name = unicodedata.name(chr(code), "")
            table[code] = 1 + next((k for k, words in enumerate(NAMED.values()) if any(w in name for w in words)), len(NAMED))
    return table


#: Texts that are decoded at once.
_SLICE = 64


def _counts(texts: pa.Array) -> pa.Array:
    table, out = class_table(), np.zeros((len(texts), len(SCRIPTS)), np.int64)
    for at in range(0, len(texts), _SLICE):
        for k, text in enumerate(texts.slice(at, _SLICE).to_pylist(), at):
            if text:
                out[k] = np.bincount(table[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)], minlength=len(SCRIPTS) + 1)[1:]
    return pa.StructArray.from_arrays([pa.array(out[:, k]) for k in range(len(SCRIPTS))], names=SCRIPTS)


def script_counts(text: Column) -> Column:
    """A struct of the letters of each script, in one pass; zeros for null."""
    return F.arrow_udf(_counts, ", ".join(f"{s} long" for s in SCRIPTS))(text)
