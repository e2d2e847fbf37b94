"""Ranked text search: every term must occur, ranked by BM25."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkintel.operators.answers import search_document
from sparkintel.sources.exports import written_once

K1, B = 1.2, 0.75
MOST = 100


#: Letters with marks and the letter that they are read as, by their canonical decomposition.
_MARKED = {c: base for c in map(chr, (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))) if len(d := unicodedata.normalize("NFD", c)) > 1 and (base := d[0]).isascii()}
_BASE = str.maketrans(_MARKED)


def query_terms(query: str) -> list[str]:
    """Literal terms of a query, lower-cased, without diacritics and distinct; one without any is an error."""
    plain = "".join(c for c in query.translate(_BASE) if not unicodedata.combining(c)).lower()
    terms = re.findall(r"[^\W_]+", plain)
    if not terms:
        raise ValueError("a query needs at least one term")
    return list(dict.fromkeys(terms))


def without_diacritics(text: Column) -> Column:
    """Latin letters without their marks; combining marks go. ASCII texts stay as they are."""
    bare = F.regexp_replace(F.translate(text, "".join(_MARKED), "".join(_MARKED.values())), r"\p{Mn}", "")
    return F.when(text.rlike(r"[^\x00-\x7F]"), bare).otherwise(text)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(without_diacritics(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _times(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda t: t == F.lit(term)))


def bm25_search(docs: DataFrame, key: str, text: str, query: str, k: int = 10) -> DataFrame:
    """The k best documents that have every term: key, score. Ties by key.

    Texts are cut into words once: the lengths and counts of the asked terms are written, and what
    is known of all documents and the ranks are made of these.
    """
    if not 1 <= k <= MOST:
        raise ValueError(f"k must be between 1 and {MOST}")
    terms = query_terms(query)
    counts = F.struct(F.size("tokens").alias("length"), *[_times(F.col("tokens"), term).alias(f"tf{n}") for n, term in enumerate(terms)])
    cut = docs.select(key, F.explode_outer(F.array(tokens(F.col(text)))).alias("tokens"))  # once, and not for each use
    counted = written_once(cut.select(key, counts.alias("c")).select(key, "c.*"))
    stats = counted.agg(F.count(F.lit(1)).alias("docs"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"tf{n}") > 0).alias(f"df{n}") for n in range(len(terms))])
    hits = counted
    for n in range(len(terms)):
        hits = hits.where(F.col(f"tf{n}") > 0)
    scored = hits.crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for n in range(len(terms)):
        idf = F.log(1 + (F.col("docs") - F.col(f"df{n}") + 0.5) / (F.col(f"df{n}") + 0.5))
        score = score + idf * F.col(f"tf{n}") * (K1 + 1) / (F.col(f"tf{n}") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return scored.select(key, F.round(score, 9).alias("score")).orderBy(F.col("score").desc(), key).limit(k)


def search_cards(cards: DataFrame, fields: list[str], query: str, k: int = 20) -> DataFrame:
    """The k best cards for a query, in the texts that search looks through: repository_id, score."""
    return bm25_search(search_document(cards, fields), "repository_id", "text", query, k)
