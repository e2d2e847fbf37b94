"""From raw documents to packed training sequences, in stages that each read what the last wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkintel.llm.exact_dedup import keep_first_copies
from sparkintel.llm.language_id import UNKNOWN, has_letter, held_out, language_column, learn_languages
from sparkintel.llm.mixing import mixed_documents
from sparkintel.llm.near_dedup import keep_one_of_each
from sparkintel.llm.packing import pack_documents
from sparkintel.llm.queries import word_tokenizer
from sparkintel.llm.staging import Staged


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in some learned language; texts without a letter go, and only those if no row had a label."""
    model = learn_languages(docs, ~held_out(docs["doc_id"]))
    if not model["families"]:
        return docs.where(has_letter(docs["text"]))
    return docs.where(language_column(model, docs["text"])["lang_pred"] != UNKNOWN)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return keep_first_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates."""
    return keep_one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in training sequences; a repeated document is packed as often."""
    return pack_documents(docs, word_tokenizer())


STAGES = [("language", known_language), ("exact copies", drop_copies), ("near copies", drop_near_copies), ("mix", mix), ("pack", pack)]
#: Language machines, tokenizer ids and bin plans are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = Staged(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
