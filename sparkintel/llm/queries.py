"""The queries of this subpackage over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkintel.llm.exact_dedup import exact_dedup
from sparkintel.llm.fingerprints import fingerprint_documents
from sparkintel.llm.language_id import language_report
from sparkintel.llm.mixing import mix_sources
from sparkintel.llm.near_dedup import near_duplicate_components
from sparkintel.llm.packing import pack_documents
from sparkintel.llm.personal_data import find_personal_data
from sparkintel.llm.quality_rules import judge_quality
from sparkintel.llm.source_divergence import source_divergence
from sparkintel.llm.token_counts import count_tokens_after_edits, sample_edits
from sparkintel.llm.token_tables import token_table_digest
from sparkintel.llm.url_filters import judge_urls
from sparkintel.llm.whitening import whiten


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def word_tokenizer() -> str:
    """The vocabulary file that the queries use; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), word_tokenizer())


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op3_token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table_digest(documents(spark, sf_dir), word_tokenizer())


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(documents(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return count_tokens_after_edits(docs, word_tokenizer(), sample_edits(docs["doc_id"], docs["text"]))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(documents(spark, sf_dir))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(documents(spark, sf_dir))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_source_mixing": op2_source_mixing,
    "op3_token_tables": op3_token_tables,
    "op4_personal_data": op4_personal_data,
    "op5_token_counts": op5_token_counts,
    "op6_quality_rules": op6_quality_rules,
    "op7_url_filters": op7_url_filters,
    "op8_language_id": op8_language_id,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_source_divergence": op11_source_divergence,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_document_fingerprints": op13_document_fingerprints,
}

ORACLE_SQL: dict[str, str] = {
    "op9_exact_dedup": r"""
        WITH norm AS (
            SELECT doc_id, length(coalesce(text, '')) AS points,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
            FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER (PARTITION BY body ORDER BY points DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY body) AS group_size,
               row_number() OVER (PARTITION BY body ORDER BY points DESC, doc_id) = 1 AS kept,
               sha256(body) AS text_sha256
        FROM norm""",
    "op10_jaccard_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
            FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4])) END AS s
            FROM words),
        sizes AS (SELECT doc_id, len(s) AS n FROM sets),
        shingles AS (SELECT doc_id, unnest(s) AS g FROM sets),
        shared AS (SELECT doc_id, g FROM shingles WHERE g IN (SELECT g FROM shingles GROUP BY g HAVING count(*) > 1)),
        pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shared a JOIN shared b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        links AS (
            SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)),
        reach AS (
            SELECT doc_id, doc_id AS other FROM documents
            UNION SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other)
        SELECT doc_id, n AS n_shingles, (SELECT min(other) FROM reach r WHERE r.doc_id = z.doc_id) AS component_id FROM sizes z""",
    "op11_source_divergence": r"""
        WITH docs AS (
            SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS row,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents),
        words AS (SELECT lang, source, row, unnest(terms) AS term FROM docs),
        kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT row) >= 30),
        langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
        cells AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        totals AS (SELECT lang, source, sum(n) AS total FROM cells GROUP BY ALL),
        groups AS (SELECT lang, source, coalesce(total, 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN totals USING (lang, source)),
        shares AS (
            SELECT lang, g.source, term, coalesce(c.n, 0) AS n,
                   1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * v) AS p,
                   1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total::HUGEINT + 5 * v) AS q
            FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN cells c USING (lang, source, term)),
        pairs AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(abs(a.p - b.p)) AS value
            FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        every AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
            FROM (SELECT * FROM every UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q))
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50""",
}
