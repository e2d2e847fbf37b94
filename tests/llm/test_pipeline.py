import re
from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.test_near_dedup import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf_dir(spark, rows, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    table = [(*r, len(r[1] or "")) for r in rows]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """The input and the output of each stage, written and read as the check does."""
    folder, docs, out = str(tmp_path_factory.mktemp("stages")), spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append((before, docs))
    return out


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_columns(stages):
    for _, after in stages[:-1]:
        assert after.columns == COLUMNS


def test_language_keeps_texts_with_letters(stages):
    before, after = stages[0]
    lettered = [r for r in before.collect() if r["text"] and re.search(r"[^\W\d_]", r["text"])]
    assert Counter(map(tuple, after.collect())) == Counter(map(tuple, lettered))


def test_exact_copies(stages):
    before, after = stages[1]
    assert Counter(norm(r["text"]) for r in after.collect()) == Counter({norm(r["text"]): 1 for r in before.collect()})


def test_near_copies(stages):
    before, after = ([(r["doc_id"], r["text"]) for r in df.collect()] for df in stages[2])
    named = [(k, text) for k, (_, text) in enumerate(before)]
    assert len(after) == len({c for _, n, c in brute(named) if n})
    assert not set(after) - set(before)


def test_mix_repeats_documents(stages):
    before, after = (Counter(map(tuple, df.collect())) for df in stages[3])
    assert set(after) <= set(before) and max(after.values()) <= 3
    words = lambda c, s: sum(len((r[1] or "").split()) * n for r, n in c.items() if r[3] == s)
    whole = sum(words(before, s) for s in {r[3] for r in before})
    assert abs(sum(words(after, s) for s in {r[3] for r in before}) - whole) < 0.1 * whole


def test_packing_has_every_copy(stages):
    before, after = stages[4]
    pieces = after.where("piece = 0").groupBy("doc_id").count().collect()
    assert Counter({r["doc_id"]: r["count"] for r in pieces}) == Counter(r["doc_id"] for r in before.collect())
    for _, offset, length in sorted((r["sequence_id"], r["offset"], r["length"]) for r in after.collect()):
        assert offset + length <= 2048


def test_run(spark, sf_dir, stages):
    assert corpus_pipeline.run(spark, sf_dir).count() == stages[-1][1].count()


def test_texts_with_letters_stay_without_labels(spark, docs, rows):
    unlabelled = docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang", "source")
    kept = corpus_pipeline.known_language(spark, unlabelled, "").collect()
    assert Counter(r["text"] for r in kept) == Counter(r[1] for r in rows if r[1] and re.search(r"[^\W\d_]", r[1]))


def test_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_extra_columns_of_the_stages_own_names(spark, docs, rows):
    """Columns that are named as what the stages compute stay as they are, through every stage but the last."""
    table = docs.selectExpr("*", "7 AS times", "8 AS copies", "'k' AS doc_row", "9 AS n_chars", "'l' AS lang_pred", "10 AS comp")
    after = table
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, after, "")
        assert after.columns == table.columns
    after = after.cache()
    assert after.count() > 0 and after.select("times", "copies", "doc_row", "size", "cell", "lang_pred", "comp").distinct().collect() == table.select("times", "copies", "doc_row", "size", "cell", "lang_pred", "comp").distinct().collect()
    assert corpus_pipeline.STAGES[-1][1](spark, after, "").count() >= after.count()
