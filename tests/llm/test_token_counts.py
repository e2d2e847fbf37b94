import random

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkintel.llm.staging import Staged
from sparkintel.llm.token_counts import TokenTree, attach_edits, build_trees, count_tokens_after_edits, edit_trees, edit_trees_in_turn, sample_edits, segments
from sparkintel.llm.token_ids import encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)


def count(text):
    return len(WHOLE.encode(text, add_special_tokens=False).ids)


def changed(text, edits):
    for start, stop, new in edits:
        start = min(max(0, start or 0), len(text))
        stop = min(max(start, stop or 0), len(text))
        text = text[:start] + (new or "") + text[stop:]
    return text


def test_random_edits_keep_the_count():
    rng = random.Random(11)
    for _ in range(15):
        text = " ".join(rng.choice(["don't", "ünï", "a,b;", "word", "x" * 300, "\n\n", "日本"]) for _ in range(rng.randrange(0, 400)))
        tree = TokenTree.of(encoder(PATH), text)
        for _ in range(30):
            start = rng.randrange(-2, len(text) + 5)
            edit = (start, start + rng.choice([0, 1, 7, 900]), rng.choice(["", " ", "mid", " new words ", "é", "\n", "long text " * 300]))
            tree.edit(*edit)
            text = changed(text, [edit])
            assert tree.text == text and tree.chars[1] == len(text)
            assert tree.tokens[1] == count(text)


def test_segments_part_before_white_space():
    text = "word " * 300 + "y" * 3000 + " end"
    parts = segments(text)
    assert "".join(parts) == text and len(parts) > 4 and all(p[0] == " " for p in parts[1:])


def test_a_small_edit_encodes_little(spark):
    text = "some words here " * 20_000
    got = count_tokens_after_edits(spark.createDataFrame([(1, text)], "doc_id long, text string"), PATH, F.array(F.struct(F.lit(160_003).alias("start"), F.lit(160_005).alias("stop"), F.lit("zz").alias("replacement")))).first()
    assert got["n_encoded"] < 1200 and got["n_tokens"] == count(changed(text, [(160_003, 160_005, "zz")]))


def test_against_whole_encodings(spark, docs, rows, no_docs):
    edits = [(5, 1, 0, 3, "a"), (5, 2, 10, 10, None), (402, 1, 2, 99, " tail"), (301, 1, None, None, "new"), (7777, 1, 0, 0, "x")]
    frame = attach_edits(docs, spark.createDataFrame(edits, "doc_id long, seq int, start int, stop int, replacement string"))
    got = count_tokens_after_edits(frame, PATH, F.col("edits")).collect()
    own = lambda doc_id: [e[2:] for e in sorted(edits, key=lambda e: e[1]) if e[0] == doc_id]
    want = sorted((r[0] or -1, count(r[1] or ""), len(own(r[0])), count(changed(r[1] or "", own(r[0])))) for r in rows)
    assert sorted((r["doc_id"] or -1, r["n_before"], r["n_edits"], r["n_tokens"]) for r in got) == want
    assert count_tokens_after_edits(no_docs, PATH, sample_edits(F.col("doc_id"), F.col("text"))).count() == 0


def test_stored_trees_take_edits_again_and_again(spark):
    """Only what an edit touches is encoded, in the second round as in the first, and whole texts in none."""
    rng, staged = random.Random(2), Staged(spark, "test-trees")
    texts = {k: " ".join(rng.choice(["word", "ünï", "don't", "a,b;", "\n\n"]) for _ in range(4000)) for k in range(6)} | {6: "", 7: None}
    trees = staged.write(build_trees(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), PATH))
    for _ in range(3):
        edits = {k: [(p := rng.randrange(len(t or "") + 1), p + rng.choice([0, 3, 40]), rng.choice(["", " new words ", "x"]))] for k, t in texts.items()}
        told = F.map_from_entries(F.array(*[F.struct(F.lit(k).cast("long"), F.array(*[F.struct(F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("stop"), F.lit(c).alias("replacement")) for a, b, c in e])) for k, e in edits.items()]))
        trees = staged.write(edit_trees(trees, PATH, told[F.col("doc_id")]))
        texts = {k: changed(t or "", edits[k]) for k, t in texts.items()}
        for r in trees.collect():
            assert "".join(r["leaves"]) == texts[r["doc_id"]] and r["n_tokens"] == count(texts[r["doc_id"]]) == sum(r["tokens"])
            assert r["n_encoded"] <= 1100 and r["n_edits"] == 1 and r["n_chars"] == len(texts[r["doc_id"]])
        trees = trees.select("doc_id", "leaves", "tokens")


def test_very_many_edits_of_one_document(spark, docs, rows):
    rng, staged = random.Random(6), Staged(spark, "test-many-edits")
    trees = staged.write(build_trees(docs, PATH))
    edits = [(401, k, p := rng.randrange(30_000), p + rng.randrange(5), rng.choice(["", " w ", "zz"])) for k in range(3000)] + [(402, 2, 0, 1, "A"), (402, 1, 3, 3, " b "), (9999, 1, 0, 0, "x"), (None, 1, 0, 0, "y"), (5, 1, None, None, None)]
    got = edit_trees_in_turn(trees, PATH, spark.createDataFrame(edits, "doc_id long, seq int, start int, stop int, replacement string")).collect()
    own = lambda doc_id: [e[2:] for e in sorted((e for e in edits if e[0] is not None), key=lambda e: e[1]) if e[0] == doc_id]
    want = sorted((r[0] or -1, count(r[1] or ""), len(own(r[0])), count(changed(r[1] or "", own(r[0])))) for r in rows)
    assert sorted((r["doc_id"] or -1, r["n_before"], r["n_edits"], r["n_tokens"]) for r in got) == want
