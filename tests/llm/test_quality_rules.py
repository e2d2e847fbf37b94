import re
from collections import Counter

import numpy as np

from sparkintel.llm.quality_rules import judge_quality, learn_rules, rule_column


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, lines = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    times = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    cover = {k for i in range(len(words) - 7) if times[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), lines, len(cover)


def test_against_brute_force(spark, docs, rows):
    more = spark.createDataFrame([(900, "a b c d e f g h i\nx\n a\nx\na b c d e f g h i\n\n\n" * 3), (901, "# | <b> é&é $$ %\x0b\x1c x" * 9)], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(more)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(30)] + [(None, 1, 0), (5, None, 0), (9999, 0, 0)], "doc_id long, quality int, toxic int")
    got = judge_quality(both, labels).collect()
    want = Counter()
    for doc_id, text in [(r[0], r[1]) for r in rows] + [tuple(r) for r in more.collect()]:
        c = counts(text)
        want[doc_id, *c, c[0] < 20 or 100 * c[4] > 30 * c[0]] += 1
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
    assert not any(r["base_failed"] and r["kept"] for r in got)


def test_rules_find_a_planted_conjunction(spark):
    rng = np.random.default_rng(2)
    x = rng.random((4000, 4))
    bad = (x[:, 1] > 0.7) & (x[:, 3] <= 0.4) | (x[:, 0] > 0.95)
    rules = learn_rules(x, bad)
    names = ["a", "b", "c", "d"]
    table = spark.createDataFrame([(*map(float, r), bool(b)) for r, b in zip(x[:500], bad[:500], strict=True)], "a double, b double, c double, d double, bad boolean")
    told = table.select((rule_column(rules, names).isNotNull() == table["bad"]).alias("right")).collect()
    assert sum(r["right"] for r in told) > 480


def test_without_labels_or_documents(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r["kept"] != r["base_failed"] for r in judge_quality(docs, none).collect())
    assert judge_quality(no_docs, none).count() == 0
