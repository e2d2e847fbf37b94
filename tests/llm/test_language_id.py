import math
import random
import zlib
from collections import Counter

import unicodedata

import numpy as np
from pyspark.sql import functions as F

from sparkintel.llm import language_id
from sparkintel.llm.language_id import SIZE, family_of, fit_machine, has_letter, identify_languages, language_report, learn_languages, text_features

SYLLABLES = {"en": "the and ing tion er ed", "de": "der und ung keit sch ein", "fr": "les que ment eau oi re", "es": "los que ado cion mente ar"}


def make(rng, language, n):
    own = SYLLABLES[language].split()
    return " ".join("".join(rng.choice(own) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_held_out_accuracy_and_odd_rows(spark):
    rng = random.Random(8)
    data = [(k, make(rng, lang, rng.randrange(10, 90)), lang, "s", 0.5) for k, lang in enumerate(rng.choices(list(SYLLABLES), k=600))]
    odd = [(1000, None, "en", "s", 0.1), (1001, "", None, None, 0.1), (1002, "123 !!", "fr", "s", 0.1), (1004, "½ ²", "fr", "s", 0.1), (1005, "① Ⅷ 1_0", None, "s", 0.1), (None, make(rng, "de", 20), None, "s", 0.1), (1003, make(rng, "fr", 60_000), None, "s", 0.1), data[0], data[0]]
    got = language_report(spark.createDataFrame(data + odd, "doc_id long, text string, lang string, source string, score double").repartition(3)).collect()
    assert len(got) == len(data) + len(odd)
    want = {r[0]: r[2] for r in data}
    held = [r for r in got if r["held_out"] and r["doc_id"] in want]
    assert len(held) > 80 and sum(want[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    for r in got:
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    told = {r["doc_id"]: r["lang_pred"] for r in got}
    assert [told[k] for k in (1000, 1001, 1002, 1004, 1005, None, 1003)] == ["und"] * 5 + ["de", "fr"]


def test_families():
    assert family_of("EN-gb") == family_of("de") and family_of("fr") == family_of("es") != family_of("de") and family_of("xx") == "xx"


def test_without_labels_or_documents(spark, docs, no_docs):
    assert {r["lang_pred"] for r in language_report(docs.drop("lang").selectExpr("*", "CAST(NULL AS STRING) AS lang")).collect()} == {"und"}
    assert language_report(no_docs).count() == 0


def test_letters_are_those_of_unicode(spark):
    texts = [None, "", " ", "½ ②", "Ⅷ", "_", "１２", "é", "ªb", "日", "ʰ", "\U0001f600", "٣", "ǅ", "\U00010400"]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", has_letter(F.col("text")).alias("has")).collect()
    assert {r["text"]: r["has"] for r in got} == {t: any(unicodedata.category(c).startswith("L") for c in t or "") for t in texts}


def plain_prediction(model, text):
    """By the definition: one gram, one machine and one vote at a time."""
    if not text or not any(unicodedata.category(c).startswith("L") for c in text):
        return "und", 0.0
    data, counts = (" " + " ".join(text.lower().split()) + " ").encode(), [0] * SIZE
    for k in range(len(data) - 1):
        pair = data[k] * 257 + data[k + 1]
        counts[(pair * 2654435 >> 7) % SIZE] += 1
        if k + 2 < len(data):
            triple = (pair * 263 + data[k + 2]) * 40503
            triple = (triple + 2**31) % 2**32 - 2**31  # 32 bits
            counts[(triple >> 5) % SIZE] += 1
    x = [math.sqrt(c / sum(counts)) for c in counts]
    chance = lambda w: 1 / (1 + math.exp(-3 * (sum(a * b for a, b in zip(x, w[:-1], strict=True)) + w[-1])))
    chances = {f: chance(w) for f, w in zip(model["families"], model["against"], strict=True)}
    family = max(chances, key=chances.get)
    votes, sure = Counter(), Counter()
    own = model["groups"][family]
    for (a, b), w in model["pairs"].items():
        if a in own:
            p = chance(w)
            votes[a if p >= 0.5 else b] += 1
            sure[a] += p
            sure[b] += 1 - p
    best = max(own, key=lambda v: (votes[v], sure[v], v))
    return best, chances[family] / sum(chances.values()) * (sure[best] / (len(own) - 1) if len(own) > 1 else 1)


def test_against_the_definition(spark):
    rng = random.Random(3)
    data = [(k, make(rng, lang, rng.randrange(5, 60)), lang) for k, lang in enumerate(rng.choices(list(SYLLABLES), k=200))] + [(900, "é", None), (901, None, "en"), (902, "12", "de"), (903, "a", None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(3)
    model = learn_languages(docs, F.col("doc_id") < 150)
    assert len(model["families"]) == 2 and len(model["pairs"]) == 2
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify_languages(docs, model).collect()}
    for k, text, _ in data:
        language, score = plain_prediction(model, text)
        assert got[k][0] == language and abs(got[k][1] - score) < 1e-6


def test_machines_are_fitted_in_tasks(spark, monkeypatch):
    """The driver fits none, and the weights are those of one fit over all texts."""
    rng = random.Random(5)
    data = sorted({(make(rng, lang, rng.randrange(5, 60)), lang) for lang in rng.choices(list(SYLLABLES), k=120)})
    docs = spark.createDataFrame([(k, *r) for k, r in enumerate(data)], "doc_id long, text string, lang string").repartition(3)

    def here(*_):
        raise AssertionError("a machine was fitted on the driver")

    with monkeypatch.context() as m:
        m.setattr(language_id, "fit_machine", here)
        model = learn_languages(docs, F.lit(True))
    rows = sorted((lang, text_features(text).astype(np.float32).tobytes()) for text, lang in data)
    x, names = np.frombuffer(b"".join(f for _, f in rows), np.float32).reshape(-1, SIZE), np.array([v for v, _ in rows])
    of = np.array([family_of(v) for v in names])
    for family, w in zip(model["families"], model["against"], strict=True):
        assert np.allclose(w, fit_machine(x, of == family), atol=1e-5)
    assert set(model["pairs"]) == {("de", "en"), ("es", "fr")}
    for (a, b), w in model["pairs"].items():
        pair = (names == a) | (names == b)
        assert np.allclose(w, fit_machine(x[pair], names[pair] == a), atol=1e-5)
