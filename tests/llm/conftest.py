"""Documents with nulls, empty and long texts, ties, repeated rows and clashing column names."""

import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def make_rows():
    rng = random.Random(7)
    rows = [(k, sentence(rng, rng.randrange(3, 120)), "en", f"src{k % 4}") for k in range(40)]
    rows += [(100 + k, rows[k][1].replace(" ", "  ", k), "en", "src0") for k in range(6)]  # copies but for white space
    rows += [(120 + k, rows[9][1], "en", "src1") for k in range(5)]  # exact copies, ties
    base = sentence(rng, 200).split()
    for k in range(12):  # near copies
        words = list(base)
        for _ in range(k):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(1000)}"
        rows.append((200 + k, " ".join(words), "en", "src2"))
    rows += [(300, None, None, None), (301, "", "de", None), (302, " \t\n ", "de", "src3"), (303, "12 34 !!", None, "src3"), (None, "text without an id", "en", "src1")]
    rows += [(400, "Ünïcödé straße — ß 日本語 " * 50, "de", "src0"), (401, sentence(rng, 6000), "en", "src3"), (402, "one two three", "en", "src1"), (402, "one two three", "en", "src1")]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    extra = "id long, size string, cell int, token string, rank int, norm string, sig int, n int, hash int"
    return spark.createDataFrame([(*r, 1, "s", 2, "t", 3, "n", 4, 5, 6) for r in rows], f"doc_id long, text string, lang string, source string, {extra}").repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")
