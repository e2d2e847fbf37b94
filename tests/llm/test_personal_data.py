import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkintel.llm.personal_data import VOTERS, candidates, estimate_reliabilities, find_personal_data

TEXTS = [
    None, "", "no data here", "mail a.b+c@x-y.example.com, or _d@e.f", "x@y.z..d@e.f a@b a@b. @c.d a@b.c_d@e.f%g@h.i",
    "1.2.3.4.5.6.7.8 and 256.1.1.1 then 10.0.0.255. 0001.2.3.4", "4111 1111 1111 1111; 4111-1111-1111-1112 4111  1111 1111 1111",
    "12345678901234567890 5500000000000004x 5500005555555559 0", "+1 (132) 555-1352, +49 30 123456 +1.-+1 234 567 8901 2 + 5", "ünïcödé 😀 a@b.cd 😀 +1 (999) 555-0000 \n 8.8.8.8",
    'token = "9c9b1234a5dcc6a3c0f21b9e8d7a6b5c4d3e2f10" and card 5500000000000004', "1" * 30_000, "a" * 30_000 + "@" + "b." * 10_000 + "c", "1.2." * 5000, "+" + "1 " * 5000 + "x",
]


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


PATTERNS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([ -]?[0-9])+", lambda m: 14 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def base_spans(text):
    # Long runs are skipped where backtracking would take the test minutes; they hold no match.
    return sorted((m.start(), place, m.end(), kind) for place, (kind, (p, good)) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if good(m[0]))


def test_base_against_brute_force(spark):
    data = [(k, t, 1, "x") for k, t in enumerate(TEXTS)] + [(3, TEXTS[3], 1, "x"), (None, TEXTS[4], 1, "x"), (3, TEXTS[5], 1, "x")]
    got = find_personal_data(spark.createDataFrame(data, "doc_id long, text string, start int, kind string").repartition(3)).collect()
    want = Counter()
    for doc_id, text, *_ in data:
        text = text or ""
        spans = base_spans(text.replace("a" * 30_000, "a" * 30_000)) if len(text) < 30_000 or "@" not in text else [(0, 0, len(text), "email")]
        named = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)
        want[doc_id, *(sum(s[3] == k for s in spans) for k in PATTERNS), hashlib.sha256(named.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == want
    for r in got:
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        assert spans == sorted(spans, key=lambda s: int(s[1])) and len(spans) == r["n_added"] + sum(r[f"n_{k}"] for k in PATTERNS)


def test_reliabilities_are_recovered():
    rng, patterns = np.random.default_rng(5), Counter()
    for truth in rng.random(20_000) < 0.3:
        votes = [int(rng.choice([1, -1], p=[a, 1 - a] if truth else [1 - a, a])) for a in (0.95, 0.9, 0.8, 0.7, 0.6)]
        patterns["secret", tuple(votes)] += 1
    counts = [(k, v, n) for (k, v), n in sorted(patterns.items())]
    posterior, chances = estimate_reliabilities(counts)
    assert np.allclose([chances[j, 1, 2] for j in range(len(VOTERS))], [0.95, 0.9, 0.8, 0.7, 0.6], atol=0.05)
    assert abs(sum(p * c for p, (_, _, c) in zip(posterior, counts, strict=True)) / 20_000 - 0.3) < 0.03


def planted(rng, n):
    """Documents of which 2 % hold a secret, 2 % each of the base kinds, and 3 % a digest that is no secret."""
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9)))
    hexa = lambda k: "1a" + "".join(rng.choice("0123456789abcdef") for _ in range(k - 2))
    made = {
        "secret": lambda: rng.choice(['token = "{}"', "api_key: '{}'", 'password="{}"']).format(hexa(40)),
        "email": lambda: f"{word()}.{rng.randrange(99)}@mail{rng.randrange(9)}.example.com",
        "ip": lambda: ".".join(str(rng.randrange(1, 223)) for _ in range(4)),
        "phone": lambda: f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}",
        "digest": lambda: rng.choice(["{}", "sha256: {}", "commit {}", "({})"]).format(hexa(rng.choice([32, 40, 64]))),
    }
    rows = []
    for k in range(n):
        what = ["secret", "secret", "email", "email", "ip", "ip", "phone", "phone", "digest", "digest", "digest"][k % 100] if k % 100 < 11 else None
        words = [word() for _ in range(rng.randrange(10, 40))]
        rows.append((k, " ".join([*words[:5], made[what]() if what else word(), *words[5:]]), what))
    return rows


@pytest.mark.parametrize("n", [200, 1000, 10_000])
def test_secrets_are_added_at_every_size(spark, n):
    rows = planted(random.Random(n), n)
    got = find_personal_data(spark.createDataFrame(rows, "doc_id long, text string, what string")).collect()
    what = {k: w for k, _, w in rows}
    for r in got:
        assert r["n_added"] == (what[r["doc_id"]] == "secret"), rows[r["doc_id"]]
        assert (r["n_spans"] > 0) == (what[r["doc_id"]] not in (None, "digest")), rows[r["doc_id"]]


def test_an_address_without_digits_is_found(spark):
    texts = ["host ab:cd:ef:ab:cd:ef:ab:cd here", "me (at) example (dot) com", "f" * 40, "no: (thing) [here]"]
    got = candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), F.col("text"), F.col("doc_id")).collect()
    assert sorted((r["doc_id"], r["kind"], r["start"], r["end"]) for r in got) == [(0, "ip", 5, 28), (1, "email", 0, 25)]


def test_every_pattern_runs_once(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = candidates(docs, F.col("text"), F.col("doc_id"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 8


def test_empty(spark):
    assert find_personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0
