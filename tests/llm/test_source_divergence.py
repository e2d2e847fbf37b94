import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sparkintel.llm import source_divergence as sd
from sparkintel.llm.source_divergence import joint_distance, source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(rows, least, top):
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        words = TERM.findall(lower(text or ""))
        groups.add((lang or "", source or ""))
        counts[lang or "", source or ""].update(words)
        seen[lang or ""].update(set(words))
    out = []
    for lang in {g for g, _ in groups}:
        kept = sorted(t for t, n in seen[lang].items() if n >= least)
        sources = sorted(s for g, s in groups if g == lang)
        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])

        def share(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        q, p = share(whole), {s: share(counts[lang, s]) for s in sources}
        for s in sources:
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pair, None), ("term", term, top)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def made(seed, n_sources):
    rng = random.Random(seed)
    words = ["Alpha", "bêta", "gamma", "DELTA", "日本", "ÄRGER", "zeta", "eta"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(150)]
    rows = []
    for k in range(400):
        source = f"s{min(rng.randrange(2 * n_sources), n_sources - 1)}"  # one source has half of all rows
        text = " ".join(words[min(int(rng.expovariate(0.03)), len(words) - 1)] + rng.choice(["", ",", " 12", "_x", "\x00", "@"]) for _ in range(rng.randrange(1, 40)))
        rows.append((text, rng.choice(["en", "de", None]), source))
    rows += [(None, "en", "s0"), ("", "en", "empty"), ("12 34", "en", None), ("alpha " * 3000, "en", "s1"), ("one two", "fr", "only"), ("x", "it", "a"), ("y", "it", "b")]
    return rows + rows[:20]


@pytest.mark.parametrize("block, source_block, held", [(64, 64, 200_000), (1, 2, 50)])
def test_against_brute_force(spark, block, source_block, held):
    rows = made(block, 5)
    table = spark.createDataFrame([(*r, 1, "n", 2) for r in rows], "text string, lang string, source string, number int, term string, n int").repartition(3)
    got = sorted(tuple(r) for r in source_divergence(table, least_docs=12, top_terms=9, block_words=block, source_block=source_block, held=held).collect())
    assert got == plain(rows, 12, 9)


@pytest.mark.parametrize("step", [1, 7, 1 << 21])
def test_joint_distance(monkeypatch, step):
    monkeypatch.setattr(sd, "_CELLS", step)
    rng = np.random.default_rng(4)
    n_terms, n_groups = 130, 3
    counts = rng.poisson(0.7, (n_groups, n_terms))
    shares = 10 + 7 * counts
    full = np.zeros(3, np.uint64)
    np.bitwise_or.at(full, np.arange(n_terms) // 64, np.uint64(1) << (np.arange(n_terms) % 64).astype(np.uint64))
    levels = []
    for word in range(3):
        for g in range(n_groups):
            own = range(64 * word, min(64 * word + 64, n_terms))
            levels.append((word, g, 10, 0))
            levels += [(word, g, 10 + 7 * c, sum(1 << t % 64 for t in own if counts[g, t] == c)) for c in sorted({counts[g, t] for t in own} - {0})]
    side = (*[np.array([x[k] for x in levels], np.uint64 if k == 3 else np.int64) for k in range(4)], n_groups)
    assert (joint_distance(full, side, side) == np.abs(shares[:, None] - shares[None]).sum(axis=2)).all()


def test_empty(no_docs):
    assert source_divergence(no_docs).count() == 0
