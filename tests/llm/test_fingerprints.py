import hashlib
import random

import numpy as np

from sparkintel.llm import fingerprints
from sparkintel.llm.fingerprints import MOST_CHUNKS, WINDOW, edit_distances, fingerprint, fingerprint_documents, likeness

M = 1 << 64
CODES = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def spread(h):
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 % M
    h = (h ^ h >> 27) * 0x94D049BB133111EB % M
    return h ^ h >> 31


def plain_print(text):
    """By the definition, a byte at a time."""
    rolls = []
    for i in range(len(text)):
        rolls.append(spread(sum((text[i - k] + 1) * pow(0x9E3779B97F4A7C15, k, M) for k in range(WINDOW) if i >= k) % M))

    def units(level):
        out, start, lead = [], 0, 0
        for i, h in enumerate(rolls):
            if i + 1 == len(text) or level < 64 and h % (1 << level) == 0:
                chunk = sum((text[j] + 1) * pow(0xC2B2AE3D27D4EB4F, j - start, M) for j in range(start, i + 1))
                u = spread((chunk + lead * 0x9E3779B97F4A7C15) % M) % 4096
                out.append(CODES[u // 64] + CODES[u % 64])
                start, lead = i + 1, h
        return out

    level = 0
    while len(units(level)) > MOST_CHUNKS:
        level += 1
    return f"{level}:{''.join(units(level))}:{''.join(units(level + 1))}"


def plain_likeness(one, other):
    def read(p):
        level, a, b = p.split(":", 2) if p.count(":") == 2 else (*p.split(":", 1), "")
        return {int(level): [a[i : i + 2] for i in range(0, len(a), 2)], int(level) + 1: [b[i : i + 2] for i in range(0, len(b), 2)]}

    a, b = read(one), read(other)
    return max([0.0] + [1 - distance(a[k], b[k]) / max(len(a[k]), len(b[k]), 1) for k in a if k in b])


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_edit(text, following):
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def test_prints_by_definition():
    rng = random.Random(5)
    texts = [b"", b"a", b"abcdefg", b"aaaaaaaaaaaaaaaaaaaaaaaaa" * 40, "Straße 日本語 ünï ".encode() * 9]
    texts += [bytes(rng.randrange(32, 127) for _ in range(n)) for n in (5, 63, 64, 65, 200, 1500, 4000)]
    for text in texts:
        assert fingerprint(text) == plain_print(text)


def test_long_texts_in_segments(monkeypatch):
    rng = random.Random(6)
    text = bytes(rng.randrange(97, 123) for _ in range(3000))
    whole = fingerprint(text)
    monkeypatch.setattr(fingerprints, "_SEGMENT", 256)
    monkeypatch.setattr(fingerprints, "_HELD", 200)
    assert fingerprint(text) == whole
    assert fingerprint(b"x" * 5000) == plain_print(b"x" * 5000)


def test_edit_distances():
    rng = np.random.default_rng(2)
    n, m = rng.integers(0, MOST_CHUNKS + 1, 400), rng.integers(0, MOST_CHUNKS + 1, 400)
    one, other = (np.where(np.arange(MOST_CHUNKS) < k[:, None], rng.integers(1, 4, (400, MOST_CHUNKS)), 0).astype(np.int32) for k in (n, m))
    found = edit_distances(one, other, n, m)
    assert found.tolist() == [distance(a[:i].tolist(), b[:j].tolist()) for a, b, i, j in zip(one, other, n, m, strict=True)]


def test_against_brute_force(docs, rows):
    # The order within an id is by a hash of the text, which only the two equal rows of 402 share.
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    got = {}
    for r in fingerprint_documents(docs.repartition(7)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for here, there in zip(order, order[1:] + order[:1], strict=True):
        text, following = here[1] or "", there[1] or ""
        new = plain_edit(text, following)
        own, changed, after = (plain_print(t.encode()) for t in (text, new, following)) if len(text) + len(following) < 3000 else (fingerprint(t.encode()) for t in (text, new, following))
        want = (len(text), hashlib.sha256(new.encode()).hexdigest(), own, changed, round(plain_likeness(own, changed), 9), round(plain_likeness(own, after), 9))
        found = [(r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got[here[0]]]
        assert want in found


def test_copies_are_near_and_others_far():
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["spark", "token", "river", "mountain", "quiet", "letter"]) + str(rng.randrange(500)) for _ in range(n)) for n in (12, 40, 300, 5000)]
    for text in texts:
        own = fingerprint(text.encode())
        middle = text[: len(text) // 2] + "changed" + text[len(text) // 2 + 7 :]
        assert likeness([own], [fingerprint(middle.encode())])[0] > 0.7
        assert likeness([own], [fingerprint(texts[0][::-1].encode() * 9)])[0] < 0.2


def test_one_row_and_none(docs, no_docs):
    one = fingerprint_documents(docs.where("doc_id = 5")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1
    assert fingerprint_documents(no_docs).count() == 0
