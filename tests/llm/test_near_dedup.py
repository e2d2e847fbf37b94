from collections import Counter

from sparkintel.llm.near_dedup import keep_one_of_each, near_duplicate_components


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or (frozenset([tuple(words)]) if words else frozenset())


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    low = list(range(len(rows)))

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= 75 * len(x | sets[j]):
                a, b = root(i), root(j)
                low[max(a, b)] = min(a, b)
    smallest = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            smallest[root(k)] = min(smallest.get(root(k), r[0]), r[0])
    return Counter((r[0], len(s), smallest.get(root(k)) if s else r[0]) for k, (r, s) in enumerate(zip(rows, sets)))


def test_against_brute_force(docs, rows):
    got = near_duplicate_components(docs).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(rows)


def test_many_near_copies_in_chains(spark):
    """Each text differs from the last by some words, so that only neighbours link."""
    words = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(40):
        rows.append((k, " ".join(words)))
        words[(k * 7) % 60] = f"x{k}"
    got = near_duplicate_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(rows)


def test_keeps_one_row_of_each_component(docs, rows):
    kept = keep_one_of_each(docs)
    assert kept.columns == docs.columns
    expected = Counter(c for _, n, c in brute(rows) if n)
    assert kept.count() == len(expected) + sum(not shingles(r[1]) for r in rows)


def test_empty(no_docs):
    assert near_duplicate_components(no_docs).count() == 0
