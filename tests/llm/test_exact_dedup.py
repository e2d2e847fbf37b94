import hashlib
import re
from collections import defaultdict

from sparkintel.llm.exact_dedup import exact_dedup, keep_first_copies


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_against_brute_force(docs, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r)
    got = exact_dedup(docs, first_digit=4).collect()
    assert len(got) == len(rows)
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in got:
        group = by_hash[r["text_sha256"]]
        best = min(group, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0))
        assert (r["keep_id"], r["group_size"]) == (best[0], len(group))
    assert sum(r["kept"] for r in got) == len(groups)


def test_keeps_columns_and_one_row_of_each_group(docs, rows):
    kept = keep_first_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(norm(r["text"]) for r in kept.collect()) == sorted({norm(r[1]) for r in rows})


def test_empty(no_docs):
    assert exact_dedup(no_docs).count() == 0
