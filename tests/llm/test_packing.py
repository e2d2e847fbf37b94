import random
import tracemalloc
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sparkintel.llm import packing
from sparkintel.llm.packing import fullest, pack_documents, slack_plan
from sparkintel.llm.staging import Staged
from sparkintel.llm.token_ids import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_encoder_gives_the_ids_of_whole_texts(tokenizer, rows):
    encoder = WordEncoder(PATH, most=50)
    odd = ["á ́b  c d e", "don't we'll I'M it'S", "\x1c\x85 x\x0by\x0cz", "ΣΣ ẞ İ", "#hash @you !!! 3.14", " line ", "x" * 5000]
    for text in [r[1] or "" for r in rows] + odd:
        assert encoder.encode(text.encode()).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_fullest_against_all_subsets():
    rng = random.Random(3)
    for _ in range(200):
        items = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 8))]
        room = rng.randrange(1, 60)
        chosen = fullest(room, Counter(items), sorted(set(items), reverse=True))
        best = max(sum(c) for n in range(len(items) + 1) for c in combinations(items, n) if sum(c) <= room)
        assert sum(a * b for a, b in chosen) == best
        assert all(Counter(items)[a] >= b for a, b in chosen)


def test_plan_uses_every_piece_once():
    rng = random.Random(4)
    counts = Counter(rng.choice([rng.randrange(1, 101), 100, 7]) for _ in range(3000))
    used = Counter()
    for bins, combination in slack_plan(dict(counts), 100):
        assert sum(a * b for a, b in combination) <= 100
        for length, times in combination:
            used[length] += bins * times
    assert used == counts


@pytest.mark.parametrize("capacity", [64, 2048])
def test_against_whole_encodings(docs, rows, tokenizer, capacity):
    got = pack_documents(docs, PATH, capacity).toPandas()
    expected = Counter()
    for doc_id, text, *_ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            expected[doc_id if doc_id is not None else -1, piece, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter(got.fillna({"doc_id": -1})[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(int).itertuples(index=False, name=None)) == expected
    bins = defaultdict(list)
    for r in got.itertuples():
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) <= 1.05 * -(-got["length"].sum() // capacity) + 1


def test_empty(no_docs):
    assert pack_documents(no_docs, PATH).count() == 0


@pytest.mark.parametrize(("before", "most"), [("10000", "1000"), ("7", "7"), ("-1", "1000")])
def test_texts_pass_to_python_in_small_batches(docs, monkeypatch, before, most):
    name, write, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", Staged.write, []
    conf = docs.sparkSession.conf
    monkeypatch.setattr(Staged, "write", lambda self, df, *by: (seen.append(conf.get(name)), write(self, df, *by))[1])
    conf.set(name, before)
    try:
        pack_documents(docs, PATH)
        assert (seen, conf.get(name)) == ([most], before)
    finally:
        conf.unset(name)


def test_a_worker_holds_few_texts_of_a_batch(tokenizer):
    texts = [f"word{k % 50} other" + " " * 3000 if k % 100 else None for k in range(10_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7, 10_007)), pa.array(texts, pa.string())], names=["id", "text"])
    known = {text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0] for text in set(texts)}
    work = packing.piece_rows(PATH, 2048)
    list(work(iter([batch.slice(0, 100)])))  # loads the tokenizer
    tracemalloc.start()
    found = list(work(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < batch.nbytes / 3
    got = pa.Table.from_batches(found).to_pydict()
    assert got["id"] == [*range(7, 10_007)] and set(got["start"]) == set(got["piece"]) == {0}
    assert got["length"] == [len(known[t]) for t in texts]
    assert got["ids_crc32"] == [zlib.crc32(np.array(known[t], "<u4").tobytes()) for t in texts]
