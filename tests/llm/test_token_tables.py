import io
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkintel.llm.staging import Staged
from sparkintel.llm.token_tables import TableReader, TableWriter, doc_of, key_of, read_token_tables, token_table_digest, token_table_lookup, write_token_tables

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_round_trip_of_a_table():
    rng, out = random.Random(1), io.BytesIO()
    entries = {key_of(k): np.array([rng.choice([3, 70_000]) for _ in range(rng.randrange(0, 900))], np.uint32) for k in sorted(rng.sample(range(-5000, 5000), 700))}
    writer = TableWriter(out)
    for key, ids in entries.items():
        writer.add(key, ids)
    writer.close()
    reader = TableReader(out)
    assert [(k, v.tolist()) for k, v in reader.scan()] == [(k, v.tolist()) for k, v in entries.items()]
    for k in range(-5000, 5000, 7):
        got, want = reader.get(key_of(k)), entries.get(key_of(k))
        assert (got is None and want is None) or got.tolist() == want.tolist()
    assert sum(reader.may_hold(key_of(k)) for k in range(10_000, 20_000)) < 300
    assert len(reader.places) > 3 and doc_of(key_of(-3)) == -3


def test_damage_is_noticed():
    out = io.BytesIO()
    writer = TableWriter(out)
    writer.add(key_of(1), np.arange(50, dtype=np.uint32))
    writer.close()
    data = bytearray(out.getvalue())
    data[20] ^= 1
    with pytest.raises(ValueError):
        list(TableReader(io.BytesIO(data)).scan())


def test_digest_and_lookup(docs, rows, spark):
    tokenizer, at, expected = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is None, r[0] or 0)):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        expected.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, token_table_digest(docs, PATH).collect()), key=lambda r: r[1]) == expected
    staged = Staged(spark, "test-tables")
    folder = staged.folder()
    manifest = staged.write(write_token_tables(docs, folder, PATH, shards=3))
    assert manifest.count() == 3
    found = token_table_lookup(spark, manifest, folder, spark.createDataFrame([(5,), (402,), (77_777,), (None,)], "doc_id long")).collect()
    whole = {r["id"]: r["ids"] for r in read_token_tables(manifest, folder).collect()}
    assert {r["doc_id"]: r["ids"] for r in found} == {k: whole[k] for k in (5, 402, None)} and len(found) == 4


def test_one_id_for_very_many_documents(spark):
    """Repeated and null ids are split over shards, and starts run on through them."""
    rng = random.Random(3)
    data = [(None, f"text {rng.randrange(50)} " * rng.randrange(9)) for _ in range(300)] + [(7, f"word{k}") for k in range(300)] + [(k, None) for k in range(100)] + [(8, "long " * 50_000)]
    rng.shuffle(data)
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    staged = Staged(spark, "test-hot")
    folder = staged.folder()
    manifest = staged.write(write_token_tables(frame, folder, PATH, shards=12))
    parts = manifest.collect()
    assert sum(r["documents"] for r in parts) == len(data) and max(r["documents"] for r in parts) < 200
    got = sorted(read_token_tables(manifest, folder, with_ids=False).collect(), key=lambda r: r["start"])
    tokenizer, at = Tokenizer.from_file(PATH), 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["id"] for r in got]
    assert ids == sorted(ids, key=lambda x: (x is None, x or 0))
    crc = lambda text: zlib.crc32(np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes())
    assert Counter((r["id"], r["ids_crc32"]) for r in got) == Counter((k, crc(t)) for k, t in data)
    found = token_table_lookup(spark, manifest, folder, spark.createDataFrame([(7,), (None,)], "doc_id long")).collect()
    assert Counter(r["doc_id"] for r in found) == {7: 301, None: 300}


def test_empty(no_docs):
    assert token_table_digest(no_docs, PATH).count() == 0
