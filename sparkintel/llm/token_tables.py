"""Token ids as sorted-string tables: shards of documents in the order of their ids.

A shard is one file:

    blocks   entries in key order: shared, unshared and value length (each an unsigned LEB128), the
             unshared end of the key, the value; a block starts with a whole key and ends with the
             crc32 of its bytes
    index    per block: last key's length and bytes, offset and size (LEB128)
    filter   Bloom filter over the keys, its bits set by double hashing
    footer   fixed size: offsets and sizes of index and filter, number of hashes, entries and ids, id
             width, crc32 of index and filter, magic

Keys are a byte that is 1 for a document without an id, which come last, the id as 8 bytes in big
endian with the sign bit flipped, so that byte order is number order, and a repeated id's number among
its equals of the shard (4 bytes), so that keys are unique in a shard. Values are ids in little endian
of 2 bytes, or 4 where one needs more.

Shards are cut by ranges of ids and, as one id may stand for very many documents, of hashes of the text
among equal ids. A task writes a file of its own name and reports it in its rows; only reported files
count, so that repeated or lost attempts leave nothing that is read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkintel.llm.staging import Staged, qualified
from sparkintel.llm.token_ids import encoder, ids_crc32

END_ID = 2
BLOCK_BYTES = 32_768
BITS_PER_KEY, HASHES = 10, 7
#: Texts that are Python objects at once.
SLICE = 256
FOOTER = struct.Struct("<QQQQIQQBI8s")
MAGIC = b"TOKSST01"
KEY = struct.Struct(">BQI")
MANIFEST = "path string, first long, first_hash long, last long, documents long, ids long"


def key_of(doc_id: int | None, repeat: int = 0) -> bytes:
    return KEY.pack(doc_id is None, 0 if doc_id is None else doc_id + (1 << 63), repeat)


def doc_of(key: bytes) -> int | None:
    without, number, _ = KEY.unpack(key)
    return None if without else number - (1 << 63)


def leb(number: int) -> bytes:
    out = bytearray()
    while number >= 128:
        out.append(number & 127 | 128)
        number >>= 7
    out.append(number)
    return bytes(out)


def unleb(data: bytes, at: int) -> tuple[int, int]:
    number = shift = 0
    while True:
        byte = data[at]
        at += 1
        number |= (byte & 127) << shift
        if byte < 128:
            return number, at
        shift += 7


def _bit_places(keys: np.ndarray, bits: int) -> np.ndarray:
    """Places of each key (a row of bytes) in a filter of so many bits."""
    wide = np.zeros((len(keys), 16), np.uint8)
    wide[:, : KEY.size] = keys
    words = wide.view(">u8").astype(np.uint64)
    h = words[:, 0] ^ words[:, 1] * np.uint64(0x9E3779B97F4A7C15)
    for by, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ h >> np.uint64(by)) * np.uint64(times)
    h ^= h >> np.uint64(31)
    return ((h & np.uint64(0xFFFFFFFF))[:, None] + (h >> np.uint64(32) | np.uint64(1))[:, None] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(bits)


class TableWriter:
    """Writes entries in key order to an open binary file; holds one block, the index and the keys."""

    def __init__(self, out):
        self.out, self.at, self.block, self.last, self.width = out, 0, bytearray(), b"", 2
        self.index, self.keys, self.entries, self.ids = bytearray(), bytearray(), 0, 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        value = leb(0) + ids.astype("<u2").tobytes() if not len(ids) or int(ids.max()) < 1 << 16 else leb(1) + ids.astype("<u4").tobytes()
        shared = 0
        if self.block:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        self.block += leb(shared) + leb(len(key) - shared) + leb(len(value)) + key[shared:] + value
        self.last = key
        self.keys += key
        self.entries += 1
        self.ids += len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self._end_block()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _end_block(self) -> None:
        if self.block:
            self.index += leb(len(self.last)) + self.last + leb(self.at) + leb(len(self.block) + 4)
            self._put(bytes(self.block) + struct.pack("<I", zlib.crc32(self.block)))
            self.block = bytearray()

    def close(self) -> None:
        self._end_block()
        bits = max(64, -(-self.entries * BITS_PER_KEY // 8) * 8)
        marks = np.zeros(bits, np.uint8)
        if self.entries:
            marks[_bit_places(np.frombuffer(bytes(self.keys), np.uint8).reshape(-1, KEY.size), bits).ravel()] = 1
        bloom, index_at = np.packbits(marks).tobytes(), self.at
        self._put(bytes(self.index))
        bloom_at = self.at
        self._put(bloom)
        self._put(FOOTER.pack(index_at, len(self.index), bloom_at, len(bloom), HASHES, self.entries, self.ids, self.width, zlib.crc32(bytes(self.index) + bloom), MAGIC))


class TableReader:
    """Reads a shard from a seekable binary file: by key, or from its first entry to its last."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        source.seek(source.tell() - FOOTER.size)
        index_at, index_size, bloom_at, bloom_size, _, self.entries, self.ids, _, crc, magic = FOOTER.unpack(source.read(FOOTER.size))
        source.seek(index_at)
        index = source.read(index_size)
        source.seek(bloom_at)
        self.bloom = np.frombuffer(source.read(bloom_size), np.uint8)
        if magic != MAGIC or zlib.crc32(index + self.bloom.tobytes()) != crc:
            raise ValueError("not a whole token table")
        self.lasts, self.places, at = [], [], 0
        while at < len(index):
            size, at = unleb(index, at)
            self.lasts.append(index[at : at + size])
            offset, at = unleb(index, at + size)
            length, at = unleb(index, at)
            self.places.append((offset, length))

    def may_hold(self, key: bytes) -> bool:
        places = _bit_places(np.frombuffer(key, np.uint8).reshape(1, KEY.size), len(self.bloom) * 8)[0].astype(np.int64)
        return bool(np.all(self.bloom[places >> 3] >> (7 - (places & 7)) & 1))

    def _block(self, n: int) -> Iterator[tuple[bytes, np.ndarray]]:
        offset, length = self.places[n]
        self.source.seek(offset)
        data = self.source.read(length)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError(f"block {n} is damaged")
        at, key = 0, b""
        while at < length - 4:
            shared, at = unleb(data, at)
            unshared, at = unleb(data, at)
            size, at = unleb(data, at)
            key = key[:shared] + data[at : at + unshared]
            at += unshared
            yield key, np.frombuffer(data, "<u4" if data[at] else "<u2", offset=at + 1, count=(size - 1) // (4 if data[at] else 2))
            at += size

    def get(self, key: bytes) -> np.ndarray | None:
        """The ids of a key: filter, binary search of the index, one block."""
        if not self.may_hold(key):
            return None
        low, high = 0, len(self.lasts)
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if self.lasts[middle] < key else (low, middle)
        if low == len(self.lasts):
            return None
        return next((ids for found, ids in self._block(low) if found == key), None)

    def every(self, doc_id: int | None) -> Iterator[np.ndarray]:
        """The ids of each document of an id."""
        repeat = 0
        while (ids := self.get(key_of(doc_id, repeat))) is not None:
            yield ids
            repeat += 1

    def scan(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for n in range(len(self.places)):
            yield from self._block(n)


def _opened(folder: str, name: str = ""):
    """File system and path of a qualified folder."""
    fs, path = pafs.FileSystem.from_uri(folder)
    return fs, f"{path}/{name}" if name else path


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    return out.assign(id=pd.array(out["id"].to_list(), "Int64"))


def write_token_tables(docs: DataFrame, folder: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Writes the shards below folder (shared by driver and executors); returns a row for each file.

    Null and empty texts are one end id. Every row is a document, also of an id that comes again; rows
    without an id come last. An empty table gives no shard. The rows are lazy: write them before use.
    """
    folder = qualified(docs.sparkSession, folder)
    fields = [("path", pa.string()), *((n, pa.int64()) for n in ("first", "first_hash", "last", "documents", "ids"))]

    def texts(column: pa.Array) -> Iterator[bytes]:
        for at in range(0, len(column), SLICE):
            yield from (text or b"" for text in column.slice(at, SLICE).cast(pa.binary()).to_pylist())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = encoder(tokenizer_path).encode_all
        writer = out = None
        first = low = last = None
        repeat, name = 0, f"{uuid.uuid4().hex}.tok"
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode_all(texts(batch.column(2))), strict=True):
                if writer is None:
                    fs, path = _opened(folder, name)
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    out, first, low = fs.open_output_stream(path), doc_id, batch.column(1)[0].as_py()
                    writer = TableWriter(out)
                    repeat = 0
                else:
                    repeat = repeat + 1 if doc_id == last else 0
                last = doc_id
                writer.add(key_of(doc_id, repeat), np.append(ids, np.uint32(END_ID)))
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": name, "first": first, "first_hash": low, "last": last, "documents": writer.entries, "ids": writer.ids}], schema=pa.schema(fields))

    keyed = docs.select(docs[id_col].cast("long").alias("id"), F.xxhash64(docs[text_col]).alias("hash"), docs[text_col].alias("text"))
    order = [F.col("id").asc_nulls_last(), F.col("hash")]
    dealt = keyed.repartitionByRange(shards, *order) if shards else keyed.repartitionByRange(*order)
    return dealt.sortWithinPartitions(*order).mapInArrow(write, MANIFEST)


def read_token_tables(manifest: DataFrame, folder: str, with_ids: bool = True) -> DataFrame:
    """id, start, n_tokens, ids_crc32 and ids (if wanted) of every document, from the files in the manifest.

    start counts the ids of all documents before it, by ascending id, those without one last.
    """
    folder = qualified(manifest.sparkSession, folder)
    columns = ["id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for shard in pdf.itertuples():
                fs, path = _opened(folder, shard.path)
                rows, at, held = [], int(shard.before), 0
                with fs.open_input_file(path) as source:
                    for key, ids in TableReader(source).scan():
                        rows.append((doc_of(key), at, len(ids), ids_crc32(ids), *([ids.astype(np.int32)] if with_ids else [])))
                        at += len(ids)
                        held += len(ids)
                        if held >= 2_000_000:
                            yield _frame(rows, columns)
                            rows, held = [], 0
                yield _frame(rows, columns)

    order = Window.orderBy(F.col("first").asc_nulls_last(), "first_hash")  # over a row for each shard
    before = F.coalesce(F.sum("ids").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # As many partitions as a shuffle has: a manifest is small, but what its rows stand for is not.
    partitions = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", before.alias("before")).repartition(partitions, "path").mapInPandas(read, "id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def token_table_lookup(spark: SparkSession, manifest: DataFrame, folder: str, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The ids of wanted documents: each asks the shards whose range covers it, through their filter and index.

    A null id is one that asks for the documents without an id.
    """
    folder = qualified(spark, folder)

    def look(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        fs, path = _opened(folder, key[0])
        with fs.open_input_file(path) as source:
            reader = TableReader(source)
            found = [(x, ids.astype(np.int32)) for x in pdf["id"].astype("Int64") for ids in reader.every(None if x is pd.NA else int(x))]
        return pd.DataFrame({"id": pd.array([None if x is pd.NA else int(x) for x, _ in found], "Int64"), "ids": [ids for _, ids in found]})

    asked = wanted.select(F.col(id_col).cast("long").alias("id")).distinct()
    shards = manifest.select("path", "first", "last")  # a row for each shard
    inside = (F.col("first") <= F.col("id")) & (F.col("last").isNull() | (F.col("id") <= F.col("last")))
    covered = asked.join(F.broadcast(shards), F.when(F.col("id").isNull(), F.col("last").isNull()).otherwise(inside))
    return covered.groupBy("path").applyInPandas(look, "id long, ids array<int>").withColumnRenamed("id", id_col)


def token_table_digest(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all documents to token tables, reads them back, and gives each document's digest."""
    staged = Staged(docs.sparkSession, "token-tables")
    folder = staged.folder()
    manifest = staged.write(write_token_tables(docs, folder, tokenizer_path, id_col, text_col))
    return read_token_tables(manifest, folder, with_ids=False).select(F.col("id").alias(id_col), "start", "n_tokens", "ids_crc32")
