"""Edit-aware token counts: a stored segment tree over the pre-tokens of each document.

A document is cut before white space into segments of about 256 characters, the leaves of a tree whose
nodes hold the sums of characters and tokens below them. As a segment (but the first) starts with white
space, no word crosses a border, and for tokenizers that are local to words the ids of a text are those
of its segments in turn. Trees are kept as a table: a row for each document with its leaves and their
counts, from which the sums above follow without a tokenizer. An edit is found by descending the sums;
only the leaves that it touches are encoded again, with the leaf before them where the edit takes away
the white space that parts them, and the sums above are renewed. A leaf that has grown too long is
split, which renews the tree's shape. Edited trees are rows of the same form: written, they take the
next edits, and what no edit touches is never encoded again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sparkintel.llm.staging import Staged
from sparkintel.llm.token_ids import WordEncoder, encoder

TARGET = 256
MOST = 4 * TARGET
_SPACES = " \t\n\x0b\x0c\r"


def segments(text: str) -> list[str]:
    """The text in pieces of about TARGET characters; each but the first starts with white space."""
    parts, start = [], 0
    while len(text) - start > TARGET:
        cut = start + TARGET
        while cut < len(text) and text[cut] not in _SPACES:
            cut += 1
        if cut == len(text):
            break
        parts.append(text[start:cut])
        start = cut
    parts.append(text[start:])
    return parts


class TokenTree:
    """Token count of one text under edits."""

    def __init__(self, encode: WordEncoder, leaves: list[str], counts: list[int]):
        self.encode, self.encoded = encode, 0
        self._build(leaves, counts)

    @classmethod
    def of(cls, encode: WordEncoder, text: str) -> TokenTree:
        parts = segments(text) if encode.local else [text]
        return cls(encode, parts, [len(x) for x in encode.encode_all(p.encode("utf-8", "replace") for p in parts)])

    def _build(self, leaves: list[str], counts: list[int]) -> None:
        self.size = 1
        while self.size < len(leaves):
            self.size *= 2
        self.leaves = leaves + [""] * (self.size - len(leaves))
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        self.chars[self.size : self.size + len(leaves)] = map(len, leaves)
        self.tokens[self.size : self.size + len(leaves)] = counts
        for node in range(self.size - 1, 0, -1):
            self._sum(node)

    def _sum(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def _find(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at the place (the last one for the end), and its start."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if place - start >= self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return node - self.size, start

    def _put(self, leaf: int, text: str, count: int) -> None:
        node = leaf + self.size
        self.leaves[leaf], self.chars[node], self.tokens[node] = text, len(text), count
        while node := node // 2:
            self._sum(node)

    def edit(self, start: int, stop: int, text: str) -> None:
        """Puts text in place of the characters from start to stop, both held within the text."""
        start = min(max(0, start), self.chars[1])
        stop = min(max(start, stop), self.chars[1])
        first, begin = self._find(start)
        last, last_begin = self._find(max(start, stop - 1))
        body = "".join(self.leaves[first : last + 1])
        body = body[: start - begin] + text + body[stop - begin :]
        while (not body or body[0] not in _SPACES) and begin > 0:
            first, begin = self._find(begin - 1)
            body = self.leaves[first] + body
        self.encoded += len(body)
        count = len(self.encode.encode(body.encode("utf-8", "replace")))
        for leaf in range(first + 1, last + 1):
            if self.leaves[leaf]:
                self._put(leaf, "", 0)
        self._put(first, body, count)
        if len(body) > MOST and self.encode.local:
            parts = segments(body)
            counts = [len(x) for x in self.encode.encode_all(p.encode("utf-8", "replace") for p in parts)]
            self.encoded += len(body)
            kept = [(t, n) for k, (t, n) in enumerate(zip(self.leaves, self.tokens[self.size :], strict=True)) if t and k != first]
            before = sum(1 for t in self.leaves[:first] if t)
            kept[before:before] = zip(parts, counts, strict=True)
            self._build([t for t, _ in kept], [n for _, n in kept])

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    def kept(self) -> tuple[list[str], list[int]]:
        """Leaves that hold text and their counts; one leaf at least."""
        held = [(t, n) for t, n in zip(self.leaves, self.tokens[self.size :], strict=True) if t]
        return [t for t, _ in held] or [""], [n for _, n in held] or [0]


TREE = "leaves array<string>, tokens array<int>"
COUNTS = ["n_before", "n_edits", "n_tokens", "n_chars", "n_encoded"]
_LEAVES, _TOKENS = pa.list_(pa.string()), pa.list_(pa.int32())
#: Characters of the documents whose leaves are held at once, but for a single longer one.
_HELD = 1 << 21


def _runs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Rows from and to of runs of texts (or of lists of leaves) of about _HELD bytes."""
    sizes = [n or 0 for n in (pc.binary_length(texts) if not pa.types.is_list(texts.type) else pc.list_value_length(texts)).to_pylist()]
    if pa.types.is_list(texts.type):
        sizes = [n * TARGET for n in sizes]
    start = held = 0
    for at, n in enumerate(sizes):
        if held and held + n > _HELD:
            yield start, at
            start, held = at, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def build_trees(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """The tree of each row of docs: id, leaves, tokens, and the columns of `keep` as they are.

    Null text counts as empty: one empty leaf. Whole texts are encoded here, and only here.
    """
    more = keep or {}
    chosen = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), *[c.alias(n) for n, c in more.items()])
    carried = [f for f in chosen.schema.fields if f.name not in ("id", "text")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        for batch in batches:
            for a, b in _runs(batch.column(1)):
                part = batch.slice(a, b - a)
                cut = [(segments(t or "") if encode.local else [t or ""]) for t in part.column(1).to_pylist()]
                sizes = [len(x) for x in encode.encode_all(leaf.encode("utf-8", "replace") for leaves in cut for leaf in leaves)]
                ends = np.cumsum([len(leaves) for leaves in cut])
                counts = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(sizes, pa.int32()))
                columns = [part.column(0), pa.array(cut, _LEAVES), counts, *(part.column(k) for k in range(2, part.num_columns))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "leaves", "tokens", *part.schema.names[2:]])

    kind = chosen.schema["id"].dataType.simpleString()
    schema = ", ".join([f"id {kind}", TREE, *[f"{f.name} {f.dataType.simpleString()}" for f in carried]])
    return chosen.mapInArrow(work, schema).withColumnRenamed("id", id_col)


def edit_trees(trees: DataFrame, tokenizer_path: str, edits: Column, id_col: str = "doc_id", with_trees: bool = True) -> DataFrame:
    """Trees after edits, encoding what they touch: id, COUNTS and, if wanted, leaves and tokens.

    edits: array of (start, stop, replacement) in code points, each on the text that the one before has
    left; null for none. A null replacement is a deletion, null places are the start, places beyond the
    text its end. n_before and n_tokens count tokens before and after the edits, n_encoded the characters
    that were encoded again.
    """
    typed = edits.cast("array<struct<start:bigint,stop:bigint,replacement:string>>")
    chosen = trees.select(trees[id_col].alias("id"), "leaves", "tokens", typed.alias("edits"))
    kind = trees.schema[id_col].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        for batch in batches:
            for a, b in _runs(batch.column(1)):
                part = batch.slice(a, b - a)
                rows, made = [], []
                for leaves, counts, changes in zip(*(part.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                    tree = TokenTree(encode, leaves, counts)
                    before = tree.tokens[1]
                    for e in changes or []:
                        tree.edit(e["start"] or 0, e["stop"] or 0, e["replacement"] or "")
                    rows.append((before, len(changes or []), tree.tokens[1], tree.chars[1], tree.encoded))
                    if with_trees:
                        made.append(tree.kept())
                columns = [part.column(0), *(pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * len(COUNTS)))]
                if with_trees:
                    columns += [pa.array([x for x, _ in made], _LEAVES), pa.array([n for _, n in made], _TOKENS)]
                fields = [("id", to_arrow_type(kind)), *((n, pa.int64()) for n in COUNTS), *([("leaves", _LEAVES), ("tokens", _TOKENS)] if with_trees else [])]
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    schema = ", ".join([f"id {kind.simpleString()}", *[f"{n} long" for n in COUNTS], *([TREE] if with_trees else [])])
    return chosen.mapInArrow(work, schema).withColumnRenamed("id", id_col)


def edit_trees_in_turn(trees: DataFrame, tokenizer_path: str, edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Trees after a table of edits (id, seq, start, stop, replacement), as many as a document may have: id, COUNTS, leaves, tokens.

    Only documents with edits are moved; their edits come to their tree as a stream in order of seq, so
    that a document of very many edits is one tree and never one row of edits. Rows of one id each take
    its edits. Documents without edits keep their tree.
    """
    kind = trees.schema[id_col].dataType
    named = trees.select(F.col(id_col).alias("id"), "leaves", "tokens").withColumn("row", F.sha2(F.to_json(F.struct("leaves")), 256))
    changed = edits.select(F.col(id_col).alias("id")).where("id IS NOT NULL").distinct()
    same = named.groupBy("id", "row").agg(F.count(F.lit(1)).alias("times"), F.first("leaves").alias("leaves"), F.first("tokens").alias("tokens"))
    held = same.join(changed, "id", "left_semi")
    own = edits.select(F.col(id_col).alias("id"), F.col("seq").cast("long").alias("seq"), F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "replacement").join(held.select("id", "row"), "id")
    none = lambda t: F.lit(None).cast(t)
    stream = held.select("id", "row", none("long").alias("seq"), "times", "leaves", "tokens", none("long").alias("start"), none("long").alias("stop"), none("string").alias("replacement"))
    stream = stream.union(own.select("id", "row", F.coalesce("seq", F.lit(-(1 << 62))).alias("seq"), none("long"), none("array<string>"), none("array<int>"), "start", "stop", "replacement"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        tree = doc_id = None
        times = before = n = 0
        fields = pa.schema([("id", to_arrow_type(kind)), *((c, pa.int64()) for c in COUNTS), ("leaves", _LEAVES), ("tokens", _TOKENS)])

        def told() -> pa.RecordBatch:
            leaves, counts = tree.kept()
            row = (doc_id, before, n, tree.tokens[1], tree.chars[1], tree.encoded, leaves, counts)
            return pa.RecordBatch.from_arrays([pa.array([v] * times, f.type) for v, f in zip(row, fields, strict=True)], schema=fields)

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                for row in whole.slice(at, 256).to_pylist():
                    if row["seq"] is None:
                        if tree is not None:
                            yield told()
                        tree, doc_id, times, n = TokenTree(encode, row["leaves"], row["tokens"]), row["id"], row["times"], 0
                        before = tree.tokens[1]
                    else:
                        tree.edit(row["start"] or 0, row["stop"] or 0, row["replacement"] or "")
                        n += 1
        if tree is not None:
            yield told()

    schema = f"id {kind.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS) + f", {TREE}"
    edited = stream.repartition("id", "row").sortWithinPartitions("id", "row", F.col("seq").asc_nulls_first()).mapInArrow(work, schema)
    total = F.aggregate("tokens", F.lit(0).cast("long"), lambda s, x: s + x)
    chars = F.aggregate("leaves", F.lit(0).cast("long"), lambda s, x: s + F.length(x))
    zero = F.lit(0).cast("long")
    rest = trees.select(F.col(id_col).alias("id"), "leaves", "tokens").join(changed, "id", "left_anti")
    kept = rest.select("id", total.alias("n_before"), zero.alias("n_edits"), total.alias("n_tokens"), chars.alias("n_chars"), zero.alias("n_encoded"), "leaves", "tokens")
    return edited.union(kept).withColumnRenamed("id", id_col)


def attach_edits(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs with a column `edits`: their few edits (id, seq, start, stop, replacement) in order, empty without any.

    All edits of a document become one array; `edit_trees_in_turn` takes as many as there may be.
    """
    each = edits.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("seq", "start", "stop", "replacement"))).alias("edits"))
    plain = each.select(id_col, F.transform("edits", lambda e: F.struct(e["start"].cast("long").alias("start"), e["stop"].cast("long").alias("stop"), e["replacement"].alias("replacement"))).alias("edits"))
    return docs.drop("edits").join(plain, id_col, "left")


def count_tokens_after_edits(docs: DataFrame, tokenizer_path: str, edits: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and COUNTS, by trees that are built, written and then edited.

    edits: as for `edit_trees`, an expression over docs. An empty table gives an empty result.
    """
    staged = Staged(docs.sparkSession, "token-trees")
    typed = edits.cast("array<struct<start:bigint,stop:bigint,replacement:string>>")
    trees = staged.write(build_trees(docs, tokenizer_path, id_col, text_col, {"edits_to_make": typed}))
    return edit_trees(trees, tokenizer_path, trees["edits_to_make"], id_col, with_trees=False)


def sample_edits(doc_id: Column, text: Column) -> Column:
    """Three edits of a document at places that its id decides: a deletion, an insertion, a replacement."""
    size = F.length(F.coalesce(text, F.lit(""))).cast("long") + 1

    def place(seed: int) -> Column:
        return F.pmod(F.xxhash64(doc_id, F.lit(seed)), size)

    kinds = [(1, 12, ""), (2, 0, " some more words, "), (3, 5, "re")]
    return F.array(*[F.struct(place(s).alias("start"), (place(s) + width).alias("stop"), F.lit(new).alias("replacement")) for s, width, new in kinds])
