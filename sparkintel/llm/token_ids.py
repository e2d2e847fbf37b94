"""Token ids of whole texts by the tokenizers library, over Arrow batches.

A tokenizer whose steps are all local to a word (white space is dropped, nothing reaches across it)
gives a text the ids of its words in turn. For files of that pipeline, each word is looked up, and only
words not met yet are encoded: their parts, cut as the pipeline cuts them, go to the library's model,
and words of other characters than printable ASCII and Latin letters to the whole pipeline. Any other
tokenizer encodes whole texts. Tests hold all of it against encoding whole texts.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np

#: The steps for which words can be encoded one by one, and how they cut a word.
_LOCAL = {
    "normalizer": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    "pattern": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",
}
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
#: Characters that stand for bytes: those that print stand for themselves, the others follow from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: b if b in _PRINTED else 256 + sum(x not in _PRINTED for x in range(b)) for b in range(256)}
_GROUP = 1 << 20


def _is_local(path: str) -> bool:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
    return (
        (spec.get("normalizer") or {}).get("normalizers") == _LOCAL["normalizer"]
        and steps[0].get("pattern") == {"Regex": _LOCAL["pattern"]} and steps[0].get("behavior") == "Removed" and steps[0].get("invert") is True
        and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
        and spec["model"].get("type") == "BPE" and spec.get("post_processor") is None
    )


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class _Codes(dict):
    """A number for each word; new words are noted."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        return self.setdefault(word, len(self))


class WordEncoder:
    """Ids of texts; holds those of about `most` words and twice as many parts of words, then starts anew with either."""

    def __init__(self, path: str, most: int = 250_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.local = Tokenizer.from_file(path), most, _is_local(path)
        self.model = self.tokenizer.model
        self.tails = {p.encode(): _packed(self.tokenizer.encode(p, add_special_tokens=False).ids) for p in ",."}
        self.parts: dict[str, bytes] = {}
        self._clear()

    def _clear(self) -> None:
        self.codes = _Codes()
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.words = np.zeros(1 << 14, np.int64), 0

    def _part(self, part: str) -> bytes:
        """The ids of a part as the pipeline cuts them, in lower case; packed, as very many are held."""
        ids = self.parts.get(part)
        if ids is None:
            spelled = part if part.isascii() else part.encode().decode("latin-1").translate(_BYTES)
            ids = self.parts[part] = _packed([t.id for t in self.model.tokenize(spelled)])
        return ids

    def _ids_of(self, word: bytes) -> bytes:
        """By its lower-case core and the comma or full stop that ends it: between an ASCII letter and
        either, the pipeline always cuts."""
        low = word.lower()
        tail = self.tails.get(low[-1:], b"") if low[-2:-1].isalpha() else b""
        core = low[:-1] if tail else low
        if core.isalpha():
            return self._part(core.decode()) + tail
        text = core.decode("utf-8", "replace")
        if not _PLAIN.fullmatch(text) or "<|" in text:
            return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids) + tail
        text = text.lower()
        if text.isalpha():
            return self._part(text) + tail
        return b"".join([self._part(p) for p in _PARTS.findall(text)]) + tail

    def _learn(self) -> None:
        if len(self.parts) > 2 * self.most:
            self.parts = {}
        known = [self._ids_of(w) for w in self.codes.new]
        self.codes.new = []
        lengths = np.fromiter(map(len, known), np.int64, len(known)) >> 2
        total = int(lengths.sum())
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.words + len(known) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.ids[self.used : self.used + total] = np.frombuffer(b"".join(known), np.uint32)
        self.starts[self.words + 1 : self.words + len(known) + 1] = self.used + np.cumsum(lengths)
        self.used += total
        self.words += len(known)

    def _group(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        if len(self.codes) > self.most:
            self._clear()
        parts = []
        for text in texts:
            words = text.split()
            parts.append(np.fromiter(map(self.codes.__getitem__, words), np.int32, len(words)))
        if self.codes.new:
            self._learn()
        codes = np.concatenate(parts)
        starts = self.starts[codes]
        lengths = self.starts[codes + 1] - starts
        ends = np.cumsum(lengths)
        flat = self.ids[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)]
        upto = np.r_[0, ends][np.r_[0, np.cumsum([len(p) for p in parts])]]
        yield from (flat[a:b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True))

    def encode_all(self, texts: Iterable[bytes]) -> Iterator[np.ndarray]:
        """The ids of each UTF-8 text, in turn."""
        if not self.local:
            yield from (np.array(self.tokenizer.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32) for t in texts)
            return
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= _GROUP:
                yield from self._group(group)
                group, size = [], 0
        if group:
            yield from self._group(group)

    def encode(self, text: bytes) -> np.ndarray:
        return next(self.encode_all([text]))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
