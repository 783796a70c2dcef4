"""Byte-pair encoding and decoding with a public tokenizer file (operator 6).

A short word is held as a contiguous array of parts and of the ranks of its adjacent
pairs: the least rank is looked for, its boundary deleted and the two neighbouring ranks
are refreshed, until no pair has a rank.  Words beyond ``SHORT`` bytes do the same with a
heap of pairs, so that a text without a blank takes n log n steps.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sceneloom.llm.shared import documents, others

#: Words of more bytes than this are merged with a heap.
SHORT = 128
#: Units (a word with what clings to it) and words whose ids a task remembers; twice, as the last generation is kept.
UNITS = 150_000
_NONE = 1 << 40

# Fixed value: the split of the byte-level tokenizer family before its merges.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a vocabulary: printable Latin-1 for itself, the others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """The ids of texts and the bytes of ids, after a tokenizers JSON file of byte-level BPE."""

    def __init__(self, file: bytes) -> None:
        spec = json.loads(file)
        letter, vocab = _byte_letters(), spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of = {i: bytes(letter[c] for c in token) for token, i in vocab.items() if token not in self.special}
        self.bytes_of |= {i: token.encode() for token, i in self.special.items()}
        self.single = [0] * 256
        for i, own in self.bytes_of.items():
            if len(own) == 1:
                self.single[own[0]] = i
        self.rank: dict[int, int] = {}  # of a pair of ids, left << 32 | right
        self.made: list[int] = []  # id that the merge of a rank gives
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault(vocab[left] << 32 | vocab[right], rank)
            self.made.append(vocab[left + right])
        self.split = regex.compile(_SPLIT)
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.units, self.words = _Units(self), _Words(self)
        n = max(self.bytes_of) + 1
        self.length = np.array([len(self.bytes_of.get(i, b"")) for i in range(n)], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.flat = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(n)), np.uint8)

    def word(self, own: bytes) -> list[int]:
        parts = [self.single[b] for b in own]
        if len(parts) < 2:
            return parts
        return self._short(parts) if len(parts) <= SHORT else self._long(parts)

    def _short(self, parts: list[int]) -> list[int]:
        rank = self.rank.get
        ranks = [rank(a << 32 | b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            parts[i] = self.made[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] << 32 | parts[i], _NONE)
            if i < len(ranks):
                ranks[i] = rank(parts[i] << 32 | parts[i + 1], _NONE)
        return parts

    def _long(self, parts: list[int]) -> list[int]:
        n, rank = len(parts), self.rank.get
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank(parts[i] << 32 | parts[i + 1], _NONE)) != _NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not live[i] or j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], live[j], after[i] = self.made[r], False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (q := rank(parts[x] << 32 | parts[y], _NONE)) != _NONE:
                    heapq.heappush(heap, (q, x, parts[x], parts[y]))
        return [p for p, on in zip(parts, live, strict=True) if on]

    def unit(self, text: str) -> bytes:
        if text[1:].isalpha() and (text[0] == " " or text[0].isalpha()):
            return self.words[text]
        return b"".join(map(self.words.__getitem__, self.split.findall(text)))

    def plain(self, text: str) -> bytes:
        """The ids of a text without special tokens.

        A blank before anything but white space always begins a part, so the text can be
        taken apart there; the units repeat and are remembered.
        """
        if not text:
            return b""
        first, *rest = text.split(" ")
        try:
            return (self.unit(first) if first else b"") + b"".join(map(self.units.__getitem__, rest))
        except _NotApart:
            units = [first]
            for piece in rest:
                if piece and not piece[0].isspace():
                    units.append(" " + piece)
                else:
                    units[-1] += " " + piece
            return b"".join(self.unit(u) if len(u) < 2 or u[0] != " " or u[1].isspace() else self.units[u[1:]] for u in units)

    def encode(self, text: str) -> np.ndarray:
        if self.cut is None or not any(x in text for x in self.special):
            return np.frombuffer(self.plain(text), "<u4")
        ids = [np.array([self.special[x]], "<u4").tobytes() if x in self.special else self.plain(x) for x in self.cut.split(text)]
        return np.frombuffer(b"".join(ids), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        own = ids.astype(np.int64)
        length = self.length[own]
        ends = np.cumsum(length)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.begin[own] - (ends - length), length)
        return self.flat[at].tobytes().decode("utf-8", "replace")


class _NotApart(Exception):
    pass


class _Remembered(dict):
    """Ids by text.  When it is full it becomes the last generation, from which what is still used comes back."""

    def __init__(self, codec: Codec) -> None:
        self.codec, self.last = codec, {}

    def made(self, text: str) -> bytes:
        raise NotImplementedError

    def __missing__(self, text: str) -> bytes:
        ids = self.last.get(text)
        if ids is None:
            ids = self.made(text)
        if len(text) <= 4 * SHORT:
            if len(self) >= UNITS:
                self.last = dict(self)
                self.clear()
            self[text] = ids
        return ids


class _Units(_Remembered):
    """The ids of a unit, by its text after the blank."""

    def made(self, text: str) -> bytes:
        if not text or text[0].isspace():
            raise _NotApart
        return self.codec.unit(" " + text)


class _Words(_Remembered):
    def made(self, text: str) -> bytes:
        return np.array(self.codec.word(text.encode()), "<u4").tobytes()


_codecs: dict[str, Codec] = {}


def _codec(file: bytes) -> Codec:
    """One for each Python worker and file."""
    key = hashlib.sha256(file).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec(file)
    return _codecs[key]


def token_rows(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Every row of ``docs`` with ids (array of int) and decoded (string), by the tokenizers JSON file at ``tokenizer``.

    No special tokens are added; strings of special tokens inside a text become their
    ids, as in the tokenizers library.  Null counts as empty and gives no ids.  The file
    (some MB) is read by the driver and broadcast.  Columns called ids or decoded are replaced.
    """
    own = others(docs, "ids", "decoded")
    file = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(file.value)
        for batch in batches:
            step = 256
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                ids = [codec.encode(t or "") for t in part["text"].to_pylist()]
                arrays = [*(part[c] for c in own), pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())), pa.array([codec.decode(i) for i in ids], pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*own, "ids", "decoded"])

    schema = T.StructType([*docs.select(*own).schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return docs.select(*own).mapInArrow(run, schema)


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bounds = batch["ids"].offsets.to_numpy()
        held = memoryview(np.ascontiguousarray(batch["ids"].values.to_numpy(), "<u4")).cast("B")
        sums = [hashlib.sha256(held[4 * a : 4 * b]).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.diff(bounds), pa.int64()), pa.array(sums, pa.string()), batch["decoded_sha256"]], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def token_digests(rows: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit numbers), decoded_sha256 of what ``token_rows`` gives."""
    digests = rows.select("doc_id", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))
    return digests.mapInArrow(_digest_rows, T.StructType([rows.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]))


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_digests(token_rows(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json")))
