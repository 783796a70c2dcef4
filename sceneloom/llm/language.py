"""Language identification, words first and shorter and shorter character n-grams after (operator 3)."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneloom.llm.bytesnp import Spans, segment_hashes
from sceneloom.llm.shared import crc_remainder, documents

#: n-grams that unseen words fall back to, longest first.
ORDERS = (5, 4, 3, 2, 1)
#: About so many labelled rows of each language are learned from; every word and n-gram in them is kept.
SAMPLE_ROWS = 5_000
_BLOCK_CHARS = 1 << 18
_letters: list[np.ndarray] = []


def _letter() -> np.ndarray:
    if not _letters:
        table = np.zeros(sys.maxunicode + 1, bool)
        for plane in range(0, sys.maxunicode + 1, 1 << 16):
            table[plane : plane + (1 << 16)] = [chr(c).isalpha() for c in range(plane, min(plane + (1 << 16), sys.maxunicode + 1))] if plane < 0x40000 else False
        _letters.append(table)
    return _letters[0]


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > _BLOCK_CHARS:
            yield start, i
            start, size = i, 0
        size += len(t or "")
    if start < len(texts):
        yield start, len(texts)


@dataclass
class Words:
    """The words of some texts: runs of letters in lower case, each once, with the hashes of the n-grams of all characters."""

    texts: list[str | None]
    spans: Spans = field(init=False)

    def __post_init__(self) -> None:
        low = [(t or "").lower() for t in self.texts]
        chars = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letter()[chars]
        edge = np.diff(letter.astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
        begins = 1 + np.concatenate([[0], np.cumsum([len(t) + 1 for t in low])[:-1]]) if low else np.zeros(0, np.int64)
        self.doc = np.searchsorted(begins, starts, "right") - 1
        self.spans = Spans(np.where(letter, chars, 0))  # 0 stands for what is not a letter
        self.key, first, self.of = np.unique(segment_hashes(chars, starts, ends), return_index=True, return_inverse=True)
        self.start, self.end = starts[first], ends[first]

    def grams(self, which: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(keys, owner): the n-grams of the words ``which`` with one edge on either side; ``owner`` counts along ``which``."""
        per_word = np.maximum(0, self.end[which] - self.start[which] + 2 - n + 1)
        owner = np.repeat(np.arange(len(which)), per_word)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(per_word) - per_word, per_word) + self.start[which][owner] - 1
        return self.spans.every(n)[at], owner


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each word (order 0) and n-gram occurs in each language."""
    for batch in batches:
        texts, langs = batch["text"].to_pylist(), np.array(batch["lang"].to_pylist(), object)
        for a, b in _blocks(texts):
            words = Words(texts[a:b])
            if not len(words.key):
                continue
            names, lang = np.unique(langs[a:b].astype(str), return_inverse=True)
            often = np.zeros((len(words.key), len(names)), np.int64)
            np.add.at(often, (words.of, lang[words.doc]), 1)
            for n in (0, *ORDERS):
                if n:
                    grams, owner = words.grams(np.arange(len(words.key)), n)
                    if not len(grams):
                        continue
                    key, of = np.unique(grams, return_inverse=True)
                    count = np.zeros((len(key), len(names)), np.int64)
                    np.add.at(count, of, often[owner])
                else:
                    key, count = words.key, often
                i, j = np.nonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), n, np.int32)), pa.array(key[i].view(np.int64)), pa.array(names[j].tolist(), pa.string()), pa.array(count[i, j])], names=["n", "key", "lang", "often"])


@dataclass
class Model:
    """Per order (0: words) ascending keys and the log frequency of each in each language; log priors."""

    langs: list[str]
    prior: np.ndarray
    keys: dict[int, np.ndarray]
    logs: dict[int, np.ndarray]

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text and how much of the probability it has; und and 0 without letters."""
        langs: list[str] = []
        share = np.zeros(len(texts))
        for a, b in _blocks(texts):
            words = Words(texts[a:b])
            value = np.zeros((len(words.key), len(self.langs)))
            left = np.arange(len(words.key))
            for n in (0, *ORDERS):
                if not len(left) or not len(self.keys[n]):
                    continue
                grams, owner = (words.key[left], np.arange(len(left))) if not n else words.grams(left, n)
                at = np.searchsorted(self.keys[n], grams)
                at[at == len(self.keys[n])] = 0
                known = self.keys[n][at] == grams
                hits = np.bincount(owner[known], minlength=len(left))
                for lang in range(len(self.langs)):
                    total = np.bincount(owner[known], self.logs[n][at[known], lang], minlength=len(left))
                    value[left, lang] += np.where(hits > 0, total / np.maximum(hits, 1), 0)
                left = left[hits == 0]
            n_docs = b - a
            total = np.stack([np.bincount(words.doc, value[words.of, lang], minlength=n_docs) for lang in range(len(self.langs))], axis=1) if self.langs else np.zeros((n_docs, 0))
            some = np.bincount(words.doc, minlength=n_docs) > 0
            if self.langs:
                total = total + self.prior
                part = np.exp(total - total.max(axis=1, keepdims=True))
                share[a:b] = np.where(some, part.max(axis=1) / part.sum(axis=1), 0)
                langs += [self.langs[j] if ok else "und" for j, ok in zip(total.argmax(axis=1), some, strict=True)]
            else:
                langs += ["und"] * n_docs
        return langs, share


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of the rows of ``labelled`` (doc_id, text, lang) with text and lang.

    Of each language about ``sample_rows`` of them are used, chosen by a hash of doc_id, so that a
    rare language has all its rows in it.  Counting is done by Spark; the driver gets a row
    for each word and n-gram of the sample, with its count in each language.
    """
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    there = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(there)
    if not langs:
        return Model([], np.zeros(0), {n: np.zeros(0, np.uint64) for n in (0, *ORDERS)}, {n: np.zeros((0, 0)) for n in (0, *ORDERS)})
    bound = F.create_map(*[F.lit(x) for lang in langs for x in (lang, math.ceil(1_000_000 * min(1.0, sample_rows / there[lang])))])
    used = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < bound[F.col("lang")])
    counts = used.select("text", "lang").mapInArrow(_count_rows, "n int, key long, lang string, often long")
    table = counts.groupBy("n", "key").agg(*[F.sum(F.when(F.col("lang") == lang, F.col("often")).otherwise(0)).alias(f"often_{i}") for i, lang in enumerate(langs)]).toArrow()
    order_of, key = table["n"].to_numpy(), table["key"].to_numpy().view(np.uint64)
    count = np.stack([table[f"often_{i}"].to_numpy().astype(float) for i in range(len(langs))], axis=1).reshape(len(key), len(langs))
    keys, logs = {}, {}
    for n in (0, *ORDERS):
        own = np.flatnonzero(order_of == n)
        own = own[np.argsort(key[own])]
        keys[n] = key[own]
        logs[n] = np.log((count[own] + 0.5) / (count[own].sum(axis=0) + 0.5 * max(1, len(own))))
    sums = count[order_of == 0].sum(axis=0)
    return Model(langs, np.log((sums + 1) / (sums.sum() + len(langs))), keys, logs)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for each row of ``docs`` (doc_id, text); a text that is null or has no letter is ``und``, 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, share = shared.value.score(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(langs, pa.string()), pa.array(share)], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.where(crc_remainder(F.col("doc_id")) != 2))
    return predict(docs, model).select("doc_id", (crc_remainder(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score")
