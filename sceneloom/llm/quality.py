"""Text quality by a generalised additive model with pairwise interactions (operator 10).

Each feature has a lookup table over its bins, and so has each chosen pair of features.
Training goes round the features in turn and boosts each table by a shallow tree on the
residuals; then the pairs that explain most of what is left are boosted likewise.  A score
is the logistic of the sum of the tables' entries, which numpy adds up for whole batches.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sceneloom.llm.bytesnp import SPACE, fold_ascii, mix, segment_hashes, text_blocks, words
from sceneloom.llm.shared import checked_broadcast, crc_remainder, cut, documents, others

#: About so many labelled rows are learned from; their features (some numbers each) come to the driver.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.7
FEATURES = (
    "log_bytes", "mean_word", "long_words", "short_words", "upper", "digits", "marks", "symbols", "shouts", "distinct_words", "same_as_before",
    "top_word", "no_letters", "log_lines", "log_line_bytes", "repeated_lines", "ends_in_mark", "sentence_words", "wide_letters", "repeated_pairs",
)


def _classes() -> np.ndarray:
    """Of each byte: 1 lower case, 2 upper case, 3 digit, 4 sentence mark, 5 shout, 6 symbol, 7 part of a wide character, 0 space or control."""
    kind = np.zeros(256, np.int8)
    kind[33:127] = 6
    kind[97:123], kind[65:91], kind[48:58] = 1, 2, 3
    kind[[ord(c) for c in ".,;:'\"-()"]] = 4
    kind[[ord(c) for c in "!?"]] = 5
    kind[128:] = 7
    return kind


_KIND = _classes()


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """[document, feature] of a block; a document without bytes or words has 0 where there is nothing to count."""
    n_docs = len(offsets) - 1
    size = np.diff(offsets)
    doc_of = np.repeat(np.arange(n_docs), size)
    kinds = np.bincount(doc_of * 8 + _KIND[data], minlength=8 * n_docs).reshape(n_docs, 8).astype(float)
    low = fold_ascii(data)
    start, end, doc = words(low, offsets)
    n_words = np.bincount(doc, minlength=n_docs).astype(float)
    word = segment_hashes(low, start, end)
    per = lambda weight: np.bincount(doc, weight, minlength=n_docs)
    over = lambda a, b: np.divide(a, b, out=np.zeros(n_docs), where=b > 0)
    letters = np.concatenate([[0], np.cumsum(np.isin(_KIND[data], (1, 2, 7)))])

    def distinct(key: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys of each document, and how often its most frequent one occurs."""
        if not len(key):
            return np.zeros(n_docs), np.zeros(n_docs)
        order = np.lexsort((key, owner))
        k, o = key[order], owner[order]
        head = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])]))
        often = np.diff(np.append(head, len(k)))
        top = np.zeros(n_docs)
        np.maximum.at(top, o[head], often)
        return np.bincount(o[head], minlength=n_docs).astype(float), top

    kept, top = distinct(word, doc)
    after = (doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, bool)
    same = np.concatenate([[False], after & (word[1:] == word[:-1])]) if len(word) else np.zeros(0, bool)
    pair = mix(word[:-1] * np.uint64(31) + word[1:])[after] if len(word) > 1 else word[:0]
    pairs, _ = distinct(pair, doc[:-1][after] if len(word) > 1 else doc[:0])
    breaks = np.flatnonzero(data == 10)
    edges = np.unique(np.concatenate([offsets, breaks + 1]))
    line_start, line_end = edges[:-1], edges[1:]
    full = line_end > line_start
    line_start, line_end = line_start[full], line_end[full]
    line_doc = np.searchsorted(offsets, line_start, "right") - 1
    tail = line_end - (data[line_end - 1] == 10)
    lines = np.bincount(line_doc, minlength=n_docs).astype(float)
    kept_lines, _ = distinct(segment_hashes(low, line_start, tail), line_doc)
    marked = np.isin(data[np.maximum(tail - 1, 0)], [ord(c) for c in ".!?:\""]) & (tail > line_start)
    sentences = np.bincount(doc_of[np.isin(data, [ord(c) for c in ".!?"])], minlength=n_docs).astype(float)
    solid = np.maximum(size - np.bincount(doc_of[SPACE[data]], minlength=n_docs), 0).astype(float)
    length = end - start
    return np.stack([
        np.log1p(size), over(per(length), n_words), over(per(length > 14), n_words), over(per(length <= 3), n_words), over(kinds[:, 2], kinds[:, 1] + kinds[:, 2]), over(kinds[:, 3], solid),
        over(kinds[:, 4], solid), over(kinds[:, 6], solid), over(kinds[:, 5], solid), over(kept, n_words), over(per(same), n_words), over(top, n_words),
        over(per(letters[end] == letters[start]), n_words), np.log1p(lines), np.log1p(over(size.astype(float), lines)), 1 - over(kept_lines, np.maximum(lines, 1)) - (lines == 0),
        over(np.bincount(line_doc, marked, minlength=n_docs), lines), np.log1p(over(n_words, np.maximum(sentences, 1))), over(kinds[:, 7], solid), 1 - over(pairs, np.maximum(n_words - 1, 1)) - (n_words < 2),
    ], axis=1)


def feature_matrix(column: pa.Array) -> np.ndarray:
    parts = [features(data, offsets) for _, _, data, offsets in text_blocks(column)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


@dataclass
class Model:
    """Bin edges of the features, a table for each feature and for each pair, and the constant."""

    edges: list[np.ndarray]
    single: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray]
    coarse: list[np.ndarray]  # bin of the pair tables for each bin of a feature
    base: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, len(self.edges)), np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(b), self.base)
        for f, table in enumerate(self.single):
            total += table[b[:, f]]
        for (f, g), table in self.pairs.items():
            total += table[self.coarse[f][b[:, f]], self.coarse[g][b[:, g]]]
        return 1 / (1 + np.exp(-total))


def _gain(gradient: np.ndarray, hessian: np.ndarray) -> np.ndarray:
    return gradient**2 / (hessian + 1.0)


def _shallow_tree(gradient: np.ndarray, hessian: np.ndarray, leaves: int = 3) -> np.ndarray:
    """The step of each bin of one feature: up to ``leaves`` intervals, split greedily, by Newton's rule."""
    g, h = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(hessian)])
    cuts = [0, len(gradient)]
    for _ in range(leaves - 1):
        best, where = 1e-9, None
        for a, b in itertools.pairwise(cuts):
            inner = np.arange(a + 1, b)
            if len(inner):
                gain = _gain(g[inner] - g[a], h[inner] - h[a]) + _gain(g[b] - g[inner], h[b] - h[inner]) - _gain(g[b] - g[a], h[b] - h[a])
                gain[np.minimum(h[inner] - h[a], h[b] - h[inner]) < 1.0] = 0
                if gain.max() > best:
                    best, where = float(gain.max()), int(inner[gain.argmax()])
        if where is None:
            break
        cuts = sorted([*cuts, where])
    step = np.zeros(len(gradient))
    for a, b in itertools.pairwise(cuts):
        step[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1.0)
    return step


def _shallow_quad(gradient: np.ndarray, hessian: np.ndarray) -> tuple[np.ndarray, float]:
    """The step of each cell of a pair: one cut of either axis, the best of all; and what it gains."""
    pad = lambda x: np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    g, h = pad(gradient), pad(hessian)
    n, m = gradient.shape
    if n < 2 or m < 2:
        return np.zeros_like(gradient), 0.0
    i, j = np.arange(1, n)[:, None], np.arange(1, m)[None, :]
    quads = lambda s: (s[i, j], s[i, m] - s[i, j], s[n, j] - s[i, j], s[n, m] - s[i, m] - s[n, j] + s[i, j])
    qg, qh = quads(g), quads(h)
    gain = sum(_gain(a, b) for a, b in zip(qg, qh, strict=True)) - _gain(g[n, m], h[n, m])
    a, b = np.unravel_index(int(gain.argmax()), gain.shape)
    step = np.zeros_like(gradient)
    leaf = [float(x[a, b] / (y[a, b] + 1.0)) for x, y in zip(qg, qh, strict=True)]
    step[: a + 1, : b + 1], step[: a + 1, b + 1 :], step[a + 1 :, : b + 1], step[a + 1 :, b + 1 :] = leaf
    return step, float(gain[a, b])


def train(x: np.ndarray, y: np.ndarray, bins: int = 64, coarse_bins: int = 8, n_pairs: int = 8, rounds: int = 200, rate: float = 0.1) -> Model:
    """Cyclic boosting of the tables; with no rows or one class only, the constant is all there is."""
    n_features = x.shape[1]
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(n_features)]
    coarse = [(np.arange(len(e) + 1) * coarse_bins) // max(1, len(e) + 1) for e in edges]
    model = Model(edges, [np.zeros(len(e) + 1) for e in edges], {}, coarse, float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))))
    if len(np.unique(y)) < 2:
        return model
    b = model.bins(x)
    total = np.full(len(y), model.base)
    for _ in range(rounds):
        for f in range(n_features):
            p = 1 / (1 + np.exp(-total))
            size = len(model.single[f])
            step = rate * _shallow_tree(np.bincount(b[:, f], y - p, size), np.bincount(b[:, f], p * (1 - p), size))
            model.single[f] += step
            total += step[b[:, f]]
    cells = {}
    for f, g in itertools.combinations(range(n_features), 2):
        cells[f, g] = coarse[f][b[:, f]] * coarse_bins + coarse[g][b[:, g]]

    def grid(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return tuple(np.bincount(cell, w, coarse_bins**2).reshape(coarse_bins, coarse_bins) for w in (y - p, p * (1 - p)))  # type: ignore[return-value]

    gains = {pair: _shallow_quad(*grid(cell))[1] for pair, cell in cells.items()}
    chosen = sorted(gains, key=lambda pair: (-gains[pair], pair))[:n_pairs]
    model.pairs = {pair: np.zeros((coarse_bins, coarse_bins)) for pair in chosen}
    for _ in range(rounds // 4):
        for pair in chosen:
            step = rate * _shallow_quad(*grid(cells[pair]))[0]
            model.pairs[pair] += step
            total += step.ravel()[cells[pair]]
    return model


_FEATURE_ROW = T.StructType([T.StructField("quality", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))])


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = feature_matrix(batch["text"])
        yield pa.RecordBatch.from_arrays([batch["quality"], pa.array(list(x), pa.list_(pa.float64()))], names=["quality", "x"])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of about ``sample_rows`` rows of ``labels`` (doc_id, quality 0 or 1; null is left out) and their texts, chosen by a hash of doc_id."""
    marked = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    share = min(1.0, sample_rows / max(1, labels.count()))
    used = cut(marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * share)))
    rows = docs.select("doc_id", "text").join(checked_broadcast(used), "doc_id").select("text", "quality").mapInArrow(_feature_rows, _FEATURE_ROW).collect()
    rows.sort(key=lambda r: (r["quality"], r["x"]))
    return train(np.array([r["x"] for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r["quality"] for r in rows], float))


def score_rows(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of ``docs`` with quality_score (0 to 1); a null text is scored as an empty one.  A column of that name is replaced."""
    own = others(docs, "quality_score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in own), pa.array(shared.value.score(feature_matrix(batch["text"])), pa.float64())], names=[*own, "quality_score"])

    return docs.select(*own).mapInArrow(run, T.StructType([*docs.select(*own).schema.fields, T.StructField("quality_score", T.DoubleType())]))


def learned(spark, sf_dir: str) -> Model:
    """The model of the labelled documents that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").where(crc_remainder(F.col("doc_id")) != 2)
    return fit(documents(spark, sf_dir), labels)


def op10_quality_gam(spark, sf_dir: str) -> DataFrame:
    scored = score_rows(documents(spark, sf_dir).select("doc_id", "text"), learned(spark, sf_dir))
    return scored.select("doc_id", (crc_remainder(F.col("doc_id")) == 2).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))
