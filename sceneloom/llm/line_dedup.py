"""Removal of repeated windows of three consecutive lines (operator 7)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sceneloom.llm.bytesnp import text_blocks
from sceneloom.llm.shared import checked_broadcast, cut, documents, fresh, others

#: Consecutive lines in a window.
WINDOW = 3
_NO_ID = -(1 << 63)


def _window_rows(window: int):
    """A row for each ``window`` consecutive lines of a text: SHA-256 of their bytes, and the number of the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, _, data, offsets in text_blocks(batch["text"]):
                breaks = np.flatnonzero(data == 10)
                begin = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
                doc = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(breaks, offsets)) + 1)
                # an empty text and the line after a final line feed begin where the next text begins; sorting by place keeps texts in order
                last = np.append(doc[1:] != doc[:-1], True)
                end = np.where(last, offsets[doc + 1], np.append(begin[1:], 0) - 1)
                first = np.flatnonzero(doc[: len(doc) - window + 1] == doc[window - 1 :]) if len(doc) >= window else np.zeros(0, np.int64)
                if not len(first):
                    continue
                line = first - np.searchsorted(doc, doc[first]) + 1
                row = pa.array(doc[first] + start)
                held = memoryview(data)
                digests = [hashlib.sha256(held[a:b]).digest() for a, b in zip(begin[first].tolist(), end[first + window - 1].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), batch["row_id"].take(row), batch["row_text"].take(row), pa.array(line.astype(np.int32))], names=["digest", "row_id", "row_text", "line"])

    return run


def drop_repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every row of ``docs`` with n_lines, removed_lines (numbers from 1, ascending) and kept_text.

    Lines are split at line feeds, and windows compared by SHA-256 of their bytes.
    Every ``window`` consecutive lines of a text are a window (so windows overlap); a text of
    fewer lines has none and is left as it is, and so is a null text (n_lines 0, kept_text
    null).  Of equal windows the first stays, by ascending doc_id (null first), a hash of
    the text, and line; lines that any later one covers go, and what stays is joined by
    line feeds again.  All windows are judged on the input.  Rows that repeat id and text
    are one document.  Columns with the three names above are replaced; others pass through, whatever they are called.
    """
    own = others(docs, "n_lines", "removed_lines", "kept_text")
    row_id, row_text, gone = fresh(docs, "row_id", "row_text", "gone")
    keyed = docs.select(*own, F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias(row_id), F.xxhash64("text").alias(row_text))
    texts = keyed.where("text IS NOT NULL").select(F.col(row_id).alias("row_id"), F.col(row_text).alias("row_text"), "text")
    windows = cut(texts.mapInArrow(_window_rows(window), "digest binary, row_id long, row_text long, line int"))
    place = F.struct("row_id", "row_text", "line")
    first = windows.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("often")).where("often > 1")
    later = windows.join(checked_broadcast(cut(first.drop("often"))), "digest").where(place != F.col("first"))
    covered = later.select("row_id", "row_text", F.explode(F.sequence(F.col("line"), F.col("line") + (window - 1))).alias("line"))
    covered = cut(covered.groupBy(F.col("row_id").alias(row_id), F.col("row_text").alias(row_text)).agg(F.sort_array(F.collect_set("line")).alias(gone)))
    joined = keyed.join(checked_broadcast(covered, entries=F.size(gone)), [row_id, row_text], "left").select(*own, gone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines = batch["text"].to_pylist(), [g or [] for g in batch[gone].to_pylist()]
            n = [0 if t is None else t.count("\n") + 1 for t in texts]
            kept = [_without(t, set(g)) if g else t for t, g in zip(texts, lines, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in own), pa.array(n, pa.int32()), pa.array(lines, pa.list_(pa.int32())), pa.array(kept, pa.string())], names=[*own, "n_lines", "removed_lines", "kept_text"])

    return joined.mapInArrow(run, T.StructType([*docs.select(*own).schema.fields, T.StructField("n_lines", T.IntegerType()), T.StructField("removed_lines", T.ArrayType(T.IntegerType())), T.StructField("kept_text", T.StringType())]))


def _without(text: str, gone: set[int]) -> str:
    return "\n".join(line for i, line in enumerate(text.split("\n"), 1) if i not in gone)


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = drop_repeated_windows(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("removed_lines").cast("long").alias("n_removed"), F.array_join("removed_lines", ",").alias("removed_lines"), "kept_text")


SQL = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, i AS line, list_slice(lines, i, i + 2) AS key FROM (SELECT doc_id, lines, unnest(range(1, len(lines) - 1)) AS i FROM l)),
r AS (SELECT doc_id, line, row_number() OVER (PARTITION BY key ORDER BY doc_id, line) AS nth FROM w),
c AS (SELECT doc_id, list_sort(list_distinct(flatten(list([line, line + 1, line + 2])))) AS gone FROM r WHERE nth > 1 GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(l.lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(c.gone), 0) AS BIGINT) AS n_removed,
       coalesce(array_to_string(c.gone, ','), '') AS removed_lines,
       CASE WHEN c.gone IS NULL THEN d.text ELSE array_to_string([x[1] for x in list_zip(l.lines, range(1, len(l.lines) + 1)) if NOT list_contains(c.gone, x[2])], chr(10)) END AS kept_text
FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id LEFT JOIN c ON d.doc_id = c.doc_id
"""
