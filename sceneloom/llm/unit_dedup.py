"""Removal of repeated lines or paragraphs, with the offsets of what goes (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sceneloom.llm.shared import checked_broadcast, cut, documents, fresh, others

#: Characters that a normalised unit has at least to be compared: all but blank ones are.
MIN_CHARS = 1
SEPARATORS = {"line": "\n", "paragraph": "\n\n"}
_NO_ID = -(1 << 63)


def normalised(unit: Column) -> Column:
    """A-Z in lower case, white space within the unit as single blanks, none at its ends."""
    return F.trim(F.regexp_replace(F.translate(unit, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[ \\t\\n\\x0B\\f\\r]+", " "))


def drop_repeated_units(docs: DataFrame, unit: str = "line", min_chars: int = MIN_CHARS) -> DataFrame:
    """Every row of ``docs`` with n_units, removed (array of unit number from 1, start, end) and kept_text.

    Units are what stands between line feeds (``line``) or double line feeds
    (``paragraph``); start and end are offsets of the removed unit in the input text, in
    code points, end excluded.  Units are compared by SHA-256 of their normal form, if that has ``min_chars``
    characters at least (blank units are never compared and stay).  Of equal units the earliest stays, by ascending doc_id (null first), a hash of the
    text, and place in it; the others go, and what stays is joined by the separator
    again.  A null text has no units and stays null.  Rows that repeat id and text are
    one document.  Columns with the three names above are replaced; others pass through, whatever they are called.
    """
    sep = SEPARATORS[unit]
    own = others(docs, "n_units", "removed", "kept_text")
    row_id, row_text, gone = fresh(docs, "row_id", "row_text", "gone")
    keyed = docs.select(*own, F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias(row_id), F.xxhash64("text").alias(row_text))
    rows = keyed.where("text IS NOT NULL").select(F.col(row_id).alias("row_id"), F.col(row_text).alias("row_text"), "text")
    units = cut(
        rows.select("row_id", "row_text", F.posexplode(F.split("text", sep)).alias("at", "own"))
        .select("row_id", "row_text", (F.col("at") + 1).alias("at"), normalised(F.col("own")).alias("norm"))
        .where(F.length("norm") >= max(1, min_chars)).select("row_id", "row_text", "at", F.unhex(F.sha2("norm", 256)).alias("digest"))
    )
    place = F.struct("row_id", "row_text", "at")
    first = units.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("often")).where("often > 1")
    later = units.join(checked_broadcast(cut(first.drop("often"))), "digest").where(place != F.col("first"))
    later = cut(later.groupBy(F.col("row_id").alias(row_id), F.col("row_text").alias(row_text)).agg(F.sort_array(F.collect_set("at")).alias(gone)))
    joined = keyed.join(checked_broadcast(later, entries=F.size(gone)), [row_id, row_text], "left").select(*own, gone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = [_without(t, g, sep) for t, g in zip(batch["text"].to_pylist(), batch[gone].to_pylist(), strict=True)]
            spans = pa.array([[{"unit": u, "start": a, "end": b} for u, a, b in c[1]] for c in cuts], pa.list_(pa.struct([("unit", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in own), pa.array([c[0] for c in cuts], pa.int32()), spans, pa.array([c[2] for c in cuts], pa.string())], names=[*own, "n_units", "removed", "kept_text"])

    return joined.mapInArrow(run, T.StructType([*docs.select(*own).schema.fields, *T._parse_datatype_string("n_units int, removed array<struct<unit:int,start:int,end:int>>, kept_text string").fields]))


def _without(text: str | None, gone: list[int] | None, sep: str) -> tuple[int, list[tuple[int, int, int]], str | None]:
    """Units of a text, the removed ones as (number, start, end), and the text without them."""
    if text is None:
        return 0, [], None
    parts = text.split(sep)
    if not gone:
        return len(parts), [], text
    out, spans, kept, at = set(gone), [], [], 0
    for i, part in enumerate(parts, 1):
        spans.append((i, at, at + len(part))) if i in out else kept.append(part)
        at += len(part) + len(sep)
    return len(parts), spans, sep.join(kept)


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Repeated lines, as the SQL has them: a repeated passage that begins or ends within a line loses only the whole lines in it, and short lines repeat by chance in documents without one (see README)."""
    out = drop_repeated_units(documents(spark, sf_dir).select("doc_id", "text"))
    spans = F.array_join(F.transform("removed", lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ",")
    return out.select("doc_id", F.col("n_units").cast("long").alias("n_units"), F.size("removed").cast("long").alias("n_removed"), spans.alias("removed_spans"), "kept_text")


SQL = """
WITH u AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, i AS nr, parts[i] AS own, i - 1 + coalesce(list_sum([length(x) for x in list_slice(parts, 1, i - 1)]), 0) AS start
      FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM u)),
n AS (SELECT *, trim(regexp_replace(translate(own, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), ' ') AS norm FROM p),
r AS (SELECT doc_id, nr, start, own, (length(norm) >= 1 AND row_number() OVER (PARTITION BY norm ORDER BY doc_id, nr) > 1) AS gone FROM n),
g AS (SELECT doc_id, count(*) AS n_units, count(*) FILTER (gone) AS n_removed,
             coalesce(string_agg(CAST(CAST(start AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(start + length(own) AS BIGINT) AS VARCHAR), ',' ORDER BY nr) FILTER (gone), '') AS removed_spans,
             coalesce(string_agg(own, chr(10) ORDER BY nr) FILTER (NOT gone), '') AS kept_text FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(g.n_units, 0) AS BIGINT) AS n_units, CAST(coalesce(g.n_removed, 0) AS BIGINT) AS n_removed, coalesce(g.removed_spans, '') AS removed_spans, g.kept_text
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""
