"""Packing of documents into batches by optimal length buckets (operator 5).

The histogram of lengths over all documents decides the buckets: dynamic programming finds
the bounds with the least padding, when every document is padded to its bucket's bound.
In each bucket, batches of as many documents as the token budget allows are formed, in the order of
doc_id.  A document's place in its bucket is counted in two steps (places within ranges of ids, and the
documents of the ranges before), so that no bucket has to be in one task.

Any column of lengths will do.  The query counts words, which SQL can count, too; for batches
of model tokens give ``pack`` the number of ids that operator 6 finds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sceneloom.llm.bytesnp import text_blocks, words
from sceneloom.llm.shared import cut, documents, fresh, others

#: Tokens (of whatever kind the lengths count) of a batch, padding included; a longer document is a batch of its own.
TOKEN_BUDGET = 65_536
#: Buckets at most.
BUCKETS = 16
_NO_ID = -(1 << 63)


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [np.bincount(words(data, offsets)[2], minlength=end - start) for start, end, data, offsets in text_blocks(batch["text"])]
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64())], names=[*names, "n_words"])


def word_lengths(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and n_words (words between blanks and 0x09-0x0D, 0 for null) of each row of ``docs`` (doc_id, text)."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return keyed.mapInArrow(_word_rows, T.StructType([docs.schema["doc_id"], T.StructField("text_key", T.LongType()), T.StructField("n_words", T.LongType())]))


def _first_least(n: int, cost) -> np.ndarray:
    """For each j below ``n`` the first i <= j of least ``cost(i, j)``, a Monge cost: these ascend with j.

    All middles of a round are looked at together, each between what was found for its
    neighbours of the rounds before: O(n) memory, and O(n) costs in each of log n rounds.
    """
    found = np.zeros(n, np.int64)
    begin, end = np.zeros(1, np.int64), np.full(1, n)  # the open ranges of j, and of i, ends included
    low, high = np.zeros(1, np.int64), np.full(1, n - 1)
    while len(begin):
        middle = (begin + end) // 2
        size = np.minimum(high, middle) - low + 1
        at = np.cumsum(size) - size
        i = np.arange(int(size.sum())) + np.repeat(low - at, size)
        costs = cost(i, np.repeat(middle, size))
        equal = np.flatnonzero(costs == np.repeat(np.minimum.reduceat(costs, at), size))
        found[middle] = i[equal[np.searchsorted(equal, at)]]
        begin, end = np.concatenate([begin, middle + 1]), np.concatenate([middle, end])
        low, high = np.concatenate([low, found[middle]]), np.concatenate([found[middle], high])
        some = begin < end
        begin, end, low, high = begin[some], end[some], low[some], high[some]
    return found


def bucket_bounds(lengths: list[int], counts: list[int], buckets: int = BUCKETS) -> tuple[list[int], int]:
    """(bounds, padding): at most ``buckets`` upper bounds, ascending, with the least sum of bound - length over all documents.

    ``lengths`` ascends.  Of bounds that are equally good, those whose last bucket begins earliest are taken.
    """
    n = len(lengths)
    if not n:
        return [], 0
    x, c = np.array(lengths, np.int64), np.array(counts, np.int64)
    number, tokens = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(c * x)])
    least = np.full(n + 1, np.iinfo(np.int64).max // 4)
    least[0] = 0
    cuts = []

    def cost(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        # the last bucket has lengths i..j and is bounded by the longest of them
        return least[i] + x[j] * (number[j + 1] - number[i]) - (tokens[j + 1] - tokens[i])

    at = np.arange(n)
    for _ in range(min(buckets, n)):
        where = _first_least(n, cost)
        cuts.append(where)
        least = np.concatenate([[0], cost(where, at)])
    bounds, j = [], n
    for where in reversed(cuts):
        if not j:
            break
        bounds.append(int(x[j - 1]))
        j = int(where[j - 1])
    return bounds[::-1], int(least[n])


_MADE = ("n_tokens", "bucket", "padded_length", "batch_id", "batch_row", "batch_rows")


def pack(docs: DataFrame, length: Column, budget: int = TOKEN_BUDGET, buckets: int = BUCKETS, tie: Column | None = None) -> DataFrame:
    """Every row of ``docs`` with n_tokens, bucket, padded_length, batch_id, batch_row and batch_rows.

    n_tokens is ``length`` (null counts as 0).  batch_id is unique
    among all batches of a bucket; batch_row counts from 0.  A batch has at most
    ``budget`` / padded_length rows, or one if the bound is larger than the budget.  The
    order within a bucket is that of doc_id (null first), then of ``tie``, and any for
    rows that repeat both.  The driver gets the exact histogram, a row for each distinct length (n lengths of words need
    n * n / 2 words at least).  Columns with the six names above are replaced; others pass through, whatever they are called.
    """
    own = others(docs, *_MADE)
    row_id, row_tie, row_any, part, before, whole, fit, place = fresh(docs, *_MADE, "row_id", "row_tie", "row_any", "part", "before", "whole", "fit", "place")[len(_MADE) :]
    sized = docs.select(*own, F.coalesce(length.cast("long"), F.lit(0)).alias("n_tokens"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias(row_id), (F.lit(0) if tie is None else tie).alias(row_tie), F.rand(5).alias(row_any))
    histogram = sized.groupBy(F.col("n_tokens").alias("length")).agg(F.count(F.lit(1)).alias("docs")).orderBy("length").collect()
    bounds, _ = bucket_bounds([r["length"] for r in histogram], [r["docs"] for r in histogram], buckets)
    limits = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast(T.ArrayType(T.LongType()))
    placed = sized.withColumn("bucket", F.size(F.filter(limits, lambda b: b < F.col("n_tokens")))).withColumn("padded_length", F.element_at(limits, F.col("bucket") + 1))
    order = [row_id, row_tie, row_any]
    placed = cut(placed.repartitionByRange("bucket", *order).withColumn(part, F.spark_partition_id()))
    ranges = placed.groupBy("bucket", part).agg(F.count(F.lit(1)).alias("docs"))  # as many rows as buckets and tasks, about
    behind = Window.partitionBy("bucket").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("bucket", part, F.coalesce(F.sum("docs").over(behind), F.lit(0)).alias(before), F.sum("docs").over(Window.partitionBy("bucket")).alias(whole))
    nth = F.row_number().over(Window.partitionBy("bucket", part).orderBy(*order)) - 1 + F.col(before)
    fits = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("padded_length"), F.lit(1)))).cast("long")
    div = F.floor(F.col(place) / F.col(fit)).cast("long")
    return (
        placed.join(cut(ranges), ["bucket", part]).withColumn(place, nth).withColumn(fit, fits)
        .select(*own, "n_tokens", "bucket", "padded_length", div.alias("batch_id"), (F.col(place) % F.col(fit)).cast("long").alias("batch_row"), F.least(F.col(fit), F.col(whole) - div * F.col(fit)).alias("batch_rows"))
    )


def packed_words(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) packed by their words, without their texts."""
    return pack(cut(word_lengths(docs)), F.col("n_words"), tie=F.col("text_key")).drop("text_key", "n_words")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return packed_words(documents(spark, sf_dir))


#: For tables without repeated ids.
SQL = """
WITH RECURSIVE t AS (SELECT doc_id, CAST(len([w for w in string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+') if w <> '']) AS BIGINT) AS n_tokens FROM documents),
h AS (SELECT n_tokens AS x, count(*) AS c FROM t GROUP BY n_tokens),
u AS (SELECT row_number() OVER (ORDER BY x) AS i, x, sum(c) OVER (ORDER BY x) AS n, sum(c * x) OVER (ORDER BY x) AS s FROM h UNION ALL SELECT 0, 0, 0, 0),
m AS (SELECT least(16, max(i)) AS levels, max(i) AS last FROM u),
d(k, j, cost, p) AS (SELECT 0, CAST(0 AS BIGINT), CAST(0 AS HUGEINT), CAST(0 AS BIGINT) UNION ALL
  SELECT k + 1, i, min(cost), arg_min(j, (cost, j)) FROM (SELECT d.k, e.i, d.j, d.cost + e.x * (e.n - b.n) - (e.s - b.s) AS cost FROM d JOIN u b ON d.j = b.i JOIN u e ON d.j < e.i OR (d.j = 0 AND e.i = 0) WHERE d.k < (SELECT levels FROM m)) GROUP BY k, i),
z(k, j) AS (SELECT levels, last FROM m UNION ALL SELECT z.k - 1, d.p FROM z JOIN d ON z.k = d.k AND z.j = d.j WHERE z.k > 0),
o AS (SELECT list(x ORDER BY x) AS bounds FROM (SELECT DISTINCT x FROM z JOIN u ON z.j = u.i WHERE z.j > 0)),
a AS (SELECT doc_id, n_tokens, len([b for b in bounds if b < n_tokens]) AS bucket, bounds FROM t, o),
f AS (SELECT doc_id, n_tokens, bucket, bounds[bucket + 1] AS padded_length, row_number() OVER (PARTITION BY bucket ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY bucket) AS docs, greatest(1, 65536 // greatest(bounds[bucket + 1], 1)) AS fit FROM a)
SELECT doc_id, n_tokens, CAST(bucket AS INTEGER) AS bucket, CAST(padded_length AS BIGINT) AS padded_length, CAST(place // fit AS BIGINT) AS batch_id, CAST(place % fit AS BIGINT) AS batch_row, CAST(least(fit, docs - place // fit * fit) AS BIGINT) AS batch_rows FROM f
"""
