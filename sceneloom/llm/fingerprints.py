"""Document fingerprints of closed syncmers, and their likeness (operator 9).

A k-mer of bytes is an anchor if its least s-mer lies at one of its edges.  That depends on
the k-mer alone, so an edit moves no anchor outside itself.  A fingerprint keeps the anchors
of least hash with their byte positions; two fingerprints are alike in the anchors that
both have at consistent positions.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sceneloom.llm.bytesnp import Spans, closed_syncmers, text_blocks
from sceneloom.llm.shared import documents, others

K, S = 14, 6
#: A text of fewer than 2 K bytes has no room for anchors; all its spans of so many bytes stand for it.
TINY = 3
#: Anchors in a fingerprint at most.
ANCHORS = 64
#: Bytes by which the distance of two matching anchors may differ from the usual distance.
SLACK = 64
_FIRST_ID = -(1 << 63)
#: A row in its bucket, the first of the next bucket, and a row that its like follows.
OWN, AHEAD, COPY = 0, 1, 2


def fingerprints(texts: list[bytes], k: int = K, s: int = S, anchors: int = ANCHORS) -> list[np.ndarray]:
    """(hash, position) rows, ascending by hash, for each text; one shorter than 2 k has its spans of ``TINY`` bytes (or itself) as anchors, an empty one has none."""
    out: list[np.ndarray] = []
    for start, end, data, offsets in text_blocks(pa.array(texts, pa.large_binary())):
        spans = Spans(data)
        inner = spans.every(s)
        starts, ends = [], []
        for d in range(end - start):
            lo, hi = int(offsets[d]), int(offsets[d + 1])
            if hi - lo < 2 * k:
                at = np.arange(max(1, hi - lo - TINY + 1) if hi > lo else 0)
                ends.append(np.minimum(lo + at + TINY, hi))
            else:
                at = closed_syncmers(inner[lo : hi - s + 1], k, s)
                if not len(at):
                    at = np.zeros(1, np.int64)
                ends.append(lo + at + k)
            starts.append(lo + at)
        values = spans.hash(np.concatenate(starts), np.concatenate(ends))  # once for the block: every call goes through all its bytes
        for d, value in enumerate(np.split(values, np.cumsum([len(at) for at in starts])[:-1])):
            value, first = np.unique((value >> np.uint64(32)).astype(np.int64), return_index=True)
            out.append(np.stack([value[:anchors], starts[d][first[:anchors]] - int(offsets[d])]))
    return out


def likeness(a: np.ndarray, b: np.ndarray, anchors: int = ANCHORS, slack: int = SLACK) -> float:
    """Of the least ``anchors`` hashes of both, the share that both have, at positions that agree but for one common shift."""
    if not a.shape[1] or not b.shape[1]:
        return float(a.shape[1] == b.shape[1])
    union = np.union1d(a[0], b[0])[:anchors]
    shared, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    seen = shared <= union[-1]
    if not seen.any():
        return 0.0
    shift = (b[1][j] - a[1][i])[seen]
    return float((np.abs(shift - np.sort(shift)[len(shift) // 2]) <= slack).sum() / len(union))


def encode(fingerprint: np.ndarray) -> str:
    """Eight hexadecimal digits of hash and eight of position for each anchor."""
    return "".join(f"{h:08x}{p:08x}" for h, p in fingerprint.T.tolist())


def _dealt_rows(heads: list[tuple[int, int]], whole: set[int], repeated: set[tuple[int, int]]):
    """Each row with its bucket; the first row of a bucket goes to the one before as well, the very first to the last.

    ``heads`` are the least (id, hash of the text) of the buckets, the least id alone of those in ``whole``.
    A row whose key is in ``repeated`` and whose text the task has had with that id is a copy: one that
    equals it follows it, so that it may go to any bucket.
    """
    first = {key[0] if key[0] in whole else key: n for n, key in enumerate(heads)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        copies: dict[tuple[int, bytes], int] = {}
        for batch in batches:
            ids = batch["doc_id"].cast(pa.int64()).to_pylist()
            rows = []
            for doc_id, digest, text in zip(ids, batch["digest"].to_pylist(), batch["text"].cast(pa.large_binary()), strict=True):
                raw = text.as_py() or b""
                packed, key = packer.compress(raw), (_FIRST_ID if doc_id is None else doc_id, digest)
                if key in repeated:
                    same = (key[0], hashlib.sha256(raw).digest())
                    nth = copies[same] = copies.get(same, -1) + 1
                    if nth:
                        rows.append(((digest + nth) % len(heads), COPY, *key, doc_id, packed))
                        continue
                rows.append((bisect_right(heads, key) - 1, OWN, *key, doc_id, packed))
                ahead = first.get(key[0] if key[0] in whole else key)
                if ahead is not None:
                    rows.append(((ahead - 1) % len(heads), AHEAD, *key, doc_id, packed))
            columns = zip(*rows, strict=True) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "kind", "sort_id", "digest", "doc_id", "packed"])

    return run


def _edited_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpacker, held, size, start = zstandard.ZstdDecompressor(), [], 0, 0
    for batch in batches:
        for row in zip(*(batch[c].to_pylist() for c in ("bucket", "kind", "doc_id", "packed")), strict=True):
            held.append((*row[:3], unpacker.decompress(row[3]).decode()))
            size += len(held[-1][3])
            if size > 1 << 20:
                yield _compared(held, start)
                held, size, start = held[-1:], 0, 1
    if held:
        yield _compared(held, start)


def _compared(rows: list[tuple[int, int, int | None, str]], start: int) -> pa.RecordBatch:
    """Copies, compared with themselves, and the rows that are followed by a row of the same bucket that is no copy, compared with that; both with their edited texts."""
    own = fingerprints([r[3].encode() for r in rows])
    after = {i: i + 1 for i in range(len(rows) - 1) if rows[i][0] == rows[i + 1][0] and rows[i][1] == OWN and rows[i + 1][1] != COPY}
    after |= {i: i for i in range(start, len(rows)) if rows[i][1] == COPY}
    pairs, edited = sorted(after), []
    for i in pairs:
        text, moved = rows[i][3], len(rows[i][3]) // 4
        edited.append((text[: len(text) - moved] + rows[after[i]][3][:moved]).encode())
    other = fingerprints(edited)
    return pa.RecordBatch.from_arrays([
        pa.array([rows[i][2] for i in pairs], pa.int64()), pa.array([len(rows[i][3]) for i in pairs], pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
        pa.array([encode(own[i]) for i in pairs], pa.string()), pa.array([encode(e) for e in other], pa.string()),
        pa.array([likeness(own[i], e) for i, e in zip(pairs, other, strict=True)], pa.float64()), pa.array([likeness(own[i], own[after[i]]) for i in pairs], pa.float64()),
    ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def fingerprint_rows(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` with ``fingerprint`` (string); null counts as empty, whose fingerprint is ''.  A column of that name is replaced."""
    own = others(docs, "fingerprint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [encode(f) for f in fingerprints([t.as_py() or b"" for t in batch["text"].cast(pa.large_binary())])]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in own), pa.array(made, pa.string())], names=[*own, "fingerprint"])

    return docs.select(*own).mapInArrow(run, T.StructType([*docs.select(*own).schema.fields, T.StructField("fingerprint", T.StringType())]))


def edit_likeness(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row.

    The edited text has the last quarter of the code points (rounded down) replaced by as
    many from the start of the next row's text, in ascending doc_id (null first; rows that
    share an id in an order that their texts fix; after the last row comes the first).  A
    null text counts as empty; two empty texts have likeness 1, an empty and another 0.

    Rows are dealt to ranges of ids whose heads are quantiles; the driver sees those heads
    only.  An id (or null) that fills several ranges is dealt to ranges of its texts' hashes, and of
    a text that fills several of these all but one a task go anywhere, as their like follows them.
    The texts are shuffled once, compressed.  Ids beyond 2^53 are exact, too, but share a range if they are one as doubles.
    """
    dealt = _dealt(docs, buckets or 4 * max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "kind", "sort_id", "digest", "packed").mapInArrow(
        _edited_rows, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


def _dealt(docs: DataFrame, n: int) -> DataFrame:
    """The rows in about ``n`` buckets; see ``_dealt_rows``."""
    marks = [i / n for i in range(1, n)] or [0.5]
    # quantiles are taken as doubles: digests have 52 bits
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 12).alias("digest"))
    ids = keyed.select(F.coalesce("doc_id", F.lit(_FIRST_ID)).alias("doc_id"), "digest")
    drawn = ids.agg(F.percentile_approx("doc_id", marks, F.lit(4 * n)).alias("q"), F.min("doc_id").alias("least")).first()
    found = [*(drawn["q"] or []), *([] if drawn["least"] is None else [drawn["least"]])]
    if any(abs(i) > 1 << 53 and i != _FIRST_ID for i in found):  # back to ids that are there
        found = [i for i in ids.agg(*[F.min(F.when(F.col("doc_id") >= i, F.col("doc_id"))) for i in found]).first() if i is not None]
    ranges = Counter(found)
    crowded = [i for i, times in ranges.items() if times > 1]
    whole, repeated = set(ranges) - set(crowded), set()
    heads = {(i, _FIRST_ID) for i in whole}
    if crowded:
        inner = ids.where(F.col("doc_id").isin(crowded)).groupBy("doc_id").agg(F.percentile_approx("digest", marks, F.lit(4 * n)).alias("q"), F.min("digest").alias("least"))
        for row in inner.collect():  # ids that fill two ranges or more
            heads |= {(row["doc_id"], d) for d in (row["least"], *row["q"][:: max(1, n // ranges[row["doc_id"]])])}
            repeated |= {(row["doc_id"], d) for d, times in Counter(row["q"]).items() if times > 1}
    return keyed.mapInArrow(_dealt_rows(sorted(heads), whole, repeated), "bucket int, kind int, sort_id long, digest long, doc_id long, packed binary")


def op9_syncmer_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edit_likeness(documents(spark, sf_dir))
