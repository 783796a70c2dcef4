"""Removal of long repeated substrings through a run-length index (operator 4).

The corpus is never sorted as one string.  Closed syncmers (``anchor`` bytes long) mark
places by their own bytes alone and stand so close that every window of ``min_bytes``
bytes holds one.  Each window is dealt to its *first* anchor, so equal windows meet in the
same anchor group, at the same distance from the anchor.  What meets there is a set of
strings aligned at the anchor, of which identical ones are one string with a multiplicity.

For the strings of a group the Burrows-Wheeler transform is built column by column from
the right (for aligned strings this is the positional transform).  Neighbours in a run of
equal bytes remain neighbours one column further left, with one more common byte; so the
transform is held as runs, and only at the ends of runs does the common length have to be
sampled anew, as the least of those between the end of a run and the next run of that
byte.  The longer of the common lengths with both neighbours is the matching statistic of
a string at that column: where it reaches the length of a window (or the string has several
occurrences), the window that starts there starts elsewhere, too.  The anchors are dense enough for
the shortest windows asked for and the strings reach far enough for the longest, so that one index answers for several lengths.

Anchors and identical strings are recognised by hashes (two of 64 bits together); all that differs is compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sceneloom.llm.bytesnp import Spans, closed_syncmers, mix, text_blocks
from sceneloom.llm.shared import checked_broadcast, cut, documents, fresh, others

#: Bytes of the s-mers whose least decides on an anchor.
_INNER = 16
#: A task indexes whole groups of about so many strings at a time.
_STRINGS_AT_ONCE = 3_000
#: Groups of more distinct strings than this are resolved window by window.
GROUP_STRINGS = 40_000
#: Bytes of a passage of 50 words, of four bytes each with the blank at least; texts that share so much share a passage.
PASSAGE_BYTES = 200


def _anchor_bytes(min_bytes: int) -> int:
    """The longest anchor of which any ``min_bytes`` bytes hold a whole one: k + (k - s) - 1 <= min_bytes."""
    return max(_INNER + 1, (min_bytes + _INNER) // 2)


def _places(data: np.ndarray, offsets: np.ndarray, least: int, most: int) -> tuple[np.ndarray, ...]:
    """(document, position, left, right, anchor hash, string hash) of the anchors that own a window of ``least`` bytes.

    The windows of an anchor start up to ``left`` bytes before it; ``right`` is where its string ends, at most ``most`` bytes behind its start.
    """
    k = _anchor_bytes(least)
    spans = Spans(data)
    inner = spans.every(_INNER)
    found: list[tuple[np.ndarray, ...]] = []
    for d in range(len(offsets) - 1):
        lo, hi = int(offsets[d]), int(offsets[d + 1])
        if hi - lo < least:
            continue
        at = closed_syncmers(inner[lo : hi - _INNER + 1], k, _INNER)
        before = np.concatenate([[-1], at[:-1]])
        left = np.minimum(at - before - 1, least - k)
        owns = at - left + least <= hi - lo
        at, left = at[owns], left[owns]
        right = np.minimum(at + most, hi - lo)
        found.append((np.full(len(at), d), at, left, right, lo + at, lo + at - left, lo + right))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    doc, at, left, right, a, b, e = (np.concatenate(x) for x in zip(*found, strict=True))
    both = spans.hash(np.concatenate([a, b]), np.concatenate([a + k, e]))
    return doc, at, left, right, both[: len(a)].view(np.int64), (both[len(a) :] ^ mix(left.astype(np.uint64))).view(np.int64)


_PLACE = T.StructType([
    T.StructField("v", T.LongType()), T.StructField("c", T.LongType()), T.StructField("doc_key", T.LongType()), T.StructField("text_key", T.LongType()),
    T.StructField("at", T.IntegerType()), T.StructField("left", T.IntegerType()), T.StructField("right", T.IntegerType()), T.StructField("more", T.ArrayType(T.IntegerType())),
])


def _place_rows(least: int, most: int):
    """A row for each string of a document; where it stands several times (periodic texts) the further positions are in ``more``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch["doc_key"], batch["text_key"]
            for start, _, data, offsets in text_blocks(batch["text"]):
                found = _places(data, offsets, least, most)
                if not len(found[0]):
                    continue
                doc, at, left, right, v, c = (x[np.lexsort((found[1], found[5], found[4], found[0]))] for x in found)
                new = np.append(True, (doc[1:] != doc[:-1]) | (v[1:] != v[:-1]) | (c[1:] != c[:-1]))
                head = np.flatnonzero(new)
                end = np.append(head[1:], len(new))
                more: list[list[int] | None] = [None] * len(head)
                for i in np.flatnonzero(end - head > 1).tolist():
                    more[i] = at[head[i] + 1 : end[i]].tolist()
                row = pa.array(doc[head] + start)
                yield pa.RecordBatch.from_arrays([pa.array(v[head]), pa.array(c[head]), ids.take(row), keys.take(row), *(pa.array(x[head].astype(np.int32)) for x in (at, left, right)), pa.array(more, pa.list_(pa.int32()))], names=_PLACE.names)

    return run


def _cut_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the strings that stand for their class."""
    for batch in batches:
        out = {n: [] for n in ("v", "c", "n", "left", "bytes")}
        size = 0
        text = batch["text"].cast(pa.large_binary())
        for i, wanted in enumerate(batch["wanted"].to_pylist()):
            own = text[i].as_py() or b""
            for w in wanted:
                out["v"].append(w["v"])
                out["c"].append(w["c"])
                out["n"].append(w["n"])
                out["left"].append(w["left"])
                out["bytes"].append(own[w["at"] - w["left"] : w["right"]])
                size += 500
            if size > 1 << 22:
                yield pa.RecordBatch.from_pydict(out, schema=_STRING_ARROW)
                out, size = {n: [] for n in out}, 0
        if out["v"]:
            yield pa.RecordBatch.from_pydict(out, schema=_STRING_ARROW)


_STRING_ARROW = pa.schema([("v", pa.int64()), ("c", pa.int64()), ("n", pa.int64()), ("left", pa.int32()), ("bytes", pa.binary())])
_STRING = "v long, c long, n long, left int, bytes binary"
_MATCH = "v long, c long, size int, near int, far int"
_MATCH_ARROW = pa.schema([("v", pa.int64()), ("c", pa.int64()), ("size", pa.int32()), ("near", pa.int32()), ("far", pa.int32())])


def matching_lengths(strings: list[bytes], left: np.ndarray, group: np.ndarray, many: np.ndarray) -> np.ndarray:
    """[string, distance]: how many bytes from that far left of the anchor on stand elsewhere, too (the matching statistic).

    ``group`` ascends; strings are compared within their group only.  ``many`` marks
    strings that have several occurrences.  Left of a string's start it is 0.
    """
    n = len(strings)
    most = int(left.max()) if n else 0
    length = np.fromiter(map(len, strings), np.int64, n)
    width = most + int((length - left).max()) if n else 0
    grid = np.zeros((width, n), np.int16)  # a row for each column of the aligned strings; 0: outside the string
    flat = np.frombuffer(b"".join(strings), np.uint8).astype(np.int16) + 1
    string = np.repeat(np.arange(n, dtype=np.int32), length)
    place = np.arange(len(flat), dtype=np.int32) + np.repeat((most - left - np.cumsum(length) + length).astype(np.int32), length)
    grid[place, string] = flat
    del flat, string, place

    order = np.arange(n)
    new_group = np.ones(n + 1, bool)
    new_group[1:n] = group[1:] != group[:-1]
    member = np.cumsum(new_group[:n]) - 1
    n_groups = int(member[-1]) + 1 if n else 0
    common = np.zeros(n + 1, np.int32)  # common[i]: bytes that order[i - 1] and order[i] have in common from this column on
    statistic = np.zeros((n, most + 1), np.int32)
    for column in range(width - 1, -1, -1):
        head = grid[column][order]
        end_of_run = np.empty(n, bool)
        end_of_run[0] = True
        np.not_equal(head[1:], head[:-1], out=end_of_run[1:])
        inside = ~new_group[:n]
        torn = np.zeros(n_groups, bool)
        torn[member[end_of_run & inside]] = True  # groups with more than one run
        fresh = common[:n] + 1
        if torn.any():
            moved = np.flatnonzero(torn[member])
            own = moved[np.argsort(member[moved].astype(np.int64) * 512 + head[moved], kind="stable")]
            a, b = own[:-1], own[1:]
            same = (member[a] == member[b]) & (head[a] == head[b])
            value = np.zeros(len(own), np.int32)
            step = same & (b == a + 1)
            value[1:][step] = fresh[b[step]]
            jump = np.flatnonzero(same & (b != a + 1))  # from the end of a run to the next run of that byte
            if len(jump):
                jump = jump[np.argsort(a[jump], kind="stable")]
                pairs = np.empty(2 * len(jump), np.int64)
                pairs[0::2], pairs[1::2] = a[jump] + 1, b[jump] + 1
                value[1 + jump] = np.minimum.reduceat(common, pairs)[0::2] + 1
            fresh[moved] = value
            order[moved] = order[own]
            head = grid[column][order]
        fresh[(head == 0) | new_group[:n]] = 0
        common[:n] = fresh
        if column <= most:
            statistic[order, most - column] = np.maximum(common[:n], common[1:])
    distance = np.arange(most + 1)[None, :]
    statistic[many] = np.broadcast_to(length[many, None] - left[many, None] + distance, statistic[many].shape)  # an occurrence of the whole string
    statistic[distance > left[:, None]] = 0
    return statistic


def _index_rows(sizes: list[int]):
    def matches(v: np.ndarray, c: np.ndarray, n: np.ndarray, left: np.ndarray, strings: list[bytes]) -> pa.RecordBatch | None:
        statistic = matching_lengths(strings, left, v, n >= 2)
        parts = []
        for size in sizes:
            edge = np.diff(np.pad((statistic >= size).astype(np.int8), ((0, 0), (1, 1))), axis=1)
            row, near = np.nonzero(edge == 1)
            parts.append((row, np.full(len(row), size), near, np.nonzero(edge == -1)[1] - 1))
        row, size_of, near, far = (np.concatenate(x) for x in zip(*parts, strict=True))
        if not len(row):
            return None
        return pa.RecordBatch.from_arrays([pa.array(v[row]), pa.array(c[row]), *(pa.array(x.astype(np.int32)) for x in (size_of, near, far))], schema=_MATCH_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def flush(everything: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, count
            v, c, n, left = (np.concatenate([h[i] for h in held]) for i in range(4))
            strings = [s for h in held for s in h[4]]
            upto = len(v) if everything else int(np.searchsorted(v, v[-1]))  # the last group may go on
            start = 0
            while start < upto:
                end = min(upto, start + _STRINGS_AT_ONCE)
                if end < upto:
                    first = int(np.searchsorted(v, v[end]))
                    end = first if first > start else int(np.searchsorted(v, v[end], "right"))
                out = matches(v[start:end], c[start:end], n[start:end], left[start:end], strings[start:end])
                if out is not None:
                    yield out
                start = end
            held = [(v[upto:], c[upto:], n[upto:], left[upto:], strings[upto:])]
            count = len(v) - upto

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((*(batch[x].to_numpy(zero_copy_only=False) for x in ("v", "c", "n")), batch["left"].to_numpy(zero_copy_only=False).astype(np.int64), batch["bytes"].to_pylist()))
            count += batch.num_rows
            if count >= _STRINGS_AT_ONCE:
                yield from flush(False)
        if count:
            yield from flush(True)

    return run


def _window_rows(sizes: list[int]):
    """For groups too large to index: a row for each window, keyed by its whole content (two hashes of it)."""
    schema = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("v", pa.int64()), ("c", pa.int64()), ("n", pa.int64()), ("size", pa.int32()), ("near", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = np.frombuffer(batch["bytes"][i].as_py(), np.uint8)
                left = batch["left"][i].as_py()
                for size in sizes:
                    k = max(0, min(left + 1, len(own) - size + 1))
                    keys = [Spans(own, seed).every(size)[:k].view(np.int64) for seed in (0, 1)]
                    fill = lambda name, k=k, i=i: pa.array(np.full(k, batch[name][i].as_py(), np.int64))
                    yield pa.RecordBatch.from_arrays([*map(pa.array, keys), fill("v"), fill("c"), fill("n"), pa.array(np.full(k, size, np.int32)), pa.array((left - np.arange(k)).astype(np.int32))], schema=schema)

    return run


def _merge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ascend by document and size; out comes a row for each document and size with its maximal runs.

    A row has covered bytes from ``before`` ahead of its positions to ``after`` behind them.
    """
    key, spans, done = None, [], []

    def closed() -> tuple:
        spans.sort()
        runs: list[list[int]] = []
        for start, end in spans:
            if runs and start <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], end)
            else:
                runs.append([start, end])
        return (*key, runs)

    for batch in batches:
        for *own, at, more, before, after in zip(*(batch[x].to_pylist() for x in ("doc_key", "text_key", "size", "at", "more", "before", "after")), strict=True):
            if own != key:
                if key is not None:
                    done.append(closed())
                key, spans = own, []
            spans.append((at - before, at + after))
            spans += [(p - before, p + after) for p in more or ()]
        if len(done) > 2000:
            yield _merged(done)
            done = []
    if key is not None:
        done.append(closed())
    if done:
        yield _merged(done)


def _merged(done: list[tuple]) -> pa.RecordBatch:
    kind = pa.list_(pa.int32())
    keys = [pa.array([x[i] for x in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32()))]
    return pa.RecordBatch.from_arrays([*keys, pa.array([[s for s, _ in x[3]] for x in done], kind), pa.array([[e for _, e in x[3]] for x in done], kind)], names=["doc_key", "text_key", "size", "starts", "ends"])


def repeated_spans(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """doc_key, text_key, size, starts, ends: for each of ``sizes`` the maximal runs of bytes that some string of so many bytes covers which starts at two places at least.

    ``docs`` has doc_key, text and text_key (a hash of the text); documents without such runs have no row.

    A passage may stand in a large share of all documents, so nothing gathers the places
    of an anchor or of a string: they are counted with partial sums, and joins, whose
    large partitions Spark can split, bring the outcome back to them.
    """
    places = cut(docs.mapInArrow(_place_rows(min(sizes), max(sizes)), _PLACE))
    times = F.when(F.col("more").isNull(), 0).otherwise(F.size("more")) + 1
    repeated = cut(places.groupBy("v").agg(F.sum(times).alias("all")).where("all >= 2").select("v"))
    hits = cut(places.join(repeated, "v", "left_semi"))  # repeated grows with the corpus: shuffled at every size
    classes = cut(hits.groupBy("v", "c").agg(F.sum(times).alias("n"), F.min(F.struct("doc_key", "text_key", "at", "left", "right")).alias("shown")).select("v", "c", "n", "shown.*"))
    kinds = cut(classes.groupBy("v").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"))
    alone = classes.join(checked_broadcast(kinds), "v", "left_anti").withColumn("size", F.explode(F.array(*[F.lit(x) for x in sizes])))
    alone = alone.select("v", "c", "size", F.greatest(F.lit(0), F.col("size") - (F.col("right") - F.col("at"))).alias("near"), F.col("left").alias("far")).where("near <= far")
    several = cut(classes.join(checked_broadcast(kinds), "v"))
    shown = several.groupBy("doc_key", "text_key").agg(F.collect_list(F.struct("v", "c", "n", "left", "at", "right", "kinds")).alias("wanted"))
    keys = cut(several.select("doc_key", "text_key").distinct())
    needed = docs.select("doc_key", "text_key", "text").join(checked_broadcast(keys), ["doc_key", "text_key"], "left_semi")
    strings = lambda rows: needed.join(rows, ["doc_key", "text_key"]).select("text", "wanted").mapInArrow(_cut_strings, _STRING)
    split = lambda rows, rule: rows.withColumn("wanted", F.filter("wanted", rule)).where(F.size("wanted") > 0)
    matched = strings(split(shown, lambda w: w["kinds"] <= GROUP_STRINGS)).repartition("v").sortWithinPartitions("v").mapInArrow(_index_rows(sizes), _MATCH)
    if several.where(F.col("kinds") > GROUP_STRINGS).limit(1).count():
        windows = strings(split(shown, lambda w: w["kinds"] > GROUP_STRINGS)).mapInArrow(_window_rows(sizes), "w1 long, w2 long, v long, c long, n long, size int, near int")
        windows = cut(windows)
        often = cut(windows.groupBy("size", "w1", "w2").agg(F.sum("n").alias("total")).where("total >= 2").select("size", "w1", "w2"))
        matched = matched.unionByName(windows.join(often, ["size", "w1", "w2"], "left_semi").select("v", "c", "size", "near", F.col("near").alias("far")))
    marked = hits.join(cut(alone.unionByName(matched)), ["v", "c"]).select("doc_key", "text_key", "size", "at", "more", F.col("far").alias("before"), (F.col("size") - F.col("near")).alias("after"))
    dealt = marked.repartition("doc_key", "text_key").sortWithinPartitions("doc_key", "text_key", "size")
    return dealt.mapInArrow(_merge_rows, "doc_key long, text_key long, size int, starts array<int>, ends array<int>")


_INTS = T.ArrayType(T.IntegerType())
_MADE = {"span_starts": _INTS, "span_ends": _INTS, "passage_starts": _INTS, "passage_ends": _INTS, "n_bytes": T.LongType(), "n_removed": T.LongType(), "kept": T.BinaryType()}


def _apply(own: list[str], starts: str, ends: str, passage_starts: str, passage_ends: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, kept, removed = batch["text"].cast(pa.large_binary()), [], []
            for i, (begin, end) in enumerate(zip(batch[starts].to_pylist(), batch[ends].to_pylist(), strict=True)):
                whole = text[i].as_py() or b""
                edges = [0, *(x for s, e in zip(begin or (), end or (), strict=True) for x in (s, e)), len(whole)]
                kept.append(b"".join(whole[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if begin else whole)
                removed.append(len(whole) - len(kept[-1]))
            n_bytes = [len(k) + r for k, r in zip(kept, removed, strict=True)]
            made = [*(batch[c] for c in (starts, ends, passage_starts, passage_ends)), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in own), *made], names=[*own, *_MADE])

    return run


def drop_repeats(docs: DataFrame, min_bytes: int = 400, passage_bytes: int | None = None) -> DataFrame:
    """Every row of ``docs`` with span_starts, span_ends (removed byte runs), passage_starts, passage_ends, n_bytes, n_removed and kept (the bytes that are not removed).

    A byte goes if a ``min_bytes``-byte string over it starts at another place, too, in
    this or another row; all is judged on the input.  With ``passage_bytes``, the runs that repeated strings of that length
    cover are reported besides (passage_starts, passage_ends), but not removed.  Null and short texts keep all they
    have; runs are null where there are none; repeated rows are each other's copies; other columns pass
    through, whatever they are called, but for the seven above, which are replaced.  Cut characters leave
    incomplete UTF-8 in ``kept``, which is binary.
    """
    own = others(docs, *_MADE)
    doc_key, text_key, *lists = fresh(docs, "doc_key", "text_key", "starts", "ends", "other_starts", "other_ends")
    keyed = docs.select(*own, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias(doc_key), F.xxhash64(F.coalesce("text", F.lit(""))).alias(text_key))
    sizes = sorted({min_bytes, passage_bytes or min_bytes})
    spans = cut(repeated_spans(keyed.select(F.col(doc_key).alias("doc_key"), "text", F.col(text_key).alias("text_key")), sizes))
    of = lambda size, name: F.max(F.when(F.col("size") == (size or -1), F.col(name)))
    both = [of(size, name).alias(x) for x, (size, name) in zip(lists, ((min_bytes, "starts"), (min_bytes, "ends"), (passage_bytes, "starts"), (passage_bytes, "ends")), strict=True)]
    found = cut(spans.groupBy(F.col("doc_key").alias(doc_key), F.col("text_key").alias(text_key)).agg(*both))
    entries = sum((F.greatest(F.lit(0), F.size(x)) for x in lists), F.lit(0))
    joined = keyed.join(checked_broadcast(found, entries=entries), [doc_key, text_key], "left").select(*own, *lists)
    return joined.mapInArrow(_apply(own, *lists), T.StructType([*docs.select(*own).schema.fields, *(T.StructField(n, t) for n, t in _MADE.items())]))


def whole_characters(kept: Column) -> Column:
    """The text of bytes whose first or last character may be incomplete where something was cut; such remains are left out."""

    def decoded(column: pd.Series) -> pd.Series:
        return column.map(lambda b: None if b is None else b.decode("utf-8", "ignore"))

    return F.pandas_udf(decoded, "string")(kept)


def op4_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's columns are of strings of 400 bytes.  n_passages and n_passage_bytes count the runs, and their bytes, that repeated strings of ``PASSAGE_BYTES`` cover."""
    out = drop_repeats(documents(spark, sf_dir).select("doc_id", "text"), 400, PASSAGE_BYTES)
    number = lambda x: F.greatest(F.lit(0), F.size(x)).cast("long")
    covered = F.coalesce(F.aggregate(F.zip_with("passage_starts", "passage_ends", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
    return out.select("doc_id", "n_bytes", "n_removed", number("span_starts").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), number("passage_starts").alias("n_passages"), covered.alias("n_passage_bytes"))


SQL = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
z AS (SELECT unnest([400, 200]) AS size),
a AS (SELECT doc_id, n, o, substr(h, 2 * o + 1, 1200) AS part FROM (SELECT doc_id, h, len(h) // 2 AS n, unnest(range(0, len(h) // 2, 200)) AS o FROM b)),
w AS (SELECT size, doc_id, o + j AS i, md5(substr(part, 2 * j + 1, 2 * size)) AS k FROM (SELECT size, doc_id, n, o, part, unnest(range(0, 200)) AS j FROM a, z) WHERE o + j + size <= n),
m AS (SELECT size, doc_id, i FROM (SELECT size, doc_id, i, count(*) OVER (PARTITION BY size, k) AS c FROM w) WHERE c > 1),
n AS (SELECT size, doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY size, doc_id ORDER BY i) <= size THEN 0 ELSE 1 END AS new FROM m),
s AS (SELECT size, doc_id, min(i) AS a, max(i) + size AS z FROM (SELECT size, doc_id, i, sum(new) OVER (PARTITION BY size, doc_id ORDER BY i) AS g FROM n) GROUP BY size, doc_id, g),
l AS (SELECT s.doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY s.doc_id ORDER BY a), 0) AS before, h FROM s JOIN b ON s.doc_id = b.doc_id WHERE size = 400),
k AS (SELECT doc_id, sum(z - a) AS gone, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS kept FROM l GROUP BY doc_id),
p AS (SELECT doc_id, count(*) AS n_passages, sum(z - a) AS covered FROM s WHERE size = 200 GROUP BY doc_id)
SELECT b.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256,
       CAST(coalesce(n_passages, 0) AS BIGINT) AS n_passages, CAST(coalesce(covered, 0) AS BIGINT) AS n_passage_bytes
FROM b LEFT JOIN k ON b.doc_id = k.doc_id LEFT JOIN p ON b.doc_id = p.doc_id
"""
