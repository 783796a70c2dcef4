"""Jaccard join on word n-grams by T-occurrence search (operator 1).

A document is the set of its distinct n-grams.  Rows with the same words are one class from
the start.  The search for links runs inside *blocks* of bounded size (``link_block``):
each block has the inverted lists of its documents; for a document the longest of its
lists are set aside, the short ones are merged with a heap, and the documents that occur
there often enough are probed for the long ones by binary search (DivideSkip).  Whatever
the hashes of n-grams say, a link counts only if the n-grams themselves bear it out.  Documents
that a block has already connected are not compared again, so a block of near copies
yields a spanning forest and not all its pairs.

Two rounds decide which documents meet:

1. By their least n-grams under ``_KEYS`` hash orders; groups larger than a block are
   dealt into several at random, differently for each order.  This connects nearly all
   near copies.
2. Everything that is left, exactly.  A document of which too many n-grams occur in no other
   cannot be like any (counted over all documents with partial sums), and drops out.  If two
   sets have Jaccard likeness t or more and the
   smaller has a members, they differ in d <= a (1 - t) / t.  So of d + 1 slices of the
   n-gram space at least one has the same members in both; every document is keyed by
   its slices for its own size class and for the one below.  Documents of different
   components that share a key are still to be compared, if enough of their n-grams occur
   in other such documents (T-occurrence at large): pair by pair where few meet on
   the key; what the other keys connect is a cluster.  The members of a cluster for one size class are a block; or, if they are too
   many, the largest component among them (the hub) and the others are dealt into parts,
   and each part of the others makes a block with each part of the hub and of the others.

What many documents share (a passage, an n-gram, a key) is counted by partial sums, and
brought back by joins between written tables, whose large partitions Spark can split.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Callable, Iterator
from functools import cache, lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sceneloom.llm.bytesnp import mix, shingles, text_blocks
from sceneloom.llm.components import connected_components
from sceneloom.llm.shared import checked_broadcast, cut, documents

_KEYS = 2
#: Documents in a block of the first round at most (on average, where a group is dealt into several).
GROUP_DOCS = 128
#: Documents and n-grams in a block of the second round at most (on average, where a cluster is dealt into parts).
BLOCK_DOCS, BLOCK_GRAMS = 1024, 1_200_000
#: Keys on which so few documents meet give pairs, others clusters.
PAIR_DOCS = 8
#: So many steps the heap may take for a document: as many of the longest lists are set aside as that needs.  Where even the lists that must be merged are longer together, they are merged by sorting.
_HEAP_STEPS = 2_048
#: Nodes of rows without doc_id begin here; each text of such rows has its own, by a hash.
_NO_ID = 1 << 62


def real_ngrams(text: bytes, width: int) -> set[tuple[bytes, ...]]:
    """The n-grams themselves; ``bytes`` has the white space and the lower case of the contract."""
    own = text.lower().split()
    return set(zip(*(own[i:] for i in range(width)), strict=False)) if len(own) >= width else {tuple(own)} if own else set()


def _feature_rows(width: int):
    seeds = [np.uint64(0x5851F42D4C957F2D * (2 * i + 1) % (1 << 64)) for i in range(_KEYS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in text_blocks(batch["text"]):
                tokens, bounds = shingles(data, offsets, width)
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                at = bounds[:-1][full]
                held = data.tobytes()
                words = [hashlib.sha256(b" ".join(held[a:b].lower().split())).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                out = {"doc_id": batch["doc_id"].slice(start, end - start), "no_id": batch["no_id"].slice(start, end - start), "n": pa.array(n), "words": pa.array(words, pa.binary())}
                for i, seed in enumerate(seeds):
                    k = np.zeros(end - start, np.uint64)
                    if len(full):
                        k[full] = np.minimum.reduceat(mix(tokens ^ seed), at)
                    out[f"k{i}"] = pa.array(k.view(np.int64), mask=n == 0)
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return run


def size_classes(most: int, num: int, den: int) -> list[int]:
    """Least sizes of the classes: a set can only be like sets of its own and of the neighbouring classes."""
    lows = [1]
    while lows[-1] <= most:
        lows.append(max(lows[-1] + 1, -(-lows[-1] * den // num)))
    return lows


@cache
def slices_of(differ: int, size: int) -> tuple[int, int]:
    """(slices, spare) for sets of about ``size`` members that differ in ``differ`` at most: enough to spare that most such sets have fewer slices with one member or none."""
    spare = 2
    for _ in range(20):
        slices = differ + 1 + spare
        mean = size / slices
        weak = slices * math.exp(-mean) * (1 + mean)
        wanted = math.ceil(weak + 2 * math.sqrt(weak)) + 1
        if wanted <= spare:
            break
        spare = min(wanted, differ + 2)
    return differ + 1 + spare, spare


def slice_keys(tokens: np.ndarray, lows: list[int], num: int, den: int) -> np.ndarray:
    """The keys of one set; two sets of likeness num/den or more that differ share at least one."""
    n = len(tokens)
    own = int(np.searchsorted(lows, n, "right")) - 1
    keys = []
    for c in (own, own - 1):
        if c < 0:
            continue
        differ = (lows[c + 1] - 1) * (den - num) // num
        if not differ:  # sets so small are like only if they are equal
            if c == own:
                keys.append(mix(mix(tokens ^ np.uint64(0x1234567890ABCDEF)).sum(keepdims=True) + mix(np.full(1, c << 40, np.uint64))))
            continue
        slices, spare = slices_of(differ, lows[c])
        where = (tokens % np.uint64(slices)).astype(np.int64)
        content = np.zeros(slices, np.uint64)
        np.add.at(content, where, mix(tokens ^ np.uint64(0x1234567890ABCDEF)))
        held = np.bincount(where, minlength=slices)
        key = mix(content + mix(np.arange(slices, dtype=np.uint64) + np.uint64(c << 40)))
        # at least spare + 1 slices agree, so a set of up to spare slices without two members can leave those out
        keys.append(key[held > 1] if (held < 2).sum() <= spare else key)
    return np.concatenate(keys) if keys else tokens[:0]


def _key_rows(width: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows = size_classes(1 << 12, num, den)
        for batch in batches:
            for start, end, data, offsets in text_blocks(batch["text"]):
                tokens, bounds = shingles(data, offsets, width)
                if len(tokens) and int(np.diff(bounds).max()) >= lows[-1]:
                    lows = size_classes(int(np.diff(bounds).max()), num, den)
                keys = [slice_keys(tokens[bounds[i] : bounds[i + 1]], lows, num, den) if bounds[i + 1] > bounds[i] else tokens[:0] for i in range(end - start)]
                if not keys or not sum(map(len, keys)):
                    continue
                row = pa.array(np.repeat(np.arange(start, end), [len(k) for k in keys]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), batch["doc_id"].take(row), batch["component"].take(row)], names=["key", "doc_id", "component"])

    return run


def _gram_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in text_blocks(batch["text"]):
                tokens, bounds = shingles(data, offsets, width)
                row = pa.array(np.repeat(np.arange(start, end), np.diff(bounds)))
                yield pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), batch["doc_id"].take(row)], names=["gram", "doc_id"])

    return run


def _merge(lists: np.ndarray, begin: np.ndarray, end: np.ndarray, need: int) -> dict[int, int]:
    """Members that occur in at least ``need`` of the ascending lists ``lists[begin:end]``, with how often: by a heap of the lists' heads, or by sorting (see ``_HEAP_STEPS``)."""
    size = end - begin
    total = int(size.sum())
    if total > _HEAP_STEPS:
        at = np.arange(total) + np.repeat(begin - (np.cumsum(size) - size), size)
        member, often = np.unique(lists[at], return_counts=True)
        some = often >= need
        return dict(zip(member[some].tolist(), often[some].tolist(), strict=True))
    plain = [lists[a:b].tolist() for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
    heap = [(x[0], i, 0) for i, x in enumerate(plain)]
    heapq.heapify(heap)
    result: dict[int, int] = {}
    while heap:
        least, count = heap[0][0], 0
        while heap and heap[0][0] == least:
            _, i, at = heap[0]
            count += 1
            if at + 1 < len(plain[i]):
                heapq.heapreplace(heap, (plain[i][at + 1], i, at + 1))
            else:
                heapq.heappop(heap)
        if count >= need:
            result[least] = count
    return result


def divide_skip(lists: np.ndarray, begin: np.ndarray, end: np.ndarray, tokens: np.ndarray, need: int, held_by) -> dict[int, int]:
    """Members of at least ``need`` of the inverted lists ``lists[begin:end]`` of ``tokens``, with how often they occur.

    The longest lists are not merged (``need`` - 1 of them at most): a member that occurs often enough in the
    short ones is probed for their tokens by binary search in its sorted set (``held_by``).
    """
    if len(begin) < need:
        return {}
    size = end - begin
    by_size = np.argsort(size, kind="stable")
    merged = max(len(size) - need + 1, int(np.searchsorted(np.cumsum(size[by_size]), _HEAP_STEPS, "right")))
    aside = len(size) - merged
    short, long = by_size[:merged], tokens[np.sort(by_size[merged:])]
    found = {}
    for member, count in _merge(lists, begin[short], end[short], need - aside).items():
        count += int(held_by(member, long).sum())
        if count >= need:
            found[member] = count
    return found


def link_block(sets: list[np.ndarray], component: list[int], num: int, den: int, sure: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """Links (positions) that, with the components given, connect all the block's sets of likeness num/den or more.

    ``sure`` has the last word on two sets whose hashes say so.

    The largest component given is the hub.  Its members are in the index but are not
    searched for: a link to one of them is found from its other end.
    """
    n = len(sets)
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first: dict[int, int] = {}
    held: dict[int, int] = {}
    for i, c in enumerate(component):
        parent[i] = root(first.setdefault(c, i))
        held[c] = held.get(c, 0) + 1
    if len(first) < 2:
        return []
    hub = first[max(held, key=lambda c: (held[c], -first[c]))]

    def held_by(j: int, tokens: np.ndarray) -> np.ndarray:
        own = sets[j]
        at = np.searchsorted(own, tokens)
        at[at == len(own)] = 0
        return own[at] == tokens

    def alike(i: int, j: int, shared: int) -> bool:
        return shared * den >= num * (len(sets[i]) + len(sets[j]) - shared) and (sure is None or sure(i, j))

    size = np.fromiter(map(len, sets), np.int64, n)
    every, which = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(every, kind="stable")
    token, which = every[order], which[order]
    begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    values, ends = token[begin], np.append(begin[1:], len(token))
    links: list[tuple[int, int]] = []

    def link(i: int, j: int) -> None:
        links.append((i, j))
        parent[root(i)] = root(j)

    for i in range(n):
        if not size[i] or root(i) == root(hub):
            continue
        need = -(-num * int(size[i]) // den)  # of any set that is like this one
        if size[hub] >= need and alike(i, hub, int(held_by(hub, sets[i]).sum())):
            link(i, hub)
            continue
        at = np.searchsorted(values, sets[i])
        several = ends[at] - begin[at] > 1
        if int(several.sum()) < need:
            continue
        found = divide_skip(which, begin[at[several]], ends[at[several]], sets[i][several], need, held_by)
        for j in sorted(found, key=lambda j: -found[j]):
            if root(j) != root(i) and alike(i, j, found[j]):
                link(i, j)
    return links


def _link_rows(width: int, num: int, den: int):
    def linked(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch | None:
        if len(rows) < 2:
            return None
        text = pa.array([r[2] for r in rows], pa.large_binary())
        sets: list[np.ndarray] = []
        for start, end, data, offsets in text_blocks(text):
            tokens, bounds = shingles(data, offsets, width)
            sets += [tokens[bounds[i] : bounds[i + 1]] for i in range(end - start)]

        @lru_cache(4)
        def real(i: int) -> set[tuple[bytes, ...]]:
            return real_ngrams(rows[i][2], width)

        def sure(i: int, j: int) -> bool:
            shared = len(real(i) & real(j))
            return shared * den >= num * (len(real(i)) + len(real(j)) - shared)

        links = link_block(sets, [r[1] for r in rows], num, den, sure)
        return pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i, _ in links], pa.int64()), pa.array([rows[j][0] for _, j in links], pa.int64())], names=["a", "b"]) if links else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows = None, []
        for batch in batches:
            text = batch["text"].cast(pa.large_binary())
            for i, (key, doc, component) in enumerate(zip(batch["block"].to_pylist(), batch["doc_id"].to_pylist(), batch["component"].to_pylist(), strict=True)):
                if key != block:
                    if (out := linked(rows)) is not None:
                        yield out
                    block, rows = key, []
                rows.append((doc, component, text[i].as_py()))
        if (out := linked(rows)) is not None:
            yield out

    return run


def _dealt(key: list[Column], members: Column, doc_id: Column, salt: int) -> Column:
    """The block of a document: one for each key, or several at random if the key has more members than fit."""
    return F.xxhash64(F.lit(salt), *key, F.pmod(F.xxhash64(doc_id, F.lit(salt)), F.ceil(members / GROUP_DOCS)))


def _cluster_blocks(inside: DataFrame, num: int, den: int) -> DataFrame:
    """block, doc_id, component of the members (doc_id, cluster, n, component) of clusters: the blocks in which all pairs of one size class meet, but for pairs inside the hub."""
    lows = F.array(*[F.lit(low).cast("long") for low in size_classes(int(inside.agg(F.max("n")).first()[0] or 1), num, den)])
    own_class = F.size(F.filter(lows, lambda low: low <= F.col("n")))
    inside = inside.withColumn("cluster", F.explode(F.array(F.xxhash64("cluster", own_class), F.xxhash64("cluster", own_class - 1))))
    held = inside.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("grams"))
    hub = F.max(F.struct("docs", "component"))
    totals = held.groupBy("cluster").agg(hub["component"].alias("hub"), F.count(F.lit(1)).alias("components"), *[f.alias(n) for n, f in (("hub_docs", hub["docs"]), ("docs", F.sum("docs")), ("grams", F.sum("grams")))]).where("components > 1")
    parts = lambda docs: F.greatest(F.lit(1), F.ceil(2 * docs / BLOCK_DOCS), F.ceil(2 * F.col("grams") * docs / F.col("docs") / BLOCK_GRAMS)).cast("int")
    whole = (F.col("docs") <= BLOCK_DOCS) & (F.col("grams") <= BLOCK_GRAMS)
    totals = totals.select("cluster", "hub", F.when(whole, 0).otherwise(parts(F.col("hub_docs"))).alias("inner"), F.when(whole, 1).otherwise(parts(F.col("docs") - F.col("hub_docs"))).alias("outer"))
    dealt = inside.join(totals, "cluster").withColumn("in_hub", (F.col("component") == F.col("hub")) & (F.col("inner") > 0))
    dealt = dealt.withColumn("i", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.when(F.col("in_hub"), F.col("inner")).otherwise(F.col("outer"))).cast("int"))
    count = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    with_hub = F.transform(count(F.when(F.col("in_hub"), F.col("outer")).otherwise(F.col("inner"))), lambda j: F.when(F.col("in_hub"), F.struct(j.alias("a"), (-1 - F.col("i")).alias("b"))).otherwise(F.struct(F.col("i").alias("a"), (-1 - j).alias("b"))))
    with_others = F.when(F.col("in_hub"), F.array().cast("array<struct<a:int,b:int>>")).otherwise(F.transform(count(F.col("outer")), lambda j: F.struct(F.least(j, F.col("i")).alias("a"), F.greatest(j, F.col("i")).alias("b"))))
    dealt = dealt.withColumn("j", F.explode(F.concat(with_hub, with_others)))
    return dealt.select(F.xxhash64("cluster", "j").alias("block"), "doc_id", "component")


def ngram_components(docs: DataFrame, width: int = 5, likeness: tuple[int, int] = (80, 100)) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs`` (doc_id, text; other columns are not read).

    Words are runs without blank or 0x09-0x0D, with A-Z in lower case.  A text with fewer
    words than ``width`` has its word sequence as its only n-gram; null, empty and blank
    texts have none and are linked with nothing.  Two rows link when the Jaccard likeness
    of their sets is at least ``likeness`` (numerator, denominator; compared in integers).
    component_id is the least doc_id that links reach.  Rows that share a doc_id are one
    node; of rows without one, each text is (null is given as component only to a component of such
    rows).  N-grams are searched and counted by 64-bit hashes, and links tested on the n-grams themselves.
    """
    num, den = likeness
    given = F.col("doc_id").cast("long")
    own = docs.select(F.coalesce(given, F.shiftrightunsigned(F.xxhash64("text"), 2) + _NO_ID).alias("doc_id"), given.isNull().alias("no_id"), "text")
    keys = [f"k{i}" for i in range(_KEYS)]
    features = cut(own.mapInArrow(_feature_rows(width), "doc_id long, no_id boolean, n long, words binary, " + ", ".join(f"{k} long" for k in keys)))
    full = features.where("n > 0")
    classes = cut(full.groupBy("words").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"), *[F.max(k).alias(k) for k in keys]))
    copies = full.join(classes.where("copies > 1").select("words", "rep"), "words").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct()
    copies = cut(copies)

    def links(blocks: DataFrame) -> DataFrame:
        """block, doc_id, component -> a, b"""
        met = own.join(checked_broadcast(blocks), "doc_id").select("block", "doc_id", "component", "text")
        return met.repartition("block").sortWithinPartitions("block", "doc_id").mapInArrow(_link_rows(width, num, den), "a long, b long")

    groups = []
    for i, k in enumerate(keys):
        crowded = cut(classes.groupBy(k).agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
        groups.append(classes.join(crowded, k).select(_dealt([F.col(k)], F.col("members"), F.col("rep"), i).alias("block"), F.col("rep").alias("doc_id")))
    blocks = cut(reduce(DataFrame.unionByName, groups).distinct().withColumn("component", F.col("doc_id")))
    near = cut(links(blocks).unionByName(copies))
    found = cut(connected_components(near))

    # the rest, exactly: of each class one row, with its component
    one_set = full.groupBy("doc_id").agg((F.min("words") == F.max("words")).alias("one")).where("one").select(F.col("doc_id").alias("node"))
    other = copies.select(F.col("a").alias("node")).distinct().join(one_set, "node", "left_semi").withColumn("copy", F.lit(True))
    status = cut(found.join(other, "node", "left").withColumnRenamed("node", "doc_id"))
    once = own.join(checked_broadcast(status), "doc_id", "left").where("copy IS NULL").select("doc_id", F.coalesce("component", "doc_id").alias("component"), "text")
    sizes = classes.select(F.col("rep").alias("doc_id"), "n")

    def hopeful(rows: DataFrame) -> DataFrame:
        """doc_id of the ``rows`` (doc_id, text) of whose n-grams the share num/den or more occurs among the others here, too: of a set that is like another, so many do.  An id with several texts is always among them."""
        grams = rows.mapInArrow(_gram_rows(width), "gram long, doc_id long")
        alone = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("often"), F.min("doc_id").alias("doc_id")).where("often = 1").groupBy("doc_id").agg(F.count(F.lit(1)).alias("alone"))
        ids = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("texts")).join(sizes.groupBy("doc_id").agg(F.max("n").alias("n")), "doc_id", "left").join(alone, "doc_id", "left")
        return ids.where((F.col("texts") > 1) | ((F.col("n") - F.coalesce("alone", F.lit(0))) * den >= F.col("n") * num)).select("doc_id")

    def shared_keys(keyed: DataFrame) -> DataFrame:
        """The rows of ``keyed`` (key, doc_id, component) whose key several components have, with the key's least doc_id and its members."""
        ends = cut(keyed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("members")).where("low <> high").select("key", "least", "members"))
        return cut(keyed.join(checked_broadcast(ends), "key"))

    able = cut(hopeful(once))
    keyed = cut(once.join(checked_broadcast(able), "doc_id", "left_semi").mapInArrow(_key_rows(width, num, den), "key long, doc_id long, component long"))
    met = shared_keys(keyed)
    asked = cut(met.select("doc_id").distinct())
    able = cut(hopeful(own.join(checked_broadcast(asked), "doc_id", "left_semi").select("doc_id", "text")))
    met = shared_keys(met.join(checked_broadcast(able), "doc_id", "left_semi").select("key", "doc_id", "component"))
    few, many = met.where(F.col("members") <= PAIR_DOCS), met.where(F.col("members") > PAIR_DOCS)
    side = lambda x: few.select("key", F.col("doc_id").alias(x), F.col("component").alias(f"c{x}"))
    size_of = lambda x: sizes.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"))
    pairs = side("x").join(side("y"), "key").where("x < y AND cx <> cy").select("x", "y", "cx", "cy").distinct()
    pairs = cut(pairs.join(size_of("x"), "x").join(size_of("y"), "y").where(F.least("nx", "ny") * den >= F.greatest("nx", "ny") * num).select("x", "y", "cx", "cy").distinct())
    partners = cut(pairs.groupBy("x").agg(F.count(F.lit(1)).alias("partners")))
    pairs = cut(pairs.join(partners, "x").withColumn("block", _dealt([F.col("x")], F.col("partners"), F.col("y"), 7)))
    paired = pairs.select("block", F.col("x").alias("doc_id"), F.col("cx").alias("component")).unionByName(pairs.select("block", F.col("y").alias("doc_id"), F.col("cy").alias("component")))
    clusters = cut(connected_components(many.select(F.col("doc_id").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()))
    inside = clusters.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")).join(sizes, "doc_id").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    inside = cut(inside.select("doc_id", "cluster", "n", F.coalesce("component", "doc_id").alias("component")))
    rest = cut(links(cut(paired.unionByName(_cluster_blocks(inside, num, den)).distinct())))
    if rest.limit(1).count():
        found = connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(rest))
    labelled = features.select("doc_id", "no_id", "n").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    # a component whose least node may be a row without id has the least id given in it
    least = cut(labelled.where((F.col("component") >= _NO_ID) & ~F.col("no_id")).groupBy("component").agg(F.min("doc_id").alias("least")))
    labelled = labelled.join(checked_broadcast(least), "component", "left")
    return labelled.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("component") < _NO_ID, F.col("component")).otherwise(F.col("least")).alias("component_id"))


def op1_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return ngram_components(documents(spark, sf_dir).select("doc_id", "text"), 4, (85, 100))


SQL = """
WITH RECURSIVE t AS (SELECT doc_id, [w for w in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') if w <> ''] AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct([w[i:i + 3] for i in range(1, len(w) - 2)]) WHEN len(w) > 0 THEN [w] ELSE [] END AS s FROM t),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS an, b.n AS bn, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * k >= 85 * (an + bn - k)), y AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, reached) AS (SELECT DISTINCT a, a FROM y UNION SELECT r.doc_id, y.b FROM r JOIN y ON r.reached = y.a),
c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT g.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(component_id, g.doc_id) AS component_id FROM g LEFT JOIN c ON g.doc_id = c.doc_id
"""
