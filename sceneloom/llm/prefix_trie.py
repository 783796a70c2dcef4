"""Prefix trie of conversations, built as a Patricia tree (operator 12).

A conversation is the sequence of its turns' digests (16 bytes each).  Sequences are sorted over
the cluster; a task walks along its sorted sequences with a stack and makes points only
where sequences branch or end.  What lies between two points is an edge of unary
nodes, which all have the members of the point below; their sums follow from it and the suffix sums
of the edge.  All aggregates are sums over sequences (or least members), so a point whose
members lie in several tasks is the sum of its parts: those can only be the prefixes that a
task's first or last sequence shares with its neighbours', so these few are made node by
node, and added up by key.  Edges, not nodes, are joined with their parents; the nodes come last.

Sequences are kept in pieces of ``PIECE_TURNS``, so that no conversation makes a long row: a piece is sorted
among those with the same turns before it, and what follows it is added to its end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sceneloom.llm.shared import checked_broadcast, cut

#: Conversations c - c % FAMILY .. share first turns; HEADS is the modulus of how many.
FAMILY, HEADS = 5, 9
#: Turns in a piece.
PIECE_TURNS = 1024
#: Member ids in a piece of the text that is hashed for an end.
PIECE_IDS = 4096

_DIGEST = 16


def numbered_turns(rows: DataFrame) -> DataFrame:
    """conv_id, i (from 1), digest (hexadecimal), bytes of each row of ``rows`` (conv_id, turn, role, text) in its conversation's order: by turn, null first; rows of one turn by digest.

    Rows are dealt by ranges of conversation and turn, so that a conversation may fill many
    tasks (equal rows are told apart by a salt); only counts by range and conversation are summed across.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = rows.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.octet_length(text("text")).cast("long").alias("bytes"),
        F.substring(F.sha2(F.concat(F.octet_length(text("role")).cast("string"), F.lit(":"), text("role"), text("text")).cast("binary"), 256), 1, 2 * _DIGEST).alias("digest"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"),
    )
    order = ["conv_id", F.asc_nulls_first("turn"), "digest", "salt"]
    dealt = cut(turns.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    held = dealt.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("held"))
    before = held.withColumn("before", F.coalesce(F.sum("held").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    split = cut(before.where("before > 0").select("conv_id", "part", "before"))
    local = F.row_number().over(Window.partitionBy("part", "conv_id").orderBy(F.asc_nulls_first("turn"), "digest"))
    numbered = dealt.withColumn("local", local).join(checked_broadcast(split), ["conv_id", "part"], "left")
    return numbered.select("conv_id", (F.col("local") + F.coalesce("before", F.lit(0))).cast("long").alias("i"), "digest", "bytes")


def heads_of(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its family."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % HEADS).cast("long")


def rebuilt_turns(numbered: DataFrame, conversations: DataFrame) -> DataFrame:
    """conv_id, d (from 1), digest, bytes of the rebuilt conversations: the first turns of the family's first conversation, then the own ones after as many."""
    asked = conversations.select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), heads_of(F.col("conv_id")).alias("h"))
    first = cut(numbered.where((F.col("conv_id") % FAMILY == 0) & (F.col("i") < HEADS)).select(F.col("conv_id").alias("base"), "i", "digest", "bytes"))
    lent = asked.join(first, "base").where("i <= h").select("conv_id", F.col("i").alias("d"), "digest", "bytes")
    lengths = first.groupBy("base").agg(F.max("i").alias("length"))
    own = numbered.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).withColumn("h", heads_of(F.col("conv_id"))).where("i > h")
    own = own.join(checked_broadcast(cut(lengths)), "base", "left")
    return lent.unionByName(own.select("conv_id", (F.col("i") - F.col("h") + F.least("h", F.coalesce("length", F.lit(0)))).alias("d"), "digest", "bytes"))


def pieces_of(turns: DataFrame, conversations: DataFrame, length: int = PIECE_TURNS) -> DataFrame:
    """conv_id, k (from 0), seq (digests, hexadecimal), sizes (bytes of each turn), last (whether the conversation ends here), g and next (keys of what is before this piece and the one after) and piece (a key of g and seq) of every conversation, those without turns included."""
    gathered = turns.groupBy("conv_id", F.expr(f"(d - 1) div {length}").alias("k")).agg(F.sort_array(F.collect_list(F.struct("d", "digest", "bytes"))).alias("t"))
    own = gathered.select("conv_id", "k", F.array_join("t.digest", "").alias("seq"), F.col("t.bytes").alias("sizes"))
    none = conversations.join(turns.select("conv_id").distinct(), "conv_id", "left_anti").select("conv_id", F.lit(0).cast("long").alias("k"), F.lit("").alias("seq"), F.array().cast("array<long>").alias("sizes"))
    ordered = Window.partitionBy("conv_id").orderBy("k")
    hashed = lambda end: [F.lpad(F.hex(F.coalesce(F.bit_xor(F.xxhash64(F.lit(seed), "k", "seq")).over(ordered.rowsBetween(Window.unboundedPreceding, end)), F.lit(0))), 16, "0") for seed in (1, 2)]
    place = lambda k: F.lpad(F.hex(k), 16, "0")
    pieces = own.unionByName(none).select(
        "conv_id", "k", "seq", "sizes", (F.col("k") == F.max("k").over(Window.partitionBy("conv_id"))).alias("last"),
        F.concat(place(F.col("k")), *hashed(-1)).alias("g"), F.concat(place(F.col("k") + 1), *hashed(0)).alias("next"),
    )
    return cut(pieces.withColumn("piece", F.sha2(F.concat("g", "seq").cast("binary"), 256)))


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """piece, ends for runs of equal ``piece``: the SHA-256 of the texts of a run, joined with commas, as they stream by."""
    current, state = None, None
    for batch in batches:
        out = []
        for key, text in zip(batch["piece"].to_pylist(), batch["ids"].to_pylist(), strict=True):
            if key != current:
                if state is not None:
                    out.append((current, state.hexdigest()))
                current, state = key, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out]), pa.array([r[1] for r in out])], names=["piece", "ends"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([current]), pa.array([state.hexdigest()])], names=["piece", "ends"])


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """piece, least, ids: runs of equal ``piece`` as comma-joined texts of at most ``PIECE_IDS`` ids."""
    current, held = None, []

    def row():
        return pa.RecordBatch.from_arrays([pa.array([current]), pa.array(held[:1], pa.int64()), pa.array([",".join(map(str, held))])], names=["piece", "least", "ids"])

    for batch in batches:
        for key, conv in zip(batch["piece"].to_pylist(), batch["conv_id"].to_pylist(), strict=True):
            if held and (key != current or len(held) == PIECE_IDS):
                yield row()
                held = []
            current = key
            held.append(conv)
    if held:
        yield row()


def ends_of(members: DataFrame) -> DataFrame:
    """piece, ends: for each ``piece`` of ``members`` (piece, conv_id) the SHA-256 of its decimal ids, ascending and comma-joined.

    The ids are joined to texts in parallel, by ranges; what must go in order is the hash of those texts.
    """
    joined = members.repartitionByRange("piece", "conv_id").sortWithinPartitions("piece", "conv_id").mapInArrow(_joined_ids, "piece string, least long, ids string")
    return joined.repartition("piece").sortWithinPartitions("piece", "least").mapInArrow(_hashed_ids, "piece string, ends string")


@dataclass
class _Point:
    """A point of the tree on the current path, with sums over what was seen below it."""

    depth: int
    n: int = 0
    conv: int = (1 << 63) - 1
    children: int = 0
    leaves: int = 0
    below: int = 0  # of the turns that members have below this point, the bytes that are saved by keeping each node once
    ends: str | None = None


class _Tree:
    """One task's pass over its sorted pieces that follow the same turns (``g``)."""

    def __init__(self, g: str, length: int) -> None:
        self.g, self.length, self.first = bytes.fromhex(g), length, int(g[:16], 16) * length
        self.seq, self.sizes, self.next, self.rows = b"", np.zeros(0, np.int64), b"", 0
        self.shared = 0  # turns of the path that sequences of tasks before this have, too
        self.stack = [_Point(0)]
        self.edges: list[tuple] = []
        self.parts: list[tuple] = []

    def key(self, depth: int) -> bytes:
        """The node's key, the same in all tasks: by the turns before the piece and in it."""
        return hashlib.sha256(self.next if depth == self.length else self.g + self.seq[: depth * _DIGEST]).digest()

    def common(self, seq: bytes) -> int:
        """Turns at the start that ``seq`` and the current path share."""
        n = min(len(seq), len(self.seq)) // _DIGEST
        a, b = (np.frombuffer(s[: n * _DIGEST], np.uint64).reshape(-1, 2) for s in (seq, self.seq))
        differ = (a != b).any(1)
        return int(differ.argmax()) if differ.any() else n

    def close(self, depth: int, whole: bool = True) -> None:
        """Finishes the points below ``depth``; ``whole`` if no later sequence has them."""
        while self.stack[-1].depth > depth:
            point = self.stack.pop()
            if self.stack[-1].depth < depth:
                self.stack.append(_Point(depth))
            up = self.stack[-1]
            if whole and not point.children:
                point.leaves += 1
            size = self.sizes[up.depth : point.depth]
            made = np.arange(up.depth + 1, point.depth + 1) > self.shared  # here, not by a task before
            saved = size * (point.n - made)
            upward = np.cumsum(saved[::-1])[::-1]
            below = point.below + upward - saved
            alone = min(max(self.shared, up.depth), point.depth) if whole else point.depth
            if alone < point.depth:
                sums = below + (point.n - 1) * size
                self.edges.append((self.key(point.depth), self.key(alone), point.conv, self.first + alone + 1, point.n, point.children, point.leaves, sums[alone - up.depth :].tolist(), point.ends))
            for d in range(alone, up.depth, -1):
                at, bottom = d - 1 - up.depth, d == point.depth
                self.parts.append((
                    self.key(d), self.key(d - 1), point.conv, self.first + d, point.n, point.children if bottom else int(made[at + 1]),
                    point.leaves, int(below[at]), int(size[at]), point.ends if bottom else None,
                ))
            up.n, up.conv, up.children, up.leaves = up.n + point.n, min(up.conv, point.conv), up.children + int(made[0]), up.leaves + point.leaves
            up.below += point.below + int(upward[0])

    def add(self, row: dict) -> None:
        """The next sequence, in order."""
        seq = bytes.fromhex(row["seq"])
        shared = self.common(seq)
        if self.rows:
            self.close(shared)
            self.shared = min(self.shared, shared)
        else:  # what the task before has last
            self.shared = shared
        self.seq, self.sizes, self.next, self.rows = seq, np.array(row["sizes"], np.int64), bytes.fromhex(row["next"]), self.rows + 1
        depth = len(seq) // _DIGEST
        if depth:
            self.stack.append(_Point(depth))
        end = self.stack[-1]
        end.n, end.conv, end.children, end.leaves, end.below = end.n + row["n"], min(end.conv, row["conv"]), end.children + row["children"], end.leaves + row["leaves"], end.below + row["below"]
        end.ends = row["ends"]

    def finish(self, after: bytes = b"") -> None:
        """``after``: the sequence that the next task has first."""
        if not self.rows:
            return
        self.close(self.common(after))
        self.close(0, whole=False)
        root = self.stack[0]
        if not self.first:
            self.parts.append((self.key(0), None, root.conv, 0, root.n, root.children, root.leaves, root.below, 0, root.ends))


_EDGE = pa.schema([("key", pa.binary()), ("up", pa.binary()), ("conv", pa.int64()), ("depth", pa.int64()), ("n", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.list_(pa.int64())), ("ends", pa.string()), ("below", pa.int64()), ("size", pa.int64()), ("part", pa.bool_())])
_EDGE_SQL = "key binary, up binary, conv long, depth long, n long, children long, leaves long, saved array<long>, ends string, below long, size long, part boolean"


def _trees(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[_Tree]:
    """A tree for each run of rows (part, g, seq, ghost, ...) of one task and ``g``; rows of neighbouring tasks are ghosts.  The last tree given is not given again, and those before it are complete."""
    tree, at = None, None
    for batch in batches:
        for row in batch.to_pylist():
            if (row["part"], row["g"]) != at:
                if tree is not None:
                    tree.finish()
                    yield tree
                tree, at = _Tree(row["g"], length), (row["part"], row["g"])
            if not row["ghost"]:
                tree.add(row)
            elif tree.rows:
                tree.finish(bytes.fromhex(row["seq"]))
                yield tree
                tree = _Tree(row["g"], length)
            else:
                tree.seq = bytes.fromhex(row["seq"])
        if tree is not None and len(tree.edges) + len(tree.parts) > 2000:
            yield tree
            tree.edges, tree.parts = [], []
    if tree is not None:
        tree.finish()
        yield tree


def _edge_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree in _trees(batches, length):
            rows = [(*e, 0, 0, False) for e in tree.edges] + [(*p[:7], None, p[9], *p[7:9], True) for p in tree.parts]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _EDGE, strict=True)], schema=_EDGE)

    return run


def _first_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """piece, fresh (turns that no earlier piece of the same g has), leaf (no later one begins with it) of the rows that are no ghosts."""
    held: tuple | None = None
    out: list[tuple] = []
    for batch in batches:
        for row in batch.to_pylist():
            seq = row["seq"]
            same = held is not None and held[0] == (row["part"], row["g"])
            if held is not None and not held[4]:
                out.append((held[2], held[3], not (same and seq.startswith(held[1]))))
            fresh = len(row["sizes"] or [])
            if same:
                a, b = (np.array([s[i : i + 2 * _DIGEST] for i in range(0, min(len(seq), len(held[1])), 2 * _DIGEST)]) for s in (seq, held[1]))
                differ = a != b
                fresh -= int(differ.argmax()) if differ.any() else len(a)
            held = ((row["part"], row["g"]), seq, row["piece"], fresh, row["ghost"])
        yield _seen(out)
        out = []
    if held is not None and not held[4]:
        yield _seen([(held[2], held[3], True)])


def _seen(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.bool_()), strict=True)], names=["piece", "fresh", "leaf"])


def sorted_with_neighbours(pieces: DataFrame) -> DataFrame:
    """``pieces`` (g, seq, ...) sorted by g and seq over the cluster: part (task) and ghost besides; each task also has the last row before its own and the first after them, as ghosts (g and seq only)."""
    dealt = cut(pieces.repartitionByRange("g", "seq").withColumn("part", F.spark_partition_id()).withColumn("ghost", F.lit(False)))
    both = F.struct("g", "seq")
    ends = cut(dealt.groupBy("part").agg(F.min(both).alias("first"), F.max(both).alias("last")))
    parts = sorted(r["part"] for r in ends.select("part").collect())
    turn = [(a, b, True) for a, b in zip(parts, parts[1:], strict=False)] + [(b, a, False) for a, b in zip(parts, parts[1:], strict=False)]
    turn = dealt.sparkSession.createDataFrame(turn, "part int, to int, ahead boolean")
    ghosts = ends.join(F.broadcast(turn), "part").select(F.col("to").alias("part"), F.when(F.col("ahead"), F.col("last")).otherwise(F.col("first")).alias("e"))
    ghosts = ghosts.select("part", "e.g", "e.seq", F.lit(True).alias("ghost"))
    return dealt.unionByName(ghosts, allowMissingColumns=True).repartition("part").sortWithinPartitions("part", "g", "seq")


def _with_later(pieces: DataFrame) -> DataFrame:
    """``pieces`` with what a conversation's later pieces add below this one's end: children, leaves and below.

    Each distinct piece counts for its least conversation alone, which is a member of all that is above it.
    """
    kinds = pieces.groupBy("g", "seq", "sizes", "piece").agg(F.min("conv_id").alias("conv_id"), F.min("last").alias("ended"))
    seen = cut(sorted_with_neighbours(kinds).mapInArrow(_first_seen, "piece string, fresh long, leaf boolean"))
    made = kinds.join(seen, "piece").select("piece", "conv_id", "fresh", (F.col("leaf") & F.col("ended")).alias("leaf"))
    total = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    joined = pieces.join(made, ["piece", "conv_id"], "left")
    own = F.coalesce(F.aggregate(F.slice("sizes", F.size("sizes") - F.col("fresh").cast("int") + 1, F.col("fresh").cast("int")), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0))
    joined = joined.select(*pieces.columns, (total - own).alias("spared"), F.col("leaf").cast("long").alias("leaf"), (F.col("fresh") == F.size("sizes")).cast("long").alias("branch"))
    ordered = Window.partitionBy("conv_id").orderBy(F.desc("k"))
    later = ordered.rowsBetween(Window.unboundedPreceding, -1)
    summed = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0)).cast("long")
    return joined.select(*pieces.columns, summed("branch", ordered.rowsBetween(-1, -1)).alias("children"), summed("leaf", later).alias("leaves"), summed("spared", later).alias("below"))


def prefix_trie(rows: DataFrame, length: int = PIECE_TURNS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node of the trie of rebuilt conversations of ``rows`` (conv_id, turn, role, text; other columns are not read).

    Null roles and texts count as empty; rows without conv_id belong to no conversation and drop out.  Turns come in
    order of ``turn``, null first; of those that share one, in order of a digest of role and text, so that repeated rows are
    turns of their own and their order does not matter.  A conversation that is left without
    turns ends at the root.  Without conversations there are no nodes, not even the root.
    """
    numbered = cut(numbered_turns(rows))
    conversations = cut(numbered.select("conv_id").distinct())
    turns = cut(rebuilt_turns(numbered, conversations))
    pieces = pieces_of(turns, conversations, length)
    if pieces.where("k > 0").limit(1).count():
        pieces = cut(_with_later(pieces))
    else:
        pieces = pieces.select("*", *[F.lit(0).cast("long").alias(c) for c in ("children", "leaves", "below")])
    sums = [F.sum(c).alias(c) for c in ("children", "leaves", "below")]
    kinds = pieces.groupBy("g", "seq", "sizes", "next", "piece").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv"), *sums)
    ends = ends_of(pieces.where("last").select("piece", "conv_id"))
    made = cut(sorted_with_neighbours(kinds.join(ends, "piece", "left")).mapInArrow(_edge_rows(length), _EDGE_SQL))
    parts = made.where("part").groupBy("key").agg(
        F.first("up").alias("up"), F.min("conv").alias("conv"), F.first("depth").alias("depth"), *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "below")], F.first("size").alias("size"), F.max("ends").alias("ends")
    )
    parts = parts.select("key", "up", "conv", "depth", "n", "children", F.greatest("leaves", (F.col("children") == 0).cast("long")).alias("leaves"), F.array(F.col("below") + (F.col("n") - 1) * F.col("size")).alias("saved"), "ends")
    edges = cut(made.where("NOT part").select(*parts.columns).unionByName(parts))
    heads = cut(edges.select(F.col("key").alias("up"), F.col("conv").alias("parent")))
    edges = edges.join(checked_broadcast(heads), "up", "left").select("*", F.size("saved").alias("nodes"))
    nodes = edges.select("conv", "parent", "depth", "n", "children", "leaves", "ends", "nodes", F.posexplode("saved").alias("at", "saved"))
    bottom = F.col("at") == F.col("nodes") - 1
    return nodes.select(
        F.col("conv").alias("conv_id"), (F.col("depth") + F.col("at")).alias("depth"), F.when(F.col("at") == 0, F.col("parent")).otherwise(F.col("conv")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(bottom, F.col("children")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce(F.when(bottom, F.col("ends")), F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def op12_conversation_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = """
WITH a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, concat(strlen(role), ':', role, text) AS x, strlen(text) AS bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(strlen(role), ':', role, text))) AS i FROM a),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten([[ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR ch IN string_split(CAST(conv_id AS VARCHAR), '')])),
  lambda s, b: CASE WHEN b >= 0 THEN xor(s, b) ELSE xor(s >> 1, CASE WHEN s & 1 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295) % 9 AS h FROM t),
l AS (SELECT conv_id AS base, count(*) AS n FROM t GROUP BY ALL),
r AS (SELECT c.conv_id, t.i AS d, x, bytes FROM c JOIN t ON t.conv_id = c.base AND i <= h UNION ALL SELECT c.conv_id, i - h + least(h, coalesce(n, 0)), x, bytes FROM c JOIN t ON t.conv_id = c.conv_id AND i > h LEFT JOIN l ON l.base = c.base),
s AS (SELECT c.conv_id, coalesce(list(x ORDER BY d) FILTER (x IS NOT NULL), []) AS w, coalesce(list(bytes ORDER BY d) FILTER (x IS NOT NULL), []) AS b FROM c LEFT JOIN r ON c.conv_id = r.conv_id GROUP BY ALL),
p AS (SELECT conv_id, len(w) AS size, b, w, unnest(range(0, len(w) + 1)) AS d FROM s),
n AS (SELECT d, w[1:d] AS w, min(conv_id) AS conv_id, count(*) AS n, coalesce(any_value(b[d]), 0) AS bytes, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = d), '')) AS ends FROM p GROUP BY ALL),
k AS (SELECT u.d, u.w, any_value(u.conv_id) AS conv_id, any_value(u.n) AS n, any_value(u.bytes) AS bytes, any_value(u.ends) AS ends, count(v.d) AS children FROM n u LEFT JOIN n v ON v.d = u.d + 1 AND v.w[1:u.d] = u.w GROUP BY u.d, u.w)
SELECT u.conv_id, u.d AS depth, any_value(q.conv_id) AS parent_conv_id, any_value(u.n) AS n_convs, any_value(u.children) AS n_children, CAST(count(*) FILTER (v.children = 0) AS BIGINT) AS n_leaves, CAST(sum((v.n - 1) * v.bytes) AS BIGINT) AS saved_tokens, any_value(u.ends) AS ends_sha256
FROM k u JOIN k v ON v.d >= u.d AND v.w[1:u.d] = u.w LEFT JOIN k q ON q.d = u.d - 1 AND q.w = u.w[1:q.d] GROUP BY u.conv_id, u.d
"""
