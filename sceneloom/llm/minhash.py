"""Near-duplicate documents by MinHash with tensored banding (operator 13).

Two small collections of ``BANDS`` bands each, of ``ROWS`` minhashes a band, are computed for a
document; the key of table (i, j) is band i of the first with band j of the second.  So
4 * 12 minhashes make 144 tables of four minhashes each, which plain banding would need 576 for.
Sets of likeness s meet in a table unless one collection has no equal band: at 0.8 all but
2 (1 - 0.8^2)^12, one pair in a hundred thousand, do; at 0.85 one in two million does not.

1. Texts of the same words are one class.  Two tables, groups dealt into blocks at random,
   connect nearly all near copies.
2. All tables.  A key whose documents are one component already is dropped by partial
   aggregates.  Where few meet, pairs are made once for all tables, and those whose
   minhashes agree too rarely go (``agreement``).  Where many meet, the documents are dealt into
   blocks of bounded size, in which minhashes are compared, and only a spanning forest of what agrees
   leaves the block; what the forests connect is a cluster.  Ever larger shares of a key's pairs are compared,
   all in the end, and what earlier forests connect is one node in later ones (``agreeing_clusters``).

Whatever is proposed is verified on the full sets of shingles (``link_block``), where hashes of
shingles have no last word.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sceneloom.llm import ngram_join
from sceneloom.llm.bytesnp import mix, shingles, text_blocks
from sceneloom.llm.components import connected_components
from sceneloom.llm.ngram_join import _NO_ID, PAIR_DOCS, _cluster_blocks, _dealt, _link_rows
from sceneloom.llm.shared import checked_broadcast, cut, documents

#: Bands of each of the two collections, and minhashes in a band.
BANDS, ROWS = 12, 2
#: Tables of the first round.
FIRST_TABLES = 2
#: Keys of a document whose other documents it meets first, where many meet; and how many times more parts of a key meet in each further round.
FIRST_KEYS, MORE_PARTS = 4, 8
_SEED = 0x2545F4914F6CDD1D


def minhashes(tokens: np.ndarray, bounds: np.ndarray, hashes: int) -> np.ndarray:
    """(documents, ``hashes``) of 32 bits: the least of each hash order in each set ``tokens[bounds[i]:bounds[i + 1]]``; 0 for empty sets."""
    full = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(bounds) - 1, hashes), np.uint32)
    for i in range(hashes if len(full) else 0):
        seed = np.uint64(_SEED * (2 * i + 1) % (1 << 64))
        out[full, i] = np.minimum.reduceat(mix(tokens ^ seed) >> np.uint64(32), bounds[:-1][full])
    return out


def _signature_rows(width: int, hashes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in text_blocks(batch["text"]):
                tokens, bounds = shingles(data, offsets, width)
                held = data.tobytes()
                words = [hashlib.sha256(b" ".join(held[a:b].lower().split())).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                signature = pa.array(minhashes(tokens, bounds, hashes).view(np.int32).ravel())
                rows = np.arange(end - start + 1, dtype=np.int32) * hashes
                yield pa.RecordBatch.from_arrays([
                    batch["doc_id"].slice(start, end - start), batch["no_id"].slice(start, end - start), pa.array(np.diff(bounds)), pa.array(words, pa.binary()), pa.ListArray.from_arrays(pa.array(rows), signature),
                ], names=["doc_id", "no_id", "n", "words", "signature"])

    return run


def table_keys(signature: Column, bands: int, rows: int, tables: int | None = None) -> Column:
    """The keys of a signature: of all pairs of a band of either collection, or of the first ``tables`` bands with their own counterpart."""
    band = lambda at: F.xxhash64(F.slice(signature, at * rows + 1, rows), at)
    if tables is not None:
        return F.array(*[F.xxhash64(band(F.lit(i)), band(F.lit(bands + i))) for i in range(tables)])
    one = lambda first: F.transform(F.sequence(F.lit(first), F.lit(first + bands - 1)), band)
    return F.flatten(F.transform(one(0), lambda u: F.transform(one(bands), lambda v: F.xxhash64(u, v))))


def agreement(hashes: int, likeness: float) -> int:
    """Of so many minhashes, sets of this likeness agree in at least as many as is returned, but for seven standard deviations."""
    return max(1, math.floor(hashes * likeness - 7 * math.sqrt(hashes * likeness * (1 - likeness))))


def spanning(signatures: np.ndarray, component: np.ndarray, least: int, joined: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the graph of rows of different components whose minhashes agree in at least ``least`` places; rows of one ``joined`` are one node."""
    n = len(signatures)
    agree = np.zeros((n, n), np.uint16)
    for column in signatures.T:
        agree += column[:, None] == column[None, :]
    near = (agree >= least) & (component[:, None] != component[None, :])
    node = np.arange(n) if joined is None else np.unique(joined, return_inverse=True)[1]
    left, edges = np.ones(n, bool), []
    for seed in range(n):
        if not left[seed]:
            continue
        frontier = np.flatnonzero(node == node[seed])
        left[frontier] = False
        while len(frontier):
            reached = near[frontier] & left
            new = np.flatnonzero(reached.any(0))
            new = new[np.unique(node[new], return_index=True)[1]]
            edges += zip(frontier[reached[:, new].argmax(0)].tolist(), new.tolist(), strict=True)
            frontier = np.flatnonzero(np.isin(node, node[new])) if len(new) else new
            left[frontier] = False
    return edges


def _forest_rows(least: int):
    def forest(rows: list[tuple]) -> pa.RecordBatch:
        ids = [r[0] for r in rows]
        edges = spanning(np.array([r[3] for r in rows], np.int32), np.array([r[1] for r in rows], np.int64), least, np.array([r[2] for r in rows], np.int64)) if len(rows) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in edges], pa.int64()), pa.array([ids[j] for _, j in edges], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows = None, []
        for batch in batches:
            signatures = batch["signature"].flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1) if len(batch) else []
            for key, doc, component, joined, own in zip(batch["block"].to_pylist(), batch["doc_id"].to_pylist(), batch["component"].to_pylist(), batch["joined"].to_pylist(), signatures, strict=True):
                if key != block:
                    yield forest(rows)
                    block, rows = key, []
                rows.append((doc, component, joined, own))
        yield forest(rows)

    return run


def agreeing_clusters(met: DataFrame, signed: DataFrame, likeness: tuple[int, int], least: int) -> DataFrame:
    """doc_id, cluster: what is connected by pairs of different components that meet on a key of ``met`` (key, doc_id, component, n, members) and agree in ``least`` minhashes of ``signed`` (doc_id, component, signature).

    A block's forest tells nothing of other blocks, so all blocks of a key at once give a row for each member and part of the
    key.  Hence rounds: first each document meets one part of a few of its keys, then ``MORE_PARTS`` parts of each, and so on until all of a key's have
    met.  A document that agrees with many has been joined with them by few, and pairs already joined are no edges:
    what a round gives grows with the documents, as the rest of a graph that a sample of its edges does not connect is small.
    """
    joined = met.select("doc_id", F.col("doc_id").alias("cluster")).where(F.lit(False))
    most = met.agg(F.max("members")).first()[0]
    if not most:
        return joined
    parts = F.ceil(2 * F.col("members") / ngram_join.BLOCK_DOCS)
    few = met.groupBy("doc_id", "component", "n").agg(F.slice(F.sort_array(F.collect_set(F.struct("key", "members"))), 1, FIRST_KEYS).alias("few")).select("doc_id", "component", "n", F.inline("few"))
    spans = [1, MORE_PARTS]
    while spans[-1] * ngram_join.BLOCK_DOCS < 2 * most:
        spans.append(spans[-1] * MORE_PARTS)
    for i, span in enumerate(spans):
        asked = few if not i else met if i == 1 else met.where(parts > spans[i - 1])
        so_far = checked_broadcast(joined)
        # no edges inside a cluster so far, nor inside a component
        head = F.when(F.col("cluster").isNull(), F.xxhash64(F.lit(0), "component")).otherwise(F.xxhash64(F.lit(1), "cluster"))
        dealt = F.xxhash64("key", F.pmod(F.xxhash64("doc_id", F.lit(20 + i)), F.ceil(parts / span)))
        placed = cut(asked.join(so_far, "doc_id", "left").select(dealt.alias("cluster"), "doc_id", head.alias("component"), "n").distinct())
        blocks = cut(_cluster_blocks(placed, *likeness).select("block", "doc_id"))
        compared = blocks.join(signed.join(so_far, "doc_id", "left").select("doc_id", "component", F.coalesce("cluster", "doc_id").alias("joined"), "signature"), "doc_id")
        forest = cut(compared.repartition("block").sortWithinPartitions("block", "doc_id").mapInArrow(_forest_rows(least), "a long, b long"))
        if forest.limit(1).count():
            joined = cut(connected_components(forest.unionByName(joined.select(F.col("doc_id").alias("a"), F.col("cluster").alias("b")))).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")))
    return joined


def minhash_components(docs: DataFrame, width: int = 5, likeness: tuple[int, int] = (80, 100), bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text; other columns are not read).

    Words are runs without blank or 0x09-0x0D, with A-Z in lower case.  A text with fewer words than ``width`` has its word
    sequence as its only shingle; null, empty and blank texts have none and are linked with nothing.  Rows link when the Jaccard
    likeness of their sets is at least ``likeness`` (compared in integers, on the shingles themselves).  component_id is
    the least doc_id that links reach, and kept says that it is the row's own.  Rows that share a doc_id are one node; of rows without one, each text is
    (null is given as component only to a component of such rows, of which the rows of one text are kept).  Texts of any length are read whole.
    """
    num, den = likeness
    hashes = 2 * bands * rows
    given = F.col("doc_id").cast("long")
    own = docs.select(F.coalesce(given, F.shiftrightunsigned(F.xxhash64("text"), 2) + _NO_ID).alias("doc_id"), given.isNull().alias("no_id"), "text")
    signed = cut(own.mapInArrow(_signature_rows(width, hashes), "doc_id long, no_id boolean, n long, words binary, signature array<int>"))
    full = signed.where("n > 0")
    classes = cut(full.groupBy("words").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("signature").alias("signature")))
    copies = cut(full.select("doc_id", "words").join(classes.where("copies > 1").select("words", F.col("doc_id").alias("b")), "words").select(F.col("doc_id").alias("a"), "b").where("a <> b").distinct())

    def links(blocks: DataFrame) -> DataFrame:
        """a, b: the links inside ``blocks`` (block, doc_id, component), tested on the texts."""
        met = own.join(checked_broadcast(blocks), "doc_id").select("block", "doc_id", "component", "text")
        return met.repartition("block").sortWithinPartitions("block", "doc_id").mapInArrow(_link_rows(width, num, den), "a long, b long")

    first = cut(classes.select("doc_id", F.explode(table_keys(F.col("signature"), bands, rows, min(FIRST_TABLES, bands))).alias("key")))
    crowded = cut(first.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    blocks = first.join(checked_broadcast(crowded), "key").select(_dealt([F.col("key")], F.col("members"), F.col("doc_id"), 1).alias("block"), "doc_id")
    found = cut(connected_components(cut(links(cut(blocks.distinct().withColumn("component", F.col("doc_id")))).unionByName(copies))))

    of_class = classes.join(checked_broadcast(found.withColumnRenamed("node", "doc_id")), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"), "n", "signature")
    of_class = cut(of_class)
    keyed = of_class.select("doc_id", "component", F.explode(table_keys(F.col("signature"), bands, rows)).alias("key"))
    apart = keyed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    met = cut(keyed.join(checked_broadcast(cut(apart)), "key"))
    counted = cut(met.groupBy("key").agg(F.count(F.lit(1)).alias("members")))
    met = cut(met.join(checked_broadcast(counted), "key"))

    few = met.where(F.col("members") <= PAIR_DOCS)
    side = lambda x: few.select("key", F.col("doc_id").alias(x), F.col("component").alias(f"c{x}"))
    held = lambda x: of_class.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("signature").alias(f"s{x}"))
    agreeing = F.aggregate(F.zip_with("sx", "sy", lambda a, b: (a == b).cast("int")), F.lit(0), lambda a, x: a + x)
    pairs = cut(side("x").join(side("y"), "key").where("x < y AND cx <> cy").select("x", "y", "cx", "cy").distinct())
    pairs = pairs.join(held("x"), "x").join(held("y"), "y").where((F.least("nx", "ny") * den >= F.greatest("nx", "ny") * num) & (agreeing >= agreement(hashes, num / den)))
    pairs = cut(pairs.select("x", "y", "cx", "cy").distinct())
    partners = cut(pairs.groupBy("x").agg(F.count(F.lit(1)).alias("partners")))
    pairs = pairs.join(checked_broadcast(partners), "x").withColumn("block", _dealt([F.col("x")], F.col("partners"), F.col("y"), 7))
    paired = [pairs.select("block", F.col(x).alias("doc_id"), F.col(f"c{x}").alias("component")) for x in ("x", "y")]

    many = cut(met.where(F.col("members") > PAIR_DOCS).select("key", "doc_id", "component", "members").join(of_class.select("doc_id", "n"), "doc_id").distinct())
    clusters = agreeing_clusters(many, of_class.select("doc_id", "component", "signature"), likeness, agreement(hashes, num / den))
    inside = cut(clusters.join(of_class.select("doc_id", "component", "n"), "doc_id"))
    rest = cut(links(cut(reduce(DataFrame.unionByName, [*paired, _cluster_blocks(inside, num, den)]).distinct())))
    if rest.limit(1).count():
        found = cut(connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(rest)))

    labelled = signed.select("doc_id", "no_id", "n").join(checked_broadcast(found.withColumnRenamed("node", "doc_id")), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    least = cut(labelled.where((F.col("component") >= _NO_ID) & ~F.col("no_id")).groupBy("component").agg(F.min("doc_id").alias("least")))
    labelled = labelled.join(checked_broadcast(least), "component", "left")
    ids, heads = F.when(~F.col("no_id"), F.col("doc_id")), F.when(F.col("component") < _NO_ID, F.col("component")).otherwise(F.col("least"))
    return labelled.select(ids.alias("doc_id"), F.col("n").alias("n_shingles"), heads.alias("component_id"), F.when(heads.isNull(), F.col("doc_id") == F.col("component")).otherwise(F.coalesce(ids == heads, F.lit(False))).alias("kept"))


def op13_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return minhash_components(documents(spark, sf_dir).select("doc_id", "text"), 2, (80, 100))


SQL = """
WITH RECURSIVE t AS (SELECT doc_id, [w for w in string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') if w <> ''] AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct([w[i:i + 1] for i in range(1, len(w))]) WHEN len(w) > 0 THEN [w] ELSE [] END AS s FROM t),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM g),
f AS (SELECT x, count(*) AS often FROM e GROUP BY x),
o AS (SELECT doc_id, n, e.x, row_number() OVER (PARTITION BY doc_id ORDER BY often, e.x) AS i FROM e JOIN f ON e.x = f.x),
q AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS an, b.n AS bn FROM o a JOIN o b ON a.x = b.x AND a.doc_id < b.doc_id WHERE 5 * (a.i - 1) <= a.n AND 5 * (b.i - 1) <= b.n AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
p AS (SELECT a, b, an, bn, len(list_intersect(u.s, v.s)) AS k FROM q JOIN g u ON u.doc_id = a JOIN g v ON v.doc_id = b),
l AS (SELECT a, b FROM p WHERE 100 * k >= 80 * (an + bn - k)), y AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, reached) AS (SELECT DISTINCT a, a FROM y UNION SELECT r.doc_id, y.b FROM r JOIN y ON r.reached = y.a),
c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT g.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(component_id, g.doc_id) AS component_id, g.doc_id = coalesce(component_id, g.doc_id) AS kept FROM g LEFT JOIN c ON g.doc_id = c.doc_id
"""
