"""Approximate vector search over a stored index: a layered proximity graph for each shard.

Rows are dealt to shards by a hash of their id; a task builds the graph of one shard, whose rows are
bounded in number, and writes it as rows of a table, so neither the driver nor any task holds the whole.  A query walks
down the layers of every shard to its surroundings and looks through them with a beam; the best of the shards
are merged.  All steps are taken for many queries at a time, as array operations.

Where many queries are asked (all vectors, say), a walk through every shard costs their product.  For them there are cells
(``write_cells``, ``search_cells``): rows lie with the nearest of about sqrt(n) centres, a query is compared with the
rows of so many cells as a measurement against all rows asks for, and blocks of cells meet chunks of queries in tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Links of a node (twice as many in the lowest layer), beam of the construction and of the search.
LINKS, BUILD_BEAM, SEARCH_BEAM = 32, 200, 128
#: Rows of a shard on average, and queries that a task takes at a time.
SHARD_ROWS, QUERY_CHUNK = 10_000, 4096
#: Nodes that are put into a graph together, and nodes that a step of the beam expands.
_BATCH, _WIDTH = 256, 4
#: Beam in the upper layers.
_NARROW = 24
#: Rows that centres are fitted on and centres at most, rounds of the fit, queries that are compared with all rows to see how many cells are needed, and the recall asked for there.
FIT_ROWS, MOST_CELLS, FIT_ROUNDS, TRIED, TARGET = 20_000, 1024, 8, 256, 0.95
#: Rows of a block of cells, and queries of a chunk that meets it.
CELL_BLOCK, CELL_CHUNK = 50_000, 8192
_NODE = "shard int, position int, component_id long, embedding array<float>, links array<array<int>>"


def beam(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, scores) of the ``width`` best that each query reaches from its entries (queries, k), best first; -1 where there are fewer.

    ``links`` (nodes, most) holds -1 where a node has fewer.
    """
    n, asked = len(links), len(queries)
    seen = np.zeros((asked, n + 1), bool)
    seen[:, n] = True  # what -1 points to
    nodes = np.full((asked, width), -1, np.int32)
    scores = np.full((asked, width), -np.inf, np.float32)
    done = np.ones((asked, width), bool)

    def merge(rows: np.ndarray, new: np.ndarray) -> None:
        new = np.where(seen[rows[:, None], new], -1, new)
        ordered = np.sort(new, 1)[:, ::-1]  # a node may be reached twice in one step
        ordered[:, 1:][ordered[:, 1:] == ordered[:, :-1]] = -1
        seen[rows[:, None], ordered] = True
        fresh = np.where(ordered >= 0, np.einsum("qkd,qd->qk", vectors[ordered], queries[rows]), -np.inf).astype(np.float32)
        all_nodes, all_scores = np.concatenate([nodes[rows], ordered], 1), np.concatenate([scores[rows], fresh], 1)
        all_done = np.concatenate([done[rows], ordered < 0], 1)
        best = np.argsort(-all_scores, 1, kind="stable")[:, :width]
        nodes[rows], scores[rows], done[rows] = (np.take_along_axis(x, best, 1) for x in (all_nodes, all_scores, all_done))

    rows = np.arange(asked)
    merge(rows, entries.astype(np.int32))
    while len(rows := np.flatnonzero(~done.all(1))):
        first = np.argsort(done[rows], 1, kind="stable")[:, :_WIDTH]  # the best ones not expanded yet
        chosen = np.where(np.take_along_axis(done[rows], first, 1), -1, np.take_along_axis(nodes[rows], first, 1))
        done[rows[:, None], first] = True
        near = np.where(chosen[:, :, None] >= 0, links[chosen], -1)
        merge(rows, near.reshape(len(rows), -1))
    return nodes, scores


def diverse(vectors: np.ndarray, own: np.ndarray, candidates: np.ndarray, most: int) -> np.ndarray:
    """(rows, most) of each row's ``candidates`` (-1 for none): from the nearest on those that are nearer to the row than to any one chosen, then the nearest of the others."""
    score = np.where(candidates >= 0, np.einsum("rcd,rd->rc", vectors[candidates], own), -np.inf)
    order = np.argsort(-score, 1, kind="stable")
    candidates, score = np.take_along_axis(candidates, order, 1), np.take_along_axis(score, order, 1)
    held = vectors[candidates]
    among = held @ held.transpose(0, 2, 1)
    chosen = np.zeros(candidates.shape, bool)
    for c in range(candidates.shape[1]):
        near = np.where(chosen[:, :c], among[:, c, :c], -np.inf).max(1, initial=-np.inf)
        chosen[:, c] = (candidates[:, c] >= 0) & (near < score[:, c]) & (chosen[:, :c].sum(1) < most)
    rank = np.argsort(~chosen, 1, kind="stable")[:, :most]
    out = np.take_along_axis(candidates, rank, 1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


def _layer(vectors: np.ndarray, size: int, most: int, width: int, upper: list[np.ndarray]) -> np.ndarray:
    """Links (size, most) over the first ``size`` vectors, put in batch by batch; ``upper`` are the layers above, the topmost first."""
    links = np.full((size, most), -1, np.int32)
    start = 0
    while start < size:
        batch = np.arange(start, min(size, start + min(_BATCH, max(32, start))))
        inner = np.where(batch[:, None] == batch[None, :], -1, batch[None, :].repeat(len(batch), 0))
        if start:
            entries = descend(vectors, upper, vectors[batch], start)
            found, _ = beam(vectors, links[:start], vectors[batch], entries, width)
            inner = np.concatenate([found[:, : 2 * most], inner], 1)
        own = np.argsort(-np.where(inner >= 0, np.einsum("rcd,rd->rc", vectors[inner], vectors[batch]), -np.inf), 1, kind="stable")[:, : 2 * most]
        links[batch] = diverse(vectors, vectors[batch], np.take_along_axis(inner, own, 1), most)
        ends, back = links[batch].ravel(), batch.repeat(most)
        some = ends >= 0
        ends, back = ends[some], back[some]
        order = np.lexsort((-np.einsum("ed,ed->e", vectors[ends], vectors[back]), ends))
        ends, back = ends[order], back[order]
        target, first, count = np.unique(ends, return_index=True, return_counts=True)
        place = np.arange(len(ends)) - first.repeat(count)
        incoming = np.full((len(target), min(2 * most, int(count.max()) if len(count) else 0)), -1, np.int32)
        fits = place < incoming.shape[1]
        incoming[np.arange(len(target)).repeat(count)[fits], place[fits]] = back[fits]
        both = np.concatenate([links[target], np.where((incoming[:, :, None] == links[target][:, None, :]).any(2), -1, incoming)], 1)
        for i in range(0, len(target), _BATCH):
            links[target[i : i + _BATCH]] = diverse(vectors, vectors[target[i : i + _BATCH]], both[i : i + _BATCH], most)
        start = int(batch[-1]) + 1
    return links


def descend(vectors: np.ndarray, upper: list[np.ndarray], queries: np.ndarray, held: int) -> np.ndarray:
    """Entries (queries, some) among the first ``held`` nodes: what a narrow beam through each layer, from the top, leads to."""
    entry = np.zeros((len(queries), 1), np.int32)
    for links in upper:
        own = links if len(links) <= held else np.where(links[:held] < held, links[:held], -1)
        entry, _ = beam(vectors, own, queries, entry, _NARROW)
    return entry


def layers_of(vectors: np.ndarray, links: int = LINKS, width: int = BUILD_BEAM, seed: int = 0) -> tuple[np.ndarray, list[np.ndarray]]:
    """(order, layers): an order of the vectors in which every layer has a first part of them, and the layers' links, from the lowest (all of them) to the topmost."""
    draws = np.random.default_rng(seed).random(len(vectors))
    level = np.floor(-np.log(np.maximum(draws, 1e-300)) / math.log(links)).astype(int)
    order = np.argsort(-level, kind="stable")
    ordered, above = vectors[order], []
    for at in range(int(level.max(initial=0)), -1, -1):
        size = int((level >= at).sum())
        above.append(_layer(ordered, size, 2 * links if not at else links, width, above))
    return order, above[::-1]


def search_layers(vectors: np.ndarray, layers: list[np.ndarray], queries: np.ndarray, k: int, width: int = SEARCH_BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, scores) of the ``k`` best that the beam finds for each query."""
    entry = descend(vectors, layers[:0:-1], queries, len(vectors))
    nodes, scores = beam(vectors, layers[0], queries, entry, max(width, k))
    return nodes[:, :k], scores[:, :k]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float32).reshape(len(column), -1)


def _shard_rows(links: int, width: int):
    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("component_id")
        shard = table["shard"][0].as_py()
        vectors = _matrix(table["embedding"])
        order, layers = layers_of(vectors, links, width, shard)
        own = [[[int(x) for x in layer[i] if x >= 0] for layer in layers if i < len(layer)] for i in range(len(order))]
        moved = table.take(pa.array(order))
        return pa.table({
            "shard": pa.array(np.full(len(order), shard, np.int32)), "position": pa.array(np.arange(len(order), dtype=np.int32)), "component_id": moved["component_id"].cast(pa.int64()),
            "embedding": moved["embedding"].cast(pa.list_(pa.float32())), "links": pa.array(own, pa.list_(pa.list_(pa.int32()))),
        })

    return build


def write_index(vectors: DataFrame, path: str, links: int = LINKS, width: int = BUILD_BEAM, shard_rows: int = SHARD_ROWS) -> None:
    """Writes the index of ``vectors`` (component_id, embedding) to ``path``: shard, position, component_id, embedding, links (by layer, the lowest first).

    Vectors that are null are left out; all others must have one length.  Every row is indexed.
    """
    rows = vectors.where("embedding IS NOT NULL").select("component_id", "embedding")
    shards = max(1, math.ceil(rows.count() / shard_rows))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("component_id", "embedding"), F.lit(shards)).cast("int"))
    graphs = dealt.groupBy("shard").applyInArrow(_shard_rows(links, width), _NODE)
    graphs.write.mode("overwrite").partitionBy("shard").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("position int, component_id long, embedding array<float>, links array<array<int>>, shard int").parquet(path)


def _graph(table: pa.Table) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    table = table.sort_by("position")
    links = table["links"].to_pylist()
    layers = []
    for at in range(max(map(len, links))):
        own = [x[at] for x in links if len(x) > at]
        layer = np.full((len(own), max(1, max(map(len, own)))), -1, np.int32)
        for i, x in enumerate(own):
            layer[i, : len(x)] = x
        layers.append(layer)
    return _matrix(table["embedding"]), layers, table["component_id"].to_numpy()


def _answers(k: int, width: int):
    def search(graph: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        if len(graph) and len(asked):
            vectors, layers, ids = _graph(graph)
            queries, names = _matrix(asked["q"]), asked["query_id"].to_numpy()
            for start in range(0, len(queries), _BATCH):
                nodes, scores = search_layers(vectors, layers, queries[start : start + _BATCH], k, width)
                row, place = np.nonzero(nodes >= 0)
                found.append((names[start : start + _BATCH][row], ids[nodes[row, place]], scores[row, place].astype(np.float64)))
        columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("query_id", "component_id", "score"), columns, strict=True)))

    return search


def search_index(index: DataFrame, queries: DataFrame, k: int = 10, width: int = SEARCH_BEAM) -> DataFrame:
    """query_id, component_id, score, rank: for each query (query_id, embedding) the ``k`` rows of ``index`` with the largest dot product that are found; equal scores (to six decimals) by id.

    Approximate: a wider beam finds more.  Any number of queries: they are dealt into chunks, and a shard
    and a chunk are one task's work.  Null queries have no rows.
    """
    asked = queries.where("embedding IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<float>").alias("q"))
    chunks = max(1, math.ceil(asked.count() / QUERY_CHUNK))
    shards = index.select(F.col("shard").alias("of")).distinct()
    sent = asked.withColumn("to", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int")).crossJoin(F.broadcast(shards))  # as many rows as shards
    graphs = index.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    each = graphs.groupBy("shard", "chunk").cogroup(sent.groupBy("of", "to")).applyInArrow(_answers(k, width), "query_id long, component_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "component_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k)


def centres_of(sample: np.ndarray, cells: int, seed: int = 0) -> np.ndarray:
    """(cells, dimensions): centres of k-means by dot product, each at length one; a cell without rows keeps its centre."""
    centres = sample[np.random.default_rng(seed).choice(len(sample), min(cells, len(sample)), replace=False)].astype(np.float64)
    for at in range(FIT_ROUNDS + 1):
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        if at == FIT_ROUNDS:
            break
        own = (sample @ centres.T.astype(np.float32)).argmax(1)
        order = np.argsort(own, kind="stable")
        held, begin = np.unique(own[order], return_index=True)
        centres[held] = np.add.reduceat(sample[order].astype(np.float64), begin)
    return centres.astype(np.float32)


def write_cells(vectors: DataFrame, path: str) -> None:
    """Writes ``vectors`` (component_id, embedding) by cells to ``path``: rows (cell, component_id, embedding) and centres (cell, centre, rows).

    Centres are fitted on about ``FIT_ROWS`` rows, taken by a hash; every row is indexed, but for null vectors.  All have one length.
    """
    spark = vectors.sparkSession
    rows = vectors.where("embedding IS NOT NULL").select(F.col("component_id").cast("long").alias("component_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    n = rows.count()
    some = F.pmod(F.xxhash64("component_id", "embedding"), F.lit(max(1, n // FIT_ROWS))) == 0
    sample = rows.where(some).limit(2 * FIT_ROWS).select("embedding").toArrow()["embedding"]
    centres = centres_of(_matrix(sample), min(MOST_CELLS, math.ceil(math.sqrt(n)))) if len(sample) else np.zeros((1, 1), np.float32)

    def placed(batches):
        for batch in batches:
            cell = (_matrix(pa.chunked_array([batch["embedding"]])) @ centres.T).argmax(1) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch["component_id"], batch["embedding"]], names=["cell", "component_id", "embedding"])

    rows.mapInArrow(placed, "cell int, component_id long, embedding array<float>").write.mode("overwrite").parquet(f"{path}/rows")
    held = spark.read.parquet(f"{path}/rows").groupBy("cell").agg(F.count(F.lit(1)).alias("rows"))
    known = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<float>")
    known.join(held, "cell").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places (rows, k at most) of the largest of each row, in no order."""
    return np.argpartition(-scores, k - 1, 1)[:, :k] if scores.shape[1] > k else np.arange(scores.shape[1])[None, :].repeat(len(scores), 0)


def scan(queries: np.ndarray, probed: np.ndarray, vectors: np.ndarray, cell: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the ``k`` best ``vectors`` for each query, of those whose ``cell`` it probes (queries, cells); -1 where there are fewer. ``cell`` ascends."""
    places, scores = np.full((len(queries), k), -1, np.int64), np.full((len(queries), k), -np.inf, np.float32)
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, int)
    for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(cell)], strict=False):
        asked = np.flatnonzero(probed[:, cell[start]])
        for i in range(0, end - start, 4096):
            own = vectors[start + i : min(end, start + i + 4096)]
            for j in range(0, len(asked), 2048):
                rows = asked[j : j + 2048]
                got = queries[rows] @ own.T
                better = got.max(1) > scores[rows].min(1)
                rows, got = rows[better], got[better]
                top = _best(got, k)
                both = np.concatenate([scores[rows], np.take_along_axis(got, top, 1)], 1)
                which = np.concatenate([places[rows], top + start + i], 1)
                keep = _best(both, k)
                scores[rows], places[rows] = np.take_along_axis(both, keep, 1), np.take_along_axis(which, keep, 1)
    return places, scores


def _probed(queries: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    """(queries, cells): whether a cell is among the ``probes`` whose centres have the largest dot products with a query."""
    near = queries @ centres.T
    return near >= np.partition(near, len(centres) - probes, 1)[:, len(centres) - probes, None]


def _probes(rows: DataFrame, centres: np.ndarray, names: np.ndarray, tried: np.ndarray, k: int, target: float) -> int:
    """Of so many nearest cells the rows hold the share ``target`` of the ``k`` best of all rows, for the queries ``tried``."""
    place = np.full(int(names.max()) + 1, -1)
    place[names] = np.arange(len(names))

    def best(batches):
        for batch in batches:
            if len(batch):
                top = _best(got := tried @ _matrix(pa.chunked_array([batch["embedding"]])).T, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(tried)).repeat(top.shape[1]).astype(np.int32)), batch["cell"].take(pa.array(top.ravel())), pa.array(np.take_along_axis(got, top, 1).ravel())], names=["query", "cell", "score"])

    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
    found = rows.mapInArrow(best, "query int, cell int, score float").withColumn("rank", rank).where(F.col("rank") <= k).select("query", "cell").toArrow()
    order = np.argsort(-(tried @ centres.T), 1, kind="stable")
    at = np.empty_like(order)
    np.put_along_axis(at, order, np.arange(len(names))[None, :].repeat(len(tried), 0), 1)
    needed = np.sort(at[found["query"].to_numpy(), place[found["cell"].to_numpy()]])
    return int(needed[min(len(needed) - 1, math.ceil(target * len(needed)) - 1)]) + 1


def search_cells(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, target: float = TARGET) -> DataFrame:
    """query_id, component_id, score, rank: for each query (query_id, embedding) the ``k`` rows of ``write_cells`` with the largest dot product that are found; equal scores (to six decimals) by id.

    ``TRIED`` queries are compared with all rows first: as many cells are looked through as hold the share ``target`` of what
    is found there.  Null queries have no rows.
    """
    rows, known = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/centres").orderBy("cell").toArrow()
    asked = queries.where("embedding IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<float>").alias("q"))
    n = asked.count()
    if not len(known) or not n:
        return spark.createDataFrame([], "query_id long, component_id long, score double, rank int")
    centres, names, held = _matrix(known["centre"]), known["cell"].to_numpy(), known["rows"].to_numpy()
    tried = _matrix(asked.where(F.pmod(F.xxhash64("query_id", "q", F.lit(5)), F.lit(max(1, n // TRIED))) == 0).limit(2 * TRIED).union(asked.limit(1)).select("q").toArrow()["q"])
    probes = _probes(rows, centres, names, tried, k, target)
    # cells side by side fill blocks; one that is larger is dealt over several by a hash of its rows
    first = np.maximum(0, np.cumsum(held) - held) // CELL_BLOCK
    last = first + np.maximum(0, -(-held // CELL_BLOCK) - 1)
    blocks, chunks = int(last.max()) + 1, max(1, math.ceil(n / CELL_CHUNK))
    ends = spark.createDataFrame([(int(c), i, int(a), int(b)) for i, (c, a, b) in enumerate(zip(names, first, last, strict=True))], "cell int, at int, first int, last int")

    def sent(batches):
        for batch in batches:
            hit = _probed(_matrix(pa.chunked_array([batch["q"]])), centres, probes) if len(batch) else np.zeros((0, len(names)), bool)
            to = [np.unique(np.concatenate([np.arange(first[c], last[c] + 1) for c in np.flatnonzero(h)])).astype(np.int32) for h in hit] if len(batch) and not (first == last).all() else None
            if to is None:  # each cell lies in one block
                into = np.zeros((len(hit), blocks), bool)
                for b in range(blocks):
                    into[:, b] = hit[:, first == b].any(1)
                row, block = np.nonzero(into)
            else:
                row, block = np.arange(len(to)).repeat([len(t) for t in to]), np.concatenate(to)
            yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), batch["query_id"].take(pa.array(row)), batch["q"].take(pa.array(row))], names=["to", "query_id", "q"])

    def answered(own: pa.Table, asking: pa.Table) -> pa.Table:
        if not len(own) or not len(asking):
            return pa.table({"query_id": pa.array([], pa.int64()), "component_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        own = own.sort_by([("at", "ascending"), ("component_id", "ascending")])
        wanted = _matrix(asking["q"])
        places, scores = scan(wanted, _probed(wanted, centres, probes), _matrix(own["embedding"]), own["at"].to_numpy(), k)
        row, col = np.nonzero(places >= 0)
        return pa.table({"query_id": asking["query_id"].to_numpy()[row], "component_id": own["component_id"].to_numpy()[places[row, col]], "score": scores[row, col].astype(np.float64)})

    dealt = rows.join(F.broadcast(ends), "cell").withColumn("block", (F.col("first") + F.pmod(F.xxhash64("component_id", "embedding"), F.col("last") - F.col("first") + 1)).cast("int"))
    dealt = dealt.select("block", "at", "component_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    sending = asked.mapInArrow(sent, "to int, query_id long, q array<float>").withColumn("in", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int"))
    each = dealt.groupBy("block", "chunk").cogroup(sending.groupBy("to", "in")).applyInArrow(answered, "query_id long, component_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "component_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """query_id, recall: the share of ``exact``'s rows (query_id, component_id) that were found."""
    hits = exact.join(found.select("query_id", "component_id", F.lit(1).alias("hit")), ["query_id", "component_id"], "left")
    return hits.groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
