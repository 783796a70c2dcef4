"""Exact duplicates through an extendible-hash index on shared files (operator 2); DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sceneloom.llm.shared import checked_broadcast, cut, documents, fold_ascii_column

#: Rows that a bucket may hold before it is split by one more bit of the hash, doubling the directory where need be.
BUCKET_ROWS = 8192
#: Bits by which the directory grows at a time, at least, while it still has overfull buckets.
_STEP = 2


def directory(records: DataFrame, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, int]:
    """(cell, depth, bucket, pages) for each cell of the directory that has rows, and the directory's depth in bits.

    ``records`` has h, a 64-bit hash.  A cell is the hash's leading bits to the full depth.
    A bulk load begins at the depth at which an even spread would fill the buckets; from there
    on, every bucket with more than ``bucket_rows`` rows is split bit by bit until its
    parts fit, the directory doubling as it must.  Only the cells of overfull buckets are
    looked at again.  Rows of one hash cannot be split: they are a chain that fills several
    pages of ``bucket_rows`` rows.  The cells of an unsplit bucket share it: bucket = 1 followed by its bits.
    """
    level = max(0, math.floor(math.log2(max(1, records.count() / bucket_rows))))
    prefix = lambda bits: F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")
    settled, open_rows, depths = [], records.select("h"), []
    while True:
        sized = open_rows.groupBy(prefix(level).alias("bits")).agg(F.count(F.lit(1)).alias("rows"), F.min("h").alias("low"), F.max("h").alias("high"))
        sized = cut(sized.withColumn("fits", (F.col("rows") <= bucket_rows) | (F.col("low") == F.col("high"))))
        settled.append(sized.where("fits").select(F.lit(level).alias("depth"), "bits", F.greatest(F.lit(1), F.ceil(F.col("rows") / bucket_rows)).cast("int").alias("pages")))
        depths.append(level)
        overfull = sized.where("NOT fits")
        common = overfull.agg(F.min(64 - F.length(F.bin(F.col("low").bitwiseXOR(F.col("high"))))).alias("bits")).first()["bits"]
        if common is None:
            break
        open_rows = open_rows.join(checked_broadcast(overfull.select("bits")), prefix(level) == F.col("bits"), "left_semi")
        level = min(64, max(level + _STEP, common + 1))  # up to ``common`` bits no bucket would come apart
    # each bucket stands in the directory once for every cell below it that has rows
    cells = records.select(prefix(level).alias("cell")).distinct()
    for depth, part in zip(depths, settled, strict=True):
        found = cells.withColumn("bits", F.expr(f"shiftrightunsigned(cell, {level - depth})") if depth else F.lit(0).cast("long")).join(part, "bits")
        found = found.select("cell", "depth", (F.shiftleft(F.lit(1).cast("long"), depth) + F.col("bits")).alias("bucket"), "pages")
        all_cells = found if depth == depths[0] else all_cells.unionByName(found)
    return cut(all_cells), level


def exact_groups(docs: DataFrame, bucket_rows: int = BUCKET_ROWS, key: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of ``docs`` (doc_id, text; others are not read).

    Texts are equal if they are the same bytes with A-Z in lower case; null counts as
    empty.  Of equal texts the row with the largest doc_id stays.  Rows that repeat id
    and text share their fate; a null id stays only where the group has no other.  ``key`` makes the 64-bit hash
    of the index; texts that collide in it are told apart by their bytes.

    The index records (bucket, page, hash, digest, id) go to shared files, the pages of a bucket to an owner task; a
    chain longer than a page is dealt over its pages by id, so a hot text has many owners.  Owners
    walk the chains of several rows in their pages: the bytes of their texts are compared by grouping
    within the page first, then over the pages of the bucket.  A chain of one text gives its group to all
    its rows; in a chain of several texts (hashes that collide) each row looks for its own bytes.
    """
    texts = docs.select("doc_id", fold_ascii_column(F.coalesce("text", F.lit(""))).alias("norm"))
    records = cut(texts.select("doc_id", key(F.col("norm")).alias("h"), F.unhex(F.sha2("norm", 256)).alias("digest")))
    cells, depth = directory(records, bucket_rows)
    cells = checked_broadcast(cells.select("cell", "bucket", "pages"))
    cell_of = F.shiftrightunsigned("h", 64 - depth) if depth else F.lit(0).cast("long")
    page_of = lambda row: F.pmod(F.xxhash64("doc_id", *row), F.col("pages")).cast("int")
    located = records.withColumn("cell", cell_of).join(cells, "cell").select("bucket", page_of(["digest"]).alias("page"), "h", "digest", "doc_id")
    index = cut(located.repartition("bucket", "page").sortWithinPartitions("bucket", "page", "h"))
    crowded = index.groupBy("bucket", "page", "h").agg(F.count(F.lit(1)).alias("rows")).groupBy("bucket", "h").agg(F.sum("rows").alias("rows"))
    crowded = cut(crowded.where("rows > 1").select("bucket", "h"))
    chained = texts.withColumn("h", key(F.col("norm"))).join(checked_broadcast(crowded), "h")
    paged = chained.withColumn("cell", cell_of).join(cells.select("cell", "pages"), "cell").withColumn("page", page_of([F.unhex(F.sha2("norm", 256))]))
    in_page = paged.groupBy("bucket", "page", "h", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = cut(in_page.groupBy("bucket", "h", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")))
    kinds = cut(groups.groupBy("bucket", "h").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("bucket", "h"))
    alone = groups.join(checked_broadcast(kinds), ["bucket", "h"], "left_anti").select("bucket", "h", "keep_id", "group_size")
    mixed = groups.join(checked_broadcast(kinds), ["bucket", "h"], "left_semi")
    out = lambda rows: rows.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
    unmixed = index.join(checked_broadcast(kinds), ["bucket", "h"], "left_anti").join(checked_broadcast(cut(alone)), ["bucket", "h"], "left")
    collided = chained.join(checked_broadcast(kinds), ["bucket", "h"], "left_semi").join(mixed, ["bucket", "h", "norm"]).withColumn("digest", F.unhex(F.sha2("norm", 256)))
    return out(unmixed).unionByName(out(collided))


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""
