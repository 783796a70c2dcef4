"""A corpus made ready for training: five stages, each over all that the one before has kept.

Quality classifier, repeated line windows, near-duplicate documents, long repeated
substrings, packing.  All stages but the last return the columns of ``documents``, and no others that a table may have; n_chars
follows the text.  Rows need no id and may repeat one: no stage tells rows apart by doc_id alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneloom.llm.line_dedup import drop_repeated_windows
from sceneloom.llm.ngram_join import ngram_components
from sceneloom.llm.packing import packed_words
from sceneloom.llm.quality import THRESHOLD, learned, score_rows
from sceneloom.llm.repeats import PASSAGE_BYTES, drop_repeats, whole_characters
from sceneloom.llm.shared import checked_broadcast, cut, documents, short_batches

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_text(rows: DataFrame, text) -> DataFrame:
    return rows.withColumn("text", text).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long"))).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives ``THRESHOLD`` or more; a null text is scored as an empty one, repeated rows alike."""
    short_batches(spark)
    return score_rows(docs, learned(spark, sf_dir)).where(F.col("quality_score") >= THRESHOLD).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of windows of three lines; null texts and those of which nothing is left go.  Rows that repeat id and text are one document here: none is cut for the other's sake."""
    return _with_text(drop_repeated_windows(docs), F.col("kept_text")).where("text IS NOT NULL AND text <> ''")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, likeness 0.8 or more) one row: that with the least id (null last), then by a hash of id and text.

    Rows are told apart by id and text (62 bits of a hash), so the texts of a repeated id and the rows without
    one are documents of their own; of rows that repeat both, one stays.
    """
    rows = docs.select(*COLUMNS, F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2).alias("key"))
    repeated = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("often")).where("often > 1").select("key"))
    if repeated.limit(1).count():
        repeated = checked_broadcast(repeated)
        first = rows.join(repeated, "key", "left_semi").groupBy("key").agg(F.min(F.struct(*COLUMNS)).alias("row"))
        rows = cut(rows.join(repeated, "key", "left_anti").unionByName(first.select("row.*", "key")))
    alike = ngram_components(rows.select(F.col("key").alias("doc_id"), "text")).where("component_id <> doc_id")
    alike = cut(alike.select(F.col("doc_id").alias("key"), F.col("component_id").alias("component")))
    alike = cut(alike.unionByName(alike.select(F.col("component").alias("key"), "component").distinct()))
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))
    stay = cut(rows.select("key", "doc_id").join(checked_broadcast(alike), "key").groupBy("component").agg(least["key"].alias("key")).select("key"))
    others = cut(alike.select("key").join(checked_broadcast(stay), "key", "left_anti"))
    return rows.join(checked_broadcast(others), "key", "left_anti").select(*COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without bytes of strings of ``PASSAGE_BYTES`` (a passage of 50 words) that occur elsewhere, repeated rows included.

    Characters that a cut leaves incomplete go, too, and so do null and empty texts.
    """
    cleaned = drop_repeats(docs.select(*COLUMNS), PASSAGE_BYTES)
    return _with_text(cleaned, F.when(F.col("n_removed") == 0, F.col("text")).otherwise(whole_characters(F.col("kept")))).where("text IS NOT NULL AND text <> ''")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with its length, bucket and batch, for every row (null texts have length 0, null ids come first)."""
    return packed_words(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", substrings),
    ("packing", packed),
]

#: The classifier's scores have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``, each written to the shared folder and read back for the next."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
