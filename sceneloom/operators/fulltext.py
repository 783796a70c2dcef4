"""Full-text search over a stored positional index: words, phrases, OR and minus, with English stems.

The index is three tables: ``postings`` (stem, component_id, positions), dealt to buckets by
the stem and sorted, so that a search reads the buckets of its own words and in them the row groups
of its stems; ``frequencies`` (stem, documents that have it), in the same buckets; and ``documents``
(component_id, words in it).
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sceneloom.functions.stemming import stem, stemmed
from sceneloom.operators.lexical import K1, B, top_k

#: Folders into which the postings are dealt.
BUCKETS = 64

# Fixed value: English words that are not indexed, though they count as positions.
STOPWORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those "
    "am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below "
    "to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()

_WORD = re.compile("[a-z0-9]+")


@dataclass(frozen=True)
class Literal:
    """Stems at distances from the first of them that must occur so, or (``negated``) must not."""

    stems: tuple[tuple[int, str], ...]
    negated: bool = False


def parsed(query: str) -> list[list[Literal]]:
    """The alternatives of a query, each a list of what must hold together.

    Words are joined by AND; "words in quotes", or joined by signs, are a phrase; OR (any case) parts
    alternatives; a minus before a word or phrase negates it.  Stop words drop out but keep their place in a phrase;
    what has none but stop words says nothing, nor does an alternative without anything.
    """
    groups: list[list[Literal]] = [[]]
    for minus, quoted, bare in re.findall(r'(-?)(?:"([^"]*)"?|([^\s"]+))', query):
        if bare.lower() == "or" and not minus:
            groups.append([])
            continue
        words = [(i, w) for i, w in enumerate(_WORD.findall((quoted or bare).lower())) if w not in STOPWORDS]
        if words:
            groups[-1].append(Literal(tuple((i - words[0][0], stem(w)) for i, w in words), bool(minus)))
    return [g for g in groups if g]


@dataclass(frozen=True)
class TextIndex:
    postings: DataFrame
    frequencies: DataFrame
    documents: DataFrame

    def of(self, table: DataFrame, stems: Iterable[str]) -> DataFrame:
        """The rows of ``table`` for some stems, from their buckets."""
        stems = sorted(set(stems))
        spark = table.sparkSession
        asked = spark.createDataFrame([(s,) for s in stems], "stem string").select(_bucket()).distinct().collect()  # the words of one query
        return table.where(F.col("bucket").isin([r["bucket"] for r in asked]) & F.col("stem").isin(stems))


def _bucket():
    return F.pmod(F.xxhash64("stem"), F.lit(BUCKETS)).cast("int").alias("bucket")


def positions(rows: DataFrame, text: str = "caption") -> DataFrame:
    """component_id, stem, positions (ascending, from 1) of ``rows`` (component_id, ``text``), without stop words; null texts have none."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    each = rows.select("component_id", F.posexplode(words).alias("at", "word")).where(~F.col("word").isin(STOPWORDS))
    return each.select("component_id", stemmed("word").alias("stem"), (F.col("at") + 1).alias("at")).groupBy("component_id", "stem").agg(F.array_sort(F.collect_list("at")).alias("positions"))


def write_index(rows: DataFrame, path: str, text: str = "caption") -> None:
    """Writes the index of ``rows`` (component_id, ``text``); ids are one row's each.  A stem that many rows have fills several files."""
    found = positions(rows, text).select(_bucket(), "stem", "component_id", "positions")
    found.repartitionByRange("bucket", "stem", "component_id").sortWithinPartitions("bucket", "stem", "component_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    stored = rows.sparkSession.read.parquet(f"{path}/postings")
    counts = stored.groupBy("bucket", "stem").agg(F.count(F.lit(1)).alias("df"))
    counts.repartition("bucket").sortWithinPartitions("bucket", "stem").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/frequencies")
    lengths = stored.groupBy("component_id").agg(F.sum(F.size("positions")).alias("length"))
    rows.select("component_id").join(lengths, "component_id", "left").select("component_id", F.coalesce("length", F.lit(0)).alias("length")).write.mode("overwrite").parquet(f"{path}/documents")


def read_index(spark: SparkSession, path: str) -> TextIndex:
    tables = [spark.read.schema(f"{columns}, bucket int").parquet(f"{path}/{name}") for name, columns in (("postings", "stem string, component_id long, positions array<int>"), ("frequencies", "stem string, df long"))]
    return TextIndex(*tables, spark.read.schema("component_id long, length long").parquet(f"{path}/documents"))


def matching(index: TextIndex, query: str) -> DataFrame:
    """component_id of the rows that satisfy ``query`` (see ``parsed``); none if it says nothing.

    An occurrence of a phrase is a start at which all its stems stand in place; starts come from the
    positions of the query's stems only.  An alternative of negations alone is looked up among all documents.
    """
    groups = parsed(query)
    spark = index.documents.sparkSession
    literals = [(g, i, len(x.stems), offset, s, x.negated) for g, group in enumerate(groups) for i, x in enumerate(group) for offset, s in x.stems]
    if not literals:
        return index.documents.select("component_id").limit(0)
    parts = F.broadcast(spark.createDataFrame(literals, "alternative int, literal int, parts int, offset int, stem string, negated boolean"))  # the words of one query
    wanted = F.broadcast(spark.createDataFrame([(g, sum(not x.negated for x in group)) for g, group in enumerate(groups)], "alternative int, needed int"))
    placed = index.of(index.postings, [x[4] for x in literals]).join(parts, "stem")
    starts = placed.select("component_id", "alternative", "literal", "parts", "negated", "offset", F.explode("positions").alias("at")).withColumn("start", F.col("at") - F.col("offset"))
    held = starts.groupBy("component_id", "alternative", "literal", "parts", "negated", "start").agg(F.countDistinct("offset").alias("found")).where("found = parts").select("component_id", "alternative", "literal", "negated").distinct()
    positive = F.count(F.when(~F.col("negated"), 1))
    judged = held.groupBy("component_id", "alternative").agg(positive.alias("positive"), F.max("negated").alias("barred")).join(wanted, "alternative")
    met = judged.where("needed > 0 AND positive = needed AND NOT barred").select("component_id")
    for g, group in enumerate(groups):
        if all(x.negated for x in group):
            met = met.unionByName(index.documents.join(held.where(F.col("alternative") == g), "component_id", "left_anti").select("component_id"))
    return met.distinct()


def search(index: TextIndex, query: str, k: int | None = 10) -> DataFrame:
    """rank, component_id, score: the best ``k`` (all, if None) of the rows that satisfy ``query``, by BM25 over its stems that are not negated, with the document frequencies, count and mean length of the whole index; equal scores by id."""
    stems = sorted({s for group in parsed(query) for x in group if not x.negated for _, s in x.stems})
    stats = index.documents.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"))  # one row
    terms = index.of(index.postings, stems).drop("bucket").join(F.broadcast(index.of(index.frequencies, stems).select("stem", "df")), "stem")  # the words of one query
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.size("positions")
    weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    met = matching(index, query)
    scores = terms.join(met, "component_id", "left_semi").join(index.documents, "component_id").crossJoin(F.broadcast(stats)).groupBy("component_id").agg(F.sum(weight).alias("score"))
    ranked = met.join(scores, "component_id", "left").select("component_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    return top_k(ranked, k).select("rank", "component_id", "score")
