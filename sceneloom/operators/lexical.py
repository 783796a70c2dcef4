"""Ranked text search: an OR prefilter, BM25 over what passes it, and elbow cut-offs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sceneloom.functions.stemming import stemmed_lists
from sceneloom.session import materialised

K1, B = 1.5, 0.75
PREFILTER_ROWS = 1000


def tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case, of two characters at least."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: F.length(t) > 1)


def prefilter(components: DataFrame, terms: Sequence[str], limit: int = PREFILTER_ROWS, caption: str = "caption", tokenise=tokens) -> DataFrame:
    """Rows that have one of the words of ``terms``, both as ``tokenise`` makes them: the ``limit`` with the least ids, not the best ones."""
    return components.where(F.arrays_overlap(tokenise(F.col(caption)), tokenise(F.lit(" ".join(terms))))).orderBy("component_id").limit(limit)


def postings(rows: DataFrame, caption: str = "caption", tokenise=tokens) -> DataFrame:
    """component_id, token, tf, length: the inverted index of the rows."""
    each = rows.select("component_id", tokenise(F.col(caption)).alias("tokens"))
    return each.select("component_id", F.size("tokens").alias("length"), F.explode("tokens").alias("token")).groupBy("component_id", "token", "length").agg(F.count(F.lit(1)).alias("tf"))


def bm25(rows: DataFrame, terms: DataFrame, caption: str = "caption", tokenise=tokens) -> DataFrame:
    """term, component_id, score of the rows for each term (term string) that they match.

    Document frequency, count and mean length are those of ``rows``.  idf is
    ln(1 + (n - df + 0.5) / (df + 0.5)).  Statistics are one row, broadcast.
    """
    index = postings(rows, caption, tokenise)
    stats = rows.select(F.size(tokenise(F.col(caption))).alias("length")).agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"))
    frequency = index.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    wanted = terms.select("term", F.explode(tokenise(F.col("term"))).alias("token"))
    hits = index.join(F.broadcast(wanted), "token").join(frequency, "token").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return hits.groupBy("term", "component_id").agg(F.sum(weight).alias("score")).where("score > 0")


def top_k(scored: DataFrame, k: int | None, by: str | None = None) -> DataFrame:
    """Rows with their rank from 1, the best ``k`` (all, if None) overall or for each value of ``by``; equal scores by id."""
    order = [F.desc("score"), F.asc("component_id")]
    if by is None:
        best = scored if k is None else scored.orderBy(*order).limit(max(1, k))
        return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return ranked if k is None else ranked.where(F.col("rank") <= max(1, k))


def elbow(ranked: DataFrame, gap: float | None = None, ratio: float | None = None, positive: bool = True) -> DataFrame:
    """The ranked rows before the first drop: a gap of ``gap`` or more, a ratio of ``ratio`` or less, or (``positive``) a score of 0.

    The first row stays unless its score is 0 and ``positive`` holds.
    """
    order = Window.orderBy("rank")
    previous = F.lag("score").over(order)
    stop = F.lit(False)
    if positive:
        stop = stop | (F.col("score") <= 0)
    if gap is not None:
        stop = stop | (previous - F.col("score") >= gap)
    if ratio is not None:
        stop = stop | (F.col("score") / F.greatest(previous, F.lit(1e-9)) <= ratio)
    marked = ranked.withColumn("stop", F.when(previous.isNotNull(), stop).otherwise(F.lit(False)).cast("int"))
    kept = marked.withColumn("stopped", F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("stopped = 0").drop("stop", "stopped")
    return kept.where("score > 0") if positive else kept


def search(components: DataFrame, terms: str | Sequence[str], k: int | None = 10, elbow_on: bool = False, gap: float = 1.0, ratio: float = 0.7, candidates: DataFrame | None = None, tokenise=tokens) -> DataFrame:
    """rank, component_id, score, matched_terms.

    A string is one term, a list many; each term gives its own best ``k`` rows (all, if None), whose
    scores are added up.  With one term and ``elbow_on`` the ranking ends at the elbow.
    ``candidates`` (component_id) restricts the rows; blank terms count for nothing.
    """
    cleaned = [t.strip() for t in ([terms] if isinstance(terms, str) else terms) if isinstance(t, str) and t.strip()]
    spark = components.sparkSession
    pool = components if candidates is None else components.join(candidates.select("component_id"), "component_id", "left_semi")
    if not cleaned:
        return spark.createDataFrame([], "rank int, component_id int, score double, matched_terms array<string>")
    rows = materialised(prefilter(pool, cleaned, tokenise=tokenise))  # at most PREFILTER_ROWS, read three times
    each = spark.createDataFrame(list(enumerate(cleaned)), "position int, term string")
    per_term = top_k(bm25(rows, each, tokenise=tokenise), k, "term")
    if len(cleaned) == 1 and elbow_on:
        per_term = elbow(per_term, gap, ratio)
    summed = per_term.join(F.broadcast(each), "term").groupBy("component_id").agg(
        F.sum("score").alias("score"), F.transform(F.array_sort(F.collect_list(F.struct("position", "term"))), lambda x: x["term"]).alias("matched_terms")
    )
    return top_k(summed, k).select("rank", "component_id", "score", "matched_terms")


# Fixed value: English words that are not indexed.
STOPWORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()


def stemmed_tokens(text: Column) -> Column:
    """``tokens`` without stop words, as Snowball stems."""
    return stemmed_lists(F.filter(tokens(text), lambda t: ~t.isin(STOPWORDS)))
