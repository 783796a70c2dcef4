"""Scores of answers and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sceneloom.functions.text import plain


def set_scores(expected: Column, predicted: Column) -> dict[str, Column]:
    """precision, recall and f1 of arrays taken as sets; 0 where something is empty."""
    share = lambda n, d: F.when(d > 0, n / d).otherwise(F.lit(0.0))
    hits = F.size(F.array_intersect(expected, predicted))
    p, r = share(hits, F.size(F.array_distinct(predicted))), share(hits, F.size(F.array_distinct(expected)))
    return {"precision": p, "recall": r, "f1": share(2 * p * r, p + r)}


def exact_match(expected: Column, predicted: Column) -> Column:
    a, b = plain(F.coalesce(expected, F.lit(""))), plain(F.coalesce(predicted, F.lit("")))
    return F.when((a == b) & (F.length(a) > 0), 1.0).otherwise(0.0)


def ngrams(tokens: Column, n: int) -> Column:
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), "\x01"))).otherwise(F.array().cast("array<string>"))


def clipped(expected: Column, predicted: Column, n: int) -> tuple[Column, Column]:
    """(matches, total): n-grams of the prediction that the expectation has, each counted as often as there at most."""
    own, ref = ngrams(predicted, n), ngrams(expected, n)
    count = lambda grams, g: F.size(F.filter(grams, lambda x: x == g))
    return F.aggregate(F.array_distinct(own), F.lit(0), lambda s, g: s + F.least(count(own, g), count(ref, g))), F.size(own)


# Weights of the n-gram orders; those of the third sum to 0.99 as in the original evaluation.
BLEU_WEIGHTS = {1: (1.0,), 2: (0.5, 0.5), 3: (0.33, 0.33, 0.33), 4: (0.25, 0.25, 0.25, 0.25)}


def bleu(expected: Column, predicted: Column, order: int) -> Column:
    """BLEU of token arrays with one reference; an order without matches counts 0.1 of one, and without any unigram match it is 0."""
    pieces = [clipped(expected, predicted, n) for n in range(1, order + 1)]
    logs = sum((w * F.log(F.when(m > 0, m.cast("double")).otherwise(0.1) / F.greatest(t, F.lit(1))) for w, (m, t) in zip(BLEU_WEIGHTS[order], pieces, strict=True)), F.lit(0.0))
    short = F.when(F.size(predicted) >= F.size(expected), 0.0).otherwise(1 - F.size(expected) / F.size(predicted))
    return F.when((F.size(predicted) == 0) | (pieces[0][0] == 0), 0.0).otherwise(F.exp(logs + short))


def summary(results: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Mean, population deviation, median and quartiles of each group; a missing value counts as 0."""
    v = F.coalesce(F.col(value), F.lit(0.0))
    return results.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.median(v).alias("median"), F.percentile(v, F.lit(0.25)).alias("p25"), F.percentile(v, F.lit(0.75)).alias("p75"))


def intervals(results: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Mean and half width of its 95 % interval; 0 for a single value."""
    n = F.count(value)
    return results.groupBy(*by).agg(F.avg(value).alias("mean"), F.when(n > 1, 1.96 * F.stddev_samp(value) / F.sqrt(n)).otherwise(0.0).alias("ci"))


def pivoted(results: DataFrame, category: str, kind: str, kinds: list[str], value: str = "value") -> DataFrame:
    """A row for each category with the mean of each kind, 0 where there is none, and the unweighted mean of those."""
    wide = results.groupBy(category).pivot(kind, kinds).agg(F.avg(value)).na.fill(0.0, kinds)
    return wide.withColumn("aggregate_mean", sum((F.col(f"`{k}`") for k in kinds), F.lit(0.0)) / len(kinds))


def long_form(results: DataFrame, metrics: str = "metrics") -> DataFrame:
    """A row for each metric of a map column."""
    return results.select("*", F.explode(metrics).alias("metric", "value")).drop(metrics)
