"""Scores of answers against what was expected, and their summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sceneloom.catalog import query
from sceneloom.functions.alignment import meteor as meteor_score
from sceneloom.operators import evaluation as ev
from sceneloom.plans.tables import rounded, table

_SETS = "WITH e AS (SELECT l_suppkey AS k, list(DISTINCT l_partkey) AS s FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1), p AS (SELECT l_suppkey AS k, list(DISTINCT l_partkey) AS s FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1), h AS (SELECT e.k, len(list_intersect(e.s, p.s)) AS hit, len(e.s) AS ne, len(p.s) AS np FROM e JOIN p USING (k))"


@query("set_scores", f"{_SETS} SELECT k AS supplier, round(hit / np, 6) AS precision, round(hit / ne, 6) AS recall, round(CASE WHEN hit > 0 THEN 2 * (hit / np) * (hit / ne) / (hit / np + hit / ne) ELSE 0 END, 6) AS f1 FROM h")
def set_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    e = rows.where("l_returnflag <> 'A'").groupBy(F.col("l_suppkey").alias("supplier")).agg(F.collect_set("l_partkey").alias("e"))
    p = rows.where("l_linenumber <= 4").groupBy(F.col("l_suppkey").alias("supplier")).agg(F.collect_set("l_partkey").alias("p"))
    return e.join(p, "supplier").select("supplier", *[F.round(v, 6).alias(n) for n, v in ev.set_scores(F.col("e"), F.col("p")).items()])


@query("exact_match", r"""SELECT a.item_id, CASE WHEN regexp_replace(lower(a.text), '[!-/:-@\[-`{-~]', '', 'g') = regexp_replace(lower(b.text), '[!-/:-@\[-`{-~]', '', 'g') AND regexp_replace(lower(a.text), '[!-/:-@\[-`{-~]', '', 'g') <> '' THEN 1.0 ELSE 0.0 END AS em FROM benchmark a JOIN benchmark b ON a.item_id // 2 * 2 = b.item_id""".replace(" THEN 1.0 ELSE 0.0 END", " THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"))
def exact_match(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    other = b.select(F.col("item_id").alias("other"), F.concat(F.lit("!"), "text", F.lit("?.")).alias("prediction"))
    return b.join(other, F.col("item_id") - F.col("item_id") % 2 == F.col("other")).select("item_id", ev.exact_match(F.col("text"), F.col("prediction")).alias("em"))


def _bleu_sql(order: int) -> str:
    grams = lambda t, n: f"[array_to_string(list_slice({t}, i, i + {n - 1}), ' ') for i in range(1, len({t}) - {n - 2})]"
    match = lambda n: f"list_sum([least(len([x for x in {grams('p', n)} if x = g]), len([x for x in {grams('r', n)} if x = g])) for g in list_distinct({grams('p', n)})])"
    logs = " + ".join(f"{w} * ln(CASE WHEN coalesce({match(n)}, 0) > 0 THEN {match(n)} ELSE 0.1 END / greatest(len({grams('p', n)}), 1))" for n, w in enumerate(ev.BLEU_WEIGHTS[order], 1))
    return f"CASE WHEN len(p) = 0 OR coalesce({match(1)}, 0) = 0 THEN 0 ELSE exp({logs} + CASE WHEN len(p) >= len(r) THEN 0 ELSE 1 - len(r) / len(p) END) END"


@query("bleu", "WITH t AS (SELECT a.item_id, string_split(a.text, ' ') AS r, list_slice(string_split(a.text, ' '), 1, 12) || list_slice(string_split(b.text, ' '), 3, 14) AS p FROM benchmark a JOIN benchmark b ON a.item_id + 1 = b.item_id) SELECT item_id, " + ", ".join(f"round({_bleu_sql(n)}, 6) AS bleu{n}" for n in range(1, 5)) + " FROM t")
def bleu(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    words = F.split("text", " ")
    other = b.select((F.col("item_id") - 1).alias("item_id"), F.slice(words, 3, 12).alias("tail"))
    t = b.select("item_id", words.alias("r"), F.slice(words, 1, 12).alias("head")).join(other, "item_id").withColumn("p", F.concat("head", "tail"))
    return t.select("item_id", *[F.round(ev.bleu(F.col("r"), F.col("p"), n), 6).alias(f"bleu{n}") for n in range(1, 5)])


@query("meteor")
def meteor(spark, sf_dir):
    """The score of the pairs of ``bleu``: alignments have no SQL form, tests hold them against all matchings."""
    b = table(spark, sf_dir, "benchmark")
    words = F.split("text", " ")
    other = b.select((F.col("item_id") - 1).alias("item_id"), F.slice(words, 3, 12).alias("tail"))
    t = b.select("item_id", words.alias("r"), F.slice(words, 1, 12).alias("head")).join(other, "item_id").withColumn("p", F.concat("head", "tail"))
    return t.select("item_id", F.round(meteor_score("r", "p"), 6).alias("meteor"))


_RESULTS = "r AS (SELECT o_orderstatus AS category, o_orderpriority AS kind, o_totalprice AS value FROM orders WHERE NOT (o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'))"


def _results(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("NOT (o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')")
    return o.select(F.col("o_orderstatus").alias("category"), F.col("o_orderpriority").alias("kind"), F.col("o_totalprice").alias("value"))


@query("metric_summary", f"WITH {_RESULTS} SELECT category, kind, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, round(median(value), 4) AS median, round(quantile_cont(value, 0.25), 4) AS p25, round(quantile_cont(value, 0.75), 4) AS p75 FROM r GROUP BY category, kind")
def metric_summary(spark, sf_dir):
    found = ev.summary(_results(spark, sf_dir), ["category", "kind"])
    return found.select("category", "kind", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std", "median", "p25", "p75")])


@query("metric_intervals", f"WITH {_RESULTS} SELECT category, round(avg(value), 4) AS mean, round(CASE WHEN count(*) > 1 THEN 1.96 * stddev_samp(value) / sqrt(count(*)) ELSE 0 END, 4) AS ci FROM r GROUP BY category")
def metric_intervals(spark, sf_dir):
    found = ev.intervals(_results(spark, sf_dir), ["category"])
    return found.select("category", F.round("mean", 4).alias("mean"), F.round("ci", 4).alias("ci"))


_KINDS = ["1-URGENT", "2-HIGH", "5-LOW"]


@query("metric_pivot", f"WITH {_RESULTS}, w AS (SELECT category, " + ", ".join(f"coalesce(avg(value) FILTER (kind = '{k}'), 0) AS k{i}" for i, k in enumerate(_KINDS)) + " FROM r GROUP BY category) SELECT category, round(k0, 4) AS k0, round(k1, 4) AS k1, round(k2, 4) AS k2, round((k0 + k1 + k2) / 3, 4) AS aggregate_mean FROM w")
def metric_pivot(spark, sf_dir):
    """Means by kind as columns; a missing one is 0 and counts."""
    wide = ev.pivoted(_results(spark, sf_dir), "category", "kind", _KINDS)
    return wide.select("category", *[rounded(F.col(f"`{k}`"), 4).alias(f"k{i}") for i, k in enumerate(_KINDS)], F.round("aggregate_mean", 4).alias("aggregate_mean"))


@query("metric_counts", "SELECT o_orderpriority AS kind, count(DISTINCT o_custkey) AS benchmarks FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY 1")
def metric_counts(spark, sf_dir):
    """Distinct benchmarks of the kinds that are reported."""
    return table(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin(_KINDS)).groupBy(F.col("o_orderpriority").alias("kind")).agg(F.count_distinct("o_custkey").alias("benchmarks"))


@query("metric_rows", "SELECT doc_id, unnest(['quality', 'toxic']) AS metric, CAST(unnest([quality, toxic]) AS DOUBLE) AS value FROM labels")
def metric_rows(spark, sf_dir):
    """A row for each metric of a result."""
    packed = table(spark, sf_dir, "labels").select("doc_id", F.create_map(F.lit("quality"), F.col("quality").cast("double"), F.lit("toxic"), F.col("toxic").cast("double")).alias("metrics"))
    return ev.long_form(packed)


@query("reply_streams", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, role, text) AS reply, count(*) AS parts FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def reply_streams(spark, sf_dir):
    """The parts of each reply, in order, as one text."""
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    parts = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("reply"), F.count(F.lit(1)).alias("parts"))


@query("page_texts", r"SELECT page_id, regexp_replace(html, '<[^>]+>', '', 'g') AS plain FROM pages")
def page_texts(spark, sf_dir):
    from sceneloom.functions.text import untagged

    return table(spark, sf_dir, "pages").select("page_id", untagged(F.col("html")).alias("plain"))
