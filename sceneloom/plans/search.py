"""Search by text and by vector."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sceneloom.catalog import query
from sceneloom.functions.vectors import dot, similarity_of_squared, unit
from sceneloom.operators import fulltext, lexical
from sceneloom.operators.components import in_rank_order, shown
from sceneloom.operators.similar import similar_to, similar_until_drop
from sceneloom.operators.spatial import around
from sceneloom.operators.vector_index import search_cells, write_cells
from sceneloom.plans.tables import COMPONENTS, components, rounded, table
from sceneloom.session import shared_dir


def _bm25_sql(terms: list[str], k: int, pool: str = "c") -> str:
    """Ranked per term (term, component_id, score, rank) as CTE ``ranked``."""
    words = ", ".join(f"'{w}'" for t in terms for w in t.lower().split())
    rows = ", ".join(f"({i}, '{t}')" for i, t in enumerate(terms))
    tok = "[t for t in string_split_regex(lower({0}), '[^a-z0-9]+') if length(t) > 1]"
    return f"""{COMPONENTS},
r AS (SELECT component_id, {tok.format('caption')} AS toks FROM {pool} WHERE list_has_any({tok.format('caption')}, [{words}]) ORDER BY component_id LIMIT 1000),
i AS (SELECT component_id, len, tok, count(*) AS tf FROM (SELECT component_id, len(toks) AS len, unnest(toks) AS tok FROM r) GROUP BY ALL),
s AS (SELECT count(*) AS n, avg(len(toks)) AS mean FROM r),
d AS (SELECT tok, count(*) AS df FROM i GROUP BY tok),
q AS (SELECT position, term, unnest({tok.format('term')}) AS tok FROM (VALUES {rows}) v(position, term)),
scored AS (SELECT position, term, component_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))) AS score
           FROM i JOIN q USING (tok) JOIN d USING (tok) CROSS JOIN s GROUP BY ALL),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY round(score, 9) DESC, component_id) AS rank FROM scored WHERE score > 0) WHERE rank <= {k})"""


_BOX = ", ".join(f"round({v}, 6) + 0.0 AS {n}" for n, v in (("x0", "lo[2]"), ("y0", "lo[3]"), ("z0", "lo[1]"), ("x1", "hi[2]"), ("y1", "hi[3]"), ("z1", "hi[1]")))


@query("search_bm25", f"WITH {_bm25_sql(['red widget'], 10)} SELECT CAST(rank AS BIGINT) AS rank, CAST(component_id AS VARCHAR) AS component_id, caption, round(score, 6) AS score, {_BOX} FROM ranked JOIN c USING (component_id)")
def search_bm25(spark, sf_dir):
    """One phrase, ten best, with captions and boxes in the viewer's frame."""
    rows = components(spark, sf_dir)
    ranked = lexical.search(rows, "red widget", 10)
    found = shown(in_rank_order(ranked, rows)).join(ranked.select(F.col("component_id").cast("string"), "score"), "component_id", "left")
    corner = lambda c, i: rounded(F.col("corners")[c][i])
    return found.select(F.col("rank").cast("long").alias("rank"), "component_id", "caption", F.round("score", 6).alias("score"), *[corner(0, i).alias(f"{a}0") for i, a in enumerate("xyz")], *[corner(6, i).alias(f"{a}1") for i, a in enumerate("xyz")])


_MANY = ["small ring", "red", "economy brand"]


@query("search_bm25_terms", f"WITH {_bm25_sql(_MANY, 20)} SELECT component_id, round(sum(score), 6) AS score, array_to_string(list(term ORDER BY position), ',') AS matched_terms FROM ranked GROUP BY component_id ORDER BY round(sum(score), 9) DESC, component_id LIMIT 20")
def search_bm25_terms(spark, sf_dir):
    """Several terms, each with its own best rows, whose scores add up."""
    return lexical.search(components(spark, sf_dir), _MANY, 20).select("component_id", F.round("score", 6).alias("score"), F.array_join("matched_terms", ",").alias("matched_terms"))


@query("search_bm25_elbow", f"""WITH {_bm25_sql(['brand'], 300)}, g AS (SELECT *, lag(score) OVER (ORDER BY rank) AS prev FROM ranked),
m AS (SELECT *, max(CASE WHEN prev IS NULL THEN 0 WHEN score <= 0 OR prev - score >= 0.00001 OR score / greatest(prev, 1e-9) <= 0.7 THEN 1 ELSE 0 END) OVER (ORDER BY rank) AS stopped FROM g)
SELECT CAST(rank AS BIGINT) AS rank, component_id, round(score, 6) AS score FROM m WHERE stopped = 0""")
def search_bm25_elbow(spark, sf_dir):
    """One term, cut off where the score drops."""
    rows = components(spark, sf_dir)
    per_term = lexical.top_k(lexical.bm25(lexical.prefilter(rows, ["brand"]), spark.createDataFrame([("brand",)], "term string")), 300, "term")
    return lexical.elbow(per_term, 1e-5, 0.7).select(F.col("rank").cast("long").alias("rank"), "component_id", F.round("score", 6).alias("score"))


@query("search_prefilter", f"WITH {COMPONENTS} SELECT component_id, caption FROM c WHERE list_has_any([t for t in string_split_regex(lower(caption), '[^a-z0-9]+') if length(t) > 1], ['blue', 'ring']) ORDER BY component_id LIMIT 25")
def search_prefilter(spark, sf_dir):
    return lexical.prefilter(components(spark, sf_dir), ["blue ring"], 25).select("component_id", "caption")


@query("search_bm25_stemmed")
def search_bm25_stemmed(spark, sf_dir):
    """With stop words left out and Snowball stems: no SQL form."""
    rows = components(spark, sf_dir)
    return lexical.search(rows, ["widgets", "the rings"], 10, tokenise=lexical.stemmed_tokens)


_WEB = '"small ring" or widgets -economy or -brand'


@query("search_websearch", f"""WITH {COMPONENTS}, w AS (SELECT component_id, ' ' || array_to_string([t for t in string_split_regex(lower(caption), '[^a-z0-9]+') if t <> ''], ' ') || ' ' AS t FROM c)
SELECT component_id, t LIKE '% small ring %' AS phrase FROM w WHERE t LIKE '% small ring %' OR ((t LIKE '% widget %' OR t LIKE '% widgets %') AND t NOT LIKE '% economy %') OR t NOT LIKE '% brand %'""")
def search_websearch(spark, sf_dir):
    """A phrase, alternatives and negations, through the stored positional index."""
    path = f"{shared_dir(spark)}/sceneloom/{spark.sparkContext.applicationId}/text_index_{uuid.uuid4().hex}"
    fulltext.write_index(components(spark, sf_dir), path)
    index = fulltext.read_index(spark, path)
    phrase = fulltext.matching(index, '"small ring"').withColumn("phrase", F.lit(True))
    return fulltext.matching(index, _WEB).join(phrase, "component_id", "left").select("component_id", F.coalesce("phrase", F.lit(False)).alias("phrase"))


@query("search_around_term")
def search_around_term(spark, sf_dir):
    """Text search among the neighbours of a component (each part of it has its own SQL query)."""
    rows = components(spark, sf_dir)
    near = around(rows, 3, 2.0)
    return lexical.search(near, ["red"], None, candidates=near)


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("component_id"), "embedding")


_DOT = "list_inner_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"


@query("vector_topk", f"SELECT v.vec_id AS component_id, round({_DOT}, 5) AS similarity, round(1 - (2 - 2 * {_DOT}) / 2, 5) AS by_distance FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY round({_DOT}, 9) DESC, v.vec_id LIMIT 10")
def vector_topk(spark, sf_dir):
    """The ten vectors most like one: exact, by dot product, with only the best of each task shuffled."""
    best = similar_to(_vectors(spark, sf_dir), 7, 10)
    return best.select("component_id", F.round("score", 5).alias("similarity"), F.round(similarity_of_squared(2 - 2 * F.col("score")), 5).alias("by_distance"))


@query("vector_index_topk")
def vector_index_topk(spark, sf_dir):
    """Of each vector the ten most like it, by the stored index of all of them: approximate, so without SQL; a test measures recall."""
    path = f"{shared_dir(spark)}/sceneloom/{spark.sparkContext.applicationId}/vector_index_{uuid.uuid4().hex}"
    v = _vectors(spark, sf_dir)
    write_cells(v, path)
    found = search_cells(spark, path, v.select(F.col("component_id").alias("query_id"), "embedding"), 10)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "component_id", F.round("score", 5).alias("score"))


@query("vector_elbow", f"""WITH s AS (SELECT v.vec_id AS component_id, 1 - pow(2 - 2 * {_DOT}, 2) / 2 AS score FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 11) q),
t AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, component_id) AS rank FROM s), g AS (SELECT *, lag(score) OVER (ORDER BY rank) AS prev FROM t WHERE rank <= 50),
m AS (SELECT *, max(CASE WHEN prev - score >= 0.05 THEN 1 ELSE 0 END) OVER (ORDER BY rank) AS stopped FROM g WHERE rank > 1)
SELECT component_id, CAST(rank AS BIGINT) AS rank, round(score, 4) AS score FROM (SELECT component_id, rank, score, 0 AS stopped FROM g WHERE rank = 1 UNION ALL SELECT component_id, rank, score, stopped FROM m) WHERE stopped = 0""")
def vector_elbow(spark, sf_dir):
    """The likeness that the service reports, cut off at its first gap."""
    found = similar_until_drop(_vectors(spark, sf_dir), 11)
    return found.select("component_id", F.col("rank").cast("long").alias("rank"), F.round("score", 4).alias("score"))


@query("vector_representatives", """WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings), m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS c FROM e GROUP BY label, i),
d AS (SELECT e.label, vec_id, sum(CAST(x AS DOUBLE) * c) AS s FROM e JOIN m ON e.label = m.label AND e.i = m.i GROUP BY e.label, vec_id)
SELECT label, vec_id AS representative FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(s, 9) DESC, vec_id) AS r FROM d) WHERE r = 1""")
def vector_representatives(spark, sf_dir):
    """Of each label the vector most like the label's mean."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    mean = v.groupBy("label", "i").agg(F.avg("x").alias("c"))
    score = v.join(mean, ["label", "i"]).groupBy("label", "vec_id").agg(F.sum(F.col("x") * F.col("c")).alias("s"))
    first = Window.partitionBy("label").orderBy(F.desc(F.round("s", 9)), "vec_id")
    return score.withColumn("r", F.row_number().over(first)).where("r = 1").select("label", F.col("vec_id").alias("representative"))


@query("vector_unit", "SELECT vec_id, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 4) AS norm FROM embeddings")
def vector_unit(spark, sf_dir):
    """Vectors at length one stay there."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", unit(F.col("embedding")).alias("u"))
    return v.select("vec_id", F.round(F.sqrt(dot(F.col("u"), F.col("u"))), 4).alias("norm"))
