import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sceneloom.llm import minhash as mh
from sceneloom.llm import ngram_join as nj
from test_ngram_join import brute


def components(df, *args):
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in mh.minhash_components(df, *args).collect())


@pytest.mark.parametrize(("width", "likeness"), [(2, (80, 100)), (5, (80, 100))])
def test_same_as_brute_force(docs, rows, width, likeness):
    df = docs.where("doc_id IS NOT NULL").select("*", F.lit(1).alias("kept"), F.lit("x").alias("component"))
    got = mh.minhash_components(df, width, likeness).collect()
    assert sorted(tuple(r)[:3] for r in got) == brute([(i, t) for i, t, *_ in rows if i is not None], width, *likeness)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def chained(prose, seed, n):
    """Texts along chains of small edits, so that components hang on single links."""
    rng = random.Random(seed)
    out, w = [], prose(rng, 70).split()
    for i in range(n):
        if i % 12 == 0:
            w = prose(rng, rng.choice([8, 20, 70])).split()
        else:
            w = list(w)
            w[rng.randrange(len(w))] = f"e{rng.randrange(50)}"
        out.append((i, " ".join(w)))
    return out


def test_chains_of_links(spark, prose):
    rows = chained(prose, 5, 150)
    assert components(spark.createDataFrame(rows, "doc_id long, text string"), 2, (80, 100)) == brute(rows, 2, 80, 100)


def test_large_groups_in_blocks(spark, prose, monkeypatch):
    """With tiny blocks, where keys of many documents are compared in parts, nothing is lost."""
    monkeypatch.setattr(nj, "BLOCK_DOCS", 8)
    monkeypatch.setattr(nj, "GROUP_DOCS", 3)
    monkeypatch.setattr(mh, "PAIR_DOCS", 2)
    rng = random.Random(1)
    base = prose(rng, 120).split()
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 20)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    assert components(spark.createDataFrame(rows, "doc_id long, text string"), 2, (80, 100)) == brute(rows, 2, 80, 100)


def test_rows_without_id_and_empty_tables(spark, empty, prose):
    rng = random.Random(3)
    a, b = prose(rng, 80), prose(rng, 90)
    assert mh.minhash_components(empty).collect() == []
    rows = [(None, a), (None, b), (None, b), (None, " "), (None, None), (9, b + " x"), (12, "")]
    got = {(r["doc_id"], r["component_id"], r["kept"], r["n_shingles"] > 0) for r in mh.minhash_components(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == {(None, None, True, True), (None, 9, False, True), (None, None, True, False), (9, 9, True, True), (12, 12, True, False)}


def test_minhashes_agree_as_sets_are_alike():
    rng = np.random.default_rng(2)
    union = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    tokens, bounds = np.concatenate([union[:900], union[100:]]), np.array([0, 900, 1800, 1800])
    got = mh.minhashes(tokens, bounds, 800)
    assert abs((got[0] == got[1]).mean() - 0.8) < 0.05 and not got[2].any()
    assert mh.agreement(48, 0.8) == 19


def test_every_pair_of_bands_is_a_table(spark):
    """A key is shared just where a band of either collection is equal."""
    rng, bands, rows = np.random.default_rng(6), 4, 2
    a = rng.integers(0, 3, 2 * bands * rows)
    b = np.where(rng.random(len(a)) < 0.6, a, a + 1)
    df = spark.createDataFrame([(0, a.tolist()), (1, b.tolist())], "i int, s array<int>")
    one, two = (set(r["k"]) for r in df.select(mh.table_keys(F.col("s"), bands, rows).alias("k"), "i").orderBy("i").collect())
    same = (a == b).reshape(2, bands, rows).all(2)
    assert len(one) == bands**2 and len(one & two) == same[0].sum() * same[1].sum()


def test_forest_spans_what_agrees():
    rng = np.random.default_rng(8)
    signatures, component = rng.integers(0, 3, (60, 12)), rng.integers(0, 20, 60)
    edges = mh.spanning(signatures, component, 7)
    near = ((signatures[:, None] == signatures[None]).sum(2) >= 7) & (component[:, None] != component[None])
    assert all(near[i, j] for i, j in edges)

    def labels(pairs):
        head = list(range(60))
        for i, j in pairs:
            a, b = head[i], head[j]
            head = [min(a, b) if h in (a, b) else h for h in head]
        return head

    assert labels(edges) == labels(zip(*np.nonzero(near), strict=True)) and len(edges) == 60 - len(set(labels(edges)))


def test_rows_joined_before_are_one_node():
    """Then a forest connects what it did, with an edge less for each row joined."""
    rng = np.random.default_rng(8)
    signatures, component = rng.integers(0, 3, (60, 12)), rng.integers(0, 20, 60)
    whole, joined = mh.spanning(signatures, component, 7), list(range(60))
    for i, j in whole[: len(whole) // 2]:
        joined = [min(joined[i], joined[j]) if x in (joined[i], joined[j]) else x for x in joined]
    more = mh.spanning(signatures, component, 7, np.array(joined))
    near = ((signatures[:, None] == signatures[None]).sum(2) >= 7) & (component[:, None] != component[None])
    assert len(more) == len(whole) - len(whole) // 2 and all(near[i, j] and joined[i] != joined[j] for i, j in more)
    assert mh.spanning(signatures, component, 7, np.zeros(60, np.int64)) == []


def test_forests_grow_with_the_documents(spark, prose, monkeypatch):
    """Documents alike but not enough to link meet on many keys, part by part: their forests have a few rows a document, not one for each key and part."""
    monkeypatch.setattr(nj, "BLOCK_DOCS", 16)
    made, counted = spark.sparkContext.accumulator(0), mh._forest_rows

    def rows(least):
        def run(batches):
            for batch in counted(least)(batches):
                made.add(len(batch))
                yield batch

        return run

    monkeypatch.setattr(mh, "_forest_rows", rows)
    rng = random.Random(4)
    base = prose(rng, 100)
    docs = [(i, f"{base} {prose(rng, 22)}") for i in range(120)] + [(200 + i, prose(rng, 60)) for i in range(20)]
    assert components(spark.createDataFrame(docs, "doc_id long, text string"), 2, (80, 100)) == brute(docs, 2, 80, 100)
    assert 119 <= made.value < (2 * mh.FIRST_KEYS + 2) * 120  # a document is in two size classes
