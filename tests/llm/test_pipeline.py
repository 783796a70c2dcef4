"""The pipeline's stages against brute force over the smallest tables, each on what the one before has kept."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_dedup import removed, windows_removed
from test_ngram_join import brute

import corpus_pipeline as cp
from sceneloom.llm import quality, repeats
from sceneloom.llm.shared import cut

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for _, stage in cp.STAGES:
        out.append(cut(stage(spark, out[-1], DATA)))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_names_and_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "suffix-array dedup", "packing"]
    for df in stages[1:-1]:
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert all(r["n_chars"] == len(r["text"]) for r in df.collect())


def test_quality_stage(spark, stages):
    scores = quality.score_rows(stages[0], quality.learned(spark, DATA)).collect()
    assert texts(stages[1]) == {r["doc_id"]: r["text"] for r in scores if r["quality_score"] >= quality.THRESHOLD}
    good = {r["doc_id"] for r in spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1").collect()}
    assert len(good & set(texts(stages[1]))) >= 0.97 * len(good)


def test_line_stage(stages):
    want = windows_removed(texts(stages[1]).items(), 3)
    assert texts(stages[2]) == {i: t for i, t in want.items() if t}


def test_near_duplicate_stage(stages):
    groups = {i: c for i, _, c in brute(list(texts(stages[2]).items()), 5, 80, 100)}
    assert set(texts(stages[3])) == {i for i, c in groups.items() if i == c}
    assert len(texts(stages[3])) < len(groups)


def test_near_duplicates_of_repeated_and_missing_ids(spark, prose):
    rng = random.Random(6)
    a, b, c, d, e = (prose(rng, 80) for _ in range(5))
    rows = [(5, a), (5, b), (1, a + " x"), (9, b + " x"), (None, c), (None, c), (None, c + " x"), (None, d), (7, e), (7, e), (8, e)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in cp.near_duplicates(spark, docs, DATA).collect()]
    assert sorted(((i, t) for i, t in got if i is not None)) == sorted([(1, a + " x"), (5, b), (7, e)])
    others = [t for i, t in got if i is None]
    assert len(others) == 2 and d in others and set(others) < {c, c + " x", d}


def test_substring_stage(stages):
    before = texts(stages[3])
    gone = removed([t.encode() for t in before.values()], repeats.PASSAGE_BYTES)
    kept = {i: bytes(x for x, g in zip(t.encode(), m, strict=True) if not g).decode("utf-8", "ignore") for (i, t), m in zip(before.items(), gone, strict=True)}
    assert texts(stages[4]) == {i: t for i, t in kept.items() if t}
    assert any(any(m) for m in gone)


def test_packing_stage(spark, stages):
    rows = stages[5].collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts(stages[4]))
    assert all(r["batch_rows"] * r["padded_length"] <= 65_536 or r["batch_rows"] == 1 for r in rows)
    again = {(r["doc_id"], r["n_tokens"]) for r in cp.run(spark, DATA).collect()}
    assert again == {(r["doc_id"], r["n_tokens"]) for r in rows}


def test_empty_documents(spark, stages):
    docs = stages[0].limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.collect() == []


def test_stages_take_odd_rows(spark, docs, rows):
    """Null, empty, very long, tied and repeated rows, and columns of clashing names, in each stage by itself."""
    more = docs.withColumns({"gone": F.lit(1), "row_id": F.lit("x"), "key": F.lit(2), "starts": F.lit(3)})
    kept = {name: stage(spark, more, DATA).collect() for name, stage in cp.STAGES}
    full = [(i, t) for i, t, *_ in rows if t]
    own = Counter((r["doc_id"], r["text"]) for r in kept["quality classifier"])
    assert all(n <= Counter((i, t) for i, t, *_ in rows)[k] for k, n in own.items())
    cut = windows_removed([(i, t) for i, t, *_ in rows if i is not None], 3)
    assert {(r["doc_id"], r["text"]) for r in kept["line dedup"] if r["doc_id"] is not None} == {(i, t) for i, t in cut.items() if t}
    assert {r["text"] for r in kept["n-gram Jaccard join"]} <= {t for _, t, *_ in rows} and len(kept["n-gram Jaccard join"]) < len(rows)
    assert {None, "", "  \n\t "} <= {r["text"] for r in kept["n-gram Jaccard join"]}
    gone = removed([t.encode() for _, t in full], repeats.PASSAGE_BYTES)
    want = [(i, bytes(x for x, g in zip(t.encode(), m, strict=True) if not g).decode("utf-8", "ignore")) for (i, t), m in zip(full, gone, strict=True)]
    assert Counter((r["doc_id"], r["text"]) for r in kept["suffix-array dedup"]) == Counter((i, t) for i, t in want if t)
    assert Counter(r["doc_id"] for r in kept["packing"]) == Counter(i for i, *_ in rows)
