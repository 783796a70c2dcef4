import math

import numpy as np
import pytest

from sceneloom.llm import whitening
from sceneloom.llm.whitening import Moments, moments, op11_embedding_whitening, symmetric_qr, whitened

SCHEMA = "vec_id long, embedding array<float>, n string, whitened int"


def brute(rows, top=8):
    """By definition, with numpy's own solver and whole numbers of any size."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for _, v in kept])
    n, s = len(x), x.sum(0)
    centred = x - s / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:top], vectors[:, ::-1][:, :top]
    scores = centred @ vectors / np.sqrt(values)
    deviation = [sum((n * int(c) - int(t)) ** 2 for c, t in zip(r, s, strict=True)) for r in x]
    return kept, n, deviation, scores, values / np.trace(centred.T @ centred / n)


def made(rng, n, dim=12):
    spread = np.linspace(0.05, 0.6, dim)
    return [(i, [float(c) for c in rng.normal(0.3, spread).astype(np.float32)]) for i in range(n)]


def same(got, rows, top=8):
    kept, n, deviation, scores, explained = brute(rows, top)
    by_key = {(r["vec_id"], r["component"]): r for r in got}
    assert len(got) == len(kept) * scores.shape[1] and len(by_key) == len(got)
    for k in range(scores.shape[1]):
        own = np.array([by_key[i, k + 1]["whitened"] for i, _ in kept])
        sign = np.sign(own @ scores[:, k])
        assert np.allclose(own * sign, scores[:, k], atol=1e-8)
        for (i, _), d in zip(kept, deviation, strict=True):
            r = by_key[i, k + 1]
            assert (r["n"], r["deviation"], int(r["deviation_exact"])) == (n, d, d)
            assert r["explained"] == pytest.approx(explained[k], rel=1e-9) and r["identity_error"] < 1e-9


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_same_as_definition(spark, parts):
    rng = np.random.default_rng(parts)
    rows = made(rng, 300)
    rows += [(1000 + i, rows[0][1]) for i in range(100)]  # a third are one vector
    bad = [(2000, None), (2001, [None] + rows[0][1][1:]), (2002, [float("nan")] + rows[0][1][1:]), (2003, [float("-inf")] * 12), (2004, [])]
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows + bad], SCHEMA).repartition(parts)
    same(whitened(df).collect(), rows + bad)


def test_query_on_the_given_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    same(op11_embedding_whitening(spark, folder).collect(), rows)


def test_eigenvectors_of_many_kinds():
    rng = np.random.default_rng(3)
    cases = [np.zeros((3, 3)), np.eye(4), np.array([[2.0]]), np.diag([1e-9, 5.0, 1e9]), np.ones((6, 6))]
    cases += [(lambda m: m @ m.T)(rng.normal(size=(k, k))) for k in (2, 3, 17, 64, 130)]
    for a in cases:
        values, vectors = symmetric_qr(a)
        scale = max(1e-300, np.abs(a).max())
        assert (np.diff(values) <= 0).all() and np.allclose(vectors @ vectors.T, np.eye(len(a)), atol=1e-12)
        assert np.abs(vectors @ a - values[:, None] * vectors).max() <= 1e-12 * scale * len(a)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=0, atol=1e-12 * scale * len(a))


def test_merged_moments_are_those_of_all():
    rng = np.random.default_rng(4)
    x = rng.integers(99_000, 101_000, (500, 5))
    parts = [Moments.none(5) for _ in range(4)]
    for state, rows in zip(parts, np.split(x, [3, 3, 400]), strict=True):
        state.add(rows)
    merged = parts[0]
    for state in parts[1:]:
        merged = merged.merged(state)
    assert merged.n == 500 and (merged.total == x.sum(0)).all()
    assert np.allclose(merged.covariance, np.cov(x.T, bias=True), rtol=1e-12)


def test_states_are_merged_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    rows = made(np.random.default_rng(5), 60, 3)
    df = spark.createDataFrame([(v,) for _, v in rows], "v array<double>").repartition(9)
    assert np.allclose(moments(df).covariance, np.cov(np.array([v for _, v in rows]).T, bias=True))


def test_edges(spark):
    """No rows, one row, no variance, fewer directions than components, other lengths, ids missing or repeated, sums beyond a long."""
    make = lambda rows: whitened(spark.createDataFrame([(i, v, None, None) for i, v in rows], SCHEMA)).collect()
    assert make([]) == [] and make([(1, None), (2, [])]) == []
    assert [(r["component"], r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in make([(1, [0.5, 0.25])])] == [(1, 0, 0, 0, 0), (2, 0, 0, 0, 0)]
    line = make([(None, [float(i), 2.0 * i]) for i in range(9)] + [(None, [1.0]), (7, [0.0, 0.0])])
    assert len(line) == 20 and {r["n"] for r in line} == {10} and {r["vec_id"] for r in line} == {None, 7}
    assert all(r["whitened"] == 0 and r["explained"] < 1e-12 for r in line if r["component"] == 2) and line[0]["identity_error"] < 1e-9
    large = make([(1, [1e9, 0.0]), (2, [-1e9, 0.0]), (3, [1e9, 1.0])])
    assert {r["deviation"] for r in large} == {None} and min(int(r["deviation_exact"]) for r in large) > 1 << 63
