import random
import re

import numpy as np
import pytest

from sceneloom.llm import ngram_join as nj
from sceneloom.llm.bytesnp import mix


def shingle_set(text, width):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())


def brute(rows, width, num, den):
    sets = [(i, shingle_set(t, width)) for i, t in rows]
    head = {i: i for i, _ in sets}

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and len(x & y) * den >= num * len(x | y) and find(i) != find(j):
                lo, hi = sorted((find(i), find(j)))
                head[hi] = lo
    return sorted((i, len(s), find(i)) for i, s in sets)


@pytest.mark.parametrize(("width", "likeness"), [(4, (85, 100)), (5, (80, 100)), (2, (50, 100))])
def test_same_as_brute_force(docs, rows, width, likeness):
    real = [(i, t) for i, t, *_ in rows if i is not None]
    got = sorted(tuple(r) for r in nj.ngram_components(docs.where("doc_id IS NOT NULL"), width, likeness).collect())
    assert got == brute(real, width, *likeness)


def test_null_ids_are_one_node(docs, rows):
    got = nj.ngram_components(docs, 4, (85, 100)).where("doc_id IS NULL").collect()
    assert len(got) == 2 and {r["component_id"] for r in got} == {None}


def test_ids_with_several_texts(spark, prose):
    """A copy's other text still links."""
    rng = random.Random(8)
    a, b = prose(rng, 80), prose(rng, 90)
    near = b.replace(" ", "  ").split("  ")
    near[3] = "changed"
    rows = [(1, a), (5, a), (5, b), (9, " ".join(near)), (12, prose(rng, 50))]
    got = {(r["doc_id"], r["component_id"]) for r in nj.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, (85, 100)).collect()}
    assert got == {(1, 1), (5, 1), (9, 1), (12, 12)}


def test_texts_without_id_are_apart(spark, prose):
    """Rows without id link by their own texts only, and a blank text of an id links nothing."""
    rng = random.Random(3)
    a, b = prose(rng, 80), prose(rng, 90)
    high = (1 << 63) - 5
    rows = [(None, a), (None, b), (None, b), (None, " "), (1, a + " x"), (9, b + " x"), (9, " "), (12, b + " y"), (12, ""), (high, prose(rng, 50))]
    got = nj.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, (85, 100)).select("doc_id", "component_id").collect()
    want = [(None, 1), (None, 9), (None, 9), (None, None), (1, 1), (9, 9), (9, 9), (12, 9), (12, 9), (high, high)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_blank_texts_of_ids_in_a_block():
    some, none = np.arange(20, dtype=np.uint64), np.zeros(0, np.uint64)
    assert nj.link_block([some, none, none, some[:19]], [1, 2, 3, 4], 85, 100) == [(3, 0)]


def test_empty_table(empty):
    assert nj.ngram_components(empty).collect() == []


def test_large_clusters_in_parts(spark, prose, monkeypatch):
    """With tiny blocks the hub and the others are dealt into parts, and nothing is lost."""
    monkeypatch.setattr(nj, "BLOCK_DOCS", 8)
    monkeypatch.setattr(nj, "GROUP_DOCS", 3)
    rng = random.Random(1)
    base = prose(rng, 150).split()
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 12)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    got = sorted(tuple(r) for r in nj.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, (85, 100)).collect())
    assert got == brute(rows, 4, 85, 100)


def test_like_sets_share_a_key():
    rng = np.random.default_rng(3)
    for num, den in ((85, 100), (80, 100), (60, 100)):
        lows = nj.size_classes(3000, num, den)
        for _ in range(300):
            n = int(rng.integers(3, 400))
            union = mix(rng.integers(0, 1 << 62, n).astype(np.uint64))
            out = int(n * (den - num) / den)
            cut = int(rng.integers(0, out + 1))
            a, b = np.sort(union[cut:]), np.sort(union[: n - (out - cut)])
            if not len(a) or not len(b) or len(a) == len(b) == n:
                continue
            shared = len(np.intersect1d(a, b))
            if shared * den >= num * (len(a) + len(b) - shared):
                assert len(np.intersect1d(nj.slice_keys(a, lows, num, den), nj.slice_keys(b, lows, num, den)))


def test_divide_skip_counts_like_a_scan():
    rng = np.random.default_rng(5)
    for _ in range(50):
        sets = [np.unique(rng.integers(0, 60, 40)) for _ in range(30)]
        lists = [np.array([j for j, s in enumerate(sets) if t in s]) for t in range(60)]
        end = np.cumsum([len(x) for x in lists])
        begin = end - [len(x) for x in lists]
        query = sets[0]
        held = lambda j, tokens, sets=sets: np.isin(tokens, sets[j])
        for need in (1, 5, 20, len(query)):
            want = {j: len(np.intersect1d(query, s)) for j, s in enumerate(sets) if len(np.intersect1d(query, s)) >= need}
            for steps in (0, 10**9):
                nj._HEAP_STEPS = steps
                assert nj.divide_skip(np.concatenate(lists), begin[query], end[query], query, need, held) == want
    nj._HEAP_STEPS = 64


def test_patterned_words_are_not_confused(spark):
    """Words that meet in sums of powers of any base have nothing in common."""
    a, b = ("".join(x[bin(i).count("1") % 2] for i in range(1024)) for x in ("ab", "ba"))
    docs = spark.createDataFrame([(0, a), (1, b), (2, a.upper())], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in nj.ngram_components(docs, 4, (85, 100)).collect()} == {(0, 0), (1, 1), (2, 0)}


def test_links_of_colliding_hashes_are_refused():
    """The n-grams themselves have the last word, and a refused link hides no other."""
    some = np.arange(20, dtype=np.uint64)
    refused = lambda i, j: {i, j} != {0, 1}
    links = nj.link_block([some, some, some], [1, 2, 3], 85, 100, refused)
    assert {tuple(sorted(x)) for x in links} == {(0, 2), (1, 2)}
    assert nj.link_block([some, some], [1, 2], 85, 100, refused) == []


def test_real_ngrams():
    for t in ("A b  c d\te", "one", "", " \n", "É\u00a0x y"):
        assert nj.real_ngrams(t.encode(), 3) == {tuple(w.encode() for w in s) for s in shingle_set(t, 3)}
