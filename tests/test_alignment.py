"""METEOR against all matchings there are."""

import random

import pytest

from sceneloom.functions.alignment import aligned, meteor, meteor_of
from sceneloom.functions.stemming import stem


def exhaustive(expected, predicted):
    best = None

    def go(i, used, pairs):
        nonlocal best
        if i == len(predicted):
            exact = sum(expected[j] == predicted[k] for k, j in pairs)
            runs = sum(not (n and pairs[n - 1] == (k - 1, j - 1)) for n, (k, j) in enumerate(pairs))
            best = min(best or (1, 0, 0), (-exact, -(len(pairs) - exact), runs))
            return
        go(i + 1, used, pairs)
        for j, word in enumerate(expected):
            if j not in used and stem(word) == stem(predicted[i]):
                go(i + 1, used | {j}, [*pairs, (i, j)])

    go(0, frozenset(), [])
    return -best[0], -best[1], best[2]


def test_same_as_all_matchings():
    rng = random.Random(2)
    say = ["the", "red", "lamp", "lamps", "on", "table", "tables", "runs", "running"]
    for _ in range(400):
        a, b = ([rng.choice(say[: rng.randint(2, 9)]) for _ in range(rng.randint(0, 6))] for _ in range(2))
        assert aligned(a, b) == exhaustive(a, b)


@pytest.mark.parametrize(("expected", "predicted", "want"), [
    # six words in order: one chunk; the same in another order; half of it
    ("the cat sat on the mat", "the cat sat on the mat", 1 - 0.5 * (1 / 6) ** 3),
    ("the cat sat on the mat", "on the mat sat the cat", 1 - 0.5 * (3 / 6) ** 3),
    ("the cat sat", "the cat", (2 / 3) / (0.9 + 0.1 * 2 / 3) * (1 - 0.5 * (1 / 2) ** 3)),
    ("lamps shine", "lamp", (1 / 2) / (0.9 + 0.1 / 2) * 0.5), ("a b", "c d", 0.0), ("", "", 0.0), ("x", "", 0.0),
])
def test_scores(expected, predicted, want):
    assert meteor_of(expected.split(), predicted.split()) == pytest.approx(want)


def test_column(spark):
    df = spark.createDataFrame([(["The", "Cat"], ["the", "cat"]), (None, ["x"]), ([], None)], "e array<string>, p array<string>")
    assert [r[0] for r in df.select(meteor("e", "p")).collect()] == [pytest.approx(1 - 0.5 / 8), 0.0, 0.0]


def test_long_lists_end():
    words = ["a", "b", "c"] * 60
    exact, stems, chunks = aligned(words, words)
    assert (exact, stems) == (180, 0) and chunks >= 1
