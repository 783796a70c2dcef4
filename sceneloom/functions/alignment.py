"""Alignment of two word lists, and the METEOR score that follows from it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sceneloom.functions.stemming import stem

#: Partial alignments that are followed at a time.
BEAM = 512
# The weight of precision, the exponent and the weight of the penalty.
ALPHA, BETA, GAMMA = 0.9, 3.0, 0.5


def aligned(expected: list[str], predicted: list[str]) -> tuple[int, int, int]:
    """(exact, stems, chunks): the most words that can be matched one to one, equal words first and then words of equal stems, and the fewest runs of neighbours in both lists that such a matching has.

    The predicted words are gone through in order, with the best ``BEAM`` partial matchings, those that have used the same words and
    ended at the same one being one: only of long texts that repeat their words in many ways may a better one be missed.
    """
    own, roots = {}, {}
    for j, word in enumerate(expected):
        own.setdefault(word, []).append(j)
        roots.setdefault(stem(word), []).append(j)
    states = {(0, -2): (0, 0, 0)}  # (words used, the last one if the word before is matched): (-exact, -stems, chunks)
    for word in predicted:
        same = set(own.get(word, []))
        step: dict[tuple[int, int], tuple[int, int, int]] = {}
        for (used, last), (exact, stems, chunks) in states.items():
            options = [((used, -2), (exact, stems, chunks))]
            for j in roots.get(stem(word), []):
                if not used >> j & 1:
                    options.append(((used | 1 << j, j), (exact - (j in same), stems - (j not in same), chunks + (j != last + 1 or last < 0))))
            for key, cost in options:
                if key not in step or cost < step[key]:
                    step[key] = cost
        states = step if len(step) <= BEAM else dict(sorted(step.items(), key=lambda x: (x[1][0] + x[1][1], x[1]))[:BEAM])
    exact, stems, chunks = min(states.values())
    return -exact, -stems, chunks


def meteor_of(expected: list[str], predicted: list[str]) -> float:
    """The score of two lists of words in lower case; 0 where nothing matches."""
    exact, stems, chunks = aligned(expected, predicted)
    matched = exact + stems
    if not matched:
        return 0.0
    precision, recall = matched / len(predicted), matched / len(expected)
    mean = precision * recall / (ALPHA * precision + (1 - ALPHA) * recall)
    return mean * (1 - GAMMA * (chunks / matched) ** BETA)


@F.pandas_udf(T.DoubleType())
def meteor(expected: pd.Series, predicted: pd.Series) -> pd.Series:
    """METEOR of two columns of word lists, in any case, without the stage of synonyms (which needs a lexicon) and with Snowball stems; null counts as empty."""
    words = lambda x: [] if x is None else [w.lower() for w in x if w is not None]
    return pd.Series([meteor_of(words(e), words(p)) for e, p in zip(expected, predicted, strict=True)], dtype=float)
