import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _prose(rng, n):
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def prose():
    return _prose


@pytest.fixture(scope="session")
def rows():
    """Texts with near and exact copies, shared passages, repeats, nulls, empties, ties and a long one."""
    rng = random.Random(7)
    passage = _prose(rng, 160)
    base = _prose(rng, 120)
    out = [(i, _prose(rng, rng.randint(3, 200)) + ("\n" + passage if i % 5 == 0 else "") + "\nOne line.\nAnother of many words in it here.\nA third line that ends\n" * (i % 3)) for i in range(30)]
    for i in range(30, 42):  # near copies of one text, from close to far
        w = base.split()
        for _ in range((i - 30) // 2):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(99)}"
        out.append((i, " ".join(w)))
    out += [(50, out[3][1]), (51, out[3][1].upper()), (52, base), (53, base), (54, "Tiny"), (55, "tiny"), (56, ""), (57, None), (58, "  \n\t "), (59, "a b c"), (60, "é" * 900 + "漢字" * 300), (61, "ab" * 3000)]
    out += [(62, _prose(rng, 9000)), (63, "word " * 2500), (54, "Tiny"), (None, "no id here at all, none"), (None, None), (64, "\x00\x1f 　x"), (65, "12345 67890 !!! ???")]
    return [(i, t, None if i and i % 9 == 0 else "en", "s", None if t is None else len(t)) for i, t in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
