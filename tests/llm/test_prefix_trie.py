import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from sceneloom.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, depth string, g int"


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [r[3:] for r in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    built = {c: own.get(c - c % 5, [])[: h[c]] + own[c][h[c] :] for c in own}
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(int)
    for w in members:
        if w:
            children[w[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for w, m in members.items():
        for d in range(len(w) + 1):
            leaves[w[:d]] += not children[w]
            saved[w[:d]] += (len(m) - 1) * len(w[-1][1].encode()) if w else 0
    return sorted(
        (min(m), len(w), min(members[w[:-1]]) if w else -1, len(m), children[w], leaves[w], saved[w], hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(w)).encode()).hexdigest())
        for w, m in members.items()
    )


def nodes(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = pt.prefix_trie(df, **kw).collect()
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], *r[3:]) for r in got)


def made(seed, convs=120):
    rng = random.Random(seed)
    say = ["", "hello", "näher", "a" * 50, "yes", "no"]
    rows = []
    for c in range(convs):
        if c % 11 == 4:
            continue
        n = rng.choice([1, 2, 3, 5, 9, 14])
        rows += [(c, i, rng.choice(["user", "assistant"][i % 2 :][:1] + [None] * (rng.random() < 0.1)), rng.choice(say[: 2 + i % 4] + [None])) for i in range(n)]
    rows += [(c, i, "user", "the same") for c in range(500, 560) for i in range(12)]  # copies
    rows += [(7, None, "user", "first"), (None, 0, "user", "nobody's"), (7, 1, "user", "tied"), (7, 1, "user", "tied"), (7, 1, None, None)]
    rows += [(2001, i, "user", f"{i % 7}") for i in range(160)]  # a long one
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "parts", "length"), [(1, 7, 1024), (2, 11, 3), (4, 5, 1)])
def test_same_as_definition(spark, seed, parts, length):
    rows = made(seed)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert nodes(spark, rows, length=length) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_edges(spark):
    """No rows, none with an id, one conversation, one that is left without turns."""
    assert nodes(spark, []) == [] and nodes(spark, [(None, 1, "user", "x")]) == []
    for rows in ([(3, 0, "user", "x")], [(0, 0, None, None)], [(1, 5, "user", "only")], [(1, 5, "user", "only"), (2, 0, "a", "b")]):
        assert nodes(spark, rows) == brute(rows)


def test_ends_of_many_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(pt, "PIECE_IDS", 3)
    members = spark.createDataFrame([("a", i) for i in range(100)] + [("b", 5)], "piece string, conv_id long")
    got = {r["piece"]: r["ends"] for r in pt.ends_of(members).collect()}
    assert got == {"a": hashlib.sha256(",".join(map(str, range(100))).encode()).hexdigest(), "b": hashlib.sha256(b"5").hexdigest()}
