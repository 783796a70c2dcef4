import bisect
import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sceneloom.llm import bpe, fingerprints, language, packing, quality
from sceneloom.llm.bytesnp import Spans, closed_syncmers
from sceneloom.llm.shared import crc_remainder

DATA = "/root/testdata/sf0.01"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


def test_tokens_as_the_library(docs, rows, library):
    got = bpe.token_rows(docs, VOCABULARY).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert list(r["ids"]) == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)
    digests = {(r["n_tokens"], r["ids_sha256"]) for r in bpe.token_digests(bpe.token_rows(docs, VOCABULARY)).collect()}
    assert (0, hashlib.sha256(b"").hexdigest()) in digests


def test_tokens_of_random_texts(library, monkeypatch):
    monkeypatch.setattr(bpe, "UNITS", 50)
    codec, rng = bpe.Codec(Path(VOCABULARY).read_bytes()), random.Random(2)
    letters = [*"ab cd  \n\t'sTÉéß漢字0²　\xa0\x1c\x85!?-_", "<|endoftext|>", " the", "'ll"]
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert codec.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    for text in ("theing" * 1500, " " * 2000, "\n" * 300 + "x", "é" * 999):
        assert codec.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_tokens_of_an_empty_table(empty):
    assert bpe.token_digests(bpe.token_rows(empty, VOCABULARY)).collect() == []
    assert json.loads(Path(VOCABULARY).read_text())["model"]["type"] == "BPE"


def test_fingerprints_of_edited_texts(docs, rows):
    real = sorted(((i, t or "") for i, t, *_ in rows if i is not None and i != 54))
    for buckets in (1, 2, 7, 100):
        got = {r["doc_id"]: r for r in fingerprints.edit_likeness(docs.where("doc_id IS NOT NULL AND doc_id <> 54"), buckets).collect()}
        assert len(got) == len(real)
        for n, (i, t) in enumerate(real):
            follows, moved = real[(n + 1) % len(real)][1], len(t) // 4
            edited = t[: len(t) - moved] + follows[:moved]
            assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert got[52]["fingerprint"] == got[53]["fingerprint"] and got[52]["near_next"] == 1
    assert got[62]["near_edited"] > 0.4 > got[62]["near_next"]


def test_fingerprints_of_crowded_ids(spark, prose):
    """All ids null, all equal, two thirds of one id and half of that one text, ids beyond doubles: rows of an order by id and hash, and no bucket has most."""
    rng = random.Random(31)
    texts = [prose(rng, rng.randint(1, 30)) for _ in range(400)]
    copy = prose(rng, 25)
    for ids, some in (
        ([None] * 400, texts), ([7] * 400, texts), ([None if i % 3 else i for i in range(600)], [copy if i % 2 else t for i, t in enumerate(texts + texts[:200])]),
        ([(1 << 60) + i for i in range(400)], texts), ([5, 5, 5], [copy] * 3),
    ):
        docs = spark.createDataFrame(list(zip(ids, some, strict=True)), "doc_id long, text string").repartition(3)
        keyed = docs.withColumn("digest", F.shiftrightunsigned(F.xxhash64("text"), 12)).collect()
        order = sorted(keyed, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["digest"]))
        want = []
        for r, after in zip(order, order[1:] + order[:1], strict=True):
            moved = len(r["text"]) // 4
            edited = r["text"][: len(r["text"]) - moved] + after["text"][:moved]
            want.append((str(r["doc_id"]), len(r["text"]), hashlib.sha256(edited.encode()).hexdigest()))
        for buckets in (1, 16):
            got = fingerprints.edit_likeness(docs, buckets).collect()
            assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in got) == sorted(want)
        sizes = [r["count"] for r in fingerprints._dealt(docs, 16).where(F.col("kind") != fingerprints.AHEAD).groupBy("bucket").count().collect()]
        assert len(some) < 16 or (ids[0] or 0) > 1 << 53 or max(sizes) < len(some) / 4


def naive_fingerprint(text):
    """By definition: every 14-mer of which the leftmost least 6-mer is the first or the last."""
    one = lambda b: int(Spans(np.frombuffer(b, np.uint8)).hash(np.array([0]), np.array([len(b)]))[0])
    b, first = text.encode(), {}
    if len(b) < 28:
        anchors = [(p, b[p : p + 3]) for p in range(max(1, len(b) - 2) if b else 0)]
    else:
        anchors = []
        for p in range(len(b) - 13):
            inner = [one(b[p + i : p + i + 6]) for i in range(9)]
            if inner.index(min(inner)) in (0, 8):
                anchors.append((p, b[p : p + 14]))
    for p, own in anchors:
        first.setdefault(one(own) >> 32, p)
    return sorted(first.items())[:64]


def naive_likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    a, b = dict(a), dict(b)
    union = sorted({*a, *b})[:64]
    both = [h for h in sorted(a) if h in b and h <= union[-1]]
    if not both:
        return 0.0
    shifts = [b[h] - a[h] for h in both]
    usual = sorted(shifts)[len(shifts) // 2]
    return sum(abs(x - usual) <= 64 for x in shifts) / len(union)


def test_fingerprints_by_definition(spark, prose):
    rng = random.Random(12)
    base = prose(rng, 120)
    texts = [base, base.replace("th", "ht", 3), prose(rng, 60), "", "ab", "abcab", "é漢字 short", "x" * 300, base[:400], base[7:], prose(rng, 5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprints.edit_likeness(docs).collect()}
    for i, t in enumerate(texts):
        follows = texts[(i + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 4] + follows[: len(t) // 4]
        own, other, after = map(naive_fingerprint, (t, edited, follows))
        assert got[i]["fingerprint"] == "".join(f"{h:08x}{p:08x}" for h, p in own) and got[i]["edited_fingerprint"] == "".join(f"{h:08x}{p:08x}" for h, p in other)
        assert got[i]["near_edited"] == pytest.approx(naive_likeness(own, other)) and got[i]["near_next"] == pytest.approx(naive_likeness(own, after))


def naive_language(labelled, texts):
    """Dictionaries and loops: words by log frequency, unseen ones by the mean over their longest known n-grams."""
    words_of = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())  # noqa: E731  letters, for the texts of this test
    grams = lambda w, n: [f"\n{w}\n"[i : i + n] for i in range(len(w) + 2 - n + 1)]
    langs = sorted({lang for _, lang in labelled})
    counts = {n: {lang: Counter() for lang in langs} for n in range(6)}
    for t, lang in labelled:
        for w in words_of(t):
            counts[0][lang][w] += 1
            for n in range(1, 6):
                counts[n][lang].update(grams(w, n))
    kinds = {n: set().union(*counts[n].values()) for n in counts}
    total = {n: {lang: sum(counts[n][lang].values()) for lang in langs} for n in counts}
    log = lambda n, key, lang: math.log((counts[n][lang][key] + 0.5) / (total[n][lang] + 0.5 * len(kinds[n])))
    every = sum(total[0].values())
    out = []
    for t in texts:
        words = words_of(t)
        if not words:
            out.append(("und", 0.0))
            continue
        score = {lang: math.log((total[0][lang] + 1) / (every + len(langs))) for lang in langs}
        for w in words:
            for n in (0, 5, 4, 3, 2, 1):
                known = [k for k in ([w] if not n else grams(w, n)) if k in kinds[n]]
                if known:
                    for lang in langs:
                        score[lang] += sum(log(n, k, lang) for k in known) / len(known)
                    break
        best = max(score, key=lambda lang: score[lang])
        out.append((best, 1 / sum(math.exp(v - score[best]) for v in score.values())))
    return out


def test_language_by_hand(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").limit(60)
    rows = docs.collect()
    model = language.fit(docs.where("doc_id % 3 <> 0"))
    texts = [r["text"] for r in rows] + ["qzxj", "the", "über", "", None, "12 34", "a b c"]
    want = naive_language([(r["text"], r["lang"]) for r in rows if r["doc_id"] % 3 and r["lang"] and r["text"] is not None], texts)
    langs, share = model.score(texts)
    assert langs == [w[0] for w in want] and share.tolist() == pytest.approx([w[1] for w in want], abs=1e-6)


def test_language_learns_from_rare_languages(spark, prose):
    """A bounded sample of each language: one that dominates doesn't crowd out another."""
    rng = random.Random(2)
    rows = [(i, prose(rng, 20), "en") for i in range(400)] + [(1000 + i, "żółw gęś " * 3, "pl") for i in range(3)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_rows=50)
    assert model.langs == ["en", "pl"] and model.score(["żółw"])[0] == ["pl"]


def test_quality_sums_its_tables(spark, docs, rows):
    """Scores by hand: the bin of each feature, one number a table, the logistic of their sum."""
    rng = np.random.default_rng(5)
    data = quality.feature_matrix(pa.array([r[1] for r in rows], pa.string()))
    model = quality.train(data, (rng.random(len(data)) > 0.4).astype(float), rounds=20)
    want = []
    for x in data.tolist():
        b = [bisect.bisect_right(e.tolist(), v) for e, v in zip(model.edges, x, strict=True)]
        total = model.base + sum(float(t[i]) for t, i in zip(model.single, b, strict=True)) + sum(float(t[model.coarse[f][b[f]]][model.coarse[g][b[g]]]) for (f, g), t in model.pairs.items())
        want.append(1 / (1 + math.exp(-total)))
    got = quality.score_rows(docs.select("doc_id", "text"), model).collect()
    assert sorted(r["quality_score"] for r in got) == pytest.approx(sorted(want))


def test_fingerprint_rows_odd(docs, empty):
    assert fingerprints.fingerprint_rows(docs.withColumn("fingerprint", F.lit(1))).count() == docs.count()
    assert fingerprints.edit_likeness(docs).count() == docs.count()
    assert fingerprints.edit_likeness(docs.where("doc_id = 62")).count() == 1
    assert fingerprints.edit_likeness(empty).collect() == []


def test_syncmers_stand_close_and_depend_on_themselves():
    rng = random.Random(4)
    for data in (bytes(rng.choice(b"abcd") for _ in range(3000)), b"a" * 500, b"abab" * 300, bytes(rng.randrange(256) for _ in range(2000))):
        for k, s in ((14, 6), (40, 16), (20, 19)):
            at = closed_syncmers(Spans(np.frombuffer(data, np.uint8)).every(s), k, s)
            assert at[0] <= k - s and len(data) - k - at[-1] < k - s + 1 and (np.diff(at) <= k - s).all()
            chosen = set(at.tolist())
            for p in range(0, len(data) - k, 97):
                own = closed_syncmers(Spans(np.frombuffer(data[p : p + k], np.uint8)).every(s), k, s)
                assert (p in chosen) == bool(len(own))


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r["doc_id"]: r for r in language.op3_language_id(spark, DATA).collect()}
    held = [r for r in docs.select("doc_id", "lang").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(got[r["doc_id"]]["held_out"] for r in held)
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) >= 0.98 * len(held)


def test_language_odd_texts(spark, docs, empty):
    model = language.fit(docs)
    got = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    assert len(got) > 50 and got[57]["lang_pred"] == got[56]["lang_pred"] == got[65]["lang_pred"] == "und"
    assert got[62]["lang_pred"] == "en" and got[62]["score"] == 1
    assert language.predict(empty, model).collect() == []
    none = language.fit(empty)
    assert {r["lang_pred"] for r in language.predict(docs, none).collect()} == {"und"}


def test_quality_held_out(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    got = [r for r in quality.op10_quality_gam(spark, DATA).collect() if r["held_out"] and r["doc_id"] in labels]
    good, bad = ([r for r in got if labels[r["doc_id"]] == q] for q in (1, 0))
    assert sum(r["predicted"] for r in good) >= 0.97 * len(good) and sum(r["predicted"] for r in bad) <= 0.15 * len(bad)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)


def test_quality_odd_tables(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    some = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, None), (None, 1), (62, 1), (63, 0)], "doc_id long, quality int")
    for labels in (none, some):
        model = quality.fit(docs, labels)
        out = quality.score_rows(docs.withColumn("quality_score", F.lit(3)), model).collect()
        assert len(out) == docs.count() and all(0 <= r["quality_score"] <= 1 for r in out)
    assert quality.score_rows(empty, model).collect() == []


def test_quality_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.train(x, y)
    assert (0, 1) in model.pairs and ((model.score(x) > 0.5) == (y > 0.5)).mean() > 0.95


def best_padding(lengths, counts, buckets):
    from functools import cache

    @cache
    def least(i, k):
        if i == len(lengths):
            return 0
        if not k:
            return 1 << 60
        return min(sum(c * (lengths[j] - x) for x, c in zip(lengths[i : j + 1], counts[i : j + 1], strict=True)) + least(j + 1, k - 1) for j in range(i, len(lengths)))

    return least(0, buckets)


def test_bucket_bounds_are_optimal():
    rng = random.Random(9)
    for _ in range(60):
        lengths = sorted(rng.sample(range(500), rng.randint(1, 14)))
        counts = [rng.randint(1, 9) for _ in lengths]
        for k in (1, 2, 3, 5, 20):
            bounds, padding = packing.bucket_bounds(lengths, counts, k)
            assert len(bounds) <= k and bounds[-1] == lengths[-1] and padding == best_padding(lengths, counts, k)
            assert padding == sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts, strict=True))
    assert packing.bucket_bounds([], [], 4) == ([], 0)


def test_batches(docs, rows, empty):
    lengths = packing.word_lengths(docs)
    want = sorted(((i, len(re.findall("[^\x20\x09-\x0d]+", t or ""))) for i, t, *_ in rows), key=repr)
    assert sorted(((r["doc_id"], r["n_words"]) for r in lengths.collect()), key=repr) == want
    got = packing.pack(lengths.withColumn("bucket", F.lit("x")), F.col("n_words"), budget=600, buckets=4).collect()
    assert len(got) == len(rows) and all(r["n_tokens"] == r["n_words"] for r in got)
    batches = {}
    for r in got:
        batches.setdefault((r["bucket"], r["batch_id"]), []).append(r)
    for own in batches.values():
        bound = own[0]["padded_length"]
        assert sorted(r["batch_row"] for r in own) == list(range(len(own))) and {r["batch_rows"] for r in own} == {len(own)}
        assert len(own) * bound <= 600 or len(own) == 1
        assert all(r["n_tokens"] <= bound for r in own)
    for b in {r["bucket"] for r in got}:
        order = [r["doc_id"] if r["doc_id"] is not None else -1 for r in sorted((r for r in got if r["bucket"] == b), key=lambda r: (r["batch_id"], r["batch_row"]))]
        assert order == sorted(order)
    assert packing.packed_words(empty).collect() == []


def pairwise_bounds(x, c, buckets):
    """All pairs looked at; of equal costs the earliest begin of the last bucket."""
    n, least, cuts = len(x), [0] + [1 << 60] * len(x), []
    for _ in range(min(buckets, n)):
        where = [min(range(j + 1), key=lambda i, j=j: (least[i] + sum(c[m] * (x[j] - x[m]) for m in range(i, j + 1)), i)) for j in range(n)]
        least = [0] + [least[i] + sum(c[m] * (x[j] - x[m]) for m in range(i, j + 1)) for j, i in enumerate(where)]
        cuts.append(where)
    bounds, j = [], n
    for where in reversed(cuts):
        if j:
            bounds.append(x[j - 1])
            j = where[j - 1]
    return bounds[::-1], least[n]


def test_bounds_are_those_of_all_pairs(spark):
    rng = random.Random(4)
    cases = [(sorted(rng.sample(range(span), n)), [rng.choice((1, 1, 2, 50)) for _ in range(n)]) for n, span in ((1, 9), (2, 9), (15, 15), (25, 90)) for _ in range(5)]
    for x, c in cases:
        for k in (1, 2, 5, 16):
            assert packing.bucket_bounds(x, c, k) == pairwise_bounds(x, c, k)
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), (F.col("id") * 7 % 2999).alias("len"))
    got = packing.pack(rows, F.col("len"), buckets=5).collect()
    bounds, _ = packing.bucket_bounds(list(range(2999)), [2] + [1] * 2998, 5)
    assert len(got) == 3000 and sorted({r["padded_length"] for r in got}) == bounds


def test_batches_of_rows_without_or_with_one_id(spark):
    """Nothing tells the rows apart: batches are full all the same."""
    for doc_id in (F.lit(None).cast("long"), F.lit(3).cast("long")):
        rows = spark.range(500).select(doc_id.alias("doc_id"), F.lit(7).alias("len"))
        got = packing.pack(rows, F.col("len"), budget=70).collect()
        assert Counter(r["batch_id"] for r in got) == {b: 10 for b in range(50)} and {r["batch_rows"] for r in got} == {10}


def test_batches_of_model_tokens(docs, rows, library):
    """Lengths of operator 6 instead of words."""
    tokens = bpe.token_digests(bpe.token_rows(docs.where("doc_id IS NOT NULL").select("doc_id", "text"), VOCABULARY)).select("doc_id", "n_tokens")
    got = packing.pack(tokens.withColumnRenamed("n_tokens", "n"), F.col("n"), budget=2000).collect()
    want = sorted((i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows if i is not None)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == want
    assert all(r["batch_rows"] * r["padded_length"] <= 2000 or r["batch_rows"] == 1 for r in got)


def test_remainders(spark):
    got = spark.range(200).select("id", crc_remainder(F.col("id")).alias("r")).collect()
    assert all(r["r"] == zlib.crc32(str(r["id"]).encode()) % 4 for r in got)
