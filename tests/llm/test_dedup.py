import hashlib
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from sceneloom.llm import exact_dedup, line_dedup, packing, repeats, unit_dedup


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_exact_groups(docs, rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[lower(t)].append(i)
    want = []
    for i, t, *_ in rows:
        own = groups[lower(t)]
        keep = max((x for x in own if x is not None), default=None)
        want.append((i, keep, len(own), i == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    for bits in (None, 3):  # with three bits of hash nearly all texts collide
        key = F.xxhash64 if bits is None else (lambda c: F.pmod(F.xxhash64(c), F.lit(8)))
        got = [tuple(r) for r in exact_dedup.exact_groups(docs, bucket_rows=4, key=key).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_exact_empty(empty):
    assert exact_dedup.exact_groups(empty).collect() == []


def test_directory_splits_what_is_overfull(spark):
    records = spark.range(5000).select(F.xxhash64("id").alias("h")).unionByName(spark.range(300).select(F.lit(77).cast("long").alias("h")))
    cells, depth = exact_dedup.directory(records, 64)
    assert cells.count() == cells.select("cell").distinct().count()
    held = records.withColumn("cell", F.shiftrightunsigned("h", 64 - depth)).join(cells, "cell").groupBy("bucket", "depth", "pages").agg(F.count("*").alias("n"), F.countDistinct("h").alias("kinds"), F.min("h").alias("low"), F.max("h").alias("high")).collect()
    assert sum(r["n"] for r in held) == 5300
    assert all(r["n"] <= 64 or r["kinds"] == 1 for r in held)
    assert all(r["pages"] == -(-r["n"] // 64) for r in held)
    assert len({r["depth"] for r in held}) > 1
    for r in held:  # a bucket has all hashes of its prefix
        assert {(h % 2**64) >> (64 - r["depth"]) for h in (r["low"], r["high"])} == {r["bucket"] - (1 << r["depth"])}


def windows_removed(rows, size):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        own = [] if t is None else t.split("\n")
        gone = set()
        for j in range(len(own) - size + 1):
            key = tuple(own[j : j + size])
            gone |= set(range(j, j + size)) if key in seen else set()
            seen.add(key)
        out[i] = None if t is None else "\n".join(x for j, x in enumerate(own) if j not in gone)
    return out


def test_line_windows(docs, rows):
    real = {i: t for i, t, *_ in rows if i is not None}
    got = {r["doc_id"]: (r["n_lines"], r["kept_text"]) for r in line_dedup.drop_repeated_windows(docs.where("doc_id IS NOT NULL")).collect()}
    want = windows_removed(real.items(), 3)
    assert got == {i: (0 if t is None else t.count("\n") + 1, want[i]) for i, t in real.items()}
    assert any(want[i] != t for i, t in real.items())


def test_line_windows_odd_rows(docs, empty):
    out = line_dedup.drop_repeated_windows(docs.withColumn("kept_text", F.lit("x")).withColumn("extra", F.lit(1)))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "extra", "n_lines", "removed_lines", "kept_text"]
    assert out.count() == docs.count()
    assert line_dedup.drop_repeated_windows(empty).collect() == []


def test_units(spark, docs, rows):
    real = {i: t for i, t, *_ in rows if i is not None}
    seen, want = set(), {}
    for i, t in sorted(real.items()):
        spans, at = [], 0
        for n, unit in enumerate((t or "").split("\n"), 1):
            norm = re.sub("[ \t\n\x0b\f\r]+", " ", lower(unit)).strip(" ")
            if norm and norm in seen:
                spans.append((n, at, at + len(unit)))
            seen.add(norm)
            at += len(unit) + 1
        want[i] = spans
    got = {r["doc_id"]: [tuple(s) for s in r["removed"]] for r in unit_dedup.drop_repeated_units(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])).collect()}
    assert got == want and any(want.values())
    paragraphs = spark.createDataFrame([(1, "first paragraph of some length\n\nsecond one, long enough to count"), (2, "Second one,  long enough to count\n\nelse")], "doc_id long, text string")
    out = {r["doc_id"]: r["kept_text"] for r in unit_dedup.drop_repeated_units(paragraphs, "paragraph").collect()}
    assert out[2] == "else"


def test_units_odd_rows(docs, empty):
    out = unit_dedup.drop_repeated_units(docs.withColumn("removed", F.lit(1)))
    assert out.count() == docs.count()
    assert {r["kept_text"] for r in out.where("text IS NULL").collect()} == {None}
    assert unit_dedup.drop_repeated_units(empty).collect() == []


def removed(texts, size):
    count = Counter(b[i : i + size] for b in texts for i in range(len(b) - size + 1))
    out = []
    for b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if count[b[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        out.append(bytes(gone))
    return out


def check_repeats(frame, texts, size):
    got = defaultdict(list)
    for r in repeats.drop_repeats(frame, size).collect():
        got[r["doc_id"]].append((r["n_bytes"], r["n_removed"], len(r["span_starts"] or []), bytes(r["kept"])))
    want = defaultdict(list)
    for (i, b), gone in zip(texts, removed([b for _, b in texts], size), strict=True):
        spans = sum(1 for j, g in enumerate(gone) if g and (not j or not gone[j - 1]))
        want[i].append((len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    return sum(v[1] for x in want.values() for v in x)


def test_repeats(docs, rows):
    assert check_repeats(docs, [(r[0], (r[1] or "").encode()) for r in rows], 400) > 2000
    check_repeats(docs, [(r[0], (r[1] or "").encode()) for r in rows], 60)


def test_repeats_window_by_window(docs, rows, monkeypatch):
    """Groups beyond the bound are resolved by whole windows."""
    monkeypatch.setattr(repeats, "GROUP_STRINGS", 1)
    check_repeats(docs, [(r[0], (r[1] or "").encode()) for r in rows], 100)


def test_repeats_odd_tables(docs, empty):
    assert repeats.drop_repeats(empty).collect() == []
    out = repeats.drop_repeats(docs.withColumn("kept", F.lit("x")).withColumn("doc_key", F.lit(1)))
    assert out.count() == docs.count() and out.columns.count("kept") == 1


def test_units_query_compares_short_units(spark, tmp_path):
    rows = [(1, "les.\n\n漢字"), (2, "Les. \n\nown"), (3, "x\n漢字\nles.")]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_removed"], r["removed_spans"], r["kept_text"]) for r in unit_dedup.op8_substring_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (0, "", "les.\n\n漢字"), 2: (1, "0-5", "\nown"), 3: (2, "2-4,5-9", "x")}


def thue_morse(n, letters):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def test_patterned_lines_are_not_confused(spark):
    """Thue-Morse lines and their complements meet in sums of powers of any base; no text is lost."""
    rows = [(i, f"{thue_morse(n, letters)}\nm\nn") for i, (n, letters) in enumerate([(1024, "ab"), (1024, "ba"), (512, "bU"), (512, "Ub")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["doc_id"], r["kept_text"]) for r in line_dedup.drop_repeated_windows(docs).collect()} == set(rows)
    assert check_repeats(docs, [(i, t.encode()) for i, t in rows], 400) == sum(map(sum, removed([t.encode() for _, t in rows], 400)))


def test_columns_of_clashing_names(spark, docs):
    """Every name that an operator uses inside may be a column's, too: it passes through, and the result is the same."""
    names = ["row_id", "ROW_TEXT", "gone", "starts", "ends", "other_starts", "other_ends", "doc_key", "text_key", "size", "at", "digest", "h", "bucket_", "part", "before", "whole", "fit", "place", "row_tie", "row_any", "_gone", "v", "c", "first", "line", "norm", "page"]
    plain = docs.where("doc_id IS NOT NULL").select("doc_id", "text").dropDuplicates(["doc_id"])
    more = plain.withColumns({n: F.lit(n) for n in names})
    operators = [line_dedup.drop_repeated_windows, unit_dedup.drop_repeated_units, lambda d: repeats.drop_repeats(d, 60, 40), lambda d: packing.pack(d, F.length("text")), exact_dedup.exact_groups]
    for operator in operators:
        want, out = operator(plain), operator(more)
        if operator is not exact_dedup.exact_groups:
            assert out.columns == ["doc_id", "text", *names, *want.columns[2:]]
            assert all(out.where(f"`{n}` <> '{n}'").isEmpty() for n in ("row_id", "gone", "_gone"))
        assert sorted(map(repr, map(tuple, out.select(want.columns).collect()))) == sorted(map(repr, map(tuple, want.collect())))


def test_passages_besides_the_removed_spans(docs, rows):
    """One index answers for two lengths."""
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    got = Counter((r["doc_id"], r["n_removed"], sum(b - a for a, b in zip(r["passage_starts"] or [], r["passage_ends"] or [], strict=True))) for r in repeats.drop_repeats(docs, 150, 60).collect())
    both = [[sum(m) for m in removed([b for _, b in texts], size)] for size in (150, 60)]
    assert got == Counter((i, a, b) for (i, _), a, b in zip(texts, *both, strict=True))
    assert sum(both[1]) > sum(both[0]) > 0


def test_shuffled_joins_give_the_same(docs, rows, monkeypatch):
    """Beyond the bound of a broadcast."""
    from sceneloom.llm import shared

    monkeypatch.setattr(shared, "BROADCAST_ROWS", 0)
    real = {i: t for i, t, *_ in rows if i is not None}
    assert {r["doc_id"]: r["kept_text"] for r in line_dedup.drop_repeated_windows(docs.where("doc_id IS NOT NULL")).collect()} == windows_removed(real.items(), 3)
    check_repeats(docs, [(r[0], (r[1] or "").encode()) for r in rows], 100)
