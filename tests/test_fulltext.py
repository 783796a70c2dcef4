"""Stems by their definition, the query grammar, and the stored index against a naive scan."""

import random
import re

import pytest

from sceneloom.functions.stemming import stem, stemmed_lists
from sceneloom.operators import fulltext as ft

# Words and stems as the algorithm's description gives them.
KNOWN = """
consign consign consigned consign consigning consign consignment consign consist consist consistency consist consistently consist consolation consol consolatory consolatori consolidating consolid consolingly consol
conspicuously conspicu conspiracy conspiraci conspirators conspir constable constabl constancy constanc knack knack knackeries knackeri knaves knave knavish knavish kneaded knead kneeling kneel knew knew
knightly knight knitted knit knives knive knockers knocker knopp knopp skies sky dying die news news inning inning generate generat general general generously generous communism communism ties tie cries cri
gas gas this this gaps gap hopping hop hoping hope luxuriated luxuri agreed agre feed feed happy happi say say by by relational relat conditional condit vietnamization vietnam operator oper decisiveness decis
hopefulness hope sensibility sensibl triplicate triplic formative format electrical electr goodness good allowance allow airliner airlin replacement replac adoption adopt homologous homolog probate probat
rate rate controlling control roll roll it's it rings' ring
""".split()


@pytest.mark.parametrize(("word", "want"), list(zip(KNOWN[::2], KNOWN[1::2], strict=True)))
def test_stems(word, want):
    assert stem(word) == want


def test_stems_of_columns(spark):
    df = spark.createDataFrame([(["running", "rings"],), (None,), ([],)], "w array<string>")
    assert [r[0] for r in df.select(stemmed_lists("w")).collect()] == [["run", "ring"], None, []]


def literal(*stems, negated=False):
    return ft.Literal(tuple(stems), negated)


def test_grammar():
    assert ft.parsed("Red rings -blue") == [[literal((0, "red")), literal((0, "ring")), literal((0, "blue"), negated=True)]]
    assert ft.parsed('"ring of gold" or chairs') == [[literal((0, "ring"), (2, "gold"))], [literal((0, "chair"))]]
    assert ft.parsed('-"the small table" OR') == [[literal((0, "small"), (1, "tabl"), negated=True)]]
    assert ft.parsed('well-known "open') == [[literal((0, "well"), (1, "known")), literal((0, "open"))]]
    assert ft.parsed("the of") == ft.parsed("") == ft.parsed('"" - or OR') == []


def naive(rows, query):
    """By going through every text."""
    found = set()
    for i, text in rows:
        words = [w if w in ft.STOPWORDS else stem(w) for w in re.findall("[a-z0-9]+", (text or "").lower())]
        at = {(p, w) for p, w in enumerate(words) if w not in ft.STOPWORDS}
        has = lambda x, at=at, n=len(words): any(all((p + o, s) in at for o, s in x.stems) for p in range(n))
        if any(all(has(x) != x.negated for x in group) for group in ft.parsed(query)):
            found.add(i)
    return found


QUERIES = [
    "lamp", "lamps table", "lamp or chair", "red -lamp", '"red lamp"', '"red lamps" or "chair of wood"', '-"red lamp"', '-red or "blue chair"', 'red "lamp table" -"blue red"', "red-lamp", "nothing", "the",
    '"red red"', "-zzz", "red or red", '"lamp in the table"',
]


def test_matches_of_a_scan(spark, tmp_path):
    rng = random.Random(4)
    say = ["red", "blue", "lamp", "lamps", "chair", "tables", "of", "wood", "the", "in", "Shining", "it's"]
    rows = [(i, None if i % 37 == 5 else " ".join(rng.choice(say) for _ in range(rng.randint(0, 9))) + rng.choice(["", ".", " -- red, lamp!"])) for i in range(400)]
    ft.write_index(spark.createDataFrame(rows, "component_id long, caption string"), str(tmp_path))
    index = ft.read_index(spark, str(tmp_path))
    assert index.documents.count() == 400
    for query in QUERIES:
        got = [r["component_id"] for r in ft.matching(index, query).collect()]
        assert len(got) == len(set(got)) and set(got) == naive(rows, query), query
    ranked = ft.search(index, '"red lamp" or chair', None).orderBy("rank").collect()
    assert {r["component_id"] for r in ranked} == naive(rows, '"red lamp" or chair') and [r["rank"] for r in ranked] == list(range(1, len(ranked) + 1))
    assert all(a["score"] >= b["score"] for a, b in zip(ranked, ranked[1:], strict=False)) and ft.search(index, "", 5).collect() == []


def test_a_search_reads_the_buckets_of_its_words(spark, tmp_path):
    rows = spark.range(300).selectExpr("id AS component_id", "concat('word', id, ' lamp') AS caption")
    ft.write_index(rows, str(tmp_path))
    asked = ft.read_index(spark, str(tmp_path)).of(ft.read_index(spark, str(tmp_path)).postings, ["word7"])
    assert asked.count() == 1
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and "PushedFilters" in plan
