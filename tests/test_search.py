import pytest
from pyspark.sql import functions as F

from foliant.functions import text as tx
from foliant.operators import search
from foliant.plans.search_plan import Refused, SearchPlan, read_sigils

LINES = ["stone", "xstone", "bigstones", "s a t o n e", "red stone", "red a b stone", "stone red", "red a b c d e stone", "store", ""]


@pytest.fixture(scope="module")
def segs(spark):
    rows = [(0, "w", "en", i, x) for i, x in enumerate(LINES)] + [(1, "v", "en", 0, "red stone")]
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, line_no int, line string")


def lines(found):
    return sorted((r.doc_id, r.line_no) for r in found.select("doc_id", "line_no").collect())


@pytest.mark.parametrize(
    ("typed", "want"),
    [("stone", [0, 4, 5, 6, 7]), ("*stone*", [0, 1, 2, 4, 5, 6, 7]), ('"red stone"', [4]), ("~0 red stone", [4, 6]), ("~2 red stone", [4, 5, 6]), ("~5 red stone", [4, 5, 6, 7]), ("/sto.e/", [0, 4, 5, 6, 7, 8]), ("~stn", [0, 1, 2, 4, 5, 6, 7]), ("absent", [])],
)
def test_what_was_typed_is_what_is_found(segs, typed, want):
    assert [n for d, n in lines(search.hits(segs, read_sigils(typed))) if d == 0] == want


@pytest.mark.parametrize("bad", ["", "/^a/", "/a$/", "/(?=a)b/", "~1 a b c d e f"])
def test_what_is_too_broad_is_refused(bad):
    with pytest.raises(Refused):
        read_sigils(bad)


def test_too_many_sequences_are_refused():
    with pytest.raises(Refused):
        SearchPlan(tuple(tuple(map(str, range(40))) for _ in range(2)), shape="phrase")


def test_offers_only_on_nothing_and_what_they_say(segs):
    assert search.offers(segs, read_sigils("stone")).count() == 0
    for r in search.offers(segs, read_sigils("ston")).collect():
        assert r.n == search.hits(segs, SearchPlan((("ston",),), match=r.rung)).count() > 0


def test_facet_rows_are_what_narrowing_finds_and_unbuilt_is_not_zero(spark, segs):
    found = search.hits(segs, read_sigils("red"))
    catalogue = spark.createDataFrame([("w", ["a", "b"], None, None, True)], "source string, shelf array<string>, era string, author string, known boolean")
    tags = spark.createDataFrame([(1, "good")], "doc_id long, tag string")
    rows = {(r.dimension, r.key): r.n for r in search.facets(found, catalogue, tags).collect()}
    assert rows == {("work", "w"): 4, ("shelf", "a"): 4, ("shelf", "a/b"): 4, ("era", ""): 4, ("tag", "good"): 1, ("uncatalogued", ""): 1, ("link", "not built"): None}


def test_scopes(spark, segs):
    found, one, none = search.hits(segs, read_sigils("red")), spark.createDataFrame([(1,)], "doc_id long"), spark.createDataFrame([], "doc_id long")
    assert lines(search.scoped(found, [one])) == [(1, 0)]
    assert lines(search.scoped(found, [none])) == []
    assert len(lines(search.scoped(found))) == 5 and len(lines(search.scoped(found, [], [one]))) == 4


def test_index_round_trip(spark, segs, tmp_path):
    search.write_index(segs, str(tmp_path / "i"), 4)
    got = spark.read.parquet(str(tmp_path / "i")).where("term = 'stone'")
    assert lines(got) == lines(search.hits(segs, read_sigils("stone")))


def test_where_from_looks_for_the_whole_phrase(spark):
    said = ["one two three four five six", "x One, two three four five six y", "one two three four other", "five six", "one two three four five sixty"]
    segs = spark.createDataFrame([(i, "vwv"[i % 3], "en", 0, x) for i, x in enumerate(said)] + [(1, "w", "en", 0, said[1])], "doc_id long, source string, lang string, line_no int, line string")
    phrases = spark.createDataFrame([(1, said[0]), (2, "five six"), (3, "one"), (4, "?"), (5, "one two three four"), (6, "two three four five six seven")], "item_id long, text string")
    found = lambda **o: {r.item_id: (r.hits, r.works, r.turn_of_speech) for r in search.where_from(segs, phrases, 4, **o).collect()}
    assert found(too_common=3) == {1: (3, 2, False), 2: (4, 2, True), 3: (5, 2, True), 5: (5, 2, True)}
    assert found(without="w") == {1: (1, 1, False), 2: (2, 1, False), 3: (2, 1, False), 5: (2, 1, False)}
    assert search.where_from(segs, phrases.where("item_id = 4"), 4).count() == 0


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).head().x
    normal = one(tx.hebrew_normal(F.lit("שָׁלוֹם״")))
    assert normal == 'שלומ"' and one(tx.hebrew_normal(F.lit(normal))) == normal
    assert one(tx.letter_value(F.lit("שלומ"), tx.HEBREW, tx.HEBREW_VALUES)) == 376
    assert one(tx.letter_value(F.lit("ab1"))) is None and one(tx.letter_value(F.lit(""))) is None
    assert one(tx.mirrored(F.lit("abz"))) == "zya"
    assert one(tx.initials_at(F.array(*map(F.lit, ["to", "of", "an", "to", "ox", "at"])), "toa")) == [0, 3]
    assert one(search.skips(F.lit("zxexrzer"), "zer", 2)) == [0]
    assert one(search.skips(F.lit("zerzer"), "zer", 1)) == [0, 3]
    assert one(tx.located(F.lit("abcabc"), F.lit(3), F.lit("abc"))) == 3
    assert one(tx.located(F.lit("xaaa"), F.lit(0), F.lit("aa"))) is None
    assert one(tx.located(F.lit("xab"), F.lit(0), F.lit("ab"))) == 1
    assert one(tx.opening(F.lit("abcdef"), 3)) == "abc…"
    assert one(tx.snippet(F.lit("x" * 300 + "MARK" + "y" * 300), F.lit(300), F.lit(4))).startswith("…" + "x" * 55 + "[MARK]y")


def test_letter_sequences_are_found_in_both_directions(spark):
    from foliant import queries

    def brute(text, word, k):
        ways = [False] if word == word[::-1] else [False, True]
        return {(i, b) for b in ways for i in range(len(text)) if text[i : i + k * len(word) : k][: len(word)] == (word[::-1] if b else word)}

    for text, word in [("zerezrez", "zer"), ("rxexzxexr", "zer"), ("abababa", "aba"), ("zzz", "z"), ("", "zer"), ("zez", "zer")]:
        for k in (1, 2, 3):
            got = spark.range(1).select(search.sequences(F.lit(text), word, k).alias("x")).head().x
            assert len(got) == len(set(got)) and {(r.i, r.backwards) for r in got} == brute(text, word, k)
    found = queries.Q["dilug"](spark, "/root/testdata/sf0.001")
    assert found.columns == ["doc_id", "i", "skip", "backwards"]
    texts = {r.doc_id: "".join(c for c in r.text.lower() if "a" <= c <= "z") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {tuple(r) for r in found.collect()} == {(d, i, k, b) for d, x in texts.items() for k in range(1, 5) for i, b in brute(x, "zer", k)}
