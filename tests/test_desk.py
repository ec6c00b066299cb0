import pytest
from pyspark.sql import functions as F

from foliant.operators import desk


def one(spark, expr, kind="string", **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kind}" for k in values))
    return row.select(expr.alias("x")).head().x


@pytest.mark.parametrize(
    ("comment", "wanted"),
    [
        ("From when on. At the hour – this is", ["From when on. At the hour", "From when on"]),
        ("From when: - this is. More", ["From when", "From when: - this is"]),
        ("one – two words. and", ["one – two words"]),
        (" ".join(["w"] * 13) + " - so", []),
        ("", []),
        (None, []),
    ],
)
def test_openings(spark, comment, wanted):
    assert one(spark, desk.openings(F.col("c")), c=comment) == wanted


@pytest.mark.parametrize(
    ("base", "comment", "wanted"),
    [
        ("From when on does one read", "When ON - so", (1, 2)),
        ("a b then a b", "a b - twice", None),
        ("a b then a b c", "a b. b c - the clause stands twice, and the whole nowhere", None),
        ("x y", "x y z - longer than the base", None),
        ("a b then c d", "c d. zz – the clause", (3, 4)),
        ("", "a b - so", None),
        (None, None, None),
    ],
)
def test_an_opening_is_found_where_it_stands_once(spark, base, comment, wanted):
    got = one(spark, desk.opening_span(F.col("b"), F.col("c")), b=base, c=comment)
    assert (got and tuple(got)) == wanted


def test_a_styled_opening_comes_first(spark):
    assert tuple(one(spark, desk.opening_span(F.col("b"), F.col("c"), F.col("s")), b="a b c d", c="a b - so", s="c d.")) == (2, 3)


def test_anchors_go_and_their_places_stay(spark):
    text = 'a<i data-commentator="R" data-order="1"></i>b<i>kept</i><i\tdata-commentator=Mishnah B" data-label="x"></i><img data-commentator="n">c<i data-commentator="no">full</i>'
    got = one(spark, desk.mined(F.col("t")), t=text)
    assert got.text == 'ab<i>kept</i><img data-commentator="n">c<i data-commentator="no">full</i>'
    assert [tuple(a) for a in got.anchors] == [("R", None, 1), ("Mishnah B", "x", 13)]
    assert one(spark, desk.mined(F.col("t")), t="plain").anchors == []


def test_refs_cover_places_level_by_level(spark):
    refs = [("whole", "w", [], None), ("point", "w", [1], None), ("deep", "w", [1, 10], None), ("range", "w", [1, 9], [2, 1]), ("turned", "w", [3], [1]), ("other", "v", [1], None), ("none", None, None, None)]
    places = [("p", "w", [1, 10]), ("q", "w", [10]), ("r", "w", [2, 2]), ("s", "w", []), ("t", "w", None), ("u", None, [1])]
    got = desk.citing(spark.createDataFrame(refs, "ref string, work string, from array<int>, to array<int>"), spark.createDataFrame(places, "place string, work string, address array<int>"))
    assert sorted(map(tuple, got.collect())) == sorted([("whole", x) for x in "pqrs"] + [("point", "p"), ("deep", "p"), ("range", "p")])


def test_chosen_parts_and_work_left(spark):
    segs = spark.createDataFrame([(1, "w", [1, 2], "x", None), (2, "w", [12], "x", "heading"), (3, "v", [], " \n", None), (4, "v", [7], None, "page"), (5, "w", [1], "y", "text")], "id long, work string, path array<int>, text string, kind string")
    ids = lambda rows: sorted(r.id for r in rows.collect())
    assert ids(desk.chosen(segs, spark.createDataFrame([("w", [1]), ("w", [1, 2]), ("v", [])], "work string, under array<int>"))) == [1, 3, 4, 5]
    done = spark.createDataFrame([(1, "m"), (1, "m"), (5, "old")], "id long, model string")
    assert ids(desk.work_left(segs, done, "id", "m")) == [5]
    assert ids(desk.work_left(segs, done.limit(0), "id", "m")) == [1, 5]


def test_registry_spellings_and_collections(spark):
    of = lambda *rows: spark.createDataFrame(list(rows), "name string, changed long")
    got = desk.registry(of(("a", 1), ("b", 2), ("c", None), ("d", 1)), of(("a", 1), ("b", 3), ("c", 1), ("e", 1)), "name")
    assert dict(map(tuple, got.collect())) == {"a": "fresh", "b": "stale", "c": "stale", "d": "away", "e": "new"}
    words = lambda *rows: spark.createDataFrame(list(rows), "spelling string, work string")
    got = desk.spelled(words(("x", "w"), ("y", "w"), (None, "w")), words(("x", "w"), ("y", "v")))
    assert {tuple(r) for r in got.collect()} == {("x", "w", 1), ("y", None, 2)}
    kept = spark.createDataFrame([(1, ["a", "b"], ["t"]), (2, ["a"], []), (3, None, None)], "id int, members array<string>, tags array<string>")
    assert {r.id for r in desk.holding(kept, F.lit("a")).collect()} == {1, 2}
    assert {r.id for r in desk.holding(kept, F.lit("a"), "t").collect()} == {1}
