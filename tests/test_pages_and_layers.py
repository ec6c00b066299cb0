import pytest
from pyspark.sql import functions as F

from foliant.functions import text as tx
from foliant.functions.registered import register
from foliant.operators import editing, pages
from foliant.sources import files

GLYPH = "page int, no int, text string, x0 double, y0 double, x1 double, y1 double"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_glyphs_become_words(spark):
    def line(page, y, *glyphs):
        return [(page, i, t, float(x), float(y), float(x + w), float(y + 10)) for i, (t, x, w) in enumerate(glyphs)]

    rowset = [
        *line(1, 40, ("ב", 45, 4), ("א", 50, 4), (" ", 41, 4), ("1", 20, 4), ("2", 24, 4)),
        *line(2, 0, ("א", 10, 4), ("ב\x0e", 5, 4)), *line(2, 20, ("ג", 10, 4), ("\x10", 4, 4), ("ד", 5, 0)), *line(3, 0, ("", 1, 1), (None, 1, 1)),
    ]
    got = pages.grouped_words(spark.createDataFrame(rowset, GLYPH), "page")
    assert rows(got.select("page", "no", "line", "text", "refused")) == [(1, 0, 0, "אב", False), (1, 1, 0, "12", False), (2, 0, 0, "אב", True), (2, 1, 1, "גד", False)]
    assert got.where("page = 1 AND no = 0").select("x0", "y0", "x1", "y1").head() == (45.0, 40.0, 54.0, 50.0)
    assert pages.grouped_words(spark.createDataFrame([], GLYPH), "page").count() == 0


def test_words_down_the_page_and_by_shared_height(spark):
    glyphs = [(1, 1, "ב", 0.0, 20.0, 4.0, 30.0), (1, 2, "א", 0.0, 0.0, 4.0, 10.0), (1, 3, "ג", -5.0, 25.0, -1.0, 35.0), (1, 4, "ד", -5.0, 6.7, -1.0, 16.7)]
    assert [r.text for r in pages.grouped_words(spark.createDataFrame(glyphs, GLYPH), "page").orderBy("no").collect()] == ["א", "ד", "בג"]


def test_fixes_without_their_word(spark):
    box = "x0 double, y0 double, x1 double, y1 double"
    words = spark.createDataFrame([(1, 1, "was", 0.0, 0.0, 10.0, 10.0), (1, 2, "now", 20.0, 0.0, 30.0, 10.0)], f"page int, word int, text string, {box}")
    fixes = spark.createDataFrame([(1, "a", "was", 1.0, 0.0, 10.0, 10.0), (1, "b", "was", 20.0, 0.0, 30.0, 10.0), (2, "c", "was", 0.0, 0.0, 10.0, 10.0), (1, "d", "was", 5.0, 0.0, 30.0, 10.0)], f"page int, mark string, was string, {box}")
    assert sorted(r.mark for r in pages.stranded(fixes, words, "page").collect()) == ["b", "c", "d"]


def test_questions(spark):
    said = spark.createDataFrame([("What is it",), ("so it is?",), ("whatever",), ("«מהו הדין",), ("במה דברים",), ("",), (None,)], "t string")
    assert [r.q for r in said.select(tx.is_question(F.col("t")).alias("q")).collect()] == [True, True, False, True, False, False, False]


def test_layers_go_out_and_come_in(spark, tmp_path):
    at = str(tmp_path / "layers")
    of = lambda *r: spark.createDataFrame(list(r), "id bigint, said string")
    editing.layers_out({"note": of((1, "a\n\"b\""), (2, None)), "mark": of((3, ""))}, at)
    (tmp_path / "layers" / "kind=note" / "own.txt").write_text('{"id": 9, "said": \n')
    good, bad = editing.layers_in(spark, at, "id bigint, said string")
    assert rows(good) == [("mark", 3, ""), ("note", 1, 'a\n"b"'), ("note", 2, None)]
    assert rows(bad) == [("note", '{"id": 9, "said": ')]


def test_companions_and_folders(spark):
    got = editing.companions(spark.createDataFrame([("a",), ("a",), ("b",)], "work string"), spark.createDataFrame([("b", 2), ("b", 1), ("c", 1)], "work string, n bigint"))
    assert rows(got) == [("a", True, 0), ("b", True, 3), ("c", False, 1)]
    edges = spark.createDataFrame([("x", "base", "comments-on"), ("x", "base", "comments-on"), ("y", "base", "comments-on"), ("z", "base", "quotes"), ("w", "base", "comments-on")], "src_work string, dst_work string, edge_type string")
    works = spark.createDataFrame([("x", "A/1"), ("y", "A"), ("z", "A"), ("v", "A")], "work string, shelf string")
    assert rows(editing.folders(edges, "base", works)) == [("A", 1, 2), ("A/1", 2, 1)]


def test_provenance(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"name": "a", "licence": " Unknown"}\n{"name": "b", "origin": "o", "licence": "PD "}\n{"name": "c"}\n')
    assert rows(files.library_metadata(spark, str(tmp_path / "l.json"))) == [("a", None, None), ("b", "o", "PD"), ("c", None, None)]


@pytest.mark.parametrize(("word", "value"), [("ab", 3), ("z", 26), ("a1", None), ("", None), (None, None)])
def test_functions_in_sql_are_those_in_python(spark, word, value):
    register(spark)
    got = spark.createDataFrame([(word,)], "w string").selectExpr("w", "foliant_letter_value(w) AS v", "foliant_mirrored(w) AS m").select("*", tx.letter_value(F.col("w")).alias("v2"), tx.mirrored(F.col("w")).alias("m2")).head()
    assert (got.v, got.m) == (got.v2, got.m2) and got.v == value
