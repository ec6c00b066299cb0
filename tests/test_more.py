import datetime

import pytest
from pyspark.sql import functions as F

from foliant.functions import calendar as cal
from foliant.functions.text import fixed_day
from foliant.operators import graph, index, records, search, shelf
from foliant.plans.search_plan import Refused, SearchPlan, read_sigils

KIND = "doc_id long, source string, lang string, line_no int, line string"


@pytest.fixture
def lines(spark):
    said = ["the stone that fell", "a stone wall", "that old stone the wall", "walls of the stone", "The THE the", "", "stonework that"]
    return spark.createDataFrame([(i // 2, f"w{i % 2}", "en", i % 2, x) for i, x in enumerate(said)], KIND)


@pytest.mark.parametrize("typed", ["stone", "the stone", '"the stone"', '"stone wall"', "~1 the stone", "~0 the the", "*ston*", "/wall?s?/", "~stn", "nowhere", '"old stone the"'])
def test_the_index_finds_what_a_scan_finds(spark, lines, tmp_path, typed):
    index.write(lines, str(tmp_path), "0", 4)
    index.write(lines.where("doc_id > 1"), str(tmp_path), "0", 4)
    index.write(lines.where("doc_id <= 1"), str(tmp_path), "1", 4)
    plan, names = read_sigils(typed), lambda rows: sorted((r.doc_id, r.line_no) for r in rows.collect())
    assert names(index.search(spark, str(tmp_path), plan, 4)) == names(search.hits(lines, plan))


def test_what_is_forgotten_is_not_found(spark, lines, tmp_path):
    at = str(tmp_path)
    index.write(lines, at, "0", 4)
    index.forget(lines.where("doc_id < 2"), at, "1")
    found = lambda: {r.doc_id for r in index.search(spark, at, read_sigils("stone"), 4).collect()}
    everything = {r.doc_id for r in search.hits(lines, read_sigils("stone")).collect()}
    assert found() == {d for d in everything if d >= 2}
    index.write(lines.where("doc_id = 1"), at, "2", 4)
    assert found() == {d for d in everything if d >= 1}


def test_a_search_that_takes_too_many_words_is_refused(spark, lines, tmp_path, monkeypatch):
    index.write(lines, str(tmp_path), "0", 4)
    monkeypatch.setattr(index, "MOST_TERMS", 2)
    with pytest.raises(Refused, match="more than 2"):
        index.search(spark, str(tmp_path), read_sigils("*l*"), 4)


@pytest.mark.parametrize("typed", ["*l*", "/.*e.*/ /wall?s?/", "*o* *zz*", "~tn"])
def test_a_broad_search_finds_all_that_a_scan_finds(spark, lines, tmp_path, monkeypatch, typed):
    index.write(lines, str(tmp_path), "0", 4)
    monkeypatch.setattr(index, "MOST_TERMS", 1)
    plan, names = read_sigils(typed), lambda rows: sorted((r.doc_id, r.line_no) for r in rows.collect())
    assert names(index.search(spark, str(tmp_path), plan, 4, broad=True)) == names(search.hits(lines, plan))


def test_index_contains_is_not_refused(spark, monkeypatch):
    from foliant.more_queries import index_contains
    from foliant.queries import search_contains

    at = "/root/testdata/sf0.001"
    monkeypatch.setattr(index, "MOST_TERMS", 1)
    assert sorted(map(tuple, index_contains(spark, at).collect())) == sorted(map(tuple, search_contains(spark, at).collect()))


def test_freshness_without_an_index_is_its_own_state(spark):
    notes = spark.createDataFrame([(datetime.datetime(2024, 1, 2),)], "at timestamp")
    assert index.freshness(notes, "at", None).head().state == "no index"
    assert tuple(index.freshness(notes, "at", "2024-01-01").head()) == ("behind", 1) and index.freshness(notes, "at", "2024-02-01").head().state == "fresh"


@pytest.mark.parametrize(("day", "year", "of_year"), [("2024-10-03", 5785, 1), ("2024-10-02", 5784, 383), ("2023-09-16", 5784, 1), ("1999-09-11", 5760, 1), ("2000-01-01", 5760, 113), ("1948-05-14", 5708, 243)])
def test_known_days_of_the_hebrew_calendar(spark, day, year, of_year):
    got = spark.createDataFrame([(day,)], "d string").select(cal.hebrew(fixed_day(F.to_date("d"))).alias("h")).select("h.*").head()
    assert (got.year, got.day_of_year) == (year, of_year) and got.days in (353, 354, 355, 383, 384, 385)


def test_pages_and_years(spark):
    one = spark.range(0, 300)
    assert one.where(cal.page_of(cal.folio(F.col("id"))) != F.col("id")).count() == 0
    assert [r.f for r in one.limit(3).select(cal.folio(F.col("id")).alias("f")).collect()] == ["2a", "2b", "3a"]
    said = {"1040": (1040, 1040), "c. 1040-1105": (1040, 1105), "300 BCE": (-300, -300), "12th century": (1101, 1200), "2nd century BCE": (-200, -101), "long ago": None, "": None, None: None}
    got = {r.t: r.y and tuple(r.y) for r in spark.createDataFrame([(k,) for k in said], "t string").select("t", cal.years(F.col("t")).alias("y")).collect()}
    assert got == said


def test_redirects_are_followed_to_the_end(spark):
    pairs = [(f"n{i}", f"n{i + 1}") for i in range(100)] + [("a", "b"), ("b", "a"), ("c", "a"), ("self", "self")]
    got = dict(map(tuple, records.closure(spark.createDataFrame(pairs, "old string, new string")).collect()))
    assert all(got[f"n{i}"] == "n100" for i in range(100)) and got["a"] is got["b"] is got["c"] is got["self"] is None
    assert records.closure(spark.createDataFrame([], "old string, new string")).count() == 0


def test_a_path_has_its_steps_or_says_why_not(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "x"), ("x", "d"), ("q", "r")], "a string, b string")
    assert tuple(graph.path_steps(e, "a", "d").head()) == ("path", 2, ["a", "x", "d"])
    assert tuple(graph.path_steps(e, "a", "a").head()) == ("path", 0, ["a"])
    assert graph.path_steps(e, "a", "q").head().outcome == "none" and graph.path_steps(e, "a", "d", most=1).head().outcome == "not within"


def test_a_shortlist_has_nine_of_the_ten_nearest(spark):
    import numpy as np

    r = np.random.default_rng(4)
    centers = r.standard_normal((30, 16))
    rows = [(i, [float(x) for x in centers[i % 30] + 0.3 * r.standard_normal(16)]) for i in range(3000)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    hit = 0
    for q in range(5):
        exact = {x.vec_id for x in records.nearest_exact(e, rows[q][1], 10).collect()}
        hit += len(exact & {x.vec_id for x in records.nearest_shortlisted(e, rows[q][1], 10).collect()})
    assert hit >= 45


def test_small_tables(spark):
    got = shelf.narrowed(spark.createDataFrame([("x", 1), ("x", 2), ("y", 3), ("y", None)], "k string, v int"), "k", F.col("v") == 2)
    assert sorted((r.k, r.v or 0) for r in got.collect()) == [("x", 2), ("y", 0), ("y", 3)]
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "segment long, text string")
    layer = lambda *rows: spark.createDataFrame(list(rows), "segment long, was string, now string")
    out = shelf.corrected(texts, [layer((1, "?", "no"), (2, "b", "B")), layer((1, "a", "A"), (2, "b", "second"))])
    assert sorted(map(tuple, out.collect())) == [(1, "A", 1), (2, "B", 0), (3, "c", 0)]
    shelves = spark.createDataFrame([("a", "one", 1), ("a/b", "two", 2)], "prefix string, shelf string, rank int")
    works = spark.createDataFrame([("a/b/c",), ("a/x",), ("z",), (None,)], "category string")
    assert {r.category: r.shelf for r in shelf.shelved(works, "category", shelves).collect()} == {"a/b/c": "two", "a/x": "one", "z": None, None: None}
    assert shelf.variants_of(["a", "b"], {"a": ["x", "a"]}) == (("a", "x"), ("b",))
    words = SearchPlan((("ing",),), match="prefix", particles="ab")
    assert [r.t for r in spark.createDataFrame([("aing",), ("ing",), ("cing",), ("ababing",), ("ababaing",)], "t string").where(words.term(F.col("t"), ("ing",))).collect()] == ["aing", "ababing"]
