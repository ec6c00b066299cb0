import random

from pyspark.sql import functions as F

from foliant.operators import editing, pages
from foliant.sources import files


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def one(spark, expr, kind, *values):
    row = spark.createDataFrame([values], kind)
    return row.select(expr.alias("x")).head().x


def test_corrections_are_taken_or_refused(spark):
    held = spark.createDataFrame([("s", "a", 0, 5), ("s", "b", 10, 12), ("t", "a", 0, 9)], "segment string, id string, begin int, end int")
    asked = [("s", "n1", 5, 10, "x", "y"), ("s", "n2", 4, 6, "x", "y"), ("s", "n3", 9, 30, "x", "y"), ("s", "a", 1, 2, "x", "y"), ("s", "n4", 3, 3, "x", "y"), ("s", "n5", 6, 7, "x", "x"), ("u", "n6", 0, 4, "x", "y"), (None, "n7", 0, 4, "x", None)]
    got = editing.added(held, spark.createDataFrame(asked, "segment string, id string, begin int, end int, was string, now string"))
    assert {r.id: r.outcome for r in got.collect()} == {"n1": "taken", "n2": "clash", "n3": "clash", "a": "had", "n4": "no span", "n5": "no change", "n6": "taken", "n7": "taken"}
    assert got.columns == ["segment", "id", "begin", "end", "was", "now", "outcome"]
    none = editing.added(held.limit(0), held.selectExpr("*", "'x' AS was", "'y' AS now"))
    assert {r.outcome for r in none.collect()} == {"taken"}


def test_corrections_clash_as_by_pairs(spark):
    draw = random.Random(3)
    held, asked = [], []
    for seg in range(30):
        at = 0
        for i in range(draw.randrange(6)):
            begin = at + draw.randrange(4)
            at = begin + 1 + draw.randrange(5)
            held.append((seg, i, begin, at))
        asked += [(seg, 100 + i, b, b + 1 + draw.randrange(6), "x", "y") for i, b in enumerate(draw.choices(range(30), k=10))]
    got = editing.added(spark.createDataFrame(held, "segment int, id int, begin int, end int"), spark.createDataFrame(asked, "segment int, id int, begin int, end int, was string, now string"))
    wanted = {(s, i): any(h[0] == s and h[2] < e and h[3] > b for h in held) for s, i, b, e, _, _ in asked}
    assert {(r.segment, r.id): r.outcome == "clash" for r in got.collect()} == wanted


def test_taken_back(spark):
    held = spark.createDataFrame([("s", 1, "x"), ("s", 2, "y")], "segment string, id int, was string")
    stays, said = editing.taken_back(held, spark.createDataFrame([("s", 2), ("t", 2)], "segment string, id int"), ["segment", "id"])
    assert rows(stays) == [("s", 1, "x")]
    assert rows(said) == [("s", 2, "gone"), ("t", 2, "not held")]


def test_split_and_merge(spark):
    segs = spark.createDataFrame([("1", "abcd", "w"), ("2", "ef", "w"), ("3", None, "w"), ("4", "𝄞x", "w")], "id string, text string, work string")
    cuts = spark.createDataFrame([("1", 2), ("2", 99), ("4", 1)], "id string, at int")
    assert rows(editing.split_at(segs, cuts)) == sorted([("1.1", "ab", "1", "w"), ("1.2", "cd", "1", "w"), ("2.1", "ef", "2", "w"), ("2.2", "", "2", "w"), ("3", None, None, "w"), ("4.1", "𝄞", "4", "w"), ("4.2", "x", "4", "w")], key=str)
    lines = spark.createDataFrame([("w", 1, "a", True), ("w", 2, "b", True), ("w", 5, None, False), ("w", 6, "d", None), ("w", 7, "e", True), ("v", 1, "f", True)], "work string, ord int, text string, j boolean")
    got = editing.merged_with_next(lines, F.col("j"), "work", "ord", "text")
    assert rows(got) == sorted([("w", 1, "ab", [2, 5]), ("w", 6, "d", []), ("w", 7, "e", []), ("v", 1, "f", [])], key=str)


def test_arranged_shelf(spark):
    works = spark.createDataFrame([("a", "x", 1), ("b", "x", 2), ("c", "y", 1), ("d", None, 1)], "slug string, shelf string, rank int")
    moves, order = spark.createDataFrame([("c", "x")], "slug string, shelf string"), spark.createDataFrame([("x", "b", 1), ("y", "c", 1)], "shelf string, slug string, no int")
    assert rows(editing.arranged(works, moves, order)) == sorted([("b", "x", 1), ("c", "x", 3), ("a", "x", 2), ("d", None, 1)], key=str)


def test_suggestions(spark):
    ask = lambda printed, common: one(spark, editing.suggested(F.col("p"), F.col("c")), "p string, c string", printed, common)
    assert [ask("שלום", "שלומ"), ask("ספר", "שלומ"), ask("מלך", "אבנ"), ask("דָבר", "דבר"), ask("ים", "יד"), ask("ים", "")] == ["שלום", "שלומ", "אבן", None, "יד", None]


def test_places_trees_and_names(spark):
    notes = spark.createDataFrame([(1, "w", 3, 5), (2, "w", 6, None), (3, "w", None, None), (4, "v", 3, 5)], "id int, work string, from_ord int, to_ord int")
    assert rows(editing.everything_on({"n": notes}, "w", 5, 5)) == [("n", 1, 3), ("n", 3, None)]
    works = spark.createDataFrame([("a/b",), ("a",), ("ab/c",), ("",), (None,)], "shelf string")
    assert rows(editing.tree(works, F.col("shelf"))) == [("a", 1, 2), ("a/b", 2, 1), ("ab", 1, 1), ("ab/c", 2, 1)]
    assert rows(editing.under(works, F.col("shelf"), "a")) == [("a",), ("a/b",)]
    ids = spark.createDataFrame([(1, ["2", "b"]), (9, ["2", "b"]), (1, [])], "work int, path array<string>")
    got = editing.printed_names(ids, spark.createDataFrame([(1, "T")], "work int, title string"))
    assert sorted(r.printed for r in got.collect()) == ["9#2:b", "T", "T 2 b"]


def test_words_and_ink(spark):
    words = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 12.0, 1.0, 20.0, 11.0), (1, 3, 0.0, 20.0, 5.0, 30.0), (1, 4, 3.0, 3.0, 3.0, 9.0), (2, 1, 0.0, 0.0, 1.0, 1.0)], "page int, word int, x0 double, y0 double, x1 double, y1 double")
    marks = spark.createDataFrame([(1, "m", 0.0, 0.0, 6.0, 10.0), (1, "m", 0.0, 0.0, 7.0, 12.0), (1, "n", 0.0, 0.0, 5.9, 10.0), (3, "o", 0.0, 0.0, 9.0, 9.0)], "page int, mark string, x0 double, y0 double, x1 double, y1 double")
    assert rows(pages.words_under(words, marks, "page")) == [(1, "m", 1)]
    assert rows(pages.ink_of(words.where("word < 4"), "page")) == [(1, 0, 0.0, 0.0, 20.0, 11.0, 2), (1, 1, 0.0, 20.0, 5.0, 30.0, 1), (2, 0, 0.0, 0.0, 1.0, 1.0, 1)]
    at = lambda line, n: one(spark, pages.word_at(F.col("l"), F.col("n")), "l string, n int", line, n)
    assert [at("ab cde", n) and tuple(at("ab cde", n)) for n in (0, 1, 2, 3, 5, 6, -1)] == [(0, 2, "ab"), (0, 2, "ab"), None, (3, 6, "cde"), (3, 6, "cde"), None, None]
    assert at(None, 1) is None


def test_own_files(spark, tmp_path):
    for name, data in {"a": b"\xef\xbb\xbfx y\n z \n\n\n\nq", "b": "א\n\nב".encode("utf-16"), "c": "שלום\nrest".encode("cp1255") + b"\xff", "d": b""}.items():
        (tmp_path / name).write_bytes(data)
    got = files.own_files(spark, str(tmp_path)).select(F.element_at(F.split("path", "/"), -1), "encoding", "no", "text")
    assert rows(got) == [("a", "utf-8", 1, "x y z"), ("a", "utf-8", 2, "q"), ("b", "utf-16", 1, "א"), ("b", "utf-16", 2, "ב"), ("c", "windows-1255", 1, "שלום"), ("c", "windows-1255", 2, "rest�")]
    assert one(spark, files.paragraphs(F.col("t")), "t string", None) == []


def test_address_lines(spark):
    body = "front\n\n@One a\nx\ny\nTwo b\n======\n===\nz\n" + "w" * 121 + "\n====="
    got = rows(files.address_lines(spark.createDataFrame([(1, body), (2, None), (3, "")], "k int, body string"), "k", "body"))
    assert sorted(got, key=lambda r: r[1]) == [
        (1, 1, "text", "0", 1, "front"), (1, 3, "heading", "One a", None, "One a"), (1, 4, "text", "One a", 1, "x"), (1, 5, "text", "One a", 2, "y"), (1, 6, "heading", "Two b", None, "Two b"),
        (1, 8, "text", "Two b", 1, "==="), (1, 9, "text", "Two b", 2, "z"), (1, 10, "text", "Two b", 3, "w" * 121)]


def test_segments_by_work_and_vectors(spark, tmp_path):
    at = str(tmp_path / "s")
    of = lambda *r: spark.createDataFrame(list(r), "work string, ord int, text string")
    files.write_segments(of(("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")), at)
    files.write_segments(of(("a", 1, "new")), at)
    assert rows(files.read_segments(spark, at).select("work", "ord", "text")) == [("a", 1, "new"), ("b", 1, "z")]
    assert rows(files.read_segments(spark, at, "b").select("text")) == [("z",)]
    store = spark.createDataFrame([(1, 1, "m", [1.0]), (1, 2, "m", [2.0]), (1, 3, "old", [3.0]), (2, 1, "m", None)], "id int, seq int, model string, vector array<double>")
    assert rows(files.newest_vectors(store, "m")) == [(1, 2, [2.0])]
    edges = spark.createDataFrame([(i, f"w{i % 7}", "quotes") for i in range(70)], "edge_no int, src string, edge_type string")
    files.write_edges(edges, str(tmp_path / "e"), "src", 4)
    assert sorted(r.edge_no for r in files.read_edges(spark, str(tmp_path / "e"), "src", "w3", 4).collect()) == list(range(3, 70, 7))
    segs = of(("a", 1, "x"))
    assert [files.stamp(segs, edges, 2, b).head().state for b in (None, 1, 2)] == ["none", "rebuild", "current"]
