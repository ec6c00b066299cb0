import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from foliant.operators import graph, records
from foliant.sources.tables import catalogue_union, headed_text, nested_json


def brute_trace(edges, years, start, depth, width):
    """Level by level, over lists in their order."""
    ends = sorted([(no, a, b, t, c) for no, a, b, t, c in edges] + [(no, b, a, t, c) for no, a, b, t, c in edges])
    seen, front, out = {start}, [start], []
    for level in range(1, depth + 1):
        taken = []
        owner = {}
        for parent in front:
            for no, a, b, t, c in ends:
                if a == parent and c > 0 and b != a and b in years and a in years and years[a] > years[b] and b not in seen and b not in owner:
                    owner[b] = (parent, no, t, c, years[a] - years[b])
        for parent in front:
            mine = sorted((t, -c, gap, b, no) for b, (p, no, t, c, gap) in owner.items() if p == parent)[:width]
            taken += [(m[3], parent, level, m[4]) for m in mine]
        seen |= set(owner)
        out += taken
        front = [x[0] for x in taken]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_trace_is_the_brute_force_one(spark, seed):
    r = random.Random(seed)
    names = [f"n{i}" for i in range(14)]
    years = {n: r.randint(0, 9) for n in names[:-1]}
    edges = [(i, r.choice(names), r.choice(names), r.randint(0, 3), r.choice([0.0, 0.7, 0.9])) for i in range(70)]
    start = max(years, key=years.get)
    e = spark.createDataFrame(edges, "edge_no long, a string, b string, type_no int, confidence double")
    t = spark.createDataFrame([(n, y, y) for n, y in years.items()], "node string, y0 int, y1 int")
    got, refused = graph.trace(e, t, start, depth=2, width=2)
    assert sorted(map(tuple, got.collect())) == brute_trace(edges, years, start, 2, 2)
    assert refused


def test_path_and_forks(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d"), ("d", "c"), ("x", "y")], "a string, b string")
    assert tuple(graph.path(e, "a", "c").head()) == ("path", 2)
    assert tuple(graph.path(e, "a", "y").head()) == ("not within", None)
    assert [tuple(r) for r in graph.forks(e, "a").collect()] == [("b", "d", 1, False)]


def test_forks_are_those_of_all_pairs(spark):
    """Works with the same witnesses, with none, linked to each other, to themselves, to nothing, and more than once."""
    rng = random.Random(5)
    name = lambda: rng.choice([None, *(f"n{i}" for i in range(30))])
    rows = [(name(), name()) for _ in range(120)] + [("n0", f"n{i}") for i in range(1, 12)] + [(f"m{i}", x) for i in range(40) for x in ("n0", "n1", "p", "q")] + [("m3", "m7"), ("m8", "m2"), ("m8", "n1")]
    u = {(x, y) for a, b in rows for x, y in ((a, b), (b, a)) if a and b and a != b}
    at = {x: {y for z, y in u if z == x} - {"n0"} for x, _ in u}
    side = sorted(y for x, y in u if x == "n0")
    want = [(x, y, len(at[x] & at[y]), (x, y) in u) for x in side for y in side if x < y and at[x] & at[y]]
    assert {w[3] for w in want} == {True, False}
    e = spark.createDataFrame(rows, "a string, b string")
    for chunk in (1, 3, 256):
        assert sorted(map(tuple, graph.forks(e, "n0", chunk).collect())) == want
    assert graph.forks(e, "nowhere").count() == 0


def test_forks_of_works_with_the_same_witnesses(spark, in_time):
    """1,999,000 pairs with 2,000 witnesses each."""
    e = spark.range(4_000_000).selectExpr("CONCAT('r', id DIV 2000) AS a", "CONCAT('w', id % 2000) AS b").unionAll(spark.range(2000).selectExpr("CONCAT('r', id)", "'start'"))
    got = graph.forks(e, "start").agg(F.count(F.lit(1)), F.count_distinct("x", "y"), F.min("witnesses"), F.max("witnesses")).head()
    assert tuple(got) == (1_999_000, 1_999_000, 2000, 2000)


def test_repairs_orientation_and_masks(spark):
    e = spark.createDataFrame([(1, "c", 1, "t", 2, "comments-on", "cited", True), (2, "t", 3, "c", 4, "comments-on", "inferred", False)], "edge_no long, src_work string, src_ord int, dst_work string, dst_ord int, edge_type string, method string, directed boolean")
    bases = spark.createDataFrame([("c", "t")], "work string, base string")
    got = {r.edge_no: (r.verdict, r.src_work, r.src_ord) for r in graph.oriented(e, bases).collect()}
    assert got == {1: ("kept", "c", 1), 2: ("flipped", "c", 4)}
    fixes = spark.createDataFrame([(2, 1, "confirmed", None), (2, 2, "rejected", None), (2, 1, None, "quotes"), (9, 1, "rejected", None)], "edge_no long, at int, verdict string, retype string")
    r = {x.edge_no: (x.edge_type, x.shipped_type, x.confidence) for x in graph.repaired(e, fixes).collect()}
    assert r == {1: ("comments-on", "comments-on", 0.9), 2: ("quotes", "comments-on", 0.0)}
    assert [x.edge_no for x in graph.orphans(fixes, e).collect()] == [9]
    spans = spark.createDataFrame([("w", 1, 3, "quotes"), ("w", 2, None, "comments-on")], "work string, from_ord int, to_ord int, edge_type string")
    assert sorted(map(tuple, graph.masks(spans).collect())) == [("w", 1, 2), ("w", 2, 3), ("w", 3, 2)]


def test_log(spark):
    log = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("b", 1, True), ("b", 3, False)], "k string, n int, gone boolean")
    assert [tuple(r) for r in records.replayed(log, ["k"], "n", F.col("gone")).select("k", "n").collect()] == [("b", 3)]
    assert records.needs_compaction(100, 10) and not records.needs_compaction(84, 10)


def test_overlay(spark):
    texts = spark.createDataFrame([("s", "one two three"), ("t", "plain")], "segment string, text string")
    patches = spark.createDataFrame([("s", 4, "two", "2"), ("s", 0, "three", "3"), ("s", 5, "wo t", "x"), ("s", 0, "zzz", "")], "segment string, begin int, was string, now string")
    got = {r.segment: (r.text, r.applied, r.stale) for r in records.overlaid(texts, patches).collect()}
    assert got == {"s": ("one 2 3", 2, 2), "t": ("plain", 0, 0)}


def test_suspects(spark):
    v = spark.createDataFrame([("stone", 12000, 12000), ("stome", 1, 1), ("stones", 1, 1), ("astone", 1, 1), ("sto", 1, 1), ("other", 500, 500)], "term string, df long, cf long")
    got = records.suspects(v).collect()
    assert [(r.rare, r.common, r.how) for r in got] == [("stome", "stone", "substitution")]
    assert got[0].score == (14 * 10 + 5 * 5) * 10 // 10


def test_pieces_put_together_are_the_text():
    r = random.Random(3)
    t = "".join(r.choice(["word ", "end. ", "x" * 50, "\n"]) for _ in range(2000))
    out = records.pieces(pd.Series([t, "short", None]))
    assert "".join(out[0]) == t and max(map(len, out[0])) <= 5200 and out[1] == ["short"] and out[2] == []


def test_alignment_is_a_longest_rising_run(spark):
    a = spark.createDataFrame([("w", i, t) for i, t in enumerate("abcdea")], "k string, no int, text string")
    b = spark.createDataFrame([("w", i, t) for i, t in enumerate("bxdce")], "k string, no int, text string")
    got = sorted((r.old_no, r.new_no) for r in records.aligned(a, b, "k").collect())
    assert len(got) == 3 and got[0] == (1, 0) and got[-1] == (4, 4)


def test_asof_closure_and_shortlist(spark):
    left = spark.createDataFrame([("w", 1), ("w", 5), ("w", 9)], "k string, p int")
    anchors = spark.createDataFrame([("w", 2, "a"), ("w", 7, None)], "k string, p int, v string")
    assert sorted((r.p, r.anchor_at, r.anchor) for r in records.asof(left, anchors, "k", "p", "v").collect())[1:] == [(5, 2, "a"), (9, 7, None)]
    chain = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "old string, new string")
    assert sorted(map(tuple, records.closure(chain).collect())) == [("a", "c"), ("b", "c"), ("x", "y")]
    r = random.Random(1)
    v = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(16)]) for i in range(300)], "vec_id long, embedding array<float>")
    q = v.where("vec_id = 5").head().embedding
    assert [x.vec_id for x in records.nearest_exact(v, q, 10).collect()] == [x.vec_id for x in records.nearest_shortlisted(v, q, 10, least=300).collect()]


def test_sources(spark):
    body = spark.createDataFrame([("w", "<h1>A</h1>\none\n<h2>B</h2>\n\ntwo\n<h1>C</h1>\nthree")], "k string, body string")
    assert [(r.section, r.text) for r in headed_text(body, "k", "body").orderBy("line_no").collect()] == [("A", "one"), ("A / B", "two"), ("C", "three")]
    works = spark.createDataFrame([("w", '{"text": [["a", "b"], [], ["", "c"]]}')], "slug string, json string")
    assert [(r.path, r.text) for r in nested_json(works, 2).collect()] == [([1, 1], "a"), ([1, 2], "b"), ([3, 2], "c")]
    one, two = spark.createDataFrame([("a", 1)], "k string, n int"), spark.createDataFrame([("a", 2), ("b", 3)], "k string, n int")
    assert sorted(map(tuple, catalogue_union(one, two, "k").collect())) == [("a", 1), ("b", 3)]
