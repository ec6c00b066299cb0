import importlib
import random
import sys

from pyspark.sql import functions as F

from foliant import queries
from foliant.api import Library
from foliant.operators import places, search
from foliant.streaming import live


def test_resolve_and_follow(spark):
    at = spark.createDataFrame([("w", "1:1", 1), ("w", "1:2", 2), ("w", "10:1", 3)], "work string, address string, ord int")
    asked = spark.createDataFrame([("w", "1"), ("w", "1:2"), ("w", "2"), ("v", "1")], "work string, key string")
    got = {(r.work, r.key): (r.first, r.last, r.n, r.outcome) for r in ((lambda x: x)(r) for r in places.resolve(asked, at).withColumnsRenamed({"first": "f", "last": "l"}).select("work", "key", F.col("f").alias("first"), F.col("l").alias("last"), "n", "outcome").collect())}
    assert got == {("w", "1"): (1, 2, 2, "resolved"), ("w", "1:2"): (2, 2, 1, "resolved"), ("w", "2"): (None, None, 0, "no address"), ("v", "1"): (None, None, 0, "no work")}
    lines = spark.createDataFrame([(1, "1:2:9"), (2, "3:1"), (3, "10:1")], "line int, address string")
    base = spark.createDataFrame([("1", 5), ("1:2", 6), ("10:1:1", 7)], "address string, ord int")
    assert sorted((r.line, r.place, r.levels) for r in places.followed(lines, base).collect()) == [(1, 6, 2), (2, None, None), (3, None, None)]


def test_touching_makes_each_pair_once(spark):
    ends = spark.createDataFrame([("w", 0, 40, 1), ("w", 7, None, 2), ("v", 7, None, 3)], "work string, from_ord int, to_ord int, edge_no int")
    spans = spark.createDataFrame([(1, "w", 5, 30), (2, "w", 41, 50)], "asked int, work string, lo int, hi int")
    for bucket in (1, 4, 256):
        assert sorted(map(tuple, places.touching(ends, spans, bucket).collect())) == [(1, 1), (1, 2)]


def test_touching_counts_are_those_of_the_pairs(spark):
    """Spans and ends that repeat, run backwards, are points, null, or in another work."""
    rng = random.Random(7)
    at = lambda: rng.choice([None, *range(-9, 60)])
    ends = spark.createDataFrame([(rng.choice(["v", "w", None]), at(), at(), i) for i in range(300)], "work string, from_ord int, to_ord int, edge_no int")
    spans = spark.createDataFrame([(i // 2, rng.choice(["v", "w", "x", None]), at(), at()) for i in range(200)], "asked int, work string, lo int, hi int")
    for bucket in (1, 4, 256):
        pairs = places.touching(ends, spans, bucket).groupBy("asked").agg(F.count(F.lit(1)).alias("n"))
        got = sorted(map(tuple, places.touching_counts(ends, spans, bucket).collect()))
        assert got and got == sorted(map(tuple, pairs.collect()))


def test_links_touching_makes_no_pairs(spark, tmp_path, in_time):
    """40,000,000,000 pairs, counted; a link without a quantity has no end and touches nothing."""
    li = spark.range(200_000).selectExpr("id AS l_orderkey", "CAST(140 AS BIGINT) AS l_partkey", "id AS l_suppkey", "1 AS l_linenumber", "CAST(IF(id = 0, NULL, 69) AS DOUBLE) AS l_quantity", "'A' AS l_returnflag", "'F' AS l_linestatus")
    li.write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(200_000).selectExpr("20 * id AS p_partkey", "CAST(0 AS INT) AS p_size").write.parquet(str(tmp_path / "part.parquet"))
    got = queries.links_touching(spark, str(tmp_path)).agg(F.count(F.lit(1)), F.min("n"), F.max("n")).head()
    assert tuple(got) == (200_000, 199_999, 199_999)


def test_lens_contents_marks_and_tags(spark):
    e = spark.createDataFrame([(0.9, "quotes", "A", True), (0.9, "quotes", None, False), (0.5, "references", "A", True)], "confidence double, edge_type string, era string, mine boolean")
    assert places.lens(e).count() == 3 and places.lens(e, 0.6, ["quotes"], ["A"], True).count() == 1
    s = spark.createDataFrame([("w", 0, None), ("w", 1, "a"), ("w", 2, "a"), ("w", 3, "b"), ("w", 4, "a")], "w string, n int, s string")
    assert [r.n for r in places.contents(s, "w", "n", "s").orderBy("n").collect()] == [1, 3, 4]
    t = spark.createDataFrame([("Law", "note", 1), ("law ", "note", 2)], "tag string, kind string, at int")
    assert [tuple(r) for r in places.agreeing_tags(t).collect()] == [("Law", "note", 2)]


def test_streams(spark, tmp_path):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")]
    spark.createDataFrame(rows, "k string, n int, v string").write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema("k string, n int, v string").parquet(str(tmp_path / "log"))
    q = live.latest(stream, ["k"], "n").writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("latest").collect())) == [("a", 2, "y"), ("b", 1, "z")]
    segs = spark.createDataFrame([(1, "w", "en", 0, "one two"), (2, "w", "en", 0, "two")], "doc_id long, source string, lang string, line_no int, line string")
    segs.write.parquet(str(tmp_path / "segs"))
    s = spark.readStream.schema(segs.schema).parquet(str(tmp_path / "segs"))
    live.absorbed(s, str(tmp_path / "index"), 4).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "index")).where("term = 'two'").count() == 2


def test_library_says_what_is_not_built(spark):
    segs = spark.createDataFrame([(1, "w", "en", i, f"line {i}") for i in range(5)], "doc_id long, source string, lang string, line_no int, line string")
    lib = Library(segs)
    assert lib.search("line").count() == 5 and sorted(r.line_no for r in lib.read(1, 2, 1).collect()) == [1, 2, 3]
    try:
        lib.trace("w")
        raise AssertionError
    except LookupError as e:
        assert "not been built" in str(e)


def test_each_statement_has_a_query():
    from foliant import queries

    assert set(queries.SQL) <= set(queries.Q) and len(queries.Q) >= 45


def test_entry_works_without_the_training_data_part(monkeypatch):
    import __spark_entry__ as e

    real = importlib.import_module

    def without(name, *a):
        if name.startswith("foliant.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name=name.removesuffix(".queries"))
        return real(name, *a)

    monkeypatch.setattr(e, "import_module", without)
    assert "search_and" in e.queries() and not any(n.startswith("op") and n[2].isdigit() for n in e.queries()) and "pipeline" not in e.queries()
    assert set(e.oracle_sql()) <= set(e.queries())
    assert "foliant.llm" not in (sys.modules["foliant.queries"].__file__ or "")
