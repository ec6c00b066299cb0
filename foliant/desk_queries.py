"""Queries for corrections, segments, shelves, scanned words and files, and the same in DuckDB's SQL; registered beside those of ``queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as tx
from .functions.registered import register
from .operators import editing, graph, pages, search, shelf
from .plans.search_plan import read_sigils
from .queries import EDGES, SEG, edges, query, segs
from .sources import files
from .sources.tables import link_csv, link_json, table

_HELD = "held AS (SELECT l_orderkey AS segment, l_linenumber AS id, l_linenumber * 10 AS b, l_linenumber * 10 + 1 + max(l_partkey) % 9 AS e FROM lineitem GROUP BY 1, 2)"


def _held(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("segment"), F.col("l_linenumber").alias("id")).agg(F.max("l_partkey").alias("p"))
    return li.select("segment", F.col("id").cast("long").alias("id"), (F.col("id") * 10).cast("long").alias("begin"), (F.col("id") * 10 + 1 + F.col("p") % 9).cast("long").alias("end"))


@query(f"""WITH {_HELD}, a AS (SELECT o_orderkey AS segment, CASE WHEN o_orderkey % 9 = 0 THEN 1 ELSE 99 END AS id, o_custkey % 70 AS b, o_custkey % 70 + o_orderkey % 6 AS e, o_custkey % 10 = 0 AS same FROM orders)
SELECT segment, CASE WHEN b >= e THEN 'no span' WHEN same THEN 'no change' WHEN EXISTS (SELECT 1 FROM held h WHERE h.segment = a.segment AND h.id = a.id) THEN 'had'
  WHEN EXISTS (SELECT 1 FROM held h WHERE h.segment = a.segment AND h.b < a.e AND h.e > a.b) THEN 'clash' ELSE 'taken' END AS outcome FROM a""")
def patch_add(spark, d):
    o = table(spark, d, "orders")
    begin = F.col("o_custkey") % 70
    asked = o.select(F.col("o_orderkey").alias("segment"), F.when(F.col("o_orderkey") % 9 == 0, 1).otherwise(99).cast("long").alias("id"), begin.alias("begin"), (begin + F.col("o_orderkey") % 6).alias("end"),
                     F.lit("a").alias("was"), F.when(F.col("o_custkey") % 10 == 0, "a").otherwise("b").alias("now"))
    return editing.added(_held(spark, d), asked).select("segment", "outcome")


@query(f"WITH {_HELD}, a AS (SELECT o_orderkey AS segment, o_custkey % 8 AS id FROM orders WHERE o_orderkey % 2 = 0) SELECT CASE WHEN h.id IS NULL THEN 'not held' ELSE 'gone' END AS outcome, count(*) AS n FROM a LEFT JOIN held h ON h.segment = a.segment AND h.id = a.id GROUP BY 1 UNION ALL SELECT 'stays', count(*) FROM held h WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.segment = h.segment AND a.id = h.id)")
def patch_remove(spark, d):
    asked = table(spark, d, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("segment"), (F.col("o_custkey") % 8).alias("id"))
    stays, said = editing.taken_back(_held(spark, d), asked, ["segment", "id"])
    count = F.count(F.lit(1)).alias("n")
    return said.groupBy("outcome").agg(count).unionByName(stays.agg(count).select(F.lit("stays").alias("outcome"), "n"))


@query("WITH s AS (SELECT CAST(doc_id AS VARCHAR) AS id, text, CASE WHEN doc_id % 4 = 0 THEN least(doc_id % 300, length(text)) END AS c FROM documents) SELECT id, md5(text) AS text, CAST(NULL AS VARCHAR) AS \"of\" FROM s WHERE c IS NULL UNION ALL SELECT id || '.1', md5(substr(text, 1, c)), id FROM s WHERE c IS NOT NULL UNION ALL SELECT id || '.2', md5(substr(text, c + 1)), id FROM s WHERE c IS NOT NULL")
def segment_split(spark, d):
    docs = table(spark, d, "documents")
    name = F.col("doc_id").cast("string").alias("id")
    cuts = docs.where("doc_id % 4 = 0 AND text IS NOT NULL").select(name, (F.col("doc_id") % 300).cast("int").alias("at"))
    return editing.split_at(docs.select(name, "text"), cuts).select("id", F.md5("text").alias("text"), "of")


@query(f"WITH {SEG}, j AS (SELECT doc_id, line_no, line, coalesce(lag(line_no % 3 = 0) OVER (PARTITION BY doc_id ORDER BY line_no), false) AS j FROM seg), g AS (SELECT *, max(CASE WHEN NOT j THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM j) SELECT doc_id, CAST(g AS INT) AS line_no, md5(string_agg(line, '' ORDER BY line_no)) AS line, count(*) - 1 AS gone FROM g GROUP BY doc_id, g")
def segment_merge(spark, d):
    rows = editing.merged_with_next(segs(spark, d), F.col("line_no") % 3 == 0, "doc_id", "line_no", "line")
    return rows.select("doc_id", "line_no", F.md5("line").alias("line"), F.size("merged").cast("bigint").alias("gone"))


@query("""WITH w AS (SELECT s_suppkey AS slug, CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey % 3 + 100 ELSE s_nationkey END AS shelf, s_name AS rank FROM supplier), o AS (SELECT w.*, CASE WHEN slug % 4 = 1 THEN slug % 7 END AS no FROM w)
SELECT slug, CAST(shelf AS BIGINT) AS shelf, CAST(row_number() OVER (PARTITION BY shelf ORDER BY no NULLS LAST, rank, slug) AS INT) AS place FROM o""")
def user_arrangement(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("slug"), F.col("s_nationkey").cast("long").alias("shelf"), F.col("s_name").alias("rank"))
    moves = s.where("slug % 5 = 0").select("slug", (F.col("slug") % 3 + 100).alias("shelf"))
    order = s.where("slug % 4 = 1").select(F.when(F.col("slug") % 5 == 0, F.col("slug") % 3 + 100).otherwise(F.col("shelf")).alias("shelf"), "slug", (F.col("slug") % 7).alias("no"))
    return editing.arranged(s, moves, order)


_PRINTED, _COMMON = ["שלום", "מלך", "דָבר", "ספר", "אין"], ["שלומ", "מלכ", "דבר", "ספרימ", "אבנ"]


@query(f"WITH w AS (SELECT p_partkey, {_PRINTED}[p_partkey % 5 + 1] AS printed, {_COMMON}[p_partkey % 3 + 1] AS common FROM part) SELECT p_partkey, CASE WHEN contains(printed, 'ָ') THEN NULL WHEN right(printed, 1) IN ('ך', 'ם', 'ן', 'ף', 'ץ') THEN left(common, length(common) - 1) || translate(right(common, 1), 'כמנפצ', 'ךםןףץ') ELSE common END AS suggestion FROM w")
def typographic_suggestion(spark, d):
    pick = lambda words, n: F.get(F.array(*map(F.lit, words)), (F.col("p_partkey") % n).cast("int"))
    return table(spark, d, "part").select("p_partkey", editing.suggested(pick(_PRINTED, 5), pick(_COMMON, 3)).alias("suggestion"))


@query("SELECT doc_id, CASE WHEN length(text) > 90 THEN left(text, 90) || '…' ELSE text END AS opening, trim(regexp_replace(lower(left(text, 40)), '[^\\p{L}\\p{N}]+', '-', 'g'), '-') AS slug FROM documents")
def openings_and_slugs(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.opening(F.col("text")).alias("opening"), tx.slug(F.left("text", F.lit(40))).alias("slug"))


@query("SELECT o_orderkey AS id, o_custkey % 50 AS from_ord FROM orders WHERE o_custkey % 10 = 3 AND (o_orderkey % 11 = 0 OR (o_custkey % 50 <= 20 AND o_custkey % 50 + o_orderkey % 5 >= 10)) AND o_orderkey % 4 = 1")
def notes_on(spark, d):
    """Notes that touch the places 10 to 20 of a work, or are about all of it, with a tag."""
    at = F.col("o_custkey") % 50
    notes = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 10).alias("work"), at.alias("o"), F.when(F.col("o_orderkey") % 11 != 0, at).alias("from_ord"),
                                             (at + F.col("o_orderkey") % 5).alias("to_ord"), F.array((F.col("o_orderkey") % 4).cast("string")).alias("tags"))
    return editing.on_place(notes, 3, 10, 20).where(F.array_contains("tags", "1")).select("id", F.col("o").alias("from_ord"))


@query("SELECT 'note' AS kind, o_orderkey AS id, o_custkey % 50 AS from_ord FROM orders WHERE o_custkey % 10 = 3 AND o_custkey % 50 BETWEEN 10 AND 20 UNION ALL SELECT 'mark', event_id, user_id % 40 FROM events WHERE user_id % 10 = 3 AND user_id % 40 <= 20 AND user_id % 40 + 2 >= 10 UNION ALL SELECT 'correction', doc_id, NULL FROM labels WHERE doc_id % 10 = 3")
def yours_on_place(spark, d):
    none = F.lit(None).cast("long")
    notes = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 10).alias("work"), (F.col("o_custkey") % 50).alias("from_ord"), none.alias("to_ord"))
    marks = table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 10).alias("work"), (F.col("user_id") % 40).alias("from_ord"), (F.col("user_id") % 40 + 2).alias("to_ord"))
    fixes = table(spark, d, "labels").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 10).alias("work"), none.alias("from_ord"), none.alias("to_ord"))
    return editing.everything_on({"note": notes, "mark": marks, "correction": fixes}, 3, 10, 20)


@query("SELECT shelf, depth, count(*) AS works FROM (SELECT p_type AS shelf, 1 AS depth FROM part UNION ALL SELECT p_type || '/' || p_brand, 2 FROM part UNION ALL SELECT p_type || '/' || p_brand || '/' || p_size, 3 FROM part) GROUP BY 1, 2")
def shelf_tree(spark, d):
    return editing.tree(table(spark, d, "part"), F.concat_ws("/", "p_type", "p_brand", "p_size"))


@query("WITH p AS (SELECT p_partkey, p_type || CASE WHEN p_partkey % 3 = 0 THEN 'S' ELSE '' END || '/' || p_brand AS shelf FROM part) SELECT p_partkey FROM p WHERE shelf = 'PROMO' OR starts_with(shelf, 'PROMO/')")
def works_under(spark, d):
    shelf = F.concat(F.col("p_type"), F.when(F.col("p_partkey") % 3 == 0, "S").otherwise(""), F.lit("/"), F.col("p_brand"))
    return editing.under(table(spark, d, "part").withColumn("shelf", shelf), F.col("shelf"), "PROMO").select("p_partkey")


@query("SELECT o_orderkey, CASE WHEN s_name IS NULL THEN (o_custkey % 150) || '#' || (o_custkey % 9) || ':' || (o_orderkey % 30) ELSE s_name || ' ' || (o_custkey % 9) || ' ' || (o_orderkey % 30) END AS printed FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey % 150")
def display_names(spark, d):
    ids = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 150).alias("work"), F.array((F.col("o_custkey") % 9).cast("string"), (F.col("o_orderkey") % 30).cast("string")).alias("path"))
    return editing.printed_names(ids, table(spark, d, "supplier").select(F.col("s_suppkey").alias("work"), F.col("s_name").alias("title"))).select("o_orderkey", "printed")


@query(f"WITH {SEG} SELECT source AS work, count(*) FILTER (WHERE trim(line) <> '') AS lines, CAST(sum(CASE WHEN line_no = 0 THEN 1 ELSE 0 END) AS BIGINT) AS applied, CAST(0 AS BIGINT) AS stale, count(*) FILTER (WHERE trim(line) <> '') AS written FROM seg GROUP BY source")
def export_text(spark, d):
    """Lines of works as text files, blank ones dropped, and what is read from them again."""
    at = graph.shared(spark, "export")
    rows = segs(spark, d).select(F.col("source").alias("work"), F.struct("doc_id", "line_no").alias("ord"), F.col("line").alias("text"), F.when(F.col("line_no") == 0, 1).otherwise(0).alias("applied"), F.lit(0).alias("stale"))
    said = editing.exported(rows, at, "work")
    return said.join(spark.read.schema("value string, work string").text(at).groupBy("work").agg(F.count(F.lit(1)).alias("written")), "work", "left")


# Words on pages ----------------------------------------------------------------------------------------------------------------------------

_WORDS = "w AS (SELECT l_orderkey * 8 + l_linenumber AS word, l_orderkey AS page, (max(l_partkey) % 50)::DOUBLE AS x0, (l_linenumber * 20)::DOUBLE AS y0, (max(l_partkey) % 50 + 4 + max(l_suppkey) % 6)::DOUBLE AS x1, (l_linenumber * 20 + 14)::DOUBLE AS y1 FROM lineitem GROUP BY l_orderkey, l_linenumber)"


def _words(spark, d, per_line=1):
    """Words of pages: a page is an order, a line ``per_line`` of its numbers."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"), F.max("l_suppkey").alias("s"))
    top = F.floor(F.col("l_linenumber") / per_line) * 20
    x0 = F.col("p") % 50
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("word"), F.col("l_orderkey").alias("page"), *(c.cast("double").alias(n) for n, c in (("x0", x0), ("y0", top), ("x1", x0 + 4 + F.col("s") % 6), ("y1", top + 14))))


@query(f"WITH {_WORDS}, m AS (SELECT o_orderkey AS page, o_orderkey AS mark, (o_custkey % 40)::DOUBLE AS a, 15::DOUBLE AS b, (o_custkey % 40 + 20)::DOUBLE AS c, 72::DOUBLE AS d FROM orders) SELECT w.page, mark, word FROM w JOIN m USING (page) WHERE greatest(least(x1, c) - greatest(x0, a), 0) * greatest(least(y1, d) - greatest(y0, b), 0) >= 0.6 * (x1 - x0) * (y1 - y0)")
def words_under_mark(spark, d):
    x = F.col("o_custkey") % 40
    marks = table(spark, d, "orders").select(F.col("o_orderkey").alias("page"), F.col("o_orderkey").alias("mark"), x.cast("double").alias("x0"), F.lit(15.0).alias("y0"), (x + 20).cast("double").alias("x1"), F.lit(72.0).alias("y1"))
    return pages.words_under(_words(spark, d), marks, "page")


@query("WITH w AS (SELECT l_orderkey AS page, l_linenumber // 3 AS l, max(l_partkey) % 50 AS x0, max(l_partkey) % 50 + 4 + max(l_suppkey) % 6 AS x1 FROM lineitem GROUP BY l_orderkey, l_linenumber) SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY l) - 1 AS INT) AS line, min(x0)::DOUBLE AS x0, (l * 20)::DOUBLE AS y0, max(x1)::DOUBLE AS x1, (l * 20 + 14)::DOUBLE AS y1, CAST(count(*) AS INT) AS words FROM w GROUP BY page, l")
def ink_lines(spark, d):
    return pages.ink_of(_words(spark, d, 3), "page")


@query(f"WITH {SEG}, c AS (SELECT doc_id, CAST(line_no AS INT) AS line_no, line, regexp_extract(substr(line, 1, 12), '[\\p{{L}}\\p{{N}}]*$') AS a, regexp_extract(substr(line, 13), '^[\\p{{L}}\\p{{N}}]*') AS b FROM seg WHERE length(line) > 12) SELECT doc_id, line_no, CAST(12 - length(a) AS INT) AS \"begin\", CAST(12 + length(b) AS INT) AS \"end\", a || b AS word FROM c WHERE b <> ''")
def word_at_click(spark, d):
    return segs(spark, d).select("doc_id", "line_no", pages.word_at(F.col("line"), F.lit(12)).alias("w")).where("w IS NOT NULL").select("doc_id", "line_no", "w.*")


# Files -------------------------------------------------------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(text, '. ', '.' || chr(10) || chr(10)) ELSE text END AS text FROM documents), p AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ps FROM t),
q AS (SELECT doc_id, CASE WHEN len(ps) > 1 THEN list_transform(ps, lambda p: array_to_string(list_transform(string_split(p, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), ' ')) ELSE list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') END AS ps FROM p)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'utf-16' ELSE 'utf-8' END AS encoding, len(ps) AS n, md5(array_to_string(ps, '|')) AS text FROM q""")
def user_files(spark, d):
    """Texts as files in two encodings, read as paragraphs."""
    text = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit(". "), F.lit(".\n\n"))).otherwise(F.col("text"))
    data = F.when(F.col("doc_id") % 3 == 0, F.concat(F.unhex(F.lit("FFFE")), F.encode(text, "UTF-16LE"))).otherwise(F.encode(text, "UTF-8"))
    rows = table(spark, d, "documents").select("doc_id", files.decoded(data).alias("d")).select("doc_id", "d.encoding", files.paragraphs(F.col("d.text")).alias("ps"))
    return rows.select("doc_id", "encoding", F.size("ps").cast("bigint").alias("n"), F.md5(F.array_join("ps", "|")).alias("text"))


@query("SELECT page_id, CASE WHEN regexp_matches(html, '(?i)<h[1-6][^>]*>') THEN 'headed' ELSE 'addressed' END AS kind FROM pages")
def library_dispatch(spark, d):
    return table(spark, d, "pages").select("page_id", F.when(files.has_headings(F.col("html")), "headed").otherwise("addressed").alias("kind"))


@query(r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), a AS (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM l), b AS (SELECT doc_id, i, regexp_replace(ls[i + 1], '^\s+|\s+$', '', 'g') AS x FROM a),
k AS (SELECT doc_id, i, x, (i % 7 = 2 AND x <> '') OR (i % 11 = 4) AS said, i + 1 + i // 11 + CASE WHEN i % 11 > 4 THEN 1 ELSE 0 END AS n FROM b),
h AS (SELECT doc_id, n, x, said AND length(x) BETWEEN 1 AND 120 AS h FROM k WHERE x <> '' OR i % 7 = -1), s AS (SELECT *, max(CASE WHEN h THEN n END) OVER (PARTITION BY doc_id ORDER BY n) AS at FROM h),
f AS (SELECT s.doc_id, s.n, s.x, s.h, s.at, count(*) FILTER (WHERE NOT s.h) OVER (PARTITION BY s.doc_id, s.at ORDER BY s.n) AS no FROM s)
SELECT f.doc_id, CAST(f.n AS INT) AS line_no, CASE WHEN f.h THEN 'heading' ELSE 'text' END AS kind, coalesce(g.x, '0') AS section, CASE WHEN NOT f.h THEN f.no END AS no, f.x AS text FROM f LEFT JOIN s g ON g.doc_id = f.doc_id AND g.n = f.at""")
def address_lines(spark, d):
    """Every seventh line of a text as a header with a sign, every eleventh with a rule under it; long ones are no headers."""
    line = lambda x, i: F.when((i % 7 == 2) & (F.trim(x) != ""), F.concat(F.lit("@ "), x)).otherwise(x)
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.concat(line(x, i), F.when(i % 11 == 4, F.lit("\n=====")).otherwise("")))
    return files.address_lines(table(spark, d, "documents").select("doc_id", F.array_join(lines, "\n").alias("body")), "doc_id", "body")


@query("SELECT l_orderkey || ':' || l_linenumber AS citation_1, 'p\"' || l_partkey || '\", ' || l_suppkey AS citation_2, CASE WHEN l_returnflag = 'A' THEN 'commentary' END AS label, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
def link_csv_rows(spark, d):
    """Links as a file with quoted fields, read again."""
    at, none = graph.shared(spark, "links"), F.lit(None).cast("string")
    li = table(spark, d, "lineitem").select(
        F.concat_ws(":", "l_orderkey", "l_linenumber").alias("Citation 1"), F.concat(F.lit('p"'), "l_partkey", F.lit('", '), "l_suppkey").alias("Citation 2"), F.when(F.col("l_returnflag") == "A", "commentary").alias("Conection Type"),
        none.alias("Text 1"), none.alias("Text 2"), none.alias("Category 1"), none.alias("Category 2"))
    li.write.csv(at, header=True, quote='"', escape='"')
    return link_csv(spark, at).groupBy("citation_1", "citation_2", "label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source AS work, doc_id AS ord, CASE WHEN source = (SELECT min(source) FROM documents) THEN md5('now ' || left(text, 50)) ELSE md5(text) END AS text FROM documents WHERE source IS NOT NULL")
def segment_store(spark, d):
    """Segments by work, one of which is written again."""
    at, docs = graph.shared(spark, "segments"), table(spark, d, "documents").where("source IS NOT NULL").select(F.col("source").alias("work"), F.col("doc_id").alias("ord"), "text")
    files.write_segments(docs, at)
    one = docs.agg(F.min("work").alias("w")).head()["w"]  # one name
    files.write_segments(docs.where(F.col("work") == one).withColumn("text", F.concat(F.lit("now "), F.left("text", F.lit(50)))), at)
    return files.read_segments(spark, at).select("work", "ord", F.md5("text").alias("text"))


@query(f"WITH {EDGES} SELECT edge_no, edge_type, count(*) AS n FROM e WHERE src_work = 's7' GROUP BY 1, 2")
def edge_shards(spark, d):
    at = graph.shared(spark, "edges")
    files.write_edges(edges(spark, d).select("edge_no", "src_work", "edge_type"), at, "src_work")
    return files.read_edges(spark, at, "src_work", "s7").groupBy("edge_no", "edge_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT vec_id AS id, CAST(CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END AS INT) AS seq, round(CASE WHEN vec_id % 3 = 0 THEN embedding[2] ELSE embedding[1] END::DOUBLE, 6) AS first FROM embeddings WHERE vec_id % 5 <> 0 AND embedding IS NOT NULL")
def vector_store(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit(1).alias("seq"), F.when(F.col("vec_id") % 5 == 0, "old").otherwise("m").alias("model"), F.col("embedding").alias("vector"))
    again = e.where("id % 3 = 0").withColumn("seq", F.lit(2)).withColumn("vector", F.slice("vector", 2, 1000))
    return files.newest_vectors(e.unionByName(again), "m").select("id", "seq", F.round(F.get("vector", F.lit(0)).cast("double"), 6).alias("first"))


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'own ' || c_custkey ELSE c_name END AS name FROM customer WHERE (c_custkey % 2 = 0 OR c_custkey % 3 = 0) AND c_custkey % 7 <> 0")
def catalogue_put_remove(spark, d):
    c = table(spark, d, "customer").withColumnRenamed("c_custkey", "k")
    put = c.where("k % 3 = 0").select("k", F.concat(F.lit("own "), "k").alias("name"))
    return files.catalogued(c.where("k % 2 = 0").select("k", F.col("c_name").alias("name")), put, c.where("k % 7 = 0"), "k")


@query(f"WITH {SEG}, {EDGES} SELECT count(DISTINCT source) AS works, count(*) AS segments, (SELECT count(DISTINCT edge_type) FROM e) AS link_types, 'rebuild' AS state FROM seg")
def build_report(spark, d):
    return files.stamp(segs(spark, d).withColumnRenamed("source", "work"), edges(spark, d), 2, 1)


@query("WITH g AS (SELECT DISTINCT l_orderkey AS page, l_linenumber AS n FROM lineitem), o AS (SELECT page, n, bool_or(l_partkey % 5 = 0) AS refused FROM g JOIN lineitem ON l_orderkey = page AND l_linenumber = n GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY n) - 1 AS line FROM o), w AS (SELECT *, unnest([0, 1]) AS k FROM p) SELECT page, CAST(2 * line + k AS INT) AS no, CAST(line AS INT) AS line, CASE WHEN k = 0 THEN 'אבג' ELSE '123' END AS text, CASE WHEN k = 0 THEN 40 ELSE 20 END::DOUBLE AS x0, CASE WHEN k = 0 THEN 54 ELSE 32 END::DOUBLE AS x1, refused FROM w")
def glyph_words(spark, d):
    """A Hebrew word and a number on each line, glyph by glyph; every fifth line has a glyph that could not be named."""
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("n")).agg(F.bool_or(F.col("l_partkey") % 5 == 0).alias("odd"))
    each = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(c).alias("c"), F.lit(float(x)).alias("x")) for i, (c, x) in enumerate((("1", 20), ("א", 50), ("3", 28), ("ב", 45), ("2", 24), ("ג", 40), ("\x10", 33)))))
    g = li.select("page", "n", "odd", F.explode(each).alias("g"))
    text = F.when(F.col("odd") & (F.col("g.i") == 3), F.concat("g.c", F.lit("\x0e"))).otherwise(F.col("g.c"))
    glyphs = g.select("page", (F.col("n") * 10 + F.col("g.i")).alias("no"), text.alias("text"), F.col("g.x").alias("x0"), (F.col("n") * 20).alias("y0"), (F.col("g.x") + 4).alias("x1"), (F.col("n") * 20 + 10).alias("y1"))
    return pages.grouped_words(glyphs, "page").drop("y0", "y1")


@query("WITH w AS (SELECT l_orderkey * 8 + l_linenumber AS word, l_orderkey AS page, max(l_partkey) % 50 AS x, l_linenumber * 20 AS y, max(l_partkey) % 3 AS t FROM lineitem GROUP BY l_orderkey, l_linenumber), f AS (SELECT o_orderkey AS page, o_custkey % 40 AS x FROM orders) SELECT f.page FROM f WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.page = f.page AND w.t = 1 AND w.y = 20 AND least(w.x + 6, f.x + 20) - greatest(w.x, f.x) >= 0.6 * 6)")
def stranded_fixes(spark, d):
    """Fixes of the word t1 in a strip of the first line, most of which must be under the strip."""
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("n")).agg((F.max("l_partkey") % 150).alias("p"))
    x, y = F.col("p") % 50, F.col("n") * 20
    words = li.select("page", (F.col("page") * 8 + F.col("n")).alias("word"), F.concat(F.lit("t"), F.col("p") % 3).alias("text"), x.alias("x0"), y.alias("y0"), (x + 6).alias("x1"), (y + 14).alias("y1"))
    c = F.col("o_custkey") % 40
    fixes = table(spark, d, "orders").select(F.col("o_orderkey").alias("page"), F.lit("f").alias("mark"), F.lit("t1").alias("was"), c.alias("x0"), F.lit(20).alias("y0"), (c + 20).alias("x1"), F.lit(34).alias("y1"))
    whole = words.withColumn("x0", F.col("x0").cast("double")).withColumn("x1", F.col("x1").cast("double"))
    return pages.stranded(fixes, whole, "page").select("page")


@query("SELECT page_id FROM pages WHERE page_id % 3 <> 0 OR page_id % 2 = 0")
def scan_pages_left(spark, d):
    p = table(spark, d, "pages")
    read = p.where("page_id % 3 = 0").select("page_id", F.when(F.col("page_id") % 2 == 0, "other").otherwise("e1").alias("engine"))
    return pages.pages_left(p, read, "page_id", "e1").select("page_id")


@query("SELECT role, count(*) FILTER (WHERE regexp_matches(text, '[?؟]') OR list_contains(" + str(tx.ASKING) + ", lower(regexp_extract(text, '[\\p{L}\\p{N}]+')))) AS questions, count(*) AS n FROM conversations GROUP BY role")
def questions(spark, d):
    return table(spark, d, "conversations").groupBy("role").agg(F.count_if(tx.is_question(F.col("text"))).alias("questions"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {SEG} SELECT source, count(*) AS hits FROM seg WHERE list_contains(w, 'was') AND lang IS DISTINCT FROM 'de' GROUP BY source")
def facet_exclude(spark, d):
    """A search without one row of a facet."""
    row = table(spark, d, "documents").where("lang = 'de'").select("doc_id")
    return search.totals(search.scoped(search.hits(segs(spark, d), read_sigils("was")), without=[row]))


@query("SELECT 'note' AS kind, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS ids FROM orders WHERE o_custkey % 5 = 0 UNION ALL SELECT 'query', count(*), CAST(sum(event_id) AS BIGINT) FROM events WHERE event_id % 7 = 0")
def layer_export(spark, d):
    """Records of two kinds written as JSON and read again."""
    at = graph.shared(spark, "layers")
    notes = table(spark, d, "orders").where("o_custkey % 5 = 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("said"))
    asked = table(spark, d, "events").where("event_id % 7 = 0").select(F.col("event_id").alias("id"), F.col("props").alias("said"))
    editing.layers_out({"note": notes, "query": asked}, at)
    return editing.layers_in(spark, at, "id bigint, said string")[0].groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' OR o_orderstatus = '1-URGENT'")
def saved_by_tag(spark, d):
    saved = table(spark, d, "orders").select("o_orderkey", F.array("o_orderpriority", "o_orderstatus").alias("tags"))
    return saved.where(F.array_contains("tags", "1-URGENT")).select("o_orderkey")


@query(f"WITH {EDGES}, c AS (SELECT DISTINCT src_work FROM e WHERE edge_type = 'comments-on' AND dst_work = 'p1'), w AS (SELECT s_nationkey % 5 AS a, s_nationkey AS b FROM c JOIN supplier ON 's' || s_suppkey = src_work) SELECT 'a' || a AS shelf, 1 AS depth, count(*) AS works FROM w GROUP BY a UNION ALL SELECT 'a' || a || '/' || b, 2, count(*) FROM w GROUP BY a, b")
def commentator_folders(spark, d):
    works = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("work"), F.concat(F.lit("a"), F.col("s_nationkey") % 5, F.lit("/"), "s_nationkey").alias("shelf"))
    return editing.folders(edges(spark, d), "p1", works)


@query(f"WITH {EDGES}, n AS (SELECT src_work AS work, count(*) AS n FROM e WHERE dst_work = 'p3' GROUP BY 1), c AS (SELECT 's' || s_suppkey AS work FROM supplier WHERE s_suppkey % 6 = 0), b AS (SELECT coalesce(n.work, c.work) AS work, c.work IS NOT NULL AS declared, coalesce(n, 0) AS n FROM n FULL JOIN c ON n.work = c.work) SELECT work, declared, n, CAST(row_number() OVER (ORDER BY declared DESC, n DESC, work) AS INT) AS place FROM b ORDER BY place LIMIT 50")
def companions_listed(spark, d):
    n = edges(spark, d).where("dst_work = 'p3'").groupBy(F.col("src_work").alias("work")).agg(F.count(F.lit(1)).alias("n"))
    declared = table(spark, d, "supplier").where("s_suppkey % 6 = 0").select(F.concat(F.lit("s"), "s_suppkey").alias("work"))
    return shelf.placed(editing.companions(declared, n), F.desc("declared"), F.desc("n"), F.col("work"), most=50)


@query("SELECT s_name AS name, 'n' || s_nationkey AS origin, CASE s_suppkey % 4 WHEN 1 THEN 'CC-BY' WHEN 2 THEN 'PD' END AS licence FROM supplier")
def library_provenance(spark, d):
    at = graph.shared(spark, "provenance")
    k = F.col("s_suppkey") % 4
    table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.concat(F.lit("n"), "s_nationkey").alias("origin"), F.when(k == 0, "Unknown ").when(k == 1, " CC-BY").when(k == 2, "PD").alias("licence")).write.json(at)
    return files.library_metadata(spark, at)


@query("SELECT n_nationkey::BIGINT AS line_index_1, n_name AS path_2, (n_nationkey * 3 + i)::BIGINT AS line_index_2, CASE WHEN i = 0 THEN 'commentary' END AS label FROM nation, (SELECT unnest([0, 1]) AS i)")
def link_json_rows(spark, d):
    """Links as files that are one array each, read again; the nations are a table of fixed size."""
    at = graph.shared(spark, "links")
    one = lambda i: F.struct(F.col("n_nationkey").cast("bigint").alias("line_index_1"), F.col("n_name").alias("path_2"), (F.col("n_nationkey") * 3 + i).alias("line_index_2"), F.lit("commentary" if i == 0 else None).cast("string").alias("Conection Type"))
    table(spark, d, "nation").select("n_nationkey", F.to_json(F.array(one(0), one(1)), {"pretty": "true"}).alias("value")).write.partitionBy("n_nationkey").text(at)
    return link_json(spark, f"{at}/*").select("line_index_1", "path_2", "line_index_2", F.col("Conection Type").alias("label"))


@query("WITH p AS (SELECT p_partkey, lower(p_name) AS name, string_split(lower(p_name), ' ') AS w FROM part), x AS (SELECT p_partkey, w, unnest(range(len(w))) AS no FROM p) SELECT p_partkey, CAST(no AS INT) AS no, w[no + 1] AS word, translate(w[no + 1], 'abcdefghijklmnopqrstuvwxyz', 'zyxwvutsrqponmlkjihgfedcba') AS mirror, CAST(list_sum(list_transform(string_split(w[no + 1], ''), lambda c: ascii(c) - 96)) AS BIGINT) AS value FROM x WHERE regexp_matches(w[no + 1], '^[a-z]+$')")
def sql_functions(spark, d):
    """The registered functions in a statement of Spark's SQL."""
    register(spark)
    return spark.sql("SELECT p_partkey, no, word, foliant_mirrored(word) AS mirror, foliant_letter_value(word) AS value FROM {part} p, LATERAL foliant_words(p.p_name) WHERE word RLIKE '^[a-z]+$'", part=table(spark, d, "part"))
