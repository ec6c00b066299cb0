"""More queries for operators on the driver's tables, and the same in DuckDB's SQL; registered beside those of ``queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import calendar as cal
from .functions import text as tx
from .operators import desk, graph, index, records, search, shelf
from .plans.search_plan import SearchPlan, read_sigils
from .queries import EDGES, SEG, SQL, _plan, _works, edges, query, segs
from .sources.tables import catalogue_union, nested_json, table

# Index -----------------------------------------------------------------------------------------------------------------------------------


_built: dict[tuple[str, str], str] = {}


def _index(spark, d, fresh=False):
    """An index of all lines in two batches, built once a session; the second batch is written twice, as a replay would."""
    key = spark.sparkContext.applicationId, d
    if fresh or key not in _built:
        at, all_ = graph.shared(spark, "index"), segs(spark, d)
        index.write(all_.where("doc_id % 2 = 0"), at, "0", 16)
        for _ in range(2):
            index.write(all_.where("doc_id % 2 = 1"), at, "1", 16)
        if fresh:
            return at
        _built[key] = at
    return _built[key]


def _found(spark, d, plan):
    return search.totals(index.search(spark, _index(spark, d), plan, 16, broad=True).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id"))


@query(SQL["search_and"])
def index_and(spark, d):
    return _found(spark, d, read_sigils("the that"))


@query(SQL["search_phrase"])
def index_phrase(spark, d):
    return _found(spark, d, read_sigils('"of the"'))


@query(SQL["search_near"])
def index_near(spark, d):
    return _found(spark, d, read_sigils("~3 is that"))


@query(SQL["search_contains"])
def index_contains(spark, d):
    return _found(spark, d, read_sigils("*keit*"))


@query(SQL["search_alternatives"])
def index_alternatives(spark, d):
    return _found(spark, d, SearchPlan((("that", "est"), ("of", "la"))))


@query(f"WITH {SEG} SELECT source, count(*) AS hits FROM seg WHERE list_contains(w, 'that') AND doc_id % 3 <> 0 GROUP BY source")
def index_forget(spark, d):
    """What is forgotten is not found, and what is written again afterwards is."""
    at, docs = _index(spark, d, fresh=True), table(spark, d, "documents")
    index.forget(docs.where("doc_id % 3 < 2"), at, "1")
    index.write(segs(spark, d).where("doc_id % 3 = 1"), at, "2", 16)
    return search.totals(index.search(spark, at, read_sigils("that"), 16).join(docs.select("doc_id", "source"), "doc_id"))


@query("SELECT CASE WHEN count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-20 00:00:00') > 0 THEN 'behind' ELSE 'fresh' END AS state, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-20 00:00:00') AS newer FROM events")
def index_freshness(spark, d):
    return index.freshness(table(spark, d, "events"), "ts", "2024-01-20 00:00:00")


# Search ----------------------------------------------------------------------------------------------------------------------------------


@query(_plan("(list_contains(w, 'the') OR list_contains(w, 'der') OR list_contains(w, 'les')) AND (list_contains(w, 'and') OR list_contains(w, 'und'))"))
def search_widened(spark, d):
    words = shelf.variants_of(["the", "and"], {"the": ["der", "les"], "and": ["und"]})
    return search.totals(search.hits(segs(spark, d), SearchPlan(words)))


@query(_plan("len(list_filter(w, lambda x: regexp_matches(x, '^[ander]{1,4}ing$'))) > 0"))
def search_particles(spark, d):
    """A word after one to four letters of a set."""
    return search.totals(search.hits(segs(spark, d), SearchPlan((("ing",),), match="prefix", particles="ander")))


@query(f"""WITH {SEG} SELECT source, count(*) AS hits FROM seg WHERE regexp_matches(line, '(?i)(^|[^\\p{{L}}\\p{{N}}])d[''"’”]?e[''"’”]?s([^\\p{{L}}\\p{{N}}]|$)') GROUP BY source""")
def search_punctuated(spark, d):
    return search.totals(segs(spark, d).where(F.col("line").rlike(shelf.punctuated("des"))))


_SPANS = """g AS (SELECT doc_id, CAST(line_no AS INT) AS line_no, regexp_extract_all(line, '[\\p{L}\\p{N}]+') AS ws, regexp_split_to_array(line, '[\\p{L}\\p{N}]+') AS gs FROM seg),
p AS (SELECT doc_id, line_no, ws, gs, unnest(range(len(ws))) AS k FROM g),
e AS (SELECT doc_id, line_no, lower(ws[k + 1]) AS word, length(ws[k + 1]) AS n, list_sum(list_transform(ws[1:k + 1], lambda x: length(x))) + list_sum(list_transform(gs[1:k + 1], lambda x: length(x))) AS e FROM p)"""


@query(f"WITH {SEG}, {_SPANS} SELECT doc_id, line_no, CAST(e - n AS INT) AS \"begin\", CAST(e AS INT) AS \"end\" FROM e WHERE word IN ('was', 'las')")
def highlight_spans(spark, d):
    spans = shelf.highlights(F.col("line"), lambda w: w.isin("was", "las"))
    gated = segs(spark, d).where(F.lower("line").rlike("was|las"))
    return gated.select("doc_id", "line_no", F.explode(spans).alias("s")).select("doc_id", "line_no", "s.begin", "s.end")


@query(f"WITH {SEG}, p AS (SELECT doc_id, CAST(line_no AS INT) AS line_no, string_split(lower(line), 'ation') AS ps FROM seg WHERE contains(lower(line), 'ation')), q AS (SELECT *, unnest(range(1, len(ps))) AS k FROM p) SELECT doc_id, line_no, CAST(list_sum(list_transform(ps[1:k], lambda x: length(x))) + (k - 1) * 5 AS INT) AS at FROM q")
def in_work_find(spark, d):
    rows = segs(spark, d).where(F.contains(F.lower("line"), F.lit("ation")))
    return rows.select("doc_id", "line_no", F.explode(shelf.occurrences(F.col("line"), "ation")).alias("at"))


@query(f"WITH {SEG}, t AS (SELECT DISTINCT unnest(w) AS term FROM seg) SELECT term FROM t WHERE regexp_matches(term, '^[a-z]+$') AND list_sum(list_transform(string_split(term, ''), lambda c: ascii(c) - 96)) = 52")
def words_worth(spark, d):
    words = search.vocabulary(segs(spark, d)).where(F.col("term").rlike("^[a-z]+$"))
    return words.where(tx.letter_value(F.col("term")) == 52).select("term")


@query("WITH t AS (SELECT doc_id, source, text, CASE WHEN text = 'x' THEN text WHEN doc_id % 3 = 0 THEN 'zzcorrected ' || text WHEN doc_id % 3 = 1 THEN 'yycorrected ' || text ELSE text END AS now, CASE WHEN doc_id % 3 = 0 THEN 0 WHEN doc_id % 3 = 1 THEN 1 ELSE 0 END AS stale FROM documents) SELECT source, count(*) FILTER (WHERE starts_with(now, 'zzcorrected')) AS first, count(*) FILTER (WHERE starts_with(now, 'yycorrected')) AS second, CAST(sum(stale) AS BIGINT) AS stale FROM t GROUP BY source")
def corrected_index(spark, d):
    """Of two layers the first that applies; the first is stale where its text is another."""
    docs = table(spark, d, "documents")
    one = docs.where("doc_id % 3 < 2").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat("text", F.lit("?"))).alias("was"), F.concat(F.lit("zzcorrected "), "text").alias("now"))
    two = docs.where("doc_id % 3 < 2").select("doc_id", F.col("text").alias("was"), F.concat(F.lit("yycorrected "), "text").alias("now")).where("doc_id % 3 = 1")
    out = shelf.corrected(docs.select("doc_id", "text"), [one, two], "doc_id").join(docs.select("doc_id", "source"), "doc_id")
    return out.groupBy("source").agg(F.count_if(F.startswith("text", F.lit("zzcorrected"))).alias("first"), F.count_if(F.startswith("text", F.lit("yycorrected"))).alias("second"), F.sum("stale").alias("stale"))


@query("SELECT count(DISTINCT source) AS works, count(*) AS documents, CAST(sum(len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> ''))) AS BIGINT) AS segments, CAST(sum(len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: starts_with(x, '#')))) AS BIGINT) AS headings, count(*) FILTER (WHERE text = '') AS empty, count(*) FILTER (WHERE text IS NULL) AS missing FROM documents")
def corpus_counts(spark, d):
    return shelf.corpus_counts(table(spark, d, "documents"))


@query(f"WITH {SEG}, n AS (SELECT source, count(*) AS n FROM seg WHERE list_contains(w, 'was') GROUP BY source) SELECT source AS key, n, CAST(row_number() OVER (ORDER BY n DESC, source) AS INT) AS place FROM n")
def facet_order(spark, d):
    n = search.totals(search.hits(segs(spark, d), read_sigils("was"))).select(F.col("source").alias("key"), F.col("hits").alias("n"))
    return shelf.placed(n, *shelf.facet_order(F.col("n"), F.lit(1), F.col("key")))


@query(f"WITH {SEG}, h AS (SELECT doc_id, line_no FROM seg WHERE list_contains(w, 'was')), li AS (SELECT DISTINCT l_orderkey % 1000 AS doc_id, l_linenumber - 1 AS line_no, CASE l_returnflag WHEN 'A' THEN 'comments-on' WHEN 'N' THEN 'quotes' ELSE 'references' END AS edge_type FROM lineitem) SELECT edge_type, count(*) AS n FROM h JOIN li USING (doc_id, line_no) GROUP BY edge_type")
def facet_links(spark, d):
    """Segments by the types of the links that touch them; a segment with two types counts under both, with two links of one type once."""
    touch = table(spark, d, "lineitem").select((F.col("l_orderkey") % 1000).alias("doc_id"), (F.col("l_linenumber") - 1).alias("line_no"), tx.edge_type(F.when(F.col("l_returnflag") == "A", "commentary").when(F.col("l_returnflag") == "N", "quotation").otherwise("see")).alias("edge_type")).distinct()
    found = search.hits(segs(spark, d), read_sigils("was"))
    return found.join(touch, ["doc_id", "line_no"]).groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"))


# Links -----------------------------------------------------------------------------------------------------------------------------------


@query(f"WITH {EDGES}, t AS (SELECT src_work AS work, src_ord AS ord, CAST(bit_or(CASE edge_type WHEN 'comments-on' THEN 1 WHEN 'quotes' THEN 2 ELSE 8 END) AS INT) AS mask FROM e WHERE l_quantity > 25 GROUP BY 1, 2) SELECT * FROM t WHERE mask & 9 <> 0 AND mask & 2 = 0")
def link_types(spark, d):
    """Places with a comment or a reference, and without a quotation."""
    spans = edges(spark, d).where("l_quantity > 25").select(F.col("src_work").alias("work"), F.col("src_ord").alias("from_ord"), F.lit(None).cast("int").alias("to_ord"), "edge_type")
    return shelf.typed_links(graph.masks(spans), graph.TYPES, ["comments-on", "references"], ["quotes"])


@query(f"WITH {EDGES}, c AS (SELECT edge_no, src_work, src_ord, edge_type, round((CASE method WHEN 'cited' THEN 0.9 ELSE 0.7 END) - (CASE WHEN directed THEN 0 ELSE 0.15 END), 4) AS confidence FROM e WHERE dst_work = 'p1') SELECT edge_no, CAST(row_number() OVER (ORDER BY CASE WHEN edge_type = 'comments-on' THEN 0 ELSE 1 END, confidence DESC, edge_type, src_work, src_ord, edge_no) AS INT) AS place FROM c ORDER BY place LIMIT 40")
def link_order(spark, d):
    e = edges(spark, d).where("dst_work = 'p1'").withColumn("confidence", tx.confidence(F.col("method"), F.col("directed"), F.lit(None).cast("string")))
    return shelf.placed(e, *shelf.link_order(F.col("edge_type"), F.col("confidence"), F.col("src_work"), F.col("src_ord")), F.col("edge_no"), most=40).select("edge_no", "place")


@query("SELECT p_partkey, CAST(row_number() OVER (ORDER BY CASE WHEN p_size < 40 THEN 0 ELSE 1 END, CASE WHEN p_size < 40 THEN p_size END NULLS FIRST, p_name, p_partkey) AS INT) AS place FROM part ORDER BY place LIMIT 60")
def shelf_order(spark, d):
    declared = F.when(F.col("p_size") < 40, F.col("p_size"))
    return shelf.placed(table(spark, d, "part"), *shelf.shelf_order(declared, F.col("p_name"), F.col("p_partkey")), most=60).select("p_partkey", "place")


@query("SELECT event_id, CAST(row_number() OVER (ORDER BY ts DESC, event_id) AS INT) AS place FROM events ORDER BY place LIMIT 25")
def newest_first(spark, d):
    return shelf.placed(table(spark, d, "events"), F.desc("ts"), F.col("event_id"), most=25).select("event_id", "place")


@query(f"WITH {EDGES} SELECT edge_no, CAST(row_number() OVER (PARTITION BY dst_work ORDER BY CASE WHEN CAST(l_quantity AS INT) % 4 > 0 THEN 0 ELSE 1 END, dst_ord, edge_no) AS INT) AS landing FROM e")
def landing_sort(spark, d):
    ends = edges(spark, d).select("edge_no", F.col("dst_work").alias("work"), F.col("dst_ord").alias("from_ord"), (F.col("dst_ord") + F.col("l_quantity").cast("int") % 4).alias("to_ord"))
    return shelf.landings(ends, "work").select("edge_no", "landing")


@query(f"WITH {EDGES} SELECT dst_work AS work, dst_ord AS ord, count(DISTINCT src_work) AS n FROM e WHERE edge_type = 'comments-on' AND src_work IN ('s1', 's2', 's3', 's5', 's8') GROUP BY 1, 2")
def marker_density(spark, d):
    return shelf.marker_density(edges(spark, d), ["s1", "s2", "s3", "s5", "s8"])


@query("SELECT l_partkey AS citation, count(*) AS n FROM lineitem WHERE l_linenumber <> 7 AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 5) GROUP BY 1")
def ambiguity_queue(spark, d):
    li, key = table(spark, d, "lineitem"), F.col("p_partkey")
    rows = li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("edge_no"), F.when(F.col("l_linenumber") != 7, F.col("l_orderkey")).alias("cite_1"), F.col("l_partkey").alias("cite_2"), F.lit("see").alias("label"))
    near = table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("citation"), F.col("o_orderkey").alias("place"), F.lit(1).alias("n"))
    far = table(spark, d, "part").where("p_size < 40").select(key.alias("citation"), key.alias("place"), F.when(F.col("p_size") < 5, 2).otherwise(1).alias("n"))
    return shelf.queue(graph.import_links(rows, near, far), "cite_2")


@query("WITH c AS (SELECT p_brand AS citation, p_partkey, p_size < 3 AS fits FROM part), a AS (SELECT *, bool_or(fits) OVER (PARTITION BY citation) AS f FROM c) SELECT citation, p_partkey FROM a WHERE fits OR NOT f")
def title_narrowing(spark, d):
    return shelf.narrowed(table(spark, d, "part").select(F.col("p_brand").alias("citation"), "p_partkey", "p_size"), "citation", F.col("p_size") < 3).select("citation", "p_partkey")


@query("""WITH c AS (SELECT l_orderkey AS citation, l_suppkey AS work, l_partkey AS address FROM lineitem WHERE l_linenumber < 3), k AS (SELECT DISTINCT citation, work, address, work IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AS w, address IN (SELECT p_partkey FROM part WHERE p_size > 25) AS p FROM c),
l AS (SELECT citation, work, address, CASE WHEN w AND p THEN 'resolves' ELSE 'unknown work' END AS outcome FROM k WHERE NOT w OR p) SELECT *, count(*) OVER (PARTITION BY citation) AS "left" FROM l""")
def shelf_settling(spark, d):
    li = table(spark, d, "lineitem").where("l_linenumber < 3").select(F.col("l_orderkey").alias("citation"), F.col("l_suppkey").alias("work"), F.col("l_partkey").alias("address")).distinct()
    works = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("work"))
    known = li.join(works, "work", "left_semi").join(table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("address")), "address", "left_semi").select("work", "address")
    return shelf.settled(li, works, known)


@query(f"""WITH {SEG}, m AS (SELECT doc_id AS work, CAST(line_no AS INT) AS segment, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS line FROM seg), q AS (SELECT l_orderkey * 8 + l_linenumber AS edge_no, l_orderkey % 1200 AS work, l_linenumber AS line FROM lineitem)
SELECT q.edge_no, q.work, q.line, m.segment, CASE WHEN m.segment IS NOT NULL THEN 'imported' WHEN q.work IN (SELECT work FROM m) THEN 'no line' ELSE 'no work' END AS reason FROM q LEFT JOIN m ON q.work = m.work AND q.line = m.line""")
def link_line_import(spark, d):
    from pyspark.sql.window import Window

    lines = segs(spark, d).select(F.col("doc_id").alias("work"), F.col("line_no").alias("segment"), F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")).cast("bigint").alias("line"))
    links = table(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("edge_no"), (F.col("l_orderkey") % 1200).alias("work"), F.col("l_linenumber").cast("bigint").alias("line"))
    return shelf.line_links(links, lines)


@query(f"WITH {EDGES} SELECT edge_type, count(*) FILTER (WHERE edge_type <> 'references') AS asserted, count(*) FILTER (WHERE (edge_type <> 'references' OR l_orderkey % 7 = 0) AND l_orderkey % 5 <> 0) AS curated FROM e GROUP BY edge_type")
def asserted_edges(spark, d):
    verdict = F.when(F.col("l_orderkey") % 5 == 0, "rejected").when(F.col("l_orderkey") % 7 == 0, "confirmed")
    a, c = shelf.asserted(F.col("edge_type"), F.col("method"), verdict)
    return edges(spark, d).groupBy("edge_type").agg(F.count_if(a).alias("asserted"), F.count_if(c).alias("curated"))


@query("SELECT l.doc_id * 8 + 1 AS edge_no, l.toxic FROM labels l WHERE l.doc_id * 8 + 1 NOT IN (SELECT l_orderkey * 8 + l_linenumber FROM lineitem)")
def orphan_repairs(spark, d):
    repairs = table(spark, d, "labels").select((F.col("doc_id") * 8 + 1).alias("edge_no"), "toxic")
    return graph.orphans(repairs, edges(spark, d)).select("edge_no", "toxic")


_WORKS = f"""{EDGES}, g AS (SELECT edge_no, src_work AS a, 'o' || (l_orderkey % 200) AS b, CASE edge_type WHEN 'comments-on' THEN 0 WHEN 'quotes' THEN 1 ELSE 3 END AS type_no, round((CASE method WHEN 'cited' THEN 0.9 ELSE 0.7 END) - (CASE WHEN directed THEN 0 ELSE 0.15 END), 4) AS confidence FROM e),
n AS (SELECT edge_no, a AS node, b AS far, type_no, confidence FROM g UNION ALL SELECT edge_no, b, a, type_no, confidence FROM g),
y AS (SELECT DISTINCT node, CASE WHEN starts_with(node, 's') THEN 2010 - CAST(substr(node, 2) AS INT) % 9 ELSE 2000 - CAST(substr(node, 2) AS INT) % 40 END AS y FROM n),
m AS (SELECT n.*, p.y AS ya, q.y AS yb FROM n JOIN y p ON p.node = n.node JOIN y q ON q.node = n.far WHERE n.node <> n.far AND confidence > 0 AND p.y > q.y),
a1 AS (SELECT * FROM m WHERE node = 's1' QUALIFY row_number() OVER (PARTITION BY far ORDER BY edge_no) = 1),
b1 AS (SELECT *, row_number() OVER (ORDER BY type_no, confidence DESC, ya - yb, far) AS place FROM a1),
k1 AS (SELECT far AS node, 's1' AS parent, 1 AS level, edge_no, place, type_no FROM b1 WHERE place <= 8),
a2 AS (SELECT m.*, k1.place AS bfs FROM m JOIN k1 ON m.node = k1.node WHERE m.far <> 's1' AND m.far NOT IN (SELECT far FROM b1) QUALIFY row_number() OVER (PARTITION BY m.far ORDER BY k1.place, m.edge_no) = 1),
b2 AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY type_no, confidence DESC, ya - yb, far) AS place FROM a2),
k2 AS (SELECT far AS node, node AS parent, 2 AS level, edge_no, type_no FROM b2 WHERE place <= 8)"""
SQL["trace_depth2"] = f"WITH {_WORKS} SELECT node, parent, CAST(level AS INT) AS level, edge_no FROM k1 UNION ALL SELECT node, parent, CAST(level AS INT), edge_no FROM k2"


@query(f"""WITH {_WORKS}, c AS (SELECT node AS "end", 's1 > ' || node AS path, type_no AS weakest FROM k1 WHERE node NOT IN (SELECT parent FROM k2) UNION ALL SELECT k2.node, 's1 > ' || k1.node || ' > ' || k2.node, greatest(k1.type_no, k2.type_no) FROM k2 JOIN k1 ON k2.parent = k1.node) SELECT "end", path, weakest, weakest < 3 AS is_transmission FROM c""")
def chain_ends(spark, d):
    e, t = _works(spark, d)
    steps = graph.cut(graph.trace(e, t, "s1", depth=2)[0], "chain-steps")
    return shelf.chains(steps, e, "s1", 2)


@query(SQL["graph_path"].replace("SELECT 'path' AS outcome, min(steps) AS steps", "SELECT 'path' AS outcome, min(steps) AS steps, 's1' AS first, 's7' AS last, true AS joined"))
def graph_path_steps(spark, d):
    """A shortest path from both sides: its ends, its length, and that each step is an edge."""
    e = edges(spark, d).select(F.col("src_work").alias("a"), F.col("dst_work").alias("b"))
    got = graph.path_steps(e, "s1", "s7")
    ends = e.select(F.concat_ws(">", "a", "b").alias("s")).unionByName(e.select(F.concat_ws(">", "b", "a").alias("s"))).distinct()
    steps = got.select(F.explode(F.expr("transform(sequence(1, size(path) - 1), i -> concat(path[i - 1], '>', path[i]))")).alias("s"))
    missing = steps.join(ends, "s", "left_anti").agg(F.count(F.lit(1)).alias("m"))  # one row
    return got.crossJoin(F.broadcast(missing)).select("outcome", "steps", F.element_at("path", 1).alias("first"), F.element_at("path", -1).alias("last"), (F.col("m") == 0).alias("joined"))


@query(f"WITH {EDGES} SELECT src_work, count(*) AS n FROM e WHERE l_orderkey % 3 = 0 OR (dst_ord <= 20 AND dst_ord + CAST(l_quantity AS INT) % 4 >= 10) GROUP BY src_work")
def span_links(spark, d):
    """Links on a span of words; a link that names no words passes."""
    e = edges(spark, d).withColumn("lo", F.when(F.col("l_orderkey") % 3 != 0, F.col("dst_ord"))).withColumn("hi", F.col("lo") + F.col("l_quantity").cast("int") % 4)
    return e.where(F.col("lo").isNull() | ((F.col("lo") <= 20) & (F.col("hi") >= 10))).groupBy("src_work").agg(F.count(F.lit(1)).alias("n"))


# Places, layers and tables ------------------------------------------------------------------------------------------------------------------


@query("SELECT conv_id, turn, role FROM conversations WHERE turn BETWEEN 1 AND 2")
def passage(spark, d):
    return shelf.passage(table(spark, d, "conversations"), "turn", 1, 4, 2).select("conv_id", "turn", "role")


@query("SELECT title, CAST(distance AS INT) AS distance, greatest((SELECT count(*) FROM (SELECT DISTINCT lower(p_name) AS t FROM part) WHERE levenshtein(t, 'hott gear') <= 3) - 8, 0) AS cut FROM (SELECT DISTINCT lower(p_name) AS title, levenshtein(lower(p_name), 'hott gear') AS distance FROM part) WHERE distance <= 3 ORDER BY distance, title LIMIT 8")
def title_suggestions(spark, d):
    return shelf.suggestions(table(spark, d, "part"), "p_name", "hott gear")


@query("SELECT coalesce(o.k, c.k) AS k, decision, CASE WHEN o.k IS NULL THEN 'vanished' WHEN decision IS NULL THEN 'open' ELSE 'decided' END AS state FROM (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus <> 'F') o FULL JOIN (SELECT o_orderkey AS k, o_orderpriority AS decision FROM orders WHERE o_orderkey % 4 = 0) c ON o.k = c.k")
def queue_refresh(spark, d):
    o = table(spark, d, "orders")
    return shelf.refreshed(o.where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("k")), o.where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("decision")), "k")


@query("WITH m AS (SELECT event_type AS kind, event_id // 2 AS k, min(value) AS c FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2), t AS (SELECT event_type AS kind, event_id // 2 AS k, min(value) AS c FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2) SELECT t.kind, CASE WHEN m.c IS NULL THEN 'taken' WHEN m.c = t.c THEN 'had' ELSE 'refused' END AS outcome, count(*) AS n FROM t LEFT JOIN m ON m.kind = t.kind AND m.k = t.k GROUP BY 1, 2")
def layers_by_kind(spark, d):
    """Two people's layers, merged kind by kind, with a report of each."""
    e = table(spark, d, "events").withColumn("k", F.concat_ws(":", "event_type", F.floor(F.col("event_id") / 2)))
    out = records.merged_layers(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "k", "value")
    return out.groupBy(F.split_part("k", F.lit(":"), F.lit(1)).alias("kind"), "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'own ' || c_custkey END AS name FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 1 AND c_custkey % 3 = 0")
def timeline_union(spark, d):
    """Two tables by key; what is one's own stands."""
    c = table(spark, d, "customer").withColumnRenamed("c_custkey", "k")
    own = c.where("k % 3 <> 0").select("k", F.concat(F.lit("own "), "k").alias("name"))
    return catalogue_union(own, c.select("k", F.col("c_name").alias("name")), "k")


@query("SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS kept FROM orders")
def kept_number(spark, d):
    address = F.concat(F.lit("ch2b:"), F.col("o_custkey").cast("string"), F.lit(":7"))
    return table(spark, d, "orders").select("o_orderkey", shelf.kept_number(address).alias("kept"))


@query("SELECT o_orderkey, (o_orderkey // 2 + 2) || (CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END) AS folio, o_orderkey AS page FROM orders")
def folio_pages(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", cal.folio(F.col("o_orderkey")).alias("folio"))
    return o.withColumn("page", cal.page_of(F.col("folio")))


_BOX = "l_partkey % 50 AS ax, l_suppkey % 40 AS ay, l_partkey % 50 + l_linenumber * 6 AS bx, l_suppkey % 40 + CAST(l_quantity AS INT) AS by_, 20 AS cx, 15 AS cy, 28 AS dx, 22 AS dy"


@query(f"SELECT CASE WHEN ax <= cx AND ay <= cy AND bx >= dx AND by_ >= dy THEN 'covers' WHEN ax < dx AND cx < bx AND ay < dy AND cy < by_ THEN 'overlaps' ELSE 'apart' END AS outcome, count(*) AS n FROM (SELECT {_BOX} FROM lineitem) GROUP BY 1")
def box_geometry(spark, d):
    li = table(spark, d, "lineitem").selectExpr(*_BOX.replace("CAST(l_quantity AS INT) AS", "CAST(l_quantity AS INT) AS").split(", "))
    a, b = tuple(F.col(c) for c in ("ax", "ay", "bx", "by_")), tuple(F.col(c) for c in ("cx", "cy", "dx", "dy"))
    return li.groupBy(shelf.boxes_touch(a, b).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def _twice(text: str, word: str, other: str) -> str:
    """A word's neighbours are part of what DuckDB matches, so words that share one need a second pass."""
    for _ in range(2):
        text = f"regexp_replace({text}, '(^|[^\\p{{L}}\\p{{N}}]){word}([^\\p{{L}}\\p{{N}}]|$)', '\\1{other}\\2', 'g')"
    return text


@query(f"SELECT doc_id, md5({_twice(_twice('text', 'das', 'd-s'), 'los', 'l-s')}) AS text FROM documents")
def word_substitution(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(shelf.substituted(F.col("text"), {"das": "d-s", "los": "l-s"})).alias("text"))


_HEB = """y0 AS (SELECT DISTINCT unnest(range(5700, 5800)) AS y), y1 AS (SELECT y, (235 * y - 234) // 19 AS m FROM y0), y2 AS (SELECT y, 29 * m + (12084 + 13753 * m) // 25920 AS d FROM y1), y3 AS (SELECT y, CASE WHEN (3 * (d + 1)) % 7 < 3 THEN d + 1 ELSE d END AS d FROM y2),
y4 AS (SELECT y, d, lag(d) OVER (ORDER BY y) AS b, lead(d) OVER (ORDER BY y) AS a FROM y3), y5 AS (SELECT y, -1373427 + d + CASE WHEN a - d = 356 THEN 2 WHEN d - b = 382 THEN 1 ELSE 0 END AS n FROM y4 WHERE a IS NOT NULL AND b IS NOT NULL), y6 AS (SELECT y, n, lead(n) OVER (ORDER BY y) AS nx FROM y5)"""


@query(f"WITH {_HEB}, o AS (SELECT o_orderkey, CAST(o_orderdate::DATE - DATE '1970-01-01' + 719163 AS BIGINT) AS f FROM orders) SELECT o_orderkey, y AS year, f - n + 1 AS day_of_year, nx - n AS days FROM o JOIN y6 ON f >= n AND f < nx")
def calendar_hebrew(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", cal.hebrew(tx.fixed_day(F.col("o_orderdate"))).alias("h"))
    return rows.select("o_orderkey", "h.*")


@query("WITH e AS (SELECT event_id, CAST(ts::DATE - DATE '2020-01-05' AS BIGINT) AS n FROM events) SELECT event_id, n // 2711 AS cycle, n % 2711 AS page FROM e")
def study_pages(spark, d):
    rows = table(spark, d, "events").select("event_id", cal.study_page(tx.fixed_day(F.col("ts"))).alias("s"))
    return rows.select("event_id", "s.*")


@query("SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN 1000 + o_custkey % 900 WHEN 1 THEN -(o_custkey % 900 + 100) WHEN 2 THEN (4 + o_custkey % 15) * 100 - 99 END AS INT) AS y0, CAST(CASE o_orderkey % 4 WHEN 0 THEN 1050 + o_custkey % 900 WHEN 1 THEN -(o_custkey % 900 + 100) WHEN 2 THEN (4 + o_custkey % 15) * 100 END AS INT) AS y1 FROM orders")
def written_years(spark, d):
    n = F.col("o_custkey") % 900
    said = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("c. "), n + 1000, F.lit("-"), n + 1050)).when(F.col("o_orderkey") % 4 == 1, F.concat(n + 100, F.lit(" BCE")))
    said = said.when(F.col("o_orderkey") % 4 == 2, F.concat((F.col("o_custkey") % 15 + 4).cast("string"), F.lit("th century"))).otherwise("long ago")
    return table(spark, d, "orders").select("o_orderkey", cal.years(said).alias("y")).select("o_orderkey", "y.y0", "y.y1")


@query("SELECT doc_id, sha256('=' || doc_id || chr(10) || coalesce('=' || lang, '-') || chr(10) || coalesce('=' || text, '-')) AS id FROM documents")
def fingerprints(spark, d):
    return table(spark, d, "documents").select("doc_id", shelf.fingerprint(F.col("doc_id"), F.col("lang"), F.col("text")).alias("id"))


_SHELVES = [("ECONOMY", "small", 2), ("PROMO", "offers", 1), ("PROMO ", "plain", 9), ("STANDARD", "usual", 3), ("", "rest", 8), ("S", "other", 5)]


@query("WITH s AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{s}', {r})" for p, s, r in _SHELVES) + ") t(prefix, shelf, rank)), m AS (SELECT p_partkey, p_type, shelf, rank, row_number() OVER (PARTITION BY p_partkey ORDER BY length(prefix) DESC) AS n FROM part JOIN s ON prefix <> '' AND starts_with(p_type, prefix)) SELECT p.p_partkey, shelf, CAST(rank AS INT) AS rank FROM part p LEFT JOIN (SELECT * FROM m WHERE n = 1) m USING (p_partkey)")
def taxonomy_shelf(spark, d):
    shelves = spark.createDataFrame([x for x in _SHELVES if x[0]], "prefix string, shelf string, rank int")
    return shelf.shelved(table(spark, d, "part").select("p_partkey", "p_type"), "p_type", shelves).select("p_partkey", "shelf", "rank")


@query("WITH l AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE upper(p_name) END AS label FROM part), s AS (SELECT label, trim(regexp_replace(lower(label), '[^\\p{L}\\p{N}]+', '-', 'g'), '-') AS slug FROM l) SELECT slug, count(*) AS n, min(label) AS label, CASE WHEN count(*) > 1 THEN 'ambiguous' ELSE 'one' END AS outcome FROM s GROUP BY slug")
def section_names(spark, d):
    labels = table(spark, d, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.upper("p_name")).alias("name"))
    return shelf.named_sections(labels, "name")


@query("WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 7), s AS (SELECT vec_id % 12 AS work, vec_id AS id, round(list_sum(list_transform(list_zip(embedding, q), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 6) AS score FROM embeddings, q), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY work ORDER BY score DESC, id) <= 3) SELECT work, id, score FROM b ORDER BY score DESC, id LIMIT 15")
def lane_ask(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id = 7").head()["embedding"]
    rows = e.withColumn("work", F.col("vec_id") % 12)
    return shelf.asked_lanes(rows, F.round(records.dot(F.col("embedding"), F.array(*map(F.lit, q))), 6), "work", "vec_id", 3, 15)


@query("SELECT o_orderkey, CASE WHEN o_custkey % 100 < 20 THEN o_custkey % 100 WHEN o_custkey % 100 >= 26 THEN o_custkey % 100 - 2 END AS base FROM orders")
def base_places(spark, d):
    """Places of shown texts in their bases, under a patch at 20 of six characters for four."""
    at = F.col("o_custkey") % 100
    return table(spark, d, "orders").select("o_orderkey", shelf.base_place(at, F.lit(20), F.lit("four"), F.lit("sixsix")).alias("base"))


@query("WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), a AS (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM l), b AS (SELECT doc_id, i, string_split(ls[i + 1], '. ') AS ps FROM a), c AS (SELECT doc_id, i, ps, unnest(range(len(ps))) AS j FROM b) SELECT CAST(doc_id AS VARCHAR) AS slug, (i + 1) || ':' || (j + 1) AS path, md5(ps[j + 1]) AS text FROM c WHERE length(trim(ps[j + 1], ' ')) > 0")
def nested_json_rows(spark, d):
    """Texts as JSON nested two deep, read as segments with their paths."""
    parts = F.transform(F.split("text", "\n", -1), lambda x: F.split(x, r"\. ", -1))
    works = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("slug"), F.to_json(F.struct(parts.alias("text"))).alias("json"))
    return nested_json(works, 2).select("slug", F.array_join(F.transform("path", lambda x: x.cast("string")), ":").alias("path"), F.md5("text").alias("text"))


@query("SELECT doc_id, length(text) AS n_chars, true AS whole, true AS short FROM documents WHERE text IS NOT NULL")
def oversize_whole(spark, d):
    """The pieces of every text put together are the text, and none is longer than a text that is not cut."""
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text", records.cut_pieces(F.col("text")).alias("p"))
    return docs.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), (F.array_join("p", "") == F.col("text")).alias("whole"), (F.array_max(F.transform("p", F.length)) <= 10_000).alias("short"))


@query("WITH b AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS no FROM documents), o AS (SELECT doc_id, no FROM b QUALIFY count(*) OVER (PARTITION BY doc_id, text) = 1) SELECT doc_id, count(*) FILTER (WHERE (no + doc_id) % 6 <> 0) AS kept, true AS rising FROM o GROUP BY doc_id HAVING count(*) FILTER (WHERE (no + doc_id) % 6 <> 0) > 0")
def continuity_kept(spark, d):
    """A re-import that keeps the order and drops lines: all lines that occur once and are still there are kept, and rise on both sides."""
    from pyspark.sql.window import Window

    before = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("no", "text"))
    once = before.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "text"))).where("c = 1").drop("c")
    got = records.aligned(once, once.where((F.col("no") + F.col("doc_id")) % 6 != 0).withColumn("no", F.col("no") * 2), "doc_id")
    last = F.lag("new_no").over(Window.partitionBy("doc_id").orderBy("old_no"))
    return got.withColumn("b", last).groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"), F.bool_and(F.col("b").isNull() | (F.col("b") < F.col("new_no"))).alias("rising"))


# A reader's desk -------------------------------------------------------------------------------------------------------------------------


@query(f"""WITH {SEG}, q AS (SELECT doc_id, line_no, w, CASE WHEN line_no % 2 = 0 THEN w[1:3] ELSE w[2:4] END AS a FROM seg WHERE len(w) >= 4), f AS (SELECT doc_id, line_no, list_filter(range(len(w) - 2), lambda i: w[i + 1:i + 3] = a) AS z FROM q)
SELECT doc_id, line_no, CASE WHEN len(z) = 1 THEN CAST(z[1] AS INT) END AS first, CASE WHEN len(z) = 1 THEN CAST(z[1] + 2 AS INT) END AS last FROM f""")
def opening_spans(spark, d):
    """Comments on each line that open with three of its words, before a dash or as the first clause before one."""
    rows = segs(spark, d).withColumn("w", tx.tokens(F.col("line"))).where("size(w) >= 4")
    even = F.concat(F.array_join(F.slice("w", 1, 3), " "), F.lit(". Not there – this is so"))
    comment = F.when(F.col("line_no") % 2 == 0, even).otherwise(F.concat(F.array_join(F.slice("w", 2, 3), " "), F.lit(": - and so on")))
    return rows.select("doc_id", "line_no", desk.opening_span(F.col("line"), comment).alias("s")).select("doc_id", "line_no", "s.first", "s.last")


@query("SELECT p_partkey, '<i>' || p_name || '</i>' AS text, unnest(['Rashi', p_brand]) AS commentator, unnest(['a', NULL]) AS label, CAST(unnest([5, 7 + length(p_name)]) AS INT) AS at FROM part")
def anchor_mining(spark, d):
    """Two empty anchors in each name, one without its first quote; markup that holds something stays."""
    name = F.col("p_name")
    text = F.concat(F.lit("<i>"), F.left(name, F.lit(2)), F.lit('<i data-commentator="Rashi" data-label="a"></i>'), F.expr("substring(p_name, 3)"), F.lit("</i>"), F.lit("<i data-commentator="), F.col("p_brand"), F.lit('"></i>'))
    rows = table(spark, d, "part").select("p_partkey", desk.mined(text).alias("m"))
    return rows.select("p_partkey", "m.text", F.explode("m.anchors").alias("a")).select("p_partkey", "text", "a.*")


@query("""WITH r AS (SELECT o_orderkey AS ref, o_custkey % 25 AS work, CASE o_orderkey % 4 WHEN 0 THEN CAST([] AS INTEGER[]) WHEN 1 THEN [CAST(o_custkey % 9 AS INTEGER)] WHEN 2 THEN [CAST(o_custkey % 9 AS INTEGER), CAST(o_custkey % 3 AS INTEGER)] ELSE [CAST(o_custkey % 9 AS INTEGER), 2] END AS f, CASE WHEN o_orderkey % 4 = 3 THEN [CAST(o_custkey % 9 + 2 AS INTEGER), 4] END AS t FROM orders),
p AS (SELECT s_suppkey AS place, s_suppkey % 25 AS work, [CAST(s_suppkey % 11 AS INTEGER), CAST(s_suppkey % 7 AS INTEGER)] AS a FROM supplier) SELECT place, count(*) AS n, sum(ref) AS refs FROM r JOIN p USING (work) WHERE CASE WHEN len(f) = 0 THEN true WHEN t IS NULL THEN a[1:len(f)] = f ELSE a >= f AND a <= t END GROUP BY place""")
def who_cites(spark, d):
    """Refs to whole works, to points and to ranges that cover a place."""
    n, c = F.col("o_orderkey") % 4, F.col("o_custkey")
    a = (c % 9).cast("int")
    begin = F.when(n == 0, F.array().cast("array<int>")).when(n == 1, F.array(a)).when(n == 2, F.array(a, (c % 3).cast("int"))).otherwise(F.array(a, F.lit(2)))
    refs = table(spark, d, "orders").select(F.col("o_orderkey").alias("ref"), (c % 25).alias("work"), begin.alias("from"), F.when(n == 3, F.array(a + 2, F.lit(4))).alias("to"))
    s = F.col("s_suppkey")
    places = table(spark, d, "supplier").select(s.alias("place"), (s % 25).alias("work"), F.array((s % 11).cast("int"), (s % 7).cast("int")).alias("address"))
    return desk.citing(refs, places).groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.sum("ref").alias("refs"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey % 20 = 1 OR (l_suppkey % 20 = 2 AND l_partkey % 10 = 3) OR (l_suppkey % 20 = 3 AND ((l_partkey % 10 = 4 AND l_linenumber = 1) OR l_partkey % 10 = 5))")
def lane_selection(spark, d):
    parts = spark.createDataFrame([(1, []), (2, [3]), (3, [4, 1]), (3, [5])], "work long, under array<int>")
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 20).cast("long").alias("work"), F.array((F.col("l_partkey") % 10).cast("int"), F.col("l_linenumber").cast("int")).alias("path"))
    return desk.chosen(rows, parts).select("l_orderkey", "l_linenumber")


@query("SELECT doc_id, length(text) AS n_chars FROM documents WHERE doc_id % 5 <> 0 AND regexp_matches(text, '\\S') AND doc_id % 3 <> 0")
def job_left(spark, d):
    """What an embedding job has still to do: every fifth row is a heading, every third is done, some others by another model."""
    docs = table(spark, d, "documents").withColumn("kind", F.when(F.col("doc_id") % 5 == 0, "heading"))
    done = docs.where("doc_id % 3 = 0 OR doc_id % 7 = 0").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "m1").otherwise("m0").alias("model"))
    return desk.work_left(docs, done, "doc_id", "m1").select("doc_id", F.length("text").cast("bigint").alias("n_chars"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'away' WHEN c_custkey % 4 = 0 THEN 'new' WHEN c_custkey % 11 > c_custkey % 7 THEN 'stale' ELSE 'fresh' END AS outcome FROM customer WHERE NOT (c_custkey % 5 = 0 AND c_custkey % 4 = 0)")
def documents_registry(spark, d):
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    return desk.registry(c.where(k % 4 != 0).select("c_custkey", (k % 7).alias("changed")), c.where(k % 5 != 0).select("c_custkey", (k % 11).alias("changed")), "c_custkey")


@query("WITH n AS (SELECT DISTINCT p_name AS spelling, p_brand AS work FROM part UNION SELECT lower(p_type), p_brand FROM part WHERE p_partkey % 50 = 0) SELECT spelling, CASE WHEN count(*) = 1 THEN min(work) END AS work, count(*) AS works FROM n GROUP BY spelling")
def spelling_lexicon(spark, d):
    p = table(spark, d, "part")
    return desk.spelled(p.select(F.col("p_name").alias("spelling"), F.col("p_brand").alias("work")), p.where("p_partkey % 50 = 0").select(F.lower("p_type").alias("spelling"), F.col("p_brand").alias("work")))


@query("WITH a AS (SELECT o_orderkey, o_custkey % 30 AS work, o_orderkey % 200 AS address FROM orders), w AS (SELECT DISTINCT s_suppkey % 25 AS work FROM supplier), p AS (SELECT DISTINCT p_partkey % 25 AS work, p_partkey % 150 AS address FROM part) SELECT o_orderkey, CASE WHEN p.work IS NOT NULL THEN 'found' WHEN w.work IS NOT NULL THEN 'no address' ELSE 'not on the shelf' END AS outcome FROM a LEFT JOIN w ON a.work = w.work LEFT JOIN p ON a.work = p.work AND a.address = p.address")
def citation_lookup(spark, d):
    asked = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 30).alias("work"), (F.col("o_orderkey") % 200).alias("address"))
    works, p = table(spark, d, "supplier").select((F.col("s_suppkey") % 25).alias("work")), F.col("p_partkey")
    return desk.looked_up(asked, works, table(spark, d, "part").select((p % 25).alias("work"), (p % 150).alias("address"))).select("o_orderkey", "outcome")


@query("SELECT DISTINCT l_orderkey FROM lineitem l WHERE l_partkey % 50 = 7 AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def collections_holding(spark, d):
    """Orders as collections of parts with their flags as tags: those that hold a part and bear a tag."""
    c = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey") % 50).alias("members"), F.collect_set("l_returnflag").alias("tags"))
    return desk.holding(c, F.lit(7), "R").select("l_orderkey")


SQL["where_from"] = f"""WITH {SEG}, p AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS pw FROM benchmark), q AS (SELECT item_id, ' ' || array_to_string(pw, ' ') || ' ' AS said FROM p WHERE len(pw) > 0),
t AS (SELECT source, ' ' || array_to_string(w, ' ') || ' ' AS words FROM seg) SELECT item_id, count(*) AS hits, count(DISTINCT source) AS works, count(*) > 200 AS turn_of_speech FROM q JOIN t ON contains(words, said) GROUP BY item_id"""
SQL["atbash"] = f"""WITH {SEG}, t AS MATERIALIZED (SELECT DISTINCT unnest(w) AS term FROM seg), m AS MATERIALIZED (SELECT term, translate(term, 'abcdefghijklmnopqrstuvwxyz', 'zyxwvutsrqponmlkjihgfedcba') AS mirror FROM t) SELECT m.term, m.mirror FROM m JOIN t ON m.mirror = t.term"""
SQL["identity_closure"] = "WITH RECURSIVE r AS (SELECT c_custkey AS old, c_custkey + 1 + c_custkey % 3 AS new FROM customer WHERE c_mktsegment <> 'BUILDING'), w AS (SELECT old AS name, new AS now FROM r UNION ALL SELECT w.name, r.new FROM w JOIN r ON w.now = r.old) SELECT name, max(now) AS now FROM w GROUP BY name"
_ALIKE = "('c', 'e'), ('e', 'c'), ('i', 'l'), ('l', 'i'), ('u', 'v'), ('v', 'u')"
SQL["suspects"] = f"""WITH {SEG}, v AS MATERIALIZED (SELECT term, count(*) AS cf FROM (SELECT unnest(w) AS term FROM seg) GROUP BY term), c AS (SELECT term AS common, cf AS common_count FROM v WHERE cf >= 500 AND regexp_matches(term, '^[a-z]+$')), r AS (SELECT term AS rare, cf AS rare_count FROM v WHERE cf <= 1 AND length(term) >= 4),
p AS (SELECT *, CASE WHEN length(rare) = length(common) AND levenshtein(rare, common) = 1 THEN 'substitution' WHEN length(rare) = length(common) THEN 'swap' WHEN length(rare) < length(common) THEN 'deletion' ELSE 'insertion' END AS how FROM c JOIN r ON abs(length(rare) - length(common)) <= 1 AND damerau_levenshtein(rare, common) = 1
      WHERE NOT (starts_with(rare, common) OR ends_with(rare, common) OR starts_with(common, rare) OR ends_with(common, rare))),
k AS (SELECT p.* FROM p WHERE how <> 'substitution' OR (SELECT bool_and(regexp_matches(x, '^[a-z]$') OR x = y) FROM (SELECT unnest(string_split(rare, '')) AS x, unnest(string_split(common, '')) AS y))),
s AS (SELECT *, ((length(bin(common_count)) * 10 + length(rare) * 5) * (CASE how WHEN 'substitution' THEN 10 WHEN 'swap' THEN 9 ELSE 5 END)) // 10 * (CASE WHEN how = 'substitution' AND (SELECT count(*) FROM (SELECT unnest(string_split(rare, '')) AS x, unnest(string_split(common, '')) AS y) WHERE (x, y) IN (VALUES {_ALIKE})) > 0 THEN 2 ELSE 1 END) AS score FROM k
      WHERE how <> 'insertion' OR regexp_matches(rare, '^[a-z]+$'))
SELECT rare, common, rare_count, common_count, how, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY rare ORDER BY score DESC, common, how) AS no FROM s) WHERE no = 1"""
