"""Line dedup by content-defined chunks of lines (native: DataFrame functions only).

A rolling hash runs over the hashes of two lines; a chunk begins where it is smaller than before and not larger than after. Such a
boundary depends on four lines only, so text that is shifted, inserted or cut elsewhere does not move it, and no two
boundaries are adjacent: every chunk between two of them has two lines or more. Chunks that occur more than once
are compared with their first occurrence byte by byte, and all but the first are removed.

Few short passages hold two boundaries, so chunks alone miss most of them. Where the whole job is asked for, the lines that repeated
chunks leave are cut finer: each pair of neighbouring lines that are not blank is a chunk (with the blank lines between them), unless it
lies in a chunk that is removed. Then no repeated run of two such lines or more stays, and long passages are found by their chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, written

LINES = r"split(text, '\n', -1)"
ROLL = "transform(sequence(0, size(hashes) - 1), i -> IF(i = 0, hashes[0], md5(concat(hashes[i - 1], hashes[i]))))"
BEGINS = "concat(array(0), filter(sequence(0, size(roll) - 1), i -> i > 0 AND roll[i] < roll[i - 1] AND (i = size(roll) - 1 OR roll[i] <= roll[i + 1])))"
#: (first line, number of lines) of each chunk of two lines or more.
SPANS = "filter(transform(begins, (b, k) -> named_struct('begin', b, 'n', IF(k = size(begins) - 1, size(hashes), begins[k + 1]) - b)), s -> s.n > 1)"

def _let(value: str, name: str, then: str) -> str:
    """SQL for ``then``, in which ``name`` is a value that is worked out once; the optimizer copies an expression into each of its uses, but not a lambda's variable."""
    return f"get(transform(array({value}), {name} -> {then}), 0)"


def chunk_text(lines: str, span: str) -> str:
    return f"array_join(slice({lines}, {span}.begin + 1, {span}.n), '\\n')"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, begin, n, h): the chunks with two lines that are not blank or more; h is a 64-bit hash of the chunk's text."""
    rows = _keyed(docs, id_col, text_col).where(F.instr("text", "\n") > 0)
    full = "aggregate(slice(lines, s.begin + 1, s.n), 0, (a, x) -> a + IF(trim(x) = '', 0, 1))"
    found = f"filter(transform({SPANS}, s -> named_struct('begin', s.begin, 'n', s.n, 'h', xxhash64({chunk_text('lines', 's')}), 'full', {full})), s -> s.full > 1)"
    spans = _let(LINES, "lines", _let("transform(lines, x -> md5(x))", "hashes", _let(ROLL, "roll", _let(BEGINS, "begins", found))))
    return rows.select("id", "th", F.explode_outer(F.expr(spans)).alias("s")).where("s IS NOT NULL").select("id", "th", "s.begin", "s.n", "s.h")


#: (first and last line that is not blank, and all such lines) of each chunk that has one.
FULL = """filter(transform(begins, (b, k) -> get(transform(array(filter(sequence(b, IF(k = size(begins) - 1, size(hashes), begins[k + 1]) - 1), i -> trim(lines[i]) <> '')), f ->
    named_struct('b', get(f, 0), 'e', get(f, size(f) - 1), 'f', f)), 0)), c -> c.b IS NOT NULL)"""
#: Chunks without the blank lines at their ends; pairs inside a chunk of more than two lines, with the chunk's beginning; pairs between chunks; and the first and last pair with the blank lines at the text's ends.
FINE = """flatten(array(
    transform(filter(full, c -> size(c.f) > 1), c -> named_struct('begin', c.b, 'n', c.e - c.b + 1, 'chunk', true, 'inside', -1)),
    flatten(transform(filter(full, c -> size(c.f) > 2), c -> transform(sequence(1, size(c.f) - 1), j -> named_struct('begin', c.f[j - 1], 'n', c.f[j] - c.f[j - 1] + 1, 'chunk', false, 'inside', c.b)))),
    transform(filter(sequence(0, size(full) - 1), k -> k > 0), k -> named_struct('begin', full[k - 1].e, 'n', full[k].b - full[k - 1].e + 1, 'chunk', false, 'inside', -1)),
    transform(filter(array(coalesce(get(full[0].f, 1), get(full, 1).b)), x -> x IS NOT NULL AND full[0].b > 0), x -> named_struct('begin', 0, 'n', x + 1, 'chunk', false, 'inside', -1)),
    transform(filter(array(coalesce(get(full[size(full) - 1].f, size(full[size(full) - 1].f) - 2), get(full, size(full) - 2).e)), x -> x IS NOT NULL AND full[size(full) - 1].e < size(lines) - 1),
        x -> named_struct('begin', x, 'n', size(lines) - x, 'chunk', false, 'inside', -1))))"""


def fine_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, begin, n, h, chunk, inside): chunks as of ``chunks``, without blank lines at their ends, and pairs of neighbouring lines that are not blank; ``inside`` is the first line of the chunk that a pair lies in, or -1."""
    rows = _keyed(docs, id_col, text_col).where(F.instr("text", "\n") > 0)
    hashed = f"transform(IF(size(full) = 0, array(), {FINE}), s -> named_struct('begin', s.begin, 'n', s.n, 'h', xxhash64({chunk_text('lines', 's')}), 'chunk', s.chunk, 'inside', s.inside))"
    spans = _let(LINES, "lines", _let("transform(lines, x -> md5(x))", "hashes", _let(ROLL, "roll", _let(BEGINS, "begins", _let(FULL, "full", hashed)))))
    return rows.select("id", "th", F.explode_outer(F.expr(spans)).alias("s")).where("s IS NOT NULL").select("id", "th", "s.*")


def _first() -> Column:
    return F.min(F.struct(F.col("id").isNull().alias("none"), "id", "begin", "th"))


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """(id, th, begin, n, h) of the chunks whose hash occurs more than once. Pairs inside a chunk that is not the first with its hash are left out: what the first has says the same."""
    if not whole:
        all_ = written(chunks(docs, id_col, text_col), "op6-chunks").distinct()
        first = written(all_.groupBy("h").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("h"), "op6-repeated")
        return all_.join(first, "h", "left_semi")
    all_ = written(fine_chunks(docs, id_col, text_col), "op6-chunks").distinct()
    # Written, so that the joins below have plain exchanges on both sides, and Spark can split the partition of a hot chunk.
    heads = written(all_.groupBy("h").agg(_first().alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").select("h", "first"), "op6-repeated")
    again = all_.join(heads, "h").withColumn("leads", F.col("id").eqNullSafe(F.col("first.id")) & (F.col("begin") == F.col("first.begin")) & (F.col("th") == F.col("first.th"))).drop("first")
    again = written(again, "op6-hashed")
    gone = again.where("chunk AND NOT leads").select(F.col("id").alias("id_"), F.col("th").alias("th_"), F.col("begin").alias("inside_")).distinct()
    left = again.where("inside >= 0").join(gone, F.col("id").eqNullSafe(F.col("id_")) & (F.col("th") == F.col("th_")) & (F.col("inside") == F.col("inside_")), "left_anti")
    return again.where("inside < 0").unionByName(left).select("id", "th", "begin", "n", "h")


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["id"].eqNullSafe(b["id"]) & (a["th"] == b["th"])


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """(id, th, begin, n, kept_in): the chunks to remove, each with the id of the document that keeps the first occurrence."""
    again = written(repeated_chunks(docs, id_col, text_col, whole), "op6-again")
    per = again.groupBy("id", "th").agg(F.collect_set(F.struct("begin", "n", "h")).alias("spans")).hint("shuffle_hash")
    rows = _keyed(docs, id_col, text_col)
    cut = f"get(transform(array({LINES}), lines -> transform(spans, s -> named_struct('begin', s.begin, 'n', s.n, 'h', s.h, 'chunk', {chunk_text('lines', 's')}))), 0)"
    texts = rows.join(per, _same(rows, per)).select(per["id"], per["th"], "text", "spans").select("id", "th", F.explode_outer(F.expr(cut)).alias("s")).where("s IS NOT NULL")
    texts = written(texts.select("id", "th", "s.begin", "s.n", "s.h", "s.chunk").dropDuplicates(["id", "th", "begin", "n"]), "op6-texts")
    # Of the chunks with one hash, those with one text are a group: the smallest of each (hash, text) stays.
    heads = texts.groupBy("h", "chunk").agg(_first().alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1")
    # Written, so that the join below has plain exchanges on both sides, and Spark can split the partition of a hot chunk.
    heads = written(heads.select("h", F.col("chunk").alias("chunk_"), "first"), "op6-heads")
    found = texts.join(heads, (texts["h"] == heads["h"]) & (F.col("chunk") == F.col("chunk_")))
    other = ~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("begin") == F.col("first.begin")) & (F.col("th") == F.col("first.th")))
    # Lines that a pair shares with its own first occurrence (the same line again and again) belong to the latter.
    shared = F.when(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th")), F.greatest(F.col("first.begin") + F.col("n") - F.col("begin"), F.lit(0))).otherwise(0)
    return found.where(other).select("id", "th", (F.col("begin") + shared).alias("begin"), (F.col("n") - shared).alias("n"), F.col("first.id").alias("kept_in"))


#: Spans put together where they overlap or touch.
RUNS = """get(transform(array(array_sort(array_distinct(flatten(transform(spans, s -> sequence(s.begin, s.begin + s.n - 1)))))), gone ->
    get(transform(array(filter(sequence(0, size(gone) - 1), i -> i = 0 OR gone[i] > gone[i - 1] + 1)), at -> transform(at, (p, k) -> named_struct('begin', gone[p], 'n', coalesce(get(at, k + 1), size(gone)) - p))), 0)), 0)"""


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """``docs`` with repeated chunks taken out of the text, and n_lines, n_removed (lines), chunks_removed and kept_in (sorted ids of the documents that keep them).

    With ``whole``, every run of two lines that are not blank or more goes if it has occurred before, whatever stands around it; chunks_removed
    counts the runs of lines that are taken out, and kept_in has the documents whose chunk, or pair of lines outside such chunks, is the first. The first occurrence of a line always stays. Without it, chunks go that are cut by the rolling hash:
    lines end at a line feed; only chunks of two lines or more, two of them not blank, are removed, and the first occurrence, by
    smallest id and then place, stays (a null id is last). A null text stays null, an empty one empty; a text without a line feed never changes. Rows
    that repeat id and text are one document and get one result. A document may become empty, and stays as a row. An empty table
    gives an empty result. Columns of ``docs`` that have the names of the new columns are replaced.
    """
    new = ("n_lines", "n_removed", "chunks_removed", "kept_in")
    docs = docs.drop(*new)
    gone = removals(docs, id_col, text_col, whole).groupBy("id", "th").agg(F.collect_list(F.struct("begin", "n")).alias("spans"), F.array_sort(F.collect_set("kept_in")).alias("kept"))
    gone = written(gone.withColumn("spans", F.expr(RUNS)) if whole else gone, "op6-removals")
    own = {n: fresh_name(f"_{n}", docs.columns) for n in ("id", "th", "spans", "kept")}
    gone = gone.select(*(F.col(n).alias(own[n]) for n in own)).hint("shuffle_hash")
    joined = docs.join(gone, docs[id_col].eqNullSafe(gone[own["id"]]) & (F.xxhash64(docs[text_col]) == gone[own["th"]]), "left")
    spans = f"`{own['spans']}`"
    lines = rf"split(`{text_col}`, '\n', -1)"
    kept = f"array_except(sequence(0, size(lines) - 1), flatten(transform({spans}, s -> sequence(s.begin, s.begin + s.n - 1))))"
    put = r"array_join(transform(kept, i -> lines[i]), '\n')"
    left = f"CASE WHEN {spans} IS NULL THEN `{text_col}` ELSE {_let(lines, 'lines', _let(kept, 'kept', put))} END"
    return joined.select(
        *(F.expr(left).alias(c) if c == text_col else docs[c] for c in docs.columns),
        F.expr(rf"IF(`{text_col}` IS NULL, 0L, CAST(size({lines}) AS BIGINT))").alias("n_lines"),
        F.expr(f"CAST(aggregate(coalesce({spans}, array()), 0, (a, s) -> a + s.n) AS BIGINT)").alias("n_removed"),
        F.expr(f"CAST(greatest(size({spans}), 0) AS BIGINT)").alias("chunks_removed"), F.coalesce(F.col(own["kept"]), F.expr(f"slice(array(`{id_col}`), 1, 0)")).alias("kept_in"),
    )


def op6_query(docs: DataFrame) -> DataFrame:
    out = line_dedup(docs.select("doc_id", "text"), whole=True)
    return out.select("doc_id", "n_lines", "n_removed", "chunks_removed", F.array_join(F.transform("kept_in", lambda x: x.cast("string")), ",").alias("kept_in"), F.sha2("text", 256).alias("text_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i, len(lines) AS n_lines FROM d WHERE text IS NOT NULL),
r AS (SELECT *, CASE WHEN i = 0 THEN md5(line) ELSE md5(md5(lag(line) OVER w) || md5(line)) END AS roll FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *, CASE WHEN i > 0 AND roll < lag(roll) OVER w AND (i = n_lines - 1 OR roll <= lead(roll) OVER w) THEN 1 ELSE 0 END AS cut FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY i) AS chunk_no FROM c),
f AS (SELECT doc_id, chunk_no, i, n_lines, lead(i) OVER a AS j, lead(chunk_no) OVER a AS next_no, row_number() OVER a AS p, max(i) OVER (PARTITION BY doc_id) AS last_full,
      min(i) OVER h AS cb, max(i) OVER h AS ce, count(*) OVER h AS cn FROM k WHERE trim(line, ' ') <> '' WINDOW a AS (PARTITION BY doc_id ORDER BY i), h AS (PARTITION BY doc_id, chunk_no)),
u AS (SELECT DISTINCT doc_id, cb AS b, ce AS e, true AS chunk, -1 AS inside FROM f WHERE cn > 1
      UNION ALL SELECT doc_id, i, j, false, cb FROM f WHERE next_no = chunk_no AND cn > 2
      UNION ALL SELECT doc_id, i, j, false, -1 FROM f WHERE next_no <> chunk_no
      UNION ALL SELECT doc_id, 0, j, false, -1 FROM f WHERE p = 1 AND i > 0 AND j IS NOT NULL
      UNION ALL SELECT doc_id, i, n_lines - 1, false, -1 FROM f WHERE j = last_full AND last_full < n_lines - 1),
v AS (SELECT u.*, array_to_string(lines[b + 1:e + 1], chr(10)) AS said FROM u JOIN d USING (doc_id)),
o AS (SELECT *, first_value(doc_id) OVER w AS fd, first_value(b) OVER w AS fb FROM v WINDOW w AS (PARTITION BY said ORDER BY doc_id, b)),
z AS (SELECT DISTINCT doc_id, b FROM o WHERE chunk AND NOT (doc_id = fd AND b = fb)),
x AS (SELECT o.doc_id, CASE WHEN o.doc_id = fd THEN greatest(o.b, fb + e - o.b + 1) ELSE o.b END AS b, e, fd FROM o LEFT JOIN z ON o.doc_id = z.doc_id AND o.inside = z.b WHERE NOT (o.doc_id = fd AND o.b = fb) AND z.doc_id IS NULL),
g AS (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest(range(b, e + 1)) AS i FROM x)),
q AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE before IS NULL OR before <> i - 1) AS chunks_removed FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM g) GROUP BY doc_id),
s AS (SELECT doc_id, list_sort(list(DISTINCT fd)) AS kept_in FROM x GROUP BY doc_id),
t AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) AS text FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i WHERE g.doc_id IS NULL GROUP BY l.doc_id)
SELECT d.doc_id, CAST(coalesce(len(d.lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(q.n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(q.chunks_removed, 0) AS BIGINT) AS chunks_removed, coalesce(array_to_string(s.kept_in, ','), '') AS kept_in,
       CASE WHEN d.text IS NULL THEN NULL ELSE sha256(coalesce(t.text, '')) END AS text_sha256
FROM d LEFT JOIN q ON d.doc_id = q.doc_id LEFT JOIN s ON d.doc_id = s.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
