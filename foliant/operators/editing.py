"""What a reader changes and keeps: corrections taken and taken back, segments split and merged, an arranged shelf, notes on a place, an exported text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import FINALS, FOLDED


def added(held: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (segment, id, begin, end, was, now) with an outcome, each on its own against what is ``held`` (segment, id, begin, end): no span, no change, had (its id is
    held), clash (it claims letters that another correction claims), taken. Corrections that are held do not overlap, so the last that begins before the end of the one asked for
    is the only one to look at: an as-of over a union, not pairs."""
    ids = held.select("segment", "id", F.lit(True).alias("_had")).distinct()
    rows = asked.join(ids, ["segment", "id"], "left").withColumn("_at", F.col("end")).withColumn("_s", F.lit(0))
    both = rows.unionByName(held.select("segment", F.col("begin").alias("_at"), F.col("end").alias("_h"), F.lit(1).alias("_s")), allowMissingColumns=True)
    before = Window.partitionBy("segment").orderBy("_at", "_s").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_l", F.last("_h", ignorenulls=True).over(before)).where("_s = 0")
    outcome = F.when(F.col("begin") >= F.col("end"), "no span").when(F.col("was") == F.col("now"), "no change").when(F.col("_had"), "had").when(F.col("_l") > F.col("begin"), "clash").otherwise("taken")
    return out.withColumn("outcome", outcome).select(*asked.columns, "outcome")


def taken_back(held: DataFrame, asked: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(what stays of ``held``, ``asked`` with an outcome: gone, or not held)."""
    there = held.select(*key, F.lit(True).alias("_h")).distinct()
    outcome = F.when(F.col("_h"), "gone").otherwise("not held").alias("outcome")
    return held.join(asked.select(*key), key, "left_anti"), asked.join(there, key, "left").select(*asked.columns, outcome)


def split_at(segments: DataFrame, cuts: DataFrame) -> DataFrame:
    """Segments (id, text, ...) with those in ``cuts`` (id, at: one row each) replaced by two children, id.1 and id.2, and ``of``, the segment that a child redirects from. ``at`` counts code points and is kept within the text."""
    rows = segments.join(cuts.select("id", "at"), "id", "left")
    at = F.least(F.greatest("at", F.lit(0)), F.length("text"))
    child = lambda n, text: F.struct(F.concat("id", F.lit(f".{n}")).alias("id"), text.alias("text"), F.col("id").alias("of"))
    whole = F.struct("id", "text", F.lit(None).cast("string").alias("of"))
    parts = F.when(F.col("at").isNull(), F.array(whole)).otherwise(F.array(child(1, F.substring("text", F.lit(1), at)), child(2, F.substring("text", at + 1, F.length("text")))))
    rest = [c for c in segments.columns if c not in ("id", "text")]
    return rows.select(*rest, F.explode(parts).alias("p")).select("p.*", *rest)


def merged_with_next(segments: DataFrame, asked: Column, work: str, order: str, text: str) -> DataFrame:
    """(work, order, text, merged): each segment for which ``asked`` holds is joined with the one after it in the work; the earlier keeps its place and ``merged`` lists the places that redirect to it.
    Runs join as one, and a work's last segment has nothing to join."""
    w = Window.partitionBy(work).orderBy(order)
    joins = F.coalesce(F.lag(F.coalesce(asked, F.lit(False))).over(w), F.lit(False))
    rows = segments.select(work, order, text, joins.alias("_j")).withColumn("_g", F.max(F.when(~F.col("_j"), F.col(order))).over(w))
    all_ = rows.groupBy(work, "_g").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(text, F.lit("")).alias("t")))).alias("p"))
    return all_.select(work, F.col("_g").alias(order), F.array_join("p.t", "").alias(text), F.slice("p.o", F.lit(2), F.greatest(F.size("p") - 1, F.lit(0))).alias("merged"))


def arranged(works: DataFrame, moves: DataFrame, order: DataFrame) -> DataFrame:
    """(slug, shelf, place): works (slug, shelf, rank) on the shelf where the reader put them (moves: slug, shelf), the ones that the reader ordered (order: shelf, slug, no) first, the others in the shipped order after them."""
    rows = works.join(moves.select("slug", F.col("shelf").alias("_to")), "slug", "left").select("slug", F.coalesce("_to", "shelf").alias("shelf"), "rank")
    rows = rows.join(order, ["shelf", "slug"], "left")
    return rows.select("slug", "shelf", F.row_number().over(Window.partitionBy("shelf").orderBy(F.asc_nulls_last("no"), "rank", "slug")).alias("place"))


def suggested(printed: Column, common: Column) -> Column:
    """The common spelling as it would be printed: its last letter in the final form if what it replaces ends in one; null where the printed word bears marks, which a spelling has not."""
    last = F.right(printed, F.lit(1))
    fixed = F.when(last.isin(*FINALS), F.concat(F.expr("''"), F.left(common, F.length(common) - 1), F.translate(F.right(common, F.lit(1)), FOLDED, FINALS))).otherwise(common)
    return F.when(~printed.rlike("[֑-ֽֿׁ-ׂׄ-ׇׅ]") & (F.length(common) > 0), fixed)


def on_place(rows: DataFrame, work, first: int, last: int) -> DataFrame:
    """What touches the places first..last of a work; a row without a place is about the whole work and counts. One filter, pushed to the scan."""
    return rows.where((F.col("work") == work) & (F.col("from_ord").isNull() | ((F.col("from_ord") <= last) & (F.coalesce("to_ord", "from_ord") >= first))))


def everything_on(kinds: dict[str, DataFrame], work, first: int, last: int) -> DataFrame:
    """(kind, id, from_ord): everything of one's own on a place, kind by kind."""
    out = None
    for kind, rows in kinds.items():
        part = on_place(rows, work, first, last).select(F.lit(kind).alias("kind"), F.col("id"), F.col("from_ord"))
        out = part if out is None else out.unionByName(part)
    return out


def tree(works: DataFrame, shelf: Column) -> DataFrame:
    """(shelf, depth, works) of every shelf with what hangs under it, by paths with ``/``: each work counts under each beginning of its path, added up before the shuffle."""
    parts = F.filter(F.split(shelf, "/"), lambda p: p != "")
    up = F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("_p"), F.lit(1))), lambda n: F.slice("_p", F.lit(1), n)))
    rows = works.select(parts.alias("_p")).where("size(_p) > 0").select(up.alias("_u"))
    return rows.groupBy(F.array_join("_u", "/").alias("shelf")).agg(F.max(F.size("_u")).alias("depth"), F.count(F.lit(1)).alias("works"))


def under(works: DataFrame, shelf: Column, wanted: str) -> DataFrame:
    """The works on a shelf or under it; a shelf whose name only begins alike is another one."""
    return works.where((shelf == wanted) | shelf.startswith(wanted + "/"))


def printed_names(ids: DataFrame, works: DataFrame) -> DataFrame:
    """Ids (work, path) with the name that is printed: the work's title and its path with spaces; the id itself where the work is not on the shelf."""
    there = ids.join(works.select("work", "title"), "work", "left")
    path = F.array_join("path", " ")
    return there.select(*ids.columns, F.when(F.col("title").isNull(), F.concat_ws("#", F.col("work").cast("string"), F.array_join("path", ":"))).otherwise(F.concat_ws(" ", "title", F.nullif(path, F.lit("")))).alias("printed"))


def exported(rows: DataFrame, path: str, by: str) -> DataFrame:
    """Writes the shown lines (``by``, ord, text, applied, stale) as text, one folder a work and blank lines dropped; returns (``by``, lines, applied, stale). Rows are sorted by ranges, so a long work is several files in order."""
    kept = rows.where(F.coalesce(F.length(F.trim("text")) > 0, F.lit(False)))
    kept.repartitionByRange(by, "ord").sortWithinPartitions(by, "ord").select(by, "text").write.partitionBy(by).text(path)
    blank = F.coalesce(F.length(F.trim("text")) > 0, F.lit(False))
    return rows.groupBy(by).agg(F.count_if(blank).alias("lines"), F.sum("applied").cast("bigint").alias("applied"), F.sum("stale").cast("bigint").alias("stale"))


def companions(declared: DataFrame, found: DataFrame) -> DataFrame:
    """(work, declared, n) of the works that go with one: those that its catalogue declares (work) and those that links show (work, n), in one list; ``shelf.placed`` by declared, n and work gives its order."""
    both = declared.select("work", F.lit(True).alias("_d")).distinct().join(found.groupBy("work").agg(F.sum("n").alias("n")), "work", "full")
    return both.select("work", F.coalesce("_d", F.lit(False)).alias("declared"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def folders(edges: DataFrame, base: str, works: DataFrame) -> DataFrame:
    """(shelf, depth, works): the commentators on a work by the shelves (work, shelf) on which they stand; those on no shelf are in no folder."""
    on = edges.where((F.col("edge_type") == "comments-on") & (F.col("dst_work") == base)).select(F.col("src_work").alias("work")).distinct()
    return tree(on.join(works, "work"), F.col("shelf"))


def layers_out(kinds: dict[str, DataFrame], path: str) -> None:
    """Writes one's own records of each kind as JSON, a folder a kind; a kind without records has none."""
    for kind, rows in kinds.items():
        rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.text(f"{path}/kind={kind}")


def layers_in(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records by kind, lines that are none) of what ``layers_out`` wrote."""
    lines = spark.read.schema("value string, kind string").text(path).withColumn("r", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    return lines.where("r._bad IS NULL").select("kind", "r.*").drop("_bad"), lines.where("r._bad IS NOT NULL").select("kind", "value")
