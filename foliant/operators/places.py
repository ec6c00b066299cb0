"""Places and what belongs to them: citations, parallel reading, links at a place, contents, companions' verdicts, lenses, marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import cut


def prefixes(address: Column) -> Column:
    """All leading parts of an address whose levels a colon parts, the address included."""
    parts = F.split(address, ":")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), ":"))


def resolve(asked: DataFrame, places: DataFrame) -> DataFrame:
    """asked (work, key) with first, last (the least and greatest ordinal at or below the address), n and outcome: resolved, no address, or no work.

    A place counts under each leading part of its address, so the range join is an equi-join whose rows are the levels of addresses.
    """
    at = places.select("work", F.explode(prefixes(F.col("address"))).alias("key"), "ord")
    found = at.groupBy("work", "key").agg(F.min("ord").alias("first"), F.max("ord").alias("last"), F.count(F.lit(1)).alias("n"))
    works = places.select("work", F.lit(True).alias("_work")).distinct()
    out = asked.join(found, ["work", "key"], "left").join(works, "work", "left")
    outcome = F.when(F.col("n").isNotNull(), "resolved").when(F.col("_work"), "no address").otherwise("no work")
    return out.select(*asked.columns, "first", "last", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), outcome.alias("outcome"))


def followed(lines: DataFrame, base: DataFrame) -> DataFrame:
    """lines (line, address) with the base's place at the longest leading part of the address that the base has: (line, address, place, levels), null where it has none."""
    tried = lines.select("line", "address", F.posexplode(prefixes(F.col("address"))).alias("n", "key"))
    first = base.groupBy(F.col("address").alias("key")).agg(F.min("ord").alias("place"))
    hit = tried.join(first, "key").groupBy("line").agg(F.max_by("place", "n").alias("place"), (F.max("n") + 1).cast("int").alias("levels"))
    return lines.join(hit, "line", "left").select("line", "address", "place", "levels")


def touching(ends: DataFrame, spans: DataFrame, bucket: int = 256) -> DataFrame:
    """(asked, edge_no) for each edge end (work, from_ord, to_ord or null for a point, edge_no) that overlaps a span asked for (asked, work, lo, hi). An interval join by
    buckets of ordinals: a pair is made in the first bucket that both are in, so none is made twice."""
    hi = F.coalesce("to_ord", "from_ord")
    e = ends.select("work", "edge_no", "from_ord", hi.alias("to_"), F.explode(F.sequence(F.floor(F.col("from_ord") / bucket), F.floor(hi / bucket))).alias("b"))
    s = spans.select("asked", "work", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / bucket), F.floor(F.col("hi") / bucket))).alias("b"))
    both = s.join(e, ["work", "b"]).where((F.col("from_ord") <= F.col("hi")) & (F.col("to_") >= F.col("lo")))
    return both.where(F.col("b") == F.floor(F.greatest("from_ord", "lo") / bucket)).select("asked", "edge_no")


def touching_counts(ends: DataFrame, spans: DataFrame, bucket: int = 256) -> DataFrame:
    """(asked, n): how many edge ends ``touching`` gives each span that it gives any, without making the pairs. Of the ends of a work, those that begin by a span's end less those that end before it
    begins overlap it; both are running sums over the ordinals that occur, within a bucket of them and over the buckets before. What runs backwards (an end or a span) is joined as ``touching`` does."""
    e = ends.where("work IS NOT NULL AND from_ord IS NOT NULL").groupBy("work", "from_ord", F.coalesce("to_ord", "from_ord").alias("to_ord")).agg(F.count(F.lit(1)).alias("edge_no"))
    e = cut(e, "touching-ends")
    s = spans.where("lo <= hi")
    # One row for either side of an end and of a span: what begins there, what ends there.
    sides = lambda *of: F.explode(F.array(*(F.struct(F.col(o).cast("long").alias("ord"), F.lit(k).alias("side")) for k, o in enumerate(of)))).alias("at")
    asked = s.select("asked", "work", sides("hi", "lo")).select("asked", "work", "at.*")
    marks = e.where("from_ord <= to_ord").select("work", "edge_no", sides("from_ord", "to_ord")).select("work", "at.ord", *(F.when(F.col("at.side") == k, F.col("edge_no")).otherwise(0).alias(n) for k, n in enumerate(("begun", "over"))))
    marks = marks.unionByName(asked.select("work", "ord", F.lit(0).cast("long").alias("begun"), F.lit(0).cast("long").alias("over")))
    marks = marks.groupBy("work", "ord").agg(F.sum("begun").alias("begun"), F.sum("over").alias("over")).withColumn("b", F.floor(F.col("ord") / bucket))
    within, before = Window.partitionBy("work", "b").orderBy("ord"), Window.partitionBy("work").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    here = marks.select("work", "ord", "b", F.sum("begun").over(within).alias("begun"), (F.sum("over").over(within) - F.col("over")).alias("over"))
    by_bucket = marks.groupBy("work", "b").agg(F.sum("begun").alias("begun"), F.sum("over").alias("over"))
    by_bucket = by_bucket.select("work", "b", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("begun", "over")))
    sums = here.join(by_bucket, ["work", "b"]).select("work", "ord", (F.col("begun") + F.col("begun_before")).alias("begun"), (F.col("over") + F.col("over_before")).alias("over"))
    out = asked.join(sums, ["work", "ord"]).select("asked", F.when(F.col("side") == 0, F.col("begun")).otherwise(-F.col("over")).alias("n"))
    for those, of in ((e.where("from_ord > to_ord"), spans), (e.where("from_ord <= to_ord"), spans.where("lo > hi"))):
        if not those.isEmpty() and not of.isEmpty():
            out = out.unionByName(touching(those, of, bucket).select("asked", F.col("edge_no").alias("n")))
    return out.groupBy("asked").agg(F.sum("n").alias("n")).where("n > 0")


def contents(segments: DataFrame, work: str, order: str, section: str) -> DataFrame:
    """(work, order, section): where a section first begins in reading order."""
    before = F.lag(section).over(Window.partitionBy(work).orderBy(order))
    return segments.withColumn("_b", before).where(F.col(section).isNotNull() & ~F.col(section).eqNullSafe(F.col("_b"))).select(work, order, section)


def verdict(declared: Column, edges: Column, same: Column, from_edges: int = 12, from_same: int = 25) -> Column:
    """The relation of two works: declared, parallel (so many equal numbers), linked (so many edges), or apart."""
    return F.when(F.coalesce(declared, F.lit(False)), "declared").when(F.coalesce(same, F.lit(0)) >= from_same, "parallel").when(F.coalesce(edges, F.lit(0)) >= from_edges, "linked").otherwise("apart")


def lens(edges: DataFrame, least: float = 0.0, types: list[str] = (), eras: list[str] = (), mine: bool = False) -> DataFrame:
    """The edges that pass all tests of a lens; an empty list passes all, and a missing era fails a list of eras."""
    out = edges.where(F.col("confidence") >= least)
    if types:
        out = out.where(F.col("edge_type").isin(*types))
    if eras:
        out = out.where(F.coalesce(F.col("era").isin(*eras), F.lit(False)))
    return out.where(F.col("mine")) if mine else out


def commentators(edges: DataFrame) -> DataFrame:
    """(work, ord, works): the works that comment on each place."""
    on = edges.where(F.col("edge_type") == "comments-on")
    return on.groupBy(F.col("dst_work").alias("work"), F.col("dst_ord").alias("ord")).agg(F.array_sort(F.collect_set("src_work")).alias("works"))


def mark_state(text: Column, begin: Column, was: Column) -> Column:
    """exact, moved (one other occurrence) or lost."""
    from ..functions.text import located

    at = located(text, begin, was)
    return F.when(at == begin, "exact").when(at.isNotNull(), "moved").otherwise("lost")


def agreeing_tags(tags: DataFrame) -> DataFrame:
    """(tag, kind, n): tags that are equal when normalised are one, under the spelling that comes first."""
    key = F.lower(F.trim("tag"))
    return tags.groupBy(key.alias("_k"), "kind").agg(F.min_by("tag", "at").alias("tag"), F.count(F.lit(1)).alias("n")).select("tag", "kind", "n")
