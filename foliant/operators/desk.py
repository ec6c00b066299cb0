"""What stands on a reader's desk: openings of a comment in its base, anchors in a text, who cites a place, chosen parts, work left, registered files, spellings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, tokens

# The dashes that may end an opening, in the order in which they are tried, and the words that an opening has.
DASHES = [" – ", " — ", " - "]
FEWEST, MOST = 2, 12
_ANCHOR = r"<i\s[^>]*data-commentator\s*=[^>]*></i>"


def openings(comment: Column, styled: Column | None = None) -> Column:
    """Phrases of two to twelve words that may name what a comment is on, the likeliest first: the styled opening, what stands before a dash, its first clause, the first clause. Null gives none."""

    def clause(text: Column) -> Column:
        return F.when(F.contains(text, F.lit(". ")), F.substring_index(text, ". ", 1))

    def all_of(text: Column) -> Column:
        head = F.coalesce(*(F.when(F.contains(text, F.lit(dash)), F.substring_index(text, dash, 1)) for dash in DASHES))
        return let(head, lambda h: F.array(F.lit(None).cast("string") if styled is None else styled, h, clause(h), clause(text)))

    bare = F.transform(let(comment, all_of), lambda c: F.trim(F.regexp_replace(F.trim(c), "[:.،,]+$", "")))
    return F.coalesce(F.array_distinct(F.filter(bare, lambda c: F.regexp_count(c, F.lit(r"\S+")).between(FEWEST, MOST))), F.array().cast("array<string>"))


def only_span(words: Column, wanted: Column) -> Column:
    """(first, last), from 0: the one place of a run of words among words; null where it has none, or more than one."""

    def places(k: Column) -> Column:
        starts = F.when((k > 0) & (F.size(words) >= k), F.sequence(F.lit(0), F.size(words) - k)).otherwise(F.array().cast("array<int>"))
        return F.filter(starts, lambda i: F.slice(words, i + 1, k) == wanted)

    at = let(F.size(wanted), places)
    return let(at, lambda a: F.when(F.size(a) == 1, F.struct(F.get(a, F.lit(0)).alias("first"), (F.get(a, F.lit(0)) + F.size(wanted) - 1).alias("last"))))


def opening_span(base: Column, comment: Column, styled: Column | None = None) -> Column:
    """(first, last), the words of the base that a comment is on: the first of its openings that stands there exactly once; else null. A nearest match is no answer."""
    return let(tokens(base), lambda words: F.get(F.filter(F.transform(openings(comment, styled), lambda c: let(tokens(c), lambda w: only_span(words, w))), lambda s: s.isNotNull()), F.lit(0)))


def mined(text: Column) -> Column:
    """(text, anchors): a text without its empty commentary anchors, and of each (commentator, label, at), at in characters of what is left. A tag that holds something stays; a missing first quote is borne."""

    def value(tag: Column, name: str) -> Column:
        return F.nullif(F.regexp_extract(tag, name + r"\s*=\s*\"?([^\">]*)", 1), F.lit(""))

    def read(tags: Column, parts: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        walk = F.aggregate(parts, start, lambda acc, p: F.struct((acc["at"] + F.length(p)).alias("at"), F.concat(acc["all"], F.array(acc["at"] + F.length(p))).alias("all")))
        return let(walk["all"], lambda at: F.transform(tags, lambda tag, i: F.struct(value(tag, "data-commentator").alias("commentator"), value(tag, "data-label").alias("label"), F.get(at, i).alias("at"))))

    tags, parts = F.regexp_extract_all(text, F.lit(f"({_ANCHOR})"), F.lit(1)), F.split(text, _ANCHOR, -1)
    return F.struct(F.regexp_replace(text, _ANCHOR, "").alias("text"), read(tags, parts).alias("anchors"))


def citing(refs: DataFrame, places: DataFrame) -> DataFrame:
    """(ref, place) for stored refs (ref, work, from, to) that cover places (place, work, address): the same work, and no address, or one that the place's begins with, or
    a range from..to that holds it, level by level. A place meets refs by each beginning of its address, or by its first level, so no work's refs and places are all paired. Null works and addresses cover nothing."""
    points = refs.where("to IS NULL").select("ref", "work", F.col("from").alias("begin"))
    under = places.where("address IS NOT NULL").select("place", "work", F.explode(F.transform(F.expr("sequence(0, size(address))"), lambda n: F.slice("address", F.lit(1), n))).alias("begin"))
    ranges = refs.where("to IS NOT NULL AND size(from) > 0 AND from <= to").select("ref", "work", "from", "to", F.explode(F.expr("sequence(from[0], to[0])")).alias("level"))
    inside = places.where("size(address) > 0").select("place", "work", "address", F.expr("address[0]").alias("level"))
    by_range = ranges.join(inside, ["work", "level"]).where("address >= from AND address <= to")
    whole = refs.where("to IS NOT NULL AND size(from) = 0").select("ref", "work").join(places.where("address IS NOT NULL").select("place", "work"), "work")
    return reduce(DataFrame.unionByName, [points.join(under, ["work", "begin"]).select("ref", "place"), by_range.select("ref", "place"), whole.select("ref", "place")])


def chosen(segments: DataFrame, parts: DataFrame) -> DataFrame:
    """The segments (work, path, ...) in the chosen parts (work, under): an empty ``under`` is the whole work, another one takes the paths that begin with it. What a reader chose of a work is one short row."""
    by_work = parts.where("work IS NOT NULL AND under IS NOT NULL").groupBy("work").agg(F.collect_set("under").alias("_under"))
    takes = F.exists("_under", lambda u: F.slice("path", F.lit(1), F.size(u)) == u)
    return segments.join(by_work, "work").where(takes).drop("_under")


def work_left(segments: DataFrame, done: DataFrame, key: str, model: str) -> DataFrame:
    """The segments (key, text, kind, ...) that a job has still to do: no headings, pages or blanks, and none that is done (key, model) by this model. What is done is the only record, so a job that stopped goes on."""
    wanted = segments.where(~F.coalesce(F.col("kind").isin("heading", "page"), F.lit(False)) & F.coalesce(F.col("text").rlike(r"\S"), F.lit(False)))
    return wanted.join(done.where(F.col("model") == model).select(key), key, "left_anti")


def registry(registered: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """(key, outcome) of registered documents (key, changed) against files (key, changed), one row a key each: away, stale (the file is newer), fresh, or new."""
    both = registered.select(key, F.col("changed").alias("_r"), F.lit(True).alias("_in")).join(files.select(key, F.col("changed").alias("_f"), F.lit(True).alias("_there")), key, "full")
    return both.select(key, F.when(F.col("_there").isNull(), "away").when(F.col("_in").isNull(), "new").when(F.col("_r").isNull() | (F.col("_f") > F.col("_r")), "stale").otherwise("fresh").alias("outcome"))


def spelled(corpus: DataFrame, personal: DataFrame) -> DataFrame:
    """(spelling, work, works) for spellings (spelling, work) of the corpus and one's own: the one work that a spelling names, or null where it names several."""
    names = corpus.select("spelling", "work").unionByName(personal.select("spelling", "work")).where("spelling IS NOT NULL AND work IS NOT NULL").distinct()
    by = names.groupBy("spelling").agg(F.count(F.lit(1)).alias("works"), F.min("work").alias("_w"))
    return by.select("spelling", F.when(F.col("works") == 1, F.col("_w")).alias("work"), "works")


def looked_up(asked: DataFrame, works: DataFrame, places: DataFrame) -> DataFrame:
    """Readings of citations (work, address, ...) with an outcome: found, no address (the work has no such place), or not on the shelf."""
    shelf, there = works.select("work").distinct().withColumn("_w", F.lit(True)), places.select("work", "address").distinct().withColumn("_p", F.lit(True))
    out = asked.join(shelf, "work", "left").join(there, ["work", "address"], "left")
    return out.withColumn("outcome", F.when(F.col("_p"), "found").when(F.col("_w"), "no address").otherwise("not on the shelf")).drop("_w", "_p")


def holding(collections: DataFrame, member: Column, tag: str | None = None) -> DataFrame:
    """The collections (members, tags, ...) that hold a member and, if asked, bear a tag."""
    held = collections.where(F.array_contains("members", member))
    return held if tag is None else held.where(F.array_contains("tags", tag))
