"""Orders, narrowing, queues and small tables of a library."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import WORD, let


def placed(rows: DataFrame, *order: Column, most: int | None = None) -> DataFrame:
    """``rows`` with ``place`` (from 1) in an order, the first ``most`` of them; one sort of what a list shows."""
    top = rows.orderBy(*order).limit(most) if most else rows
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def shelf_order(declared: Column, title: Column, slug: Column) -> tuple[Column, ...]:
    """Works with a declared order first, by it; then by title, then by slug."""
    return F.when(declared.isNull(), 1).otherwise(0), declared, title, slug


def link_order(kind: Column, confidence: Column, title: Column, place: Column) -> tuple[Column, ...]:
    """Commentary first, then the surer, then by type, title and place."""
    return F.when(kind == "comments-on", 0).otherwise(1), F.desc_nulls_last(confidence), kind, title, place


def facet_order(n: Column, depth: Column, key: Column) -> tuple[Column, ...]:
    return F.desc_nulls_last(n), depth, key


def passage(rows: DataFrame, order: str, first: int, last: int, most: int) -> DataFrame:
    """The places from ``first`` to ``last``, both included, ``most`` of them from the first."""
    return rows.where(F.col(order).between(first, min(last, first + most - 1)))


def typed_links(masks: DataFrame, types: list[str], any_of: list[str] = (), none_of: list[str] = ()) -> DataFrame:
    """Masks that have any of some types, if any are named, and none of others."""
    bits = lambda names: sum(1 << types.index(n) for n in names)
    out = masks.where(F.col("mask").bitwiseAND(F.lit(bits(any_of))) != 0) if any_of else masks
    return out.where(F.col("mask").bitwiseAND(F.lit(bits(none_of))) == 0) if none_of else out


def narrowed(candidates: DataFrame, key: str, fits: Column) -> DataFrame:
    """Of each key's candidates those that fit; all, where none does."""
    w = Window.partitionBy(key)
    return candidates.withColumn("_f", F.coalesce(fits, F.lit(False))).withColumn("_any", F.bool_or("_f").over(w)).where("_f OR NOT _any").drop("_f", "_any")


def settled(candidates: DataFrame, works: DataFrame, places: DataFrame) -> DataFrame:
    """Candidates (citation, work, address) that resolve, and those of works that are not known; outcome and how many are left for each citation."""
    known = candidates.join(works.select("work", F.lit(True).alias("_w")).distinct(), "work", "left").join(places.select("work", "address", F.lit(True).alias("_p")).distinct(), ["work", "address"], "left")
    left = known.where("_w IS NULL OR _p").select("citation", "work", "address", F.when(F.col("_p"), "resolves").otherwise("unknown work").alias("outcome"))
    return left.withColumn("left", F.count(F.lit(1)).over(Window.partitionBy("citation")))


def queue(imported: DataFrame, citation: str) -> DataFrame:
    """(citation, n): how often each ambiguous citation occurs."""
    return imported.where("reason = 'ambiguous'").groupBy(F.col(citation).alias("citation")).agg(F.count(F.lit(1)).alias("n"))


def refreshed(queue: DataFrame, decided: DataFrame, key: str) -> DataFrame:
    """(key, decision, state): open or decided rows of the queue, and decided ones that have vanished from it, which stay."""
    out = queue.select(key, F.lit(True).alias("_q")).join(decided.select(key, "decision"), key, "full")
    return out.select(key, "decision", F.when(F.col("_q").isNull(), "vanished").when(F.col("decision").isNull(), "open").otherwise("decided").alias("state"))


def suggestions(titles: DataFrame, title: str, typed: str, most: int = 8, far: int = 3) -> DataFrame:
    """(title, distance, cut): the nearest spellings, and how many more there are."""
    near = titles.select(F.lower(title).alias("title")).distinct().withColumn("distance", F.levenshtein("title", F.lit(typed.lower()))).where(F.col("distance") <= far)
    total = near.agg(F.count(F.lit(1)).alias("total"))  # one row
    return near.orderBy("distance", "title").limit(most).crossJoin(F.broadcast(total)).select("title", "distance", F.greatest(F.col("total") - most, F.lit(0).cast("long")).alias("cut"))


def line_links(links: DataFrame, segments: DataFrame) -> DataFrame:
    """Links by line number (edge_no, work, line) with the segment that the line is: line n is a work's nth line, from 1; reason imported, no work or no line."""
    works = segments.select("work", F.lit(True).alias("_w")).distinct()
    out = links.join(segments.select("work", "line", "segment"), ["work", "line"], "left").join(works, "work", "left")
    return out.select("edge_no", "work", "line", "segment", F.when(F.col("segment").isNotNull(), "imported").when(F.col("_w"), "no line").otherwise("no work").alias("reason"))


def landings(ends: DataFrame, by: str) -> DataFrame:
    """Ends (``by``, from_ord, to_ord or null) with their place in the work's landing file: runs first, then points, by ordinal. Every row stays."""
    run = F.coalesce(F.col("to_ord") > F.col("from_ord"), F.lit(False))
    return ends.withColumn("landing", F.row_number().over(Window.partitionBy(by).orderBy(F.when(run, 0).otherwise(1), "from_ord", "edge_no")))


def marker_density(edges: DataFrame, chosen: list[str]) -> DataFrame:
    """(work, ord, n): how many of the chosen works comment on each place."""
    on = edges.where((F.col("edge_type") == "comments-on") & F.col("src_work").isin(*chosen))
    return on.groupBy(F.col("dst_work").alias("work"), F.col("dst_ord").alias("ord")).agg(F.count_distinct("src_work").alias("n"))


def corpus_counts(docs: DataFrame) -> DataFrame:
    """works, documents, segments, headings (lines that begin with #), empty and missing texts."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    return docs.agg(
        F.count_distinct("source").alias("works"), F.count(F.lit(1)).alias("documents"), F.sum(F.size(F.filter(lines, lambda x: x != ""))).cast("bigint").alias("segments"),
        F.sum(F.size(F.filter(lines, lambda x: x.startswith("#")))).cast("bigint").alias("headings"), F.count_if(F.col("text") == "").alias("empty"), F.count_if(F.col("text").isNull()).alias("missing"))


def highlights(line: Column, takes) -> Column:
    """(begin, end) of each word that ``takes``, in code points from 0."""

    def spans(parts: Column) -> Column:
        words, gaps = parts["words"], parts["gaps"]
        ends = F.transform(words, lambda w, i: F.aggregate(F.slice(words, F.lit(1), i + 1), F.lit(0), lambda a, x: a + F.length(x)) + F.aggregate(F.slice(gaps, F.lit(1), i + 1), F.lit(0), lambda a, x: a + F.length(x)))
        both = F.zip_with(words, ends, lambda w, e: F.struct((e - F.length(w)).alias("begin"), e.alias("end"), F.lower(w).alias("word")))
        return F.transform(F.filter(both, lambda s: takes(s["word"])), lambda s: F.struct(s["begin"].alias("begin"), s["end"].alias("end")))

    return let(F.struct(F.regexp_extract_all(line, F.lit(f"({WORD})"), F.lit(1)).alias("words"), F.split(line, WORD, -1).alias("gaps")), spans)


def occurrences(text: Column, wanted: str) -> Column:
    """Where (from 0) a string stands in the lower-case text; occurrences do not overlap."""
    parts = lambda p: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda x, i: (F.aggregate(F.slice(p, F.lit(1), i + 1), F.lit(0), lambda a, y: a + F.length(y)) + i * len(wanted)).cast("int"))
    return let(F.split(F.lower(text), re.escape(wanted), -1), parts)


def punctuated(word: str) -> str:
    """A pattern for a word with quote signs between its letters."""
    return "(?i)(^|[^\\p{L}\\p{N}])" + "['\"’”]?".join(map(re.escape, word)) + "([^\\p{L}\\p{N}]|$)"


def corrected(texts: DataFrame, layers: list[DataFrame], key: str = "segment") -> DataFrame:
    """Texts (key, text) under the first layer of whole-line corrections (key, was, now) that applies: its ``was`` is the text. ``stale`` counts those that do not."""
    out = texts
    for i, layer in enumerate(layers):
        out = out.join(layer.select(key, F.col("was").alias(f"_w{i}"), F.col("now").alias(f"_n{i}")), key, "left")
    fits = [F.coalesce(F.col(f"_w{i}") == F.col("text"), F.lit(False)) for i in range(len(layers))]
    now = F.coalesce(*(F.when(f, F.col(f"_n{i}")) for i, f in enumerate(fits)), F.col("text"))
    stale = reduce(lambda a, b: a + b, (F.when(F.col(f"_w{i}").isNotNull() & ~f, 1).otherwise(0) for i, f in enumerate(fits)))
    return out.select(key, now.alias("text"), stale.alias("stale"))


def base_place(at: Column, begin: Column, was: Column, now: Column) -> Column:
    """A place in a text that one patch has changed, in the text before; null inside the patch."""
    return F.when(at < begin, at).when(at >= begin + F.length(now), at - F.length(now) + F.length(was))


def kept_number(address: Column) -> Column:
    """The first level of an address that is a number; a level of letters and digits is none."""
    return F.get(F.filter(F.split(address, ":"), lambda x: x.rlike(r"^\d+$")), F.lit(0)).cast("bigint")


def boxes_touch(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """covers, overlaps or apart, for boxes (x0, y0, x1, y1); edges that only touch are apart."""
    inside = (a[0] <= b[0]) & (a[1] <= b[1]) & (a[2] >= b[2]) & (a[3] >= b[3])
    return F.when(inside, "covers").when((a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3]), "overlaps").otherwise("apart")


def substituted(text: Column, table: dict[str, str]) -> Column:
    """Whole words written another way."""
    for word, other in table.items():
        text = F.regexp_replace(text, rf"(?<![\p{{L}}\p{{N}}]){word}(?![\p{{L}}\p{{N}}])", other)
    return text


def fingerprint(*parts: Column) -> Column:
    """A stable id of content: SHA-256 of its parts, a null told from an empty one."""
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-")) if i == 0 else F.concat(F.lit("\n"), F.coalesce(F.concat(F.lit("="), p.cast("string")), F.lit("-"))) for i, p in enumerate(parts))), 256)


def shelved(works: DataFrame, category: str, shelves: DataFrame) -> DataFrame:
    """Works with the shelf (prefix, shelf, rank) of the longest prefix of their category, null where none fits; an equi-join on the leading parts of the categories."""
    keys = works.select(category).distinct().withColumn("_p", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(category), F.lit(1))), lambda n: F.left(F.col(category), n))))
    best = keys.join(shelves.withColumnRenamed("prefix", "_p"), "_p").groupBy(category).agg(F.max_by(F.struct("shelf", "rank"), F.length("_p")).alias("_s"))
    return works.join(best, category, "left").select(*works.columns, "_s.shelf", "_s.rank")


def named_sections(labels: DataFrame, label: str) -> DataFrame:
    """(slug, n, outcome): the labels that have one slug when written plainly; one, or ambiguous."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(label), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    out = labels.select(F.col(label).alias("label"), slug.alias("slug")).distinct().groupBy("slug").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("label"))
    return out.select("slug", "n", "label", F.when(F.col("n") > 1, "ambiguous").otherwise("one").alias("outcome"))


def asked_lanes(vectors: DataFrame, score: Column, work: str, id_col: str, per: int, most: int) -> DataFrame:
    """(work, id, score): the best of each work, then the best of these."""
    rows = vectors.select(F.col(work).alias("work"), F.col(id_col).alias("id"), score.alias("score"))
    best = rows.withColumn("_n", F.row_number().over(Window.partitionBy("work").orderBy(F.desc("score"), "id"))).where(F.col("_n") <= per).drop("_n")
    return best.orderBy(F.desc("score"), "id").limit(most)


def chains(steps: DataFrame, edges: DataFrame, start: str, depth: int, asserted: int = 3) -> DataFrame:
    """(end, path, weakest, is_transmission) of each chain of a trace (node, parent, level, edge_no): an end is a node that no other comes from; weakest is the greatest type number on the way, and all
    types below ``asserted`` are asserted. One join a level, at most ``depth``; the trace is bounded by its width."""
    ways = edges.select("edge_no", F.col("a").alias("node"), F.col("b").alias("parent"), "type_no").unionByName(edges.select("edge_no", F.col("b").alias("node"), F.col("a").alias("parent"), "type_no"))
    typed = steps.join(ways, ["edge_no", "node", "parent"])
    front = typed.where("level = 1").select(F.col("node").alias("end"), F.array(F.lit(start), F.col("node")).alias("path"), F.col("type_no").alias("weakest"))
    levels = [front]
    for n in range(2, depth + 1):
        more = typed.where(F.col("level") == n).select("node", "parent", "type_no")
        front = front.join(more, front["end"] == more["parent"]).select(F.col("node").alias("end"), F.concat("path", F.array("node")).alias("path"), F.greatest("weakest", "type_no").alias("weakest"))
        levels.append(front)
    all_ = reduce(DataFrame.unionByName, levels).join(steps.select(F.col("parent").alias("end")).distinct(), "end", "left_anti")
    return all_.select("end", F.array_join("path", " > ").alias("path"), "weakest", (F.col("weakest") < asserted).alias("is_transmission"))


def variants_of(words: list[str], table: dict[str, list[str]]) -> tuple[tuple[str, ...], ...]:
    """The forms of each position: the word itself first, then its variants."""
    return tuple(tuple(dict.fromkeys([w, *table.get(w, [])])) for w in words)


def asserted(kind: Column, method: Column, verdict: Column) -> tuple[Column, Column]:
    """(asserted: all but references; curated: asserted, confirmed or drawn by the user, and not rejected)."""
    is_ = kind != "references"
    fine = F.coalesce(verdict != "rejected", F.lit(True))
    return is_, (is_ | F.coalesce(verdict == "confirmed", F.lit(False)) | (method == "mine")) & fine

