"""Retrieval over segments: hits, totals, ranking, facets, scopes, offers to widen a search, quotations."""

from __future__ import annotations

import re
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import let, tokens
from ..plans.search_plan import SearchPlan


def segments(docs: DataFrame) -> DataFrame:
    """A row for each line of a document; its name is (doc_id, line_no)."""
    return docs.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).where(F.length("line") > 0)


def hits(segs: DataFrame, plan: SearchPlan) -> DataFrame:
    """The segments that a plan finds, with their words. No shuffle: each segment is judged by itself."""
    gated = segs.where(plan.gate(F.lower("line"))).withColumn("words", tokens(F.col("line")))
    return gated.where(plan.matches(F.col("words")))


def totals(found: DataFrame, by: str = "source") -> DataFrame:
    return found.groupBy(by).agg(F.count(F.lit(1)).alias("hits"))


def postings(segs: DataFrame) -> DataFrame:
    """(term, doc_id, line_no, tf, positions, length): the inverted index."""
    words = segs.withColumn("words", tokens(F.col("line")))
    each = words.select("doc_id", "line_no", F.size("words").alias("length"), F.posexplode("words").alias("pos", "term"))
    return each.groupBy("term", "doc_id", "line_no", "length").agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def _write(segs: DataFrame, path: str, buckets: int, batch: str, **options: str) -> None:
    out = postings(segs).withColumns({"bucket": F.expr(f"CAST(pmod(xxhash64(term), {buckets}) AS INT)"), "batch": F.lit(batch)})
    out.repartition(buckets, "bucket").sortWithinPartitions("term", "doc_id", "line_no").write.mode("overwrite").options(**options).partitionBy("batch", "bucket").parquet(path)


def write_index(segs: DataFrame, path: str, buckets: int = 64) -> None:
    """The postings alone, by bucket of the term, sorted in it, so that a term's rows lie in few row groups; a new table. ``operators.index`` writes and searches an index with its vocabulary."""
    _write(segs, path, buckets, "all")


def absorb(segs: DataFrame, path: str, buckets: int = 64, batch: str = "more") -> None:
    """Adds the postings of a batch of segments; a batch that is written again replaces itself, so a replay doubles nothing."""
    _write(segs, path, buckets, batch, partitionOverwriteMode="dynamic")


def vocabulary(segs: DataFrame) -> DataFrame:
    """(term, df, cf): segments that have a word, and its occurrences. Words are counted in each segment before they are shuffled."""
    # In a sorted array a word's occurrences are a run; where runs begin gives its count.
    begins = lambda s: F.filter(F.transform(s, lambda x, i: i), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    runs = lambda s: let(begins(s), lambda b: F.transform(b, lambda x, k: F.struct(F.get(s, x).alias("term"), (F.coalesce(F.get(b, k + 1), F.size(s)) - x).cast("long").alias("tf"))))
    each = segs.select(F.explode(let(F.array_sort(tokens(F.col("line"))), runs)).alias("e"))
    return each.select("e.*").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def expand(vocab: DataFrame, plan: SearchPlan) -> DataFrame:
    """The words of a vocabulary that the first position of a plan takes."""
    return vocab.where(plan.term(F.col("term"), plan.words[0]))


def ranked(segs: DataFrame, words: list[str], size: int = 100, offset: int = 0, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """A page of the segments with all words, best first by BM25, ties by name. One pass gives the statistics, which are three numbers and one a word."""
    cut = segs.withColumn("words", tokens(F.col("line")))
    has = [F.array_contains("words", w) for w in words]
    stats = cut.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("words")).alias("avg"), *(F.count_if(h).alias(f"df{i}") for i, h in enumerate(has)))
    found = hits(segs, SearchPlan(tuple((w,) for w in words))).crossJoin(F.broadcast(stats))  # one row
    score: Column = F.lit(0.0)
    for i, w in enumerate(words):
        tf = F.size(F.filter("words", F.lit(w).eqNullSafe))
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.size("words") / F.col("avg")))
    rows = found.select("doc_id", "line_no", F.round(score, 6).alias("score"))
    return rows.orderBy(F.desc("score"), "doc_id", "line_no").offset(offset).limit(size)


def scoped(found: DataFrame, only: list[DataFrame] = (), without: list[DataFrame] = (), key: str = "doc_id") -> DataFrame:
    """Within one question any, across questions all, less the exclusions; an empty list of questions is everything, an empty question nothing."""
    found = reduce(lambda x, y: x.join(y.select(key).distinct(), key, "left_semi"), only, found)
    return reduce(lambda x, y: x.join(y.select(key).distinct(), key, "left_anti"), without, found)


def facets(found: DataFrame, catalogue: DataFrame, tags: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(dimension, key, depth, n) over the whole result: work, shelf (each prefix), era, author, tag and link. A missing era is the key ``''``, a missing
    author no row; hits outside the catalogue are counted by themselves; without ``links`` there is a row of the dimension ``link`` that says so."""
    per = found.groupBy("doc_id", "source").agg(F.count(F.lit(1)).alias("n"))
    known = per.join(catalogue, "source", "left")
    dim = lambda rows, name, key, depth: rows.groupBy(key.alias("key"), depth.alias("depth")).agg(F.sum("n").alias("n")).select(F.lit(name).alias("dimension"), "key", "depth", "n")
    one = F.lit(1)
    inside = known.where(F.col("known"))
    shelf = inside.withColumn("d", F.explode(F.sequence(F.lit(1), F.size("shelf")))).withColumn("key", F.expr("array_join(slice(shelf, 1, d), '/')"))
    parts = [
        dim(inside, "work", F.col("source"), one), dim(shelf, "shelf", F.col("key"), F.col("d")), dim(inside, "era", F.coalesce("era", F.lit("")), one),
        dim(inside.where(F.col("author").isNotNull()), "author", F.col("author"), one), dim(per.join(tags, "doc_id"), "tag", F.col("tag"), one),
        dim(known.where(F.col("known").isNull()), "uncatalogued", F.lit(""), one),
    ]
    if links is None:
        parts.append(found.sparkSession.range(1).select(F.lit("link").alias("dimension"), F.lit("not built").alias("key"), one.alias("depth"), F.lit(None).cast("bigint").alias("n")))
    else:
        parts.append(dim(per.join(links, "doc_id"), "link", F.col("edge_type"), one))
    return reduce(DataFrame.unionByName, parts)


def offers(segs: DataFrame, plan: SearchPlan, near: int = 5) -> DataFrame:
    """(rung, n): what each way to widen a search would find, all in one pass; offered only if the search itself finds nothing. Nothing is widened by itself."""
    rungs = {"prefixes": replace(plan, match="prefix"), "contains": replace(plan, match="contains"), "letters": replace(plan, match="letters")}
    if len(plan.words) > 1:
        rungs |= {"near": replace(plan, shape="near", slop=near), "anywhere": replace(plan, shape="anywhere")}
    words = segs.select(tokens(F.col("line")).alias("words"))
    counted = words.agg(F.count_if(plan.matches(F.col("words"))).alias("literal"), *(F.count_if(p.matches(F.col("words"))).alias(n) for n, p in rungs.items()))
    rows = counted.select(F.col("literal"), F.explode(F.array(*(F.struct(F.lit(n).alias("rung"), F.col(n).alias("n")) for n in rungs))).alias("r"))
    return rows.where((F.col("literal") == 0) & (F.col("r.n") > 0)).select("r.rung", "r.n")


def smart(segs: DataFrame, plan: SearchPlan, near: int = 5) -> DataFrame:
    """(how, doc_id, line_no): the exact hits; if there are none, what the rungs prefix and contains find; if none still, what nearness finds, each named."""
    rungs = [("exact", plan), ("prefixes", replace(plan, match="prefix")), ("contains", replace(plan, match="contains")), ("near", replace(plan, shape="near", slop=near))]
    words = segs.withColumn("words", tokens(F.col("line")))
    how = reduce(lambda c, x: c.when(x[1].matches(F.col("words")), x[0]), rungs[1:], F.when(plan.matches(F.col("words")), "exact"))
    found = words.select("doc_id", "line_no", how.alias("how")).where(F.col("how").isNotNull())
    level = F.expr("CASE how WHEN 'exact' THEN 0 WHEN 'near' THEN 2 ELSE 1 END")
    least = found.agg(F.min(level).alias("least"))
    return found.join(F.broadcast(least), level == F.col("least")).select("how", "doc_id", "line_no")


def where_from(segs: DataFrame, phrases: DataFrame, n_words: int, too_common: int = 200, without: str | None = None) -> DataFrame:
    """(item_id, hits, works, turn_of_speech): where all words of each phrase occur as a phrase in a segment, outside the work ``without`` if one is named. A join on
    hashed word n-grams, not a scan a phrase, finds candidates by the first ``n_words`` words (all words of a shorter phrase); the whole phrase is then looked for in
    each. A phrase without a word has no row; more hits than ``too_common`` are a turn of speech and no quotation."""
    if without is not None:
        segs = segs.where(~F.col("source").eqNullSafe(F.lit(without)))
    spaced = lambda words: F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    gram = lambda words, i, n: F.xxhash64(F.array_join(F.slice(words, i, n), " "))
    asked = phrases.select("item_id", tokens(F.col("text")).alias("words")).where(F.size("words") > 0)
    asked = asked.select("item_id", spaced("words").alias("phrase"), gram("words", F.lit(1), F.lit(n_words)).alias("gram"), F.least(F.size("words"), F.lit(n_words)).alias("n")).distinct()
    lengths = asked.agg(F.collect_set("n").alias("lengths"))  # n_words numbers at most
    places = lambda words, n: F.sequence(F.lit(1), F.size(words) - n + 1)
    grams = lambda words: F.flatten(F.transform(F.filter("lengths", lambda n: n <= F.size(words)), lambda n: F.transform(places(words, n), lambda i: gram(words, i, n))))
    each = F.explode(F.array_distinct(let(tokens(F.col("line")), grams)))
    there = segs.select("doc_id", "line_no", "line").crossJoin(F.broadcast(lengths)).select(F.col("doc_id").alias("doc_id_"), F.col("line_no").alias("line_no_"), each.alias("gram"))
    candidates = asked.join(there, "gram").select("item_id", "phrase", "doc_id_", "line_no_").distinct()
    whole = segs.join(candidates, F.col("doc_id").eqNullSafe(F.col("doc_id_")) & (F.col("line_no") == F.col("line_no_"))).where(F.contains(spaced(tokens(F.col("line"))), F.col("phrase")))
    found = whole.groupBy("item_id").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("source").alias("works"))
    return found.withColumn("turn_of_speech", F.col("hits") > too_common)


def around(rows: DataFrame, group: str, order: str, at: Column, n: int) -> DataFrame:
    """The rows within ``n`` places of those that ``at`` chooses, in reading order inside their group."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(-n, n)
    return rows.withColumn("near", F.max(at.cast("int")).over(w)).where(F.col("near") == 1).drop("near")


def title_rank(titles: DataFrame, typed: str, title: str) -> DataFrame:
    """0 exact, 1 prefix, 2 contains, 3 to 5 the same without vowels; then the shorter title, then by name."""
    bare = lambda c: F.translate(c, "aeiou", "")
    low, short = F.lower(title), bare(F.lower(title))
    t, b = typed.lower(), typed.lower().translate(str.maketrans("", "", "aeiou"))
    rank = F.when(low == t, 0).when(low.startswith(t), 1).when(low.contains(t), 2).when(short == b, 3).when(short.startswith(b), 4).when(short.contains(b), 5)
    return titles.withColumn("rank", rank).where(F.col("rank").isNotNull())


def skips(letters: Column, wanted: str, k: int) -> Column:
    """Where (from 0) letters at distance ``k`` spell ``wanted``, in a text of letters alone."""
    gap = f".{{{k - 1}}}"
    pattern = re.escape(wanted[0]) + "(?=" + "".join(gap + re.escape(c) for c in wanted[1:]) + ")"
    parts = F.transform(F.split(letters, pattern, -1), lambda p: F.length(p).cast("bigint"))
    # A hit lies where a part ends; each hit is one letter.
    ends = F.aggregate(parts, F.array().cast("array<bigint>"), lambda a, n: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(-1).cast("bigint")) + n + 1)))
    return F.slice(ends, F.lit(1), F.size(ends) - 1)


def sequences(letters: Column, wanted: str, k: int) -> Column:
    """(i, backwards): where letters at distance ``k`` spell ``wanted``, forwards or backwards; ``i`` is the first place in the text. A word that reads the same in both directions is found once."""
    found = lambda word, backwards: F.transform(skips(letters, word, k), lambda i: F.struct(i.alias("i"), F.lit(backwards).alias("backwards")))
    return found(wanted, False) if wanted == wanted[::-1] else F.concat(found(wanted, False), found(wanted[::-1], True))
