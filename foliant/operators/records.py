"""Logs, overlays, merges, coverage, mining, vectors, addresses."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import LATIN


def replayed(log: DataFrame, key: list[str], order: str, gone: Column) -> DataFrame:
    """The last record of each key, unless it is a tombstone. ``max_by`` combines before the shuffle, so a busy key costs a task one row."""
    cols = [c for c in log.columns if c not in key]
    last = log.groupBy(*key).agg(F.max_by(F.struct(*cols), order).alias("_r"))
    return last.select(*key, "_r.*").where(~gone)


def since(log: DataFrame, live: DataFrame, key: list[str], at: str, when: str) -> DataFrame:
    """(live, newer, records): live keys, those newer than ``when`` (without a time: newer), and all records."""
    newer = live.agg(F.count(F.lit(1)).alias("live"), F.count_if(F.col(at).isNull() | (F.col(at) > F.lit(when).cast("timestamp"))).alias("newer"))
    return newer.crossJoin(log.agg(F.count(F.lit(1)).alias("records")))  # one row each


def needs_compaction(records: int, live: int) -> bool:
    return records > 2 * live + 64


def merged_layers(mine: DataFrame, theirs: DataFrame, key: str, content: str) -> DataFrame:
    """(key, outcome) for their rows: taken, had (same content), or refused (another content, or a key that they have twice)."""
    them = theirs.groupBy(key).agg(F.min(content).alias("c"), F.count_distinct(content).alias("kinds"))
    out = them.join(mine.groupBy(key).agg(F.min(content).alias("own")), key, "left")
    return out.select(key, F.when(F.col("kinds") > 1, "refused").when(F.col("own").isNull(), "taken").when(F.col("own") == F.col("c"), "had").otherwise("refused").alias("outcome"))


def coverage(wanted: DataFrame, held: DataFrame, key: str, group: str) -> DataFrame:
    """(group, wanted, held, whole, none)."""
    got = wanted.join(held.select(key, F.lit(1).alias("_h")).distinct(), key, "left")
    out = got.groupBy(group).agg(F.count(F.lit(1)).alias("wanted"), F.count("_h").alias("held"))
    return out.withColumn("whole", F.col("held") == F.col("wanted")).withColumn("none", F.col("held") == 0)


def overlaid(texts: DataFrame, patches: DataFrame, key: str = "segment") -> DataFrame:
    """(key, text, applied, stale): texts (key, text) with their patches (key, begin, was, now) applied where ``was`` stands: at its place, or at its only other one. Of patches that overlap, the one that
    begins first applies; the others are stale. All in the JVM: a fold over a segment's patches in order."""
    grouped = patches.groupBy(key).agg(F.collect_list(F.struct("begin", "was", "now")).alias("p"))
    rows = texts.join(grouped, key, "left")
    place = """transform(coalesce(p, array()), x -> named_struct('at', CASE WHEN substring(text, x.begin + 1, length(x.was)) = x.was THEN x.begin
        WHEN locate(x.was, text) > 0 AND locate(x.was, text, locate(x.was, text) + 1) = 0 THEN locate(x.was, text) - 1 END, 'was', x.was, 'now', x.now))"""
    rows = rows.withColumn("p", F.expr(f"array_sort(filter({place}, x -> x.at IS NOT NULL))")).withColumn("asked", F.expr("size(p)"))
    rows = rows.join(grouped.select(key, F.size("p").alias("given")), key, "left")
    fold = """aggregate(p, named_struct('out', '', 'end', 0, 'n', 0), (a, x) -> IF(x.at < a.end, a,
        named_struct('out', concat(a.out, substring(text, a.end + 1, x.at - a.end), x.now), 'end', x.at + length(x.was), 'n', a.n + 1)))"""
    return rows.withColumn("f", F.expr(fold)).select(key, F.expr("concat(f.out, substring(text, f.end + 1))").alias("text"), F.col("f.n").alias("applied"), F.expr("coalesce(given, 0) - f.n").alias("stale"))


def one_edit(word: Column, letters: str = LATIN) -> Column:
    """Every word one substitution, deletion, swap of neighbours or insertion away, with how."""
    w = f"transform(sequence(1, length(word)), i -> i)"
    each = ",".join(f"'{c}'" for c in letters)
    return F.expr(f"""array_distinct(flatten(array(
        flatten(transform({w}, i -> transform(array({each}), c -> named_struct('rare', concat(left(word, i - 1), c, substring(word, i + 1)), 'how', 'substitution')))),
        transform({w}, i -> named_struct('rare', concat(left(word, i - 1), substring(word, i + 1)), 'how', 'deletion')),
        transform(filter({w}, i -> i < length(word)), i -> named_struct('rare', concat(left(word, i - 1), substring(word, i + 1, 1), substring(word, i, 1), substring(word, i + 2)), 'how', 'swap')),
        flatten(transform(sequence(1, length(word) + 1), i -> transform(array({each}), c -> named_struct('rare', concat(left(word, i - 1), c, substring(word, i)), 'how', 'insertion')))))))""")


def suspects(vocab: DataFrame, common_from: int = 10_000, rare_to: int = 1, least_length: int = 4, letters: str = LATIN, alike: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """(rare, common, rare_count, common_count, how, score): rare words one edit from a common one, the best common word for each; the ``most`` best, by score, rare and common, if a number is given. Edits at a
    word's edges that add or drop a letter are grammar and no suspects. A letter for another that looks ``alike`` (pairs of letters) counts twice. An equi-join of the common words' neighbours with the
    vocabulary; the common words are few, and only they are expanded."""
    commons = vocab.where((F.col("cf") >= common_from) & F.col("term").rlike(f"^[{letters}]+$")).select(F.col("term").alias("word"), F.col("cf").alias("common_count"))
    near = commons.select("word", "common_count", F.explode(one_edit(F.col("word"), letters)).alias("e")).select("word", "common_count", "e.rare", "e.how")
    edge = F.col("rare").startswith(F.col("word")) | F.col("rare").endswith(F.col("word")) | F.col("word").startswith(F.col("rare")) | F.col("word").endswith(F.col("rare"))
    rare = vocab.where((F.col("cf") <= rare_to) & (F.length("term") >= least_length)).select(F.col("term").alias("rare"), F.col("cf").alias("rare_count"))
    weight = F.when(F.col("how") == "substitution", 10).when(F.col("how") == "swap", 9).otherwise(5)
    found = near.where(~edge & (F.col("rare") != F.col("word"))).join(rare, "rare")
    both = [p for a in alike for p in (a, a[::-1])]
    letters_of = lambda c: F.regexp_extract_all(c, F.lit("(.)"), F.lit(1))
    twice = F.when((F.col("how") == "substitution") & F.exists(F.zip_with(letters_of("word"), letters_of("rare"), lambda x, y: F.concat(x, y)), lambda x: x.isin(both)), 2).otherwise(1) if both else F.lit(1)
    scored = found.withColumn("score", F.expr("CAST((length(bin(common_count)) * 10 + length(rare) * 5) AS BIGINT)") * weight).withColumn("score", F.expr("score div 10") * twice)
    best = Window.partitionBy("rare").orderBy(F.desc("score"), "word", "how")
    out = scored.withColumn("no", F.row_number().over(best)).where("no = 1").select("rare", F.col("word").alias("common"), "rare_count", "common_count", "how", "score")
    return out.orderBy(F.desc("score"), "rare", "common").limit(most) if most else out


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def nearest_exact(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    score = F.round(dot(F.col(vec_col), F.array(*map(F.lit, query))), 6)
    return vectors.select(id_col, score.alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def planes(dims: int, bits: int = 256, seed: int = 7) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).standard_normal((bits, dims))


def signatures(vectors: DataFrame, dims: int, id_col: str = "vec_id", vec_col: str = "embedding", bits: int = 256, seed: int = 7) -> DataFrame:
    """(id, s0..s3): 256 signs of random projections, as four integers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = planes(dims, bits, seed)
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(b.column(1)), -1)
            words = np.packbits(x @ p.T >= 0, axis=1, bitorder="little").view("<i8")
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(words[:, i]) for i in range(bits // 64))], names=["id", *(f"s{i}" for i in range(bits // 64))])

    kind = vectors.schema[id_col].dataType.simpleString()
    return vectors.select(id_col, vec_col).mapInArrow(run, f"id {kind}, " + ", ".join(f"s{i} bigint" for i in range(bits // 64)))


def nearest_shortlisted(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vec_col: str = "embedding", least: int = 256, per: int = 32) -> DataFrame:
    """Exact scores of the ``max(per * k, least)`` vectors whose signatures differ least from the query's."""
    signs = np.packbits(np.asarray([query]) @ planes(len(query)).T >= 0, axis=1, bitorder="little").view("<i8")[0]
    apart = sum((F.bit_count(F.col(f"s{i}").bitwiseXOR(F.lit(int(s)))) for i, s in enumerate(signs)), F.lit(0))
    short = signatures(vectors, len(query), id_col, vec_col).select(F.col("id").alias(id_col), apart.alias("apart")).orderBy("apart", id_col).limit(max(per * k, least))
    # The shortlist has a fixed number of rows, so it is broadcast.
    return nearest_exact(vectors.join(F.broadcast(short.select(id_col)), id_col), query, k, id_col, vec_col)


def pieces(text: pd.Series, most: int = 10_000, target: int = 4_000, reach: int = 1_200) -> pd.Series:
    """Texts of more than ``most`` characters cut near multiples of ``target``, at the best boundary within ``reach``; put together they are the text."""
    marks = ["\n\n", "\n", "׃", ":", ".", "! ", "? ", " "]

    def one(t: str | None) -> list[str]:
        if t is None or len(t) <= most:
            return [] if t is None else [t]
        out, at = [], 0
        while len(t) - at > target + reach:
            low, high, cut_ = at + target - reach, at + target + reach, at + target
            for m in marks:
                ends = [i + len(m) for i in (t.rfind(m, low, at + target), t.find(m, at + target, high)) if i >= 0]
                if ends:
                    cut_ = min(ends, key=lambda e: abs(e - at - target))
                    break
            out.append(t[at:cut_])
            at = cut_
        return [*out, t[at:]]

    return text.map(one)


def cut_pieces(text: Column) -> Column:
    """The pieces of a text; where a cut lies depends on the one before, so it runs in Python. Batches are of ``spark.sql.execution.arrow.maxRecordsPerBatch`` texts."""

    def run(texts: pd.Series) -> pd.Series:
        return pieces(texts)

    return F.pandas_udf(run, "array<string>")(text)


def closure(pairs: DataFrame) -> DataFrame:
    """(name, now): where each old name leads through redirects (old, new), at last; null where it leads round and round. Of two redirects of one name the greater counts. Pointers are
    doubled, so the rounds are the logarithm of the longest chain; each is written."""
    from .graph import cut

    now = cut(pairs.groupBy(F.col("old").alias("name")).agg(F.max("new").alias("now")), "redirects")
    rounds = max(1, now.count()).bit_length() + 1
    for _ in range(rounds):
        names = now.select(F.col("name").alias("n_"), F.col("now").alias("next"))
        ahead = cut(now.join(names, now["now"] == names["n_"], "left").select("name", F.coalesce("next", "now").alias("now"), F.col("next").isNotNull().alias("on")), "redirects")
        now = ahead.select("name", "now")
        if ahead.where("on").isEmpty():
            break
    starts = now.select(F.col("name").alias("n_"), F.lit(True).alias("_goes"))
    out = now.join(starts, now["now"] == starts["n_"], "left")
    return out.select("name", F.when(F.col("_goes").isNull(), F.col("now")).alias("now"))


def asof(left: DataFrame, anchors: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """``left`` with the value and place of the latest anchor at or before ``at``; an anchor without a value hides those before it. A union and one window: no pairs are made."""
    cols = left.columns
    a = anchors.select(key, F.col(at), F.struct(F.col(at).alias("at"), F.col(value).alias("v")).alias("_a"), F.lit(0).alias("_s"))
    both = left.withColumn("_s", F.lit(1)).unionByName(a, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "_s").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_l", F.last("_a", ignorenulls=True).over(w)).where("_s = 1")
    return out.select(*cols, F.col("_l.at").alias("anchor_at"), F.col("_l.v").alias("anchor"))


def aligned(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, old_no, new_no): lines (key, no, text) that a re-import keeps: texts that occur once on both sides, along the longest run that rises on both. One group is one work."""
    once = lambda d, n: d.groupBy(key, "text").agg(F.min("no").alias(n), F.count(F.lit(1)).alias("c")).where("c = 1").drop("c")
    both = once(before, "old_no").join(once(after, "new_no"), [key, "text"]).select(key, "old_no", "new_no")

    def rising(x: pd.DataFrame) -> pd.DataFrame:
        from bisect import bisect_left

        x = x.sort_values("old_no").reset_index(drop=True)
        tops, at, back = [], [], [-1] * len(x)
        for i, v in enumerate(x["new_no"]):
            j = bisect_left(tops, v)
            back[i] = at[j - 1] if j else -1
            if j == len(tops):
                tops.append(v)
                at.append(i)
            else:
                tops[j], at[j] = v, i
        keep, i = [], at[-1] if at else -1
        while i >= 0:
            keep.append(i)
            i = back[i]
        return x.iloc[keep[::-1]]

    return both.groupBy(key).applyInPandas(rising, both.schema)
