"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The documents of a source lie in a permuted order on a line of words. A source's quota is a length of that line, gone round again
beyond its end, cut into blocks. A seeded permutation gives each block a slot: blocks are ranked by a hash, in buckets of the hash
whose counts give where each begins. A binary tree splits the slots of all sources among the output shards: at each node a
multivariate-hypergeometric draw says how many blocks of each source go left, and a slot walks down its source's counts to a leaf. So
the shards draw disjoint blocks and use up every quota exactly; inside a shard, the pieces of documents that its blocks hold are
shuffled by a hash. What the mix takes from a document is read from the shards.

Tables with a row a bucket, a block or a document are joined by merging, never broadcast: written tables are small as files and large in memory.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import fresh_name, written

WORD = r"[^\x20\x09-\x0D]+"
#: A node of the tree cannot draw from more blocks than this.
MOST_BLOCKS = 500_000_000
#: Blocks that one row is unfolded to; words of a part of a shard, on average at most.
SPREAD, PART_WORDS = 1 << 14, 1 << 26


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: list[int], weights: list[float], total: float, most: float = 2.0) -> list[float]:
    """Shares of ``total`` by weight; a share stops at ``most`` times its source's size, and the excess is shared again by weight."""
    out, open_, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], float(total)
    while open_:
        w = math.fsum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > most * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = most * sizes[i]
        left -= math.fsum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def split_tree(blocks: list[int], depth: int, seed: int) -> np.ndarray:
    """[source, node]: how many of the blocks that reach a node go left. The root is node 1, the children of n are 2n and 2n + 1."""
    rng = np.random.Generator(np.random.PCG64(seed))
    left = np.zeros((len(blocks), 1 << depth), dtype=np.int64)
    at = {1: np.asarray(blocks, dtype=np.int64)}
    for node in range(1, 1 << depth):
        have = at.pop(node)
        total = int(have.sum())
        go = rng.multivariate_hypergeometric(have, total // 2, method="marginals") if total else have * 0
        left[:, node] = go
        at[2 * node], at[2 * node + 1] = go, have - go
    return left


@dataclass
class Mix:
    """documents: what was mixed, with size, source_size, target, ``place`` (source key and begin on the source's line) and pieces (epoch, block, begin, end); blocks: (s, block, slot,
    shard); lines: (s, bucket, base, source_size, target, quota), where each bucket of a source begins on its line."""

    documents: DataFrame
    blocks: DataFrame
    lines: DataFrame
    block: int
    parts: int
    most: float
    buckets: int
    seed: int


def _key(source: str) -> Column:
    """A source as a string that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def mix(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", size: Column | None = None, weights: tuple[float, ...] = (3, 1, 2),
        share: float = 1.5, most: float = 2.0, block_words: int = 1024, depth: int = 6, buckets: int = 4096, seed: int = 9) -> Mix:
    """``docs`` with what the mix takes from each document, and the shard of each block.

    Sources are ordered by code point, null last, and take the weights in turn. An empty or null text has size 0 and no
    pieces; a source without words has target 0. A document gets at most ``ceil(most)`` epochs of itself. Rows that repeat
    an id are documents of their own. An empty table gives an empty result. Columns of ``docs`` that have the names of
    the new columns are replaced. One row for each source comes to the driver, no more, and the tree has a number a node for each.
    """
    spark = docs.sparkSession
    placed = _bucketed(docs, source_col, id_col, text_col, size, buckets, seed)
    sums = written(placed.groupBy("_key.s", "_key.b").agg(F.sum("size").alias("n")), "op9-sums")
    found = sorted(((r.s, int(r.n)) for r in sums.groupBy("s").agg(F.sum("n").alias("n")).collect()), key=lambda x: (x[0] == "", x[0].encode("utf-8", "surrogatepass")))
    sizes = [n for _, n in found]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], share * sum(sizes), most)
    quota = [min(round(t), int(most * n)) for t, n in zip(goal, sizes, strict=True)]
    block = max(block_words, -(-sum(quota) // MOST_BLOCKS))
    counts = [-(-q // block) for q in quota]
    tree = split_tree(counts, depth, seed)
    kind = "s string, source_size bigint, target double, quota bigint, k bigint, halves array<bigint>"
    plan = written(spark.createDataFrame([(s, n, goal[i], quota[i], counts[i], tree[i].tolist()) for i, (s, n) in enumerate(found)], kind), "op9-plan")
    # Blocks: unfolded in two steps, so that no task makes those of a whole source.
    wide = plan.where("k > 0").select("s", "k", F.explode(F.expr(f"sequence(0L, (k - 1) div {SPREAD})")).alias("run")).repartition(F.col("s"), F.col("run"))
    blocks = wide.select("s", F.explode(F.expr(f"sequence(run * {SPREAD}, least((run + 1) * {SPREAD}, k) - 1)")).alias("block"))
    blocks = blocks.withColumn("h", F.xxhash64(F.lit(seed + 1), "s", "block")).withColumn("b", F.shiftrightunsigned("h", 64 - int(math.log2(buckets))).cast("int"))
    each = Window.partitionBy("s").orderBy("b")
    table = blocks.groupBy("s", "b").agg(F.count(F.lit(1)).alias("n")).select("s", "b", (F.sum("n").over(each) - F.col("n")).alias("base"))
    slot = F.row_number().over(Window.partitionBy("s", "b").orderBy("h", "block"))
    blocks = blocks.withColumn("no", slot).join(table.hint("merge"), ["s", "b"]).withColumn("slot", F.col("base") + F.col("no") - 1).join(plan.select("s", "halves"), "s")
    walk = f"""aggregate(sequence(1, {depth}), named_struct('n', 1, 'r', slot),
        (a, i) -> IF(a.r < halves[a.n], named_struct('n', 2 * a.n, 'r', a.r), named_struct('n', 2 * a.n + 1, 'r', a.r - halves[a.n])), a -> a.n - {1 << depth})""" if depth else "0"
    blocks = blocks.select("s", "block", "slot", F.expr(walk).alias("shard"))
    lines = sums.select("s", "b", (F.sum("n").over(each) - F.col("n")).alias("base")).join(plan.drop("k", "halves"), "s")
    lines = written(lines, "op9-lines")
    rows = _on_lines(placed, lines, id_col, block, most)
    return Mix(rows, blocks, lines, block, max(1, -(-sum(quota) // ((1 << depth) * PART_WORDS))), most, buckets, seed)


def _bucketed(docs: DataFrame, source_col: str, id_col: str, text_col: str, size: Column | None, buckets: int, seed: int) -> DataFrame:
    """``docs`` with size and _key: the source's key s, a hash h of id and size, and its bucket b."""
    size = word_count(F.col(text_col)) if size is None else size
    docs = docs.drop(*{"source_size", "target", "pieces", "place", "_key"} & set(docs.columns)).withColumn("size", size)
    h = F.xxhash64(F.lit(seed), F.col(id_col), F.col("size"))
    return docs.withColumn("_key", F.struct(_key(source_col).alias("s"), F.shiftrightunsigned(h, 64 - int(math.log2(buckets))).cast("int").alias("b"), h.alias("h")))


def _on_lines(placed: DataFrame, lines: DataFrame, id_col: str, block: int, most: float) -> DataFrame:
    """What ``_bucketed`` gives with source_size, target, place and pieces. The window and the join go by one key, so rows are moved once."""
    own = {n: fresh_name(f"_{n}", placed.columns) for n in ("s", "b", "before", "line")}
    lines = lines.select(F.col("s").alias(own["s"]), F.col("b").alias(own["b"]), F.struct("base", "source_size", "target", "quota").alias(own["line"]))
    rows = placed.withColumn(own["s"], F.col("_key.s")).withColumn(own["b"], F.col("_key.b"))
    order = Window.partitionBy(own["s"], own["b"]).orderBy("_key.h", id_col, "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn(own["before"], F.sum("size").over(order) - F.col("size")).join(lines.hint("merge"), [own["s"], own["b"]])
    t = f"`{own['line']}`"
    start = f"({t}.base + `{own['before']}`)"
    piece = f"""flatten(transform(sequence(0, {math.ceil(most) - 1}), e ->
        transform(
            CASE WHEN size > 0 AND e * {t}.source_size + {start} < {t}.quota
                 THEN sequence((e * {t}.source_size + {start}) div {block}, (least(e * {t}.source_size + {start} + size, {t}.quota) - 1) div {block})
                 ELSE array() END,
            b -> named_struct('epoch', e, 'block', b,
                'begin', greatest(b * {block} - e * {t}.source_size - {start}, 0),
                'end', least((b + 1) * {block} - e * {t}.source_size - {start}, size, {t}.quota - e * {t}.source_size - {start})))))"""
    place = F.struct(F.col("_key.s").alias("s"), F.expr(start).alias("at"))
    return rows.select(*(c for c in placed.columns if c != "_key"), F.col(f"{own['line']}.source_size").alias("source_size"), F.col(f"{own['line']}.target").alias("target"), place.alias("place"), F.expr(piece).alias("pieces"))


def shards(mixed: Mix) -> DataFrame:
    """(shard, part, order_key, s, at, epoch, block, slot, begin, end): a row for every piece of a document, in the shard that its block was dealt to and shuffled inside it; a
    shard is its parts in order, each sorted. A document without words has no piece. Written by the caller, or by ``dealt``."""
    pieces = mixed.documents.select("place.s", "place.at", F.explode("pieces").alias("p")).select("s", "at", "p.*")
    out = pieces.join(mixed.blocks.hint("merge"), ["s", "block"])
    out = out.withColumn("order_key", F.xxhash64(F.lit(mixed.seed), "s", "slot", "epoch", "at"))
    out = out.withColumn("part", F.floor(F.shiftrightunsigned("order_key", 32) * mixed.parts / float(1 << 32)).cast("int"))
    columns = ["shard", "part", "order_key", "s", "at", "epoch", "block", "slot", "begin", "end"]
    return out.select(*columns).repartition("shard", "part").sortWithinPartitions("shard", "part", "order_key")


def dealt(mixed: Mix) -> DataFrame:
    """The shards, written; the mix itself, from which all that follows is read."""
    return written(shards(mixed), "op9-shards")


def taken(mixed: Mix, shards: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, size, source_size, target, taken (words that the shards have of the document, repeats counted) for every row that was mixed."""
    got = written(shards.groupBy("s", "at").agg(F.sum(F.col("end") - F.col("begin")).alias("taken")), "op9-taken")
    # A place is that of one document with words; those without have none of their own.
    rows = mixed.documents.select(F.col(id_col).alias("doc_id"), "size", "source_size", "target", F.when(F.col("size") > 0, F.col("place.s")).alias("s"), "place.at")
    return rows.join(got.hint("merge"), ["s", "at"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


def mixed_documents(docs: DataFrame, columns: list[str], text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", **options) -> DataFrame:
    """The mixed corpus as documents: a row for each epoch of a document that the shards have, rebuilt from its pieces. Where a quota ends inside a document, the row has the words
    up to there, parted by one space. Texts are moved once to their places and once to what is taken of them; the shards hold places alone. Ties, null and empty texts, repeated
    rows and clashing names as in ``mix``; a document without words has no row."""
    sized = written(docs.select(id_col, source_col, word_count(F.col(text_col)).alias("size")), "op9-sizes")
    own = mix(sized, source_col, id_col, size=F.col("size"), **options)
    each = dealt(own).groupBy("s", "at", "epoch").agg(F.sum(F.col("end") - F.col("begin")).alias("words"))
    takes = each.groupBy("s", "at").agg(F.array_sort(F.collect_list("words")).alias("takes"))
    docs = docs.select(*dict.fromkeys([id_col, source_col, text_col, *columns]))
    names = {n: fresh_name(f"_{n}", [*docs.columns, "_key"]) for n in ("s", "at", "takes", "words")}
    takes = written(takes.toDF(names["s"], names["at"], names["takes"]), "op9-takes")
    rows = _on_lines(_bucketed(docs, source_col, id_col, text_col, None, own.buckets, own.seed), own.lines, id_col, own.block, own.most).where("size > 0")
    rows = rows.withColumn(names["s"], F.col("place.s")).withColumn(names["at"], F.col("place.at")).drop("pieces", "place")
    rows = rows.join(takes.hint("merge"), [names["s"], names["at"]]).withColumn(names["words"], F.explode(names["takes"]))
    words = F.col(names["words"])
    cut = F.concat_ws(" ", F.slice(F.regexp_extract_all(F.col(text_col), F.lit(f"({WORD})"), F.lit(1)), F.lit(1), words.cast("int")))
    return rows.withColumn(text_col, F.when(words < F.col("size"), cut).otherwise(F.col(text_col))).select(*columns)


def op9_query(docs: DataFrame) -> DataFrame:
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "op9-sizes")
    mixed = mix(sized, size=F.col("size"))
    mixed.documents = written(mixed.documents, "op9-places")
    return taken(mixed, dealt(mixed))
