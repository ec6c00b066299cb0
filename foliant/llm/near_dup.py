"""N-gram Jaccard join by MinHash banding, with exact verification.

Documents with one set of word n-grams are a class, and one of them stands for it. Representatives meet where a band of their
MinHash signatures is equal. A bucket's members are dealt to blocks of bounded size, and a task meets two blocks: first with the
band hashes alone, to see which pairs have not met in an earlier band, then with the full n-gram sets of the members that have such
pairs. What a task returns is one row for each member, with its number of links and one link of a spanning tree,
so a bucket of thousands of near copies makes thousands of rows and not millions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written
from .units import CHUNK, mixed, span_hashes, text_bytes

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.999
#: A block has so many members, and so many n-grams, on average at most.
BLOCK_MEMBERS, BLOCK_GRAMS = 1024, 1 << 21
_MUL = np.uint64(0x9E3779B97F4A7C15)
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[32, *range(9, 14)]] = True


def choose_bands(similarity: float = SIMILARITY, recall: float = RECALL, most_hashes: int = 144) -> tuple[int, int]:
    """(bands, rows): the most selective banding whose chance to bring a pair of just this similarity together is ``recall`` or more."""
    found = [(rows, math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))) for rows in range(1, 33)]
    ok = [(rows, bands) for rows, bands in found if rows * bands <= most_hashes]
    if not ok:
        raise ValueError("no banding of so few hashes has this recall")
    rows, bands = ok[-1]
    return bands, rows


def word_hashes(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words, text of each) of the texts that begin at ``begins`` (each once); words are what ASCII white space parts."""
    hashes, texts, pos, size = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0, CHUNK
    while pos < len(data):
        part = data[pos : pos + size]
        white = _WHITE[part]
        first = np.zeros(len(part) + 1, dtype=bool)
        first[begins[np.searchsorted(begins, pos) : np.searchsorted(begins, pos + len(part), "right")] - pos] = True
        start = np.flatnonzero(~white & (first[:-1] | np.concatenate([[True], white[:-1]])))
        last = pos + len(part) == len(data)
        end = np.flatnonzero(~white & (first[1:] | np.concatenate([white[1:], [last]]))) + 1
        # A word that the part does not end is left for the next part.
        if len(start) > len(end):
            part, start = part[: start[-1]], start[:-1]
            if not len(part):
                size *= 2
                continue
        hashes.append(span_hashes(part, start, end))
        texts.append(np.searchsorted(begins, start + pos, "right") - 1)
        pos, size = pos + len(part), CHUNK
    return np.concatenate(hashes), np.concatenate(texts)


def gram_sets(column: pa.Array, n: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted 64-bit hashes of its word n-grams; a text of fewer words has one, of all its words, and one without words none."""
    data, at = text_bytes(column)
    some = np.flatnonzero(at[1:] > at[:-1])
    h, of = word_hashes(data, at[:-1][some])
    words = np.bincount(some[of], minlength=len(column)) if len(of) else np.zeros(len(column), np.int64)
    begin = np.cumsum(words) - words
    count = np.where(words > n, words - n + 1, np.minimum(words, 1))
    grams = np.zeros(int(count.sum()), np.uint64)
    to = np.cumsum(count) - count
    with np.errstate(over="ignore"):
        for k in range(1, n + 1):
            own = np.flatnonzero(words >= n) if k == n else np.flatnonzero(words == k)
            if not len(own):
                continue
            place = np.arange(int(count[own].sum())) - np.repeat(np.cumsum(count[own]) - count[own], count[own])
            source, out = np.repeat(begin[own], count[own]) + place, np.zeros(len(place), np.uint64)
            for i in range(k):
                out = out * _MUL + h[source + i]
            grams[np.repeat(to[own], count[own]) + place] = mixed(out + np.uint64(k))
    sets = [grams[a : a + c] for a, c in zip(to.tolist(), count.tolist(), strict=True)]
    for i, x in enumerate(sets):
        x.sort()
        sets[i] = x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x
    return sets


def band_hashes(sets: list[np.ndarray], bands: int, rows: int, seed: int = 5) -> np.ndarray:
    """[set, band] 64-bit hashes of the bands of the sets' MinHash signatures; an empty set's row means nothing."""
    rng = np.random.Generator(np.random.PCG64(seed))
    mul = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    add = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
    some = [s for s in sets if len(s)]
    out = np.zeros((len(sets), bands), dtype=np.uint64)
    if not some:
        return out
    at = np.flatnonzero([len(s) for s in sets])
    length = np.fromiter(map(len, some), np.int64, len(some))
    begin = np.cumsum(length) - length
    flat = np.concatenate(some)
    low = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
    with np.errstate(over="ignore"):
        value = np.empty_like(low)
        for b in range(bands):
            acc = np.full(len(some), b + 1, dtype=np.uint64)
            for r in range(rows):
                np.multiply(low, mul[b * rows + r], out=value)
                value += add[b * rows + r]
                acc = mixed(acc * _MUL + np.minimum.reduceat(value, begin))
            out[at, b] = acc
    return out


def signatures(docs: DataFrame, bands: int, rows: int, n: int, id_col: str, text_col: str) -> DataFrame:
    """(id, key, grams, bands): a class key (a 128-bit hash of the set), the size of the set and its band hashes, for each document."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = gram_sets(batch.column(1), n)
            hashes = band_hashes(sets, bands, rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(list(map(np.ndarray.tobytes, hashes)), pa.binary())], names=["id", "key", "grams", "bands"])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {id_type}, key binary, grams bigint, bands binary")


def full_sets(docs: DataFrame, keys: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(key, grams): the full sets of the classes in ``keys`` (id, key), from the texts of their representatives."""
    kept = keys.select(F.col("id").alias("id_"), F.col("key")).hint("shuffle_hash")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.join(kept, F.col("id").eqNullSafe(F.col("id_"))).select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for s in gram_sets(batch.column(1), n)]
            out = [(k, s) for k, s in zip(batch.column(0).to_pylist(), sets, strict=True) if xxhash.xxh3_128_digest(s) == k]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([s for _, s in out], pa.binary())], names=["key", "grams"])

    return rows.mapInArrow(run, "key binary, grams binary").dropDuplicates(["key"])


def groups(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[list[list]]:
    """The columns, as lists, of each run of rows that agree in the first ``by`` columns."""
    for run in runs(batches, by):
        yield [[x for part in run for x in part.column(i).to_pylist()] for i in range(run[0].num_columns)]


def runs(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[list[pa.RecordBatch]]:
    """Each run of rows that agree in the first ``by`` columns, as its parts; a run may go on over several batches."""
    parts: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = np.zeros(batch.num_rows, dtype=bool)
        for c in batch.columns[:by]:
            v = c.to_numpy(zero_copy_only=False)
            cut[1:] |= v[1:] != v[:-1]
        first = tuple(c[0].as_py() for c in batch.columns[:by])
        cut[0] = first != last
        at = [*np.flatnonzero(cut).tolist(), batch.num_rows]
        if at[0] > 0:
            parts.append(batch.slice(0, at[0]))
        for a, b in zip(at, at[1:], strict=False):
            if parts:
                yield parts
            parts = [batch.slice(a, b - a)]
        last = tuple(c[batch.num_rows - 1].as_py() for c in batch.columns[:by])
    if parts:
        yield parts


def open_pairs(band: int, i: int, j: int, block: np.ndarray, bands: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """([left], [right], mask): members of block i and of block j, and which pairs are to be compared here: each once, in the first band that they share."""
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    if i == j:
        mask = np.triu(np.ones((len(left), len(left)), dtype=bool), 1)
    else:
        mask = np.ones((len(left), len(right)), dtype=bool)
    for b in range(band):
        mask &= bands[left, b][:, None] != bands[right, b][None, :]
    return left, right, mask


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """[left, right] sizes of intersections where the mask says so: by matrix products over the n-grams that several members share, or pair by pair if that is less work."""
    out = np.zeros(mask.shape, dtype=np.int64)
    a, b = np.nonzero(mask)
    if not len(a):
        return out
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    members, of = np.unique(np.concatenate([left, right]), return_inverse=True)
    one_by_one = 30 * (size[left[a]] + size[right[b]]).sum() + 20_000 * len(a)
    flat = np.concatenate([sets[m] for m in members])
    if one_by_one > 60 * len(flat):
        grams, column, times = np.unique(flat, return_inverse=True, return_counts=True)
        shared = np.cumsum(times > 1) - 1
        n = int(shared[-1]) + 1
        row = np.repeat(np.arange(len(members)), size[members])
        keep = times[column] > 1
        row, column = row[keep], shared[column[keep]]
        if one_by_one > 2 * len(left) * len(right) * n // 8:
            order = np.argsort(column, kind="stable")
            row, column = row[order], column[order]
            step = 4096
            for c in range(0, n, step):
                x, y = np.searchsorted(column, [c, c + step])
                dense = np.zeros((len(members), min(step, n - c)), dtype=np.float32)
                dense[row[x:y], column[x:y] - c] = 1
                out += (dense[of[: len(left)]] @ dense[of[len(left) :]].T).astype(np.int64)
            return out
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        out[x, y] = len(np.intersect1d(sets[left[x]], sets[right[y]], assume_unique=True))
    return out


def links_of(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, mask: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """([member] links, [edge] a, [edge] b): how many members each is linked to, and the edges of a spanning forest."""
    both = intersections(sets, left, right, mask)
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    union = size[left][:, None] + size[right][None, :] - both
    a, b = np.nonzero(mask & (both >= similarity * union - 1e-9))
    a, b = left[a], right[b]
    n = np.bincount(a, minlength=len(sets)) + np.bincount(b, minlength=len(sets))
    root = np.arange(len(sets))
    edges = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        u, v = x, y
        while root[u] != u:
            root[u] = root[root[u]]
            u = root[u]
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        if u != v:
            root[max(u, v)] = min(u, v)
            edges.append((x, y))
    e = np.asarray(edges, dtype=np.int64).reshape(-1, 2)
    return n, e[:, 0], e[:, 1]


def components(edges: DataFrame) -> DataFrame:
    """(key, root): for every node of ``edges`` (a, b) the smallest node that it is connected to, by alternating large and small stars."""
    spark = edges.sparkSession
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "stars")
    seen = None
    while True:
        # Large star: every larger neighbour of a node is linked to the smallest of the node and its neighbours.
        ways = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = ways.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        low = written(low, "stars-low")
        large = ways.join(low, ways.u == low.n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: the smaller neighbours of a node, and the node, are linked to the smallest of them.
        large = written(large, "stars-large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m"), "stars-least")
        small = large.join(least, large.u == least.n).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = written(small.select("e.u", "e.v").where("u <> v").distinct(), "stars")
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())
        if state == seen:
            break
        seen = state
    nodes = now.select(F.col("u").alias("key"), F.col("v").alias("root"))
    return nodes.unionByName(now.select(F.col("v").alias("key"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, block_members: int = BLOCK_MEMBERS, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """A row for every row of ``docs``: doc_id, class_id, copy_of, n_links.

    Words are what ASCII white space parts, as they are; a text of fewer than ``n`` words has one n-gram, of all its words. Documents with equal
    sets are copies (null and empty texts are copies of one another): copy_of is the smallest id among them. n_links counts
    the other sets, each once, whose Jaccard similarity to the document's own is ``similarity`` or more; class_id is the smallest id that
    the document is connected to by copies and links. Every pair of sets that share a band is verified on the full sets; at just that
    similarity a pair shares one with probability ``recall``. Rows that repeat an id and a text get equal results; a null id is
    larger than any. An empty table gives an empty result. Other columns are not read.
    """
    bands, rows = choose_bands(similarity, recall)
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signed = written(signatures(docs, bands, rows, n, "doc_id", "text"), "op5-signatures")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id"))
    classes = written(signed.groupBy("key").agg(first.alias("f"), F.first("grams").alias("grams"), F.first("bands").alias("bands")).select("key", F.col("f.id").alias("id"), "grams", "bands"), "op5-classes")
    cut = F.expr(f"transform(sequence(0, {bands - 1}), b -> hex(substring(bands, b * 8 + 1, 8)))")
    at = classes.where("grams > 0").select("key", "grams", F.posexplode(cut).alias("band", "value")).select("band", F.unhex("value").alias("value"), "key", "grams")
    at = at.select("band", F.xxhash64("value").alias("bucket"), "key", "grams")
    sizes = at.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("members"), F.sum("grams").alias("total")).where("members > 1")
    # What is aggregated is written before rows are joined to it: the joins then have plain exchanges, and Spark can split a hot key's partition.
    sizes = written(sizes, "op5-buckets")
    met = at.join(sizes, ["band", "bucket"]).select("band", "bucket", "key", F.expr(f"CAST(greatest(ceil(members / {block_members}), ceil(total / {block_grams})) AS INT)").alias("blocks"))
    met = met.withColumn("block", F.expr("CAST(pmod(xxhash64(key, 7), blocks) AS INT)"))
    met = met.select("band", "bucket", "key", "block", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    met = written(met.select("band", "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key"), "op5-met")
    meeting = ["band", "bucket", "i", "j"]
    wide = met.join(classes.select("key", "bands"), "key").select(*meeting, "block", "key", "bands")

    def first_met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for band, bucket, i, j, block, key, raw in groups(batches, 4):
            left, right, mask = open_pairs(band[0], i[0], j[0], np.asarray(block), np.frombuffer(b"".join(raw), np.int64).reshape(len(raw), bands))
            for m in np.union1d(left[mask.any(axis=1)], right[mask.any(axis=0)]).tolist():
                out.append((band[m], bucket[m], i[m], j[m], block[m], key[m], raw[m]))
            if len(out) > 20_000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    kinds = [("band", pa.int32()), ("bucket", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("block", pa.int32()), ("key", pa.binary()), ("bands", pa.binary())]

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*out, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])

    spec = "band int, bucket bigint, i int, j int, block int, key binary, bands binary"
    open_ = written(wide.repartition(*meeting).sortWithinPartitions(*meeting).mapInArrow(first_met, spec), "op5-open")
    wanted = open_.select("key").distinct().join(classes.select("key", "id"), "key")
    sets = written(full_sets(docs, wanted, n, "doc_id", "text"), "op5-sets", "uncompressed")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for band, _, i, j, block, key, raw, grams in groups(batches, 4):
            own = [np.frombuffer(g, np.uint64) for g in grams]
            left, right, mask = open_pairs(band[0], i[0], j[0], np.asarray(block), np.frombuffer(b"".join(raw), np.int64).reshape(len(raw), bands))
            links, a, b = links_of(own, left, right, mask, similarity)
            to = dict(zip(b.tolist(), a.tolist(), strict=True)) if len(set(b.tolist())) == len(b) else None
            if to is None:
                rows += [(key[x], 0, key[y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                to = {}
            rows += [(key[m], int(links[m]), key[to[m]] if m in to else None) for m in np.flatnonzero(links).tolist()]
            if len(rows) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.binary()), strict=True)], names=["a", "links", "b"])
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.binary()), strict=True)], names=["a", "links", "b"])

    joined = open_.join(sets, "key").select(*meeting, "block", "key", "bands", "grams")
    found = written(joined.repartition(*meeting).sortWithinPartitions(*meeting).mapInArrow(compare, "a binary, links bigint, b binary"), "op5-links")
    per = found.groupBy("a").agg(F.sum("links").alias("n_links")).withColumnRenamed("a", "key")
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    placed = classes.select("key", "id").join(roots, "key", "left").join(per, "key", "left").select("key", F.col("id").alias("copy_of"), F.coalesce("root", "key").alias("root"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))
    placed = written(placed, "op5-placed")
    names = placed.groupBy("root").agg(F.min(F.struct(F.col("copy_of").isNull().alias("none"), F.col("copy_of").alias("id"))).alias("f")).select("root", F.col("f.id").alias("class_id"))
    names = written(names, "op5-names")
    return signed.select("key", "id").join(placed.join(names, "root"), "key").select(F.col("id").alias("doc_id"), "class_id", "copy_of", "n_links")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those that are near copies of one that stays: of each class the row with the smallest id. Rows without an id all stay."""
    found = near_duplicates(docs, id_col, text_col).where(F.col("doc_id") != F.col("class_id")).select(F.col("doc_id").alias("_gone")).distinct().hint("shuffle_hash")
    return docs.join(found, docs[id_col] == found["_gone"], "left_anti")
