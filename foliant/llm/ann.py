"""Approximate nearest neighbours by balanced posting lists.

Centroids are fitted on a bounded sample, and clusters that are too large are split until the lists are balanced. Every vector is
put in the lists whose centroids are nearest, those at a boundary in several. A graph over the centroids is searched in memory; a query
reads the lists whose distance is within a ratio of the nearest one's, the ratio being chosen on the sample for a target recall.
Lists are cut into blocks of bounded size, and tasks multiply a block of a list with a block of its queries.

Equal vectors are searched once: a hot vector is one entry, and its smallest ids stand for it, which is exact as ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_batches, written
from .near_dup import runs

#: Bounds of what is fitted: vectors of the sample, and their bytes; centroids. Within them the sample has ``PER`` vectors a centroid, and 8,192 at least, and there is a centroid
#: for each root of the number of vectors. Lists that hold one vector.
SAMPLE, SAMPLE_BYTES, PER, MOST_CENTROIDS, REPLICAS = 65_536, 64 << 20, 16, 4096, 4
NEIGHBOURS, RECALL = 24, 0.97
#: Vectors, and queries, of a block on average at most; queries whose best a task holds at most.
BLOCK, HELD = 2048, 50_000
#: Rows, and pairs of a row and a centroid, that a step of a search of the graph takes at once.
ROWS, PAIRS = 512, 1 << 16


def measured(rows: np.ndarray, top: float) -> np.ndarray:
    """Vectors with one more component, by which the largest inner product is the smallest distance from a query that has 0 there."""
    rest = np.maximum(top * top - np.einsum("ij,ij->i", rows, rows), 0.0)
    return np.concatenate([rows, np.sqrt(rest)[:, None]], axis=1)


def as_query(rows: np.ndarray, top: float) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.concatenate([rows * (top / norm), np.zeros((len(rows), 1))], axis=1)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([np.zeros(0, np.int64), *((half - x[i : i + 4096] @ c.T).argmin(axis=1) for i in range(0, len(x), 4096))])


def _next(c: np.ndarray, n: int) -> np.ndarray:
    """[centroid, n] the nearest other centroids, nearest first."""
    half, out = (c * c).sum(axis=1) / 2, []
    for i in range(0, len(c), 512):
        d = half - c[i : i + 512] @ c.T
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        out.append(np.argsort(d, axis=1, kind="stable")[:, : min(n, len(c) - 1)])
    return np.concatenate(out)


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        at = _nearest(x, c)
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


class Index:
    """Centroids, the graph over them, and the ratio within which a query reads lists."""

    def __init__(self, sample: np.ndarray, top: float, rows: int, recall: float = RECALL, nearest: int = 20, seed: int = 8) -> None:
        rng = np.random.Generator(np.random.PCG64(seed))
        self.top = top
        x = measured(sample, top)
        k = int(min(max(1, round(math.sqrt(rows))), MOST_CENTROIDS, max(1, len(x) // PER)))
        c = _means(x, k, rng, 10)
        at = _nearest(x, c)
        for i in np.flatnonzero(np.bincount(at, minlength=k) > 2 * len(x) / k):
            own = x[at == i]
            part = _means(own, 2, rng, 5)
            c[i] = part[0]
            c = np.concatenate([c, part[1:]])
        # Lists of a fifth of the mean or less go; their vectors join the lists next to them.
        n = np.bincount(_nearest(x, c), minlength=len(c))
        c = c[n > max(0, len(x) // (5 * len(c)) if len(c) > 1 else 0)]
        self.centroids = c
        near = _next(c, NEIGHBOURS)
        far = rng.integers(0, len(c), (len(c), 4))
        self.graph = np.concatenate([near, far], axis=1)
        self.start = rng.choice(len(c), min(len(c), 8), replace=False)
        #: A query that lies on a centroid counts as being so far from it.
        self.ratio, self.least = 0.0, 0.0
        self._calibrate(sample, recall, nearest, rng)

    def _calibrate(self, sample: np.ndarray, recall: float, nearest: int, rng: np.random.Generator) -> None:
        """The ratio at which ``recall`` of the sample's true neighbours lie in a list that a query reads."""
        if len(sample) < 2:
            return
        at = rng.choice(len(sample), min(256, len(sample)), replace=False)
        score = sample[at] @ sample.T
        score[np.arange(len(at)), at] = -np.inf
        true = np.argsort(-score, axis=1)[:, : min(nearest, len(sample) - 1)]
        q = as_query(sample[at], self.top)
        c = self.centroids
        d = np.sqrt(np.maximum((q * q).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * q @ c.T, 0))
        self.least = float(np.median(d.min(axis=1)))
        d = d / np.maximum(d.min(axis=1, keepdims=True), max(self.least, 1e-12))
        lists, kept = self.lists_of(sample)
        best = np.full(true.shape, np.inf)
        for r in range(lists.shape[1]):
            ok = kept[true, r]
            best = np.minimum(best, np.where(ok, np.take_along_axis(d, lists[true, r], axis=1), np.inf))
        self.ratio = float(np.quantile(best, recall)) - 1 + 1e-9

    def walk(self, x: np.ndarray, ratio: float, least: int, floor: float = 0.0) -> np.ndarray:
        """[row, centroid] distances that a search of the graph finds, infinite elsewhere: it goes on from every centroid within the ratio, and from the ``least`` nearest."""
        if len(x) > ROWS:
            return np.concatenate([self.walk(x[i : i + ROWS], ratio, least, floor) for i in range(0, len(x), ROWS)])
        c, n = self.centroids, len(self.centroids)
        d = np.full((len(x), n), np.inf)
        xx, cc = (x * x).sum(axis=1), (c * c).sum(axis=1)
        done = np.zeros((len(x), n), dtype=bool)
        i, j = np.repeat(np.arange(len(x)), len(self.start)), np.tile(self.start, len(x))
        while len(i):
            for a in range(0, len(i), PAIRS):
                p, q = i[a : a + PAIRS], j[a : a + PAIRS]
                d[p, q] = np.sqrt(np.maximum(xx[p] + cc[q] - 2 * np.einsum("ij,ij->i", x[p], c[q]), 0))
            bound = np.maximum(d.min(axis=1), floor) * (1 + ratio)
            if least < n:
                bound = np.maximum(bound, np.partition(d, least - 1, axis=1)[:, least - 1])
            i, j = np.nonzero((d <= bound[:, None]) & np.isfinite(d) & ~done)
            done[i, j] = True
            seen = np.zeros_like(done)
            seen[i[:, None], self.graph[j]] = True
            i, j = np.nonzero(seen & np.isinf(d))
        return d

    def lists_of(self, rows: np.ndarray, closeness: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
        """([row, r] lists, [row, r] whether the row is put there): the nearest, and those up to ``REPLICAS`` that are nearly as near."""
        d = self.walk(measured(rows, self.top), 0.0, min(len(self.centroids), 2 * REPLICAS))
        at = np.argsort(d, axis=1)[:, :REPLICAS]
        near = np.take_along_axis(d, at, axis=1)
        return at, np.isfinite(near) & (near <= near[:, :1] * (1 + closeness) + 1e-12)

    def lists_for(self, rows: np.ndarray, sizes: np.ndarray, enough: int) -> np.ndarray:
        """[row, list] whether a query reads the list: those within the ratio, and in any case the nearest until they hold ``enough`` entries."""
        least = int(np.searchsorted(np.cumsum(np.sort(sizes)), enough)) + 1
        d = self.walk(as_query(rows, self.top), self.ratio, min(len(sizes), max(4, least)), self.least)
        order = np.argsort(d, axis=1)
        held = np.cumsum(sizes[order], axis=1) - sizes[order]
        short = np.zeros(d.shape, dtype=bool)
        np.put_along_axis(short, order, held < enough, axis=1)
        return np.isfinite(d) & (short | (d <= np.maximum(d.min(axis=1, keepdims=True), self.least) * (1 + self.ratio)))


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def search(vectors: DataFrame, every: int = 20, nearest: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """The ``nearest`` rows found for every row whose id is divisible by ``every``: query_id, rank (from 1), vec_id, score (inner product in double precision).

    Vectors that are null or zero or hold a null or a component that is not finite take no part, nor do rows without an id or of
    another length than most; equal scores go to the smaller id. Rows that repeat an id and a vector count once. A query has fewer rows if
    there are fewer candidates; an empty table gives an empty result. Other columns are not read. Every vector is indexed; the
    centroids are fitted on ``sample`` vectors at most (see SAMPLE), the same in each run.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    v = F.col(vec_col)
    fine = v.isNotNull() & F.col(id_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: x.cast("double")).alias("vector")).withColumn("h", F.xxhash64("vector"))
    size = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).head()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if size is None:
        return spark.createDataFrame([], schema)
    dims = size["n"]
    rows = rows.where(F.size("vector") == dims)
    own = written(rows.groupBy("h", "vector").agg(F.min("vec_id").alias("rep")).select("h", "vector", "rep"), "op8-vectors")
    of = rows.join(own.withColumnsRenamed({"vector": "vector_", "h": "h_"}), (F.col("h") == F.col("h_")) & (F.col("vector") == F.col("vector_"))).select("vec_id", "rep").distinct()
    of = written(of, "op8-ids")
    first = F.row_number().over(Window.partitionBy("rep").orderBy("vec_id"))
    # Written, so that the join with what is found has plain exchanges, and Spark can split the partition of a vector that is near to most queries.
    ids = written(of.withColumn("no", first).where(F.col("no") <= nearest + 1).select(F.col("rep").alias("found"), "vec_id"), "op8-firsts")
    asked = of.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "rep")
    top, n = own.agg(F.max(F.expr("sqrt(aggregate(vector, 0D, (a, x) -> a + x * x))")), F.count(F.lit(1))).head()
    sample = max(1, min(sample, SAMPLE_BYTES // (8 * dims), max(8192, PER * math.isqrt(n))))
    taken = own.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("vector").toPandas()
    index = Index(np.stack([np.asarray(x, dtype=np.float64) for x in taken["vector"]]), float(top), n, recall, nearest)
    shipped = spark.sparkContext.broadcast(index)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, kept = shipped.value.lists_of(_vectors(batch.column(1)))
            i, r = np.nonzero(kept)
            yield pa.RecordBatch.from_arrays([pa.array(lists[i, r], pa.int32()), batch.column(0).take(pa.array(i)), batch.column(1).take(pa.array(i))], names=["list", "rep", "vector"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, c = np.nonzero(shipped.value.lists_for(_vectors(batch.column(1)), sizes, REPLICAS * (nearest + 1)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), batch.column(0).take(pa.array(i)), batch.column(1).take(pa.array(i))], names=["list", "rep", "vector"])

    spec = "list int, rep bigint, vector array<double>"
    narrow = own.select("rep", "vector")
    posted = written(narrow.mapInArrow(put, spec), "op8-lists")
    # One row a list.
    held = {r["list"]: r["count"] for r in posted.groupBy("list").count().collect()}
    sizes = np.array([held.get(i, 0) for i in range(len(index.centroids))])
    queries = written(narrow.join(asked.select("rep").distinct(), "rep", "left_semi").select("rep", "vector").mapInArrow(ask, spec), "op8-asked")
    blocks = posted.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("vs")).join(queries.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("qs")), "list")
    dealt = lambda rows, mine, others, a, b: (
        rows.join(blocks, "list").withColumn(a, F.expr(f"CAST(pmod(xxhash64(rep, 3), {mine}) AS INT)")).withColumn(b, F.explode(F.expr(f"sequence(0, {others} - 1)")))
    )
    both = dealt(posted, "vs", "qs", "vb", "qb").select("list", "vb", "qb", F.lit(False).alias("asks"), "rep", "vector").unionByName(dealt(queries, "qs", "vs", "qb", "vb").select("list", "vb", "qb", F.lit(True).alias("asks"), "rep", "vector"))
    most = nearest + 1

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def flush() -> pa.RecordBatch:
            q = [q for q, (i, _) in best.items() for _ in range(len(i))]
            out = [pa.array(q, pa.int64()), pa.array(np.concatenate([i for i, _ in best.values()]), pa.int64()), pa.array(np.concatenate([s for _, s in best.values()]), pa.float64())]
            best.clear()
            return pa.RecordBatch.from_arrays(out, names=["rep", "found", "score"])

        for run in runs(batches, 3):
            asks = np.concatenate([part.column(3).to_numpy(zero_copy_only=False) for part in run])
            rep = np.concatenate([part.column(4).to_numpy() for part in run])
            x = np.concatenate([_vectors(part.column(5)) for part in run])
            q, v, qi, vi = x[asks], x[~asks], rep[asks], rep[~asks]
            if not len(q) or not len(v):
                continue
            rough = q @ v.T
            keep = min(len(v), most)
            # All that may be equal to the last one stay, so that equal scores go to the smaller id; products differ from sums by rounding.
            slack = 1e-12 * np.linalg.norm(q, axis=1) * np.linalg.norm(v, axis=1).max()
            last = np.partition(rough, len(v) - keep, axis=1)[:, len(v) - keep] - slack
            for k in range(len(q)):
                at = np.flatnonzero(rough[k] >= last[k])
                i = vi[at]
                s = (v[at] * q[k]).sum(axis=1)
                if (old := best.get(int(qi[k]))) is not None:
                    i, s = np.concatenate([old[0], i]), np.concatenate([old[1], s])
                    i, one = np.unique(i, return_index=True)
                    s = s[one]
                order = np.lexsort((i, -s))[:most]
                best[int(qi[k])] = i[order], s[order]
            if len(best) > HELD:
                yield flush()
        if best:
            yield flush()

    meeting = ["list", "vb", "qb"]
    near = both.repartition(*meeting).sortWithinPartitions(*meeting).mapInArrow(multiply, "rep bigint, found bigint, score double").dropDuplicates(["rep", "found"])
    place = F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("score"), "found"))
    near = written(near.withColumn("no", place).where(F.col("no") <= most).drop("no"), "op8-near")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out = asked.join(near, "rep").join(ids, "found").where(F.col("vec_id") != F.col("query_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= nearest).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
