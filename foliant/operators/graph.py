"""The typed link graph: import, orientation, inversion, masks, pairs, repairs, and traversal in time."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import confidence, edge_type, era_order

#: Types in the order in which a trace prefers them; a type's bit is its place.
TYPES = ["comments-on", "quotes", "paraphrases", "references"]


def shared(spark: SparkSession, label: str) -> str:
    """A new folder's name in that of spark.checkpoint.dir, which driver and executors share."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='foliant-')}"
        spark.sparkContext.setCheckpointDir(at)
    return f"{at.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the folder of spark.checkpoint.dir; the lineage ends there."""
    spark = df.sparkSession
    at = shared(spark, label)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def import_links(rows: DataFrame, near: DataFrame, far: DataFrame) -> DataFrame:
    """Link rows (edge_no, cite_1, cite_2, label) with src, dst and reason. Both ends known: an edge; else exactly one reason. ``near`` and ``far`` map a citation
    to ``n`` places, of which ``place`` is one."""
    a = near.select(F.col("citation").alias("cite_1"), F.col("place").alias("src"), F.col("n").alias("n1"))
    b = far.select(F.col("citation").alias("cite_2"), F.col("place").alias("dst"), F.col("n").alias("n2"))
    out = rows.join(a, "cite_1", "left").join(b, "cite_2", "left")
    reason = F.when(F.col("cite_1").isNull() | F.col("cite_2").isNull(), "no address").when(F.col("n1").isNull(), "near unresolved").when(F.col("n2").isNull(), "far unresolved").when((F.col("n1") > 1) | (F.col("n2") > 1), "ambiguous").otherwise("imported")
    return out.withColumn("reason", reason).withColumn("edge_type", edge_type(F.col("label")))


def import_tally(imported: DataFrame) -> DataFrame:
    return imported.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("edge_type") == "references").alias("untyped"))


def oriented(edges: DataFrame, bases: DataFrame) -> DataFrame:
    """Edges with the ends of ``comments-on`` swapped where the far work declares the near one its base; verdict kept, flipped, undeclared or not asked."""
    d1 = bases.select(F.col("work").alias("src_work"), F.col("base").alias("dst_work"), F.lit(True).alias("_kept"))
    d2 = bases.select(F.col("work").alias("dst_work"), F.col("base").alias("src_work"), F.lit(True).alias("_flip"))
    asked = F.col("edge_type") == "comments-on"
    out = edges.join(d1, ["src_work", "dst_work"], "left").join(d2, ["src_work", "dst_work"], "left")
    verdict = F.when(~asked, "not asked").when(F.col("_kept"), "kept").when(F.col("_flip"), "flipped").otherwise("undeclared")
    out = out.withColumn("verdict", verdict)
    swap = F.col("verdict") == "flipped"
    ends = {c: F.when(swap, F.col(d)).otherwise(F.col(c)) for c, d in (("src_work", "dst_work"), ("dst_work", "src_work"), ("src_ord", "dst_ord"), ("dst_ord", "src_ord"))}
    return out.withColumns(ends).drop("_kept", "_flip")


def inverted(edges: DataFrame) -> DataFrame:
    """Every edge between two works under both of its ends: (work, ord, far_work, far_ord, edge_no, outgoing)."""
    between = edges.where(F.col("src_work") != F.col("dst_work"))
    out = between.select(F.col("src_work").alias("work"), F.col("src_ord").alias("ord"), F.col("dst_work").alias("far_work"), F.col("dst_ord").alias("far_ord"), "edge_no", F.lit(True).alias("outgoing"))
    return out.unionByName(between.select(F.col("dst_work").alias("work"), F.col("dst_ord").alias("ord"), F.col("src_work").alias("far_work"), F.col("src_ord").alias("far_ord"), "edge_no", F.lit(False).alias("outgoing")))


def masks(spans: DataFrame) -> DataFrame:
    """(work, ord, mask): the bits of the edge types that touch a segment, the inside of a span included. ``spans``: work, from_ord, to_ord (null: a point), edge_type."""
    bit = reduce(lambda c, x: c.when(F.col("edge_type") == x[1], 1 << x[0]), list(enumerate(TYPES))[1:], F.when(F.col("edge_type") == TYPES[0], 1))
    each = spans.select("work", F.explode(F.sequence("from_ord", F.greatest("from_ord", F.coalesce("to_ord", "from_ord")))).alias("ord"), bit.alias("bit"))
    return each.groupBy("work", "ord").agg(F.bit_or("bit").alias("mask"))


def companions(edges: DataFrame, most: int = 200) -> DataFrame:
    """(work, other, n, joined): for each work those that it shares most edges with, and how many it is joined to at all."""
    one = edges.where(F.col("src_work") != F.col("dst_work")).groupBy("src_work", "dst_work").agg(F.count(F.lit(1)).alias("n"))
    both = one.select(F.col("src_work").alias("work"), F.col("dst_work").alias("other"), "n").unionByName(one.select(F.col("dst_work").alias("work"), F.col("src_work").alias("other"), "n"))
    pairs = both.groupBy("work", "other").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("work")
    ranked = pairs.withColumn("joined", F.count(F.lit(1)).over(w)).withColumn("no", F.row_number().over(w.orderBy(F.desc("n"), "other")))
    return ranked.where(F.col("no") <= most).drop("no")


def order_agreement(edges: DataFrame, same: int = 25) -> DataFrame:
    """(src_work, dst_work, numbers, same, parallel): over the distinct places that a pair joins, how often both have one number."""
    per = edges.groupBy("src_work", "dst_work", "src_ord").agg(F.bool_or(F.col("src_ord") == F.col("dst_ord")).alias("agrees"))
    out = per.groupBy("src_work", "dst_work").agg(F.count(F.lit(1)).alias("numbers"), F.count_if("agrees").alias("same"))
    return out.withColumn("parallel", F.col("same") >= same)


def repaired(edges: DataFrame, repairs: DataFrame) -> DataFrame:
    """Edges under the last verdict and the last type given by (edge_no, at, verdict, retype), with shipped_type and confidence."""
    last = repairs.groupBy("edge_no").agg(F.max_by("verdict", F.when(F.col("verdict").isNotNull(), F.col("at"))).alias("verdict"), F.max_by("retype", F.when(F.col("retype").isNotNull(), F.col("at"))).alias("retype"))
    out = edges.join(last, "edge_no", "left").withColumn("shipped_type", F.col("edge_type")).withColumn("edge_type", F.coalesce("retype", "edge_type"))
    return out.withColumn("confidence", confidence(F.col("method"), F.col("directed"), F.col("verdict"))).drop("retype")


def orphans(repairs: DataFrame, edges: DataFrame) -> DataFrame:
    return repairs.join(edges.select("edge_no"), "edge_no", "left_anti")


def trace(edges: DataFrame, timeline: DataFrame, start: str, back: bool = True, depth: int = 3, width: int = 8, most_edges: int = 40_000) -> tuple[DataFrame, dict[str, int]]:
    """((node, parent, level, edge_no), refused): the works that ``start`` reaches step by step, each strictly earlier (or later) than the one before.

    ``edges``: edge_no, a, b, type_no, confidence; ``timeline``: node, y0, y1. An edge that is rejected, leads to its own node, to a
    node without years, of the same time, or of the wrong time is counted by that reason. A node belongs to the parent that comes first, by the edge that comes first, and is
    then ranked among that parent's: type, confidence, gap of years, name; those beyond ``width`` are never reached again. One join for each level.
    """
    spark = edges.sparkSession
    way = "after" if back else "before"
    ends = edges.select("edge_no", F.col("a").alias("node"), F.col("b").alias("far"), "type_no", "confidence").unionByName(edges.select("edge_no", F.col("b").alias("node"), F.col("a").alias("far"), "type_no", "confidence"))
    front = spark.createDataFrame([(start, 0)], "node string, bfs bigint")
    seen, found, refused, opened = front.select("node"), [], {}, 0
    for level in range(1, depth + 1):
        t = timeline.select(F.col("node").alias("n_"), F.col("y0").alias("a0"), F.col("y1").alias("a1"))
        u = timeline.select(F.col("node").alias("f_"), F.col("y0").alias("b0"), F.col("y1").alias("b1"))
        near = front.join(ends, "node").join(t, F.col("node") == F.col("n_"), "left").join(u, F.col("far") == F.col("f_"), "left")
        order = era_order(F.col("a0"), F.col("a1"), F.col("b0"), F.col("b1"))
        why = F.when(F.col("confidence") <= 0, "rejected").when(F.col("far") == F.col("node"), "same work").when(order == "unknown", "unknown date").when(order == "contemporary", "contemporary").when(order != way, "wrong way").otherwise("taken")
        near = cut(near.withColumn("why", why).select("node", "bfs", "far", "edge_no", "type_no", "confidence", "why", F.least(F.abs(F.col("a0") - F.col("b1")), F.abs(F.col("b0") - F.col("a1"))).alias("gap")), "trace")
        # One row a reason.
        for r in near.groupBy("why").count().collect():
            opened += r["count"]
            if r["why"] != "taken":
                refused[r["why"]] = refused.get(r["why"], 0) + r["count"]
        fresh = near.where("why = 'taken'").join(seen.select(F.col("node").alias("far")), "far", "left_anti")
        first = fresh.withColumn("no", F.row_number().over(Window.partitionBy("far").orderBy("bfs", "edge_no"))).where("no = 1").drop("no")
        first = first.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("type_no", F.desc("confidence"), "gap", "far")))
        first = cut(first, "trace")
        seen = cut(seen.unionByName(first.select(F.col("far").alias("node"))), "trace-seen")
        kept = first.where(F.col("place") <= width)
        found.append(kept.select(F.col("far").alias("node"), F.col("node").alias("parent"), F.lit(level).alias("level"), "edge_no"))
        front = kept.select(F.col("far").alias("node"), (F.col("bfs") * (width + 1) + F.col("place")).alias("bfs"))
        if opened > most_edges:
            refused["budget"] = opened
            break
    return reduce(DataFrame.unionByName, found), refused


def distances(edges: DataFrame, start: str, most: int = 12) -> DataFrame:
    """(node, steps): the least number of edges from ``start``, up to ``most``; the frontier alone is joined at each step."""
    ends = cut(edges.select(F.col("a").alias("node"), F.col("b").alias("far")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("far"))).distinct(), "path-ends")
    front = edges.sparkSession.createDataFrame([(start,)], "node string")
    out = [front.select("node", F.lit(0).alias("steps"))]
    seen = front
    for step in range(1, most + 1):
        front = cut(front.join(ends, "node").select(F.col("far").alias("node")).distinct().join(seen, "node", "left_anti"), "path-front")
        if front.isEmpty():
            break
        out.append(front.select("node", F.lit(step).alias("steps")))
        seen = cut(seen.unionByName(front), "path-seen")
    return reduce(DataFrame.unionByName, out)


def path(edges: DataFrame, start: str, end: str, most: int = 12) -> DataFrame:
    """(outcome, steps): path, or not within ``most``."""
    got = distances(edges, start, most).where(F.col("node") == end).agg(F.min("steps").cast("int").alias("steps"))
    return got.select(F.when(F.col("steps").isNull(), "not within").otherwise("path").alias("outcome"), "steps")


def path_steps(edges: DataFrame, start: str, end: str, most: int = 12, most_edges: int = 1_000_000) -> DataFrame:
    """(outcome, steps, path): a shortest path from both sides, the smaller frontier going on at each step; its nodes, of equal ways the least names near either end. ``not within`` where none has at most ``most`` steps
    or so many edges have been opened, ``none`` where one side has nowhere left to go."""
    ends = cut(edges.select(F.col("a").alias("node"), F.col("b").alias("far")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("far"))).where("node <> far").distinct(), "path-ends")
    spark = edges.sparkSession
    sides = [cut(spark.createDataFrame([(x, [x])], "node string, way array<string>"), "path-side") for x in (start, end)]
    fronts, sizes, opened = list(sides), [1, 1], 0
    outcome, steps = "not within", 0
    while True:
        met = sides[0].join(sides[1].select("node", F.col("way").alias("back")), "node").select(F.concat("way", F.slice(F.reverse("back"), F.lit(2), F.size("back"))).alias("path"))
        if best := met.orderBy(F.size("path"), "path").head():
            return spark.createDataFrame([("path", len(best["path"]) - 1, best["path"])], "outcome string, steps int, path array<string>")
        if steps >= most or opened > most_edges:
            break
        i = 0 if sizes[0] <= sizes[1] else 1
        found = fronts[i].join(ends, "node").select(F.col("far").alias("node"), F.concat("way", F.array("far")).alias("way")).join(sides[i].select("node"), "node", "left_anti")
        fronts[i] = cut(found.groupBy("node").agg(F.min("way").alias("way")), "path-front")
        sizes[i] = fronts[i].count()
        opened, steps = opened + sizes[i], steps + 1
        if not sizes[i]:
            outcome = "none"
            break
        sides[i] = cut(sides[i].unionByName(fronts[i]), "path-side")
    return spark.createDataFrame([(outcome, None, None)], "outcome string, steps int, path array<string>")


def forks(edges: DataFrame, start: str, chunk: int = 256) -> DataFrame:
    """(x, y, witnesses, joined): pairs of works next to ``start`` with the works next to both, start left out; joined if they are linked themselves.

    Works with the same witnesses are a class (their number and two 64-bit hashes of the set say which), and witnesses are counted by an equi-join on the witness between a member of each class
    only. The pairs then come from blocks, a chunk of a class's members against another, so that what is moved is a block and tasks have about as many pairs each.
    """
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("far")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("far"))).where("node <> far").distinct()
    ends = cut(ends, "fork-ends")
    side = ends.where(F.col("node") == start).select(F.col("far").alias("r"))
    reach = cut(side.join(ends, F.col("r") == F.col("node")).where(F.col("far") != start).select("r", F.col("far").alias("w")), "fork-reach")
    sets = reach.groupBy("r").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("w")).alias("h"), F.bit_xor(F.xxhash64(F.lit(1), "w")).alias("g"))
    sets = cut(sets, "fork-sets")
    classes = cut(sets.groupBy("n", "h", "g").agg(F.min("r").alias("c"), F.count(F.lit(1)).alias("size")).withColumn("chunks", F.ceil(F.col("size") / chunk)), "fork-classes")
    members = cut(sets.join(classes, ["n", "h", "g"]).select("c", F.pmod(F.xxhash64("r"), "chunks").alias("k"), "r"), "fork-members")
    # Pairs of classes with what their members share; a class with itself too.
    one = reach.join(classes.select(F.col("c").alias("r")), "r").select(F.col("r").alias("c"), "w")
    met = one.select(F.col("c").alias("c1"), "w").join(one.select(F.col("c").alias("c2"), "w"), "w").where("c1 <= c2").groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("witnesses"))
    size = lambda i: classes.select(F.col("c").alias(f"c{i}"), F.col("size").alias(f"size{i}"), F.col("chunks").alias(f"chunks{i}"))
    met = cut(met.join(size(1), "c1").join(size(2), "c2"), "fork-classes-met")
    tasks = min(100_000, 1 + int(met.agg(F.sum(F.col("size1").cast("double") * F.col("size2"))).head()[0] or 0) // 4_000_000)
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    blocks = met.where("size1 > 1 OR c1 <> c2").withColumn("k1", upto("chunks1")).repartition("c1", "k1", "c2").withColumn("k2", upto("chunks2")).where("c1 <> c2 OR k1 <= k2").select("c1", "k1", "c2", "k2", "witnesses")
    # Links between the works themselves, by block.
    of = lambda v, i: members.select(F.col("r").alias(v), F.struct("c", "k").alias(f"_{i}"))
    direct = ends.where("node < far").join(of("node", 1), "node").join(of("far", 2), "far").withColumn("_in", F.col("_1") <= F.col("_2"))
    a, b, r1, r2 = (F.when(F.col("_in"), F.col(x)).otherwise(F.col(y)) for x, y in (("_1", "_2"), ("_2", "_1"), ("node", "far"), ("far", "node")))
    direct = direct.select(a["c"].alias("c1"), a["k"].alias("k1"), b["c"].alias("c2"), b["k"].alias("k2"), r1.alias("r1"), r2.alias("r2"))
    key = ["c1", "k1", "c2", "k2"]
    direct = direct.groupBy(*key, "r1").agg(F.collect_list("r2").alias("js")).groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("r1", "js"))).alias("js"))
    chunks = members.groupBy("c", "k").agg(F.collect_list("r").alias("rs"))
    for i in (1, 2):
        blocks = blocks.join(chunks.toDF(f"c{i}", f"k{i}", f"rs{i}"), [f"c{i}", f"k{i}"])
    blocks = blocks.join(direct, key, "left").repartition(tasks, *key)
    same = (F.col("c1") == F.col("c2")) & (F.col("k1") == F.col("k2"))
    each = blocks.select(same.alias("same"), "witnesses", "js", "rs2", F.explode("rs1").alias("r1")).withColumn("js", F.try_element_at("js", "r1"))
    each = each.select("same", "witnesses", "js", "r1", F.explode("rs2").alias("r2")).where("NOT same OR r1 < r2")
    joined = F.col("js").isNotNull() & F.coalesce(F.array_contains("js", F.col("r2")), F.lit(False))
    return each.select(F.least("r1", "r2").alias("x"), F.greatest("r1", "r2").alias("y"), "witnesses", joined.alias("joined"))
