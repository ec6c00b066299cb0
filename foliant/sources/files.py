"""Files of a library: own texts, address lines, segments and links by parts, vectors by model, the stamp of a build."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The name of what stands before the first header, and the longest header.
FRONT_MATTER, LONGEST_HEADER = "0", 120


def decoded(data: Column) -> Column:
    """(text, encoding) of bytes: UTF-8 with or without its mark, UTF-16 if it says so, else windows-1255, in which what it does not define shows as U+FFFD. The Hebrew code page is no charset of the JVM side, so this runs in Python."""

    def one(b: bytes | None) -> tuple[str | None, str | None]:
        if b is None:
            return None, None
        try:
            return b.removeprefix(b"\xef\xbb\xbf").decode("utf-8"), "utf-8"
        except UnicodeDecodeError:
            for mark, name in ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
                if b.startswith(mark):
                    return b[2 : len(b) - len(b) % 2].decode(name, "replace"), "utf-16"
            return b.decode("cp1255", "replace"), "windows-1255"

    def run(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(b) for b in data], columns=["text", "encoding"])

    return F.pandas_udf(run, "text string, encoding string")(data)


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text: parts between blank lines, each on one line; where that gives fewer than two, its lines. Null gives none."""
    trim = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    full = lambda xs: F.filter(F.transform(xs, trim), lambda x: x != "")
    parts = full(F.split(F.coalesce(text, F.lit("")), "\n\n", -1))
    lines = full(F.split(F.coalesce(text, F.lit("")), "\n", -1))
    return F.when(F.size(parts) > 1, F.transform(parts, lambda p: F.array_join(F.transform(F.split(p, "\n", -1), trim), " "))).otherwise(lines)


def own_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, encoding, no, text): a reader's own text files, a row a paragraph, counted from 1."""
    files = spark.read.format("binaryFile").load(path).select("path", decoded(F.col("content")).alias("d"))
    return files.select("path", "d.encoding", F.posexplode(paragraphs(F.col("d.text"))).alias("no", "text")).select("path", "encoding", (F.col("no") + 1).alias("no"), "text")


def has_headings(body: Column) -> Column:
    """Whether a body is headed text; else its lines carry addresses."""
    return F.coalesce(body.rlike(r"(?i)<h[1-6][^>]*>"), F.lit(False))


def address_lines(bodies: DataFrame, key: str, body: str) -> DataFrame:
    """(key, line_no from 1, kind, section, no, text): segments of a body whose headers state their whole address. A header begins with ``@`` or has a rule (four ``=`` or more) under it, and is no longer than a reader could
    type; a rule is no segment. What stands above the first header is section 0. Headers without a sign, which a run of like ones would show, are read as text."""
    lines = F.transform(F.split(body, "\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    rule = lambda x: F.coalesce(x.rlike("^={4,}$"), F.lit(False))
    each = lambda ls: F.transform(ls, lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line"), rule(F.get(ls, i + 1)).alias("ruled")))
    rows = bodies.select(key, F.explode(F.get(F.transform(F.array(lines), each), F.lit(0))).alias("l")).select(key, "l.*").where((F.col("line") != "") & ~rule(F.col("line")))
    text = F.regexp_replace("line", r"^@\s*", "")
    header = (F.col("line").startswith("@") | F.col("ruled")) & F.length(text).between(1, LONGEST_HEADER)
    rows = rows.select(key, "line_no", text.alias("text"), header.alias("h"))
    down = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("s", F.last(F.when(F.col("h"), F.struct("line_no", "text")), ignorenulls=True).over(down))
    inside = Window.partitionBy(key, "s.line_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    no = F.when(~F.col("h"), F.count_if(~F.col("h")).over(inside))
    return rows.select(key, "line_no", F.when(F.col("h"), "heading").otherwise("text").alias("kind"), F.coalesce("s.text", F.lit(FRONT_MATTER)).alias("section"), no.alias("no"), "text")


def write_segments(rows: DataFrame, path: str) -> None:
    """Writes segments (work, ord, ...) by work; the works in ``rows`` replace what was there of them, and the others stay. Ranges of (work, ord) are the tasks, so a long work is several files, each sorted."""
    rows.repartitionByRange("work", "ord").sortWithinPartitions("work", "ord").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("work").parquet(path)


def read_segments(spark: SparkSession, path: str, *works: str) -> DataFrame:
    """Segments as they were written; of some works only, if named, whose folders alone are read."""
    rows = spark.read.parquet(path)
    return rows.where(F.col("work").isin(*works)) if works else rows


def write_edges(edges: DataFrame, path: str, end: str, buckets: int = 64) -> None:
    """Edges by bucket of the work at one end, so that a work's edges are read from one folder. A bucket is written by as many tasks as hold its rows."""
    edges.withColumn("bucket", F.pmod(F.xxhash64(end), F.lit(buckets)).cast("int")).write.partitionBy("bucket").parquet(path)


def read_edges(spark: SparkSession, path: str, end: str, work: str, buckets: int = 64) -> DataFrame:
    b = spark.range(1).select(F.pmod(F.xxhash64(F.lit(work)), F.lit(buckets)).cast("int")).head()[0]  # one number
    return spark.read.parquet(path).where((F.col("bucket") == b) & (F.col(end) == work)).drop("bucket")


def newest_vectors(store: DataFrame, model: str) -> DataFrame:
    """(id, seq, vector): the newest record of each id in a store (id, seq, model, vector) that is of this model; records of other models are not compared with it. ``max_by`` combines before the shuffle."""
    return store.where((F.col("model") == model) & F.col("vector").isNotNull()).groupBy("id").agg(F.max("seq").alias("seq"), F.max_by("vector", "seq").alias("vector"))


def catalogued(catalogue: DataFrame, put: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """A catalogue with rows put in, in place of those with their key, and others removed; what is put and gone is gone."""
    return catalogue.join(put.select(key), key, "left_anti").unionByName(put).join(gone.select(key), key, "left_anti")


def stamp(segments: DataFrame, edges: DataFrame, version: int, built: int | None) -> DataFrame:
    """(works, segments, link_types, state), one row: what a build holds, and whether an index of version ``built`` can be read: none, rebuild or current."""
    held = segments.agg(F.count_distinct("work").alias("works"), F.count(F.lit(1)).alias("segments")).crossJoin(edges.agg(F.count_distinct("edge_type").alias("link_types")))  # one row each
    return held.withColumn("state", F.lit("none" if built is None else "current" if built == version else "rebuild"))


def library_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(name, origin, licence) of libraries; a licence that is not known is null, never a guess."""
    rows = spark.read.schema("name string, origin string, licence string").json(path)
    return rows.withColumn("licence", F.when(~F.lower(F.trim("licence")).isin("", "unknown"), F.trim("licence")))
