"""Sources: named tables, headed text, nested JSON, links as CSV and JSON, and landed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LINK_COLUMNS = "`Citation 1` STRING, `Citation 2` STRING, `Conection Type` STRING, `Text 1` STRING, `Text 2` STRING, `Category 1` STRING, `Category 2` STRING"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def link_csv(spark: SparkSession, path: str) -> DataFrame:
    """Link rows with quoted fields, under the headers that the files have, misspelling included."""
    return spark.read.csv(path, schema=LINK_COLUMNS, header=True, quote='"', escape='"').toDF("citation_1", "citation_2", "label", "text_1", "text_2", "category_1", "category_2")


def link_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("line_index_1 BIGINT, path_2 STRING, line_index_2 BIGINT, heRef_2 STRING, `Conection Type` STRING").json(path, multiLine=True)


def nested_json(works: DataFrame, depth: int) -> DataFrame:
    """(slug, path, text) of works (slug, json) whose text is an array nested ``depth`` deep; ragged and missing parts give no rows. Paths count from 1."""
    kind = "string"
    for _ in range(depth):
        kind = f"array<{kind}>"
    rows = works.select("slug", F.from_json("json", f"struct<text:{kind}>")["text"].alias("node"), F.array().cast("array<int>").alias("path"))
    for _ in range(depth):
        rows = rows.select("slug", "path", F.posexplode("node").alias("i", "node")).select("slug", "node", F.concat("path", F.array(F.col("i") + 1)).alias("path"))
    return rows.where(F.length(F.trim("node")) > 0).select("slug", "path", F.col("node").alias("text"))


def headed_text(bodies: DataFrame, key: str, body: str) -> DataFrame:
    """(key, line_no, section, text): a segment for each line that is neither blank nor a heading, under the path of the headings ``<h1>`` to ``<h6>`` above it."""
    lines = bodies.select(key, F.posexplode(F.split(body, "\n", -1)).alias("line_no", "line")).where(F.length(F.trim("line")) > 0)
    lines = lines.withColumn("level", F.expr(r"CAST(nullif(regexp_extract(line, '^\\s*<h([1-6])[^>]*>', 1), '') AS INT)")).withColumn("label", F.regexp_extract("line", r"<h[1-6][^>]*>(.*?)</h[1-6]>", 1))
    down = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    # A heading counts as long as no higher one has come after it.
    seen = [F.last(F.when(F.col("level") == n, F.struct("line_no", "label")), ignorenulls=True).over(down).alias(f"h{n}") for n in range(1, 7)]
    higher = [F.last(F.when(F.col("level") < n, F.col("line_no")), ignorenulls=True).over(down).alias(f"u{n}") for n in range(1, 7)]
    rows = lines.select("*", *seen, *higher).where(F.col("level").isNull())
    parts = [F.when(F.col(f"u{n}").isNull() | (F.col(f"u{n}") < F.col(f"h{n}.line_no")), F.col(f"h{n}.label")) for n in range(1, 7)]
    return rows.select(key, "line_no", F.array_join(F.array_compact(F.array(*parts)), " / ").alias("section"), F.col("line").alias("text"))


def catalogue_union(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Two catalogues as one; where both have a key, the first one's row stands."""
    both = first.withColumn("_no", F.lit(0)).unionByName(second.withColumn("_no", F.lit(1)), allowMissingColumns=True)
    best = F.row_number().over(Window.partitionBy(key).orderBy("_no"))
    return both.withColumn("_n", best).where("_n = 1").drop("_n", "_no")
