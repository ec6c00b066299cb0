"""Exact dedup by a tree merge of sorted digest runs (native: DataFrame functions only).

Every input partition makes a run: one record for each digest in it. In binomial rounds ``fan_in`` runs meet,
are merged by sort aggregation, and a record for each digest is retained, with the verified best identifier
and the number of rows. A digest that a third of all rows share is one record for each run from the first
round on, so no task ever meets more than ``fan_in`` records of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: What is deleted before texts are compared.
SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, "")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 256, key_bits: int = 64) -> DataFrame:
    """One narrow row a document: id, code points of the text, sort key, SHA-256, bytes of the normalised text, run."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.length(text).cast("long").alias("chars"), normalised(F.col(text_col)).alias("norm")).select(
        "id", "chars", F.shiftrightunsigned(F.xxhash64("norm"), 64 - key_bits).alias("key") if key_bits < 64 else F.xxhash64("norm").alias("key"),
        F.sha2("norm", 256).alias("sha"), F.octet_length("norm").cast("long").alias("bytes"), (F.spark_partition_id() % runs).alias("run"),
    )


def merged_runs(runs: DataFrame, n_runs: int = 256, fan_in: int = 16) -> DataFrame:
    """The rounds. Records are equal if sort key, SHA-256 and length all are; a key alone never joins two texts."""
    same = ["key", "sha", "bytes"]
    best = F.min(F.struct((-F.col("chars")).alias("less"), F.col("id").isNull().alias("none"), "id"))
    level = runs.groupBy("run", *same).agg(best.alias("best"), F.count(F.lit(1)).alias("rows"))
    while n_runs > 1:
        n_runs = -(-n_runs // fan_in)
        level = level.groupBy(F.floor(F.col("run") / fan_in).cast("int").alias("run"), *same).agg(F.min("best").alias("best"), F.sum("rows").alias("rows"))
    return level.drop("run")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = 256, fan_in: int = 16, key_bits: int = 64) -> DataFrame:
    """A row for every row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are after deleting white space; a null text is empty. Of equal texts that with the
    most code points stays, then that with the smallest id; a null id stays only if its group has no other.
    Rows that repeat the id and the text of the row that stays are that document again and count as kept.
    An empty table gives an empty result; other columns, whatever their names, are not read.
    """
    if runs < 1 or fan_in < 2 or not 1 <= key_bits <= 64:
        raise ValueError("runs >= 1, fan_in >= 2 and 1 <= key_bits <= 64 are needed")
    rows = written(digests(docs, id_col, text_col, runs, key_bits), "op10-digests")
    best = merged_runs(rows, runs, fan_in)
    return rows.join(best, ["key", "sha", "bytes"]).select(
        F.col("id").alias("doc_id"), F.col("best.id").alias("keep_id"), F.col("rows").alias("group_size"),
        (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("chars") == -F.col("best.less"))).alias("kept"), F.col("sha").alias("text_sha256"),
    )
