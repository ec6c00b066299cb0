"""What the operators share: reading tables and cutting lineage in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: Rows of one Arrow batch handed to Python. Texts may be long, so few rows.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset and all runs on this machine, as in tests, a folder of our own; on a cluster it must be set."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='foliant-')}"
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


#: Folders that ``fresh_dir`` has named and ``clear`` has not removed.
_made: list[str] = []


def fresh_dir(spark: SparkSession, label: str) -> str:
    _made.append(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return _made[-1]


def marked() -> int:
    """Where the list of written folders ends now, for ``clear``."""
    return len(_made)


def clear(spark: SparkSession, since: int, keep: DataFrame) -> None:
    """Removes the folders that were written after ``since``, but for what ``keep`` reads; for a caller that needs nothing else of them."""
    used = {f.rsplit("/", 1)[0] for f in keep.inputFiles()}
    for at in [x for x in _made[since:] if not any(u.endswith(x.rsplit("/", 1)[1]) for u in used)]:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _made.remove(at)


def written(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """``df`` as a table in the shared folder: the lineage ends there, and lost executors cost nothing that is done."""
    spark = df.sparkSession
    at = fresh_dir(spark, label)
    df.write.option("compression", compression).parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def fresh_name(wanted: str, taken: list[str]) -> str:
    """A column name that no column has, whatever its case."""
    names = {c.lower() for c in taken}
    while wanted.lower() in names:
        wanted += "_"
    return wanted


_held: dict[str, Any] = {}


def held(key: str, make: Callable[[], Any]) -> Any:
    """What a worker keeps from task to task. It keeps one thing: another key lets go of it, so the memories of operators do not add up."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]
