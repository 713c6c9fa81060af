"""Scratch tables and files in the folder that the cluster shares (spark.checkpoint.dir)."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def root(spark: SparkSession) -> str:
    """The shared folder named by the session; on a local master without one, a temporary folder is set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext.getCheckpointDir()
        if held:
            return held
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.sparkContext.setCheckpointDir(at)
        return spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; nothing is there yet."""
    return f"{root(spark)}/quillspark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


#: Folders of stored tables, in the order they were made; the driver alone keeps this list.
_MADE: list[str] = []


#: Spark drops the shuffle files of a query when it ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts lineage and survives lost executors; its shuffle files go at once."""
    spark = df.sparkSession
    at, before = folder(spark, name), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(at)
    finally:
        spark.conf.set(_CLEANUP, before)
    _MADE.append(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out.stored_at = at
    return out


def mark() -> int:
    """A moment; see cleared()."""
    return len(_MADE)


def cleared(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Deletes the tables stored since a moment, but for those kept; no later plan may read them."""
    kept = {x.stored_at for x in keep}
    for at in _MADE[since:]:
        if at not in kept:
            removed(spark, at)
    _MADE[since:] = [at for at in _MADE[since:] if at in kept]


#: Rows that go to Python at once: texts of kilobytes each make batches of a few megabytes.
ARROW_ROWS = 1024


def few_rows(spark: SparkSession) -> None:
    """Lowers the session's rows of an Arrow batch to ARROW_ROWS, as batches of long texts are held outside the heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, ARROW_ROWS)


def quoted(name: str) -> str:
    """A column name that may hold dots and backticks, as an expression."""
    return "`" + name.replace("`", "``") + "`"


def packed(df: DataFrame):
    """All columns of a row as the one column row, so that their names cannot clash with an operator's own."""
    return F.struct(*(F.col(quoted(c)) for c in df.columns)).alias("row")


def unpacked(rows: DataFrame, like: DataFrame) -> DataFrame:
    """The columns that packed() took."""
    return rows.select(*(F.col("row").getField(c).alias(c) for c in like.columns))


def removed(spark: SparkSession, at: str) -> None:
    """Deletes a scratch path through Hadoop's file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The Arrow file system and the path in it, on driver or executor."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path
