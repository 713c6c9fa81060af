"""A keyed table in layers: each commit adds one layer of changed rows, and a small numbered head names the layers that count.

A head appears by one rename that fails if its number is taken, so readers see whole commits only and two writers cannot
publish the same number (file systems with an atomic rename; on others a folder may have one writer at a time). Each commit names
its writer and a number that rises; a commit whose number is not above the writer's last one is dropped, so
a repeated one, as after a lost driver or a replayed micro-batch, changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Commits that lie on top of each other before one writes the whole table anew.
MAX_LAYERS = 8


def rename_new(spark: SparkSession, source: str, target: str) -> bool:
    """Moves a file or folder; False if the target is there already."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    here = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(target).toUri(), conf) if "://" in target else jvm.org.apache.hadoop.fs.FileContext.getFileContext(conf)
    if here.util().exists(path(target)):
        return False
    here.mkdir(path(target).getParent(), jvm.org.apache.hadoop.fs.permission.FsPermission.getDirDefault(), True)
    plain = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        here.rename(path(source), path(target), plain)
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            return False
        raise
    return True


def exists(spark: SparkSession, at: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def drop(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def head(spark: SparkSession, at: str) -> tuple[int, dict]:
    """Number and content of the newest head: its layers, oldest first, and the last commit of each writer; 0 before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/heads")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    n = max((int(f.getPath().getName()) for f in fs.listStatus(path)), default=0) if fs.exists(path) else 0
    return (n, json.loads(spark.read.text(f"{at}/heads/{n}").first()[0])) if n else (0, {"layers": [], "done": {}})


def read(spark: SparkSession, at: str, keys: list[str], schema: str, state: dict | None = None) -> DataFrame:
    """The table as the newest head (or a given one) has it: of each key the row of the newest layer, unless that took it away. One shuffle by key."""
    state = state or head(spark, at)[1]
    fields = spark.createDataFrame([], schema).schema
    if not state["layers"]:
        return spark.createDataFrame([], fields)
    stored = spark.createDataFrame([], f"{schema}, _gone boolean").schema
    rows = None
    for n, layer in enumerate(state["layers"]):
        part = spark.read.schema(stored).parquet(f"{at}/layers/{layer}").withColumn("_layer", F.lit(n))
        rows = part if rows is None else rows.unionByName(part)
    newest = rows.where("NOT _gone") if len(state["layers"]) == 1 else rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), "_layer").alias("_row")).select(*keys, "_row.*").where("NOT _gone")
    return newest.select(*fields.names)


def commit(spark: SparkSession, at: str, changes: DataFrame, keys: list[str], schema: str, writer: str, number: int) -> bool:
    """Puts rows (schema, one a key, and where there is a column _gone, rows to take away); False if that commit was made before.

    Rows that repeat a key raise nothing: the largest row counts. When another writer comes first, the commit goes on top of its head.
    After MAX_LAYERS layers the whole table is written as one; a superseded layer is kept for readers that have begun, and
    dropped by the next such commit.
    """
    state = head(spark, at)[1]
    if state["done"].get(writer, -1) >= number:
        return False
    names = spark.createDataFrame([], schema).schema.names
    gone = F.coalesce("_gone", F.lit(False)) if "_gone" in changes.columns else F.lit(False)
    rest = F.struct(*[c for c in names if c not in keys], "_gone")
    rows = changes.withColumn("_gone", gone).groupBy(*keys).agg(F.max(rest).alias("_row")).select(*keys, "_row.*").select(*names, "_gone")
    layer = uuid.uuid4().hex
    rows.write.parquet(f"{at}/layers/{layer}")
    while True:
        n, state = head(spark, at)
        if state["done"].get(writer, -1) >= number:  # the same commit, made elsewhere meanwhile
            drop(spark, f"{at}/layers/{layer}")
            return False
        layers, old = [*state["layers"], layer], state.get("old", [])
        if len(layers) > MAX_LAYERS:
            whole = uuid.uuid4().hex
            read(spark, at, keys, schema, {"layers": layers}).withColumn("_gone", F.lit(False)).write.parquet(f"{at}/layers/{whole}")
            layers, old, stale = [whole], layers, old
        else:
            whole, stale = None, []
        content = json.dumps({"layers": layers, "done": state["done"] | {writer: number}, "old": old}, sort_keys=True)
        waiting = f"{at}/waiting/{uuid.uuid4().hex}"
        spark.createDataFrame([(content,)], "value string").coalesce(1).write.text(waiting)
        if rename_new(spark, waiting, f"{at}/heads/{n + 1}"):
            for name in stale:
                drop(spark, f"{at}/layers/{name}")
            if n > 1:
                drop(spark, f"{at}/heads/{n - 1}")  # the one before stays for readers that have begun
            return True
        drop(spark, waiting)
        if whole:
            drop(spark, f"{at}/layers/{whole}")
