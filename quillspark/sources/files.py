"""Readers and writers of record files, through Spark's own sources."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspark.operators.quality import gate
from quillspark.sources.store import drop, rename_new

CARD = "id STRING, swedish STRING, forms STRING, english STRING, level STRING, chapter INT, page INT, source STRING, source_pdf_page INT, parse_method STRING"
WORD = "id STRING, swedish STRING, english ARRAY<STRING>, cefr STRING, pos STRING, article STRING, ipa ARRAY<STRING>, examples ARRAY<STRING>"


def read_list(spark: SparkSession, path: str, schema: str | StructType = CARD) -> DataFrame:
    """A JSON list of objects, or one object a line."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_words(spark: SparkSession, path: str, schema: str = WORD) -> DataFrame:
    """Words as a JSON list or under "words" of one object; other shapes raise when read."""
    whole = spark.read.text(path, wholetext=True).select(F.col("value").alias("v"))
    listed = F.from_json("v", f"array<struct<{_fields(schema)}>>")
    nested = F.from_json("v", f"struct<words: array<struct<{_fields(schema)}>>>")["words"]
    shape = F.regexp_extract("v", r"^\ufeff?\s*(.)", 1)
    rows = F.when(shape == "[", listed).when(shape == "{", nested)
    rows = F.coalesce(rows, F.raise_error(F.lit("words must be a list or stand under 'words'")).cast(f"array<struct<{_fields(schema)}>>"))
    return whole.select(F.explode(rows).alias("w")).select("w.*")


def _fields(ddl: str) -> str:
    return ", ".join(f"{p.split(' ', 1)[0]}: {p.split(' ', 1)[1]}" for p in ddl.split(", "))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """Lines "word pronunciation": (word, ord, sampa); lines with one field are skipped, a byte order mark is dropped.

    ord is (file, start of the split, row): it sorts like the lines of the files by path, however splits are dealt to tasks,
    as Spark may put several splits into one task in any order, but reads each from its start to its end.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    lines = spark.read.text(path).select("value", place.alias("ord"))
    line = F.regexp_replace("value", "^\ufeff", "")
    rows = lines.select(F.regexp_extract(line, r"^\s*(\S+)\s+(.*\S)\s*$", 1).alias("word"), "ord", F.regexp_extract(line, r"^\s*(\S+)\s+(.*\S)\s*$", 2).alias("sampa"))
    return rows.where("word <> ''")


def work_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; on a local master without one, a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quillspark-")
    return f"{at.rstrip('/')}/quillspark-files/{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df written as Parquet to the shared folder and read back: what a plan reads twice is then evaluated once, and survives lost executors."""
    at = f"{work_folder(df.sparkSession)}-{name}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def presence(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(name, path, present, first) of expected text files: whether each can be read, and its first line."""

    def first(path: str) -> tuple[bool, str | None]:
        try:
            row = spark.read.text(path).limit(1).collect()
        except AnalysisException:
            return False, None
        return True, row[0][0] if row else None

    rows = [(name, path, *first(path)) for name, path in paths.items()]  # a few names, given by the caller
    return spark.createDataFrame(rows, "name string, path string, present boolean, first string")


def read_assets(spark: SparkSession, path: str, schema: str = WORD) -> DataFrame:
    """Words of a JSON list file; anything but a list of objects raises when read."""
    whole = spark.read.text(path, wholetext=True).select(F.col("value").alias("v"))
    is_list = F.col("v").rlike(r"^\ufeff?\s*\[")
    items = F.from_json("v", "array<string>")
    sound = is_list & items.isNotNull() & F.forall(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.coalesce(x.rlike(r"^\s*\{"), F.lit(False)))
    kind = f"array<struct<{_fields(schema)}>>"
    rows = F.when(sound, F.from_json("v", kind)).otherwise(F.raise_error(F.lit("an asset must be a list of objects")).cast(kind))
    return whole.select(F.explode(rows).alias("w")).select("w.*")


def read_lines(spark: SparkSession, path: str, schema: str | StructType = CARD) -> DataFrame:
    """JSON objects, one a line."""
    return spark.read.schema(schema).json(path)


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_checked(df: DataFrame, errors: DataFrame, path: str, report: str | None = None) -> None:
    """Writes only if there are no errors; the report of errors by rule is written in any case."""
    if report:
        write_report(errors.groupBy("rule").agg(F.count("*").alias("value")).withColumnRenamed("rule", "metric"), report)
    gate(df, errors).write.mode("overwrite").json(path)


def write_observed(df: DataFrame, rules: dict[str, Column], path: str, report: str | None = None) -> dict[str, int]:
    """Writes df as JSON lines and counts its rows and those against each rule in the same scan; returns the counts.

    The rows go to a waiting folder, which takes the place of `path` only if no rule holds for any row; else it is dropped,
    ValueError is raised, and what stood at `path` stays. The report is written in any case. Rules are Columns of
    true, false or null (not counted). Unlike write_checked() this reads df once, but rules must look at one row alone.
    """
    spark, waiting, found = df.sparkSession, f"{path.rstrip('/')}-waiting-{uuid.uuid4().hex}", Observation()
    df.observe(found, F.count("*").alias("ROWS"), *[F.count_if(rule).alias(name) for name, rule in rules.items()]).write.json(waiting)
    counts = {name: int(n) for name, n in found.get.items()}
    if report:
        write_report(spark.createDataFrame(sorted(counts.items()), "metric string, value long"), report)
    bad = {name: n for name, n in counts.items() if n and name != "ROWS"}
    if bad:
        drop(spark, waiting)
        raise ValueError(f"not written: {bad}")
    drop(spark, path)
    if not rename_new(spark, waiting, path):
        raise FileExistsError(path)
    return counts


def write_events(events: DataFrame, kind: str, path: str) -> None:
    """Events as JSON lines in one folder of each kind; every task writes its own file of a kind, so no kind is gathered anywhere."""
    events.write.mode("overwrite").partitionBy(kind).json(path)


def read_events(spark: SparkSession, path: str, kinds: list[str], kind: str, schema: str) -> DataFrame:
    """The events of some kinds: folders of others are not opened."""
    return spark.read.schema(f"{schema}, {kind} string").json(path).where(F.col(kind).isin(kinds))


def write_report(metrics: DataFrame, path: str) -> None:
    """A report is small: one file of lines, by metric."""
    report_lines(metrics.orderBy("metric")).coalesce(1).write.mode("overwrite").text(path)


def report_lines(metrics: DataFrame, width: int = 40) -> DataFrame:
    """(metric, value) as lines of a fixed-width report."""
    return metrics.select(F.concat(F.rpad("metric", width, " "), F.lpad(F.col("value").cast("string"), 12, " ")).alias("value"))


def report_sections(spark: SparkSession, sections: list[tuple[str, DataFrame, list, int | None]], width: int = 78) -> DataFrame:
    """(section, line, value): a report of titled sections, each a title, a rule and the lines of a DataFrame (value).

    A section names the order of its lines and how many of them it shows: figures and histograms show all their groups (None, for
    DataFrames of a bounded number of rows), samples of cases the first few; a section that shows fewer than there are says so with
    their number in a last line. Only shown lines are numbered, so no window sees a table of cases.
    """
    out = spark.createDataFrame([(k, n, v) for k, (title, *_) in enumerate(sections) for n, v in enumerate((title, "-" * width))], "section int, line int, value string")
    for k, (_, rows, order, show) in enumerate(sections):
        keyed = rows.select(F.struct(*order).alias("_at"), "value")
        some = keyed if show is None else keyed.orderBy("_at").limit(show)
        lines = some.agg(F.array_sort(F.collect_list(F.struct("_at", "value"))).alias("_l")).select(F.posexplode("_l").alias("n", "l"))
        out = out.unionByName(lines.select(F.lit(k).alias("section"), (F.col("n") + 2).alias("line"), F.col("l.value").alias("value")))
        if show is not None:
            left = rows.agg(F.count("*").alias("n")).where(F.col("n") > show)
            out = out.unionByName(left.select(F.lit(k).alias("section"), F.lit(show + 2).alias("line"), F.format_string("... and %d more", F.col("n") - show).alias("value")))
    return out
