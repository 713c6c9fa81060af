"""Operators on ordered rows: carried values, neighbours, greedy pairing, continuation folds.

Windows are partitioned by document: order never crosses one, so partitions stay as small as documents; carry_over_ranges() parts
documents too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import cards as C
from quillspark.functions import text as T
from quillspark.sources import files


def carry_forward(df: DataFrame, partition: list[str], order: list, columns: dict[str, Column]) -> DataFrame:
    """Adds, for each new column, the last value that was not null up to and including the row."""
    w = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({name: F.last_value(c, ignoreNulls=True).over(w) for name, c in columns.items()})


def carry_over_ranges(df: DataFrame, partition: list[str], order: list[str], name: str, value: Column) -> DataFrame:
    """carry_forward() of one column, for documents larger than a task: no window sees more than a range of the order.

    Rows are dealt by ranges of document and order and stored once, as a second sample would part them differently. A value is carried
    within its range, and into a range from the last row with a value before it, if that is of the same document.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*partition, *order]
    ranged = df.withColumn("_value", value).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    stored = files.stored(ranged.withColumns({"_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}), "ranges")
    ends = stored.groupBy("_range").agg(F.max_by(F.struct(*partition, "_value"), F.when(F.col("_value").isNotNull(), F.col("_place"))).alias("_end"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = ends.select("_range", F.last_value("_end", ignoreNulls=True).over(earlier).alias("_before"))
    inside = F.last_value("_value", ignoreNulls=True).over(Window.partitionBy("_range", *partition).orderBy("_place").rowsBetween(Window.unboundedPreceding, 0))
    same = F.col("_before").isNotNull()
    for c in partition:
        same = same & F.col(c).eqNullSafe(F.col("_before")[c])
    carried = F.coalesce(F.col("_inside"), F.when(same, F.col("_before._value")))
    out = stored.withColumn("_inside", inside).join(F.broadcast(before), "_range")
    return out.withColumn(name, carried).drop("_value", "_range", "_place", "_inside", "_before")


def neighbours(df: DataFrame, partition: list[str], order: list, accepted: Column, value: str, page: list[str] | None = None) -> DataFrame:
    """Adds the value of the last accepted row before, and of the next row (of the same page)."""
    w = Window.partitionBy(*partition).orderBy(*order)
    before = F.last_value(F.when(accepted, F.col(value)), ignoreNulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.lead(value).over(Window.partitionBy(*(page or partition)).orderBy(*order))
    return df.withColumns({"previous_value": before, "next_value": after})


def pair_greedily(df: DataFrame, partition: list[str], order: list, can_start: Column) -> DataFrame:
    """Adds pair: the position of the first row of each greedy, non-overlapping pair of a starter and its next row.

    Within a run of starters every second one starts a pair, so no loop is needed. can_start may look at
    the next row through columns made with lead().
    """
    w = Window.partitionBy(*partition).orderBy(*order)
    out = df.withColumn("_n", F.row_number().over(w)).withColumn("_s", F.coalesce(can_start, F.lit(False)) & F.lead(F.lit(True)).over(w).isNotNull())
    out = out.withColumn("_run", F.col("_n") - F.sum(F.col("_s").cast("int")).over(w))
    inside = F.row_number().over(Window.partitionBy(*partition, "_run", "_s").orderBy(*order))
    out = out.withColumn("_first", F.col("_s") & (inside % 2 == 1))
    after = F.coalesce(F.lag("_first").over(w), F.lit(False))
    return out.withColumn("pair", F.when(F.col("_first"), F.col("_n")).when(after, F.col("_n") - 1).otherwise(F.col("_n"))).drop("_s", "_run", "_first").withColumnRenamed("_n", "position")


def _joined_rows(rows: DataFrame, partition: list[str], order: list, starts: Column, raw: str) -> DataFrame:
    """Greedy pairs of neighbouring rows as one row: the first one's columns, the text of both, position and n_rows."""
    paired = pair_greedily(rows, partition, order, starts)
    w = Window.partitionBy(*partition, "pair")
    both = paired.withColumns({"_second": F.lead(raw).over(w.orderBy("position")), "n_rows": F.count("*").over(w)}).where("position = pair")
    return both.withColumn(raw, F.when(F.col("n_rows") > 1, C.merge_rows(F.col(raw), F.col("_second"))).otherwise(F.col(raw))).drop("_second", "pair")


def repair_broken_rows(rows: DataFrame, partition: list[str], order: list, side: str = "side", raw: str = "raw") -> DataFrame:
    """Rows whose headword breaks off (an open parenthesis) joined with the next row of the same column; at most two rows become one."""
    w = Window.partitionBy(*partition).orderBy(*order)
    same = rows.withColumn("_same", F.lead(side).over(w) == F.col(side))
    return _joined_rows(same, partition, order, C.is_broken(F.col(raw)) & F.col("_same"), raw).drop("_same")


def prejoin_rows(rows: DataFrame, partition: list[str], order: list, side: str = "side", y: str = "y", raw: str = "raw") -> DataFrame:
    """Rows joined with the next one of their column, near below: after a soft hyphen, or if a separated translation goes on and the next row is a short fragment."""
    w = Window.partitionBy(*partition).orderBy(*order)
    out = rows.withColumns({"_side": F.lead(side).over(w), "_y": F.lead(y).over(w), "_raw": F.lead(raw).over(w)})
    near = (F.col("_side") == F.col(side)) & F.col("_y").isNotNull() & (F.col("_y") - F.col(y) > 0) & (F.col("_y") - F.col(y) < 24)
    filled = (T.normalize_basic(F.col(raw)) != "") & (T.normalize_basic(F.col("_raw")) != "")
    parted = C.split_by_separator(F.filter(F.split(raw, "[ \\t\\n\\r]+"), lambda x: x != ""))
    unfinished = F.coalesce(T.let(parted, lambda p: F.when(p.isNotNull(), C.goes_on_strict(p["translation"]))), F.lit(False))
    starts = near & filled & (T.strip_end(F.col(raw)).endswith(T.SOFT_HYPHEN) | (unfinished & C.is_short_fragment(F.col("_raw"))))
    return _joined_rows(out, partition, order, starts, raw).drop("_side", "_y", "_raw")


def continues_below(y: Column, side: Column, page: Column, last_y: Column, last_side: Column, last_page: Column, reach: float = 27.0) -> Column:
    """A row of the same column and page, a little below."""
    return F.coalesce((side == last_side) & (page == last_page) & (y - last_y > 0) & (y - last_y < reach), F.lit(False))


def continues_across(y: Column, side: Column, page: Column, last_y: Column, last_side: Column, last_page: Column, low: float = 680.0, high: float = 150.0) -> Column:
    """The top of the right column after the bottom of the left one of the same page."""
    return F.coalesce((page == last_page) & (last_side == "left") & (side == "right") & (last_y > low) & (y < high), F.lit(False))


def fold_continuations(rows: DataFrame, partition: str, order: str, text: str, joins: Column, aligned: Column | None = None) -> DataFrame:
    """Appends fragments to the row before: (partition, first order, text, n_rows).

    rows: (partition, order, text, y, side, page); joins: the row may be a fragment. It is appended if it lies just
    below the last row of its card, whose text as joined so far goes on, or at the top of the next column. The joined
    text decides about the next row, so this is a true fold, over the rows of one document in order.
    """
    may = joins if aligned is None else joins & aligned
    row = F.struct(F.col(order).alias("at"), F.coalesce(text, F.lit("")).alias("text"), F.col("y").cast("double").alias("y"), "side", "page", F.coalesce(may, F.lit(False)).alias("may"))
    grouped = rows.groupBy(partition).agg(F.array_sort(F.collect_list(row)).alias("ws"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    card = f"struct<at:{kinds[order]},text:string,n_rows:bigint>"
    start = F.struct(F.array().cast(f"array<{card}>").alias("done"), F.lit(None).cast(card).alias("card"), F.lit(None).cast("double").alias("y"), F.lit(None).cast(kinds["side"]).alias("side"), F.lit(None).cast(kinds["page"]).alias("page"))

    def step(acc: Column, w: Column) -> Column:
        at = (w["y"], w["side"], w["page"], acc["y"], acc["side"], acc["page"])
        near = (continues_below(*at) & C.goes_on_strict(acc["card"]["text"])) | continues_across(*at)
        more = acc["card"].isNotNull() & w["may"] & near
        joined = F.struct(acc["card"]["at"].alias("at"), C.join_continuation(acc["card"]["text"], w["text"]).alias("text"), (acc["card"]["n_rows"] + 1).alias("n_rows"))
        new = F.struct(w["at"].alias("at"), w["text"].alias("text"), F.lit(1).cast("bigint").alias("n_rows"))
        done = F.when(more | acc["card"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["card"])))
        return F.struct(done.alias("done"), F.when(more, joined).otherwise(new).alias("card"), w["y"].alias("y"), w["side"].alias("side"), w["page"].alias("page"))

    cards = F.aggregate("ws", start, step, lambda a: F.concat(a["done"], F.array(a["card"])))
    return grouped.select(partition, F.explode(cards).alias("c")).select(partition, F.col("c.at").alias(order), F.col("c.text").alias(text), "c.n_rows")
