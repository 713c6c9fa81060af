"""Daily study statistics as a stream, beyond the batch form: day windows with a watermark for late answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def daily_stats(answers: DataFrame, time: str, known: Column, late: str = "1 day") -> DataFrame:
    """(day, studied, known, learning) of a stream of answers; a day is final once the watermark has passed it."""
    day = F.window(time, "1 day")
    out = answers.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(day.alias("w")).agg(F.count("*").alias("studied"), F.count_if(known).alias("known"), F.count_if(~known).alias("learning"))
    return out.select(F.to_date("w.start").alias("day"), "studied", "known", "learning")
