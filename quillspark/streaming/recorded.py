"""Stored study statistics kept up to date by a stream of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from quillspark.operators import recorded
from quillspark.sources import store


def statistics_schema(answers: DataFrame, keys: list[str]) -> str:
    typed = {f.name: f.dataType.simpleString() for f in answers.schema.fields}
    return ", ".join([*(f"{k} {typed[k]}" for k in keys), *(f"{t} bigint" for t in recorded.TOTALS), "stats_days string"])


def record_answers(answers: DataFrame, at: str, keys: list[str], time: str, known: str, writer: str = "answers") -> DataStreamWriter:
    """A writer that adds each micro-batch to the statistics stored at a folder; the caller sets trigger and checkpoint and starts it.

    The number of the batch is that of the commit, so a batch that is run again after a failure counts once. A batch
    rewrites the rows of its own users alone. Answers without a user are left out. A folder has one such stream, as each batch
    goes on from the rows that it reads.
    """
    schema = statistics_schema(answers, keys)

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.dropna(subset=keys)
        users = batch.select(*keys).distinct()
        stats = store.read(spark, at, keys, schema).join(users, keys, "left_semi")
        store.commit(spark, at, recorded.record_answers(stats, batch, keys, time, known), keys, schema, writer, number)

    return answers.writeStream.outputMode("update").foreachBatch(add)
