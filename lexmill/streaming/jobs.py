"""Structured Streaming forms: the stateless expressions of the batch operators, first-wins dedup and event windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexmill.functions import text as X
from lexmill.operators.qa import validated


def stream_table(spark: SparkSession, path: str, files_a_batch: int = 8) -> DataFrame:
    """A Parquet folder or file as a stream."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).option("pathGlobFilter", name if name.endswith(".parquet") else "*.parquet").parquet(folder if name.endswith(".parquet") else path)


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Times without zone are taken as the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def windowed(events: DataFrame, length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and event type; rows later than the watermark are dropped."""
    return _timed(events, late).groupBy(F.window("ts", length, slide or length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    return _timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def first_wins(records: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first record of each question-answer hash within the watermark."""
    return records.withColumn("qa_hash", X.pair_hash(F.col("question"), F.col("answer"))).transform(_timed, late).dropDuplicatesWithinWatermark(["qa_hash"])


def accepted(records: DataFrame) -> DataFrame:
    """Records that pass validation."""
    return validated(records).filter("reject_reason IS NULL").drop("reject_reason")


def append_to(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Rows as Parquet files; with once, all that is there and no more."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def for_each_batch(stream: DataFrame, action: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """An action for each micro-batch; batch numbers let it make repeats harmless."""
    return stream.writeStream.foreachBatch(action).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_files(stream: DataFrame, path: str, mode: str = "complete") -> DataFrame:
    """All input through the stream; what the last micro-batch gives, as Parquet files under path.

    A batch writes its own folder, so a batch that runs again replaces itself. In complete mode the last holds the whole result.
    """
    last: list[int] = []

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch-{number}")
        last[:] = [number]

    job = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    try:
        job.awaitTermination()
    finally:
        job.stop()
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(f"{path}/batch-{last[0]}") if last else spark.createDataFrame([], stream.schema)


def append_once(path: str) -> Callable[[DataFrame, int], None]:
    """An action for for_each_batch: rows become a folder of the batch's number, so a batch that runs again adds nothing."""

    def act(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").option("header", True).csv(f"{path}/batch={number}")

    return act

