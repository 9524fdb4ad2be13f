"""Structured Streaming: the batch operators over micro-batches, and windowed facts with a watermark. Keyed state is in ``keyed``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from emberlog.functions import values as V
from emberlog.operators.measure import facts
from emberlog.operators.parse import parse
from emberlog.sources.logs import log_events


def read_events(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """A folder of event files as a stream of log rows; all files that are new make one batch, unless ``files_per_batch`` says how many.

    Files of one batch may be in any order of time. Files of different batches must follow each other in time, but for what the watermark allows.
    """
    reader = spark.readStream.schema(schema)
    return log_events((reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder))


def windowed_facts(logs: DataFrame, delay: str = "15 minutes", seconds: int = V.WINDOW_SECONDS) -> DataFrame:
    """Facts per tumbling window, emitted once the watermark has passed; events later than ``delay`` are left to a replay."""
    records = parse(logs.filter(F.col("level") == "ERROR")).withWatermark("ts", delay)
    w = F.window("ts", f"{int(seconds)} seconds")
    return records.groupBy(w, "namespace", "app_name", "fingerprint").agg(F.count("*").alias("error_count"), F.min("ts").alias("first_event_at"), F.max("ts").alias("last_event_at")).select(F.col("window.start").alias("window_start"), "namespace", "app_name", "fingerprint", "error_count", "first_event_at", "last_event_at")


def distinct_events(logs: DataFrame, delay: str = "15 minutes", key: str = "seq") -> DataFrame:
    """Events delivered twice within the delay count once."""
    return logs.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def page_consumer(consume: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that parses a micro-batch, makes its facts by the batch operator and hands them on."""
    return lambda batch, number: consume(facts(parse(batch.filter(F.col("level") == "ERROR"))), number)


def write_facts(logs: DataFrame, path: str, checkpoint: str):
    """Each micro-batch's facts under a folder of its own number: a batch that is run again overwrites what it wrote."""

    def put(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return logs.writeStream.foreachBatch(page_consumer(put)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
