"""Streaming use of the operators: file sources, row-wise transformation, deduplicated late data, learning per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from papyrine.operators.boilerplate import page_blocks


def read_documents(spark: SparkSession, folder: str, schema, files_per_trigger: int = 100, named: str | None = None) -> DataFrame:
    """A stream of parquet files as they arrive, only those of a name (a glob) if one is given."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return (reader.option("pathGlobFilter", named) if named else reader).parquet(folder)


def transform(stream: DataFrame, source: str, target: str, operator: Callable[[Column], Column]) -> DataFrame:
    """Any operator from Column to Column, on a stream as on a table."""
    return stream.withColumn(target, operator(F.col(source)))


def first_arrivals(stream: DataFrame, key: str, event_time: str, lateness: str = "30 days") -> DataFrame:
    """One row per key, with state held for ``lateness`` only; later repeats are dropped as long as it lasts."""
    return stream.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark([key])


def counts_by_window(stream: DataFrame, event_time: str, size: str, lateness: str, *keys: str, text: str | None = None) -> DataFrame:
    """Documents by time window and keys, and with ``text`` named its bytes (0 where all are null), late data included up to ``lateness``."""
    window = F.window(event_time, size)
    made = [F.count(F.lit(1)).alias("documents")]
    if text is not None:
        made.append(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes"))
    return stream.withWatermark(event_time, lateness).groupBy(window, *keys).agg(*made)


def collect_blocks(stream: DataFrame, path: str, checkpoint: str, **columns: str) -> StreamingQuery:
    """Candidate boilerplate blocks of arriving pages, appended to a table from which ``boilerplate.learn`` learns removals in batch.

    A batch that is run again overwrites its own folder, so a lost executor or driver
    leaves no repeated blocks.
    """

    def write(batch: DataFrame, number: int) -> None:
        page_blocks(batch, **columns).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
