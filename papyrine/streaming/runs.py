"""Streams run to their end over the tables of a folder, so that their results can be compared with those of batches."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.operators.injection import sanitize_prompt_injection
from papyrine.plans.session import ensure_checkpoint_dir
from papyrine.sources.tables import table
from papyrine.streaming.documents import counts_by_window, first_arrivals, read_documents, transform


def arriving(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The files of a table as a stream; a stream watches folders, so a table of one file is picked out of its folder by name."""
    path, schema = f"{folder}/{name}.parquet", table(spark, folder, name).schema
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return read_documents(spark, path, schema)
    return read_documents(spark, folder, schema, named=f"{name}.parquet")


def finished(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The rows a stream writes until no file is left; results and state lie in the shared checkpoint folder."""
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    place = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:  # a batch run again overwrites its own folder; in complete mode the last one counts
        batch.write.mode("overwrite").parquet(f"{place}/rows/batch={number if mode == 'append' else 0}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/rows").select(stream.columns)


def _utc(name: str) -> Column:
    """A time without zone as that time in UTC, whatever the zone of the session; fractions of a second are dropped."""
    c = F.col(name)
    return F.timestamp_seconds(F.datediff(c, F.lit("1970-01-01").cast("date")).cast("bigint") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c))


def stream_injection(spark: SparkSession, folder: str) -> DataFrame:
    pages = arriving(spark, folder, "pages").select("page_id", F.translate("html", "&", "+").alias("html"))
    return finished(transform(pages, "html", "clean", sanitize_prompt_injection).select("page_id", "clean"))


def stream_first_contents(spark: SparkSession, folder: str) -> DataFrame:
    """One row of each content, however often it arrives."""
    contents = arriving(spark, folder, "page_contents").select("content_id", "page_id", _utc("ingested_at").alias("ingested_at"))
    return finished(first_arrivals(contents, "content_id", "ingested_at", "365 days").select("content_id", "page_id"))


def stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and bytes by day of fetching, late ones included."""
    docs = arriving(spark, folder, "documents").filter("fetched_at IS NOT NULL").withColumn("fetched_at", _utc("fetched_at"))
    made = counts_by_window(docs, "fetched_at", "1 day", "3650 days", text="text")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_seconds("window.start") / 86400).cast("int"))
    return finished(made.select(day.cast("string").alias("day"), "documents", "bytes"), "complete")


def queries() -> dict:
    """All queries, by name."""
    return {f.__name__: f for f in (stream_injection, stream_first_contents, stream_windows)}
