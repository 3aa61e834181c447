"""Views of the tables that several corpus queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.sources.tables import table


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """``tbl, id, text`` of contents and chunks."""
    contents = table(spark, folder, "page_contents").select(F.lit("contents").alias("tbl"), F.col("content_id").alias("id"), F.col("content").alias("text"))
    chunks = table(spark, folder, "chunks").select(F.lit("chunks").alias("tbl"), F.col("chunk_id").alias("id"), "text")
    return contents.unionByName(chunks)
