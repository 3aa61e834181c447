"""Reading and writing documents: text and binary files, JSON lines, parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.functions.guards import decode


def read_text_files(spark: SparkSession, path: str, strict: bool = False, name: str = "content") -> DataFrame:
    """``path, text, error``: whole files, decoded strictly and bounded in size."""
    files = spark.read.format("binaryFile").load(path).select("path", decode(F.col("content"), name, strict).alias("d"))
    return files.select("path", "d.text", "d.error")


def read_json_lines(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON lines with a stated schema; broken lines are kept in ``_corrupt``."""
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def write_partitioned(df: DataFrame, path: str, by: str | None = None, mode: str = "overwrite", files_rows: int = 2_000_000) -> None:
    """Parquet, by a low-cardinality column if given, with files of bounded rows."""
    writer = df.write.mode(mode).option("maxRecordsPerFile", files_rows)
    (writer.partitionBy(by) if by else writer).parquet(path)
