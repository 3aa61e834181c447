"""Size and encoding guards: documents are bytes at the border, strings inside.

``decode`` gives ``struct<text, error>``: permissive rows carry a null text and the
message; ``strict=True`` raises on the first such row. NULL bytes give NULL text and
no error. ``guarded`` puts both guards before an operator, ``batch`` the limits of a
whole batch: bytes are summed, and one bad document fails all, named by its place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BYTES = 10 * 1024 * 1024


def too_large(c: Column, most: int = MOST_BYTES) -> Column:
    return F.octet_length(c) > most


def error_of(c: Column, name: str = "content", most: int = MOST_BYTES) -> Column:
    """The message for bytes that cannot be taken, else NULL."""
    size = F.concat(F.lit("Input too large: "), F.octet_length(c).cast("string"), F.lit(f" bytes (max {most} bytes)"))
    bad = F.try_validate_utf8(c.cast("string")).isNull() & c.isNotNull()
    return F.when(too_large(c, most), size).when(bad, F.lit(f"Invalid UTF-8 in {name}"))


def decode(c: Column, name: str = "content", strict: bool = False, most: int = MOST_BYTES) -> Column:
    error = error_of(c, name, most)
    text = F.when(error.isNull(), F.try_validate_utf8(c.cast("string")))
    if strict:
        return F.struct(F.when(error.isNotNull(), F.raise_error(error).cast("string")).otherwise(text).alias("text"), F.lit(None).cast("string").alias("error"))
    return F.struct(text.alias("text"), error.alias("error"))


def batch_sizes(df: DataFrame, group: str, text: str, most: int = MOST_BYTES) -> DataFrame:
    """``group, n_bytes, accepted``: the limit of a batch holds for the sum of its documents."""
    total = df.groupBy(group).agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("bigint").alias("n_bytes"))
    return total.withColumn("accepted", F.col("n_bytes") <= most)


def guarded(c: Column, operator: Callable[[Column], Column], name: str = "content", most: int = MOST_BYTES) -> Column:
    """``struct<result, error>`` of an operator on bytes; what cannot be taken never reaches it. NULL bytes give NULL and no error."""
    d = decode(c, name, most=most)
    return F.struct(operator(d["text"]).alias("result"), d["error"].alias("error"))


def batch(df: DataFrame, group: str, order: str, content: str, operator: Callable[[Column], Column], name: str = "inputs", most: int = MOST_BYTES) -> DataFrame:
    """``group, order, result, error`` of every document: batches are groups, in the order of a column without repetition.

    A batch of too many bytes, or with a document that is no UTF-8, has the one error in all its rows and no results.
    A NULL document has no bytes and a NULL result. Only sizes and orders are aggregated, never gathered.
    """
    own = df.select(F.col(group), F.col(order), F.col(content).alias("__content"))
    bad = F.try_validate_utf8(F.col("__content").cast("string")).isNull() & F.col("__content").isNotNull()
    sums = own.groupBy(group).agg(F.coalesce(F.sum(F.octet_length("__content")), F.lit(0)).alias("__bytes"), F.min(F.when(bad, F.col(order))).alias("__bad"))
    first = own.join(sums.filter("__bad IS NOT NULL").select(F.col(group).alias("__group"), "__bad"), F.col(group).eqNullSafe(F.col("__group"))).groupBy(group).agg(F.count(F.when(F.col(order) < F.col("__bad"), 1)).alias("__place"))
    large = F.concat(F.lit("Input too large: "), F.col("__bytes").cast("string"), F.lit(f" bytes (max {most} bytes)"))
    error = F.when(F.col("__bytes") > most, large).when(F.col("__bad").isNotNull(), F.concat(F.lit(f"Invalid UTF-8 in {name}["), F.col("__place").cast("string"), F.lit("]")))
    known = sums.join(first.withColumnRenamed(group, "__group"), F.col(group).eqNullSafe(F.col("__group")), "left").select(F.col(group), error.alias("error"))
    text = F.when(F.col("error").isNull(), F.try_validate_utf8(F.col("__content").cast("string")))
    made = own.join(known.withColumnRenamed(group, "__group"), F.col(group).eqNullSafe(F.col("__group")), "left")
    return made.select(F.col(group), F.col(order), operator(text).alias("result"), "error")
