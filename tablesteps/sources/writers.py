"""Writers: split data sets, metrics, predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def save_dataset(df: DataFrame, path: str) -> None:
    """Parquet with one folder per split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def save_metrics(df: DataFrame, path: str) -> None:
    """One JSON object per line."""
    df.write.mode("overwrite").json(path)


def save_lines(df: DataFrame, column: str, path: str, order: Sequence[Column] = (), parts: int | None = None) -> None:
    """One prediction per line; line breaks inside a prediction become blanks, a null is an empty line.

    With ``order`` the lines are range-partitioned and sorted: the numbered part files, one after the other, are the lines in
    order, and no task holds more than its range; their number is ``parts`` or follows from the size. Without it lines stay in the order of the partitions. ``read_lines`` gives the places back.
    """
    line = F.coalesce(F.regexp_replace(F.col(column).cast("string"), r"[\r\n]+", " "), F.lit(""))
    lines = df.withColumn("_line", line)
    if order:
        by = order if parts is None else (parts, *order)
        lines = lines.repartitionByRange(*by).sortWithinPartitions(*order)
    lines.select(F.col("_line").alias("value")).write.mode("overwrite").text(path)


def save_by_id(df: DataFrame, table: str, path: str, buckets: int, key: str = "id") -> None:
    """A table at ``path`` bucketed and sorted by a key: tables with equally many buckets join by it without a shuffle.

    The rows are dealt by the key first, so a bucket is one file.
    """
    dealt = df.repartition(buckets, key)
    dealt.write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(table)
