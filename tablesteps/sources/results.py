"""Scores per checkpoint kept in a log that a stopped run can go on from.

The log is a folder of JSON lines, one per finished checkpoint. A checkpoint's line is one file that Spark's committer puts in place
when its job has ended, so a reader meets whole lines only and a lost job leaves none. Of several lines of a checkpoint the last
one counts.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as E

LINE = "checkpoint string, n bigint, exact double, fuzzy double, strict double, flexible double, written timestamp"


def finished(spark: SparkSession, folder: str) -> DataFrame:
    """The last line of every checkpoint in the log; without a log there are none."""
    try:
        lines = spark.read.schema(LINE).json(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        lines = spark.createDataFrame([], LINE)
    whole = F.struct(*[F.col(c) for c in lines.columns])
    return lines.groupBy("checkpoint").agg(F.max_by(whole, "written").alias("l")).select("l.*").drop("written")


def score_open(predictions: DataFrame, folder: str) -> Iterator[str]:
    """Score the checkpoints of (checkpoint, target, prediction, exact) rows that have no finished line, one after the other.

    Yields each name once its line is in the log. Checkpoints are few; each is a job over all its rows. A fuzzy
    score of 0 is not finished and is done again.
    """
    spark = predictions.sparkSession
    names = predictions.select("checkpoint").distinct()
    for row in E.to_redo(names, finished(spark, folder)).orderBy("checkpoint").collect():
        mine = predictions.filter(F.col("checkpoint") == row["checkpoint"])
        line = E.by_checkpoint(E.scored(mine).select("checkpoint", *E.METRICS)).withColumn("written", F.current_timestamp())
        line.coalesce(1).write.mode("append").json(folder)
        yield row["checkpoint"]
