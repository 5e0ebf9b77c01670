"""Scoring of answer tables and roll-ups per checkpoint and per operator kind."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S

# Operator kinds of a query plan.
KINDS = ["P", "C", "S", "GB", "H", "OB", "A", "OP", "L"]
METRICS = ["exact", "fuzzy", "strict", "flexible"]


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly. Answers are short and their scores dear: a file small enough for one task of a scan is work for many."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def with_typed_sets(df: DataFrame, target: str = "target", predicted: str = "prediction") -> DataFrame:
    """Add the typed value sets of both answer lists as ``_target`` and ``_predicted``.

    The rows are spread first. Both normalisations run in one Python pass; the typed values are kept as
    columns, so every score reads them without computing them again.
    """
    normal = spread(df).withColumns({"_tn": S.normalize_list(F.col(target)), "_pn": S.normalize_list(F.col(predicted))})
    typed = normal.withColumns({
        "_target": S.typed_values(F.col(target), F.col("_tn")),
        "_predicted": S.typed_values(F.col(predicted), F.col("_pn")),
    })
    return typed.withColumns({
        "_target": S.as_set(F.col("_target")), "_predicted": S.as_set(F.col("_predicted"))
    }).drop("_tn", "_pn")


def scored(
    df: DataFrame, target: str = "target", predicted: str = "prediction", units: Sequence[str] = S.UNITS
) -> DataFrame:
    """Add ``strict``, ``flexible``, ``multiset`` and ``fuzzy`` for two answer list columns."""
    left = F.lower(F.array_join(target, ", "))
    right = F.lower(F.array_join(predicted, ", "))
    sets = with_typed_sets(df, target, predicted)
    return sets.withColumns({
        "strict": S.strict(F.col("_target"), F.col("_predicted")),
        "flexible": S.flexible(F.col(target), F.col(predicted), F.col("_target"), F.col("_predicted"), units),
        "multiset": S.multiset(left, right),
        "fuzzy": S.fuzzy(left, right),
    }).drop("_target", "_predicted")


def by_checkpoint(df: DataFrame, key: str = "checkpoint") -> DataFrame:
    """Mean of every metric per checkpoint; a missing score counts as 0."""

    def mean(name: str) -> Column:
        kind = dict(df.dtypes)[name]
        value = F.col(name).cast("int") if kind == "boolean" else F.col(name)
        return F.avg(F.coalesce(value.cast("double"), F.lit(0.0))).alias(name)

    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[mean(m) for m in METRICS if m in df.columns])


def best_checkpoint(results: DataFrame, key: str = "checkpoint", metric: str = "flexible") -> DataFrame:
    """One row: the checkpoint with the highest metric; of equal ones the first by step."""
    best = F.max_by(F.struct(*results.columns), F.struct(F.col(metric), -checkpoint_step(F.col(key))))
    return results.agg(best.alias("b")).select("b.*")


def checkpoint_step(name: Column) -> Column:
    return F.element_at(F.split(name, "-"), -1).try_cast("bigint")


def checkpoint_curve(results: DataFrame, key: str = "checkpoint") -> DataFrame:
    """Metrics by training step, without the test rows, in step order."""
    kept = results.filter(~F.col(key).startswith("test"))
    return kept.withColumn("step", checkpoint_step(F.col(key))).orderBy("step")


def accuracy_by_kind(df: DataFrame, kinds: str = "kinds", ok: str = "flexible") -> DataFrame:
    """Per operator kind: questions that use it, wrong ones among them, and percent right."""
    used = df.select(F.explode(F.array_distinct(kinds)).alias("kind"), F.coalesce(ok, F.lit(False)).alias("_ok"))
    return (
        used.filter(F.col("kind").isin(KINDS))
        .groupBy("kind")
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col("_ok")).alias("wrong"))
        .withColumn("accuracy", (1 - F.col("wrong") / F.col("total")) * 100)
    )


def to_redo(checkpoints: DataFrame, done: DataFrame, key: str = "checkpoint") -> DataFrame:
    """Checkpoints without a finished result; a fuzzy score of 0 is not finished."""
    finished = done.filter(F.col("fuzzy") != 0).select(key)
    return checkpoints.join(finished, key, "left_anti")
