"""Query registry, table access and the relation ``w`` that the table steps run on."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Parquet tables of one folder; a table is opened once per query."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        setattr(self, name, table)
        return table

    def columns(self, name: str, *columns: str) -> DataFrame:
        """Some columns of a table."""
        return getattr(self, name).select(*columns)

    @cached_property
    def w(self) -> DataFrame:
        """Orders as a question table: id, total-row mark, text, number, date and mixed columns."""
        return self.orders.select(
            F.col("o_orderkey").alias("id"),
            F.when(F.col("o_orderstatus") == "P", 1).otherwise(0).alias("agg"),
            F.nullif("o_orderpriority", F.lit("5-LOW")).alias("c1"),
            F.col("o_totalprice").alias("c2"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("c3"),
            F.col("o_custkey").alias("c4"),
            F.col("o_orderstatus").alias("c5"),
            F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))
            .otherwise(F.col("o_custkey").cast("string")).alias("c6"),
        )


W_SQL = """w AS (
  SELECT o_orderkey AS id,
         CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS agg,
         nullif(o_orderpriority, '5-LOW') AS c1,
         o_totalprice AS c2,
         strftime(o_orderdate, '%Y-%m-%d') AS c3,
         o_custkey AS c4,
         o_orderstatus AS c5,
         CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE CAST(o_custkey AS VARCHAR) END AS c6
  FROM orders)"""


def query(name: str, sql: str | None = None):
    """Register a function of ``Tables`` under a name, with its SQL equivalent."""

    def keep(build):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql.strip()
        return build

    return keep


def on_w(body: str) -> str:
    """SQL over the relation ``w``; further CTEs may precede the final SELECT."""
    body = body.strip()
    return f"WITH {W_SQL}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {W_SQL}\n{body}"


# Number in a text under the same guard as the library uses.
def num_sql(text: str) -> str:
    guard = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
    return f"CASE WHEN regexp_full_match(trim({text}), '{guard}') THEN try_cast(trim({text}) AS DOUBLE) END"
