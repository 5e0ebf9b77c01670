"""Readers: tagged answer lists, query corpora, data sets by file type, split data sets."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.positions import positions
from .json_arrays import read_json_array

CORPUS_SCHEMA = "nt string, tbl string, sql array<array<string>>"
DATASET_SCHEMA = (
    "id string, question string, "
    "table struct<header: array<string>, rows: array<array<string>>>, answers array<string>"
)


def unescape_list(text: Column) -> Column:
    r"""List written with bars between items; ``\n``, ``\p`` and ``\\`` stand for newline, bar and backslash."""

    def unescape(item: Column) -> Column:
        for escaped, plain in [(r"\n", "\n"), (r"\p", "|"), ("\\\\", "\\")]:
            item = F.replace(item, F.lit(escaped), F.lit(plain))
        return item

    return F.transform(F.split(text, r"\|"), unescape)


def with_targets(df: DataFrame) -> DataFrame:
    """Both answer columns as lists, every other column as it is."""
    return df.withColumns({c: unescape_list(F.col(c)) for c in ("targetValue", "targetCanon")})


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """Tab separated answers with a header line; quotes have no meaning in them."""
    rows = spark.read.csv(path, sep="\t", header=True, quote="")
    return with_targets(rows.select("id", "targetValue", "targetCanon"))


def sql_text(tokens: Column) -> Column:
    """Query text from a list of tokens whose text is at position 1."""
    return F.array_join(F.transform(tokens, lambda token: F.get(token, F.lit(1))), " ")


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Query corpus: JSON arrays of questions with table id and query tokens, each file read by as many tasks as its size asks for."""
    rows = read_json_array(spark, path, CORPUS_SCHEMA)
    return rows.withColumn("sql", sql_text(F.col("sql")))


def load_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV or JSON by file extension, under an explicit schema."""
    extension = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read.schema(schema)
    if extension == "csv":
        return reader.csv(path, header=True)
    if extension == "json":
        return reader.json(path)
    raise ValueError(f"no reader for .{extension} files, use .csv or .json")


def load_dataset(spark: SparkSession, path: str, *splits: str) -> DataFrame:
    """Saved data set; with names given only those split folders are read."""
    data = spark.read.parquet(path)
    return data.filter(F.col("split").isin(list(splits))) if splits else data


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a folder of numbered part files with their place over all of them: (pos, value).

    A file may be read in several pieces; a line's place follows from file name, where its piece starts, and the order in the piece.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_in_piece"),
    )
    return positions(lines, [F.col("_file"), F.col("_start"), F.col("_in_piece")]).select("pos", "value")


_W_LOCK = threading.Lock()


def run_sql(df: DataFrame, sql: str) -> DataFrame:
    """Run a query text over ``df`` under the name ``w``.

    The name is bound while the text is analysed, one caller at a time; a view ``w`` of the session is as before afterwards.
    """
    spark = df.sparkSession
    with _W_LOCK:
        before = spark.table("w") if spark.catalog.tableExists("w") else None
        df.createOrReplaceTempView("w")
        try:
            return spark.sql(sql)
        finally:
            spark.catalog.dropTempView("w")
            if before is not None and not spark.catalog.tableExists("w"):
                before.createOrReplaceTempView("w")


def flat_cells(df: DataFrame, *row_key: str) -> DataFrame:
    """Every cell as text with its column place: (row key, place, cell)."""
    cells = F.array(*[F.col(c).cast("string") for c in df.columns])
    return df.select(*row_key, F.posexplode(cells).alias("place", "cell"))
