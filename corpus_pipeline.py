"""Corpus pipeline: language filter, near-copy removal, secret masking, mixing, packing.

``run`` applies STAGES to the documents of a folder. Each stage works on all rows its predecessor kept,
which are written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablesteps.llm.files import new_folder
from tablesteps.llm.jaccard import link_components
from tablesteps.llm.langid import predict, train
from tablesteps.llm.mixing import curriculum
from tablesteps.llm.names import free_prefix
from tablesteps.llm.packing import packed_sequences
from tablesteps.llm.secrets import redacted, scan

LEAST_LANGUAGE_SCORE = 0.3

#: No SQL: the stages train classifiers and run a tokenizer; tests/llm checks them by brute force.
ORACLE_SQL: str | None = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a known language; ``lang`` becomes the predicted one.

    Rejected are texts without a letter (null and empty ones too) and those whose score is below
    LEAST_LANGUAGE_SCORE. The model learns from the rows that carry a language; without any, nothing is known
    and all go.
    """
    model = train(docs)
    x = free_prefix(docs.columns)
    named = docs.select(*[F.col(f"`{c}`").alias(c if c == "text" else x + c) for c in docs.columns])
    known = predict(named, model).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    values = {x + "lang": F.col("lang_pred")}
    return known.select(*[values.get(c, F.col(c)).alias(c) for c in named.columns]).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more.

    The one with the smallest doc_id stays; of rows that repeat that id and belong to the group, one stays. Texts without
    words are in no group and all stay.
    """
    x = free_prefix(docs.columns)
    row, first_id, place = x + "row", x + "id", x + "n"
    rows = docs.withColumn(row, F.xxhash64(*docs.columns))
    linked = link_components(rows, words=5, percent=80, carry=(row,))
    # Per group the smallest id, and of the rows with that id the smallest hash; the hash covers the id.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(row).alias("row")))
    kept = (
        linked.where("set_key is not null").groupBy("component_key").agg(first.alias("k"))
        .select(F.col("k.id").alias(first_id), F.col("k.row").alias(row))
    )
    # Wholly equal rows share id and hash; one of them stays.
    nth = F.row_number().over(Window.partitionBy(row).orderBy(F.lit(0)))
    stays = rows.join(kept, row).where(F.col("doc_id").eqNullSafe(F.col(first_id))).withColumn(place, nth).where(F.col(place) == 1)
    wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return stays.select(*docs.columns).union(docs.where(wordless))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets in their texts are replaced by [SECRET] and n_chars follows."""
    x = free_prefix(docs.columns)
    named = docs.select(*[F.col(f"`{c}`").alias(c if c in ("doc_id", "text") else x + c) for c in docs.columns])
    found = scan(named)
    masked = F.when(F.size("secrets") > 0, redacted(F.col("text"), F.col("secrets")))
    found = found.withColumn(x + "_masked", masked)
    masked, length = F.col(x + "_masked"), x + "n_chars"
    values = {"text": F.coalesce(masked, F.col("text"))}
    if length in named.columns:
        values[length] = F.coalesce(F.length(masked).cast(named.schema[length].dataType), F.col(length))
    return found.select(*[values.get(c, F.col(c)).alias(c) for c in named.columns]).toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, in training order, once per copy taken."""
    return curriculum(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 1024 ids, with their ids."""
    return packed_sequences(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_copies),
    ("secret_scan", mask_secrets),
    ("curriculum_mix", mix_sources),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; returns the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for place, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{place}-{name}")
            docs = spark.read.parquet(f"{folder}/{place}-{name}")
    return docs
