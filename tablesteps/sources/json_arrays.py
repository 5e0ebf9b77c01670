"""JSON arrays read by many tasks however few files they are, and written without one task that sees them whole.

Spark's text source cuts a file at every ``}``, and it does so from any byte range. Whether such a brace ends a record depends on
what comes before it: the quotes before it say if it lies in a text, the braces before it how deep it lies. Both are running sums.
They are taken within a byte range first, for a range that starts outside a text and for one that starts inside; one short row per
range then tells which of the two holds. No task reads more than its range, apart from the records that it puts together.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_RANGE = ["_file", "_start"]


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The text up to each ``}``, with its quotes and the braces it opens, by whether it starts outside or inside a text."""
    # An escaped sign is neither quote nor brace. A piece never starts after a backslash, as no text escapes a closing brace.
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    stretches = F.split(bare, '"', -1)

    def opened(first: int) -> Column:
        kept = F.filter(stretches, lambda s, i: i % 2 == first)
        return F.aggregate(kept, F.lit(0), lambda n, s: n + F.length(s) - F.length(F.replace(s, F.lit("{"))))

    return spark.read.text(path, lineSep="}").select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        (F.size(stretches) - 1).alias("_quotes"), opened(0).alias("_out"), opened(1).alias("_in"),
    )


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Neighbouring pieces of one range, in order: the range, the pieces, and for each piece's end whether it lies in a text (0, 1)
    and its two depths, all counted from the start of the range, the depths for a start outside and inside a text."""
    at, odd, deep = None, 0, [0, 0]
    for batch in batches:
        if not batch.num_rows:
            continue
        file, start = batch["_file"], batch["_start"]
        new = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(start[1:], start[:-1]))
        cuts = [0, *(np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows]
        for low, high in pairwise(cuts):
            part = batch.slice(low, high - low)
            here = (part["_file"][0].as_py(), part["_start"][0].as_py())
            if here != at:
                at, odd, deep = here, 0, [0, 0]
            quotes, out, within = (part[c].to_numpy().astype("int64") for c in ("_quotes", "_out", "_in"))
            sums = odd + np.cumsum(quotes)
            odds, before = sums % 2, (sums - quotes) % 2
            depths = np.stack([
                deep[i] + np.cumsum(np.where(before == i, out, within) - (odds == i)) for i in (0, 1)
            ])
            odd, deep = int(odds[-1]), depths[:, -1].tolist()
            yield at, part, odds, depths


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state at the end of every range."""
    def row(at: tuple[str, int], state: list[int]) -> pa.RecordBatch:
        types = [pa.string(), *[pa.int64()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*at, *state), types)], [*_RANGE, "_odd", "_depth0", "_depth1"])

    last, state = None, []
    for at, _, odds, depths in _stretches(batches):
        if last is not None and at != last:
            yield row(last, state)
        last, state = at, [int(odds[-1]), int(depths[0, -1]), int(depths[1, -1])]
    if last is not None:
        yield row(last, state)


def _range_starts(pieces: DataFrame) -> DataFrame:
    """One row per byte range: whether it starts in a text, and how deep."""
    ranges = pieces.drop("value").mapInArrow(_summed, "_file string, _start long, _odd long, _depth0 long, _depth1 long")
    before = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("_odd").over(before), F.lit(0)) % 2
    ranges = ranges.withColumn("_inside", inside)
    change = F.when(F.col("_inside") == 1, F.col("_depth1")).otherwise(F.col("_depth0"))
    return ranges.select(*_RANGE, "_inside", F.coalesce(F.sum(change).over(before), F.lit(0)).alias("_depth"))


def _assembled(whole: bool):
    """Either the records that begin and end in a range, or what a range holds of others: the text up to the first end
    (``_ends`` is 1) and the text after the last one (0). A range without an end is one such text."""
    names = ["value"] if whole else [*_RANGE, "_part", "_ends", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rest, first = None, [], True

        def edge(part: int, ends: int) -> pa.RecordBatch:
            arrays = [[at[0]], [at[1]], [part], [ends], ["}".join(rest)]]
            types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(arrays, types)], names)

        for here, part, odds, depths in _stretches(batches):
            if here != at:
                if rest and not whole:
                    yield edge(1, 0)
                at, rest, first = here, [], True
            inside, depth = part["_inside"][0].as_py(), part["_depth"][0].as_py()
            ends = np.flatnonzero(((odds + inside) % 2 == 0) & (depth + depths[inside] == 0)).tolist()
            values = part["value"]
            done, low = [], 0
            if not whole and ends and not first:  # only what follows the last end can be of another record
                rest, low = [], ends[-1] + 1
                ends = []
            for end in ends:
                if first:
                    rest += values[low:end + 1].to_pylist()
                    if not whole:
                        yield edge(0, 1)
                    rest, first, low = [], False, end + 1
                    if not whole:
                        low = ends[-1] + 1
                        break
                else:
                    done.append("}".join([*rest, *values[low:end + 1].to_pylist()]) if rest or end > low else values[low].as_py())
                    rest, low = [], end + 1
            rest += values[low:].to_pylist()
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names)
        if rest and not whole:
            yield edge(1, 0)

    return run


def record_texts(spark: SparkSession, path: str) -> DataFrame:
    """The text of every object of the JSON arrays at ``path`` (UTF-8): (value).

    Objects may hold others, and braces in their texts. Elements that are no objects are passed over; a file that is one object, or
    objects one after the other, is read as well. A file without an object, or an empty one, gives no row. A range is walked in the
    task that reads it, a batch and a record at a time; only the two ends of a range are shuffled.
    """
    pieces = _pieces(spark, path)
    known = pieces.join(F.broadcast(_range_starts(pieces)), _RANGE)
    inner = known.mapInArrow(_assembled(True), "value string")
    edges = known.mapInArrow(_assembled(False), "_file string, _start long, _part int, _ends int, value string")
    # What follows the last end of a range belongs to the first record that ends in a later range.
    before = Window.partitionBy("_file").orderBy("_start", "_part").rowsBetween(Window.unboundedPreceding, -1)
    numbered = edges.withColumn("_record", F.coalesce(F.sum("_ends").over(before), F.lit(0)))
    parts = numbered.groupBy("_file", "_record").agg(F.array_sort(F.collect_list(F.struct("_start", "_part", "value"))).alias("p"))
    joined = inner.unionByName(parts.select(F.array_join(F.col("p.value"), "}").alias("value")))
    whole = F.concat("value", F.lit("}"))
    return joined.select(F.regexp_extract(whole, r"(?s)\{.*", 0).alias("value")).filter(F.col("value") != "")


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of JSON arrays as rows; what a value does not fit is null, as in Spark's own reader."""
    return record_texts(spark, path).select(F.from_json("value", schema).alias("r")).select("r.*")


def _array_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    lead = "["
    for batch in batches:
        if len(batch):
            lines = "," + batch["value"]
            lines.iloc[0] = lead + batch["value"].iloc[0]
            yield lines.to_frame("value")
            lead = ","
    yield pd.DataFrame({"value": ["]" if lead == "," else "[]"]})


def save_json_array(df: DataFrame, path: str) -> None:
    """Rows as part files that are one JSON array each."""
    objects = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))
    objects.mapInPandas(_array_lines, "value string").write.mode("overwrite").text(path)
