"""Sets of 64-bit keys as bits of a table of fixed size, for tasks that pass over rows that cannot match.

Keys share bits, so a marked key may not be in the set and has to be joined with it; an unmarked key is not.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 22
SHIFT = 17  # which bits of a key tell its place
MARKS = (36, 42, 48, 54)  # where the numbers of a key's bits within its word of a set begin


def places(keys: np.ndarray) -> np.ndarray:
    """Place of each unsigned key in the table."""
    return (keys >> np.uint64(SHIFT)) & np.uint64((1 << BITS) - 1)


def places_of(df: DataFrame, name: str) -> np.ndarray:
    """The distinct places of a column of keys: whatever the rows, no more than the table has."""
    place = F.shiftrightunsigned(name, SHIFT).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
    return df.where(F.col(name).isNotNull()).select(place.alias("place")).distinct().toArrow().column("place").to_numpy()


def _word_bits() -> int:
    """Bits of a word's number: the words of a set take as many bytes as there are places."""
    return max(0, BITS - 3)


def packed_bits(df: DataFrame, name: str) -> bytes:
    """The set of a column's keys, packed to be sent to tasks: four megabytes at most.

    Each key sets ``len(MARKS)`` bits of one 64-bit word; with one bit a key, false hits would grow with the keys times the rows
    passed over. Spark puts the words together, so the driver gets no more rows than the table has words, whatever the keys.
    """
    word = F.shiftrightunsigned(name, SHIFT).bitwiseAND(F.lit((1 << _word_bits()) - 1)).cast("int")
    marks = [f"shiftleft(1L, cast(shiftrightunsigned(`{name}`, {shift}) & 63 as int))" for shift in MARKS]
    rows = df.where(F.col(name).isNotNull()).groupBy(word.alias("word")).agg(F.bit_or(F.expr(" | ".join(marks))).alias("bits")).toArrow()
    table = np.zeros(1 << _word_bits(), np.int64)
    table[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return zlib.compress(table.tobytes(), 1)


def unpacked_bits(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint64)


def marked(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the unsigned keys may be in an unpacked set."""
    words = table[(keys >> np.uint64(SHIFT)) & np.uint64(len(table) - 1)]
    found = words != 0
    at = np.flatnonzero(found)
    bits = np.zeros(len(at), np.uint64)
    for shift in MARKS:
        bits |= np.uint64(1) << ((keys[at] >> np.uint64(shift)) & np.uint64(63))
    found[at] = words[at] & bits == bits
    return found
