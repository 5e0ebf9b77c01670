"""Token ids of whole texts by the tokenizers library, and a keyed store of them.

Store. ``write_store`` writes shards of raw little-endian ids in ascending key order and, next to
each, a minimal perfect hash index. ``lookup`` finds a key's ids in constant time: the hash gives
the slot, the stored fingerprint tells a foreign key, and the slot holds offset and length.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encoder import encoder
from .files import Target, new_folder, opened
from .textbytes import U64, mix

SHARD_IDS = 1 << 26
KEY_LEVEL_SLOTS = 2  # slots per key of a hash level


# ---- texts -----------------------------------------------------------------------


def text_groups(texts: list[str | None], most: int = 1 << 21) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) in groups of about ``most`` characters, null as empty; no text is cut."""
    start, group, size = 0, [], 0
    for i, text in enumerate(texts):
        group.append(text or "")
        size += len(group[-1])
        if size >= most:
            yield start, group
            start, group, size = i + 1, [], 0
    if group:
        yield start, group


# ---- minimal perfect hash -------------------------------------------------------


def _level(low: np.ndarray, high: np.ndarray, level: int, slots: int) -> np.ndarray:
    return ((mix(low + U64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64))) ^ high) % U64(slots)).astype(np.int64)


def key_words(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hash words and a fingerprint of each key, all from one 128-bit digest."""
    import xxhash

    digests = b"".join(xxhash.xxh3_128_digest(k) for k in keys)
    words = np.frombuffer(digests, "<u8").reshape(-1, 2)
    low, high = mix(words[:, 0]), mix(words[:, 1])
    return low, high, mix(low ^ (high << U64(1)))


class PerfectHash:
    """Maps n distinct keys to 0..n-1 by levels of bits; a key stays at the first level where it is alone."""

    def __init__(self, levels: list[np.ndarray]):
        self._levels = levels
        sizes = np.cumsum([0, *(len(x) for x in levels)])
        self._starts = sizes[:-1]
        bits = np.concatenate(levels) if levels else np.zeros(0, bool)
        self._rank = np.r_[0, np.cumsum(bits)]

    @classmethod
    def build(cls, low: np.ndarray, high: np.ndarray) -> PerfectHash:
        levels = []
        while len(low):
            if len(levels) > 200:
                raise ValueError("two keys are equal")
            slots = max(64, KEY_LEVEL_SLOTS * len(low))
            at = _level(low, high, len(levels), slots)
            alone = np.bincount(at, minlength=slots) == 1
            levels.append(alone)
            low, high = low[~alone[at]], high[~alone[at]]
        return cls(levels)

    def slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for some of the foreign keys, the fingerprint tells the others."""
        out = np.full(len(low), -1, np.int64)
        open_rows = np.arange(len(low))
        for level, bits in enumerate(self._levels):
            at = _level(low[open_rows], high[open_rows], level, len(bits))
            hit = bits[at]
            out[open_rows[hit]] = self._rank[self._starts[level] + at[hit]]
            open_rows = open_rows[~hit]
        return out

    def to_bytes(self) -> bytes:
        parts = [struct.pack("<I", len(self._levels))]
        for bits in self._levels:
            parts += [struct.pack("<Q", len(bits)), np.packbits(bits).tobytes()]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple[PerfectHash, int]:
        (n,), at, levels = struct.unpack_from("<I", data), 4, []
        for _ in range(n):
            (size,) = struct.unpack_from("<Q", data, at)
            packed = np.frombuffer(data, np.uint8, -(-size // 8), at + 8)
            levels.append(np.unpackbits(packed, count=size).astype(bool))
            at += 8 + len(packed)
        return cls(levels), at


_SLOT = np.dtype([("fingerprint", "<u8"), ("offset", "<u8"), ("length", "<u8")])
_MAGIC = b"TSIX0001"


def index_bytes(keys: list[bytes], offsets: np.ndarray, lengths: np.ndarray) -> bytes:
    """Index file: magic, number of slots, slots (fingerprint, offset, length), hash levels."""
    low, high, fingerprint = key_words(keys)
    hashed = PerfectHash.build(low, high)
    slots = np.zeros(len(keys), _SLOT)
    at = hashed.slots(low, high)
    slots["fingerprint"][at], slots["offset"][at], slots["length"][at] = fingerprint, offsets, lengths
    return _MAGIC + struct.pack("<Q", len(keys)) + slots.tobytes() + hashed.to_bytes()


class Index:
    """An index file in memory."""

    def __init__(self, data: bytes):
        if data[:8] != _MAGIC:
            raise ValueError("not an index file")
        (n,) = struct.unpack_from("<Q", data, 8)
        self._slots = np.frombuffer(data, _SLOT, n, 16)
        self._hash, _ = PerfectHash.from_bytes(data[16 + n * _SLOT.itemsize :])

    def find(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, offset, length) of each key, in ids."""
        low, high, fingerprint = key_words(keys)
        at = self._hash.slots(low, high)
        rows = self._slots[np.maximum(at, 0)] if len(self._slots) else np.zeros(len(at), _SLOT)
        found = (at >= 0) & (rows["fingerprint"] == fingerprint)
        return found, rows["offset"].astype(np.int64), rows["length"].astype(np.int64)


# ---- shards ---------------------------------------------------------------------


def _key(doc_id: int | None, nth: int) -> bytes:
    """The key of the nth row (from 0) with this id."""
    return struct.pack("<Bqq", 0 if doc_id is None else 1, doc_id or 0, nth)


class _Occurrences:
    """Counts rows of equal ids in sorted order."""

    def __init__(self):
        self._last, self._nth = (), -1

    def key(self, doc_id: int | None) -> bytes:
        self._nth = self._nth + 1 if self._last == (doc_id,) else 0
        self._last = (doc_id,)
        return _key(doc_id, self._nth)


_SHARDS = (
    "part int, shard int, name string, first_id long, last_id long, has_null boolean, all_null boolean, docs long, ids long, width int"
)


def _write(folder: str, tokenizer: str, end_id: int, width: int):
    dtype = {2: "<u2", 4: "<u4"}[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        encode, seen = encoder(tokenizer).encode, _Occurrences()
        end = np.array([end_id], "<u4").tobytes()
        shard, out = 0, None
        done = []

        def close():
            nonlocal shard, out
            out.finish()
            index = Target(folder, f"{name()}.idx")
            index.write(index_bytes(keys, np.array(offsets, np.uint64), np.array(lengths, np.uint64)))
            index.finish()
            known = [i for i in ids if i is not None]
            done.append((
                part, shard, name(), min(known, default=None), max(known, default=None),
                len(known) < len(ids), not known, len(ids), offsets[-1] + lengths[-1], width,
            ))
            shard, out = shard + 1, None

        def name():
            return f"{part:06d}-{attempt}-{shard:05d}"

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for start, group in text_groups(batch.column("text").to_pylist()):
                for doc_id, encoded in zip(doc_ids[start : start + len(group)], encode(group)):
                    if out is None:
                        out, keys, ids, offsets, lengths = Target(folder, f"{name()}.ids"), [], [], [], []
                    payload = np.frombuffer(encoded + end, "<u4")
                    keys.append(seen.key(doc_id))
                    ids.append(doc_id)
                    offsets.append(out.length // width)
                    lengths.append(len(payload))
                    out.write(payload.astype(dtype).tobytes())
                    if out.length >= SHARD_IDS * width:
                        close()
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_pylist(
                [dict(zip([f.split()[0] for f in _SHARDS.split(", ")], row)) for row in done],
                schema=pa.schema([
                    ("part", pa.int32()), ("shard", pa.int32()), ("name", pa.string()), ("first_id", pa.int64()),
                    ("last_id", pa.int64()), ("has_null", pa.bool_()), ("all_null", pa.bool_()), ("docs", pa.int64()),
                    ("ids", pa.int64()), ("width", pa.int32()),
                ]),
            )

    return run


def write_store(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> list[dict]:
    """Write shards of ids in ascending doc_id order, null ids first; returns the shard list.

    A null text is empty, so its document is the end id alone. Rows that repeat an id are kept as
    its first, second, ... row in text order (null texts first). Columns other than doc_id and text are not read.
    An empty table writes no shard. The list has one entry per shard of up to ``SHARD_IDS`` ids (0.1 to 0.3 GB)
    or per task; it is also written to ``shards.json``.
    """
    from tokenizers import Tokenizer

    size = Tokenizer.from_file(tokenizer).get_vocab_size()
    width = 2 if max(size - 1, end_id) < 1 << 16 else 4
    rows = (
        docs.select("doc_id", "text")
        .repartitionByRange(F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
        .mapInArrow(_write(folder, tokenizer, end_id, width), _SHARDS)
    )
    shards, start = [], 0
    for row in sorted(rows.collect(), key=lambda r: (r["part"], r["shard"])):
        shards.append(row.asDict() | {"start": start})
        start += row["ids"]
    files, path = opened(folder)
    files.create_dir(path, recursive=True)
    with files.open_output_stream(f"{path}/shards.json") as out:
        out.write(json.dumps(shards).encode())
    return shards


class Store:
    """Reads documents of a store by key. Opens a shard when a key first falls in its range."""

    def __init__(self, folder: str, shards: list[dict]):
        self._files, self._path = opened(folder)
        self._shards = shards
        self._open: dict[int, tuple] = {}

    def _shard(self, i: int):
        if i not in self._open:
            self._open = {k: v for k, v in self._open.items() if k == i - 1}  # keys come in order
            path = f"{self._path}/{self._shards[i]['name']}"
            with self._files.open_input_file(f"{path}.idx") as file:
                index = Index(file.read())
            self._open[i] = (index, self._files.open_input_file(f"{path}.ids"))
        return self._open[i]

    def _holds(self, i: int, doc_id: int | None) -> bool:
        shard = self._shards[i]
        if doc_id is None:
            return shard["has_null"]
        return not shard["all_null"] and shard["first_id"] <= doc_id <= shard["last_id"]

    def get(self, doc_ids: list[int | None], keys: list[bytes]) -> Iterator[tuple[int, np.ndarray] | None]:
        """(start, ids) of each key, None for a key that is not in the store."""
        found: list[tuple[int, int, int] | None] = [None] * len(keys)
        last = np.array([s["last_id"] if s["last_id"] is not None else -(1 << 63) for s in self._shards], np.int64)
        wanted: dict[int, list[int]] = {}
        for row, doc_id in enumerate(doc_ids):
            i = 0 if doc_id is None else int(np.searchsorted(last, doc_id))
            while i < len(self._shards) and self._holds(i, doc_id):  # rows of one id may run over shards
                wanted.setdefault(i, []).append(row)
                i += 1
        for i, rows in sorted(wanted.items()):
            index, _ = self._shard(i)
            hit, offset, length = index.find([keys[r] for r in rows])
            for r, h, o, n in zip(rows, hit.tolist(), offset.tolist(), length.tolist()):
                if h:
                    found[r] = (i, o, n)
        for place in found:
            if place is None:
                yield None
                continue
            i, offset, length = place
            width = self._shards[i]["width"]
            raw = self._shard(i)[1].read_at(length * width, offset * width)
            yield self._shards[i]["start"] + offset, np.frombuffer(raw, "<u2" if width == 2 else "<u4")


def _look_up(folder: str, shards: list[dict]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, seen = Store(folder, shards), _Occurrences()
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for at in range(0, len(doc_ids), 1000):
                part = doc_ids[at : at + 1000]
                rows = [x for x in zip(part, store.get(part, [seen.key(d) for d in part])) if x[1] is not None]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([d for d, _ in rows], pa.int64()),
                        pa.array([s for _, (s, _) in rows], pa.int64()),
                        pa.array([x.astype("<u4").tobytes() for _, (_, x) in rows], pa.binary()),
                    ],
                    ["doc_id", "start", "ids"],
                )

    return run


def lookup(keys: DataFrame, folder: str, shards: list[dict]) -> DataFrame:
    """Documents of a store by key: (doc_id, start, ids), ids as little-endian unsigned 32-bit bytes.

    ``keys`` has a column doc_id; its nth row with an id gets the nth document stored under that id.
    Keys that are not in the store give no row. Every key is found through the index of its shard.
    """
    rows = (
        keys.select("doc_id")
        .repartitionByRange(max(1, len(shards)), F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    )
    return rows.mapInArrow(_look_up(folder, shards), "doc_id long, start long, ids binary")


def encode_store(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Write ``docs`` to a store and read every document back from its files by key."""
    spark: SparkSession = docs.sparkSession
    folder = folder or new_folder(spark, "token-ids")
    return lookup(docs, folder, write_store(docs, folder, tokenizer, end_id))
