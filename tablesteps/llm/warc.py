"""WARC archives of pages, written with an index of their records and read back by byte range.

Writing gives one index row per record: file, offset, length, URL and digest. Reading takes any
selection of index rows, sorts them by file and offset and fetches neighbours with one read. Each record
is a gzip member of its own, so a range of records can be read without the rest of its file.

Records with equal payloads are stored once: the one with the largest page_id is the response, the
others are revisits that name it.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .files import Target, new_folder, opened

FILE_BYTES = 1 << 28
RANGE_BYTES = 1 << 23  # of one read at most, unless a record is longer
RANGE_GAP = 1 << 16  # unwanted bytes between two records that one read may span
DATE = "2020-01-01T00:00:00Z"  # the pages carry no time; a fixed one keeps reruns equal

_INDEX = "file string, offset long, length long, page_id long, url string, digest string, record_type string"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def record_name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(name: str) -> int | None:
    number = name[len("<urn:page:") : -1]
    return None if number == "none" else int(number)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """The bytes of one record, not compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_name(page_id)),
        ("WARC-Date", DATE),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if revisit:
        fields += [("WARC-Profile", _REVISIT), ("WARC-Refers-To", record_name(refers_to))]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of one record, its payload (None for a revisit) and the payload's full length."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and len(payload) != length:
        raise ValueError("a payload is cut short")
    return fields | {"payload": None if revisit else payload, "length": length}


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # Named by the attempt, so that an attempt that runs beside this one can not replace what its index describes.
        part, attempt, number, out = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), 0, None
        for batch in batches:
            rows = []
            for page_id, url, html, digest, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name = f"pages-{part:06d}-{attempt}-{number:05d}.warc.gz"
                    out = Target(folder, name)
                digest = base64.b32encode(bytes.fromhex(digest)).decode()
                member = zlib.compressobj(1, zlib.DEFLATED, 31)
                raw = record(page_id, url, (html or "").encode(), digest, refers_to, revisit)
                raw = member.compress(raw) + member.flush()
                rows.append((name, out.length, len(raw), page_id, url, digest, "revisit" if revisit else "response"))
                out.write(raw)
                if out.length >= FILE_BYTES:
                    out.finish()
                    number, out = number + 1, None
            if rows:
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                names = [f.split()[0] for f in _INDEX.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)
        if out is not None:
            out.finish()

    return run


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write one record per row of (page_id, url, html) and return the index, kept in the checkpoint folder.

    A null html is an empty payload. Of rows with equal payloads of at least ``least_bytes`` bytes
    those with the largest page_id are responses (a row that repeats that id is one as well), the others
    revisits; a null page_id is smaller than any. Shorter payloads are all responses. A null URL is left
    out of the record. Other columns are not read. An empty table writes no file and gives an empty index.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.sha1(payload).alias("_digest"), F.octet_length(payload).alias("_bytes"))
    keepers = durable(
        rows.where(F.col("_bytes") >= least_bytes).groupBy("_digest")
        .agg(F.max("page_id").alias("_keeper"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    )
    known = rows.join(keepers.drop("_n").withColumnRenamed("_digest", "_d"), F.col("_digest") == F.col("_d"), "left")
    revisit = F.col("_d").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_keeper"))
    named = known.select(
        "page_id", "url", "html", "_digest", F.when(revisit, F.col("_keeper")).alias("refers_to"), revisit.alias("revisit")
    )
    return durable(named.mapInArrow(_write(folder), _INDEX))


def ranges(rows: list[tuple[str, int, int]], most: int = RANGE_BYTES, gap: int = RANGE_GAP) -> Iterator[tuple[str, int, int, list[int]]]:
    """(file, start, end, rows) of reads that cover rows (file, offset, length) sorted by file and offset."""
    file, start, end, held = None, 0, 0, []
    for i, (name, offset, length) in enumerate(rows):
        if held and (name != file or offset - end > gap or offset + length - start > most):
            yield file, start, end, held
            held = []
        if not held:
            file, start, end = name, offset, offset
        end = max(end, offset + length)
        held.append(i)
    if held:
        yield file, start, end, held


def _read(folder: str, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        files, path = opened(folder)
        name, source = None, None
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            for file, start, end, held in ranges(rows):
                if file != name:
                    name, source = file, files.open_input_file(f"{path}/{file}")
                data = source.read_at(end - start, start)
                found = []
                for i in held:
                    _, offset, length = rows[i]
                    got = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                    digest = got["WARC-Payload-Digest"].removeprefix("sha1:")
                    payload, refers_to = got["payload"], got.get("WARC-Refers-To")
                    if payload is not None and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError("a payload does not match its digest")
                    found.append((
                        page_of(got["WARC-Record-ID"]), got.get("WARC-Target-URI"), got["WARC-Type"], got["length"], digest,
                        None if refers_to is None else page_of(refers_to), payload if with_payload else None,
                    ))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
                names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found), kinds)], names)

    return run


def read_records(selected: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of some index rows: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload.

    Length and digest are those of the full payload, also for a revisit, whose payload is null. An index
    row given twice is read twice.
    """
    rows = selected.select("file", "offset", "length").repartitionByRange("file", "offset")
    return rows.sortWithinPartitions("file", "offset").mapInArrow(
        _read(folder, with_payload),
        "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary",
    )


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages and read every record back."""
    folder = folder or new_folder(pages.sparkSession, "warc")
    return read_records(write_archives(pages, folder), folder, with_payload=False)
