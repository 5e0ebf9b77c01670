"""Ranked lexical search by the Best Position Algorithm.

Documents become postings of the terms that some item asks for, written once with the counts over
all documents that weights need. A task takes its documents a block at a time and lays out an impact list
per term: the documents that hold it by falling contribution to a score. For an item, the lists of its terms are
read in step. Every document met is scored at once by direct access to all lists, which also tells its place in
each. The places seen so far are tracked per list; the first place not yet seen bounds what an unseen document can still
gain there, however far the list was read. The search of a block ends when the sum of these bounds is strictly
below the k-th best score, which goes on from block to block; a sum equal to it might still hide a tie.

Items are dealt into blocks by their number of terms. A block, which is bounded, goes to all tasks and is
answered in one job over all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.positions import running_total
from .files import new_folder
from .textbytes import U64, Texts, slices

BLOCK_TERMS = 1 << 14  # terms of a block of items, and one more item at most
CELLS = 1 << 22  # terms times documents of a block of documents
FIRST_DEPTH = 16  # places read of each list in the first round; each round reads twice as many
MERGE_PARTS = 256  # results of tasks are merged in so many parts first
SCALE = 1_000_000_000

_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _terms(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each term in order, bounds): text i has bounds[i]:bounds[i + 1]."""
    texts = texts.lowered()
    starts, ends, bounds = texts.runs(_TERM)
    return texts.hashes(starts, ends), bounds


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the distinct terms of each item."""
    for batch in batches:
        terms = []
        for _, _, texts in slices(batch.column("text")):
            hashed, bounds = _terms(texts)
            terms += [np.unique(hashed[a:b]).view(np.int64) for a, b in zip(bounds[:-1], bounds[1:])]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(terms, pa.list_(pa.int64()))], [*batch.schema.names[:-1], "terms"]
        )


def _postings(vocabulary: np.ndarray):
    """(doc_id, n, postings): the number of all terms of a document and pairs (term, tf) of those in the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, texts in slices(batch.column("text")):
                hashed, bounds = _terms(texts)
                term = np.minimum(np.searchsorted(vocabulary, hashed), len(vocabulary) - 1)
                hit = vocabulary[term] == hashed
                n = np.diff(bounds)
                doc = np.repeat(np.arange(len(n)), n)[hit]
                pairs, tf = np.unique(doc * len(vocabulary) + term[hit], return_counts=True)
                both = np.stack([pairs % len(vocabulary), tf], 1).astype(np.int32)
                ends = np.r_[0, np.cumsum(np.bincount(pairs // len(vocabulary), minlength=len(n)))].astype(np.int32) * 8
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(row, end - row), pa.array(n, pa.int64()),
                        pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(both)]),
                    ],
                    ["doc_id", "n", "postings"],
                )

    return run


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n of each document, terms, tf) with the documents' postings one after the other, and how many each has."""
    n = batch.column("n").to_numpy()
    column = batch.column("postings").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(np.int32).reshape(-1, 2) if data else np.zeros((0, 2), np.int32)
    return n, flat, np.diff(offsets) // 8


def _frequencies(terms: int):
    """(term, df) summed in the task; term -1 has the documents with a term, -2 all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, totals = np.zeros(terms, np.int64), np.zeros(2, np.int64)
        for batch in batches:
            if len(batch):
                n, flat, _ = _columns(batch)
                df += np.bincount(flat[:, 0], minlength=terms)
                totals += [np.count_nonzero(n), n.sum()]
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[-1, -2, held], pa.int64()), pa.array(np.r_[totals, df[held]], pa.int64())], ["term", "df"]
        )

    return run


class Best:
    """The ``k`` best (score, doc_id) so far, ties to the smaller doc_id, a null one last."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.ids, self.nulls = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def least(self) -> int:
        """The k-th best score; 0 while there are fewer."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 0

    def add(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        good = scores >= max(1, self.least)
        if good.any():
            scores, ids, nulls = (np.r_[a, b[good]] for a, b in ((self.scores, scores), (self.ids, ids), (self.nulls, nulls)))
            order = np.lexsort((ids, nulls, -scores))[: self.k]
            self.scores, self.ids, self.nulls = scores[order], ids[order], nulls[order]


class ImpactLists:
    """A block of documents as one list per term, by falling impact, with every document's place in each."""

    def __init__(self, terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_terms: int, n_docs: int):
        order = np.lexsort((docs, -impacts, terms))
        self.docs, self.impacts = docs[order], np.r_[impacts[order], 0]
        self.lengths = np.bincount(terms, minlength=n_terms)
        self.starts = np.r_[0, np.cumsum(self.lengths)[:-1]]
        # Flat place of each document in each list; one that is not there points behind all lists, to impact 0.
        self.places = np.full((n_terms, n_docs), len(order), np.int32)
        self.places[terms[order], self.docs] = np.arange(len(order))
        self.n_docs = n_docs

    def search(self, terms: np.ndarray, best: Best, ids: np.ndarray, nulls: np.ndarray) -> int:
        """Improve ``best`` by the documents of the block; returns how many of them were scored."""
        terms = terms[self.lengths[terms] > 0]
        position, ends = self.starts[terms].copy(), self.starts[terms] + self.lengths[terms]
        unseen = np.ones(len(self.docs) + 1, bool)
        met = np.zeros(self.n_docs, bool)
        depth, scored = FIRST_DEPTH, 0
        while True:
            bound = int(self.impacts[position[position < ends]].sum())
            if bound < best.least or bound == 0:
                return scored
            # Sorted access: the next places of every list after its best position.
            read = np.concatenate([self.docs[p : min(p + depth, e)] for p, e in zip(position, ends)])
            fresh = np.unique(read[~met[read]])
            met[fresh] = True
            scored += len(fresh)
            # Direct access: places and impacts of these documents in all lists.
            places = self.places[terms[:, None], fresh]
            best.add(self.impacts[places].sum(0), ids[fresh], nulls[fresh])
            unseen[places] = False
            unseen[-1] = True
            for i, (p, e) in enumerate(zip(position, ends)):
                if p < e:
                    ahead = unseen[p:e]
                    step = int(ahead.argmax())
                    position[i] = p + step if ahead[step] else e
            depth *= 2


def _search(items: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, k: int):
    """(item, doc_id, score): the k best documents of the task for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = max(1, CELLS // len(weights))
        best = [Best(k) for _ in items]
        for whole in batches:
            for start in range(0, len(whole), rows):
                batch = whole.slice(start, rows)
                n, flat, held = _columns(batch)
                doc = np.repeat(np.arange(len(n)), held)
                term, tf = flat[:, 0].astype(np.int64), flat[:, 1].astype(np.int64)
                useful = weights[term] > 0
                doc, term, tf = doc[useful], term[useful], tf[useful]
                m = 10 + 90 * n * n_docs // n_terms if n_terms else n
                impacts = weights[term] * (SCALE * tf // (1000 * tf + 8 * m[doc]))
                ids = batch.column("doc_id")
                nulls = ids.is_null().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy()
                lists = ImpactLists(term, doc, impacts, len(weights), len(n))
                for item, top in zip(items, best):
                    lists.search(item, top, ids, nulls)
        which = np.repeat(np.arange(len(items)), [len(b.scores) for b in best])
        ids, nulls, scores = (np.concatenate([getattr(b, x) for b in best]) for x in ("ids", "nulls", "scores"))
        yield pa.RecordBatch.from_arrays(
            [pa.array(which, pa.int32()), pa.array(ids, pa.int64(), mask=nulls), pa.array(scores, pa.int64())],
            ["item", "doc_id", "score"],
        )

    return run


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best documents of every item: (item_id, rank, doc_id, score).

    Terms are runs of ASCII letters and digits and of all code points from 0x80, A-Z lower-cased. With N the documents
    that have a term, L all terms, n those of a document, df the documents that hold a term and tf its
    occurrences in one, a term weighs floor(1000 ln((2N + 2) / (2 df + 1))), a document has
    m = 10 + 90 n N div L, and its score is the sum over an item's distinct terms of weight times
    (10^9 tf div (1000 tf + 8 m)). Only scores above 0 rank; equal ones by ascending doc_id, a null id last.

    A null or empty text has no terms: such an item has no rows and such a document is never found nor counted. A
    repeated item is answered once per row, repeated documents and ids rank each for themselves. Only ``doc_id`` and ``text``,
    ``item_id`` and ``text`` are read; an empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    home = new_folder(spark, "lexical")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = items.schema["item_id"].dataType.simpleString()
    asked = items.select("item_id", "text").mapInArrow(_item_terms, f"item_id {kind}, terms array<long>").where("size(terms) > 0")
    asked = asked.withColumn("_row", F.xxhash64("item_id", "terms"))
    dealt = running_total(asked, [F.col("_row")], [], F.size("terms").cast("long"), "_through")
    dealt.select("item_id", "terms", F.expr(f"cast((_through - size(terms)) div {BLOCK_TERMS} as int)").alias("block")).write.parquet(f"{home}/items")
    dealt = spark.read.parquet(f"{home}/items")
    blocks = dealt.agg(F.max("block")).first()[0]
    for block in range(0 if blocks is None else blocks + 1):
        rows = dealt.where(F.col("block") == block).select("item_id", "terms").toArrow()
        if not len(rows):  # an item with many terms may reach over whole blocks
            continue
        terms = [np.asarray(t, np.int64).view(U64) for t in rows.column("terms").to_pylist()]
        vocabulary = np.unique(np.concatenate(terms))
        chosen = [np.searchsorted(vocabulary, t) for t in terms]
        docs.mapInArrow(_postings(vocabulary), "doc_id long, n long, postings binary").write.parquet(f"{home}/postings-{block}")
        postings = spark.read.parquet(f"{home}/postings-{block}")
        counted = postings.mapInArrow(_frequencies(len(vocabulary)), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
        df = dict(zip(counted.column("term").to_pylist(), counted.column("df").to_pylist()))
        n_docs, n_terms = df.get(-1, 0), df.get(-2, 0)
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(vocabulary))], np.int64)
        top = postings.mapInArrow(_search(chosen, weights, n_docs, n_terms, k), "item int, doc_id long, score long")
        part = F.pmod(F.spark_partition_id(), F.lit(MERGE_PARTS))
        top = top.withColumn("part", part)
        for keys in (["item", "part"], ["item"]):
            order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
            top = top.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        ids = spark.createDataFrame(rows.select(["item_id"]).append_column("item", pa.array(range(len(terms)), pa.int32())))
        top.join(F.broadcast(ids), "item").select(F.col("item_id").cast(kind).alias("item_id"), "rank", "doc_id", "score").write.parquet(f"{home}/best/block={block}")
    schema = f"item_id {kind}, rank int, doc_id long, score long"
    if blocks is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{home}/best").select("item_id", "rank", "doc_id", "score")
