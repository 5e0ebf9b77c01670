"""Quality classifier by co-training of two views of a document.

The text view sees hashed byte n-grams of the whole text, the metadata view the document's language,
source and length. Both are logistic regressions. In each round the tasks score all unlabelled documents,
and either view hands every document that it is sure of to the other view as an example. What is handed over
reaches the driver as sums alone: the gradient of the other view, per class. Afterwards each view's score is calibrated on labelled documents that no view was trained on, and a last
regression on the calibrated log-odds combines the two. All documents are scored in the tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import Texts, slices

LABELLED_ROWS = 3000  # of each class at most
ROUNDS = 5
SURE = 0.95  # a view hands over documents that it gives this probability or more
TEXT_BITS, META_WIDTH = 12, 512
TEXT_WIDTH = (1 << TEXT_BITS) + 32
FEW_GRAMS, FEW_WORDS = 300, 20
FOLD = 4  # every fourth labelled document calibrates


def text_features(texts: Texts) -> np.ndarray:
    """One row per text: square roots of the shares of hashed 1- to 3-byte grams (case is kept),
    the size class of its number of words and the tenth that its distinct words fall in.

    The shares of a short text are damped, as they say little about its quality.
    """
    data, offsets = texts.data.astype(np.uint32), texts.offsets
    grams = [data, (data[:-1] << 8 | data[1:]) + (1 << 16), (data[:-2] << 16 | data[1:-1] << 8 | data[2:]) + (1 << 25)]
    buckets = [((g * np.uint32(2654435761)) >> np.uint32(32 - TEXT_BITS)).astype(np.int64) for g in grams]
    starts, ends, bounds = texts.words()
    words = texts.hashes(starts, ends)
    width = 1 << TEXT_BITS
    rows = np.zeros((texts.size, TEXT_WIDTH), np.float32)
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        if b > a:
            own = np.concatenate([x[a : max(a, b - j)] for j, x in enumerate(buckets)])
            rows[i, :width] = np.sqrt(np.bincount(own, minlength=width) / (len(own) + FEW_GRAMS))
        n = int(bounds[i + 1] - bounds[i])
        distinct = len(np.unique(words[bounds[i] : bounds[i + 1]])) / max(1, n)
        rows[i, width + min(15, n.bit_length())] = 0.5
        rows[i, width + 16 + (min(9, int(10 * distinct)) if n >= FEW_WORDS else 10)] = 0.5
    return rows


def meta_features(languages: list, sources: list, lengths: list) -> np.ndarray:
    """One-hot hashed language and source and the size class of the length; null is a value of its own."""
    import zlib

    rows = np.zeros((len(languages), META_WIDTH), np.float32)
    for i, (language, source, length) in enumerate(zip(languages, sources, lengths)):
        rows[i, zlib.crc32(repr(language).encode()) % 64] = 1
        rows[i, 64 + zlib.crc32(repr(source).encode()) % 384] = 1
        rows[i, 448 + (63 if length is None else min(62, max(0, int(length)).bit_length()))] = 1
    return rows / np.float32(np.sqrt(3))


def fit_logistic(
    x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 150,
    start: np.ndarray | None = None, others: np.ndarray | None = None,
) -> np.ndarray:
    """Weights with the bias last; both classes count alike. Accelerated full-batch steps from zero, or from ``start``.

    ``others`` has the sums of further examples at ``start`` (see ``handed``). The rows of ``x`` then stand for the
    curvature, and the gradient at ``start`` is made that of all examples; a column in which the others are larger
    than the rows of ``x`` is held back by as much curvature as it can lack.
    """
    y = y.astype(np.float32)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum())).astype(np.float32)
    start = np.zeros(x.shape[1] + 1, np.float32) if start is None else start
    tilt, hold = np.zeros_like(start), np.zeros_like(start)
    if others is not None:
        own = np.stack([_sums(x[y == c], _sigmoid(_odds(start, x[y == c])) - c) for c in (0, 1)])
        each, every = (0.5 / np.maximum(1, s[:, -1:]) for s in (own, own + others))
        change = (every * (own + others) - each * own).sum(0)
        n = len(start)
        tilt, hold[:-1] = change[:n].astype(np.float32), np.maximum(0, change[n:-1]) / 4
    w = start.copy()
    ahead, step = w.copy(), np.float32(2 / max(1e-6, float((x * x).sum(1).max()) + 1 + 4 * float(hold.max())))
    for t in range(rounds):
        pull = weight * (1 / (1 + np.exp(-np.clip(x @ ahead[:-1] + ahead[-1], -30, 30))) - y)
        slope = np.r_[x.T @ pull, pull.sum()] + tilt + hold * (ahead - start)
        after = ahead - step * (slope + np.float32(penalty) * ahead)
        ahead = after + np.float32(t / (t + 3)) * (after - w)
        w = after
    return w


def _sums(x: np.ndarray, pull: np.ndarray) -> np.ndarray:
    """Of some examples: gradient with the bias last, sum of squares of each column, number."""
    return np.r_[pull @ x.astype(np.float64), pull.sum(), np.einsum("ij,ij->j", x, x, dtype=np.float64), len(x)]


def _first_sure(history: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """The label that a view gave each row in the first round in which it was sure, or -1."""
    labels = np.full(len(x), -1)
    for w in history:
        p = _sigmoid(_odds(w, x))
        fresh = labels < 0
        labels[fresh & (p >= SURE)] = 1
        labels[fresh & (1 - p >= SURE)] = 0
    return labels


def handed(history: tuple[list[np.ndarray], list[np.ndarray]], text: np.ndarray, meta: np.ndarray) -> list[np.ndarray]:
    """What the rows add to the examples of either view: per class the sums at the view's last weights.

    ``history`` has the weights of both views in all rounds so far.
    """
    views, out = (text, meta), []
    for v, x in enumerate(views):
        labels = _first_sure(history[1 - v], views[1 - v])
        pull = _sigmoid(_odds(history[v][-1], x))
        out.append(np.stack([_sums(x[labels == c], pull[labels == c] - c) for c in (0, 1)]))
    return out


def _odds(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (x @ w[:-1] + w[-1]).astype(np.float64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _line(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes, none below 0, and offset of a logistic regression on a few columns, by Newton steps.

    The classes count as often as they occur, so the scores follow the share of good documents.
    """
    columns = np.c_[x, np.ones(len(x))]
    weight = np.full(len(x), 1 / len(x))
    held = np.ones(columns.shape[1], bool)
    while True:
        w = np.zeros(columns.shape[1])
        own = columns[:, held]
        for _ in range(30):
            p = _sigmoid(own @ w[held])
            gradient = own.T @ (weight * (p - y)) + 1e-3 * w[held]
            curve = (own * (weight * p * (1 - p))[:, None]).T @ own + 1e-3 * np.eye(own.shape[1])
            w[held] -= np.linalg.solve(curve, gradient)
        bad = held[:-1] & (w[:-1] < 0)
        if not bad.any():
            return w
        held[:-1] &= ~bad


class CoTrained:
    """Weights of both views, their calibration lines and the combination."""

    def __init__(self, text: np.ndarray, meta: np.ndarray, text_line: np.ndarray, meta_line: np.ndarray, both: np.ndarray):
        self.text, self.meta, self.text_line, self.meta_line, self.both = text, meta, text_line, meta_line, both

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, meta, combined) probabilities of good quality."""
        a = _odds(self.text, text) * self.text_line[0] + self.text_line[1]
        b = _odds(self.meta, meta) * self.meta_line[0] + self.meta_line[1]
        return _sigmoid(a), _sigmoid(b), _sigmoid(a * self.both[0] + b * self.both[1] + self.both[2])


def co_train(
    text: np.ndarray, meta: np.ndarray, y: np.ndarray, fold: np.ndarray, rounds: int = ROUNDS,
    give: Callable[[tuple[list[np.ndarray], list[np.ndarray]]], list[np.ndarray]] | None = None,
) -> CoTrained:
    """Train on rows with y 0 or 1 outside ``fold``; those in ``fold`` calibrate.

    ``give`` sums what the unlabelled documents add, as ``handed`` does; by default they are the rows with y -1.
    """
    views, known, free = (text, meta), (y >= 0) & ~fold, y < 0
    fold = fold & (y >= 0)
    give = give or (lambda history: handed(history, text[free], meta[free]))
    history = tuple([fit_logistic(x[known], y[known])] for x in views)
    for _ in range(rounds):
        for x, own, others in zip(views, history, give(history)):
            own.append(fit_logistic(x[known], y[known], start=own[-1], others=others))
    weights = [own[-1] for own in history]
    lines = [_line(_odds(w, x[fold])[:, None], y[fold]) for w, x in zip(weights, views)]
    calibrated = np.stack([_odds(w, x[fold]) * k[0] + k[1] for w, x, k in zip(weights, views, lines)], 1)
    return CoTrained(weights[0], weights[1], lines[0], lines[1], _line(calibrated, y[fold]))


def learn(docs: DataFrame, labels: DataFrame) -> CoTrained | None:
    """Co-train on at most ``LABELLED_ROWS`` labelled documents of each class and all other documents.

    The labelled ones taken are those with the smallest hash of their doc_id; the labels of others are not used, and
    they count as unlabelled. Every unlabelled row counts, repeated ones and those without a doc_id too; each round
    reads them once. A document labelled more than
    once counts as good if half of its labels or more are; a null quality or doc_id is no label. None if a
    class has fewer than two documents.
    """
    known = (
        labels.where("doc_id is not null and quality is not null").groupBy("doc_id")
        .agg(F.when(F.avg("quality") >= 0.5, 1).otherwise(0).alias("y"))
    )
    order = F.xxhash64("doc_id", F.lit("sample"))
    taken = [r for y in (0, 1) for r in known.where(F.col("y") == y).orderBy(order, "doc_id").limit(LABELLED_ROWS).collect()]
    if min(sum(r["y"] == y for r in taken) for y in (0, 1)) < 2:
        return None
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(r["doc_id"], r["y"]) for r in taken], "_id long, _y int")
    # At most 2 * LABELLED_ROWS short rows.
    rows = docs.join(F.broadcast(wanted), F.col("doc_id") == F.col("_id")).select(
        "doc_id", "text", "lang", "source", "n_chars", "_y"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = {n: batch.column(n).to_pylist() for n in ("doc_id", "lang", "source", "n_chars", "_y")}
            for first, end, texts in slices(batch.column("text")):
                out = []
                meta = meta_features(*[values[n][first:end] for n in ("lang", "source", "n_chars")])
                for i, row in enumerate(text_features(texts)):
                    hit = np.flatnonzero(row)
                    out.append((values["doc_id"][first + i], values["_y"][first + i], hit.astype("<u2").tobytes(), row[hit].tobytes(), meta[i].tobytes()))
                kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["doc_id", "y", "hit", "value", "meta"]
                )

    found: dict[int, tuple] = {}
    for r in rows.mapInArrow(run, "doc_id long, y int, hit binary, value binary, meta binary").toLocalIterator():
        # Of rows that repeat an id, one counts.
        row = (r["y"], bytes(r["hit"]), bytes(r["value"]), bytes(r["meta"]))
        found[r["doc_id"]] = min(found.get(r["doc_id"], row), row)
    ids = sorted(found)
    text = np.zeros((len(ids), TEXT_WIDTH), np.float32)
    meta = np.zeros((len(ids), META_WIDTH), np.float32)
    y = np.zeros(len(ids), np.int64)
    fold = np.zeros(len(ids), bool)
    counts = [0, 0]
    for i, doc_id in enumerate(ids):
        y[i], hit, value, own = found.pop(doc_id)
        text[i, np.frombuffer(hit, "<u2")] = np.frombuffer(value, np.float32)
        meta[i] = np.frombuffer(own, np.float32)
        if y[i] >= 0:
            fold[i] = counts[y[i]] % FOLD == 1  # the same part of both classes
            counts[y[i]] += 1
    if min(counts) < 2:
        return None
    # A join with all labels would shuffle every text in every round; those of the sample are few.
    free = docs.join(F.broadcast(wanted.select("_id")), F.col("doc_id") == F.col("_id"), "left_anti")
    return co_train(text, meta, y, fold, give=lambda history: _given(free, history))


def _given(free: DataFrame, history: tuple[list[np.ndarray], list[np.ndarray]]) -> list[np.ndarray]:
    """``handed`` of all rows of ``free``: summed in the tasks, then by Spark, so the driver gets one row per sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            metas = [batch.column(n).to_pylist() for n in ("lang", "source", "n_chars")]
            for first, end, texts in slices(batch.column("text")):
                more = handed(history, text_features(texts), meta_features(*[m[first:end] for m in metas]))
                total = more if total is None else [a + b for a, b in zip(total, more)]
        for v, sums in enumerate(total or []):
            place = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(place), v, np.int32)), pa.array(place.astype(np.int32)), pa.array(sums.reshape(-1)[place])],
                ["view", "place", "value"],
            )

    sums = [np.zeros((2, 2 * width + 2)) for width in (TEXT_WIDTH, META_WIDTH)]
    found = free.mapInArrow(run, "view int, place int, value double").groupBy("view", "place").agg(F.sum("value").alias("value"))
    for r in found.collect():
        sums[r["view"]].reshape(-1)[r["place"]] = r["value"]
    return sums


def _scored(model: CoTrained | None, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            metas = [batch.column(n).to_pylist() for n in ("lang", "source", "n_chars")]
            parts = [np.zeros((3, 0))]
            for first, end, texts in slices(batch.column("text")):
                if model is None:
                    parts.append(np.full((3, end - first), 0.5))
                else:
                    parts.append(np.stack(model.scores(text_features(texts), meta_features(*[m[first:end] for m in metas]))))
            scores = np.concatenate(parts, 1)
            rest = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(
                [*rest, *(pa.array(s) for s in scores), pa.array(scores[2] >= least)],
                [*batch.schema.names, "text_score", "meta_score", "score", "kept"],
            )

    return run


def score(docs: DataFrame, model: CoTrained | None, least: float = 0.5) -> DataFrame:
    """Add text_score, meta_score, score (0 to 1) and kept (score of ``least`` or more) to every row.

    Whole texts are read; a null or empty text has no grams, null metadata are values of their own, and
    without a model all scores are 0.5. Repeated rows are scored alike. Other columns pass
    through; the names added replace equal ones. An empty table gives an empty result.
    """
    docs = docs.drop("text_score", "meta_score", "score", "kept")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(
        _scored(model, least), f"{schema}, text_score double, meta_score double, score double, kept boolean"
    )
