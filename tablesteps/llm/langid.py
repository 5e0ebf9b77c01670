"""Language identification in two steps: the family first, then the language within it.

A text's features are shares of hashed byte n-grams (1 to 3 bytes of the text with A-Z
lower-cased). A linear classifier over all families picks the family; within it, every pair of
languages has a linear support vector machine, and the language that wins most pairs is
predicted. All classifiers are trained in numpy on a bounded sample of labelled rows, and applied to
whole texts in the tasks, so the broadcast model has a fixed size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textbytes import Texts, slices

# Families of common languages. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca"],
    "slavic": ["ru", "pl", "cs", "uk", "sk", "bg", "hr"],
    "uralic": ["fi", "et", "hu"],
}
BUCKET_BITS = 12
BUCKETS = 1 << BUCKET_BITS
SAMPLE_ROWS = 1000  # labelled rows per language that training takes at most
_WORD_SIGN = re.compile(r"[^\W\d_]+")
LETTER = r"\p{L}"  # as ``has_letter``, for Spark


def has_letter(text: str) -> bool:
    """Whether a text holds a letter; number letters such as roman numerals and fractions are none."""
    return any(any(map(str.isalpha, m.group())) for m in _WORD_SIGN.finditer(text))


def family_of(language: str) -> str:
    return next((f for f, members in FAMILIES.items() if language in members), language)


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, bounds): the n-gram buckets of text i are buckets[bounds[i]:bounds[i + 1]]."""
    lowered = texts.lowered()
    data, offsets = lowered.data.astype(np.uint32), lowered.offsets
    n = len(data)
    grams = np.zeros((n, 3), np.uint32)
    grams[:, 0] = data
    grams[1:, 1] = (data[:-1] << 8 | data[1:]) + (1 << 16)
    grams[2:, 2] = (data[:-2] << 16 | data[1:-1] << 8 | data[2:]) + (1 << 25)
    # Grams that would reach into the text before count as the single byte once more.
    first = np.zeros(n, np.int64)
    starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[starts] = starts
    inside = np.arange(n) - np.maximum.accumulate(first)
    grams[inside < 1, 1] = data[inside < 1]
    grams[inside < 2, 2] = data[inside < 2]
    buckets = (grams * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)
    return buckets.reshape(-1).astype(np.int64), offsets * 3


def _shares(buckets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row per text: the square roots of the shares of each bucket."""
    rows = np.zeros((len(bounds) - 1, BUCKETS), np.float32)
    for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        if b > a:
            rows[i] = np.sqrt(np.bincount(buckets[a:b], minlength=BUCKETS) / (b - a))
    return rows


def train_svm(x: np.ndarray, y: np.ndarray, rounds: int = 60, penalty: float = 1e-4) -> np.ndarray:
    """Weights (with the bias last) of a linear SVM with squared hinge loss; y is -1 or 1.

    Full-batch accelerated gradient steps from zero: the same rows give the same weights. Both
    classes count alike, whatever their sizes.
    """
    y = y.astype(np.float32)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = np.zeros(x.shape[1] + 1, np.float32)
    ahead, step = w.copy(), np.float32(0.25)  # rows have length 1, with the bias at most 2
    for t in range(rounds):
        gap = np.maximum(0, 1 - y * (x @ ahead[:-1] + ahead[-1]))
        pull = weight * y * gap
        gradient = np.r_[-2 * (pull @ x), np.float32(-2 * pull.sum())] + np.float32(penalty) * ahead
        after = ahead - step * gradient
        ahead = after + np.float32(t / (t + 3)) * (after - w)
        w = after
    return w


class Model:
    """Families, their languages, and one weight vector per family and per pair within one."""

    def __init__(self, families: list[str], members: dict[str, list[str]], weights: np.ndarray, sharpness: np.ndarray):
        self.families, self.members, self.weights, self.sharpness = families, members, weights, sharpness

    @property
    def pairs(self) -> list[tuple[str, str, str]]:
        return [(f, a, b) for f in self.families for a, b in combinations(self.members[f], 2)]

    def predict(self, margins: np.ndarray) -> list[tuple[str, float]]:
        """(language, score) of each row of margins; the score is the product of both steps' probabilities."""
        sure = 1 / (1 + np.exp(-np.clip(margins * self.sharpness, -30, 30)))
        n = len(self.families)
        family = np.argmax(margins[:, :n], 1)
        total = sure[:, :n].sum(1)
        out = []
        places = {p: n + i for i, p in enumerate(self.pairs)}
        for row, f in enumerate(family.tolist()):
            name, members = self.families[f], self.members[self.families[f]]
            score = float(sure[row, f] / total[row])
            wins = {m: [0, 0.0] for m in members}
            for a, b in combinations(members, 2):
                p = float(sure[row, places[name, a, b]])
                winner, chance = (a, p) if p >= 0.5 else (b, 1 - p)
                wins[winner][0] += 1
                wins[winner][1] += chance
            best = max(members, key=lambda m: (wins[m][0], wins[m][1]))
            if wins[best][0]:
                score *= wins[best][1] / wins[best][0]
            out.append((best, min(1.0, max(0.0, score))))
        return out


def train(labelled: DataFrame, sample: int = SAMPLE_ROWS) -> Model | None:
    """A model from (text, lang), on at most ``sample`` distinct texts of each language.

    The texts taken are those with the smallest hash; copies are one text. Their features go to the driver,
    at most ``sample`` texts of each language that has a label. Rows without a language or a letter are
    not used; None if nothing is left.
    """
    rows = labelled.where("lang is not null and text is not null").select("text", "lang").where(F.col("text").rlike(LETTER))
    rows = rows.withColumn("place", F.xxhash64("text", F.lit("sample")))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("place", 0.02).alias("n")).collect()}
    # Keep a text by its hash with the chance that gives each language its sample and some more, then cut exactly.
    most = 1.1 * sample + 8 * sample**0.5 + 20
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, most / max(1, n)))) for k, n in sorted(counts.items())], F.lit(0.0))
    spread = F.pmod("place", F.lit(1 << 30)) / float(1 << 30)
    drawn = (rows.where(spread < share) if counts else rows.limit(0)).groupBy("lang", "place").agg(F.min("text").alias("text"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("place", F.lit(1 << 30)), "place"))
    taken = drawn.withColumn("nth", nth).where(F.col("nth") <= sample).select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, column = batch.column("lang").to_pylist(), batch.column("text")
            for first, end, texts in slices(column):
                buckets, bounds = features(texts)
                out = []
                for i in range(end - first):
                    text = column[first + i].as_py()
                    if has_letter(text):
                        counted = np.bincount(buckets[bounds[i] : bounds[i + 1]], minlength=BUCKETS)
                        hit = np.flatnonzero(counted)
                        out.append((names[first + i], hit.astype("<u2").tobytes(), np.sqrt(counted[hit] / (bounds[i + 1] - bounds[i])).astype("<f4").tobytes()))
                lang, hit, value = zip(*out) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lang, pa.string()), pa.array(hit, pa.binary()), pa.array(value, pa.binary())], ["lang", "hit", "value"]
                )

    by_language: dict[str, list[tuple[bytes, bytes]]] = {}
    for row in taken.mapInArrow(run, "lang string, hit binary, value binary").collect():
        by_language.setdefault(row["lang"], []).append((bytes(row["hit"]), bytes(row["value"])))
    if not by_language:
        return None
    examples, names = [], []
    for lang in sorted(by_language):
        for hit, value in sorted(by_language[lang]):
            row = np.zeros(BUCKETS, np.float32)
            row[np.frombuffer(hit, "<u2")] = np.frombuffer(value, "<f4")
            examples.append(row)
            names.append(lang)
    del by_language
    x, y = np.stack(examples), np.array(names)
    del examples
    members: dict[str, list[str]] = {}
    for lang in sorted(set(names)):
        members.setdefault(family_of(lang), []).append(lang)
    families = sorted(members)
    family = np.array([family_of(n) for n in names])
    weights, sharpness = [], []

    def fit(rows: np.ndarray, positive: np.ndarray) -> None:
        z = x if rows.all() else x[rows]
        sign = np.where(positive[rows], 1.0, -1.0)
        w = train_svm(z, sign) if len(set(sign)) == 2 else np.r_[np.zeros(BUCKETS), sign[0]]
        margin = np.abs(z @ w[:-1] + w[-1]) if len(z) else np.ones(1)
        weights.append(w)
        sharpness.append(3 / max(1e-6, float(np.median(margin))))

    for f in families:
        fit(np.ones(len(y), bool), family == f)
    for f in families:
        for a, b in combinations(members[f], 2):
            fit((y == a) | (y == b), y == a)
    return Model(families, members, np.stack(weights, 1).astype(np.float32), np.array(sharpness))


def _predicted(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            languages, scores = [], []
            for first, end, texts in slices(column):
                margins = None
                if model is not None:
                    buckets, bounds = features(texts)
                    margins = _shares(buckets, bounds) @ model.weights[:-1] + model.weights[-1]
                    predicted = model.predict(margins)
                for i in range(first, end):
                    text = column[i].as_py()
                    if model is None or text is None or not has_letter(text):
                        languages.append("und")
                        scores.append(0.0)
                    else:
                        languages.append(predicted[i - first][0])
                        scores.append(predicted[i - first][1])
            rest = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(languages, pa.string()), pa.array(scores, pa.float64())],
                [*batch.schema.names, "lang_pred", "score"],
            )

    return run


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Add lang_pred and score (0 to 1) to every row, from its whole text alone.

    ``und`` with score 0 for a null text, one without a letter (empty ones too), or without a model.
    Repeated rows are predicted alike; other columns pass through, but lang_pred and score are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_predicted(model), f"{schema}, lang_pred string, score double")


def held_out() -> Column:
    """Whether crc32 of the doc_id as text leaves 2 when divided by 4; a null id is never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
