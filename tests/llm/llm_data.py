"""Small documents for the tests: nulls, empty and long texts, ties, repeats, a foreign column."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(7)
WORDS = ["alpha", "beta", "gamma", "delta", "Epsilon,", "zeta.", "eta", "theta", "iota", "kappa"]


def prose(n, seed, words=WORDS):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) + (str(rng.randrange(60)) if rng.random() < 0.5 else "") for _ in range(n))


def odd_documents():
    long_text = prose(30_000, 1)
    texts = [
        None, "", " ", "\n\t", "one", "one two", "ünï cödé é́x 日本 語", "Same Text here", "same text HERE", "a  b\t\tc", long_text,
        long_text + " end", "$$ ## %% ||", "x\x0by\x0cz", "line\nline\nline\n\nother", "nbsp word  wide",
    ]
    rows = [(i, t, ["en", "fr", None][i % 3], ["b", "a", None][i % 3], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, "null id", None, None, None), (None, None, None, None, None), (4, "another text, same id", "en", "b", 5)]
    return rows


def frame(spark, rows, extra=()):
    """A table of documents, with further columns of the given names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in extra])
