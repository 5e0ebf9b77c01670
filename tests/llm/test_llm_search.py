"""Collocations, ranked search and near-copies against plain loops over small tables."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from check import compare, connect
from conftest import SMALL
from llm_data import frame, odd_documents, prose
from pyspark.sql import functions as F

from tablesteps.llm import collocations as C
from tablesteps.llm import hyperminhash as H
from tablesteps.llm import keybits
from tablesteps.llm import lexical as X
from tablesteps.llm.queries import ORACLES, QUERIES
from tablesteps.llm.textbytes import U64, shingles, slices

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


@pytest.mark.parametrize("name", ["op11_phrase_collocations", "op12_ranked_search", "op13_hyperminhash_near_dedup"])
def test_against_sql(spark, duck, name):
    assert compare(QUERIES[name](spark, SMALL), duck, ORACLES[name])[0] == ""


# ---- collocations ---------------------------------------------------------------


def brute_collocations(rows, least, most):
    counts, totals = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            totals[lang] += len(words)
            for size in range(1, 6):
                for i in range(len(words) - size + 1):
                    counts[lang, tuple(words[i : i + size])] += 1
    out = []
    frequent = {k: a for k, a in counts.items() if a >= least and len(k[1]) > 1}
    covered = set()
    for (lang, phrase), a in frequent.items():
        for i in range(len(phrase)):
            for j in range(i + 2, len(phrase) + 1):
                part = (lang, phrase[i:j])
                if j - i < len(phrase) and a >= frequent.get(part, a + 1):
                    covered.add(part)
    for (lang, phrase), a in frequent.items():
        if (lang, phrase) not in covered:
            n = totals[lang]
            cuts = [(1000 * a * n // (counts[lang, phrase[:k]] * counts[lang, phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            out.append((lang, " ".join(phrase), a, counts[lang, phrase[:k]], counts[lang, phrase[k:]], n, score))
    ranked = []
    for lang in {r[0] for r in out}:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:most]
        ranked += [(r[0], i + 1, *r[1:]) for i, r in enumerate(mine)]
    return sorted(ranked)


def phrase_rows():
    rng = random.Random(3)
    words = ["the", "of", "New", "york", "city", "Süd", "x-y", "a'b", "日本"]
    rows = [(i, " ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".", "\n"]) for _ in range(rng.randrange(40))), rng.choice(["en", "fr", None, "und"]), "s", 1) for i in range(300)]
    rows += [(1000 + i, "one fixed passage of eight words in all", "en", "s", 1) for i in range(40)]  # copies, activated late
    return rows + odd_documents()


@pytest.mark.parametrize("least,most,shards", [(12, 2000, 4), (3, 15, 1)])
def test_collocations(spark, least, most, shards):
    rows = phrase_rows()
    docs = frame(spark, rows, ["score", "key", "a", "n", "shard", "phrase", "len"]).repartition(5)
    found = C.collocations(docs, least, most, shards).collect()
    assert sorted(tuple(r) for r in found) == brute_collocations(rows, least, most)


def test_late_and_hot_phrases(spark):
    """A rare word found often in the last shard only, and one text that is a third of all rows."""
    rows = [(i, f"w{i % 7} filler text", "en", "s", 1) for i in range(400)]
    rows += [(i, "hot copies of one single text", "en", "s", 1) for i in range(200)]
    rows += [(i, "zeta eta theta iota kappa lambda", "en", "s", 1) for i in range(600, 625)]
    docs = frame(spark, rows).coalesce(1)
    found = C.collocations(docs, 25).collect()
    assert sorted(tuple(r) for r in found) == brute_collocations(rows, 25, 2000)


def test_shared_places_only_cost_work(spark, monkeypatch):
    """With a table of four places every phrase is activated with some other one; counts stay exact."""
    monkeypatch.setattr(keybits, "BITS", 2)
    monkeypatch.setattr(C, "BITS", 2)
    rows = phrase_rows()
    found = C.collocations(frame(spark, rows), 12).collect()
    assert sorted(tuple(r) for r in found) == brute_collocations(rows, 12, 2000)


def test_lookup_names_hardly_more_than_wanted(spark):
    """Rare phrases that are not looked for are not named, though there are many of them and many wanted keys."""
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(12)) for _ in range(20000)] + ["one wanted phrase"]
    batch = pa.record_batch({"lang": ["en"] * len(texts), "text": texts})
    wanted = next(p for p, *_ in C._by_language(iter([batch.slice(20000)])))
    here = [int(k) for length, key in wanted.keys() if length > 1 for k in key.view(np.int64)]
    others = spark.range(40000).select(F.xxhash64("id").alias("key"))
    keys = spark.createDataFrame([(k,) for k in here], "key long").union(others)
    found = pa.Table.from_batches(C._names(keybits.packed_bits(keys, "key"))(iter([batch])))
    assert {"one wanted", "wanted phrase", "one wanted phrase"} <= set(found.column("phrase").to_pylist())
    assert found.num_rows < 50  # of 760,000


def test_marked_keys_are_found(spark):
    rng = np.random.default_rng(5)
    keys = np.r_[rng.integers(-(2**63), 2**63 - 1, 3000), -(2**63), 2**63 - 1, -1, 0]
    df = spark.createDataFrame([(int(k),) for k in keys] + [(None,)], "`a key` long")
    table = keybits.unpacked_bits(keybits.packed_bits(df, "a key"))
    assert keybits.marked(table, keys.view(U64)).all()
    assert keybits.marked(table, rng.integers(0, 2**63, 10**6).view(U64)).sum() < 50
    assert not keybits.marked(keybits.unpacked_bits(keybits.packed_bits(df.limit(0), "a key")), keys.view(U64)).any()


def test_huge_counts_do_not_overflow(spark):
    a, n, l, r = 10**12, 10**13, 10**12 + 7, 10**12 + 9
    got = spark.createDataFrame([(a, n, l, r)], "a long, n long, l long, r long").selectExpr(f"{C.SCORE} AS s").first().s
    assert got == 1000 * a * n // (l * r)


def test_empty_collocations(spark):
    assert C.collocations(frame(spark, [])).count() == 0
    assert C.collocations(frame(spark, [(1, None, None, None, None), (2, " .,! ", "en", "a", 1)])).count() == 0


# ---- ranked search --------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_ranked(docs, items, k):
    terms = [(d[0], Counter(TERM.findall((d[1] or "").translate(LOWER)))) for d in docs]
    terms = [(i, c) for i, c in terms if c]
    n_docs, total = len(terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = []
    for item, text in items:
        wanted = set(TERM.findall((text or "").translate(LOWER)))
        scored = []
        for doc_id, c in terms:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                for t in wanted if t in c
            )
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        for rank, (score, _, doc_id) in enumerate(sorted(scored, key=lambda s: (s[0], s[1], s[2] or 0))[:k], 1):
            out.append((item, rank, doc_id, -score))
    return out


def order(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("cells,terms,k", [(1 << 23, 1 << 14, 10), (600, 30, 3), (1, 1, 10)])
def test_ranked_search(spark, monkeypatch, cells, terms, k):
    monkeypatch.setattr(X, "CELLS", cells)
    monkeypatch.setattr(X, "BLOCK_TERMS", terms)
    docs = odd_documents() + [(i, prose(30 + i % 9, i % 50), "en", "a", 1) for i in range(100, 260)]  # copies and ties
    items = [(0, prose(12, 5)), (1, "Alpha BETA!"), (2, None), (3, ""), (4, "nosuchterm"), (None, "gamma42"), (5, "ünï 日本"), (1, "Alpha BETA!"), (6, prose(400, 9))]
    asked = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS score")
    found = X.ranked_search(frame(spark, docs, ["score", "item", "n", "postings"]).repartition(4), asked, k)
    assert found.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert order(tuple(r) for r in found.collect()) == order(brute_ranked(docs, items, k))


def test_ranked_search_of_empty_tables(spark):
    items = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert X.ranked_search(frame(spark, []), items).count() == 0
    assert X.ranked_search(frame(spark, odd_documents()), items.where("item_id < 0")).count() == 0
    assert X.ranked_search(frame(spark, [(1, None, None, None, None)]), items).count() == 0


def test_best_positions_stop_early():
    """With one document far ahead the search scores few of many documents, and the threshold is strict."""
    rng = np.random.default_rng(1)
    n_docs, n_terms = 5000, 6
    term, doc = np.repeat(np.arange(n_terms), n_docs), np.tile(np.arange(n_docs), n_terms)
    impacts = rng.integers(1, 100, n_terms * n_docs)
    impacts[doc == 77] = 1000
    lists, best, ids = X.ImpactLists(term, doc, impacts, n_terms, n_docs), X.Best(1), np.arange(n_docs)
    assert lists.search(np.arange(n_terms), best, ids, np.zeros(n_docs, bool)) < n_docs / 10
    assert best.ids.tolist() == [77]
    tied = X.ImpactLists(np.zeros(100, int), np.arange(100)[::-1].copy(), np.full(100, 5), 1, 100)
    best = X.Best(2)
    tied.search(np.array([0]), best, np.arange(100)[::-1].copy(), np.zeros(100, bool))
    assert best.ids.tolist() == [0, 1]


# ---- near-copies ----------------------------------------------------------------


def brute_near(rows, words=5, percent=85):
    sets = []
    for _, text, *_ in rows:
        found = re.findall(r"[^ \t-\r]+", (text or "").translate(LOWER))
        sets.append({tuple(found[i : i + words]) for i in range(len(found) - words + 1)} if len(found) >= words else {tuple(found)} if found else set())
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[top(i)] = top(j)
    least = defaultdict(list)
    for i, row in enumerate(rows):
        least[top(i)].append(row[0])
    out = []
    for i, row in enumerate(rows):
        ids = [x for x in least[top(i)] if x is not None]
        component = min(ids) if ids else None
        out.append((row[0], len(sets[i]), component, row[0] == component))
    return order(out)


def edited(text, share, seed):
    rng = random.Random(seed)
    return " ".join(f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split(" "))


def near_rows():
    """Groups at every distance from the threshold, short texts, chains of edits, copies."""
    rows = odd_documents()
    for g in range(12):
        base = prose([6, 9, 20, 45, 120, 300][g % 6], 100 + g, [f"w{i}" for i in range(400)])
        rows += [(1000 * g + i, edited(base, [0, 0.002, 0.01, 0.02, 0.03, 0.05, 0.1][i % 7], 50 * g + i), "en", "a", 1) for i in range(20)]
    text = prose(200, 77, [f"w{i}" for i in range(400)])
    for i in range(25):
        rows.append((90_000 - i, text, "en", "a", 1))
        text = edited(text, 0.006, i)
    return rows


@pytest.mark.parametrize("block_rows", [512, 4])
def test_near_duplicates(spark, monkeypatch, block_rows):
    monkeypatch.setattr(H, "BLOCK_ROWS", block_rows)
    rows = near_rows()
    docs = frame(spark, rows, ["member", "sketch", "root", "content", "kept"]).repartition(6)
    assert order(tuple(r) for r in H.near_duplicates(docs).collect()) == brute_near(rows)


def test_large_group_is_linear(spark, monkeypatch):
    """A third of all rows are copies and near-copies of one text; pairs of blocks that are joined already are not compared."""
    monkeypatch.setattr(H, "BLOCK_ROWS", 16)
    base = prose(200, 5, [f"w{i}" for i in range(400)])
    rows = [(i, edited(base, 0.0025, i), "en", "a", 1) for i in range(300)] + [(1000 + i, base, "en", "a", 1) for i in range(300)]
    rows += [(2000 + i, prose(60, 10_000 + i, [f"v{i}" for i in range(3000)]), "en", "a", 1) for i in range(900)]
    found = {r.doc_id: r for r in H.near_duplicates(frame(spark, rows)).collect()}
    assert {found[i].component_id for i in [*range(300), *range(1000, 1300)]} == {0}
    assert all(found[2000 + i].kept for i in range(900))


def test_many_rows_under_one_id(spark):
    rows = [(None if i % 3 else 7, prose(40, i), "en", "a", 1) for i in range(150)] + [(3, prose(40, 5), "en", "a", 1)]
    assert order(tuple(r) for r in H.near_duplicates(frame(spark, rows)).collect()) == brute_near(rows)


def test_empty_near_duplicates(spark):
    assert H.near_duplicates(frame(spark, [])).count() == 0
    rows = [(1, None, None, None, None), (2, "\t \n", "en", "a", 1)]
    assert order(tuple(r) for r in H.near_duplicates(frame(spark, rows)).collect()) == brute_near(rows)


def test_registers_keep_zeros_and_bits():
    values = [1, 2, 3, (1 << 63) + (5 << 53), 1 << 40, (1 << 64) - 1]
    got = H.registers(np.array([values], U64))[0].tolist()
    for value, register in zip(values, got):
        zeros = 64 - value.bit_length()
        bits = ((value << zeros) >> 53) & 1023
        assert register == (zeros << 10) | bits


def test_estimate_follows_the_similarity():
    rng = np.random.default_rng(2)
    errors = []
    for share in (0.2, 0.5, 0.85):
        for _ in range(30):
            union = rng.integers(1, 1 << 63, 1000).astype(U64)
            both = int(1000 * share)
            rest = (1000 - both) // 2
            left, right = union[: both + rest], np.r_[union[:both], union[both + rest :]]
            a, b = (H.registers(H.minima(x)[None, :])[0] for x in (left, right))
            chance = H.accidental(np.array([len(left)]), np.array([len(right)]))[0]
            errors.append((np.mean(a == b) - chance) / (1 - chance) - share)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05
    # Of two sets with nothing in common about one register in six thousand is equal.
    same = [np.mean(H.registers(H.minima(rng.integers(1, 1 << 63, 500).astype(U64))[None]) == H.registers(H.minima(rng.integers(1, 1 << 63, 500).astype(U64))[None])) for _ in range(200)]
    assert abs(np.mean(same) - H.accidental(np.array([500]), np.array([500]))[0]) < 3e-4


def test_pairs_at_the_threshold_pass_the_estimate():
    assert 90 < H.least_count(85) < 115
    text = prose(400, 8, [f"w{i}" for i in range(900)])
    _, _, texts = next(slices(pa.array([text, edited(text, 0.016, 3)])))
    one, other = shingles(texts, 5)
    common = len(np.intersect1d(one, other))
    assert 0.8 < common / (len(one) + len(other) - common) < 0.95
    sketches = [H.registers(H.minima(c)[None])[0].tobytes() for c in (one, other)]
    blocks = [H.Block([(i, len(c), i, s)]) for i, (c, s) in enumerate(zip((one, other), sketches))]
    assert len(H.candidate_pairs(*blocks, 85)[0]) == 1
