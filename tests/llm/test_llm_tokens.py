"""Token ids, the keyed store and packing, next to the tokenizers library itself."""

import functools
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import frame, odd_documents
from tokenizers import Tokenizer

from tablesteps.llm import encoder as E
from tablesteps.llm import tokens
from tablesteps.llm.files import new_folder
from tablesteps.llm.packing import RoomTree, pack, packed_sequences

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


@functools.cache
def library(name):
    tokenizer = Tokenizer.from_file(P.path(name))
    return tokenizer


@functools.cache
def made(name):
    return E.Encoder(P.path(name))


def whole(name, texts):
    return [np.array(e.ids, "<u4").tobytes() for e in library(name).encode_batch(texts, add_special_tokens=False)]


ODD = [
    "", "a", "  a b", "a\n\nb", "it's, don't. they'LL", "\ta b", "a \nb", "x  y", "\x01 a \x01b c", "É, né. ÀB! ß? ıİ",
    "a.\nB,", "1, 2. a1, 1a,", "foo,, bar..", "<|endoftext|> hi <|startoftext|>", "a b c", "é ́x y", "日本, 語。 x",
    "\n", "  ", " ", "a\x1cb c", "ſ, Σας ΣΑΣ,", "!, a!! ?", "a 's 't, 've.", "x'\ny's,", "a\r\nb c", "ÀÉ ÀÉ, àé", "Á á,",
]


@pytest.mark.parametrize("name", FILES)
def test_pieces_give_the_ids_of_the_whole(name):
    encoder = E.Encoder(P.path(name))
    assert encoder.encode(ODD) == whole(name, ODD)
    assert encoder.encode(ODD) == whole(name, ODD)  # from the table


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aB'stl,.!?: \n\tÉé́ 1Σ日|<>", max_size=40), max_size=4))
def test_any_text(texts):
    for name in FILES:
        assert made(name).encode(texts) == whole(name, texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=4), st.sampled_from(["<|endoftext|>", "<|startoftext|>", "İ?", "J\u030c T\u0308", "K\u212a."]))
def test_any_letters(texts, odd):
    """All of Unicode, letters that change length when lowered or compose only in one case, and added tokens."""
    texts = [*texts, *[f"{t}{odd}" for t in texts], f"a {odd} b\n{odd}, c"]
    for name in FILES:
        assert made(name).encode(texts) == whole(name, texts)


def test_words_of_a_vocabulary_in_every_case():
    rng = np.random.default_rng(1)
    words = ["Straße", "ÉCOLE", "it's", "naïve", "x1y2", "日本", "don't", "A.B.", "e\u0301", "\u1e96", "ΣΑΣ"]
    texts = [" ".join(rng.choice(words) + rng.choice(["", ".", ",", "?!", "\n"]) for _ in range(30)).replace("\n ", "\n") for _ in range(200)]
    for name in FILES:
        assert made(name).encode(texts) == whole(name, texts)


def test_table_is_bounded(monkeypatch):
    monkeypatch.setattr(E, "TABLE_PIECES", 40)
    monkeypatch.setattr(E, "RECENT", 5)
    encoder = E.Encoder(P.path(FILES[1]))
    for i in range(60):
        texts = [f"w{i} w{i + 1}, w{i % 3}", "", "w0"]
        assert encoder.encode(texts) == whole(FILES[1], texts)
        assert len(encoder._known.keys) + len(encoder._recent.keys) < 60


def test_a_very_long_text():
    texts = ["x" * 300_000 + " y", "word " * 200_000 + "end", "é" * 1000]
    for name in FILES:
        assert made(name).encode(texts[1:]) == whole(name, texts[1:])
    assert made(FILES[1]).encode(texts[:1]) == whole(FILES[1], texts[:1])


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_perfect_hash(n):
    keys = [tokens._key(i * 7 - 50, i % 2) for i in range(n)]
    low, high, _ = tokens.key_words(keys)
    built = tokens.PerfectHash.build(low, high)
    again, _ = tokens.PerfectHash.from_bytes(built.to_bytes())
    assert sorted(again.slots(low, high).tolist()) == list(range(n))


def test_index_finds_its_keys_and_no_others():
    keys = [tokens._key(i, 0) for i in range(500)]
    index = tokens.Index(tokens.index_bytes(keys, np.arange(500) * 3, np.arange(500)))
    found, offset, length = index.find(keys)
    assert found.all() and (offset == np.arange(500) * 3).all() and (length == np.arange(500)).all()
    assert not index.find([tokens._key(i, 1) for i in range(500)] + [tokens._key(None, 0)])[0].any()


def test_equal_keys_are_refused():
    low, high, _ = tokens.key_words([b"x", b"x"])
    with pytest.raises(ValueError):
        tokens.PerfectHash.build(low, high)


@pytest.mark.parametrize("shard_ids", [tokens.SHARD_IDS, 40])
def test_store_round_trip(spark, monkeypatch, shard_ids):
    monkeypatch.setattr(tokens, "SHARD_IDS", shard_ids)
    rows = odd_documents()
    docs = frame(spark, rows, extra=["start", "ids"])
    got = tokens.encode_store(docs, P.path(FILES[0]), end_id=2).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for row, ids in zip(order, whole(FILES[0], [r[1] or "" for r in order])):
        ids += np.array([2], "<u4").tobytes()
        want.append((row[0], start, ids))
        start += len(ids) // 4
    def key(x):
        return (x[0] is not None, x[0] or 0, x[1])

    assert sorted(((r["doc_id"], r["start"], bytes(r["ids"])) for r in got), key=key) == sorted(want, key=key)


def test_store_lookup_of_some_keys(spark):
    docs = frame(spark, [(i, f"text {i}", None, None, None) for i in range(50)])
    folder = new_folder(spark, "test")
    shards = tokens.write_store(docs, folder, P.path(FILES[0]), 2)
    keys = spark.createDataFrame([(3,), (49,), (1000,), (-1,), (None,)], "doc_id long")
    got = {r["doc_id"]: bytes(r["ids"]) for r in tokens.lookup(keys, folder, shards).collect()}
    assert got == {i: whole(FILES[0], [f"text {i}"])[0] + np.array([2], "<u4").tobytes() for i in (3, 49)}


def test_empty_store(spark):
    assert tokens.encode_store(frame(spark, []), P.path(FILES[0]), 2).collect() == []


# ---- packing ---------------------------------------------------------------------


def test_room_tree_finds_the_tightest():
    tree, rooms = RoomTree(16), [16, 3, 7, 7, 5]
    for window, room in enumerate(rooms):
        tree.add(room, window)
    assert tree.take(4) == (5, 4)
    assert tree.take(6)[0] == 7 and tree.take(7)[0] == 7
    assert tree.take(4) == (16, 0) and tree.take(4) is None and tree.take(1) == (3, 1)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=60), st.integers(0, 4))
def test_packing_holds_every_id_once(lengths, max_gap):
    sequences = pack(lengths, 16, max_gap)
    seen = sorted((item, start + i) for s in sequences for item, start, n in s for i in range(n))
    assert seen == [(item, i) for item, n in enumerate(lengths) for i in range(n)]
    for s in sequences:
        total = sum(n for _, _, n in s)
        assert 16 - max_gap <= total <= 16 or (total < 16 and total & (total - 1) == 0)


def test_packing_is_best_fit_decreasing():
    assert pack([10, 6, 9, 7], 16, 4) == [[(0, 0, 10), (1, 0, 6)], [(2, 0, 9), (3, 0, 7)]]


def test_packed_documents(spark):
    rows = odd_documents()
    got = packed_sequences(frame(spark, rows, extra=["sequence_id", "length"]), P.path(FILES[1]), end_id=0).collect()
    want = sorted(whole(FILES[1], [r[1] or ""])[0] + bytes(4) for r in rows)
    pieces, at = {}, {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
        assert len(r["ids"]) == 4 * r["length"]
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], bytes(r["ids"])))
    assert all(n <= 1024 for n in at.values())
    by_id = {}
    for r, ids in zip(rows, whole(FILES[1], [r[1] or "" for r in rows])):
        by_id.setdefault((r[0], len(ids) // 4 + 1), []).append(ids + bytes(4))
    assert set(by_id) == set(pieces)
    for key, texts in by_id.items():
        if len(texts) == 1:
            assert b"".join(x for _, x in sorted(pieces[key])) == texts[0]
        assert sum(len(x) for _, x in pieces[key]) == sum(map(len, texts))
    assert sum(at.values()) == sum(len(x) // 4 for x in want)
    padding = sum(1024 - n for n in at.values() if n & (n - 1))
    assert padding < 0.01 * sum(at.values())


def test_no_documents_to_pack(spark):
    assert packed_sequences(frame(spark, []), P.path(FILES[1]), end_id=0).collect() == []


def test_crc_of_ids(spark):
    from pyspark.sql import functions as F

    ids = np.array([1, 70_000, 2], "<u4").tobytes()
    row = spark.createDataFrame([(ids,)], "ids binary").select(F.crc32("ids").alias("c")).first()
    assert row["c"] == zlib.crc32(ids)
