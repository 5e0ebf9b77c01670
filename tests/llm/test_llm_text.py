"""Jaccard join, language identification, quality rules and classifier, mixing: brute force and edge cases."""

import re
import string
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_data import frame, odd_documents, prose
from pyspark.sql import functions as F

from tablesteps.llm import cotrain, jaccard, langid, mixing, quality_rules
from tablesteps.llm.textbytes import shingles, slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def one_slice(texts):
    ((_, _, out),) = slices(pa.array(texts), most=1 << 40)
    return out


# ---- words -----------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é日\n\t\x0b\x0c\x1c #", max_size=30)), min_size=1, max_size=6))
def test_words_of_a_batch(texts):
    made = one_slice(texts)
    starts, ends, bounds = made.words()
    for i, text in enumerate(texts):
        got = [bytes(made.data[a:b]).decode() for a, b in zip(starts[bounds[i] : bounds[i + 1]], ends[bounds[i] : bounds[i + 1]])]
        assert got == WORD.findall(text or "")


def test_slices_cover_all_rows():
    column = pa.array([None, "", "x" * 50, "y", None, "z" * 7, ""]).slice(1)
    got = [(a, b, bytes(t.data)) for a, b, t in slices(column, most=8)]
    assert [a for a, _, _ in got] == [0] + [b for _, b, _ in got][:-1] and got[-1][1] == 6
    assert b"".join(x for _, _, x in got) == b"x" * 50 + b"y" + b"z" * 7


# ---- n-gram Jaccard join -----------------------------------------------------------


def brute_sets(texts, words):
    out = []
    for text in texts:
        w = WORD.findall((text or "").translate(LOWER))
        out.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    return out


def brute_components(ids, sets, percent):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(ids))]


def near_copies():
    """Groups whose members differ by a few words each, so that most pairs are near the threshold."""
    rng = np.random.default_rng(3)
    rows = []
    for group in range(4):
        base = prose(60 + 40 * group, 100 + group).split(" ")
        for _ in range(40):
            words = list(base)
            for at in rng.integers(0, len(words), rng.integers(0, 9)):
                words[at] = f"new{rng.integers(0, 4)}"
            rows.append(" ".join(words))
    rows += [prose(30, 900 + i) for i in range(20)]
    shared = prose(55, 77)
    rows += [shared + " " + prose(50, 2000 + i) for i in range(20)]
    return [(int(i), t, None, None, None) for i, t in zip(rng.permutation(len(rows)) * 3, rows)]


@pytest.mark.parametrize(("words", "percent", "block"), [(3, 90, 768), (5, 80, 768), (3, 90, 7), (5, 80, 7), (1, 60, 7)])
def test_components_like_brute_force(spark, monkeypatch, words, percent, block):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", block)
    rows = near_copies() + [(i + 10_000 if i is not None else None, *rest) for i, *rest in odd_documents()]
    sets = brute_sets([r[1] for r in rows], words)
    want = brute_components([r[0] for r in rows], sets, percent)
    docs = frame(spark, rows, extra=["set_key", "block", "component_id"])
    got = jaccard.link_components(docs, words, percent).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter(
        (row[0], len(s), c) for row, s, c in zip(rows, sets, want)
    )


def test_texts_under_one_id_meet_once(spark, monkeypatch):
    rows = [(None, prose(40, 1) + f" end{i}", "en", "a", 1) for i in range(30)] * 2
    cells, seen = jaccard._cells, spark.sparkContext.accumulator(0)

    def counted(words):
        run = cells(words)

        def count(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield from run([batch])

        return count

    monkeypatch.setattr(jaccard, "_cells", counted)
    got = jaccard.link_components(frame(spark, rows), words=3, percent=60).collect()
    assert len(got) == 60 and len({r["component_key"] for r in got}) == 1
    assert 0 < seen.value <= 60


def test_jaccard_of_nothing(spark):
    assert jaccard.link_components(frame(spark, [])).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 400), st.integers(0, 30), st.integers(0, 30), st.sampled_from([60, 80, 90, 100]), st.integers(0, 10**6))
def test_linked_sets_share_a_signature(common, left, right, percent, seed):
    if 100 * common < percent * (common + left + right):
        return
    cells = np.unique(np.random.default_rng(seed).integers(0, 1 << 63, common + left + right).astype(np.uint64))
    np.random.default_rng(seed + 1).shuffle(cells)
    a, b = np.sort(cells[: common + left]), np.sort(np.r_[cells[:common], cells[common + left :]])
    classes = jaccard.Classes(percent)
    both = [dict(zip(*(x.tolist() for x in classes.signatures(c)))) for c in (a, b)]
    equal = both[0].keys() & both[1].keys()
    mask = (1 << jaccard.NOTE_NEED) - 1
    need = [{n & mask: (n >> jaccard.NOTE_NEED) & 0xFFFFFF for n in own.values()} for own in both]
    counts = [Counter(own[s] & mask for s in equal) for own in both]
    assert any(c >= max(need[0][t], need[1][t]) for t, c in counts[0].items() if t in need[1] and counts[1][t] == c)


def test_equal_hashes_of_equal_shingles():
    a, b, c = shingles(one_slice(["A b  C d", "x a\tB c\nD", "a b"]), 3)
    assert len(a) == 2 and len(b) == 3 and len(np.intersect1d(a, b)) == 2 and len(c) == 1


def test_shared_runs_over_batches():
    rows = [(1, 5), (1, 5), (1, 6), (2, 1), (3, 2), (3, 2), (4, 1), (4, 2), (4, 2), (4, 3), (5, 9)]
    want = [(s, m, min(x for t, x in rows if t == s)) for s, m in sorted(set(rows)) if len({x for t, x in rows if t == s}) > 1]
    for width in range(1, len(rows) + 1):
        batches = [
            pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64()), pa.array([1] * len(part), pa.int64())],
                ["sig", "member", "note"],
            )
            for part in (rows[i : i + width] for i in range(0, len(rows), width))
        ]
        got = [(r["sig"], r["member"], r["pivot"]) for b in jaccard._shared(iter(batches)) for r in b.to_pylist()]
        assert got == want


def test_star_contraction(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 102), (102, 101), (101, 100), (7, 7), (3, 2)]
    got = {r["a"]: r["b"] for r in jaccard.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 102: 100}


# ---- language identification ---------------------------------------------------------


LANGUAGES = {
    "en": ["the", "and", "thing", "with", "ing", "oath"], "de": ["der", "und", "schön", "über", "keit", "zung"],
    "fr": ["les", "être", "dans", "eaux", "çela", "pour"], "es": ["los", "año", "ción", "para", "ñandú", "más"],
    "xx": ["qzq", "zzk", "kqk", "xqx", "zqz", "kkz"],
}


def language_rows(n, first=0):
    return [
        (first + i, prose(3 + i % 30, first + i, LANGUAGES[lang]), lang, "s", 1)
        for i in range(n) for lang in [list(LANGUAGES)[i % len(LANGUAGES)]]
    ]


def test_held_out_languages(spark):
    model = langid.train(frame(spark, language_rows(300)))
    assert model.members["germanic"] == ["de", "en"] and model.members["xx"] == ["xx"]
    rows = [(i, t, None, s, n) for i, t, _, s, n in language_rows(200, 5000)]
    got = {r["doc_id"]: r for r in langid.predict(frame(spark, rows), model).collect()}
    want = {i: lang for i, _, lang, _, _ in language_rows(200, 5000)}
    assert np.mean([got[i]["lang_pred"] == want[i] for i in want]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_odd_texts_have_a_language_or_und(spark):
    model = langid.train(frame(spark, language_rows(100)))
    docs = frame(spark, odd_documents(), extra=["score", "margins"])
    got = langid.predict(docs, model)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "margins", "lang_pred", "score"]
    for r in got.collect():
        letter = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letter) and r["margins"] == "own margins"
        assert r["lang_pred"] in {"und", *LANGUAGES}


def test_nothing_to_learn_languages_from(spark):
    unlabelled = frame(spark, [(1, "words", None, None, None), (2, None, "en", None, None), (3, "123", "en", None, None)])
    model = langid.train(unlabelled)
    assert model is None
    assert {(r["lang_pred"], r["score"]) for r in langid.predict(unlabelled, model).collect()} == {("und", 0.0)}
    assert langid.predict(frame(spark, []), None).collect() == []


def test_one_language(spark):
    model = langid.train(frame(spark, [(1, "some words", "en", None, None)]))
    (row,) = langid.predict(frame(spark, [(2, "other", None, None, None)]), model).collect()
    assert row["lang_pred"] == "en"


def test_training_sample_is_bounded_and_repeatable(spark):
    docs = frame(spark, language_rows(300))
    a, b = langid.train(docs, sample=10), langid.train(docs.repartition(5), sample=10)
    assert np.allclose(a.weights, b.weights)


def test_copies_are_one_training_text(spark, monkeypatch):
    texts = [f"wort nummer {i} und mehr {'abcdefgh'[i % 8] * (i % 5 + 1)}" for i in range(40)]
    order = spark.createDataFrame([(t,) for t in texts], "text string").orderBy(F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 30)))
    smallest = [r["text"] for r in order.limit(10).collect()]
    rows = [(i, t, lang, "s", 1) for lang in ("de", "en") for i, t in enumerate(texts + [smallest[0]] * 60 + ["12 34"] * 60)]
    seen = []
    fit = langid.train_svm
    monkeypatch.setattr(langid, "train_svm", lambda x, y: seen.append(x) or fit(x, y))
    langid.train(frame(spark, rows), sample=10)
    want = langid._shares(*langid.features(one_slice(smallest)))
    assert all(len(x) == 20 for x in seen) and {r.tobytes() for r in seen[0]} == {r.tobytes() for r in want.astype(np.float32)}


def test_held_out_rows(spark):
    import zlib

    ids = [*range(40), None]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", langid.held_out().alias("h")).collect()
    assert all(r["h"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)


# ---- quality rules -------------------------------------------------------------------


def brute_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
    )


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab é日\n\t#|\x0c", max_size=40), min_size=1, max_size=5))
def test_counts_of_any_text(texts):
    found = quality_rules.base_counts(one_slice(texts))
    assert [tuple(int(found[c][i]) for c in COUNTS) for i in range(len(texts))] == [brute_counts(t) for t in texts]


def quality_rows():
    good = [(i, prose(120 + i, i), "en", None, None) for i in range(60)]
    bad = [(100 + i, "".join(f"{w.upper()}!!*** | " for w in prose(120, 500 + i).split(" ")), "en", None, None) for i in range(6)]
    repeated = [(200, "same words again " * 40, "en", None, None), (201, prose(49, 9), "en", None, None)]
    return good + bad + repeated


def test_quality_rules(spark):
    rows = quality_rows() + [(i, t, x, s, n) for i, t, x, s, n in odd_documents() if i is not None and i > 10]
    docs = frame(spark, rows, extra=["kept", "classes"])
    got = quality_rules.judge(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        counts = brute_counts(r["text"])
        assert tuple(r[c] for c in COUNTS) == counts and r["classes"] == "own classes"
        assert r["base_failed"] == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (r["base_failed"] and r["kept"])
        assert 0 <= r["class_distance"] <= 1 and 0 <= r["word_distance"] <= 1
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert set(range(60)) <= kept and not kept & {100, 101, 102, 103, 104, 105, 200, 201}


def test_quality_without_language_takes_the_nearest(spark):
    docs = frame(spark, quality_rows())
    references = quality_rules.learn_references(docs)
    got = quality_rules.judge(docs.withColumn("lang", F.lit(None).cast("string")), references).collect()
    assert {r["doc_id"] for r in got if r["kept"]} >= set(range(60))


def test_references_count_all_documents(spark):
    rows = quality_rows()
    reference = quality_rules.learn_references(frame(spark, rows).repartition(5))["en"]
    words = Counter(w for r in rows for w in WORD.findall(r[1].translate(LOWER)))
    total = sum(words.values())
    often = sorted((n / total for n in words.values() if n >= quality_rules.COMMON_SHARE * total), reverse=True)
    assert np.allclose(sorted(reference.words[:-1], reverse=True), often)


def test_quality_of_nothing(spark):
    assert quality_rules.judge(frame(spark, [])).collect() == []
    (row,) = quality_rules.judge(frame(spark, [(1, None, None, None, None)])).collect()
    assert row["base_failed"] and not row["kept"]


def test_distance_is_symmetric_and_bounded():
    p, q = np.array([[0.5, 0.5, 0.0]]), np.array([0.0, 0.0, 1.0])
    assert quality_rules.js_distance(p, q)[0] == pytest.approx(1) and quality_rules.js_distance(p, p[0])[0] == 0


# ---- co-training ---------------------------------------------------------------------


def test_co_training_on_held_out_documents(spark):
    rows = [(i, t, x, f"s{i % 5}", len(t)) for i, t, x, _, _ in quality_rows() if i < 60]
    rows += [(1000 + i, prose(100, 3000 + i).upper().replace(" ", "!! "), "en", f"s{i % 5}", 9) for i in range(60)]
    labels = [(r[0], int(r[0] < 1000), 0) for r in rows if r[0] % 2] + [(3, 1, 0), (5, None, 0), (None, 1, 0)]
    label_table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = frame(spark, rows, extra=["score", "y"])
    model = cotrain.learn(docs, label_table)
    got = cotrain.score(docs, model).collect()
    assert len(got) == 120 and all(r["kept"] == (r["doc_id"] < 1000) for r in got)
    assert all(0 <= r[c] <= 1 for r in got for c in ("text_score", "meta_score", "score"))
    odd = cotrain.score(frame(spark, odd_documents()), model).collect()
    assert len(odd) == len(odd_documents())


def test_no_labels_no_verdict(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = frame(spark, odd_documents())
    assert cotrain.learn(docs, labels) is None
    assert {r["score"] for r in cotrain.score(docs, None).collect()} == {0.5}
    assert cotrain.score(frame(spark, []), None).collect() == []


def test_pool_examples_pass_between_views():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400)
    text, meta = (np.c_[y * 2 - 1 + rng.normal(0, s, 400), rng.normal(size=400)].astype(np.float32) for s in (0.4, 0.4))
    given = np.where(np.arange(400) < 60, y, -1)
    model = cotrain.co_train(text, meta, given, np.arange(400) % 4 == 1)
    assert np.mean((model.scores(text, meta)[2] >= 0.5) == y) > 0.97


def test_every_sure_example_is_handed_over():
    # Five documents of a kind that only its metadata show; 1,200 others of each class are surer.
    y = np.r_[np.arange(400) % 2, np.full(2405, -1)]
    truth = np.r_[np.arange(400) % 2, np.arange(2400) % 2, np.ones(5, int)]
    text = np.c_[truth * 2.0 - 1, np.zeros(len(y))].astype(np.float32) * 3
    text[-5:] *= 0.8
    meta = np.c_[np.where(np.arange(len(y)) % 5, truth * 2.0 - 1, 0), np.zeros(len(y))].astype(np.float32)
    meta[-5:] = [0, 1]
    model = cotrain.co_train(text, meta, y, np.arange(len(y)) % 4 == 1)
    assert model.meta[1] > 0.001


def test_all_unlabelled_documents_are_scored(spark):
    rows = [(i if i % 9 else None, f"w{i} of many", "en", "s", 10) for i in range(3500)] + [(1, "w1 of many", "en", "s", 10)] * 2
    sure = [[np.r_[np.zeros(w, np.float32), np.float32(9)]] for w in (cotrain.TEXT_WIDTH, cotrain.META_WIDTH)]
    sums = cotrain._given(frame(spark, rows), tuple(sure))
    assert [s[:, -1].tolist() for s in sums] == [[0, 3502], [0, 3502]]
    asked = []
    given = cotrain._given
    cotrain._given = lambda free, history: asked.append(free.count()) or given(free, history)
    try:
        cotrain.learn(frame(spark, rows), spark.createDataFrame([(i, i % 2) for i in range(1, 9)], "doc_id long, quality int"))
    finally:
        cotrain._given = given
    assert asked == [3492] * cotrain.ROUNDS  # all but eight ids and two repeats of one of them


# ---- mixing --------------------------------------------------------------------------


def brute_targets(sizes, weights=(1, 2, 3)):
    """Share by weight, take the excess off full sources, share it again, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in names if s not in full)
        target = {s: 3.0 * sizes[s] if s in full else left * weight[s] / open_weight for s in names}
        above = {s for s in names if s not in full and target[s] > 3 * sizes[s]}
        if not above:
            return target
        full |= above


@pytest.mark.parametrize("bin_rows", [mixing.BIN_ROWS, 10])
def test_mix_meets_targets(spark, monkeypatch, bin_rows):
    monkeypatch.setattr(mixing, "BIN_ROWS", bin_rows)
    shares = ["hot"] * 10 + ["a", "b", "c", None, "Z", "é"] + ["small"] * 0
    rows = [(i, prose(i % 37, i), "en", shares[i % len(shares)], 1) for i in range(900)]
    rows += [(5000, "few words", "en", "small", 1), (5000, "few words", "en", "small", 1), (None, None, None, "none", None)]
    docs = frame(spark, rows, extra=["Position", "_x_bin", "rows", "_start"])
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    target = brute_targets(sizes)
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        assert r["size"] == len(WORD.findall(r["text"] or "")) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]]) and r["taken"] <= 3 * r["size"]
        assert r["taken"] == r["size"] * len(r["positions"]) and r["_x_bin"] == "own _x_bin"
        assert all(0 <= p < 1 for p in r["positions"]) and r["positions"] == sorted(r["positions"])
        taken[r["source"]] += r["taken"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= 37 / 2 + 1
    again = mixing.mix(docs.repartition(7)).collect()
    assert Counter((r["doc_id"], r["taken"]) for r in got) == Counter((r["doc_id"], r["taken"]) for r in again)


def test_curriculum_is_sorted_and_tilted(spark):
    rows = [(i, prose(20, i), "en", "abc"[i % 3], i) for i in range(600)]
    docs = frame(spark, rows, extra=["position", "size"])
    out = mixing.curriculum(docs)
    assert out.columns == docs.columns
    placed = {r["doc_id"]: r["positions"] for r in mixing.mix(frame(spark, rows)).collect()}
    got = [r["doc_id"] for r in out.collect()]
    want = sorted((p, i) for i, ps in placed.items() for p in ps)
    assert got == [i for _, i in want]
    early = [np.mean([p < 0.5 for i, ps in placed.items() for p in ps if i % 3 == s]) for s in range(3)]
    assert early[0] > 0.55 and abs(early[1] - 0.5) < 0.06 and early[2] < 0.45


def test_inverse_demand(spark):
    for tilt in (-0.5, 0.0, 0.8):
        shares = [0.0, 0.1, 0.5, 0.9, 1.0]
        df = spark.createDataFrame([(s, tilt) for s in shares], "s double, a double")
        for r in df.select("s", mixing._inverse_demand(F.col("s"), F.col("a")).alias("t")).collect():
            assert (1 + tilt) * r["t"] - tilt * r["t"] ** 2 == pytest.approx(r["s"])


def test_mix_of_nothing(spark):
    assert mixing.mix(frame(spark, [])).collect() == [] and mixing.curriculum(frame(spark, [])).collect() == []


def test_number_letters_are_no_letters():
    assert not any(map(langid.has_letter, ["", "½ ²", "Ⅳ ⅷ", "12 _ ٣"]))
    assert all(map(langid.has_letter, ["a", "½ x", "日", "_é", "ªⅣ"]))
