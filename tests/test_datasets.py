"""Readers, writers, serialisation, permutation invariants and plan texts."""

import json
import time

import pyarrow as pa
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from tablesteps.catalog import QUERIES
from tablesteps.functions.scoring import normalize_text
from tablesteps.operators import datasets as D
from tablesteps.plans import graph as G
from tablesteps.plans import text as X
from tablesteps.sources import readers as R
from tablesteps.sources import writers as W


def test_tagged_answers(spark, tmp_path):
    path = tmp_path / "a.tagged"
    path.write_text('id\tutterance\ttargetValue\ttargetCanon\nq1\t"x\ta\\pb|c\\nd\\\\\t1|2\n', encoding="utf8")
    row = R.read_targets(spark, str(path)).first()
    assert row["targetValue"] == ["a|b", "c\nd\\"] and row["targetCanon"] == ["1", "2"]


def test_corpus(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps([{"nt": "nt-1", "tbl": "t1", "sql": [["Keyword", "select", []], ["Column", "c1", []]]}], indent=1))
    assert tuple(R.read_corpus(spark, str(path)).select("nt", "tbl", "sql").first()) == ("nt-1", "t1", "select c1")


def test_files_by_extension(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x\n1,a\n")
    (tmp_path / "a.json").write_text('{"id": 1, "x": "a"}\n')
    for name in ("a.csv", "a.json"):
        assert tuple(R.load_file(spark, str(tmp_path / name), "id int, x string").first()) == (1, "a")
    with pytest.raises(ValueError):
        R.load_file(spark, str(tmp_path / "a.txt"), "id int")


def test_saved_forms(spark, tmp_path):
    df = spark.createDataFrame([(1, "train", "a\nb"), (2, "test", "c")], "id int, split string, p string")
    W.save_dataset(df, str(tmp_path / "d"))
    assert R.load_dataset(spark, str(tmp_path / "d"), "test").select("id").collect() == [(2,)]
    assert R.load_dataset(spark, str(tmp_path / "d")).count() == 2
    W.save_lines(df, "p", str(tmp_path / "l"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "l")).collect()) == ["a b", "c"]
    W.save_metrics(df, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 2


def test_lines_keep_their_order(spark, tmp_path):
    texts = [f"line {i}" if i % 5 else None if i % 2 else f"a\r\nb {i}" for i in range(2000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, p string").repartition(9)
    W.save_lines(df, "p", str(tmp_path / "l"), order=[F.col("id")], parts=5)
    got = {r["pos"]: r["value"] for r in R.read_lines(spark, str(tmp_path / "l")).collect()}
    assert [got[i] for i in range(2000)] == ["" if t is None else t.replace("\r\n", " ") for t in texts]
    parts = sorted((tmp_path / "l").glob("part-*"))
    assert len(parts) == 5 and "".join(p.read_text() for p in parts).split("\n")[0] == got[0]


def test_tables_saved_by_id_join_without_a_shuffle(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(5000)
        W.save_by_id(rows.select("id", F.lit("q").alias("question")), "saved_questions", str(tmp_path / "q"), 4)
        W.save_by_id(rows.select("id", (F.col("id") * 2).alias("place"), F.lit("f").alias("lf_p")), "saved_forms", str(tmp_path / "f"), 4)
        joined = D.attach(spark.table("saved_questions"), spark.table("saved_forms"), order=["place"])
        kept = D.keep_ids(spark.table("saved_questions"), spark.table("saved_forms"), "id")
        for df in (joined, kept):
            assert df.count() == 5000
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS saved_questions")
        spark.sql("DROP TABLE IF EXISTS saved_forms")


def test_long_text_is_wired_in_linear_time(spark):
    """A text of 100,000 tokens: a chain of selections, and a first token that is its own root."""
    n = 50_000
    text = "5 ||" + "and ||c1 ||" * n + "c1 ||"
    df = spark.createDataFrame([(1, text, ["c1"]), (2, "min ||c1 ||max ||c1 ||", ["c1"])], "query_id long, text string, header array<string>")
    start = time.time()
    got = X.edges_from_text(df).collect()
    assert time.time() - start < 60
    edges = sorted((r["edge"], int(r["child"][1:]), int(r["parent"][1:]), r["place"]) for r in got if r["query_id"] == 1)
    want = []
    for i in range(n):  # token 2i + 2 is the i-th ``and``; its second operand is the next one
        if i:
            want.append((2 * i + 2, 2 * i, 1))
        want.append((2 * i + 3, 2 * i + 2, 0))
    want.append((2 * n + 2, 2 * n, 1))
    assert edges == [(k, c, p, place) for k, (c, p, place) in enumerate(sorted(want))]
    assert sorted((r["child"], r["parent"], r["place"]) for r in got if r["query_id"] == 2) == [("n2", "n1", 0), ("n4", "n3", 0)]


def test_random_example_is_seeded(spark):
    rows = spark.range(100)
    assert D.random_example(rows, 7).collect() == D.random_example(rows, 7).collect()


def test_serialised_table_and_header(spark):
    rows = spark.range(5).select(F.lit("t").alias("k"), F.col("id").alias("pos"), F.col("id").alias("a"), F.lit("z").alias("b c"))
    parts = D.serialize(rows, ["k"], "pos", F.lit("who ?"), ["a", "b c"], size=2).orderBy("part").collect()
    text = "".join(p["text"] for p in parts)
    assert text == "who ? col : a | b c" + "".join(f" row {i + 1} : {i} | z" for i in range(5))
    assert spark.createDataFrame([(text,)], "t string").select(D.header_of(F.col("t")).alias("h")).first()["h"] == ["a", "b c"]


def test_budget_keeps_the_longest_prefix(spark):
    rows = spark.createDataFrame([("a", i, 3) for i in range(10)] + [("b", 0, 50)], "k string, pos bigint, n int")
    kept = D.prefix_budget(rows, ["k"], "pos", "n", F.lit(2), budget=12)
    assert sorted((r["k"], r["pos"]) for r in kept.collect()) == [("a", 0), ("a", 1), ("a", 2)]


def test_rows_that_cost_nothing_are_kept(spark):
    rows = spark.createDataFrame(
        [("a", i, 0) for i in range(4)] + [("b", 0, 1), ("b", 1, None), ("b", 2, 1), ("b", 3, 0), ("b", 4, 1), ("b", 5, 0)],
        "k string, pos bigint, n int",
    )
    kept = D.prefix_budget(rows, ["k"], "pos", "n", F.lit(0), budget=2)
    assert sorted((r["k"], r["pos"]) for r in kept.collect()) == [("a", i) for i in range(4)] + [("b", i) for i in range(4)]


def test_permutation_of_nested_cells(spark):
    rows = spark.range(30).select(F.lit("t").alias("k"), F.col("id").alias("pos"), F.array(F.col("id"), F.lit(None)).alias("a"))
    moved = D.permute(rows, ["k"], "pos", ["a"]).orderBy("pos").collect()
    assert sorted(r["a"][0] for r in moved) == list(range(30)) and [r["a"][0] for r in moved] != list(range(30))


def test_query_text_leaves_the_view_of_the_session(spark):
    from tablesteps.sources import readers

    spark.range(3).createOrReplaceTempView("w")
    out = readers.run_sql(spark.range(7), "SELECT count(*) AS n FROM w")
    assert out.first()["n"] == 7 and spark.table("w").count() == 3
    spark.catalog.dropTempView("w")
    assert readers.run_sql(spark.range(7), "SELECT * FROM w").count() == 7 and not spark.catalog.tableExists("w")


def test_permutation_moves_only_the_first_rows(spark):
    rows = spark.range(200).select(
        (F.col("id") % 2).alias("k"), F.floor(F.col("id") / 2).alias("pos"), F.col("id").alias("a"), (F.col("id") * 2).alias("b")
    )
    moved = D.permute(rows, ["k"], "pos", ["a", "b"], first=F.lit(80)).toPandas().sort_values(["k", "pos"])
    plain = rows.toPandas().sort_values(["k", "pos"])
    tail = (plain["pos"] >= 80).values
    for column in ("a", "b"):
        assert (moved[column].values[tail] == plain[column].values[tail]).all()
        for k in (0, 1):
            assert sorted(moved[moved["k"] == k][column]) == sorted(plain[plain["k"] == k][column])
        assert (moved[column].values != plain[column].values).sum() > 100
    # Columns move on their own, and the same table moves alike in every copy.
    assert (moved["b"].values != moved["a"].values * 2).any()
    copy = rows.withColumn("a", F.concat(F.lit("v"), "a"))
    again = D.permute(copy, ["k"], "pos", ["a", "b"], first=F.lit(80)).toPandas().sort_values(["k", "pos"])
    assert (again["a"].str[1:].astype(int).values == moved["a"].values).all()


def test_original_stays_when_the_answer_does(spark, tables):
    rows = QUERIES["permuted_or_original"](spark, SMALL).collect()
    moved = {(r["table_id"], r["pos"]): r["c_acctbal"] for r in D.permute(
        C_rows(tables), ["table_id"], "pos", ["c_acctbal"]).collect()}
    best = {}
    for r in C_rows(tables).collect():
        key = (r["table_id"], r["pos"])
        old, new = (r["c_acctbal"], r["pos"], r["c_name"]), (moved[key], r["pos"], r["c_name"])
        a, b = best.get(r["table_id"], (old, new))
        best[r["table_id"]] = max(a, old), max(b, new)
    for r in rows:
        before, after = best[r["table_id"]][0][2], best[r["table_id"]][1][2]
        changed = normalize_text(before) != normalize_text(after)
        assert (r["kept"], r["answer"]) == (("permuted", after) if changed else ("original", before))


def C_rows(tables):
    from tablesteps.catalog.corpus import _nation_rows

    return _nation_rows(tables).select("table_id", "pos", "c_name", "c_acctbal")


# ---- plans --------------------------------------------------------------------

NODES = [("n1", "S", "where"), ("n2", "P", "c1"), ("n3", "C", "= a"), ("n4", "P", "c2")]
EDGES = [("n2", "n1", 0), ("n3", "n1", 1), ("n4", "n3", 0)]


@pytest.fixture(scope="module")
def plan(spark):
    nodes = spark.createDataFrame([(1, *n, n[2] + "!") for n in NODES], "query_id bigint, node string, kind string, parameter string, result string")
    edges = spark.createDataFrame([(1, i, *e) for i, e in enumerate(EDGES)], "query_id bigint, edge int, child string, parent string, place int")
    return nodes, edges


@pytest.mark.parametrize("kinds, want, left", [
    (["P"], ["0", "last", "0", "last"], 4), (["P", "C"], ["0", "last", "last", "1"], 3), (["P", "C", "S"], ["last", "1", "1", "1"], 1),
])
def test_execution_status(plan, kinds, want, left):
    status = G.exec_status(*plan, {"x": kinds})
    assert [r["status"] for r in status.orderBy("node").collect()] == want
    assert G.residual(status).first()["tokens"] == left


def test_tokens_and_edges_of_a_text(spark):
    df = spark.createDataFrame([(1, "where ||c1 ||= a ||c2 ||", ["c1", "c2"])], "query_id bigint, text string, header array<string>")
    assert [(r["kind"], r["operands"]) for r in X.tokens(df).orderBy("pos").collect()] == [("S", 2), ("P", 0), ("C", 1), ("P", 0)]
    edges = {(r["child"], r["parent"], r["place"]) for r in X.edges_from_text(df).collect()}
    assert edges == set(EDGES)
    back = df.withColumn("text", F.lit("c2 ||= a ||c1 ||where ||"))
    assert {(r["child"], r["parent"], r["place"]) for r in X.edges_from_text(back, "postorder").collect()} == set(EDGES)


def test_texts_of_a_plan(plan):
    def text(*args, **kwargs):
        return X.to_text(*plan, *args, subsets={"x": ["P", "C"]}, **kwargs).first()["text"]

    assert text("preorder") == "where ||c1! ||= a! ||"
    assert text("postorder") == "= a! ||c1! ||where ||"
    assert text("preorder", alias="start") == "n2 c1! ||n3 = a! |||n1 where n2 n3 ||"
    assert text("preorder", alias="end") == "n1 where n2 n3 |||n2 c1! ||n3 = a! ||"
    assert X.to_text(*plan, "preorder", alias="end", subsets={"x": ["P", "C", "S"]}).first()["text"] == "where! ||"


def test_alias_text_round_trip(spark, plan):
    texts = X.to_text(*plan, "preorder", alias="end", subsets={"x": ["P"]})
    edges = {(r["child"], r["parent"], r["place"]) for r in X.edges_from_alias(texts).collect()}
    assert edges == set(EDGES)


def _tables(spark, nodes, edges):
    nodes = spark.createDataFrame([(q, n, "P", n, n + "!") for q, n in nodes], "query_id bigint, node string, kind string, parameter string, result string")
    edges = spark.createDataFrame([(q, i, *e) for i, (q, *e) in enumerate(edges)], "query_id bigint, edge int, child string, parent string, place int")
    return nodes, edges


def test_cycles_and_dangling_edges_are_reported(spark):
    nodes, edges = _tables(
        spark, [(1, "n1"), (1, "n2"), (1, "n3"), (2, "a"), (2, "b")],
        [(1, "n3", "n1", 0), (1, "n1", "n2", 0), (1, "n2", "n1", 1), (2, "a", None, 0), (2, "x", "b", 0), (2, "a", "b", 0), (3, "p", "q", 0)],
    )
    assert {tuple(r) for r in G.problems(nodes, edges).collect()} == {(1, "cycle", 2), (2, "dangling edge", 2), (3, "dangling edge", 1)}
    assert {tuple(r) for r in G.levels(nodes, edges).collect()} == {(1, "n3", 0), (1, "n1", None), (1, "n2", None), (2, "a", 0), (2, "b", 1)}
    assert {tuple(r)[1:] for r in G.descendants(edges).where("query_id = 1").collect()} == {
        (a, b) for a in ("n1", "n2") for b in ("n1", "n2", "n3")
    }
    texts = {r["query_id"]: r["text"] for r in X.to_text(nodes, edges, subsets={"x": []}).collect()}
    assert texts == {1: None, 2: "b ||a ||", 3: ""}


def test_a_deep_plan_and_a_ladder_of_shared_nodes(spark):
    chain = [(1, f"n{i:04d}") for i in range(3000)]
    ladder = [(2, f"{s}{i:02d}") for i in range(30) for s in "ab"]
    edges = [(1, b[1], a[1], 0) for a, b in zip(chain, chain[1:])]
    edges += [(2, f"{s}{i + 1:02d}", f"{r}{i:02d}", int(s == "b")) for i in range(29) for r in "ab" for s in "ab"]
    nodes, edges = _tables(spark, chain + ladder, edges)
    assert G.levels(nodes, edges).agg(F.max("level")).first()[0] == 2999
    texts = {r["query_id"]: r["text"] for r in X.to_text(nodes, edges, alias="end", subsets={"x": []}).collect()}
    assert texts[1].count("||") == 3000 and texts[2].count("||") == 60
    assert G.descendants(edges).where("query_id = 2").count() == sum(2 * 2 * (29 - i) for i in range(30))


def test_operands_beyond_ten_thousand_keep_their_order(spark):
    nodes, edges = _tables(
        spark, [(1, "top")] + [(1, f"c{i}") for i in range(10_050)], [(1, f"c{i}", "top", i) for i in range(10_050)]
    )
    text = X.to_text(nodes, edges, subsets={"x": []}).first()["text"]
    assert text == "top ||" + "".join(f"c{i} ||" for i in range(10_050))


def test_plans_wired_alike_are_walked_once():
    walked = []

    def rows(plan):
        walked.append(list(plan.nodes))
        return [("x", X._aliased(plan, plan.status(plan.masks(), ["P"]), True, True))]

    table = {"query_id": [], "_table": [], "_a": [], "_b": [], "_place": [], "_c": [], "_d": []}
    # Two leaves under a sum: their results are equal in every tenth plan, and the first one's is missing in the last plan.
    for q in range(100):
        left, right = None if q == 99 else f"r{q}", f"r{q}" if q % 10 == 0 else f"s{q}"
        lines = [(0, "a", "OP", None, f"+ {q}", "r"), (0, "b", "P", None, "c1", left), (0, "c", "P", None, "c2", right),
                 (1, "b", "a", 0, None, None), (1, "c", "a", 1, None, None)]
        for line in lines:
            for column, value in zip(table, (q, *line)):
                table[column].append(value)
    types = [pa.int64(), pa.int8(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    batch = pa.table({c: pa.array(v, t) for (c, v), t in zip(table.items(), types)})
    found = {}
    for ids, _, texts in G._Walks(rows, [pa.string(), pa.string()], True).fill(batch):
        found |= dict(zip(ids.to_pylist(), texts.to_pylist()))
    assert len(walked) == 3
    assert found[1] == "b r1 ||c s1 |||a + 1 b c ||" and found[10] == "b r10 |||a + 10 b b ||"
    assert found[99] == "b ||c s99 |||a + 99 b c ||" and len(found) == 100


def test_residuals_are_those_of_the_status(spark):
    nodes, edges = _tables(spark, [(1, "a"), (1, "b"), (2, "a")], [(1, "b", "a", 0), (3, "p", "q", 0)])
    want = {tuple(r) for r in G.residual(G.exec_status(nodes, edges)).select("query_id", "omega", "tokens").collect()}
    assert {tuple(r) for r in G.residuals(nodes, edges).collect()} == want


def test_a_plan_goes_on_over_batches(spark):
    nodes, edges = _tables(spark, [(q, n) for q in range(50) for n in "abc"], [(q, n, "a", i) for q in range(50) for i, n in enumerate("bc")])
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, 2)
    try:
        texts = {r["query_id"]: r["text"] for r in X.to_text(nodes, edges, subsets={"x": []}).collect()}
    finally:
        spark.conf.set(size, before)
    assert texts == dict.fromkeys(range(50), "a ||b ||c ||")


def test_texts_are_wired_without_a_shuffle(spark):
    texts = [(1, "c1 ||where ||c2 ||= a ||where ||c1 ||c2 ||c1 ||"), (2, None), (None, "where ||"), (4, ""), (5, "gb ||" * 70_000 + "c1 ||")]
    df = spark.createDataFrame(texts, "query_id long, text string").withColumn("header", F.array(F.lit("c1"), F.lit("c2")))
    found = X.edges_from_text(df)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    rows = found.orderBy("query_id", "edge").collect()
    # Two further roots: the first token, and the last one, as all places are filled by then.
    assert [tuple(r) for r in rows if r["query_id"] == 1] == [
        (1, 0, "n3", "n2", 0), (1, 1, "n4", "n2", 1), (1, 2, "n5", "n4", 0), (1, 3, "n6", "n5", 0), (1, 4, "n7", "n5", 1),
    ]
    deep = [tuple(r) for r in rows if r["query_id"] == 5]
    assert deep == [(5, i, f"n{i + 2}", f"n{i + 1}", 0) for i in range(70_000)] and len(rows) == len(deep) + 5
