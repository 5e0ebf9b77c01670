"""Every registered query with a SQL form gives the same whole result in both engines."""

import pytest
from check import compare
from conftest import SMALL

from tablesteps.catalog import ORACLES, QUERIES

# Text normalisation and matching-block similarity are the only steps outside the JVM.
PYTHON_QUERIES = {
    "normalize_answer", "typed_value_set", "score_strict", "score_flexible", "score_fuzzy", "score_by_checkpoint",
    "best_checkpoint", "checkpoint_curve", "permuted_or_original", "render_nested_answer",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    df = QUERIES[name](spark, SMALL)
    physical = df._jdf.queryExecution().executedPlan().toString()
    assert ("EvalPython" in physical) == (name in PYTHON_QUERIES)
    assert "CartesianProduct" not in physical and "BroadcastNestedLoopJoin" not in physical
    if name in ORACLES:
        assert compare(df, duck, ORACLES[name])[0] == ""
    else:
        assert df.count() > 0


def test_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["query_id", "part", "answer"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
