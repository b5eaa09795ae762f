from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from lotline.operators import diff
from tests.conftest import rows


def test_anti_join_semantics(spark):
    new = spark.createDataFrame([("a", None), ("a", None), ("b", "x"), ("b", "x"), ("c", "y")], "k string, v string")
    old = spark.createDataFrame([("a", None), ("b", "x"), ("d", "z"), ("d", "z")], "k string, v string")
    # null equals null; any copy on the other side removes all copies; left-only copies all kept
    assert rows(diff.rows_not_in(new, old, ["k", "v"])) == [("c", "y")]
    assert rows(diff.rows_not_in(old, new, ["k", "v"])) == [("d", "z"), ("d", "z")]


def test_counts_keep_null_groups(spark):
    new = spark.createDataFrame([("x", None, 1), ("x", None, 2), ("z", "3", 1)], "a string, b string, c int")
    old = spark.createDataFrame([("y", "1", 1), ("z", "3", 1)], "a string, b string, c int")
    cols = ["a", "b", "c"]
    assert rows(diff.diff_counts(new, old, ["a", "b"], columns=cols)) == [("Added", "x", None, 2), ("Removed", "y", "1", 1)]
    assert rows(diff.diff_counts(new, old, ["a", "b"], dropna=True, columns=cols)) == [("Removed", "y", "1", 1)]


def test_hot_row(spark):
    new = spark.range(5_000_000).selectExpr("'hot' AS k", "CAST(NULL AS STRING) AS v")
    old = spark.createDataFrame([("cold", "x")], "k string, v string")
    log = diff.change_log(new, old, ["k", "v"])
    assert {(r.modify_flag, r.k): r["count"] for r in log.groupBy("modify_flag", "k").count().collect()} == {
        ("Added", "hot"): 5_000_000, ("Removed", "cold"): 1}
    assert rows(diff.diff_counts(new, old, ["k"], columns=["k", "v"])) == [("Added", "hot", 5_000_000), ("Removed", "cold", 1)]


def test_one_exchange_no_join(spark):
    df = spark.createDataFrame([("a", "b")], "k string, v string")
    plan = diff.change_log(df, df, ["k", "v"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


@settings(max_examples=6, deadline=None)
@given(st.lists(st.sampled_from(["p", "q", "r", None]), max_size=8),
       st.lists(st.sampled_from(["p", "q", "s", None]), max_size=8))
def test_added_removed_swap(spark, a, b):
    A = spark.createDataFrame([(x,) for x in a], "k string")
    B = spark.createDataFrame([(x,) for x in b], "k string")
    log_ab = rows(diff.change_log(A, B, ["k"]))
    log_ba = rows(diff.change_log(B, A, ["k"]))
    swap = {"Added": "Removed", "Removed": "Added"}
    assert sorted(log_ab, key=str) == sorted([(swap[f], k) for f, k in log_ba], key=str)
