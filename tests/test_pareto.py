from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from lotline.operators import pareto
from tests.conftest import rows

SCHEMA = ("visual_id string, devrevstep string, process_step string, functional_bin string, "
          "interface_bin string, subflow_latest_flag string, substructure_id string, lot string")


def units(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_distinct_units_and_totals(spark):
    df = units(spark, [
        ("u1", "D1", "S", "100", "1", "Y", "U1.U2", "L1"),
        ("u1", "D1", "S", "100", "1", "Y", "U1.U2", "L1"),   # repeated unit in one bin counts once
        ("u2", "D1", "S", "7", "3", "Y", "U1.U2", "L1"),
        ("u2", "D1", "S", "100", "1", "Y", "U1.U2", "L1"),   # unit in two bins counts in both
        ("u3", "D2", "S", "7", "3", "Y", "U1.U2", "L1"),
        ("u4", "D2", "S", "7", "3", "N", "U1.U2", "L1"),     # retest slice
        ("u5", "D2", "S", "7", "3", "Y", "U1.U1", "L1"),     # other substructure: nowhere
    ])
    out = pareto.bin_pareto(df).filter("slice = 'main' AND bin_kind = 'functional'")
    got = {(r.bin, r.devrevstep, r.row_kind): (r.quantity, r.percentage) for r in out.collect()}
    assert got[("100", "D1", "cell")] == (2, round(2 / 3, 6))
    assert got[("7", "D1", "cell")][0] == 1
    assert got[("7", "D2", "cell")] == (1, 1.0)
    assert got[("7", None, "bin_total")] == (2, 0.5)
    assert got[("100", None, "bin_total")] == (2, 0.5)
    assert got[(None, "D1", "step_total")] == (3, 1.0)
    assert got[(None, None, "grand_total")] == (4, 1.0)
    retest = pareto.bin_pareto(df).filter("slice = 'retest' AND bin_kind = 'functional' AND row_kind = 'grand_total'")
    assert rows(retest, "quantity") == [(1,)]


def test_null_fill_and_severity(spark):
    df = units(spark, [
        ("u1", None, None, None, "1", "Y", "U1.U2", "L1"),
        *[(f"p{i}", "D", "S", "100", "1", "Y", "U1.U2", "L1") for i in range(47)],
        ("r1", "D", "S", "9", "5", "Y", "U1.U2", "L1"),          # 1/50 = 0.02 -> yellow (inclusive)
        ("r2", "D", "S", "8", "5", "Y", "U1.U2", "L1"),
        ("r3", "D", "S", "8", "5", "Y", "U1.U2", "L1"),          # 2/50 = 0.04 -> yellow
    ])
    out = pareto.bin_pareto(df).filter("slice = 'main' AND bin_kind = 'functional'")
    cells = {(r.bin, r.devrevstep, r.process_step, r.row_kind): r.severity for r in out.collect()}
    assert cells[("UNKNOWN", "UNKNOWN", "UNKNOWN", "cell")] == "red"  # nulls filled; alone in its step
    assert cells[("100", "D", "S", "cell")] == "green"                  # pass bin always green
    assert cells[("9", "D", "S", "cell")] == "yellow"
    assert cells[("8", "D", "S", "cell")] == "yellow"
    assert cells[(None, None, "S", "grand_total")] is None
    assert cells[(None, "D", "S", "step_total")] is None


def test_severity_boundaries(spark):
    from pyspark.sql import functions as F

    from lotline.functions.classify import severity
    df = spark.createDataFrame([(0.02,), (0.05,), (0.0500001,), (0.0199,)], "p double")
    out = df.select("p", severity(F.col("p"), F.lit("7"), F.lit("functional"), F.lit(False)).alias("s"))
    assert dict(out.collect()) == {0.02: "yellow", 0.05: "yellow", 0.0500001: "red", 0.0199: "green"}


def test_measure_sum_is_explicit(spark):
    df = units(spark, [("10", "D", "S", "7", "1", "Y", "U1.U2", "L"), ("5", "D", "S", "7", "1", "Y", "U1.U2", "L")])
    out = pareto.bin_pareto(df, bin_kinds={"functional": "functional_bin"}, measure="sum")
    assert rows(out.filter("slice='main' AND row_kind='cell'"), "quantity") == [(15.0,)]
    out = pareto.bin_pareto(df, bin_kinds={"functional": "functional_bin"})
    assert rows(out.filter("slice='main' AND row_kind='cell'"), "quantity") == [(2,)]


def test_exceptions_after_fill(spark):
    df = units(spark, [("u1", None, "S", None, "1", "Y", "U1.U2", None),
                       (None, "D", "S", "7", "1", "Y", "U1.U2", "L"),
                       ("u3", "D", "S", "7", "1", "Y", "U1.U2", "L")])
    assert len(pareto.unit_exceptions(df).collect()) == 2


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c", "d"]), st.sampled_from(["D1", "D2"]),
                          st.sampled_from(["100", "7", "8"])), min_size=1, max_size=25))
def test_shares_sum_to_one(spark, data):
    df = units(spark, [(u, d, "S", b, "1", "Y", "U1.U2", "L") for u, d, b in data])
    out = pareto.bin_pareto(df, bin_kinds={"functional": "functional_bin"}).filter("slice = 'main'")
    cells = [r for r in out.collect() if r.row_kind == "cell"]
    for dev in {r.devrevstep for r in cells}:
        assert abs(sum(r.percentage for r in cells if r.devrevstep == dev) - 1.0) < 1e-5
    totals = [r for r in out.collect() if r.row_kind == "bin_total"]
    assert abs(sum(r.percentage for r in totals) - 1.0) < 1e-5
