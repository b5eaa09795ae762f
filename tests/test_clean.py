from __future__ import annotations

import pytest

from lotline.operators import clean
from lotline.sources.extracts import union_batches
from tests.conftest import rows


def test_require_columns(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert clean.require_columns(df, ["a"]) is df
    with pytest.raises(clean.MissingColumnsError):
        clean.require_columns(df, ["a", "c"])


def test_resolve_aliases_first_column_wins(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`Source Lot` int, SOURCELOT int, other int")
    out = clean.resolve_aliases(df, {"source_lot": ["SOURCELOT", "SOURCE LOT"]})
    assert out.columns == ["source_lot", "SOURCELOT", "other"]


def test_predicates(spark):
    df = spark.createDataFrame([("SCS", "TVMIN1"), ("scs", "X"), (None, "VMINX"), ("SPH", "Y")], "s string, t string")
    assert rows(clean.exclude_value_keep_nulls(df, "s", "SCS"), "s") == [(None,), ("SPH",)]
    assert rows(clean.optional_predicates(df, not_in={"s": ["SPH"]}), "s") == [("SCS",), ("scs",)]
    assert rows(clean.optional_predicates(df, like={"t": "%VMIN%"}), "t") == [("TVMIN1",), ("VMINX",)]
    assert rows(clean.optional_predicates(df, like_any={"t": ["X%", "Y%"]}), "t") == [("X",), ("Y",)]
    assert rows(clean.apply_filters(df, {"s": "SCS", "missing": 1}), "s") == [("SCS",)]


def test_union_batches(spark):
    a = spark.createDataFrame([(1, "x")], "k int, a string")
    b = spark.createDataFrame([(2, "y")], "k int, b string")
    assert rows(union_batches([a, b]), "k", "a", "b") == [(1, "x", None), (2, None, "y")]


def test_presentation_orders(spark):
    from lotline.operators import present
    df = spark.createDataFrame([("b", "t2", 1), ("a", "t9", 2), ("a", "t1", 3)], "category string, test_name string, v int")
    assert [r.test_name for r in present.limits_order(df).collect()] == ["t1", "t9", "t2"]
    m = spark.createDataFrame([("A", "x", 1), ("A", "y", 5), ("B", "x", 2)], "config_set string, execution_mode string, count long")
    assert [(r.config_set, r["count"]) for r in present.mode_order(m).collect()] == [("A", 5), ("A", 1), ("B", 2)]


def test_lot_order(spark):
    from lotline.operators import present
    df = spark.createDataFrame([("L2", "b"), ("L1", "z"), ("L1", "a")], "lot string, x string")
    assert [tuple(r) for r in present.lot_order(df).collect()] == [("L1", "a"), ("L1", "z"), ("L2", "b")]


def test_unit_extract_rules(spark):
    from lotline.sources.extracts import unit_results_extract
    cols = ("visual_id string, substructure_id string, lot string, operation string, facility string, "
            "devrevstep string, program_name string, process_step string, unit_functional_bin string, "
            "substructure_functional_bin string, unit_interface_bin string, substructure_interface_bin string, "
            "unit_data_bin string, substructure_data_bin string, unit_good_bad_flag string, "
            "substructure_good_bad_flag string, unit_subflow_latest_flag string, "
            "substructure_subflow_latest_flag string, lato_latest_flag string, test_end_date timestamp, "
            "total_tested int, total_good int, total_bad int, unit_tester_site_id string, unit_tester_id string, "
            "tester_interface_unit_id string, lots_temperature int, operation_subflow_latest_flag string, "
            "operation_final_latest_flag string")
    base = ["u1", "U1.U2", "L1", "6248", "F", "8PXAAFB1", "P", "CLASSHOT", "7", "9", "1", None, "d", None,
            "B", "G", "Y", None, None, None, 5, 4, 1, None, "T1", None, -5, None, "Y"]
    rows_ = [
        tuple(base),                                        # sub bins win, unit flag used, lato '' when null
        tuple(base),                                        # exact duplicate: DISTINCT
        tuple(base[:2] + ["L2"] + base[3:]),                # lot not requested
        tuple(base[:-2] + ["X", "Y"]),                      # operation flag not Y/N: dropped
        tuple(base[:-2] + [None, None]),                    # no operation flag: dropped
        tuple(base[:16] + [None, "N"] + base[18:]),         # substructure flag wins
        tuple(base[:16] + ["X", None] + base[18:]),         # the projected flag is not filtered
        tuple(base[:24] + ["T2"] + base[25:]),              # differs in the tester only: a row of its own
    ]
    raw = spark.createDataFrame(rows_, cols)
    lots = spark.createDataFrame([("L1",)], "lot string")
    out = unit_results_extract(raw, lots=lots).collect()
    got = sorted((r.functional_bin, r.interface_bin, r.good_bad_flag, r.subflow_latest_flag, r.lato_latest_flag,
                  r.bom, r.dlcp, r.stepping) for r in out)
    assert got == [("9", "1", "G", f, "", "8", "AF", "B1") for f in "NXYY"]
    assert {(r.unit_tester_id, r.unit_tester_site_id, r.total_tested, r.lots_temperature) for r in out} == {
        ("T1", "", "5", "-5"), ("T2", "", "5", "-5")}


def test_name_rules(spark):
    import pytest

    from lotline.operators import lotperf
    df = spark.createDataFrame([(1, 2, 3, 4, 5, 6)], "lot int, lot_type int, TTG int, ttg_target int, Yield int, `Sub Flow Step` int")
    assert clean.resolve_by_rule(df, lotperf.LAB_RULES) == {"LOT": "lot", "TTG": "TTG", "Yield": "Yield", "Sub Flow Step": "Sub Flow Step"}
    with pytest.raises(ValueError, match="both match"):
        clean.resolve_by_rule(spark.createDataFrame([(1, 2)], "facility int, facility_2 int"), lotperf.LAB_RULES)


def test_text_keys(spark):
    from lotline.functions.numbers import normalise_key, round_half_up, to_number
    df = spark.createDataFrame([("1D",), ("7f",), ("9007199254740993",), (" 6248.00 ",), ("6.50",), ("-3.0",)], "k string")
    assert [r[0] for r in df.select(normalise_key("k")).collect()] == ["1D", "7f", "9007199254740993", "6248", "6.50", "-3"]
    assert [r[0] for r in df.select(to_number("k")).collect()] == [None, None, 9007199254740992.0, 6248.0, 6.5, -3.0]
    big = spark.createDataFrame([(1e31,), (float("nan"),), (2.675,)], "v double")
    assert [r[0] for r in big.select(round_half_up("v", 2)).collect()] == [None, None, 2.68]
