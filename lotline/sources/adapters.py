"""Domain-shaped views derived from the driver's tables.

The test data is TPC-H-like; the operators need unit results, test
sessions, packed test durations, catalogue snapshots and so on. Each view
here is a pure projection of one driver table (narrow, no shuffle), so it
scales with the table and Catalyst prunes the columns it does not use.

The column expressions are plain SQL that both Spark and DuckDB accept;
the oracle SQL builds the same views from the same text, so the two
engines compare like with like. Nulls, duplicates and odd values are put
in on purpose (every driver column is non-null).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lotline.sources.tables import read_table

_LOT = "CAST(floor(l_orderkey / 25) AS BIGINT)"
_SLOT = "CAST(floor(event_id / 40) AS BIGINT)"

# view name -> (driver table, [column expressions])
VIEWS: dict[str, tuple[str, list[str]]] = {
    # Warehouse-style unit results: one row per unit test, with unit-level
    # and substructure-level bins and flags (input of the unit extract).
    "unit_results_raw": ("lineitem", [
        "CASE WHEN l_suppkey % 89 = 0 THEN NULL ELSE 'V' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) END AS visual_id",
        "CASE WHEN l_returnflag = 'R' THEN 'U1.U1' ELSE 'U1.U2' END AS substructure_id",
        f"CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE 'L' || lpad(CAST({_LOT} AS STRING), 5, '0') END AS lot",
        "CASE WHEN l_linenumber <= 4 THEN '6248' ELSE '7820' END AS operation",
        "'F' || CAST(l_suppkey % 3 AS STRING) AS facility",
        "'8PXA' || l_returnflag || l_linestatus || 'B' || CAST(l_linenumber % 2 AS STRING) AS devrevstep",
        "'P' || CAST(l_suppkey % 4 AS STRING) AS program_name",
        "CASE l_linenumber % 5 WHEN 1 THEN 'CLASSHOT' WHEN 2 THEN 'CLASSCOLD' WHEN 3 THEN 'PHMHOT' WHEN 4 THEN 'PHMCOLD' END AS process_step",
        "CASE WHEN l_partkey % 101 = 0 THEN NULL WHEN l_quantity < 35 THEN '100' ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS unit_functional_bin",
        "CASE WHEN l_tax = 0 THEN NULL WHEN l_quantity < 30 THEN '100' ELSE CAST(CAST(l_quantity AS INT) + 200 AS STRING) END AS substructure_functional_bin",
        "CASE WHEN l_quantity < 35 THEN '1' ELSE CAST(l_linenumber + 10 AS STRING) END AS unit_interface_bin",
        "CASE WHEN l_tax = 0 THEN NULL WHEN l_quantity < 38 THEN '1' ELSE CAST(l_linenumber + 20 AS STRING) END AS substructure_interface_bin",
        "CAST(l_linenumber AS STRING) AS unit_data_bin",
        "CASE WHEN l_tax = 0 THEN NULL ELSE CAST(l_linenumber + 50 AS STRING) END AS substructure_data_bin",
        "CASE WHEN l_quantity < 35 THEN 'G' ELSE 'B' END AS unit_good_bad_flag",
        "CASE WHEN l_tax = 0 THEN NULL WHEN l_quantity < 30 THEN 'G' ELSE 'B' END AS substructure_good_bad_flag",
        "CASE WHEN l_suppkey % 5 = 0 THEN 'N' ELSE 'Y' END AS unit_subflow_latest_flag",
        "CASE WHEN l_suppkey % 7 = 0 THEN NULL WHEN l_suppkey % 5 = 0 THEN 'N' ELSE 'Y' END AS substructure_subflow_latest_flag",
        "CASE WHEN l_suppkey % 7 = 0 AND l_linenumber = 7 THEN 'X' WHEN l_suppkey % 11 = 0 THEN 'N' ELSE 'Y' END AS lato_latest_flag",
        "l_shipdate AS test_end_date",
        "CASE WHEN l_suppkey % 23 = 0 THEN NULL ELSE l_suppkey % 40 + 60 END AS total_tested",
        "CASE WHEN l_suppkey % 23 = 0 THEN NULL ELSE l_suppkey % 40 + 50 END AS total_good",
        "CASE WHEN l_suppkey % 23 = 0 THEN NULL ELSE 10 END AS total_bad",
        "CASE WHEN l_linenumber = 5 THEN NULL ELSE 'A' || CAST(100 + l_linenumber AS STRING) END AS unit_tester_site_id",
        "CASE WHEN l_suppkey % 29 = 0 THEN NULL ELSE 'HDMT' || CAST(l_suppkey % 6 AS STRING) END AS unit_tester_id",
        "CASE WHEN l_partkey % 2 = 0 THEN NULL ELSE 'TIU' || CAST(l_partkey % 9 AS STRING) END AS tester_interface_unit_id",
        "CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_linenumber * 10 - 25 END AS lots_temperature",
        # latest flags of the operation: nulls and other values, which the extract leaves out
        "CASE WHEN l_partkey % 6 = 0 THEN NULL WHEN l_partkey % 31 = 0 THEN 'X' WHEN l_suppkey % 3 = 0 THEN 'N' ELSE 'Y' END AS operation_subflow_latest_flag",
        "CASE WHEN l_partkey % 12 = 0 THEN NULL WHEN l_partkey % 37 = 0 THEN '' ELSE 'Y' END AS operation_final_latest_flag",
    ]),
    # Test sessions for lot performance: one row per unit test in a lot.
    "test_sessions": ("events", [
        f"'K' || lpad(CAST({_SLOT} AS STRING), 5, '0') AS lot",
        "CASE WHEN event_type = 'signup' AND user_id % 10 = 0 THEN NULL ELSE 'W' || CAST(CAST(floor(event_id / 2) AS BIGINT) AS STRING) END AS visual_id",
        # keys that must stay text: long ids apart by one, and one that looks like a typed number
        f"CASE WHEN {_SLOT} % 11 = 5 THEN '9007199254740993' WHEN {_SLOT} % 11 = 7 THEN '9007199254740992'"
        f" WHEN {_SLOT} % 13 = 6 THEN '1D' WHEN {_SLOT} % 13 = 7 THEN '1'"
        f" WHEN {_SLOT} % 4 = 0 THEN '7820' ELSE '6248' END AS operation",
        f"'F' || CAST({_SLOT} % 3 AS STRING) AS facility",
        "CASE event_id % 8 WHEN 0 THEN 'SPH' WHEN 1 THEN 'CLASSHOT' WHEN 2 THEN 'CLASSCOLD' WHEN 3 THEN 'SCS'"
        " WHEN 4 THEN 'PHMHOT' WHEN 5 THEN 'scs' WHEN 6 THEN 'PHMCOLD' END AS sub_flow_step",
        "'Q' || CAST(user_id % 2 AS STRING) AS s_spec",
        f"'PG' || CAST({_SLOT} % 5 AS STRING) AS prodgroup3",
        "'PRG' || CAST(user_id % 2 AS STRING) AS program_name",
        "CASE WHEN user_id % 17 = 0 THEN NULL ELSE '8PXA' || CASE WHEN user_id % 3 = 0 THEN 'AF' ELSE 'NO' END || 'B0' END AS devrevstep",
        "CASE WHEN event_type = 'error' THEN 'B' ELSE 'G' END AS goodbad_flag",
        "CASE WHEN event_id % 2 = 0 AND event_type IN ('error', 'view') THEN 'N' ELSE 'Y' END AS within_lao_sfs_latest_flag",
        "CAST(event_id % 4 + 1 AS INT) AS within_session_sequence_number",
        "value AS test_time",
        "ts AS test_end_date",
    ]),
    # Per-test durations as the tester prints them (packed text).
    "test_durations": ("lineitem", [
        "CASE WHEN l_suppkey % 83 = 0 THEN NULL ELSE 'V' || CAST(l_partkey AS STRING) END AS visual_id",
        "CASE WHEN l_linenumber <= 4 THEN '6248' ELSE '7820' END AS operation",
        "'8PXA' || l_returnflag || l_linestatus || 'B0' AS devrevstep",
        "CASE WHEN l_orderkey % 53 = 0 THEN NULL"
        " WHEN l_orderkey % 2 = 1 THEN 'TPX' || CAST(l_suppkey % 3 AS STRING) || 'A0B1CH' || CAST(l_suppkey % 2 AS STRING)"
        " ELSE 'TPX' || CAST(l_suppkey % 3 AS STRING) || 'A0B1CE' || CAST(l_suppkey % 2 AS STRING) END AS program_name",
        "CAST(l_partkey % 4 AS STRING) AS dlcp",
        "'T' || CAST(l_suppkey % 20 AS STRING) AS test_name",
        "CASE WHEN l_suppkey % 11 = 0 THEN 'PRE_' || CAST(CAST(l_quantity AS INT) AS STRING) || 'MS_MAIN_1.00MS_ET_1.00MS'"
        " WHEN l_suppkey % 13 = 0 THEN 'PRE_1.25MS_MAIN_2.50MS'"
        " WHEN l_suppkey % 17 = 0 THEN NULL"
        " ELSE 'log:PRE_' || CAST(CAST(l_quantity AS INT) AS STRING) || '.25MS_MAIN_' || CAST(l_partkey % 1000 AS STRING)"
        " || '.50MS_ET_' || CAST(l_linenumber AS STRING) || '.00MS;end' END AS test_result",
        f"'L' || lpad(CAST({_LOT} AS STRING), 5, '0') AS lot",
        "CASE WHEN l_quantity < 40 THEN '100' ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS functional_bin",
    ]),
    # Request sheets: 50 requests per sheet, source lots interleaved, some
    # blank or missing cells.
    "requests": ("customer", [
        "c_custkey AS ordinal",
        "CAST(floor(c_custkey / 50) AS BIGINT) AS sheet",
        "CASE WHEN c_custkey % 29 = 0 THEN NULL WHEN c_custkey % 31 = 0 THEN '  '"
        " ELSE 'SL' || CAST(c_nationkey % 6 AS STRING) END AS source_lot",
        "c_mktsegment AS part_type",
        "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(c_custkey % 4 + 1 AS STRING) END AS quantity",
        "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(6248 + c_nationkey % 3 AS STRING) END AS operation",
        "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'E' || CAST(c_custkey % 13 AS STRING) END AS eng_id",
        "'MIR' || CAST(c_custkey AS STRING) AS mir",
        "CASE WHEN c_acctbal > 5000 THEN 'HRI' END AS hri",
    ]),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, exprs = VIEWS[name]
    return read_table(spark, sf_dir, table).selectExpr(*exprs)


def view_sql(name: str) -> str:
    """The same view as a DuckDB common table expression."""
    table, exprs = VIEWS[name]
    return f"{name} AS (SELECT {', '.join(exprs)} FROM {table})"


def unit_results_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "unit_results_raw")


def test_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "test_sessions")


def test_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "test_durations")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "requests")


# Catalogue snapshots (old, new) from orders: the new one loses the
# pending orders, changes the package of urgent ones, repeats the low-priority
# finished ones and gains renamed models for high-priority open ones.
_SNAP_COLS = [
    "'PRG' || CAST(o_custkey % 50 AS STRING) AS program_name",
    "{model} AS model_name",
    "o_orderstatus AS ccb",
    "{package} AS package",
    "'D' || CAST(o_custkey % 7 AS STRING) AS device",
    "'R' || CAST(o_orderkey % 3 AS STRING) AS revision",
    "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE 'S' || CAST(o_orderkey % 4 AS STRING) END AS stepping",
    "CASE WHEN o_custkey % 19 = 0 THEN NULL ELSE 'DIE' || CAST(o_custkey % 11 AS STRING) END AS die_code_name",
    "'T' || CAST(o_orderkey % 9 AS STRING) AS test_name",
]
_MODEL = "'M' || CAST(o_orderkey AS STRING)"
SNAPSHOT_SQL = {
    "snap_old": [c.format(model=_MODEL, package="o_orderpriority") for c in _SNAP_COLS],
    "snap_new": [c.format(model=_MODEL,
                          package="CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderpriority || '-X' ELSE o_orderpriority END")
                 for c in _SNAP_COLS],
    "snap_new_models": [c.format(model="'M' || CAST(o_orderkey AS STRING) || 'B'", package="o_orderpriority")
                        for c in _SNAP_COLS],
}
SNAP_NEW_KEEP = "o_orderstatus <> 'P'"
SNAP_NEW_REPEAT = "o_orderstatus = 'F' AND o_orderpriority = '5-LOW'"
SNAP_NEW_MODELS = "o_orderstatus = 'O' AND o_orderpriority = '2-HIGH'"


def snapshot_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "orders").selectExpr(*SNAPSHOT_SQL["snap_old"])


def snapshot_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan: each order gives its row, its repeat and its renamed model as far as it has them."""
    rows = [f"CASE WHEN {cond} THEN named_struct({', '.join(_field(c) for c in SNAPSHOT_SQL[name])}) END"
            for cond, name in ((SNAP_NEW_KEEP, "snap_new"), (SNAP_NEW_REPEAT, "snap_new"), (SNAP_NEW_MODELS, "snap_new_models"))]
    picked = f"filter(array({', '.join(rows)}), x -> x IS NOT NULL)"
    return read_table(spark, sf_dir, "orders").selectExpr(f"inline({picked})")


def _field(column: str) -> str:
    """``expr AS name`` as a struct field."""
    expr, _, name = column.rpartition(" AS ")
    return f"'{name}', {expr}"


def snapshot_sql() -> str:
    """DuckDB CTEs ``snap_old`` and ``snap_new``."""
    old = ", ".join(SNAPSHOT_SQL["snap_old"])
    new = ", ".join(SNAPSHOT_SQL["snap_new"])
    models = ", ".join(SNAPSHOT_SQL["snap_new_models"])
    return (f"snap_old AS (SELECT {old} FROM orders), "
            f"snap_new AS (SELECT {new} FROM orders WHERE {SNAP_NEW_KEEP} "
            f"UNION ALL SELECT {new} FROM orders WHERE {SNAP_NEW_REPEAT} "
            f"UNION ALL SELECT {models} FROM orders WHERE {SNAP_NEW_MODELS})")
