"""Program-style texts derived from the driver's tables.

Each source row becomes a fixed number of text lines (a test block, a
limits block, a pin group, a resource entry); a fixed number of rows share
one file, so files stay small while their count grows with the table.
Files are assembled as whole texts and read back through the line reader
(S4), exactly as files on disk would be.

The line templates are plain SQL that both Spark and DuckDB accept; the
oracle builds the same lines from the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotline.sources.documents import LIMIT_DOC_EXPRS
from lotline.sources.tables import read_table
from lotline.sources.text import lines_from_text

_K = "CAST(p_partkey AS STRING)"
_C = "CAST(c_custkey AS STRING)"
# the configuration name the limits documents use for the same part
_CFG = LIMIT_DOC_EXPRS["name"]
_S = "CAST(s_suppkey AS STRING)"


def _floor(x: str, n: int) -> str:
    return f"CAST(floor({x} / {n}) AS BIGINT)"


# limit values: five quoted / unquoted numbers built from the customer key
_V = "lpad(CAST((c_custkey * 37 + {j} * 11) % 1000 AS STRING), 3, '0')"
_HV = ["'0.' || " + _V.format(j=j) for j in range(5)]
_LV = ["'-0.' || " + _V.format(j=j + 5) for j in range(5)]


def _quoted(vals: list[str]) -> str:
    return " || ', ' || ".join(f"'\"' || {v} || '\"'" for v in vals)


def _plain(vals: list[str]) -> str:
    return " || ', ' || ".join(vals)


_FMT = {
    "H": _quoted(_HV), "H12": _quoted(_HV[:2]), "H345": _quoted(_HV[2:]), "HU": _plain(_HV),
    "L": _quoted(_LV), "LU": _plain(_LV),
}


# name -> (table, rows per file, file expression, [line expressions per row])
TEMPLATES: dict[str, tuple[str, int, str, list[str]]] = {
    # Test blocks: wanted heads (two leakage methods), commented heads,
    # indented heads, other methods; fields missing, commented, or spread
    # over several lines; rule-call and quoted configurations.
    "instance_program": ("part", 64, f"'prog_' || lpad(CAST({_floor('p_partkey', 64)} AS STRING), 5, '0') || '.mtpl'", [
        f"CASE WHEN p_partkey % 10 = 3 THEN '# Test PrimeDcLeakageTestMethod CMT_' || {_K}"
        f" WHEN p_partkey % 10 = 7 THEN '    Test PrimeDcLeakageTestMethod IND_' || {_K}"
        f" WHEN p_partkey % 10 = 9 THEN 'Test PrimeFunctionalTestMethod FUNC_' || {_K}"
        f" WHEN p_partkey % 4 = 1 THEN 'Test TraceAnalyticsDcLeakage TRC_' || {_K}"
        f" ELSE 'Test PrimeDcLeakageTestMethod LKG_' || {_K} END",
        "'{'",
        "CASE WHEN p_partkey % 13 = 0 THEN '    LogLevel = \"Disabled\";'"
        " ELSE '    TestType = \"' || CASE WHEN p_size % 3 = 0 THEN 'VCC' ELSE 'VSS' END || '\";' END",
        "'    ConfigurationFile = \"cfg/' || lower(p_type) || '.json\";'",
        f"CASE WHEN p_partkey % 6 = 0 THEN '    # Configuration = \"OLD_' || {_K} || '\";'"
        " ELSE '    LevelsTc = \"' || upper(replace(p_name, ' ', '_')) || '_lvl\";' END",
        f"CASE p_partkey % 3 WHEN 0 THEN '    Configuration = Mod_Rules.Temp(\"' || {_CFG} || '\", \"C_' || {_K}"
        f" || '\", \"P_' || {_K} || '\", \"A_' || {_K} || '\");'"
        f" WHEN 1 THEN '    Configuration = \"' || {_CFG} || '\";'"
        " ELSE '    Configuration =' END",
        f"CASE WHEN p_partkey % 3 = 2 THEN '        Mod_Rules.Temp(\"' || {_CFG} || '\", \"C_' || {_K} || '\",'"
        " ELSE '    LogLevel = \"Enabled\";' END",
        f"CASE WHEN p_partkey % 3 = 2 THEN '            \"P_' || {_K} || '\", \"A_' || {_K} || '\");' ELSE '' END",
        "CASE WHEN p_partkey % 8 = 5 THEN ''"
        " ELSE '    BypassPort = ' || CASE WHEN p_partkey % 3 = 1 THEN '1' ELSE '-1' END || ';' END",
        "'}'",
        "''",
        f"'// end ' || {_K}",
    ]),
    # Limit blocks: heads (commented, indented, indented-commented), six
    # spellings of the high/low limit pair, commented pairs, _FF tests and
    # repeated test names (the later block wins).
    "limits_program": ("customer", 50, f"'shops_' || lpad(CAST({_floor('c_custkey', 50)} AS STRING), 5, '0') || '.mtpl'", [
        "CASE WHEN c_custkey % 13 = 0 THEN '#Test iCShopsTest ' WHEN c_custkey % 17 = 0 THEN '  # Test iCShopsTest '"
        " WHEN c_custkey % 19 = 0 THEN '   Test iCShopsTest ' ELSE 'Test iCShopsTest ' END"
        " || CASE (c_custkey % 700) % 3 WHEN 0 THEN 'UPPERDIODE' WHEN 1 THEN 'LOWERDIODE' ELSE 'OTHERTEST' END"
        " || '_T' || CAST(c_custkey % 700 AS STRING) || CASE WHEN c_custkey % 11 = 0 THEN '_FF' ELSE '' END",
        "'{'",
        "CASE WHEN c_custkey % 7 = 0 THEN '#   upper_diode_limit_high = Old_Rules.Pick(\"9\", \"9\", \"9\", \"9\", \"9\");'"
        " ELSE '' END",
        "CASE c_custkey % 5"
        f" WHEN 0 THEN '    upper_diode_limit_high = TPI_SHOPS_Rules.Selector_UPPERDIODE_limit_high_EVG(' || {_FMT['H']} || ');'"
        f" WHEN 1 THEN '    lower_diode_limit_high = Other_Rules.Pick(' || {_FMT['H12']} || ','"
        " WHEN 2 THEN '    ThermalMode = \"' || c_mktsegment || '\";'"
        f" WHEN 3 THEN '    lower_diode_limit_high(' || {_FMT['H']} || ')'"
        f" ELSE '    upper_diode_limit_high(' || {_FMT['HU']} || ')' END",
        f"CASE c_custkey % 5 WHEN 1 THEN '        ' || {_FMT['H345']} || ');' ELSE '' END",
        "CASE c_custkey % 5"
        f" WHEN 0 THEN '    lower_diode_limit_low = TPI_SHOPS_Rules.Selector_LOWERDIODE_limit_low_EVG(' || {_FMT['L']} || ');'"
        f" WHEN 1 THEN '    lower_diode_limit_low = Other_Rules.Pick(' || {_FMT['L']} || ');'"
        f" WHEN 2 THEN '    upper_diode_limit_low = Func(' || {_FMT['LU']} || ');'"
        f" WHEN 3 THEN '    lower_diode_limit_low(' || {_FMT['L']} || ')'"
        f" ELSE '    upper_diode_limit_low(' || {_FMT['LU']} || ')' END",
        "'}'",
        f"'// customer ' || {_C}",
    ]),
    # Pin groups: one group per supplier (names repeat across suppliers),
    # pins with ';', ',', nothing or a __SUFFIX, commented and lower-case
    # pins, and groups that are never closed.
    "pin_program": ("supplier", 40,
                    f"CASE {_floor('s_suppkey', 40)} % 3 WHEN 0 THEN 'pins_IP_CPU_' WHEN 1 THEN 'pins_IP_CD_' ELSE 'pins_' END"
                    f" || lpad(CAST({_floor('s_suppkey', 40)} AS STRING), 4, '0') || '.txt'", [
        "'Group LANE_' || CAST(s_nationkey AS STRING)",
        "'{'",
        f"CASE WHEN s_suppkey % 9 = 0 THEN '    #PIN_' || {_S} || ';' WHEN s_suppkey % 11 = 0 THEN '    pin_' || {_S}"
        f" ELSE '    PIN_' || {_S} || CASE s_suppkey % 4 WHEN 0 THEN ';' WHEN 1 THEN ',' WHEN 2 THEN '' ELSE '__X;' END END",
        f"'    PIN_' || {_S} || 'B;'",
        "CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE '}' END",
        f"'// supplier ' || {_S}",
    ]),
    # Resource sections: a header every ten customers (so the first lines
    # of a file belong to no resource), pins with plain, bracketed,
    # negative, zero, large, non-numeric and tie-rounding values.
    "resource_program": ("customer", 100, f"'soc_' || lpad(CAST({_floor('c_custkey', 100)} AS STRING), 4, '0') || '.txt'", [
        f"CASE WHEN c_custkey % 10 = 3 THEN 'Resource RES_' || CAST({_floor('c_custkey', 10)} AS STRING)"
        f" ELSE '# customer ' || {_C} END",
        f"'    IP_PIN' || {_C} || ' ' || CASE c_custkey % 8"
        " WHEN 0 THEN CAST(c_custkey % 97 AS STRING) || '.' || CAST(c_custkey % 7 AS STRING)"
        f" WHEN 1 THEN '[' || {_C} || ']0.' || lpad(CAST(c_custkey % 1000 AS STRING), 3, '0')"
        " WHEN 2 THEN '-' || CAST(c_custkey % 50 AS STRING) || '.25'"
        " WHEN 3 THEN '0'"
        " WHEN 4 THEN CAST(100 + c_custkey % 5 AS STRING)"
        f" WHEN 5 THEN 'V' || {_C}"
        " WHEN 6 THEN '1:2'"
        " ELSE '0.0025' END || ';'",
        f"CASE WHEN c_custkey % 5 = 0 THEN '  IP_AUX' || {_C} || ' 0.' || CAST(c_custkey % 9 AS STRING) || ';'"
        " ELSE '' END",
        f"'// customer ' || {_C}",
    ]),
    # Lot lists: one id per line with surrounding blanks, '#' lines, blank
    # lines and repeated ids (orders of one customer share a lot).
    "lot_list": ("orders", 200, f"'lots_' || lpad(CAST({_floor('o_orderkey', 200)} AS STRING), 5, '0') || '.txt'", [
        "CASE WHEN o_orderkey % 9 = 0 THEN '# ' WHEN o_orderkey % 11 = 0 THEN '' ELSE '  ' END"
        f" || CASE WHEN o_orderkey % 11 = 0 AND o_orderkey % 9 <> 0 THEN ''"
        f" ELSE 'L' || lpad(CAST({_floor('o_custkey', 3)} AS STRING), 5, '0') || ' ' END",
        "CASE WHEN o_orderkey % 4 = 0 THEN '#note ' || CAST(o_orderkey AS STRING) ELSE '' END",
    ]),
}

_KEYS = {"part": "p_partkey", "customer": "c_custkey", "supplier": "s_suppkey", "orders": "o_orderkey"}

def template_lines(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """(file, line_no, line) straight from the template (no text round trip)."""
    table, per_file, file_expr, exprs = TEMPLATES[name]
    key = _KEYS[table]
    df = read_table(spark, sf_dir, table).selectExpr(f"{file_expr} AS file", f"{key} % {per_file} AS _slot",
                                                     f"array({', '.join(exprs)}) AS _lines")
    width = len(exprs)
    return df.select("file", (F.col("_slot") * width).alias("_base"), F.posexplode("_lines").alias("_pos", "line")) \
             .select("file", (F.col("_base") + F.col("_pos")).cast("int").alias("line_no"), "line")


#: Lines, about, that one task puts together.
TASK_LINES = 100_000


def program_texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """(file, text): whole files assembled in line order (bounded per file). Source rows are dealt by
    file over a number of tasks that follows their count, before they become lines, and a row's lines
    are gathered as one array, so a task's memory does not grow with the table."""
    table, per_file, file_expr, exprs = TEMPLATES[name]
    width = len(exprs)
    rows = read_table(spark, sf_dir, table)
    tasks = max(1, -(-rows.count() * width // TASK_LINES))
    dealt = rows.selectExpr("*", f"{file_expr} AS file").repartition(tasks, "file")
    blocks = dealt.selectExpr("file", f"{_KEYS[table]} % {per_file} AS _slot", f"array({', '.join(exprs)}) AS _lines")
    held = F.transform(F.collect_list(F.struct("_slot", "_lines")), lambda row: F.transform(
        row["_lines"], lambda line, pos: F.struct((row["_slot"] * width + pos).cast("int").alias("line_no"), line.alias("line"))))
    ordered = F.array_sort(F.flatten(held))
    return blocks.groupBy("file").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def program_lines(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """S4 over the assembled files: (file, line_no, line)."""
    return lines_from_text(program_texts(spark, sf_dir, name))


def template_sql(name: str) -> str:
    """DuckDB CTE ``<name>_lines(file, line_no, line)`` with line numbers
    renumbered from 0 per file, as the line reader numbers them."""
    table, per_file, file_expr, exprs = TEMPLATES[name]
    key = _KEYS[table]
    width = len(exprs)
    parts = [f"SELECT {file_expr} AS file, ({key} % {per_file}) * {width} + {i} AS raw_no, {e} AS line FROM {table}"
             for i, e in enumerate(exprs)]
    union = " UNION ALL ".join(parts)
    return (f"{name}_lines AS (SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY raw_no) - 1 AS INTEGER)"
            f" AS line_no, line FROM ({union}))")
