"""File-source queries: request sheets landed as delimited files and read back by their
headers (S1, S2, P1, P2, K5)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotline.session import checkpoint_dir
from lotline.sinks.writers import write_status
from lotline.sources import adapters
from lotline.sources.sheets import read_any, read_sheets
from lotline.sources.tables import read_table

# Header names as the sheets spell them, and the aliases
# that map them to canonical names (first matching column wins).
FILE_HEADERS = {
    "ordinal": "Row", "sheet": "Sheet", "source_lot": "Source Lot", "part_type": "Part Type",
    "quantity": "Quantity", "operation": "OPERATION", "eng_id": "EngID", "mir": "MIR", "hri": "HRI / MRV",
}
ALIASES = {
    "ordinal": ["ROW"], "sheet": ["SHEET"],
    "source_lot": ["SOURCELOT", "SOURCE LOT", "SOURCE_LOT", "SOURCELOTS", "SOURCE LOTS"],
    "part_type": ["PART TYPE", "PARTTYPE"], "quantity": ["QUANTITY", "QTY"],
    "operation": ["OPERATION", "OP", "LOCATION CODE"], "eng_id": ["ENGID", "ENG ID"], "mir": ["MIR"],
    "hri": ["HRI / MRV", "HRI"],
}
SCHEMA = T.StructType([T.StructField(c, T.LongType() if c in ("ordinal", "sheet") else T.StringType()) for c in FILE_HEADERS])

# Three layouts of a sheet, by its number: separator, encoding, columns in order with their header. The
# second spells them otherwise, the third has a column that nothing asks for and one name twice.
LAYOUTS = {
    0: (",", "UTF-8", list(FILE_HEADERS.items())),
    1: (";", "ISO-8859-1", [("mir", "MIR"), ("quantity", " Qty "), ("part_type", "PartType"), ("source_lot", "source_lot"), ("sheet", "SHEET"),
                            ("ordinal", "row"), ("operation", "Op"), ("eng_id", "Eng ID"), ("hri", "HRI")]),
    2: ("|", "UTF-8", [("hri", "HRI / MRV"), ("operation", "Location Code"), ("remark", "Remark"), ("ordinal", "ROW"), ("source_lot", "Source Lots"),
                       ("remark", "SourceLot"), ("eng_id", "engid"), ("part_type", "Part Type"), ("sheet", "Sheet"), ("quantity", "QUANTITY"), ("mir", "Mir")]),
}


def quoted(expr: str) -> str:
    """A cell in quotes, for the SQL of both engines."""
    return f"'\"' || replace({expr}, '\"', '\"\"') || '\"'"


def line_sql(part_type: str, more: dict[str, str] | None = None) -> str:
    """A sheet's line in its layout; ``part_type`` is the SQL of that cell, ``more`` that of others."""
    cells = {"part_type": part_type, "remark": "'r'", **(more or {})}
    kinds = []
    for kind, (sep, _, columns) in LAYOUTS.items():
        row = f" || '{sep}' || ".join(cells.get(c, f"COALESCE(CAST({c} AS STRING), '')") for c, _ in columns)
        kinds.append(f"WHEN {kind} THEN {row}")
    return f"CASE sheet % {len(LAYOUTS)} {' '.join(kinds)} END"


def header_sql() -> str:
    return f"CASE sheet % {len(LAYOUTS)} " + " ".join(f"WHEN {k} THEN '{s.join(h for _, h in cols)}'" for k, (s, _, cols) in LAYOUTS.items()) + " END"


#: Requests, about, whose sheets one task lands: a file costs more than its rows, so tasks follow
#: the requests and not their bytes.
TASK_REQUESTS = 5_000


def land(spark: SparkSession, sf_dir: str, line: str) -> str:
    """The request sheets as one file each, in the sheet's layout, in a fresh folder, which is returned."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/requests-{uuid.uuid4().hex}"
    req = adapters.requests(spark, sf_dir)
    heads = req.select("sheet").distinct().selectExpr("sheet", "-1L AS ordinal", f"{header_sql()} AS line")
    rows = req.selectExpr("sheet", "ordinal", f"{line} AS line").unionByName(heads)
    coded = F.col("line")
    for kind, (_, encoding, _) in LAYOUTS.items():
        if encoding != "UTF-8":
            coded = F.when(F.col("sheet") % len(LAYOUTS) == kind, F.encode("line", encoding).cast("string")).otherwise(coded)
    tasks = max(1, -(-req.count() // TASK_REQUESTS))
    (rows.repartition(tasks, "sheet").sortWithinPartitions("sheet", "ordinal").select("sheet", coded.alias("value"))
     .write.partitionBy("sheet").text(root))
    return root


PLAIN = line_sql("part_type || 'é'")
#: A cell with line breaks, quotes and every separator.
BROKEN_CELL = "part_type || chr(10) || '\"x\", é;|' || chr(10) || COALESCE(hri, '')"
BROKEN = line_sql(quoted(BROKEN_CELL))
#: Sheets with rows that do not fit: short, long, ill-typed, a quote inside, a quote left open in the last row of a sheet.
DAMAGED = f"""CASE WHEN ordinal % 10 = 1 THEN '1' WHEN ordinal % 10 = 2 THEN {PLAIN} || CASE sheet % 3 WHEN 0 THEN ',' WHEN 1 THEN ';' ELSE '|' END || 'more'
WHEN ordinal % 10 = 3 THEN {line_sql("part_type", {"quantity": "'many'"})}
WHEN ordinal % 10 = 4 THEN {line_sql("part_type", {"mir": quoted("mir") + " || 'x'"})}
WHEN ordinal % 50 = 49 THEN {line_sql("part_type", {"mir": "'\"' || mir"})} ELSE {PLAIN} END"""
TYPED = T.StructType([T.StructField(f.name, T.IntegerType() if f.name == "quantity" else f.dataType) for f in SCHEMA.fields])


def q_request_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land the request sheets as CSV files (even sheets UTF-8 with commas, odd
    sheets Latin-1 with semicolons; part types carry an accented letter) in a
    fresh folder under the shared folder, then read them back: reader chosen by
    extension (S2), encoding and separator chosen per file (S1), headers
    mapped to canonical names by aliases (P2), required columns checked (P1)."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/requests-{uuid.uuid4().hex}"
    req = adapters.requests(spark, sf_dir).withColumn("part_type", F.concat(F.col("part_type"), F.lit("é")))
    out = req.select(*[F.col(c).alias(h) for c, h in FILE_HEADERS.items()])
    for parity, enc, sep in ((0, "UTF-8", ","), (1, "ISO-8859-1", ";")):
        (out.filter(F.col("Sheet") % 2 == parity).write.option("header", True).option("encoding", enc).option("sep", sep)
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
            .csv(f"{root}/{enc.lower()}"))
    return read_any(spark, f"{root}/*/*.csv", SCHEMA, ALIASES).drop("source_file")


def q_sheet_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets of three layouts in one folder, each mapped by its own header."""
    out = read_sheets(spark, land(spark, sf_dir, PLAIN), SCHEMA, ALIASES)
    return out.select(*ALIASES, "line", "status")


def q_sheet_line_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with line breaks, quotes and separators inside quoted cells."""
    return read_sheets(spark, land(spark, sf_dir, BROKEN), SCHEMA, ALIASES).select(*ALIASES, "line", "status")


def q_sheet_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: sheets with rows that do not fit: good and rejected rows go out side by side in one
    pass, and both are read back."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/sheets-{uuid.uuid4().hex}"
    write_status(read_sheets(spark, land(spark, sf_dir, DAMAGED), TYPED, ALIASES), path)
    back = spark.read.parquet(path).filter("read_at <= current_timestamp()")
    return back.select(*ALIASES, "line", "status", "reason", "record",
                       F.regexp_extract("source_file", r"/sheet=(\d+)/", 1).cast("long").alias("file_sheet"))


def q_table_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers as .csv, .tsv, .jsonl and .parquet files, each read by its extension."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/forms-{uuid.uuid4().hex}"
    rows = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    writers = {"csv": rows.write.option("header", True).format("csv"), "tsv": rows.write.option("header", True).option("sep", "\t").format("csv"),
               "jsonl": rows.write.format("json"), "parquet": rows.write.format("parquet")}
    out = None
    for form, writer in writers.items():
        writer.save(f"{root}/rows.{form}")
        part = read_any(spark, f"{root}/rows.{form}", rows.schema).select(*rows.columns, F.lit(form).alias("form"))
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = {
    "request_files": q_request_files, "sheet_layouts": q_sheet_layouts, "sheet_line_breaks": q_sheet_line_breaks,
    "sheet_rejects": q_sheet_rejects, "table_forms": q_table_forms,
}
