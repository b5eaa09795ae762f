"""Delimited sheets with a header each.

Every file has its own encoding, separator and header: one row of facts per file holds
them, with the place of each wanted column, so files of one folder may order and spell
their columns differently. Records may hold quoted line breaks: the lines with an odd
number of quotes are numbered over the splits of a file (a prefix sum of their counts),
and each pair of them opens and closes a record, wherever the splits cut. Rows that do not
fit are not dropped: they come beside the good ones with file, line and reason.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotline.functions.guards import require
from lotline.sources.files import SEPARATORS, allows, charsets, first_line, landed_lines, separator

#: Lines of a file that one window numbers.
CHUNK = 50_000
#: Columns beside those of the sheet.
FACTS = ("source_file", "line", "status", "reason", "record", "read_at")


def _lines(raw: DataFrame) -> DataFrame:
    """(file, line, _raw): lines with their number (from 0) in the file, from the counts of its earlier splits."""
    splits = raw.groupBy("file", "_blk").agg(F.count("*").alias("_n"), F.min("_mid").alias("_m0"))
    earlier = F.sum("_n").over(Window.partitionBy("file").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("file", "_blk", (F.coalesce(earlier, F.lit(0)) - F.col("_m0")).alias("_shift"))
    return raw.join(splits, ["file", "_blk"]).select("file", (F.col("_mid") + F.col("_shift")).alias("line"), "_raw")


def _odd(line: Column) -> Column:
    return (F.octet_length(line) - F.octet_length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 1


def _spans(lines: DataFrame) -> DataFrame:
    """(file, line, open): the lines of records that span several, with the record's first line;
    ``open`` is -1 for a line whose quote nothing closes. Only lines with an odd number of quotes
    are numbered, chunk by chunk with the counts of earlier chunks."""
    odd = lines.filter(_odd(F.col("_raw"))).select("file", "line", F.expr(f"line div {CHUNK}").alias("_c"))
    counts = odd.groupBy("file", "_c").agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy("file").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("file", "_c", F.coalesce(earlier, F.lit(0)).alias("_before"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("file", "_c").orderBy("line")) - 1
    pairs = odd.join(counts, ["file", "_c"]).withColumn("_pair", F.floor(place / 2)).groupBy("file", "_pair").agg(
        F.min("line").alias("open"), F.max("line").alias("close"), F.count("*").alias("_n"))
    return pairs.select("file", F.when(F.col("_n") == 2, F.col("open")).otherwise(-1).alias("open"), F.explode(F.sequence("open", "close")).alias("line"))


def records(raw: DataFrame) -> DataFrame:
    """(file, line, record, unclosed): records, those over several lines put together with line feeds."""
    lines = _lines(raw)
    spans = _spans(lines)
    alone = lines.join(spans, ["file", "line"], "left_anti").select("file", "line", F.col("_raw").alias("record"), F.lit(False).alias("unclosed"))
    held = lines.join(spans, ["file", "line"])
    whole = held.filter("open >= 0").groupBy("file", "open").agg(F.array_sort(F.collect_list(F.struct("line", "_raw"))).alias("_l"))
    return (alone.unionByName(whole.select("file", F.col("open").alias("line"), F.array_join("_l._raw", "\n").alias("record"), F.lit(False).alias("unclosed")))
            .unionByName(held.filter("open < 0").select("file", "line", F.col("_raw").alias("record"), F.lit(True).alias("unclosed"))))


def _patterns(sep: str) -> dict[str, str]:
    """Patterns for a separator: one cell after it, a whole record that begins with one, and the
    separator itself. A cell is quoted whole (quotes doubled inside) or does not begin with a quote."""
    s = "\\" + sep if sep == "|" else sep
    cell = rf'"[^"]*+(?:""[^"]*+)*+"|(?!")[^{s}]*+'
    return {"cell": f"{s}({cell})(?={s}|\\z)", "whole": f"\\A(?:{s}(?:{cell}))*+\\z", "split": s}


def _patterns_of(sep: Column, seps: Sequence[str]) -> dict[str, Column]:
    """The same as columns: a file's patterns are facts of it, so a row's expressions stay small."""
    return {f"_{kind}": F.coalesce(*[F.when(sep == s, F.lit(_patterns(s)[kind])) for s in seps]) for kind in ("cell", "whole", "split")}


def _cells(text: Column) -> Column:
    """The cells of a record, quotes taken off, by the columns of its file's patterns."""
    quoted = F.transform(F.regexp_extract_all(F.concat("_sep", text), F.col("_cell"), F.lit(1)),
                         lambda c: F.when(F.startswith(c, F.lit('"')), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))
    return F.when(F.contains(text, F.lit('"')), quoted).otherwise(F.split(text, F.col("_split")))


def _computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that later expressions use many times: through a generator, over
    which the optimizer doesn't copy them into each of those uses."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _decoded(column: str, chain: Sequence[str]) -> Column:
    text = F.coalesce(*[F.when(F.col("_enc") == e, F.col(column) if e == "UTF-8" else F.decode(F.col(column).cast("binary"), e)) for e in chain])
    return F.regexp_replace(text, "^﻿", "")


def header_facts(raw: DataFrame, names: Mapping[str, Sequence[str]], required: Sequence[str], chain: Sequence[str], sep: str | None) -> DataFrame:
    """One row per file: encoding, separator and its patterns, number of columns, and ``_at_*``, the
    place (from 0) of each wanted column: the first of the header whose trimmed upper-case name is one of its
    aliases. A file without a required column, or whose header has an open quote, fails the job."""
    facts = raw.groupBy("file").agg(first_line().alias("_first"), *[F.every(allows(e)).alias(f"_ok{i}") for i, e in enumerate(chain)])
    facts = facts.select("file", F.col("_first.line").alias("_raw"), F.coalesce(*[F.when(F.col(f"_ok{i}"), F.lit(e)) for i, e in enumerate(chain)], F.lit(chain[-1])).alias("_enc"))
    bare = F.regexp_replace(F.col("_raw"), '"[^"]*"', "")
    facts = _computed(facts, _sep=F.lit(sep) if sep is not None else separator(bare, SEPARATORS), _head=_decoded("_raw", chain))
    facts = _computed(facts, **_patterns_of(F.col("_sep"), (sep,) if sep is not None else SEPARATORS))
    facts = _computed(facts, _names=F.transform(_cells(F.col("_head")), lambda c: F.upper(F.trim(c))))

    def place(aliases: Sequence[str]) -> Column:
        return F.array_min(F.array(*[F.nullif(F.array_position("_names", a.strip().upper()), F.lit(0)) for a in aliases])) - 1
    facts = _computed(facts, **{f"_at_{c}": place(a).cast("int") for c, a in names.items()})
    missing = F.concat_ws(", ", *[F.when(F.col(f"_at_{c}").isNull(), F.lit(c)) for c in required])
    facts = require(facts, (missing == "") & ~_odd(F.col("_raw")),
                    F.concat(F.lit("missing columns ["), missing, F.lit("] in "), F.col("file"), F.lit("; header: "), F.col("_head")))
    return facts.select("file", "_enc", "_sep", "_cell", "_whole", "_split", F.size("_names").alias("_columns"), *[f"_at_{c}" for c in names])


def read_sheets(spark: SparkSession, path, schema: T.StructType, aliases: Mapping[str, Sequence[str]] | None = None,
                required: Sequence[str] | None = None, sep: str | None = None, fallbacks: Sequence[str] = ("GBK", "ISO-8859-1")) -> DataFrame:
    """Every record of the delimited files under ``path``: the columns of ``schema`` by name and FACTS.

    ``aliases``: header names of each column (default: its own name); ``required``: columns that
    every file must have (default: all); others are null where a file lacks them. ``sep=None``:
    taken per file from its header. Empty cells are null, blank lines are skipped, unknown columns
    are ignored. ``status`` is 'ok' or 'rejected'; ``reason``: unclosed quote, misplaced quote,
    short row, long row, or bad <column> (a cell that its type does not take); ``line``: the record's
    first line in the file (the header is 0); ``record``: its text where rejected. An empty file,
    or one with a header only, gives no rows.
    """
    names = {f.name: list((aliases or {}).get(f.name, [f.name])) for f in schema.fields}
    raw = landed_lines(spark, path)
    chain = charsets(spark, fallbacks)
    facts = header_facts(raw, names, list(names) if required is None else required, chain, sep)
    rows = _computed(records(raw).filter("line > 0").join(facts, "file"), _text=_decoded("record", chain)).filter(F.trim("_text") != "")
    rows = _computed(rows, _cells=_cells(F.col("_text")))
    misplaced = F.contains("_text", F.lit('"')) & ~F.rlike(F.concat("_sep", "_text"), F.col("_whole"))
    cells = {f.name: F.nullif(F.get("_cells", F.col(f"_at_{f.name}")), F.lit("")) for f in schema.fields}
    values = {f.name: cells[f.name].try_cast(f.dataType) for f in schema.fields}
    reason = F.coalesce(
        F.when(F.col("unclosed"), "unclosed quote"), F.when(misplaced, "misplaced quote"),
        F.when(F.size("_cells") < F.col("_columns"), "short row"), F.when(F.size("_cells") > F.col("_columns"), "long row"),
        *[F.when(cells[f.name].isNotNull() & values[f.name].isNull(), f"bad {f.name}") for f in schema.fields])
    rows = _computed(rows, _reason=reason)
    ok = F.col("_reason").isNull()
    return rows.select(*[F.when(ok, v).alias(c) for c, v in values.items()], F.col("file").alias("source_file"), "line",
                       F.when(ok, "ok").otherwise("rejected").alias("status"), F.col("_reason").alias("reason"),
                       F.when(~ok, F.col("_text")).alias("record"), F.current_timestamp().alias("read_at"))


def good_rows(rows: DataFrame) -> DataFrame:
    """The sheet's columns of the rows read; a rejected row fails the job with its place and reason."""
    checked = require(rows, F.col("status") == "ok", F.concat_ws(" ", F.lit("rejected row in"), "source_file", F.lit("line"), F.col("line").cast("string"), "reason"))
    return checked.drop(*[c for c in FACTS if c != "source_file"])


def read_any(spark: SparkSession, path: str, schema: T.StructType | None = None,
             aliases: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Reader chosen by extension (.csv with its separator taken from each file,
    .tsv/.txt tab-separated, .json one document a file, .jsonl one a line, .parquet). Delimited files are read by their headers
    (``aliases``: header names of each column) and must have no row that does not fit.
    Spreadsheets are not read: land them as CSV or Parquet."""
    low = path.lower()
    if low.endswith((".csv", ".tsv", ".txt")):
        if schema is None:
            raise ValueError("give a schema for delimited files")
        return good_rows(read_sheets(spark, path, schema, aliases, sep=None if low.endswith(".csv") else "\t"))
    if low.endswith((".json", ".jsonl")):
        r = spark.read.option("multiLine", low.endswith(".json"))
        return (r.schema(schema) if schema is not None else r).json(path)
    if low.endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError(f"unsupported file type: {path} (xls/xlsx: export to CSV or Parquet first)")
