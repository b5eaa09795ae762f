"""Line-oriented text sources.

A text file becomes ``(file, line_no, line)`` rows. Files are read in splits, and a line's
number is its place in its split plus the lines of the file's earlier splits, so line
order is explicit data and a large file is many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotline.functions.guards import require
from lotline.operators.segments import place


def lines_from_text(df: DataFrame, file_col: str = "file", text_col: str = "text") -> DataFrame:
    """S4 on a (file, text) table: one row per line, ``line_no`` from 0.
    Line breaks are \\n, \\r\\n or \\r; a final line break does not make an
    extra empty line (as ``str.splitlines``)."""
    body = F.regexp_replace(F.col(text_col), r"(\r\n|\r|\n)\z", "")
    parts = F.split(body, r"\r\n|\r|\n")
    return (df.select(F.col(file_col).alias("file"), F.posexplode(parts).alias("line_no", "line"))
              .select("file", F.col("line_no").cast("int").alias("line_no"), "line"))


def read_program_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files under ``path`` -> (file, line_no, line), for files of
    any size. Files are read in splits (a large file is many tasks); each
    line's number is its index inside its split plus the number of lines in
    the file's earlier splits (a prefix sum over the per-split counts, one
    small aggregate). Line breaks are \\n, \\r\\n or \\r, and a final
    line break adds no empty line (as ``str.splitlines``)."""
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_blk"),
        F.monotonically_increasing_id().alias("_mid"),
        F.col("value").alias("line"))
    splits = raw.groupBy("file", "_blk").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_blk")
                              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = splits.select("file", "_blk", "_m0", F.coalesce(before, F.lit(0)).alias("_off"))
    return (raw.join(offsets, ["file", "_blk"])
               .select("file", (F.col("_off") + F.col("_mid") - F.col("_m0")).cast("long").alias("line_no"), "line"))


def read_whole_files(spark: SparkSession, path: str) -> DataFrame:
    """S4 for small files: one task per file (``wholetext``) and split in
    memory; line numbers need no prefix sum."""
    whole = (spark.read.text(path, wholetext=True)
                  .select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text")))
    return lines_from_text(whole)


def read_lot_list(lines: DataFrame, id_col: str = "lot") -> DataFrame:
    """S5 (+ W9): ids one per line; blank lines and '#' lines skipped; white
    space stripped at both ends; the first occurrence per file kept, with its
    line as ``ordinal``. A list without any id fails the job, whatever is read of the result."""
    stripped = F.regexp_replace(F.col("line"), r"^\s+|\s+\z", "")
    is_id = (F.col(id_col) != "") & ~F.col(id_col).startswith("#")
    # both branches read this one grouping, so the lines are scanned and dealt once
    found = lines.select("file", "line_no", stripped.alias(id_col)).groupBy("file", id_col).agg(
        F.min(F.when(is_id, F.col("line_no"))).alias("ordinal"))
    counts = found.groupBy("file").agg(F.count("ordinal").alias("_n"))
    checked = require(counts, F.col("_n") > 0, F.concat(F.lit("no lot in "), F.col("file")))
    none = checked.filter("_n < 0").select("file", F.lit(None).cast("string").alias(id_col), F.lit(None).cast(lines.schema["line_no"].dataType).alias("ordinal"))
    return found.filter(F.col("ordinal").isNotNull()).unionByName(none)


def split_batches(ids: DataFrame, batch_size: int | None, order_col: str = "ordinal",
                  part_col: str = "file") -> DataFrame:
    """Consecutive batches of ``batch_size`` ids per list file, in list
    order; ``None`` or <= 0 puts the whole list in batch 0. Places are counted
    in chunks of lines, so one list may be many tasks."""
    if not batch_size or batch_size <= 0:
        return ids.withColumn("batch_id", F.lit(0))
    ranked = place(ids, [part_col], order_col, "_rank")
    return ranked.withColumn("batch_id", F.floor((F.col("_rank") - 1) / F.lit(batch_size)).cast("int")).drop("_rank")
