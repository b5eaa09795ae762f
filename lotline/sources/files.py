"""File sources (S1, S10) and what their readers share.

Encoding and separator are chosen per file, on the executors: lines are read as
raw bytes, one aggregate per file says which encodings its bytes allow and what
its first line looks like, and these facts are joined back to the lines. No file
name and no row reaches the driver.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotline.session import ensure_checkpoint_dir

# Charsets that can be decoded without ``spark.sql.legacy.javaCharsets``.
_STANDARD_CHARSETS = {"UTF-8", "ISO-8859-1", "US-ASCII", "UTF-16", "UTF-16BE", "UTF-16LE", "UTF-32"}


def _charset_allowed(spark: SparkSession, enc: str) -> bool:
    return (enc.upper() in _STANDARD_CHARSETS
            or spark.conf.get("spark.sql.legacy.javaCharsets", "false").lower() == "true")


# Separators tried when a file's separator is not given.
SEPARATORS = (",", ";", "\t", "|")


def raw_lines(spark: SparkSession, path) -> DataFrame:
    """(file, _blk, _mid, _raw): undecoded lines; ``_mid`` grows with the line within a split."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_blk"),
        F.monotonically_increasing_id().alias("_mid"), F.col("value").alias("_raw"))


def landed_lines(spark: SparkSession, path) -> DataFrame:
    """The same, checkpointed, for readers that use the lines several times: the files, which may be
    many and small, are opened once."""
    ensure_checkpoint_dir(spark)
    return raw_lines(spark, path).checkpoint()


def first_line() -> Column:
    """Aggregate: the first line of a file, from its split at offset 0."""
    return F.min(F.when(F.col("_blk") == 0, F.struct(F.col("_mid").alias("mid"), F.col("_raw").alias("line"))))


def separator(line: Column, candidates: tuple[str, ...]) -> Column:
    counts = [F.size(F.split(line, "\\" + c if c in "|" else c)) - 1 for c in candidates]
    best = F.greatest(*counts) if len(counts) > 1 else counts[0]
    return F.coalesce(*[F.when((best > 0) & (n == best), F.lit(c)) for c, n in zip(candidates, counts, strict=True)], F.lit(","))


def allows(enc: str) -> Column:
    """Whether the bytes of ``_raw`` are text of an encoding."""
    if enc.upper() == "UTF-8":
        return F.is_valid_utf8("_raw")
    if enc.upper() == "GBK":  # whatever is left without its two-byte characters must be ASCII
        as_bytes = F.decode(F.col("_raw").cast("binary"), "ISO-8859-1")
        return ~F.regexp_replace(as_bytes, "[\u0081-\u00fe][\u0040-\u007e\u0080-\u00fe]", "").rlike("[\u0080-\u00ff]")
    return F.lit(True)


def charsets(spark: SparkSession, fallbacks: Sequence[str]) -> list[str]:
    """UTF-8 and the fallbacks that the session can decode."""
    return ["UTF-8", *[e for e in fallbacks if _charset_allowed(spark, e)]]


def read_delimited(spark: SparkSession, path, schema: T.StructType, sep: str | None = ",",
                   fallbacks: tuple[str, ...] = ("GBK", "ISO-8859-1"), header: bool = True) -> DataFrame:
    """S1 for plain files of one column order (others: ``sources.sheets``): delimited
    text (one row per line) with a per-file encoding: UTF-8,
    else the first fallback that the whole file's bytes allow (GBK only when
    the session allows legacy charsets; Latin-1 accepts any byte, so it is
    the last resort). A byte-order mark is dropped, blank lines are skipped,
    columns are taken by position. ``sep=None`` sniffs the separator per
    file. Adds ``source_file``."""
    raw = raw_lines(spark, path)
    chain = charsets(spark, fallbacks)
    facts = raw.groupBy("file").agg(first_line().alias("_first"), *[F.every(allows(e)).alias(f"_ok{i}") for i, e in enumerate(chain)])
    facts = facts.select("file", F.col("_first.mid").alias("_first_mid"),
                         F.coalesce(*[F.when(F.col(f"_ok{i}"), F.lit(e)) for i, e in enumerate(chain)], F.lit(chain[-1])).alias("_enc"),
                         (F.lit(sep) if sep is not None else separator(F.col("_first.line"), SEPARATORS)).alias("_sep"))
    df = raw.join(facts, "file")
    if header:
        df = df.filter(F.col("_mid") != F.col("_first_mid"))
    line = F.coalesce(*[F.when(F.col("_enc") == e, F.col("_raw") if e == "UTF-8" else F.decode(F.col("_raw").cast("binary"), e))
                        for e in chain])
    df = df.withColumn("_line", F.regexp_replace(line, "^\ufeff", "")).filter(F.trim("_line") != "")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    seps = (sep,) if sep is not None else SEPARATORS
    row = F.coalesce(*[F.when(F.col("_sep") == c, F.from_csv("_line", ddl, {"sep": c})) for c in seps])
    return df.select(row.alias("_row"), F.col("file").alias("source_file")).select("_row.*", "source_file")


def latest_by_name(df: DataFrame, name_pattern: str, part: str = "file_name") -> DataFrame:
    """Rows of the newest file, newest by the timestamp in the file
    name (``name_pattern`` must capture it, e.g. r'^MIR_Results_(\\d{8}_\\d{6})\\.csv$'
    so that other exports with a longer prefix never match), never by name
    order. ``part="file_path"`` matches the whole path, for exports that are
    folders. The newest stamp is one row, joined back as a broadcast."""
    stamp = F.regexp_extract(F.col(f"_metadata.{part}"), name_pattern, 1)
    tagged = df.withColumn("_stamp", stamp).filter(F.col("_stamp") != "")
    newest = tagged.agg(F.max("_stamp").alias("_stamp"))
    return tagged.join(F.broadcast(newest), "_stamp", "left_semi").drop("_stamp")


def newest_by_name(spark: SparkSession, path: str, name_pattern: str) -> str:
    """Path of the newest export (a file or a folder) among those that the glob ``path`` lists, by
    the stamp that ``name_pattern`` captures in the whole name. Only names are listed, no row is
    read; ties go to the greater name."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    listed = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p) or []
    found = [(m[1], s.getPath().getName(), s.getPath().toString()) for s in listed if (m := re.fullmatch(name_pattern, s.getPath().getName()))]
    if not found:
        raise FileNotFoundError(f"no export under {path} is named like {name_pattern}")
    return max(found)[2]
