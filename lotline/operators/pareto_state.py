"""The bin Pareto kept up to date from batches of unit rows (A7, A11 from S11).

A distinct count does not add up over batches, a set does: the state holds, per Pareto
cell, the exact set of its units as bitmaps over unit numbers. Every batch numbers the
units that no batch before it had (dense numbers, in parts of the dictionary), and adds its
own bitmaps; nothing that is there is read but the dictionary, and nothing is rewritten. A
query ors the bitmaps of all batches and counts their bits. Batches may come in any order
of content; one that comes again, by its id, changes nothing, as both parts of a batch
appear with one manifest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotline.operators import pareto
from lotline.sinks import versions

KEYS = ["slice", "bin_kind", "process_step"]
CELL = [*KEYS, "bin", "devrevstep"]


def _parts(spark: SparkSession, path: str, kind: str) -> list[DataFrame]:
    try:
        names = versions.parts(spark, path)
    except versions.NoVersionError:
        return []
    return [spark.read.parquet(f"{path.rstrip('/')}/{folder}") for name, folder in sorted(names.items()) if name.startswith(kind)]


def _numbered(new: DataFrame, first: int, staged: str) -> DataFrame:
    """``new`` (visual_id) with dense numbers from ``first``: place in the part of a written table plus
    the rows of the parts before it (one row per part)."""
    new.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()).write.parquet(staged)
    table = new.sparkSession.read.parquet(staged)
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = table.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_m")).select(
        "_part", (F.coalesce(before, F.lit(0)) - F.col("_m") + first).alias("_shift"))
    return table.join(F.broadcast(parts), "_part").select("visual_id", (F.col("_at") + F.col("_shift")).alias("number"))


def add_batch(units: DataFrame, path: str, batch_id: int | str) -> bool:
    """Adds a batch of unit rows to the state under ``path``; False where a batch of this id is there.
    One writer at a time, as a stream's batches have it."""
    spark = units.sparkSession
    try:
        held = versions.parts(spark, path)
    except versions.NoVersionError:
        held = {}
    if f"cells-{batch_id}" in held:
        return False
    rows, _ = pareto.pareto_rows(units)
    rows = rows.select(*CELL, "visual_id").distinct()
    known = _parts(spark, path, "units-")
    ids = rows.select("visual_id").filter("visual_id is not null").distinct()
    first = 0
    if known:
        dictionary = reduce(DataFrame.unionByName, known)
        first = (dictionary.agg(F.max("number")).first()[0] or 0) + 1
        ids = ids.join(dictionary, "visual_id", "left_anti")
    fresh = _numbered(ids, first, f"{path.rstrip('/')}/staged/{batch_id}-{len(held)}")
    everyone = reduce(DataFrame.unionByName, [*known, fresh])
    # a cell of rows without a unit is there too, with an empty set
    numbered = rows.join(everyone, "visual_id", "left")
    at = F.col("number") + 1
    cells = numbered.groupBy(*CELL, F.coalesce(F.bitmap_bucket_number(at), F.lit(1)).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("units"))
    versions.publish(path, {f"units-{batch_id}": fresh, f"cells-{batch_id}": cells}, keep=True)
    return True


def compact(spark: SparkSession, path: str, name: str = "merged") -> None:
    """All batches' bitmaps as one part, and all dictionaries; readers see either form. The ids of
    the batches stay known as empty parts."""
    held = versions.parts(spark, path)
    cells = _merged(spark, path)
    tables = {f"cells-{name}": cells, f"units-{name}": reduce(DataFrame.unionByName, _parts(spark, path, "units-"))}
    tables |= {p: cells.limit(0) for p in held if p.startswith("cells-") and p != f"cells-{name}"}
    versions.publish(path, tables)


def _merged(spark: SparkSession, path: str) -> DataFrame:
    cells = reduce(DataFrame.unionByName, _parts(spark, path, "cells-"))
    return cells.groupBy(*CELL, "bucket").agg(F.bitmap_or_agg("units").alias("units"))


def current_pareto(spark: SparkSession, path: str) -> DataFrame:
    """The Pareto over all batches, as ``bin_pareto`` over all their rows gives it."""
    cells = _merged(spark, path).groupBy(*CELL).agg(F.sum(F.bitmap_count("units")).alias("quantity"))
    return pareto.pareto_table(cells, KEYS)
