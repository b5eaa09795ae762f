"""Sharding by proportional stratified interleaving (DataFrame functions only).

Rows of a source are shuffled by a seeded hash and ranked; a row's fractional
rank (rank - 1/2) / (rows of the source) says where in the mixture it belongs.
Sorting all rows by it interleaves the sources in proportion, so a contiguous
cut gives shards that each have the whole mixture, of sizes at most one apart
(law ``rows``).

Ranks need no global sort in one task: within a source they are a window over
(source, hash prefix) plus the counts of the earlier prefixes, so a source with
a third of all rows is dealt over PREFIXES groups. The rank over all rows comes from
ranges of (fractional rank, seeded hash), so that many sources of one row, which share a
fractional rank, are many tasks too, and mix by their hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotline.llm.turns import numbered

#: Groups that the rows of one source are dealt over.
PREFIXES = 1024


def interleave(docs: DataFrame, shards: int = 8, seed: str = "lot") -> DataFrame:
    """Shard and slot of every row of ``docs`` (doc_id, text, source; other columns are ignored).

    Returns doc_id, source, size (UTF-8 bytes of the text plus 1), text_crc32, law,
    shard, slot (gapless from 0 in a shard, in mixture order), grown_shard (null: the
    law is not ``key``). Null text counts as empty, null source is a source of its own,
    null doc_id hashes as an empty one; repeated rows each get a slot (which of them
    gets which does not matter, as they are equal). An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", "source",
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("stratum"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")).alias("key"),
    ).withColumn("prefix", (F.conv(F.substring("key", 1, 4), 16, 10).cast("int") % PREFIXES))
    # the prefix decides the order first, so the seeded order is (prefix, key)
    counts = rows.groupBy("stratum", "prefix").agg(F.count("*").alias("n"))
    by_stratum = Window.partitionBy("stratum")
    counts = counts.select(
        "stratum", "prefix",
        (F.sum("n").over(by_stratum.orderBy("prefix")) - F.col("n")).alias("before"),
        F.sum("n").over(by_stratum).alias("total"))
    within = Window.partitionBy("stratum", "prefix").orderBy("key", "doc_id", "size", "text_crc32")
    ranked = (rows.join(counts, ["stratum", "prefix"])
              .withColumn("rank", F.col("before") + F.row_number().over(within))
              .withColumn("fraction", (2 * F.col("rank") - 1) / (2 * F.col("total"))))
    all_rows = counts.select("stratum", "total").distinct().agg(F.sum("total")).first()[0] or 0
    order = [F.col(c).asc() for c in ("fraction", "key", "stratum", "doc_id", "size", "text_crc32")]
    placed = numbered(ranked.select("doc_id", "source", "stratum", "size", "text_crc32", "key", "fraction", F.lit(0).alias("one")), "one", *order)
    return (placed.withColumn("at", F.col("pos") - 1).withColumn("all_rows", F.lit(all_rows).cast("long"))
            .withColumn("shard", F.expr(f"cast((at * {shards}) div all_rows as int)"))
            .select("doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                    F.expr(f"at - ((shard * all_rows + {shards - 1}) div {shards})").alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
