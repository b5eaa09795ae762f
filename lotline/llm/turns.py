"""Turns of conversations, numbered in order, however many turns one conversation has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotline.llm.common import written


def digest(text: Column) -> Column:
    """The first 128 bits of the SHA-256 of a text, in hex."""
    return F.substring(F.sha2(text, 256), 1, 32)


def turn_digest(role: Column, text: Column) -> Column:
    """Digest of a turn; the role's length keeps (role, text) apart from other splits of the same bytes."""
    return digest(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))


def numbered(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """``rows`` with ``pos``, their place (from 1) among the rows of ``key`` by ``order``.

    The rows are dealt by ranges of (key, order), so one key may fill many tasks; they are
    sorted and written there with their place in the part, and a row's number is that place
    less the key's first in the part, plus the key's rows in earlier parts. Rows equal in key
    and order take their numbers in any order; a null key is a key like any other.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(key).asc_nulls_first(), *order]
    dealt = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    table = written(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    same = F.col("_key").eqNullSafe(F.col(key)) & (F.col("_of") == F.col("_part"))
    earlier = F.sum("_n").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    heads = (table.groupBy("_part", key).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
             .select(F.col("_part").alias("_of"), F.col(key).alias("_key"), "_first", F.coalesce(earlier, F.lit(0)).alias("_earlier")))
    return (table.join(heads, same).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_earlier") + 1)
            .drop("_part", "_at", "_of", "_key", "_first", "_earlier"))
