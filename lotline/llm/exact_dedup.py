"""Exact deduplication against immutable snapshots screened by static binary fuse filters.

Texts arrive in batches. A batch's own duplicates are grouped first, by digest and bytes;
its distinct digests are then screened by the filter of every earlier snapshot, one
filter per bucket of digests. Only the digests that a filter lets pass ("maybe") are
joined with the snapshot's texts, where the bytes decide. What no snapshot holds becomes
the batch's own snapshot, written once and never changed.

Digests are 64 bits, so unlike texts may share one; texts of one digest are told apart by
their bytes, within a batch and against snapshots.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotline.llm import fuse_filter
from lotline.llm.common import dealt_join, maybe_in, written

#: Digests that one filter is built for, about, and that are screened at a time.
BUCKET_KEYS = 30_000
#: Fixed value of the contract: characters that do not count.
SPACE = " \t\n\x0b\x0c\r"

FILTERS = "bucket long, seed long, segment int, span long, prints binary"


def normal(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def digest(norm: Column) -> Column:
    return F.xxhash64(norm)


@dataclass(frozen=True)
class Snapshot:
    """Distinct texts of one batch: ``texts`` (digest, norm, cls) and ``filters`` (FILTERS), tables
    in the shared folder; ``buckets``: number of buckets of digests, each with its filter."""
    texts: DataFrame
    filters: DataFrame
    buckets: int


@dataclass
class Store:
    """Snapshots so far; ``hashed`` gives the digest of a normalised text."""
    hashed: Callable[[Column], Column] = digest
    snapshots: list[Snapshot] = field(default_factory=list)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.col("digest"), F.lit(buckets))


def _build(groups: pa.Table) -> pa.Table:
    f = fuse_filter.build(groups.column("digest").to_numpy())
    return pa.table({"bucket": groups.column("bucket")[:1], "seed": pa.array(np.array([f.seed], np.uint64).view(np.int64)),
                     "segment": pa.array([f.segment], pa.int32()), "span": pa.array([f.span], pa.int64()),
                     "prints": pa.array([f.prints.tobytes()], pa.binary())})


def _screen(filters: pa.Table, digests: pa.Table) -> pa.Table:
    """The digests that their bucket's filter lets pass; none where the bucket is empty."""
    columns = {c: digests.column(c) for c in ("digest",)}
    if not filters.num_rows or not digests.num_rows:
        return pa.table(columns).slice(0, 0)
    f = filters.to_pylist()[0]
    held = fuse_filter.Filter(f["seed"] % (1 << 64), f["segment"], f["span"], np.frombuffer(f["prints"], np.uint8))
    return pa.table(columns).filter(pa.array(held.maybe(digests.column("digest").to_numpy())))


def snapshot(texts: DataFrame) -> Snapshot:
    """Snapshot of ``texts`` (digest, norm, cls), a table of distinct texts."""
    keys = texts.select("digest").distinct()
    buckets = max(1, keys.count() // BUCKET_KEYS)
    filters = keys.select(_bucket(buckets).alias("bucket"), "digest").groupBy("bucket").applyInArrow(_build, FILTERS)
    return Snapshot(texts, written(filters, "fuse-filters"), buckets)


def maybe(digests: DataFrame, snap: Snapshot) -> DataFrame:
    """Those of ``digests`` (digest: distinct) that the snapshot's filters let pass. A bucket with
    more of them than BUCKET_KEYS is screened in slices, each with the filter."""
    slices = max(1, -(-digests.count() // (snap.buckets * BUCKET_KEYS)))
    part = F.pmod(F.shiftright("digest", 20), F.lit(slices))
    left = snap.filters.withColumn("slice", F.explode(F.expr(f"sequence(0L, {slices - 1}L)"))).groupBy("bucket", "slice")
    right = digests.select(_bucket(snap.buckets).alias("bucket"), part.cast("long").alias("slice"), "digest").groupBy("bucket", "slice")
    return left.cogroup(right).applyInArrow(_screen, "digest long")


def _snapshot(texts: DataFrame, name: str) -> Snapshot:
    """The new texts of a batch under names of their own; where texts share a digest, their
    order tells them apart (then they are written anew; 64 bits make that rare)."""
    plain = F.concat(F.lit(f"{name}:"), F.hex("digest"))
    new = texts.filter("not known").select("digest", "norm", plain.alias("cls"))
    if not new.groupBy("digest").count().filter("count > 1").isEmpty():
        rank = F.row_number().over(Window.partitionBy("digest").orderBy("norm"))
        new = written(new.withColumn("cls", F.concat("cls", F.lit(":"), rank.cast("string"))), f"{name}-apart")
    return snapshot(new)


def ingest(store: Store, batch: DataFrame, name: str) -> DataFrame:
    """Class of every row of ``batch`` (text and any other columns, which it keeps, without text).

    Adds cls, a name that equal texts, and only they, share over all batches, and ``known``:
    an earlier snapshot holds the text. The batch's new texts become a snapshot of
    ``store``. The batch is read more than once and must give the same rows (a table). Null
    text is empty; an empty batch gives no rows.
    """
    rows = batch.withColumn("__norm", normal(F.col("text"))).withColumn("__digest", store.hashed(F.col("__norm"))).drop("text")
    narrow = written(rows.drop("__norm").withColumn("__row", F.monotonically_increasing_id()), f"{name}-rows")
    digests = narrow.groupBy(F.col("__digest").alias("digest")).agg(F.count("*").alias("n"))
    # the filters let few digests pass beside those that are there; only their texts are looked at
    held = None
    for snap in store.snapshots:
        passed = written(maybe(digests.select("digest"), snap), f"{name}-passed")
        theirs = maybe_in(snap.texts, passed, "digest")
        held = theirs if held is None else held.unionByName(theirs)
    # the batch's own duplicates fall together before the shuffle: the key is the text itself
    own = rows.groupBy(F.col("__digest").alias("digest"), F.col("__norm").alias("norm")).agg(F.lit(1).alias("one")).drop("one")
    own = own.withColumn("cls", F.lit(None).cast("string")) if held is None else own.join(held.hint("merge"), ["digest", "norm"], "left")
    texts = written(own.select("digest", "norm", F.col("cls").isNotNull().alias("known"), F.col("cls").alias("held")), f"{name}-texts")
    new = _snapshot(texts, name)
    store.snapshots.append(new)
    classes = new.texts.select("digest", F.lit(False).alias("known"), "cls", "norm").unionByName(
        texts.filter("known").select("digest", "known", F.col("held").alias("cls"), "norm"))
    # a digest's rows go by it where it has one text, else by the text
    single = classes.groupBy("digest").agg(F.count("*").alias("texts"), F.first("known").alias("known"), F.first("cls").alias("cls"))
    single = written(single.join(digests, "digest"), f"{name}-classes")
    renamed = narrow.withColumnRenamed("__digest", "digest")
    out = dealt_join(renamed, single.filter("texts = 1"), ["digest"], F.col("__row"), "n").drop("__row", "digest", "texts", "n")
    several = single.filter("texts > 1").select("digest")
    if several.isEmpty():
        return out
    apart = rows.withColumnsRenamed({"__digest": "digest", "__norm": "norm"}).join(several, "digest", "left_semi")
    return out.unionByName(apart.join(classes, ["digest", "norm"]).select(*out.columns))


def dedup(docs: DataFrame, batches: int = 3, hashed: Callable[[Column], Column] = digest) -> DataFrame:
    """Which of ``docs`` (doc_id, text; other columns are ignored) stays of every group of equal texts.

    The rows arrive in ``batches``, dealt by a hash of doc_id: the first makes the first snapshot,
    each later one is screened against the snapshots of all before it. Texts are equal when
    identical without the characters of SPACE. Of a group the row with most code points stays,
    then the smallest doc_id (null last); of rows equal in both one stays. Returns doc_id, keep_id,
    group_size, kept, text_sha256 (of the text without those characters), one row per row.
    """
    store, parts = Store(hashed), []
    for b in range(batches):
        batch = docs.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit("batch")), F.lit(batches)) == b).select(
            F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.char_length("text"), F.lit(0)).alias("points"),
            F.sha2(normal(F.col("text")), 256).alias("text_sha256"))
        parts.append(ingest(store, batch, f"batch{b}"))
    members = written(reduce(DataFrame.unionByName, parts).withColumn("row", F.monotonically_increasing_id()), "members")
    # ~doc_id turns the order round without overflow
    best = F.max(F.struct("points", F.bitwise_not("doc_id").alias("id"), "row")).alias("best")
    groups = written(members.groupBy("cls").agg(F.count("*").alias("group_size"), best), "groups")
    out = dealt_join(members, groups, ["cls"], F.col("row"), "group_size")
    return out.select("doc_id", F.bitwise_not("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256")
