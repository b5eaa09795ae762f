"""Prefix trie of conversations by fixed-length block hashing.

Turns are cut into blocks of BLOCK at fixed places. Conversations are grouped by their
successive block digests first: a block node is all conversations equal up to the end
of a block. Turn boundaries are refined only inside blocks where siblings diverge, that
is under a block node with more than one following block, and there on the distinct
blocks, not on the conversations. A block without siblings gives its turn nodes as it is.

Sums over subtrees go by chains. Every node has a representative, its member with the
smallest hash; the nodes with one representative are a chain that ends where that
conversation ends. A chain's total is lifted to the node it hangs from, the totals so
received are lifted again, until none is left: as hashes are random, a path crosses
about the logarithm of the number of conversations of chains, whatever its depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotline.llm.common import crc32_of, dealt_join, written
from lotline.llm.turns import digest, numbered, turn_digest

#: Turns in a block, and digests that one digest of the next level covers.
BLOCK = 8
FAN = 16
#: Depths of a chain that one window covers.
CHUNK = 1024
#: Bytes of a piece of a list of ids.
PIECE = 1 << 16
#: Turns at most that a conversation takes from its base.
BORROWED = 8
ROOT = ""


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, bytes) of every turn, by turn (nulls first); turns of one number
    stand in the order of their digests. Null role and text are empty; rows without a
    conv_id belong to no conversation."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_digest(role, text).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"))
    return numbered(rows, "conv_id", F.col("turn").asc_nulls_first(), F.col("digest").asc()).drop("turn")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that share openings: c takes the first h turns of conversation c - c % 5 and
    its own after the first h, h = crc32(c) % 9. Returns the turns as :func:`turns` does and
    (conv_id, n) with the number of turns, of every conversation, also those left without one."""
    rows = written(turns(conversations), "turns")
    convs = written(rows.groupBy("conv_id").agg(F.max("pos").alias("n")).select(
        "conv_id", "n", F.expr("conv_id - conv_id % 5").alias("base"), (crc32_of(F.col("conv_id")) % (BORROWED + 1)).alias("h")), "conversations")
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = written(convs.select("conv_id", "n", "base", "h", "taken"), "openings")
    heads = rows.filter(F.col("pos") <= BORROWED).withColumnRenamed("conv_id", "base")
    opening = convs.select("conv_id", "base", "taken").join(heads, "base").filter("pos <= taken").select("conv_id", "pos", "digest", "bytes")
    own = dealt_join(rows, convs.select("conv_id", "n", "h", "taken"), ["conv_id"], F.col("pos"), "n").filter("pos > h")
    out = opening.unionByName(own.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "bytes"))
    return out, convs.select("conv_id", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))


def _running(column: str) -> Column:
    """Digest of the first k digests of an array, for every k."""
    return F.transform(F.sequence(F.lit(1), F.size(column)), lambda k: digest(F.array_join(F.slice(column, F.lit(1), k), "")))


def successive(items: DataFrame, last: int) -> DataFrame:
    """(conv_id, i, before, upto): digests of all items of the conversation before and up to the
    i-th, from ``items`` (conv_id, i from 0 to ``last`` at most, d). FAN items make one of the
    next level, so that no group is larger and long conversations are many groups."""
    groups = (items.groupBy("conv_id", F.expr(f"i div {FAN}").alias("g"))
              .agg(F.array_sort(F.collect_list(F.struct("i", "d"))).alias("l"))
              .select("conv_id", "g", F.col("l.d").alias("d")).withColumn("r", _running("d")))
    if last < FAN:
        groups = groups.withColumn("start", F.lit(ROOT)).withColumn("end", F.lit(None).cast("string"))
        upto = F.expr("r[k]")
    else:
        groups = written(groups, "digests")
        over = successive(groups.select("conv_id", F.col("g").alias("i"), F.element_at("r", -1).alias("d")), last // FAN)
        groups = groups.join(over.select("conv_id", F.col("i").alias("g"), F.col("before").alias("start"), F.col("upto").alias("end")), ["conv_id", "g"])
        upto = F.when(F.col("k") == FAN - 1, F.col("end")).otherwise(digest(F.expr("concat(start, r[k])")))
        before = digest(F.expr("concat(start, r[k - 1])"))
    out = groups.select("conv_id", "g", "start", "end", "r", F.explode(F.sequence(F.lit(0), F.size("r") - 1)).alias("k"))
    previous = F.expr("r[k - 1]") if last < FAN else before
    return out.select("conv_id", (F.col("g") * FAN + F.col("k")).alias("i"),
                      F.when(F.col("k") == 0, F.col("start")).otherwise(previous).alias("before"), upto.alias("upto"))


def _nodes(blocks: DataFrame, convs: DataFrame) -> DataFrame:
    """(uid, parent_uid, depth, conv_id, n_convs, rep, bytes): every node of the trie."""
    chosen = F.min(F.struct(F.xxhash64("conv_id").alias("h"), F.col("conv_id").alias("conv"))).alias("rep")
    distinct = written(blocks.groupBy("before", "upto", "i").agg(
        F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), chosen, F.first("turns").alias("turns")), "blocks")
    following = written(distinct.groupBy("before").agg(F.count("*").alias("siblings")), "following")
    known = dealt_join(distinct, following, ["before"], F.col("upto"), "siblings")
    steps = known.withColumn("r", _running("turns.digest")).withColumn("uids", _uids()).select(
        "before", "i", "n", "conv_id", "rep", "siblings", "turns", "uids", F.explode(F.sequence(F.lit(0), F.size("uids") - 1)).alias("k")).select(
        F.expr("uids[k]").alias("uid"), F.expr("if(k = 0, before, uids[k - 1])").alias("parent_uid"),
        (F.col("i") * BLOCK + F.col("k") + 1).alias("depth"), "conv_id", F.col("n").alias("n_convs"), "rep",
        F.expr("turns[k].bytes").alias("bytes"), "siblings")
    columns = ["uid", "parent_uid", "depth", "conv_id", "n_convs", "rep", "bytes"]
    alone = steps.filter("siblings = 1").select(*columns)
    refined = steps.filter("siblings > 1").groupBy("uid", "parent_uid", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.min("rep").alias("rep"), F.max("bytes").alias("bytes"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), chosen).filter("n_convs > 0").select(
        F.lit(ROOT).alias("uid"), F.lit(None).cast("string").alias("parent_uid"), F.lit(0).cast("long").alias("depth"),
        "conv_id", "n_convs", "rep", F.lit(0).cast("long").alias("bytes"))
    return alone.unionByName(refined.select(*columns)).unionByName(root).withColumn("rep", F.col("rep.conv"))


def _uids() -> Column:
    """Names of a block's turn nodes: a full block's last is the block's, the others' come from what precedes."""
    return F.transform("r", lambda x, k: F.when(k == BLOCK - 1, F.col("upto")).otherwise(digest(F.concat(F.col("before"), x))))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Comma-joined ids of sorted (uid, conv_id) rows, in pieces of one uid."""
    out: list[tuple] = []
    uid, first, ids, size = None, None, [], 0
    for batch in batches:
        for u, c in zip(batch.column("uid").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if u != uid or size >= PIECE:
                if ids:
                    out.append((uid, first, ",".join(ids)))
                uid, first, ids, size = u, c, [], 0
            ids.append(str(c))
            size += len(ids[-1]) + 1
        if sum(len(x[2]) for x in out) >= PIECE:
            yield _table(out, uid=pa.string(), first=pa.int64(), ids=pa.string())
            out = []
    if ids:
        out.append((uid, first, ",".join(ids)))
    yield _table(out, uid=pa.string(), first=pa.int64(), ids=pa.string())


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each uid's pieces, taken one after the other."""
    uid, state = None, None
    for batch in batches:
        out = []
        for u, ids in zip(batch.column("uid").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if u == uid:
                state.update(b",")
            else:
                if state:
                    out.append((uid, state.hexdigest()))
                uid, state = u, hashlib.sha256()
            state.update(ids.encode())
        yield _table(out, uid=pa.string(), ends_sha256=pa.string())
    yield _table([(uid, state.hexdigest())] if state else [], uid=pa.string(), ends_sha256=pa.string())


def _table(rows: list[tuple], **columns: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(columns.items())})


def ends_digest(ends: DataFrame) -> DataFrame:
    """(uid, ends_sha256) of (uid, conv_id): the ids' pieces are made in ranges of (uid, id), so a
    node where very many conversations end is many tasks; one then hashes its pieces as they come."""
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = ends.repartitionByRange(parts, "uid", "conv_id").sortWithinPartitions("uid", "conv_id").mapInArrow(_pieces, "uid string, first long, ids string")
    return pieces.repartition(parts, "uid").sortWithinPartitions("uid", "first").mapInArrow(_hashed, "uid string, ends_sha256 string")


def _lifted(nodes: DataFrame) -> DataFrame:
    """(rep, depth, leaves, saved): what each node receives from the chains that hang from it."""
    chains = written(nodes.filter("parent_rep is not null and parent_rep <> rep").select("rep", "parent_rep", (F.col("depth") - 1).alias("at")), "chains")
    totals = nodes.groupBy("rep").agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
    received = None
    while True:
        found = written(totals.join(chains, "rep").groupBy(F.col("parent_rep").alias("rep"), F.col("at").alias("depth"))
                        .agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "lifted")
        received = found if received is None else received.unionByName(found)
        totals = found.groupBy("rep").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        if found.isEmpty():
            return received.groupBy("rep", "depth").agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))


def _subtree_sums(nodes: DataFrame) -> DataFrame:
    """``nodes`` with n_leaves and saved_tokens of their subtrees: sums down the chains, by chunks of CHUNK depths."""
    own = nodes.join(_lifted(nodes), ["rep", "depth"], "left").withColumn("chunk", F.expr(f"depth div {CHUNK}"))
    for c, kind, more in (("n_leaves", "leaf", "more_leaves"), ("saved_tokens", "saved", "more_saved")):
        own = own.withColumn(c, F.col(kind) + F.coalesce(F.col(more), F.lit(0)))
    deeper = Window.partitionBy("rep").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    chunks = own.groupBy("rep", "chunk").agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s")).select(
        "rep", "chunk", F.coalesce(F.sum("l").over(deeper), F.lit(0)).alias("below_l"), F.coalesce(F.sum("s").over(deeper), F.lit(0)).alias("below_s"))
    down = Window.partitionBy("rep", "chunk").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (own.withColumn("n_leaves", F.sum("n_leaves").over(down)).withColumn("saved_tokens", F.sum("saved_tokens").over(down))
            .join(chunks, ["rep", "chunk"])
            .withColumn("n_leaves", F.col("n_leaves") + F.col("below_l")).withColumn("saved_tokens", F.col("saved_tokens") + F.col("below_s")))


def trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """The prefix trie of conversations: one row per node.

    ``rows``: (conv_id, pos from 1 without gaps, digest, bytes) of every turn; ``convs``: (conv_id, n)
    of every conversation, also those without a turn. A node is a distinct sequence of
    first turns, the root that of none. Returns conv_id (smallest member), depth,
    parent_conv_id (null for the root), n_convs, n_children, n_leaves (childless nodes of the
    subtree), saved_tokens (bytes that later members share, over the subtree), ends_sha256
    (of the sorted ids of the conversations that end there). No conversations: no rows.
    """
    rows, convs = written(rows, "rebuilt"), written(convs, "rebuilt-lengths")
    last = convs.agg(F.max("n")).first()[0] or 0
    cut = rows.withColumn("i", F.expr(f"(pos - 1) div {BLOCK}")).groupBy("conv_id", "i").agg(
        F.array_sort(F.collect_list(F.struct("pos", "digest", "bytes"))).alias("turns"))
    cut = written(cut, "cut")
    items = cut.select("conv_id", "i", digest(F.array_join("turns.digest", "")).alias("d"))
    blocks = written(cut.join(successive(items, max(0, last - 1) // BLOCK), ["conv_id", "i"]), "successive")
    nodes = written(_nodes(blocks, convs), "nodes")

    children = nodes.filter("parent_uid is not null").groupBy(F.col("parent_uid").alias("uid")).agg(F.count("*").alias("n_children"))
    known = written(nodes.join(children, "uid", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "children")
    parents = known.filter("n_children > 0").select(F.col("uid").alias("parent_uid"), F.col("conv_id").alias("parent_conv_id"),
                                                    F.col("rep").alias("parent_rep"), F.col("n_children").alias("of"))
    below = dealt_join(known.filter("parent_uid is not null"), parents, ["parent_uid"], F.col("uid"), "of").drop("of")
    full = below.unionByName(known.filter("parent_uid is null"), allowMissingColumns=True).select(
        "uid", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "rep", "parent_rep",
        F.when(F.col("n_children") == 0, F.lit(1)).otherwise(0).cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    summed = _subtree_sums(written(full, "tree"))

    at = convs.filter("n > 0").select("conv_id", F.expr(f"(n - 1) div {BLOCK}").alias("i"))
    ends = blocks.join(at, ["conv_id", "i"]).withColumn("r", _running("turns.digest")).select(F.element_at(_uids(), -1).alias("uid"), "conv_id")
    ends = ends.unionByName(convs.filter("n = 0").select(F.lit(ROOT).alias("uid"), "conv_id"))
    return summed.join(ends_digest(ends), "uid", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
