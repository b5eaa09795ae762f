"""Embedding near-duplicates by an epsilon grid order join.

Vectors are scaled to length 1, so cosine >= t is distance <= eps = sqrt(2 - 2t). They are
sorted by their grid cells (of side eps) on the leading principal dimensions and cut into
sequence intervals with a box each. Pairs of intervals are found recursively, from the
root of a tree of intervals down, leaving out every pair whose boxes are farther apart
than eps; the vectors of an interval pair are joined by the same recursion on halves,
down to small blocks that are compared in double precision.

Equal vectors stand for one. A pair of intervals tells, for each vector, its number of
links there and one link towards its component, so groups of near copies never become
all their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotline.llm.common import components, cut, salted_join

#: Vectors in a sequence interval, about; vectors in a block that is compared in one step.
INTERVAL = 4096
BLOCK = 512
#: Leading principal dimensions of the grid, and vectors their directions are fitted on.
GRID_DIMS = 8
FIT_ROWS = 4096
#: Children of a node of the interval tree.
FANOUT = 8
#: Slack of the distance bound against rounding.
SLACK = 1e-6


def _usable(vector: Column) -> Column:
    """Has components, all of them finite numbers, not all of them zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _directions(distinct: DataFrame, size: int) -> np.ndarray:
    """Leading principal directions of at most FIT_ROWS vectors; they only decide the
    order, not which pairs link."""
    sample = (distinct.filter(F.size("vector") == size).orderBy(F.xxhash64("vector"), "node")
              .limit(FIT_ROWS).select("vector").collect())
    x = _unit(np.array([r["vector"] for r in sample], float))
    x = x - x.mean(axis=0)
    return np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :GRID_DIMS]


def link(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """Links and components of the vectors with cosine >= ``threshold``.

    Returns one row per input row: the id, n_links (other vectors linked to it), component_id
    (smallest id reachable by links, itself included), kept (id = component_id). Vectors
    that are null, empty, zero or hold a null or non-finite component link with nothing, nor
    do vectors of different sizes with one another, nor rows with a null id (whose
    component is null). Rows that repeat a vector are vectors of their own and link.
    Other columns are ignored; an empty table gives no rows.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    eps = float(np.sqrt(2 - 2 * threshold)) + SLACK
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    rows = rows.withColumn("usable", _usable(F.col("vector")) & F.col("id").isNotNull())
    # 128 bits of the vector, to bring results back to its copies
    prints = [F.xxhash64("vector").alias("print_a"), F.xxhash64(F.lit(1), F.reverse("vector")).alias("print_b")]
    distinct = cut(rows.filter("usable").groupBy("vector").agg(F.min("id").alias("node"), F.count("*").alias("copies"))
                   .select("node", "copies", "vector", *prints))
    counts = {r["size"]: r["n"] for r in distinct.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n")).collect()}
    found = None
    for size, n in sorted(counts.items()):  # one size, as a rule
        part = _links(distinct, size, n, eps, threshold)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"),
                           F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = cut(found)
    groups = components(found.filter("node <> towards").select(F.col("node").alias("src"), F.col("towards").alias("dst")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    result = (distinct.select("node", "copies", "print_a", "print_b").join(links, "node", "left")
              .join(groups, "node", "left")
              .select("print_a", "print_b", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"),
                      F.coalesce("component_id", "node").alias("component")))
    keyed = rows.select("id", *[F.when(F.col("usable"), p).alias(f"print_{c}") for p, c in zip(prints, "ab", strict=True)])
    out = salted_join(keyed, result, ["print_a", "print_b"], F.col("id"), "left")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("component", "id").alias("component_id"),
                      F.col("id").eqNullSafe(F.coalesce("component", "id")).alias("kept"))


def _links(distinct: DataFrame, size: int, n: int, eps: float, threshold: float) -> DataFrame:
    """(node, links, towards) from every pair of near intervals of vectors of one size."""
    directions = _directions(distinct, size)
    dims = directions.shape[1]
    at = ", ".join(f"p{i} double" for i in range(dims))

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                x = _unit(np.array(pdf["vector"].tolist(), float))
                out = pd.DataFrame({"node": pdf["node"], "copies": pdf["copies"], "unit": [r.tobytes() for r in x]})
                for i, c in enumerate((x @ directions).T):
                    out[f"p{i}"] = c
                yield out

    def intervals(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n_held = [], 0

        def interval(pdf: pd.DataFrame) -> pd.DataFrame:
            p = pdf[[f"p{i}" for i in range(dims)]].to_numpy()
            return pd.DataFrame({"nodes": [pdf["node"].to_numpy()], "copies": [pdf["copies"].to_numpy()],
                                 "units": [b"".join(pdf["unit"])], "low": [p.min(axis=0)], "high": [p.max(axis=0)]})

        for pdf in frames:
            held.append(pdf)
            n_held += len(pdf)
            if n_held >= INTERVAL:
                everything = pd.concat(held, ignore_index=True)
                whole = n_held - n_held % INTERVAL
                for i in range(0, whole, INTERVAL):
                    yield interval(everything.iloc[i:i + INTERVAL])
                held, n_held = [everything.iloc[whole:]], n_held - whole
        if n_held:
            yield interval(pd.concat(held, ignore_index=True))

    projected = (distinct.filter(F.size("vector") == size).select("node", "copies", "vector")
                 .mapInPandas(project, f"node long, copies long, unit binary, {at}"))
    # epsilon grid order: by cell, dimension after dimension; in a cell by the leading coordinate
    order = [F.floor(F.col(f"p{i}") / eps) for i in range(dims)] + [F.col("p0"), F.col("node")]
    parts = max(1, round(n / INTERVAL))
    # as many tasks as intervals, also where the session deals a range out finer than asked for
    sequence = projected.repartitionByRange(parts, *order).sortWithinPartitions(*order).coalesce(parts)
    table = cut(sequence.mapInPandas(intervals, "nodes array<long>, copies array<long>, units binary, low array<double>, high array<double>")
                .withColumn("part", F.spark_partition_id()).withColumn("step", F.monotonically_increasing_id()))
    pairs = _near_intervals(table, eps)

    # an interval's vectors travel once for each interval near it
    a = table.select(F.col("step").alias("a"), F.col("nodes").alias("nodes_a"), F.col("copies").alias("copies_a"), F.col("units").alias("units_a"))
    b = table.select(F.col("step").alias("b"), F.col("nodes").alias("nodes_b"), F.col("copies").alias("copies_b"), F.col("units").alias("units_b"))

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples():
                xa, xb = (np.frombuffer(u, np.float64).reshape(-1, size) for u in (r.units_a, r.units_b))
                yield _compared(xa, xb, np.asarray(r.nodes_a), np.asarray(r.nodes_b), np.asarray(r.copies_a),
                                np.asarray(r.copies_b), r.a == r.b, directions, eps, threshold)

    both = pairs.join(b, "b").join(a, "a")
    return both.mapInPandas(compare, "node long, links long, towards long")


def _distance(low: Column, high: Column, other_low: Column, other_high: Column) -> Column:
    """Squared distance of two boxes."""
    gap = F.zip_with(F.zip_with(low, other_high, lambda x, y: x - y), F.zip_with(other_low, high, lambda x, y: x - y),
                     lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x)


def _near_intervals(table: DataFrame, eps: float) -> DataFrame:
    """Pairs (a, b) of intervals, a <= b in the sequence, with boxes at most eps apart.

    The leaves of the tree are the intervals, above them the partitions they are in and
    then FANOUT neighbours each up to a root; a pair of nodes is followed down only
    where their boxes are near.
    """
    box = [F.col("low"), F.col("high")]
    levels = [table.select(F.col("step").alias("node"), F.col("part").cast("long").alias("up"), *box)]
    top = table.agg(F.max("part")).first()[0] or 0
    while True:
        below = levels[-1]
        dims = F.sequence(F.lit(0), F.size(F.first("low")) - 1)
        lows, highs = F.collect_list("low"), F.collect_list("high")  # FANOUT boxes, or those of a partition
        level = below.groupBy("up").agg(
            F.transform(dims, lambda i: F.array_min(F.transform(lows, lambda x: x[i]))).alias("low"),
            F.transform(dims, lambda i: F.array_max(F.transform(highs, lambda x: x[i]))).alias("high"))
        levels.append(level.select(F.col("up").alias("node"), F.expr(f"up div {FANOUT}").alias("up"), *box))
        if top == 0:
            break
        top //= FANOUT
    pairs = levels[-1].select(F.col("node").alias("a"), F.col("node").alias("b"))
    for level in reversed(levels[:-1]):
        kids = [level.select(F.col("up").alias(x), F.col("node").alias(f"kid_{x}"), F.col("low").alias(f"low_{x}"),
                             F.col("high").alias(f"high_{x}")) for x in "ab"]
        near = _distance(F.col("low_a"), F.col("high_a"), F.col("low_b"), F.col("high_b")) <= eps * eps
        pairs = (pairs.join(kids[0], "a").join(kids[1], "b").filter((F.col("kid_a") <= F.col("kid_b")) & near)
                 .select(F.col("kid_a").alias("a"), F.col("kid_b").alias("b")))
    return pairs


def _compared(xa: np.ndarray, xb: np.ndarray, nodes_a: np.ndarray, nodes_b: np.ndarray, copies_a: np.ndarray,
              copies_b: np.ndarray, same: bool, directions: np.ndarray, eps: float, threshold: float) -> pd.DataFrame:
    """Links between two intervals (or within one): counts by vector, and a smallest
    vector towards which each linked vector's component goes."""
    pa, pb = xa @ directions, xb @ directions
    links_a, links_b = np.zeros(len(xa), np.int64), np.zeros(len(xb), np.int64)
    nodes = nodes_a if same else np.r_[nodes_a, nodes_b]
    shift = 0 if same else len(xa)
    label = np.argsort(np.argsort(nodes))  # of each vector: rank of the smallest node known in its component
    by_rank = np.sort(nodes)

    def visit(a0: int, a1: int, b0: int, b1: int) -> None:
        if a0 >= a1 or b0 >= b1 or (same and a0 >= b1):
            return
        gap = np.maximum(0, np.maximum(pa[a0:a1].min(0) - pb[b0:b1].max(0), pb[b0:b1].min(0) - pa[a0:a1].max(0)))
        if (gap * gap).sum() > eps * eps:
            return
        if a1 - a0 <= BLOCK and b1 - b0 <= BLOCK:
            hit = xa[a0:a1] @ xb[b0:b1].T >= threshold
            if same:
                hit &= np.arange(a0, a1)[:, None] < np.arange(b0, b1)[None, :]
            i, j = np.nonzero(hit)
            if len(i):
                i, j = i + a0, j + b0
                np.add.at(links_a, i, copies_b[j])
                np.add.at(links_a if same else links_b, j, copies_a[i])
                join(i, j + shift)
            return
        halves_a = [(a0, a1)] if a1 - a0 <= BLOCK else [(a0, (a0 + a1) // 2), ((a0 + a1) // 2, a1)]
        halves_b = [(b0, b1)] if b1 - b0 <= BLOCK else [(b0, (b0 + b1) // 2), ((b0 + b1) // 2, b1)]
        for p in halves_a:
            for q in halves_b:
                visit(*p, *q)

    def join(i: np.ndarray, j: np.ndarray) -> None:
        """Merge the components of linked vectors: the smaller label wins, everywhere."""
        nonlocal label
        while True:
            li, lj = label[i], label[j]
            apart = li != lj
            if not apart.any():
                return
            to = np.arange(len(label))
            np.minimum.at(to, np.maximum(li, lj)[apart], np.minimum(li, lj)[apart])
            while (to[to] != to).any():
                to = to[to]
            label = to[label]

    visit(0, len(xa), 0, len(xb))
    links = links_a if same else np.r_[links_a, links_b]
    linked = np.flatnonzero(links)
    return pd.DataFrame({"node": nodes[linked], "links": links[linked], "towards": by_rank[label[linked]]})
