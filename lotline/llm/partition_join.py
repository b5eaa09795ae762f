"""Exact set-similarity self-join on word n-grams, by universe partitioning.

Texts become sets of hashed word n-grams. Sets are put into size bands; two sets of
Jaccard similarity >= percent/100 share a band and differ there in at most H elements.
A band's universe of hashes is cut into M segments, and a set is indexed by the subset
that falls into each:

* ``exact`` layout: M = H + 1 + spare segments. A similar pair agrees on at least
  spare + 1 of them, so every set may leave out its ``spare`` costliest keys (those
  that most sets have: empty segments, common passages) - the cheapest key that a
  similar pair shares is left out by neither.
* ``deletion`` layout: M = H // 2 + 1 larger segments, indexed by the subset and all
  subsets with one element deleted; a similar pair differs by at most one element
  in one of them.

The layout of a band is chosen by cost: its number of sets (over all rows) against the
keys that either layout writes. Sets that share a key are verified exactly on their
texts. A key of many sets is not expanded into pairs: its sets are compared with one
pivot first, then only sets of different components that share a key, so that no
link between components is lost. Before any text is fetched, a pair must pass a parity
sketch: each element flips one of SKETCH_BITS bits, so two sets' sketches differ in at most
as many bits as the sets in elements, whatever they have in common.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotline.llm.common import components, dealt_join, maybe_in, salted_join, without, written
from lotline.llm.words import trim

#: Words whose hashes a task remembers.
REMEMBERED = 100_000
#: Bands grow by this factor (more where a low similarity lets partners differ more).
GROWTH = 1.5
_TAG_BITS = 6
#: Bits of a set's parity sketch, kept as 64-bit columns.
SKETCH_BITS = 1024
_SKETCH = [f"sketch_{i}" for i in range(SKETCH_BITS // 64)]


@dataclass(frozen=True)
class Band:
    """Layout of a size band; segments 0: no two different sets of it can be similar."""

    low: int
    segments: int
    spare: int
    deletion: bool


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(text: str | None, k: int) -> set[bytes]:
    w = words_of(text)
    if len(w) < k:
        return {b" ".join(w)} if w else set()
    return {b" ".join(w[i:i + k]) for i in range(len(w) - k + 1)}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, k: int, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles."""
    w = words_of(text)
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w))
    n = min(k, len(w))
    out = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i:len(h) - n + 1 + i])
    return np.unique(out)


def band_edges(percent: int, longest: int) -> list[int]:
    growth = max(GROWTH, 110 / percent)
    edges = [1]
    while edges[-1] <= longest and len(edges) < 1 << _TAG_BITS:
        edges.append(max(edges[-1] + 1, int(edges[-1] * growth)))
    return edges


def layouts(percent: int, edges: list[int], sets: dict[int, int]) -> list[Band]:
    """The cheaper layout of every band; ``sets``: number of sets by band (an estimate
    is enough, it decides the cost only)."""
    out = []
    for t, low in enumerate(edges):
        # the last band is open: its layout only has to hold for the sizes up to its limit
        top = (edges[t + 1] - 1) if t + 1 < len(edges) else int(low * max(GROWTH, 110 / percent))
        h = 2 * top * (100 - percent) // (100 + percent)
        n, middle = sets.get(t, 0), (low + top) / 2
        if h == 0:
            out.append(Band(low, 0, 0, False))
            continue
        spare = max(2, h // 8)
        m = h + 1 + spare
        m_del = h // 2 + 1

        def false_pairs(segments: int, at_most: int, left_out: int) -> float:
            """Pairs expected to share a segment of at most so many elements by chance,
            beside those that every set leaves out."""
            mean = middle / segments
            p = sum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(at_most + 1))
            return max(0.0, segments * p - left_out) * n * n * p / 2

        exact = n * m + false_pairs(m, 0, spare)
        deletion = n * (middle + m_del) + false_pairs(m_del, 1, 0)
        out.append(Band(low, m_del, 0, True) if deletion < exact else Band(low, m, spare, False))
    return out


def keys_of(h: np.ndarray, tag: int, band: Band) -> np.ndarray:
    """Keys of a set in a band; the lowest bits of a key are the band."""
    m = np.uint64(band.segments)
    seg = ((h >> np.uint64(32)) * m) >> np.uint64(32)
    element = _mix(h + np.uint64(tag))
    order = np.argsort(seg, kind="stable")
    seg, element = seg[order], element[order]
    starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
    sums = np.zeros(band.segments, np.uint64)
    sums[seg[starts].astype(np.int64)] = np.add.reduceat(element, starts)
    number = _mix(np.arange(band.segments, dtype=np.uint64) + np.uint64(1 << 40))
    keys = _mix(sums ^ number)
    if band.deletion:
        at = seg.astype(np.int64)
        keys = np.r_[keys, _mix((sums[at] - element) ^ number[at])]
    return (keys << np.uint64(_TAG_BITS)) | np.uint64(tag)


def sets_of(docs: DataFrame, k: int) -> DataFrame:
    """Per row of (doc_id, text): n_shingles, a 128-bit fingerprint and a parity sketch of the set."""

    def fingerprint(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        for pdf in frames:
            n, a, b, sketches = [], [], [], []
            for text in pdf["text"]:
                h = shingle_hashes(text, k, hashes)
                n.append(len(h))
                a.append(int(np.add.reduce(_mix(h), dtype=np.uint64)))
                b.append(int(np.add.reduce(_mix(h ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)))
                odd = np.bincount((h % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
                sketches.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            matrix = np.array(sketches, np.int64).reshape(-1, len(_SKETCH))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_shingles": n,
                                "print_a": np.array(a, np.uint64).view(np.int64),
                                "print_b": np.array(b, np.uint64).view(np.int64), **dict(zip(_SKETCH, matrix.T, strict=True))})
            trim()

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, print_a long, print_b long, "
    schema += ", ".join(f"{c} long" for c in _SKETCH)
    return docs.select("doc_id", "text").mapInPandas(fingerprint, schema)


def key_rows(docs: DataFrame, k: int, percent: int, edges: list[int], bands: list[Band]) -> DataFrame:
    """(key, doc_id) for every key of every set."""

    def emit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        for pdf in frames:
            keys, ids, held = [], [], 0
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                h = shingle_hashes(text, k, hashes)
                if not len(h):
                    continue
                first = bisect.bisect_right(edges, len(h)) - 1
                last = bisect.bisect_right(edges, len(h) * 100 // percent) - 1
                for tag in range(first, last + 1):
                    if bands[tag].segments:
                        x = keys_of(h, tag, bands[tag])
                        keys.append(x.view(np.int64))
                        ids.append(np.full(len(x), doc_id, np.int64))
                        held += len(x)
                if held > 200_000:
                    yield pd.DataFrame({"key": np.concatenate(keys), "doc_id": np.concatenate(ids)})
                    keys, ids, held = [], [], 0
            if held:
                yield pd.DataFrame({"key": np.concatenate(keys), "doc_id": np.concatenate(ids)})
            trim()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    return rows.mapInPandas(emit, "key long, doc_id long")


def _sketch(sets: DataFrame, side: str) -> DataFrame:
    """One row per document, columns named for one side of a pair."""
    one = sets.groupBy("doc_id").agg(F.first("n_shingles").alias("n_shingles"), *[F.first(c).alias(c) for c in _SKETCH])
    return one.select(F.col("doc_id").alias(side), F.col("n_shingles").alias(f"n_{side}"),
                      *[F.col(c).alias(f"{c}_{side}") for c in _SKETCH])


def _may_link(percent: int) -> Column:
    """The sketches of sides a and b leave room for a link."""
    bits = [F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in _SKETCH]
    return reduce(Column.__add__, bits) * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)


def verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those (a, b) of ``pairs`` whose shingle sets have 100 * common >= percent * union."""

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            ok, last, kept = [], None, set()
            for a, ta, tb in zip(pdf["a"], pdf["text_a"], pdf["text_b"], strict=True):
                if a != last:
                    last, kept = a, shingle_set(ta, k)
                other = shingle_set(tb, k)
                common = len(kept & other)
                ok.append(100 * common >= percent * (len(kept) + len(other) - common))
            yield pdf.loc[ok, ["a", "b"]]
            trim()

    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInPandas(check, "a long, b long")


def join_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents linked by n-gram Jaccard similarity >= percent/100.

    ``docs``: doc_id (whole number), text; other columns are ignored. Returns one row per
    input row: doc_id, n_shingles (size of its set of distinct k-word shingles; a text of
    fewer words has its whole sequence as one), component_id (smallest doc_id reachable
    by links, itself included).

    Null and empty texts have an empty set and link with nothing. A null doc_id links
    with nothing and has a null component. Rows that repeat a doc_id are one document
    and should have one text; where they differ, one of the texts decides its links.
    Shingles are hashed to 64 bits to find candidates and to count n_shingles; links
    between different sets are verified on the words themselves. Of two equal sets no
    text is compared: they have equal 128-bit fingerprints.
    """
    sets = written(sets_of(docs, k), "sets")
    # equal sets: one of them stands for all
    known = sets.filter("doc_id is not null and n_shingles > 0").select(F.col("doc_id").cast("long").alias("doc_id"), "n_shingles", "print_a", "print_b")
    same = ["n_shingles", "print_a", "print_b"]
    leaders = written(known.groupBy(*same).agg(F.min("doc_id").alias("leader"), F.count("*").alias("n")).filter("n > 1"), "leaders")
    copies = written(dealt_join(known, leaders, same, F.col("doc_id"), "n").filter("doc_id <> leader")
                     .groupBy("doc_id").agg(F.min("leader").alias("leader")), "copies")

    longest = known.agg(F.max("n_shingles")).first()[0] or 1
    edges = band_edges(percent, longest * 100 // percent + 1)
    band = F.lit(-1)
    for edge in edges:
        band = band + (F.col("n_shingles") >= edge).cast("int")
    counts = {r["band"]: r["n"] for r in known.groupBy(band.alias("band")).agg(F.count("*").alias("n")).collect()}
    bands = layouts(percent, edges, counts)

    # keys shared by two documents at least, without each document's costliest ones; copies have none
    one_each = without(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), copies, "doc_id")
    rows = key_rows(one_each, k, percent, edges, bands)
    by_key = Window.partitionBy("key")
    shared = rows.withColumn("holders", F.count("*").over(by_key)).filter("holders > 1")
    tag = F.col("key").bitwiseAND(F.lit((1 << _TAG_BITS) - 1)).cast("int")
    spare = F.element_at(F.array(*[F.lit(b.spare) for b in bands]), tag + 1)
    in_doc = Window.partitionBy("doc_id", "tag").orderBy(F.desc("holders"), "key")
    # dealt by document once, for the window and the join
    cheap = (shared.repartition("doc_id").withColumn("tag", tag).withColumn("place", F.row_number().over(in_doc))
             .filter(F.col("place") > spare).select("key", "doc_id"))
    # and by key once
    links = written(cheap.repartition("key").distinct().withColumn("pivot", F.min("doc_id").over(by_key))
                    .withColumn("holders", F.count("*").over(by_key)).filter("holders > 1")
                    .select("key", "doc_id", "pivot"), "links")
    near = written(links.select("doc_id").distinct(), "near")
    # most documents share nothing: a bit field of fixed size keeps their texts out of the join's shuffle
    likely = maybe_in(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), near, "doc_id")
    texts = written(likely.join(near, "doc_id", "left_semi"), "texts")
    sketches = written(sets.select(F.col("doc_id").cast("long").alias("doc_id"), "n_shingles", *_SKETCH)
                       .join(near, "doc_id", "left_semi"), "sketches")
    side_a, side_b = _sketch(sketches, "a"), _sketch(sketches, "b")

    def check(pairs: DataFrame) -> DataFrame:
        likely = salted_join(pairs.join(side_b, "b"), side_a, ["a"], F.col("b")).filter(_may_link(percent)).select("a", "b")
        return written(verified(likely, texts, k, percent), "edges")

    # every document with the pivot it shares most keys with, then with its other pivots
    stars = written(links.filter("doc_id <> pivot").groupBy("doc_id", "pivot").agg(F.count("*").alias("common")), "stars")
    best = Window.partitionBy("doc_id").orderBy(F.desc("common"), "pivot")
    first = stars.withColumn("place", F.row_number().over(best)).filter("place = 1")
    found = [check(first.select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")))]
    groups = written(_groups(found), "groups")
    found.append(check(_apart(stars.select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")), groups)))
    groups = written(_groups(found), "groups")

    # what is left: documents of different components that share a key
    placed = (links.select("key", F.col("doc_id").alias("node")).join(groups, "node", "left")
              .select("key", "node", F.coalesce("component_id", "node").alias("g")))
    mixed = placed.groupBy("key").agg(F.min("g").alias("g0"), F.max("g").alias("g1")).filter("g0 <> g1").select("key")
    placed = written(placed.join(mixed, "key"), "placed")
    one = placed.select("key", F.col("g").alias("ga"), F.col("node").alias("a")).join(side_a, "a")
    other = placed.select("key", F.col("g").alias("gb"), F.col("node").alias("b")).join(side_b, "b")
    # the sketches are part of the join's condition, so pairs without a chance are not made
    rest = one.join(other, (one["key"] == other["key"]) & (F.col("ga") < F.col("gb")) & _may_link(percent))
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    found.append(written(verified(rest, texts, k, percent), "edges"))
    groups = _groups(found)

    # groups of leaders, then their copies
    places = (sets.withColumn("_id", F.col("doc_id").cast("long"))
              .join(copies.select(F.col("doc_id").alias("_id"), "leader"), "_id", "left")
              .withColumn("node", F.coalesce("leader", "_id")))
    out = salted_join(places, groups, ["node"], F.col("_id"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "node").alias("component_id"))


def _groups(found: list[DataFrame]) -> DataFrame:
    edges = reduce(DataFrame.unionByName, found)
    return components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")))


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs (a, b) not yet in one component."""
    a = groups.select(F.col("node").alias("a"), F.col("component_id").alias("ga"))
    b = groups.select(F.col("node").alias("b"), F.col("component_id").alias("gb"))
    both = salted_join(pairs.join(b, "b", "left"), a, ["a"], F.col("b"), "left")
    return both.filter(F.coalesce("ga", "a") != F.coalesce("gb", "b")).select("a", "b")
