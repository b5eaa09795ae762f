"""Benchmark decontamination by greedy string tiling.

A document is compared with the test items it shares a seed (SEED tokens in a row)
with. Tiles are found greedily: the longest run of tokens that the two have in common
and that no earlier tile has marked, found by Karp-Rabin window hashes, is marked in
both, again and again until no run of SEED tokens is left. The share of the item's tokens
under tiles decides, so passages that were cut up and reordered are caught too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotline.llm.common import FIELD_BITS, bit_field, written

#: Tokens of a seed, and the shortest tile.
SEED = 5
#: Share of an item's tokens that tiles must cover.
COVERAGE = 0.5
#: Words whose hashes a task remembers.
REMEMBERED = 300_000

_TOKEN = re.compile(r"[^\W_]+")
_BASE = 0x9E3779B97F4A7C15


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def tokens_of(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits."""
    return _TOKEN.findall(text.lower()) if text else []


def window_hashes(x: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hash of every window of ``n`` of the 64-bit values ``x``."""
    if len(x) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(x) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(_BASE) + x[i:len(x) - n + 1 + i]
    return out ^ (out >> np.uint64(29))


def rolling(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix hashes and powers from which :func:`window` reads any window's hash."""
    n = len(x)
    power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, _BASE, np.uint64)])
    # sum of x[i] * base**i, so a window's sum is a difference
    return np.r_[np.uint64(0), np.add.accumulate(x * power[:n])], power


def window(prefix: np.ndarray, power: np.ndarray, n: int, longest: int) -> np.ndarray:
    """Comparable hashes of all windows of ``n``: each is lifted to the same power."""
    count = len(prefix) - n
    return (prefix[n:] - prefix[:count]) * power[longest - 1:longest - 1 - count:-1] if count > 0 else np.empty(0, np.uint64)


def tile(item: list[str], doc: list[str], shortest: int = SEED) -> list[tuple[int, int, int]]:
    """Tiles (place in item, place in doc, length), longest first; ties go to the first
    place in the item, then in the document."""
    ids: dict[str, int] = {}
    p = np.array([ids.setdefault(t, len(ids) + 1) for t in item], np.uint64)
    t = np.array([ids.get(w, 0) for w in doc], np.uint64)
    p, t = p * np.uint64(0xD6E8FEB86659FD93), t * np.uint64(0xD6E8FEB86659FD93)
    longest = max(len(p), len(t)) + 1
    (pp, power), (tp, _) = rolling(np.r_[p, np.zeros(longest - len(p), np.uint64)]), rolling(np.r_[t, np.zeros(longest - len(t), np.uint64)])
    pp, tp = pp[:len(p) + 1], tp[:len(t) + 1]
    marked_p, marked_t = np.zeros(len(p), np.int64), np.zeros(len(t), np.int64)

    def common(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Free places in the item and the document that start equal windows."""
        free = []
        for marks in (marked_p, marked_t):
            c = np.r_[0, np.cumsum(marks)]
            free.append(np.flatnonzero(c[n:] == c[:len(c) - n]) if len(c) > n else np.empty(0, np.int64))
        hp, ht = window(pp, power, n, longest)[free[0]], window(tp, power, n, longest)[free[1]]
        return free[0][np.isin(hp, ht)], free[1][np.isin(ht, hp)], ht

    tiles, upper = [], min(len(p), len(t))
    while upper >= shortest:
        low, high, best = shortest, upper, 0
        while low <= high:  # a run of n holds runs of n - 1
            n = (low + high) // 2
            if len(common(n)[0]):
                best, low = n, n + 1
            else:
                high = n - 1
        if not best:
            break
        starts_p, starts_t, _ = common(best)
        places: dict[bytes, list[int]] = {}
        for j in starts_t.tolist()[::-1]:
            places.setdefault(t[j:j + best].tobytes(), []).append(j)
        done = False
        for i in starts_p.tolist():
            if marked_p[i:i + best].any():
                continue
            where = places.get(p[i:i + best].tobytes(), [])
            while where and marked_t[where[-1]:where[-1] + best].any():
                where.pop()
            if where:
                j = where.pop()
                marked_p[i:i + best], marked_t[j:j + best] = 1, 1
                tiles.append((i, j, best))
                done = True
        upper = best if done else best - 1
    return tiles


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """Pairs of a document and a test item that its tiles cover to ``coverage`` or more.

    ``docs``: doc_id, text; ``benchmark``: item_id, text; other columns are ignored.
    Returns doc_id, item_id, item_tokens, covered_tokens, tiles, coverage, one row per
    distinct pair. Null ids and null texts take no part, nor do items of fewer than SEED
    tokens (they have no seed). Repeated rows count once; where an id has several texts,
    the best covered one counts. Empty tables give no rows.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    item_type = benchmark.schema["item_id"].dataType.simpleString()

    def item_seeds(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        for pdf in frames:
            for item_id, text in zip(pdf["item_id"], pdf["text"], strict=True):
                words = tokens_of(text)
                h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
                seeds = window_hashes(h, SEED)  # one row per place
                if len(seeds):
                    yield pd.DataFrame({"seed": seeds.view(np.int64), "item_id": item_id, "item_tokens": len(words)})

    items = benchmark.select("item_id", "text").filter("item_id is not null and text is not null").distinct()
    seeds = written(items.mapInPandas(item_seeds, f"seed long, item_id {item_type}, item_tokens int"), "seeds")
    # the seed's unsigned value modulo a power of two is its lowest bits
    bits_shared = docs.sparkSession.sparkContext.broadcast(bit_field(seeds, F.col("seed")))

    def doc_seeds(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, filled = _Hashes(), bits_shared.value
        for pdf in frames:
            out = {"doc_id": [], "text": [], "seeds": []}
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                words = tokens_of(text)
                h = window_hashes(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)), SEED)
                at = h % np.uint64(FIELD_BITS)
                hit = (filled[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
                if hit.any():
                    out["doc_id"].append(doc_id)
                    out["text"].append(text)
                    out["seeds"].append(np.unique(h[hit.astype(bool)]).view(np.int64))
            if out["doc_id"]:
                yield pd.DataFrame(out)

    texts = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")
    hits = written(texts.mapInPandas(doc_seeds, f"doc_id {id_type}, text string, seeds array<long>"), "hits")
    # a place whose seed the document has covers SEED tokens at most, so n places cover SEED * n at most
    found = (hits.select("doc_id", F.explode("seeds").alias("seed")).distinct().join(seeds, "seed")
             .groupBy("doc_id", "item_id", "item_tokens").agg(F.count("*").alias("n")))
    found = found.filter(F.col("n") * SEED >= F.col("item_tokens") * coverage)
    return _tiled(found.select("doc_id", "item_id").distinct(), hits, items, id_type, item_type, coverage)


def _tiled(pairs: DataFrame, hits: DataFrame, items: DataFrame, id_type: str, item_type: str, coverage: float) -> DataFrame:
    def cover(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for doc_id, item_id, doc, item in zip(pdf["doc_id"], pdf["item_id"], pdf["text"], pdf["item_text"], strict=True):
                words = tokens_of(item)
                tiles = tile(words, tokens_of(doc))
                covered = sum(n for _, _, n in tiles)
                if covered >= coverage * len(words):
                    out.append((doc_id, item_id, len(words), covered, len(tiles), covered / len(words)))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "item_tokens", "covered_tokens", "tiles", "coverage"])

    wanted = items.select("item_id", F.col("text").alias("item_text"))
    rows = pairs.join(wanted, "item_id").join(hits.select("doc_id", "text").distinct(), "doc_id")
    out = rows.select("doc_id", "item_id", "text", "item_text").mapInPandas(
        cover, f"doc_id {id_type}, item_id {item_type}, item_tokens int, covered_tokens int, tiles int, coverage double")
    best = F.max(F.struct("coverage", "covered_tokens", "item_tokens", F.negative("tiles").alias("t"))).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "b.item_tokens", "b.covered_tokens", F.negative("b.t").alias("tiles"), "b.coverage")
