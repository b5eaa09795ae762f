from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from hashlib import md5

from lotline.llm import interleave_shards as sh

SCHEMA = "doc_id long, text string, source string, prefix int, shard string"


def brute(rows, shards):
    """(doc_id, source, size, crc, shard, slot) by sorting everything in one list."""
    items = defaultdict(list)
    for i, text, source in rows:
        raw = (text or "").encode()
        key = md5(f"lot:{'' if i is None else i}".encode()).hexdigest()
        order = (int(key[:4], 16) % sh.PREFIXES, key, i is not None, i or 0, len(raw) + 1, zlib.crc32(raw))
        items["" if source is None else "=" + source].append((order, i, source, len(raw) + 1, zlib.crc32(raw)))
    line = []
    for stratum, rs in items.items():
        for k, (order, *rest) in enumerate(sorted(rs, key=lambda r: r[0]), 1):
            line.append(((float(Fraction(2 * k - 1, 2 * len(rs))), order[1], stratum, order[2:]), rest))
    line.sort(key=lambda r: r[0])
    n = len(line)
    return [(*rest, at * shards // n, at - (at * shards // n * n + shards - 1) // shards) for at, (_, rest) in enumerate(line)]


def check(frame, rows, shards=8):
    got = sh.interleave(frame([(*r, 1, "x") for r in rows], SCHEMA), shards=shards).collect()
    plain = sorted(((r.doc_id, r.source, r.size, r.text_crc32, r.shard, r.slot) for r in got), key=str)
    assert plain == sorted(brute(rows, shards), key=str)
    assert {(r.law, r.grown_shard) for r in got} <= {("rows", None)}
    sizes = Counter(r.shard for r in got)
    if len(rows) >= shards:
        assert len(sizes) == shards and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    return got


def test_matches_brute_force_and_mixture(frame):
    rows = [(i, f"t{i}é", "big" if i % 3 else f"s{i % 7}") for i in range(500)]
    got = check(frame, rows)
    big = Counter(r.shard for r in got if r.source == "big")
    assert max(big.values()) - min(big.values()) <= 8


def test_nulls_ties_repeats(frame):
    rows = [(1, None, None), (1, "", None), (None, None, None), (2, "x", ""), (2, "x", ""), (2, "x", ""), (3, "long " * 9000, "a")]
    check(frame, rows)
    check(frame, rows, shards=2)


def test_one_source_and_empty(frame):
    check(frame, [(i, "same", "only") for i in range(100)])
    assert sh.interleave(frame([], SCHEMA, 1)).count() == 0


def test_many_sources_of_one_row_mix(frame):
    """All of them have the fractional rank 1/2: their hashes deal them over the shards, beside a large source."""
    rows = [(i, "t", f"host{i}" if i % 2 else "big") for i in range(800)]
    got = check(frame, rows)
    middle = [r.shard for r in got if r.source != "big"]
    assert len(set(middle)) >= 4
    names = sorted((r.source, r.shard) for r in got if r.source != "big")
    assert [s for _, s in names] != sorted(s for _, s in names)
