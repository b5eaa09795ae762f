from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotline.llm import exact_dedup as ed
from lotline.llm import fuse_filter

SCHEMA = "doc_id long, text string, digest string, norm string, cls string"


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def expected(rows):
    groups: dict = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((i, t))
    out = []
    for key, members in groups.items():
        order = sorted(members, key=lambda m: (-len(m[1] or ""), m[0] is None, m[0] or 0))
        for n, (i, _) in enumerate(order):
            out.append((i, order[0][0], len(members), n == 0, hashlib.sha256(key.encode()).hexdigest()))
    return sorted(map(repr, out))


def got(df):
    return sorted(repr((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)) for r in df.collect())


ROWS = ([(i, f"text {i % 17} of the set") for i in range(60)] + [(100, None), (101, ""), (102, " \t\r\n\x0b\x0c"), (103, "a b"), (104, "ab"), (105, "a b"),
         (7, "text 7 of the set"), (7, "text 7 of the set"), (7, "some other"), (None, "some other"), (None, "alone"), (-5, "long " * 20_000), (2**62, "long" * 20_000)])


@pytest.mark.parametrize("batches", [1, 3])
def test_groups_are_those_of_brute_force(table, batches):
    docs = table([(i, t, "x", "y", "z") for i, t in ROWS], SCHEMA)
    assert got(ed.dedup(docs, batches)) == expected(ROWS)


def test_unlike_texts_of_one_digest_stay_apart(table):
    """Two digests for all texts: the filters let everything pass, the bytes decide."""
    rows = [(i, t) for i, t in ROWS if i is None or i < 1000]
    weak = lambda c: F.pmod(F.xxhash64(c), F.lit(2))
    assert got(ed.dedup(table([(i, t, "x", "y", "z") for i, t in rows], SCHEMA), 3, weak)) == expected(rows)


def test_hot_text_is_dealt(table, monkeypatch):
    from lotline.llm import common

    monkeypatch.setattr(common, "FEW_ROWS", 50)
    rows = [(i, "hot" if i % 3 else f"t{i}") for i in range(900)]
    assert got(ed.dedup(table([(i, t, "x", "y", "z") for i, t in rows], SCHEMA), 2)) == expected(rows)


def test_empty_table(table):
    assert ed.dedup(table([], SCHEMA)).collect() == []


def test_known_texts_are_those_of_earlier_snapshots(table):
    store = ed.Store()
    first = ed.ingest(store, table([(1, "a b"), (2, "c"), (3, "ab")], "doc_id long, text string"), "one")
    assert {r.known for r in first.collect()} == {False}
    second = ed.ingest(store, table([(4, "ab "), (5, "d"), (6, "d")], "doc_id long, text string"), "two")
    rows = {r.doc_id: r for r in second.collect()}
    assert [rows[i].known for i in (4, 5, 6)] == [True, False, False]
    assert rows[4].cls == first.filter("doc_id = 3").first().cls and rows[5].cls == rows[6].cls
    assert [s.texts.count() for s in store.snapshots] == [2, 1]


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 60_000])
def test_filter_holds_every_key_and_few_others(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(-(1 << 63), 1 << 63, n, dtype=np.int64)
    f = fuse_filter.build(keys)
    assert f.maybe(keys).all()
    others = rng.integers(-(1 << 63), 1 << 63, 50_000, dtype=np.int64)
    assert f.maybe(others).mean() < (0.006 if n else 1e-9)
    assert n < 10_000 or len(f.prints) * 8 <= 11 * n  # small sets have more room, by the published rule


def test_filter_of_repeated_and_near_keys():
    keys = np.array([5, 5, 6, 7, 8, -1, 0], np.int64)
    assert fuse_filter.build(keys).maybe(keys).all()
