from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from lotline.llm import partition_join as pj


def brute(rows, k, percent):
    """(doc_id, n_shingles, component) of every row, comparing all pairs with a common shingle."""
    sets = defaultdict(list)
    for i, t in rows:
        if i is not None:
            sets[i].append(pj.shingle_set(t, k))
    inverted, parent = defaultdict(list), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    flat = [(i, s) for i, ss in sets.items() for s in ss]
    for at, (_, s) in enumerate(flat):
        for e in s:
            inverted[e].append(at)
    for at, (i, s) in enumerate(flat):
        for other, common in Counter(o for e in s for o in inverted[e] if o < at).items():
            j, s2 = flat[other]
            if 100 * common >= percent * (len(s) + len(s2) - common):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return sorted([(i, len(pj.shingle_set(t, k)), None if i is None else root(i)) for i, t in rows], key=str)


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + [f"Rare{i}" for i in range(3000)]
    passage = rng.choices(vocabulary, k=60)
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.55:
            words = (rng.choice(rows)[1] or "x").split(" ")
            for _ in range(rng.choice([0, 1, 1, 2, 4, 9])):
                at = rng.randrange(len(words))
                words[at:at + rng.randint(0, 1)] = rng.choices(vocabulary, k=rng.randint(0, 1))
                words = words or ["x"]
        else:
            words = rng.choices(vocabulary, k=rng.choice([1, 2, 4, 12, 40, 150, 400]))
            if rng.random() < 0.4:
                at = rng.randrange(len(words) + 1)
                words[at:at] = passage
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("k, percent, seed", [(3, 90, 1), (5, 80, 2), (2, 60, 3)])
def test_matches_brute_force(table, k, percent, seed):
    rows = corpus(seed)
    got = pj.join_groups(table(rows, "doc_id long, text string"), k, percent)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, k, percent)


def test_odd_rows(table):
    long = " ".join(f"x{i}" for i in range(30_000))
    text = " ".join(f"a{i}" for i in range(40))
    rows = [(9, text), (4, text.upper()), (7, text.replace(" ", "\n\t")), (7, text.replace(" ", "\n\t")), (None, text), (1, None), (2, ""),
            (3, " \x0b\x0c "), (5, "two words"), (6, "Two  WORDS"), (8, long), (10, long + " end"), (11, "É é")]
    df = table([(*r, 1, "x") for r in rows], "doc_id long, text string, key int, leader string")
    got = sorted((tuple(r) for r in pj.join_groups(df, 3, 90).collect()), key=str)
    assert got == brute(rows, 3, 90)
    assert (9, 38, 4) in got and (6, 1, 5) in got and (10, 29_999, 8) in got


def test_hot_groups(table):
    """Many copies, many near copies of one text and a passage that most texts hold."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(300)]
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, "same text for all of these copies") for i in range(200)]
    for i in range(200, 400):
        words = list(base)
        words[rng.randrange(300)] = f"edit{i}"
        rows.append((i, " ".join(words)))
    rows += [(i, " ".join(f"u{i}_{j}" for j in range(30)) + " " + passage) for i in range(400, 600)]
    got = sorted((tuple(r) for r in pj.join_groups(table(rows, "doc_id long, text string"), 5, 80).collect()), key=str)
    assert got == brute(rows, 5, 80)


def test_empty(table):
    out = pj.join_groups(table([], "doc_id long, text string"))
    assert out.columns == ["doc_id", "n_shingles", "component_id"] and out.count() == 0


@pytest.mark.parametrize("percent", [60, 80, 90, 100])
def test_similar_sets_share_a_kept_key(percent):
    """The pigeonhole: a pair at the bound agrees on more keys than a set may leave out."""
    import numpy as np

    rng = np.random.default_rng(percent)
    edges = pj.band_edges(percent, 3000)
    for deletion in (False, True):
        for _ in range(60):
            n = int(rng.integers(1, 400))
            total = rng.integers(0, 2**63, 2 * n, dtype=np.int64).astype(np.uint64)
            most = 2 * n * (100 - percent) // (100 + percent)
            change = int(rng.integers(0, most // 2 + 1))
            a, b = np.unique(total[:n]), np.unique(total[change:n + change])
            common = len(np.intersect1d(a, b))
            if 100 * common < percent * (len(a) + len(b) - common) or (len(a) == len(b) and (a == b).all()):
                continue
            sets = {t: (10**9 if deletion else 1) for t in range(len(edges))}
            bands = pj.layouts(percent, edges, sets)
            shared = 0
            for t, band in enumerate(bands):
                in_a = edges[t] <= len(a) * 100 // percent and len(a) >= edges[t - 1] if t else len(a) < edges[1]
                if band.segments and in_a and len(a) * 100 // percent >= band.low and (t + 1 == len(edges) or len(a) < edges[t + 1]):
                    shared = max(shared, len(np.intersect1d(pj.keys_of(a, t, band), pj.keys_of(b, t, band))) - band.spare)
            assert shared > 0
