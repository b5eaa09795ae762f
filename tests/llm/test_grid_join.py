from __future__ import annotations

import numpy as np
import pytest

from lotline.llm import grid_join


def brute(rows, threshold):
    ids = [i for i, _ in rows]
    ok = [v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v) and i is not None for i, v in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if o else None for (_, v), o in zip(rows, ok)]
    n, comp = [0] * len(rows), list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(len(rows)):
            if a != b and ok[a] and ok[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                n[a] += 1
                x, y = comp[a], comp[b]
                comp = [x if c == y else c for c in comp]
    out = []
    for a, i in enumerate(ids):
        members = [ids[b] for b in range(len(rows)) if comp[b] == comp[a]]
        c = min(members) if ok[a] else i
        out.append((i, n[a], c, i == c))
    return sorted(out, key=str)


def vectors(seed, n=150, d=6):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        base = np.random.default_rng(seed + i % 40).normal(size=d)
        rows.append((i, [float(np.float32(x)) for x in base + rng.normal(size=d) * rng.choice([0.0, 0.1, 0.3])]))
    return rows


@pytest.mark.parametrize("interval, block", [(4096, 512), (20, 4)])
def test_matches_brute_force(frame, monkeypatch, interval, block):
    # workers get the compared sizes by value through the functions' globals, so set them there too
    monkeypatch.setattr(grid_join, "INTERVAL", interval)
    monkeypatch.setattr(grid_join, "BLOCK", block)
    rows = vectors(5)
    rows += [(1000, None), (1001, []), (1002, [0.0] * 6), (1003, [1.0, None, 0.0, 0.0, 0.0, 0.0]),
             (1004, [float("nan")] * 6), (1005, [float("inf")] + [0.0] * 5), (None, rows[0][1]),
             (1006, rows[3][1]), (1007, [2 * x for x in rows[3][1]]), (1008, [1.0, 0.0]), (1009, [0.9, 0.1]), (3, rows[3][1])]
    df = frame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, node int, links string")
    got = sorted((tuple(r) for r in grid_join.link(df).collect()), key=str)
    assert got == brute(rows, 0.9)


def test_group_of_near_copies_and_empty_table(frame):
    base = np.random.default_rng(1).normal(size=8)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in base + rng.normal(size=8) * 0.01]) for i in range(700)]
    got = grid_join.link(frame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(699, 0)}
    empty = grid_join.link(frame([], "vec_id long, embedding array<float>", 1))
    assert empty.columns == ["vec_id", "n_links", "component_id", "kept"] and empty.count() == 0
