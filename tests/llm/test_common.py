from __future__ import annotations

import random

import pytest

from lotline.llm import common
from lotline.llm.common import components


def brute(edges):
    near = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = {}
    for n in sorted(near):
        if n not in out:
            todo = [n]
            while todo:
                x = todo.pop()
                if x not in out:
                    out[x] = n
                    todo += near[x]
    return out


@pytest.mark.parametrize("edges", [
    [], [(1, 1), (None, 2), (3, None)], [(1, 2), (2, 1), (1, 2)],
    [(i, i + 1) for i in range(200)],
    [(0, i) for i in range(1, 300)] + [(500, i) for i in range(501, 800)] + [(300, 700)],
    [(random.Random(i).randrange(400), random.Random(-i).randrange(400)) for i in range(300)],
])
def test_components(frame, edges):
    got = {r.node: r.component_id for r in components(frame(edges, "src long, dst long")).collect()}
    assert got == brute(edges)


def test_bit_field_and_filter(frame):
    from pyspark.sql import functions as F

    rng = random.Random(7)
    values = [rng.randrange(-2**63, 2**63) for _ in range(3000)] + [0, -1, common.FIELD_BITS, common.FIELD_BITS - 1]
    bits = common.bit_field(frame([(v,) for v in values], "v long"), F.col("v"))
    at = {v % common.FIELD_BITS for v in values}
    assert all(bits[a >> 3] >> (a & 7) & 1 for a in at)
    assert sum(int(x).bit_count() for x in bits[bits > 0]) == len(at)
    many = frame([(v,) for v in range(-5000, 5000)], "v long")
    some = frame([(v,) for v in range(0, 5000, 7)], "v long")
    got = {r.v for r in common.maybe_in(many, some, "v").collect()}
    assert set(range(0, 5000, 7)) <= got and len(got) < 800
