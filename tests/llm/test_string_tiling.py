from __future__ import annotations

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lotline.llm import string_tiling as tiling


def brute(item, doc, shortest):
    """Greedy tiling by comparing every pair of places."""
    mp, mt, tiles = [False] * len(item), [False] * len(doc), []
    while True:
        best, matches = shortest - 1, []
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not mp[i + n] and not mt[j + n]:
                    n += 1
                if n > best:
                    best, matches = n, [(i, j)]
                elif n == best and n >= shortest:
                    matches.append((i, j))
        if not matches:
            return tiles
        for i, j in matches:
            if not any(mp[i:i + best]) and not any(mt[j:j + best]):
                mp[i:i + best], mt[j:j + best] = [True] * best, [True] * best
                tiles.append((i, j, best))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=14), st.lists(st.sampled_from("abc"), max_size=18), st.integers(1, 4))
def test_tiles_match_brute_force(item, doc, shortest):
    assert tiling.tile(item, doc, shortest) == brute(item, doc, shortest)


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def test_finds_whole_cut_and_reordered_passages(frame):
    rng = random.Random(5)
    items = [(i, words(rng, 40)) for i in range(20)]
    a, b, c = items[3][1], items[4][1], items[5][1]
    docs = [(1, words(rng, 50) + a + words(rng, 50)), (2, words(rng, 80)), (3, b[20:] + words(rng, 30) + b[:20]),
            (4, c[:12] + words(rng, 30)), (5, [w.upper() + "," for w in a]), (6, a + b), (1, words(rng, 50) + a)]
    rows = [(i, " ".join(w), 1, "x") for i, w in docs] + [(7, None, 1, ""), (8, "", 1, ""), (None, " ".join(a), 1, ""), (9, " ".join(a * 400), 1, "")]
    bench = [(i, " ".join(w), 2) for i, w in items] + [(100, None, 2), (101, "too short here", 2), (None, " ".join(a), 2), (102, "", 2), (3, " ".join(a), 2)]
    got = tiling.contaminated(frame(rows, "doc_id long, text string, seed int, item_id string"), frame(bench, "item_id long, text string, seeds int"))
    found = {(r.doc_id, r.item_id): (r.covered_tokens, r.tiles, r.coverage) for r in got.collect()}
    assert found == {(1, 3): (40, 1, 1.0), (3, 4): (40, 2, 1.0), (5, 3): (40, 1, 1.0), (6, 3): (40, 1, 1.0), (6, 4): (40, 1, 1.0), (9, 3): (40, 1, 1.0)}


def test_coverage_threshold(frame):
    rng = random.Random(6)
    item = words(rng, 40)
    docs = [(n, " ".join(words(rng, 10) + item[:n] + words(rng, 10))) for n in (4, 5, 19, 20, 21, 40)]
    bench = frame([(1, " ".join(item))], "item_id long, text string", 1)
    df = frame(docs, "doc_id long, text string")
    assert {r.doc_id for r in tiling.contaminated(df, bench).collect()} == {20, 21, 40}
    assert {r.doc_id: r.covered_tokens for r in tiling.contaminated(df, bench, coverage=0.0).collect()} == {5: 5, 19: 19, 20: 20, 21: 21, 40: 40}


def test_repetitive_item(frame):
    docs = frame([(1, "a " * 12), (2, "a " * 300), (3, "b " * 30)], "doc_id long, text string")
    got = tiling.contaminated(docs, frame([(1, "a " * 24)], "item_id long, text string", 1)).collect()
    assert {(r.doc_id, r.covered_tokens) for r in got} == {(1, 12), (2, 24)}


def test_empty_tables(frame):
    docs, bench = frame([(1, "a b c d e f")], "doc_id long, text string"), frame([(1, "a b c d e f")], "item_id long, text string", 1)
    none = frame([], "doc_id long, text string", 1)
    assert tiling.contaminated(none, bench).count() == 0
    assert tiling.contaminated(docs, frame([], "item_id long, text string", 1)).count() == 0
    assert tiling.contaminated(docs, bench).count() == 1
