from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from lotline.llm import common, prefix_trie, turns

SCHEMA = "conv_id long, turn long, role string, text string, pos int, digest string"


def numbered(rows):
    """Turns of every conversation, in order."""
    out: dict = {}
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            out.setdefault(c, []).append((t is not None, t or 0, key, role, text))
    return {c: [x[3:] for x in sorted(v)] for c, v in out.items()}


def rebuilt(rows):
    by = numbered(rows)
    out = {}
    for c, own in by.items():
        h = zlib.crc32(str(c).encode()) % 9
        rest = abs(c) % 5 * (1 if c >= 0 else -1)
        out[c] = by.get(c - rest, [])[:h] + own[h:]
    return out


def brute(convs):
    members: dict = {}
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    kids: dict = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = []
    for p, ids in members.items():
        below = [q for q in members if q[:len(p)] == p]
        ends = ",".join(map(str, sorted(c for c in ids if len(convs[c]) == len(p))))
        out.append((min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), len(kids.get(p, [])), sum(q not in kids for q in below),
                    sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def query(df):
    return sorted((tuple(r) for r in prefix_trie.trie(*prefix_trie.rebuilt(df)).collect()), key=str)


def made(n, seed, longest=12, words="ab"):
    rng = random.Random(seed)
    rows = []
    for c in range(-6, n):
        for t in range(rng.randrange(longest)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice([*words, None, "é" * 3])))
    return rows


def frame_rows(rows):
    return [(*r, 1, "x") for r in rows]


@pytest.mark.parametrize("block, fan, chunk", [(8, 16, 1024), (2, 2, 3)])
def test_matches_brute_force(table, monkeypatch, block, fan, chunk):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "FAN", fan)
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    rows = made(30, 1)
    # one conversation with a third of all rows and one that repeats it for long
    rows += [(40, t, "user", f"turn {t}") for t in range(90)] + [(44, t, "user", f"turn {t}" if t < 70 else "other") for t in range(80)]
    assert query(table(frame_rows(rows), SCHEMA)) == brute(rebuilt(rows))


def test_odd_rows(table):
    """Nulls, ties, repeated rows, an id without a base, ids that take nothing, a null id, a long text."""
    rows = [(3, None, "user", "x"), (3, None, "user", "x"), (3, 1, None, None), (3, 1, "", ""), (3, 1, "user", "a"), (None, 1, "user", "lost"),
            (9, 5, "user", "y" * 100_000), (13, 0, "user", "x"), (10, 0, "assistant", "z"), (11, 0, "u", "ser:"), (12, 0, "us", "er:")]
    assert query(table(frame_rows(rows), SCHEMA)) == brute(rebuilt(rows))


def test_empty_table(table):
    assert query(table([], SCHEMA)) == []


def test_hot_openings_and_copies_are_dealt(table, monkeypatch):
    monkeypatch.setattr(common, "FEW_ROWS", 20)
    monkeypatch.setattr(prefix_trie, "PIECE", 64)
    rows = [(c, t, "user", "same" if t < 4 or c % 3 == 0 else f"{c}:{t}") for c in range(0, 600, 5) for t in range(9)]
    assert query(table(frame_rows(rows), SCHEMA)) == brute(rebuilt(rows))


def test_numbers_run_over_parts(table):
    rows = [(c, t, "user", "x") for c in (1, 2, None) for t in [None, None, *range(40)]]
    df = table(frame_rows(rows), SCHEMA).select("conv_id", "turn")
    out = turns.numbered(df, "conv_id", df["turn"].asc_nulls_first()).collect()
    for c in (1, 2, None):
        mine = sorted((r.pos, r.turn) for r in out if r.conv_id == c)
        assert [p for p, _ in mine] == list(range(1, 43)) and [t for _, t in mine] == [None, None, *range(40)]
