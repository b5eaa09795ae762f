from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from lotline.llm import common, structure_repair as sr

SCHEMA = "conv_id long, turn long, role string, text string, pos int, audit string"
SPACE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out: dict = {}
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        f = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if f == 0:
            continue
        text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
        role = "user" if f == 4 else role
        out.setdefault(c, []).extend([(t, role, text)] * (2 if f == 3 else 1))
    key = lambda x: (x[0] is not None, x[0] or 0, hashlib.sha256(f"{len(x[1].encode())}:{x[1]}{x[2]}".encode()).hexdigest())
    return {c: sorted(v, key=key) for c, v in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.rstrip(SPACE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, costs=sr.Costs(), inserts=2):
    """The least (cost, audit) with what it leaves, by trying every plan."""
    bad = faults(rows)
    best = None

    def go(i, made, used, cost, audit, lines):
        nonlocal best
        if not re.fullmatch("s?(ua)*u?", made):
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", made) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, lines)
        if used < inserts:
            for x, r in (("u", "user"), ("a", "assistant")):
                go(i, made + x, used + 1, cost + costs.insert, audit + "I", [*lines, r + ":"])
        if i == len(rows):
            return
        _, role, text = rows[i]
        go(i + 1, made, used, cost + costs.delete, audit + "D", lines)
        if bad[i] in ("", "truncated"):
            more = costs.truncated if bad[i] else 0
            go(i + 1, made + (role[:1] if role[:1] in ("s", "u", "a") else "?"), used, cost + more, audit + "K", [*lines, f"{role}:{text}"])
            for x, r in (("u", "user"), ("a", "assistant")):
                go(i + 1, made + x, used, cost + costs.rerole + more, audit + "R", [*lines, f"{r}:{text}"])

    go(0, "", 0, 0, "", [])
    return best


def expected(rows, costs=sr.Costs()):
    by, out = damaged(rows), []
    for c in {r[0] for r in rows}:
        own = by.get(c, [])
        bad, turns = faults(own), [t for t, _, _ in own if t is not None]
        cost, audit, lines = cheapest(own, costs)
        out.append((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[bad.count(x) for x in ("blank", "duplicate", "truncated")],
                    sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own)), cost, audit,
                    hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def query(df, costs=sr.Costs()):
    return sorted((tuple(r) for r in sr.repair(sr.damage(df), df, costs).collect()), key=str)


def made(n, seed, longest=6):
    rng = random.Random(seed)
    return [(c, rng.choice([t, t, t + 3, None]), rng.choice(["system", "user", "user", "assistant", "assistant", None, "", "tool"]),
             rng.choice(["Yes.", "No! ", "What?", "cut", "", " \n", None, "é. "]))
            for c in range(n) for t in range(rng.randrange(longest))]


@pytest.mark.parametrize("chunk, fan", [(256, 16), (2, 2)])
def test_matches_brute_force(table, monkeypatch, chunk, fan):
    monkeypatch.setattr(sr, "CHUNK", chunk)
    monkeypatch.setattr(sr, "FAN", fan)
    rows = made(60, 2)
    assert query(table([(*r, 1, "x") for r in rows], SCHEMA)) == expected(rows)


@pytest.mark.parametrize("chunk", [256, 2])
def test_insertions_where_they_are_cheap(table, monkeypatch, chunk):
    monkeypatch.setattr(sr, "CHUNK", chunk)
    costs = sr.Costs(rerole=4, delete=6, insert=1, truncated=1)
    rows = made(25, 3, 5)
    out = expected(rows, costs)
    assert any("I" in r[7] for r in out)
    assert query(table([(*r, 1, "x") for r in rows], SCHEMA), costs) == out


def test_no_insertion_is_ever_cheaper():
    for roles in itertools.product("sua", repeat=4):
        for ends in itertools.product((".", ""), repeat=4):
            rows = [(i, r, f"{i}x{e}") for i, (r, e) in enumerate(zip(roles, ends, strict=True))]
            assert "I" not in cheapest(rows)[1]


def test_odd_rows(table):
    rows = [(1, None, None, None), (1, None, "user", "a."), (2, 0, "user", "x" * 200_000 + "."), (2, 1, "assistant", "ok."), (None, 1, "user", "Hi."),
            (None, 2, "assistant", "Ho."), (5, 3, "user", "again."), (5, 3, "user", "again."), (7, 0, "user", " ")]
    assert query(table([(*r, 1, "x") for r in rows], SCHEMA)) == expected(rows)


def test_conversations_that_lose_all_rows(table):
    gone = [(c, 0) for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    out = query(table([(c, t, "user", "x.", 1, "x") for c, t in gone], SCHEMA))
    empty = hashlib.sha256(b"").hexdigest()
    assert out == sorted([(c, 0, 0, 0, 0, 0, 0, "", empty) for c, _ in gone], key=str)


def test_empty_table(table):
    assert query(table([], SCHEMA)) == []


def test_one_long_conversation(table, monkeypatch):
    """A third of all rows in one conversation: chunks give what one chunk gives, copies are found."""
    rows = [(1, t, "user" if t % 2 else "assistant", f"{t % 50}.") for t in range(600)] + made(40, 5)
    df = table([(*r, 1, "x") for r in rows], SCHEMA)
    whole = query(df)
    monkeypatch.setattr(sr, "CHUNK", 16)
    monkeypatch.setattr(sr, "FAN", 4)
    monkeypatch.setattr(common, "FEW_ROWS", 10)
    assert query(df) == whole
