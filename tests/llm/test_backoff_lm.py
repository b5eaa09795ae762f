from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lotline.llm import backoff_lm as lm


def words_of(text):
    return [w.decode() for w in (text or "").encode().lower().split()]


def brute(rows, learn):
    """n_tokens, n_known, N, base and automaton score by plain dictionaries."""
    texts = [words_of(t) + [None] for _, t in rows]
    c = Counter(w for t, f in zip(texts, learn) if f for w in t)
    n, v, k = sum(c.values()), len(c), sum(learn)
    f1, f2 = sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
    d = f1 / (f1 + 2 * f2) if f1 and f2 else 0.5
    states = {w for w in c if w is not None} | {"start"}
    total = {s: k if s == "start" else c[s] for s in states}
    arcs = Counter()
    for t, f in zip(texts, learn):
        for h, w in zip(["start", *t], t):
            if f and h in states and (w is None or w in states):
                arcs[h, w] += 1
    taken = Counter()
    for (h, _), x in arcs.items():
        taken[h] += x - lm.DISCOUNT
    out = []
    for (i, _), t in zip(rows, texts):
        score = base = 0.0
        for h, w in zip(["start", *t], t):
            base += math.log10((c[w] + 1) / (n + v + 1))
            if not n:
                continue
            p = (c[w] - d) / n if c[w] else d * v / n
            if h in states and total[h]:
                p = p * (total[h] - taken[h]) / total[h] + max(0, arcs.get((h, w), 0) - lm.DISCOUNT) / total[h]
            score += math.log10(p)
        out.append((i, len(t), sum(c[w] > 0 for w in t), n, base, score))
    return out


def check(table, rows, learn=None):
    learn = learn or [zlib.crc32(str(i).encode()) % 7 != 2 if i is not None else False for i, _ in rows]
    df = table([(*r, "x", f, 3) for r, f in zip(rows, learn)], "doc_id long, text string, word string, learn boolean, n int")
    from pyspark.sql import functions as F

    got = sorted(map(tuple, lm.score(df, F.col("learn")).collect()), key=str)
    want = sorted(brute(rows, learn), key=str)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for g, w in zip(got, want):
        assert g[4:] == pytest.approx(w[4:], rel=1e-9, abs=1e-12)


def corpus(n, seed=2):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    out = []
    for i in range(n):
        line, w = [], rng.choice(words)
        for _ in range(rng.randint(0, 40)):
            line.append(w.upper() if rng.random() < 0.1 else w)
            w = words[(words.index(w) + rng.choice([1, 1, 1, 5])) % 30] if rng.random() < 0.9 else f"rare{rng.randrange(400)}"
            if w not in words:
                line.append(w)
                w = rng.choice(words)
        out.append((i, rng.choice([" ", "\n", " \t"]).join(line)))
    return out


def test_matches_brute_force_and_learns(table):
    rows = corpus(160)
    check(table, rows)
    scores = brute(rows, [zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows])
    held = [s for s in scores if zlib.crc32(str(s[0]).encode()) % 7 == 2]
    assert sum(s[5] for s in held) > sum(s[4] for s in held)


def test_odd_rows(table):
    rows = corpus(40) + [(100, None), (101, ""), (102, " \x0b\n"), (None, "w1 w2 w3"), (103, "É é\x85x"), (104, "w1 w2 " * 5000), (5, "w1"), (5, "w1"), (105, "Unseen only")]
    check(table, rows)


@pytest.mark.parametrize("texts", [["a b"], ["a", "a"], ["a a b b c"], ["", None]])
def test_tiny_training(table, texts):
    check(table, list(enumerate(texts)), [True] * len(texts))


def test_no_training_and_empty(table, frame):
    check(table, [(1, "a b"), (2, None)], [False, False])
    from pyspark.sql import functions as F

    assert lm.score(table([], "doc_id long, text string"), F.lit(True)).count() == 0


def test_root_probabilities_sum_to_one():
    """Over the types of the base score: the known ones and one for all unseen."""
    counts = np.array([1] * 5 + [2] * 3 + [7, 9])
    root = lm.Root(int(counts.sum()), len(counts), 7, 5, 3)
    assert (10 ** root.log10(np.r_[counts, 0])).sum() == pytest.approx(1)
    assert (10 ** root.base_log10(np.r_[counts, 0])).sum() == pytest.approx(1)


def test_small_blocks(spark, table):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        check(table, corpus(60) + [(200, None), (201, " ")])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_numbered():
    texts = ["  A b\x0bB ", None, "", "\n", "É a\x85é"]
    names, codes, counts = lm.numbered(pa.array(texts, pa.string()))
    at, got = 0, []
    for n in counts.tolist():
        got.append([names[c] for c in codes[at:at + n]])
        at += n
    assert got == [words_of(t) for t in texts]


def test_rare_words_are_states(table):
    """Words far below 1/4,096 of the training tokens have arcs."""
    from pyspark.sql import functions as F

    rows = [(i, " ".join(f"r{j} s{j}" for j in range(i, i + 40))) for i in range(20)] + [(900, "w1 w2 " * 60_000)]
    learn = [True] * len(rows) + [False, False]
    rows += [(901, "r20 s20"), (902, "r20 s25")]
    check(table, rows, learn)
    df = table([(*r, f) for r, f in zip(rows, learn)], "doc_id long, text string, learn boolean")
    score = {r.doc_id: r.score for r in lm.score(df, F.col("learn")).filter("doc_id > 900").collect()}
    assert score[901] > score[902] + 1


@pytest.mark.parametrize("bucket", [50, 700])
def test_many_buckets(table, monkeypatch, bucket):
    monkeypatch.setattr(lm, "BUCKET", bucket)
    check(table, corpus(80) + [(200, None), (201, " ")])


def test_frequent_history_is_dealt_out():
    history, word = np.full(10_000, 7), np.arange(10_000)
    order, runs = lm._dealt(16, history, word)
    assert sorted(order.tolist()) == list(range(10_000)) and len(runs) == 16
    assert max(j - i for _, i, j in runs) < 1_000
