from __future__ import annotations

import random

import numpy as np
import xxhash

from lotline.llm import ordinal_toxicity as tox

BAD = ["zork", "zorkel", "blip", "gnarf"]


def corpus(n=600, seed=4):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeimnorst", k=rng.randint(3, 8))) for _ in range(800)]
    docs, labels = [], []
    for i in range(n):
        text = rng.choices(words, k=rng.randint(20, 120))
        bad = i % 5 == 0
        for _ in range(rng.randint(1, 6) if bad else 0):
            text.insert(rng.randrange(len(text)), rng.choice(BAD) + rng.choice(["", "a", "ing", "."]))
        docs.append((i, " ".join(text)))
        if i % 3:
            labels.append((i, 1, int(bad)))
    return docs, labels


def test_held_out(frame):
    docs, labels = corpus()
    known = {i for i, _, _ in labels}
    df = frame([(*d, "x", 9) for d in docs], "doc_id long, text string, severity string, _id int")
    model = tox.fit(df, frame(labels, "doc_id long, quality int, toxic int"))
    assert model.thresholds[0] < model.thresholds[1]
    out = tox.predict(df, model).collect()
    held = [r for r in out if r.doc_id not in known]
    assert len(held) == 200
    caught = [r.toxic for r in held if r.doc_id % 5 == 0]
    clean = [r.toxic for r in held if r.doc_id % 5]
    assert sum(caught) >= 0.95 * len(caught) and sum(clean) <= 0.02 * len(clean)
    assert all(0 <= r.severity <= 2 and 0 <= r.p_toxic <= 1 and r.grade in (0, 1, 2) for r in out)
    # more marks, more severity
    few, many = tox.predict(frame([(1, "zork aa"), (2, "zork blip gnarf zorkel aa")], "doc_id long, text string", 1), model).orderBy("doc_id").collect()
    assert few.severity < many.severity


def test_odd_rows(frame):
    docs, labels = corpus(300)
    docs += [(1000, None), (1001, ""), (None, "zork"), (1002, "zork " * 20_000), (1, docs[1][1])]
    labels += [(None, 1, 1), (5, 1, None), (7, 1, 1), (7, 1, 0), (4, 1, 0), (4, 1, 0), (99_999, 0, 1)]
    model = tox.fit(frame(docs, "doc_id long, text string"), frame(labels, "doc_id long, quality int, toxic int"))
    got = tox.predict(frame(docs, "doc_id long, text string"), model).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got}
    assert not by[1000].toxic and not by[1001].toxic and by[None].toxic and by[1002].toxic
    assert by[1000].severity == by[1001].severity


def test_nothing_to_learn(frame):
    docs = frame([(1, "a b"), (2, "c")], "doc_id long, text string")
    for labels in ([], [(1, 1)], [(1, 0), (2, 0)], [(8, 1), (9, 0)]):
        model = tox.fit(docs, frame(labels, "doc_id long, toxic int", 1))
        assert model == tox.OrdinalModel()
        assert {(r.severity, r.toxic) for r in tox.predict(docs, model).collect()} == {(0.0, False)}
    assert tox.predict(frame([], "doc_id long, text string", 1), tox.OrdinalModel()).count() == 0


def test_gradient_reaches_the_order():
    """Grades that grow with the number of marks are fitted in that order."""
    rng = np.random.default_rng(0)

    class Row(dict):
        pass

    data = []
    for _ in range(300):
        k = int(rng.integers(0, 6))
        data.append(Row(toxic=k > 0, idx=sorted(rng.choice(6, k, replace=False).tolist()), marks=k))
    model = tox._optimise(data, [f"=w{i}" for i in range(6)])
    s = [model.severity(sum(sorted(model.weights.values())[:k]))[0] for k in range(7)]
    assert s == sorted(s) and s[0] < 0.5 < s[1] and s[6] > 1.5


def test_marks_of_a_small_language(frame):
    """A stem in under 3 % of the toxic documents, all of which share frequent word pairs, is still learned."""
    docs, labels = corpus(1500)
    rng = random.Random(8)
    other = ["".join(rng.choices("ghjklpquvwxyz", k=rng.randint(3, 8))) for _ in range(300)]
    # one word pair that all share has a smaller hash than their others
    pairs = min(("el " + "".join("abcdefghij"[int(c)] for c in str(i)) for i in range(20_000)), key=xxhash.xxh3_64_intdigest)
    known, held = [], []
    for i in range(5000, 5120):
        bad = i % 15 == 0
        text = f"{pairs} {' '.join(rng.choices(other, k=40))}{' bomentos' if bad else ''}"
        docs.append((i, text))
        (known if i < 5100 else held).append((i, 1, int(bad)))
    model = tox.fit(frame(docs, "doc_id long, text string"), frame(labels + known, "doc_id long, quality int, toxic int"))
    assert any(f.startswith("<boment") for f in model.weights)
    out = {r.doc_id: r.toxic for r in tox.predict(frame([d for d in docs if d[0] >= 5100], "doc_id long, text string"), model).collect()}
    assert all(out[i] == bool(bad) for i, _, bad in held)


def test_copy_key_needs_more_than_one_pair():
    rng = random.Random(3)
    texts = [["el", "la"] * 5 + [f"w{rng.randrange(10**6)}" for _ in range(50)] for _ in range(50)]
    assert len({tox.copy_key(t) for t in texts}) == 50
    assert tox.copy_key(["a"]) != tox.copy_key(["b"])
