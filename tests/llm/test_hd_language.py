from __future__ import annotations

import random
import zlib

import pytest

from lotline.llm import hd_language as hd

SYLLABLES = {"aa": ["the", "ing", "ou", "sh", "wh"], "bb": ["ção", "lhe", "que", "ões"], "cc": ["sch", "ein", "ung", "öß"]}


def sentence(lang, rng, n=40):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    langs = list(SYLLABLES)
    return [(i, sentence(langs[i % 3], rng), langs[i % 3]) for i in range(240)]


def test_held_out_accuracy(frame, rows):
    df = frame([(*r, 0.5, "x") for r in rows], "doc_id long, text string, lang string, score double, code string")
    model = hd.fit(hd.training_rows(df))
    out = hd.predict(df.withColumn("held_out", hd.held_out()), model).collect()
    assert len(out) == len(rows) and set(out[0].asDict()) == {"doc_id", "text", "lang", "code", "held_out", "lang_pred", "score"}
    held = [r for r in out if r.held_out]
    assert {r.doc_id for r in held} == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.98
    assert all(0 < r.score <= 1 for r in out)


def test_odd_texts(frame, rows):
    model = hd.fit(frame(rows, "doc_id long, text string, lang string"))
    odd = [(1, None), (2, ""), (3, "12 $$ -- 34"), (4, "the"), (5, "x" * 200_000), (6, "中文字" * 5), (None, rows[0][1]), (6, "中文字" * 5)]
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in hd.predict(frame(odd, "doc_id long, text string"), model).collect()}
    assert all(got[k] == ("und", 0.0) for k in odd[:3])
    assert all(got[k][0] in SYLLABLES for k in odd[3:])
    assert got[None, rows[0][1]][0] == "aa"


def test_prototypes_do_not_depend_on_the_tasks(frame, rows):
    a = hd.fit(frame(rows, "doc_id long, text string, lang string", 1))
    b = hd.fit(frame(rows, "doc_id long, text string, lang string", 7))
    assert list(a) == list(b) and all((a[k] == b[k]).all() for k in a)


def test_brute_force_bundle():
    first, second, third = hd._letters()
    text, total = "ab ba", 0
    slots = [0, 1, 2, 0, 2, 1, 0]
    for x, y, z in zip(slots, slots[1:], slots[2:]):
        total = total + first[x].astype(int) * second[y] * third[z]
    assert (hd.bundle(*hd.trigrams(text)) == total).all()


def test_nothing_learned(frame):
    none = [(1, "text", None), (2, None, "aa"), (3, "123", "bb")]
    model = hd.fit(frame(none, "doc_id long, text string, lang string"))
    assert model == {}
    assert {r.lang_pred for r in hd.predict(frame(none, "doc_id long, text string, lang string"), model).collect()} == {"und"}
    assert hd.predict(frame([], "doc_id long, text string", 1), model).count() == 0
