from __future__ import annotations

import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lotline.llm import bpe, words

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
TOK = Tokenizer.from_file(PATH)

TEXTS = [None, "", " \n\t", "Hello, World! it's DON'T 12 3.14", "a<|endoftext|>b <|STARTOFTEXT|> <|startoftext|>",
         "é É é É H̱ ẖ ß ẞ İ ı ŉ Σας ΣΑΣ ǅ ﬁ Ｆｕｌｌ", "x y z\u0085w​q\x0b\x0cv\x1cw\x00n",
         "中文 テキスト 🙂🙂 👩‍👩‍👧", "≠ !̸= a̸", "''s 're 'RE ' s 'll'd'", "loooooong" * 3000, "a b " * 5000, "$$$ ### %%%&&& ---", "a'sé 'sß"]


def ids_of(text):
    return TOK.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", TEXTS)
def test_words_encode_as_the_text(text):
    assert [i for w in words.split(text) for i in ids_of(w)] == ids_of(text)


PARTS = st.lists(st.sampled_from([*"aAbZ sS'tT<|>\n\t\x0b\x0c.,9éÉßñŸſİ̸́Σ中ǅK", "<|endoftext|>", "\u00a0", "\x1c", "\x85"]), max_size=30)


@settings(max_examples=400, deadline=None)
@given(PARTS)
def test_words_encode_as_any_text(parts):
    text = "".join(parts)
    assert [i for w in words.split(text) for i in ids_of(w)] == ids_of(text)


ENCODER = words.Encoder(words.vocabulary(PATH))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), PARTS.map("".join)), max_size=6))
def test_columns_encode_as_their_texts(texts):
    got = [x.tolist() for x in ENCODER.texts(pa.array(texts, pa.string()))]
    assert got == [ids_of(t) for t in texts]


def test_a_column_of_odd_texts():
    assert [x.tolist() for x in ENCODER.texts(pa.array(TEXTS, pa.string()).slice(2))] == [ids_of(t) for t in TEXTS[2:]]


def test_round_trip_against_the_library(table):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", "x"), (3, TEXTS[3], "x")]
    got = bpe.encode_decode(table(rows, "doc_id long, text string, ids string"), PATH).collect()
    expect = []
    for i, t, _ in rows:
        e = ids_of(t)
        expect.append((i, struct.pack(f"<{len(e)}I", *e), len(e), TOK.decode(e, skip_special_tokens=False)))
    assert sorted(((r.doc_id, bytes(r.ids), r.n_tokens, r.decoded) for r in got), key=str) == sorted(expect, key=str)


def test_small_blocks_and_empty_table(spark, table):
    rows = [(i, f"word{i % 7} shared Shared {i}") for i in range(60)] + [(60, None), (61, " ")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        got = {r.doc_id: bytes(r.ids) for r in bpe.encode_decode(table(rows, "doc_id long, text string"), PATH).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {i: struct.pack(f"<{len(ids_of(t))}I", *ids_of(t)) for i, t in rows}
    assert bpe.encode_decode(table([], "doc_id long, text string"), PATH).count() == 0
    assert [(r.ids, r.decoded) for r in bpe.encode_decode(table([(1, None), (2, "")], "doc_id long, text string"), PATH).collect()] == [(b"", "")] * 2


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), PARTS.map("".join)), max_size=6))
def test_numbered_words_are_the_words(texts):
    names, codes, counts = words.numbered(pa.array(texts, pa.string()))
    assert len(set(names)) == len(names) and "" not in names
    at = 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        assert [i for c in codes[at:at + n] for i in ids_of(names[c])] == ids_of(text)
        at += n
    assert at == len(codes)


def test_a_changed_input_is_an_error():
    stream = pa.table({"stream": pa.array([], pa.binary())})
    with pytest.raises(ValueError, match="changed"):
        bpe.rebuilt(stream, pa.table({"place": [0], "ids": [b"ab"]}), "<u2")


def test_a_block_goes_out_in_small_batches():
    n = 2 * bpe.BATCH + 1
    codes = np.zeros(n, np.uint32)
    data = zstandard.ZstdCompressor().compress(codes.view(np.uint8).reshape(-1, 4).T[:3].tobytes())
    stream = pa.Table.from_pylist([{"stream": data, "n_words": n, "doc_ids": [None, *range(1, n)], "lengths": [1] * n}])
    run = zstandard.ZstdCompressor().compress(np.array([0], "<i4").tobytes() + np.array([2], "<u4").tobytes() + np.array([7, 1], "<u2").tobytes())
    out = bpe.rebuilt(stream, pa.table({"n": [1], "data": [run]}), "<u2", [str(i) for i in range(8)])
    assert [b.num_rows for b in out.to_batches()] == [bpe.BATCH, bpe.BATCH, 1]
    assert out.column("doc_id").to_pylist() == [None, *range(1, n)]
    assert set(out.column("ids").to_pylist()) == {np.array([7, 1], "<u4").tobytes()} and set(out.column("decoded").to_pylist()) == {"7 1"}


def test_distinct_words_encode_as_one_by_one():
    names = list(dict.fromkeys(w for t in TEXTS for w in words.split(t) if w))
    flat, lengths = ENCODER.distinct(names)
    assert lengths.tolist() == [len(ids_of(w)) for w in names]
    assert flat.tolist() == [i for w in names for i in ids_of(w)]
    assert [x.tolist() for x in ENCODER.distinct([])] == [[], []]


def test_tasks_of_a_worker_share_one_tokenizer(table, monkeypatch):
    # the library keeps the memory of each tokenizer that has encoded
    docs, steps, loads = table([(1, "some words")], "doc_id long, text string"), [], []
    step, load = type(docs).mapInArrow, words.load
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, f, schema: steps.append((f, schema)) or step(df, f, schema))
    bpe.encode(docs, PATH)
    encode_words = next(f for f, schema in steps if schema.endswith("n int, data binary"))
    monkeypatch.setattr(words, "load", lambda text: loads.append(1) or load(text))
    words._encoders.clear()
    at = pa.array([[{"block": 5, "place": 0}], [{"block": 5, "place": 1}, {"block": 6, "place": 0}]])
    for _ in range(3):
        runs = pa.Table.from_batches(encode_words(iter([pa.RecordBatch.from_pydict({"word": ["some", "\u00ddx\u4e2d"], "at": at})])))
        assert runs.column("block").to_pylist() == [5, 6]
        flat, starts, lengths = bpe.by_place(runs.slice(0, 1), "<u2")
        assert [flat[s:s + n].tolist() for s, n in zip(starts, lengths, strict=True)] == [ids_of("some"), ids_of("\u00ddx\u4e2d")]
    assert len(loads) == 1
