from __future__ import annotations

import struct
import zlib

import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from lotline.llm import seekable_ids as sk

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
TOK = Tokenizer.from_file(PATH)
SCHEMA = "doc_id long, text string, part string"


def expected(rows, end=(1,)):
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = TOK.encode(t or "", add_special_tokens=False).ids + list(end)
        out.append((i, start, len(ids), struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    return out


def test_round_trip(spark, frame, tmp_path):
    rows = [(i * 7 % 101, f"text number {i} " * (i % 5)) for i in range(101)] + [(500, None), (501, ""), (None, "none"), (7, "again"), (-4, "minus " * 3000)]
    path = str(tmp_path / "ids")
    sk.write(frame([(i, t, "x") for i, t in rows], SCHEMA), path, PATH)
    got = sk.read(spark, path).collect()
    key = lambda r: (r[1], str(r[0]))
    assert sorted(((r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in got), key=key) == sorted(expected(rows), key=key)
    some = sk.read(spark, path, only=[7, 500]).collect()
    assert sorted(r.doc_id for r in some) == [7, 7, 500]


def test_small_frames_and_files(spark, frame, tmp_path, monkeypatch):
    rows = [(i, f"w{i} " * 9) for i in range(80)]
    path = str(tmp_path / "ids")
    monkeypatch.setattr(sk, "FRAME_IDS", 30)
    monkeypatch.setattr(sk, "FILE_RECORDS", 4)
    sk.write(frame([(i, t, "x") for i, t in rows], SCHEMA), path, PATH, end_id=None)
    files = list((tmp_path / "ids").glob("part-*"))
    assert len(files) > 8
    got = sorted((r.start, r.doc_id, r.n_tokens, bytes(r.ids)) for r in sk.read(spark, path).collect())
    assert got == sorted((s, i, n, b) for i, s, n, b in expected(rows, ()))
    content = files[0].read_bytes()
    frames, docs = sk.read_table(content)
    offset, size, n, _ = frames[0]
    assert zstandard.ZstdDecompressor().decompress(content[offset:offset + size], max_output_size=4 * n) == sk.read_frame(content, frames[0])


def test_empty_table(spark, frame, tmp_path):
    path = str(tmp_path / "ids")
    sk.write(frame([], SCHEMA, 1), path, PATH)
    assert sk.read(spark, path).count() == 0


def test_damage_is_found():
    data = struct.pack("<3I", 1, 2, 3)
    frame = zstandard.compress(data)
    good = frame + b"\n" + sk.seek_table([(len(frame), 3, zlib.crc32(data))], [(5, 0, 0, 3)]) + b"\n"
    frames, docs = sk.read_table(good)
    assert sk.read_frame(good, frames[0]) == data and docs == [(5, 0, 0, 3)]
    with pytest.raises(ValueError, match="seek table"):
        sk.read_table(good[:-40] + bytes([good[-40] ^ 1]) + good[-39:])
    wrong = frame + b"\n" + sk.seek_table([(len(frame), 3, zlib.crc32(data) ^ 1)], []) + b"\n"
    with pytest.raises(ValueError, match="frame"):
        sk.read_frame(wrong, sk.read_table(wrong)[0][0])
    with pytest.raises(ValueError, match="not a seekable"):
        sk.read_table(b"x" * 100)
