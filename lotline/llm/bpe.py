"""BPE encoding and decoding through a distinct-word table.

Texts are split into words task by task and told in blocks: the distinct words of a
block, one row each, and its stream of word places. Words are grouped over all blocks,
each distinct word is encoded once, and its ids go back to every block that has it, where
they are joined to the stream by place. Decoding looks ids up in the id-to-piece table,
which is broadcast (it is the vocabulary): a look-up by row number in place of a join, as
a join would make a row of each token.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotline.llm import words
from lotline.llm.blocks import STREAM_SCHEMA, blocks, stream_batch, unpack, word_batches


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, words.numbered):
        yield from word_batches(block)


def _stream_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, words.numbered):
        yield stream_batch(block)


#: Words of blocks that a task holds before it packs them.
RUN = 500_000
_RUN = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("data", pa.binary())])


def _runs(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Rows (block, n, data): the places of a block's words (as steps), how many ids each has, and the ids."""
    block, place, lengths = (np.concatenate([h[i] for h in held]) for i in range(3))
    flat = np.concatenate([h[3] for h in held])
    order = np.lexsort((place, block))
    starts = np.cumsum(lengths) - lengths
    block, place, flat, lengths = block[order], place[order], words.gather(flat, starts[order], lengths[order]), lengths[order]
    first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.empty(0, np.int64)
    last, ends = np.r_[first[1:], len(block)], np.r_[0, np.cumsum(lengths)]
    pack = zstandard.ZstdCompressor(level=3).compress
    data = [pack(np.diff(place[i:j], prepend=0).astype("<i4").tobytes() + lengths[i:j].astype("<u4").tobytes() + flat[ends[i]:ends[j]].tobytes())
            for i, j in zip(first.tolist(), last.tolist(), strict=True)] if len(block) else []
    return pa.RecordBatch.from_pydict({"block": block[first], "n": (last - first if len(block) else first).astype(np.int32), "data": data}, _RUN)


def encoded_words(batches: Iterator[pa.RecordBatch], encoder: words.Encoder, width: str) -> Iterator[pa.RecordBatch]:
    """The ids of distinct words (word, at: block and place) as runs for the blocks that have them."""
    held, size = [], 0
    for batch in batches:
        flat, lengths = encoder.distinct(batch.column("word").to_pylist())
        flat, starts = flat.astype(width), np.cumsum(lengths) - lengths
        at = batch.column("at")
        word = np.repeat(np.arange(len(lengths)), at.value_lengths().to_numpy(zero_copy_only=False))
        spots = at.flatten()
        held.append((spots.field("block").to_numpy(), spots.field("place").to_numpy(), lengths[word], words.gather(flat, starts[word], lengths[word])))
        size += len(word)
        if size >= RUN:
            yield _runs(held)
            held, size = [], 0
            words.trim()
    if held:
        yield _runs(held)
    words.trim()


def by_place(found: pa.Table, width: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's words from their runs: the ids, and by place where a word's begin and how many it has."""
    places, counts, flat = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, width)]
    for n, data in zip(found.column("n").to_pylist(), found.column("data").to_pylist(), strict=True):
        raw = zstandard.ZstdDecompressor().decompress(data)
        places.append(np.cumsum(np.frombuffer(raw, "<i4", n), dtype=np.int64))
        counts.append(np.frombuffer(raw, "<u4", n, 4 * n).astype(np.int64))
        flat.append(np.frombuffer(raw, width, int(counts[-1].sum()), 8 * n))
    place, lengths = np.concatenate(places), np.concatenate(counts)
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(place)
    if not np.array_equal(place[order], np.arange(len(place))):
        raise ValueError("a block's words and those that came back differ")
    return np.concatenate(flat).astype("<u4"), starts[order], lengths[order]


#: Texts in a batch of rebuilt ones: a block goes out in many, of which each is held by itself.
BATCH = 200


def rebuilt(stream: pa.Table, found: pa.Table, width: str, table: list[str] | None = None) -> pa.Table:
    """The ids of a block's documents from its stream and its words' ids (by place), and with a
    ``table`` of pieces what they stand for, in batches of BATCH."""
    if not stream.num_rows:
        raise ValueError("words of a block without its texts: the input changed between two reads")
    flat, starts, lengths = by_place(found, width)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), *[("decoded", pa.string())] * (table is not None)])
    batches = []
    for s in stream.to_pylist():
        codes = unpack(s["stream"], s["n_words"])
        per_text = np.array(s["lengths"], np.int64)
        ends = np.r_[0, np.cumsum(per_text)]
        for i in range(0, len(per_text), BATCH):
            last = min(len(per_text), i + BATCH)
            some = codes[ends[i]:ends[last]]
            data = words.gather(flat, starts[some], lengths[some])
            ids_before = (4 * np.r_[0, np.cumsum(lengths[some])][ends[i:last + 1] - ends[i]]).astype(np.int32)
            ids = pa.Array.from_buffers(pa.binary(), last - i, [None, pa.py_buffer(ids_before), pa.py_buffer(data)])
            batches.append(pa.RecordBatch.from_arrays([pa.array(s["doc_ids"][i:last], pa.int64()), ids, *([_texts(ids, table)] if table is not None else [])], schema=schema))
    words.trim()
    return pa.Table.from_batches(batches, schema)


def _texts(ids: pa.Array, table: list[str]) -> pa.Array:
    """What each row's ids stand for: their pieces, put together with blanks."""
    out = []
    for i in range(0, len(ids), 500):
        found = [" ".join([table[j] for j in np.frombuffer(x or b"", "<u4").tolist()]) for x in ids.slice(i, 500).to_pylist()]
        out.append(pa.array(found, pa.string()))
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Token ids of every row of ``docs`` (doc_id, text).

    Returns doc_id (long), ids (binary: little-endian unsigned 32-bit), n_tokens. Null and
    empty texts have no ids; a null doc_id is kept; repeated rows each give a row; other
    columns are ignored. ``docs`` is read twice and must give the same rows in the same
    partitions both times (a table, a checkpoint); otherwise the job fails.
    """
    return _encoded(docs, tokenizer_path, with_text=False)


def _encoded(docs: DataFrame, tokenizer_path: str, with_text: bool) -> DataFrame:
    """:func:`encode`; ``with_text``: also ``decoded``, in the step that has the ids at hand."""
    text = words.vocabulary(tokenizer_path)
    vocabulary = docs.sparkSession.sparkContext.broadcast(text)
    pieces = words.pieces(text)
    width = "<u2" if len(pieces) <= 1 << 16 else "<u4"
    table = docs.sparkSession.sparkContext.broadcast(pieces) if with_text else None

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from encoded_words(batches, words.encoder(vocabulary.value), width)

    def join(stream: pa.Table, found: pa.Table) -> pa.Table:
        return rebuilt(stream, found, width, table.value if table is not None else None)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    told = rows.mapInArrow(_word_rows, "block long, place int, word string")
    # one row per distinct word; its list is at most one entry per block
    distinct = told.groupBy("word").agg(F.collect_list(F.struct("block", "place")).alias("at"))
    placed = distinct.mapInArrow(encode_words, "block long, n int, data binary")
    streams = rows.mapInArrow(_stream_rows, STREAM_SCHEMA)
    out = streams.groupBy("block").cogroup(placed.groupBy("block")).applyInArrow(join, "doc_id long, ids binary" + ", decoded string" * with_text)
    return out.select("doc_id", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), *["decoded"] * with_text)


def decode(tokens: DataFrame, tokenizer_path: str) -> DataFrame:
    """``tokens`` (doc_id, ids as :func:`encode` gives them; other columns are dropped) with
    ``decoded``: the ids looked up in the id-to-piece table, which is broadcast, the pieces
    put together with blanks, as the tokenizer, which has no decoder step, puts them.
    Null ids count as none; an id that the table lacks is an error."""
    pieces = tokens.sparkSession.sparkContext.broadcast(words.pieces(words.vocabulary(tokenizer_path)))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 5000):
                part = batch.slice(i, 5000)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "ids": part.column("ids"), "decoded": _texts(part.column("ids"), pieces.value)})
            words.trim()

    rows = tokens.select(F.col("doc_id").cast("long").alias("doc_id"), "ids")
    return rows.mapInArrow(join, "doc_id long, ids binary, decoded string")


def encode_decode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Both: doc_id, ids, n_tokens, decoded, one row per row of ``docs``."""
    return _encoded(docs, tokenizer_path, with_text=True)
