"""Blocks of texts, told as distinct words and as streams of word places.

A block is a run of a task's texts, cut at a number of bytes within its Arrow batches. Its
distinct words are numbered by first appearance (their place), so a table of words can be
joined back to every block that has them, and the block's texts are a compact stream of
places. The streams and the words come from separate reads of the texts: ``docs`` must
give the same rows in the same partitions each time (a table, a checkpoint). A block's
key holds a hash of its content, so a change between two reads is an error, not a wrong
result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext

from lotline.llm.words import slices, trim

STREAM_SCHEMA = ("block long, stream binary, n_words int, doc_ids array<long>, flags array<boolean>, "
                 "lengths array<int>")

#: Distinct words, the place of each word of the texts, and the number of words of each text.
Numbered = tuple[list, np.ndarray, np.ndarray]


@dataclass
class Block:
    key: int
    words: list
    codes: np.ndarray
    lengths: np.ndarray
    doc_ids: pa.Array
    flags: np.ndarray

    def flagged(self) -> np.ndarray:
        """Occurrences of each place in the flagged texts."""
        return np.bincount(self.codes[np.repeat(self.flags, self.lengths)], minlength=len(self.words))


#: Bytes of text in a block, about; a longer text is a block of its own. WORKED: of which so many
#: are split at a time, as that takes many times their size.
BLOCK_BYTES = 10_000_000
WORKED = 2_500_000


def _numbered(column: pa.Array, numbered: Callable[[pa.Array], Numbered]) -> Numbered:
    """``numbered`` of a block's texts, run by run."""
    places: dict = {}
    codes, lengths = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
    for part in slices(column, WORKED):
        words, some, n = numbered(part)
        here = np.fromiter((places.setdefault(w, len(places)) for w in words), np.uint32, len(words))
        codes.append(here[some])
        lengths.append(n)
        del words, some, n
    return list(places), np.concatenate(codes), np.concatenate(lengths)


def blocks(batches: Iterator[pa.RecordBatch], numbered: Callable[[pa.Array], Numbered], limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of a task's rows (doc_id, text and, if there is one, flag), cut at ``limit`` bytes of
    text whatever the size of Spark's batches."""
    part = TaskContext.get().partitionId()
    for n, batch in enumerate(batches):
        first = 0
        for k, texts in enumerate(slices(batch.column("text"), limit)):
            rows = batch.slice(first, len(texts))
            first += len(texts)
            words, codes, lengths = _numbered(texts, numbered)
            flags = (rows.column("flag").to_numpy(zero_copy_only=False).astype(bool) if "flag" in batch.schema.names
                     else np.ones(rows.num_rows, bool))
            content = xxhash.xxh3_64(f"{part}.{n}.{k}:{rows.column('doc_id').to_pylist()}")
            for x in (codes, lengths, flags):
                content.update(np.ascontiguousarray(x).tobytes())
            content.update("\0".join(words).encode("utf-8", "surrogatepass"))
            yield Block(content.intdigest() - (1 << 63), words, codes, lengths, rows.column("doc_id"), flags)
            trim()


def word_batches(block: Block, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (block, place, word, and the columns given by place)."""
    for i in range(0, len(block.words), 50_000):
        part = block.words[i:i + 50_000]
        n = len(part)
        yield pa.RecordBatch.from_pydict({
            "block": pa.array(np.full(n, block.key)), "place": pa.array(np.arange(i, i + n, dtype=np.int32)),
            "word": pa.array(part, pa.string()), **{k: pa.array(v[i:i + n]) for k, v in columns.items()}})


def stream_batch(block: Block) -> pa.RecordBatch:
    """The block's stream (STREAM_SCHEMA): the bytes of its places, lowest first."""
    # frequent words come early, so most high bytes are 0
    planes = block.codes.astype("<u4").view(np.uint8).reshape(-1, 4).T[:3 if len(block.words) < 1 << 24 else 4]
    data = zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())
    return pa.RecordBatch.from_pydict({
        "block": pa.array([block.key]), "stream": pa.array([data], pa.binary()), "n_words": pa.array([len(block.codes)], pa.int32()),
        "doc_ids": pa.array([block.doc_ids.to_pylist()], pa.list_(pa.int64())),
        "flags": pa.array([block.flags.tolist()], pa.list_(pa.bool_())),
        "lengths": pa.array([block.lengths.tolist()], pa.list_(pa.int32()))})


def unpack(stream: bytes, n_words: int) -> np.ndarray:
    """The places of a stream."""
    out = np.zeros(n_words, np.uint32)
    if n_words:
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(stream), np.uint8).reshape(-1, n_words)
        for i, plane in enumerate(planes):
            out |= plane.astype(np.uint32) << np.uint32(8 * i)
    return out
