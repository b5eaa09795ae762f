"""Token-id files of independent zstandard frames with a trailing seek table.

A file is a sequence of records, each followed by a line feed: frames, then the seek
table. A frame is a zstandard frame of the ids (little-endian unsigned 32-bit) of some
documents in a row. The seek table has, little-endian,

    per frame     size of the frame u32, ids in it u32, crc32 of its ids' bytes u32
    per document  doc_id i64, 1 if the id is null u8, frame u32, first id in the frame u32, ids u32
    at the end    frames u32, documents u32, crc32 of the table so far u32, ids of the file
                  u64 (big-endian), magic ``LOTSEEK1``

so a reader finds a document's frame from the end of the file and decompresses only
that. Spark's own text writer writes the records, hence files are committed as any
Spark output (a lost task leaves nothing behind) and may be in any store.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotline.llm import words
from lotline.llm.common import cut

#: Ids that close a frame, and records of a file (its last is the table): about 64 MB of ids.
FRAME_IDS = 65_536
FILE_RECORDS = 257
LEVEL = 3
MAGIC = b"LOTSEEK1"

_FRAME = struct.Struct("<III")
_DOC = struct.Struct("<qBIII")
_END = struct.Struct("<III")
_TOTAL = struct.Struct(">Q8s")


def seek_table(frames: list[tuple[int, int, int]], docs: list[tuple[int | None, int, int, int]]) -> bytes:
    body = b"".join(_FRAME.pack(*f) for f in frames)
    body += b"".join(_DOC.pack(0 if d is None else d, d is None, f, at, n) for d, f, at, n in docs)
    return body + _END.pack(len(frames), len(docs), zlib.crc32(body)) + _TOTAL.pack(sum(f[1] for f in frames), MAGIC)


def read_table(content: bytes) -> tuple[list[tuple[int, int, int, int]], list[tuple[int | None, int, int, int]]]:
    """Frames (offset, size, ids, crc32) and documents (doc_id, frame, first, ids) of a file."""
    end = len(content) - 1 - _TOTAL.size  # the last line feed
    if end < _END.size or _TOTAL.unpack_from(content, end)[1] != MAGIC:
        raise ValueError("not a seekable id file")
    n_frames, n_docs, crc = _END.unpack_from(content, end - _END.size)
    start = end - _END.size - n_frames * _FRAME.size - n_docs * _DOC.size
    body = content[start:end - _END.size]
    if zlib.crc32(body) != crc:
        raise ValueError("damaged seek table")
    frames, offset = [], 0
    for size, ids, check in _FRAME.iter_unpack(body[:n_frames * _FRAME.size]):
        frames.append((offset, size, ids, check))
        offset += size + 1
    docs = [(None if null else d, f, at, n) for d, null, f, at, n in _DOC.iter_unpack(body[n_frames * _FRAME.size:])]
    return frames, docs


def read_frame(content: bytes, frame: tuple[int, int, int, int]) -> bytes:
    """The ids' bytes of a frame, checked."""
    offset, size, ids, check = frame
    data = zstandard.ZstdDecompressor().decompress(content[offset:offset + size], max_output_size=4 * ids) if ids else b""
    if len(data) != 4 * ids or zlib.crc32(data) != check:
        raise ValueError("damaged frame")
    return data


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 1) -> None:
    """Encode every text of ``docs`` (doc_id, text; other columns are ignored) and write
    the ids to files in ``path``, in ascending doc_id order over the files' names.

    Null texts count as empty; ``end_id`` closes each document (None: nothing does, so an
    empty document has no ids). A null doc_id comes first; rows that repeat a doc_id
    follow one another, ordered by text. An empty table writes no document.
    """
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(words.vocabulary(tokenizer_path))
    closing = b"" if end_id is None else end_id.to_bytes(4, "little")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = words.encoder(vocabulary.value)
        compress = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False)
        done: list[tuple[int, int, int]] = []
        index: list[tuple[int | None, int, int, int]] = []
        held: list[bytes] = []
        n_held = 0

        def close() -> bytes:
            nonlocal n_held
            data = b"".join(held)
            frame = compress.compress(data)
            done.append((len(frame), n_held, zlib.crc32(data)))
            held.clear()
            n_held = 0
            return frame

        for batch in batches:
            out = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.texts(batch.column("text")), strict=True):
                data = ids.astype("<u4").tobytes() + closing
                index.append((doc_id, len(done), n_held, len(data) // 4))
                held.append(data)
                n_held += len(data) // 4
                if n_held >= FRAME_IDS:
                    out.append(close())
                    if len(done) == FILE_RECORDS - 1:
                        out.append(seek_table(done, index))
                        done.clear()
                        index.clear()
            yield pa.RecordBatch.from_pydict({"record": pa.array(out, pa.binary())})
            words.trim()
        if held:
            last = [close(), seek_table(done, index)]
        else:
            last = [seek_table(done, index)] if done else []
        yield pa.RecordBatch.from_pydict({"record": pa.array(last, pa.binary())})

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(parts, "doc_id")
    rows = ordered.sortWithinPartitions("doc_id", "text").mapInArrow(records, "record binary")
    (rows.select(F.col("record").cast("string").alias("value")).write
     .option("lineSep", "\n").option("maxRecordsPerFile", FILE_RECORDS).text(path))


def read(spark: SparkSession, path: str, only: list[int] | None = None) -> DataFrame:
    """The documents of the files in ``path``: doc_id, start (ids of all documents before
    it), n_tokens, ids (binary, little-endian unsigned 32-bit). ``only``: these doc_ids;
    frames without one of them are not decompressed.
    """
    wanted = None if only is None else set(only)

    def documents(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for part, volume, content in zip(pdf["part"], pdf["volume"], pdf["content"], strict=True):
                table, docs = read_table(content)
                before, held, data, out = 0, -1, b"", []
                for doc_id, frame, first, n in docs:
                    if wanted is None or doc_id in wanted:
                        if frame != held:
                            held, data = frame, read_frame(content, table[frame])
                        out.append((part, volume, doc_id, before, n, data[4 * first:4 * (first + n)]))
                    before += n
                    if len(out) >= 2000:
                        yield _frame(out)
                        out = []
                yield _frame(out)

    name = r"part-(\d+)-.*-c(\d+)"
    files = (spark.read.format("binaryFile").load(path).filter("length > 0")
             .select(F.regexp_extract("path", name, 1).cast("int").alias("part"),
                     F.regexp_extract("path", name, 2).cast("int").alias("volume"), "content"))
    # ids before a part (one row per writing task) and before a volume of it
    total = F.conv(F.hex(F.expr("substring(content, -17, 8)")), 16, 10).cast("long")
    sizes = cut(files.select("part", "volume", total.alias("n")))  # one row per file
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("parts_before"))
    sizes = sizes.select("part", "volume", (F.sum("n").over(Window.partitionBy("part").orderBy("volume")) - F.col("n")).alias("volumes_before"))
    starts = sizes.join(parts, "part").select("part", "volume", (F.col("parts_before") + F.col("volumes_before")).alias("file_start"))
    found = files.mapInPandas(documents, "part int, volume int, doc_id long, before long, n_tokens long, ids binary")
    return found.join(F.broadcast(starts), ["part", "volume"]).select(
        "doc_id", (F.col("file_start") + F.col("before")).alias("start"), "n_tokens", "ids")


def _frame(rows: list[tuple]) -> pd.DataFrame:
    pdf = pd.DataFrame(rows, columns=["part", "volume", "doc_id", "before", "n_tokens", "ids"])
    pdf["doc_id"] = pdf["doc_id"].astype("Int64")
    return pdf
