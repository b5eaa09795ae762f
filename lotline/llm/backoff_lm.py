"""Language-model scores from a weighted backoff automaton.

States are the empty history (root), the start of a text and every training word. A state
has an arc for each word or end that ever followed it, with the
log-probability of a discounted and interpolated bigram, and one failure arc to the root
with its backoff weight; the root has an arc for every word. A text is read once from
left to right: take the state's arc for the word, or follow the failure arc and take
the root's, add the log-probabilities, go on in the state of the word (the root, if the
word is no state).

Root probabilities are absolute-discounted unigrams over the types of the base score: the
V training types and one type for all unseen words, which gets the discounted mass.

Counting and look-up run over the blocks of :mod:`lotline.llm.blocks`: words are told once
per block with their training counts, summed over all blocks, numbered, and go back to the
blocks that have them. Pairs of word numbers are told once per block too, as packed runs in
buckets (a hash of both words, so a frequent history is dealt over all of them); each
bucket sums its pairs, answers each run in its order, and passes what its arcs take from
each history on to a second dealing, by history, which answers the blocks with the sums.
The number of buckets follows the number of tokens; the model is on no one machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotline.llm.blocks import STREAM_SCHEMA, blocks, stream_batch, unpack, word_batches
from lotline.llm.common import crc32_of, written
from lotline.llm.words import trim

#: Bytes of text in a block.
BLOCK_BYTES = 8_000_000
DISCOUNT = 0.75
#: Words of a block that are worked on at a time.
SLICE = 500_000
#: Tokens for which there is a bucket.
BUCKET = 2_000_000
#: Number of the start (as a history) and the end (as a token).
END = -2

TOLD_SCHEMA = ("block long, bucket long, history binary, word binary, n binary, wanted binary, stream binary, "
               "ids binary, counts binary, doc_ids array<long>, flags array<boolean>, lengths array<int>")
_TOLD = pa.schema([("block", pa.int64()), ("bucket", pa.int64()),
                   *[(c, pa.binary()) for c in ("history", "word", "n", "wanted", "stream", "ids", "counts")],
                   ("doc_ids", pa.list_(pa.int64())), ("flags", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int32()))])
_SUMS = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("n", pa.binary()), ("history", pa.binary()), ("taken", pa.binary())])
_TAKEN = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("n", pa.binary()), ("taken", pa.binary())])


def numbered(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words between ASCII white space, A-Z lower-cased: the distinct ones, the place of
    each word of the texts (null: none), and the number of words of each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    found = pc.dictionary_encode(lists.flatten())
    names, codes = found.dictionary.to_pylist(), found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]
    empty = names.index("") if "" in names else -1
    if empty >= 0:  # white space at an end of a text
        keep = codes != empty
        ends = np.r_[0, np.cumsum(keep)][ends]
        codes = codes[keep]
        codes -= codes > empty
        del names[empty]
    return names, codes, np.diff(ends)


def slices(lengths: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Texts in runs of about SLICE words: first text, last + 1, and the same of their words."""
    ends = np.r_[0, np.cumsum(lengths)]
    first = 0
    while first < len(lengths):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + SLICE, side="right")) - 1)
        yield first, last, int(ends[first]), int(ends[last])
        first = last


@dataclass
class Root:
    """Counts of the training tokens (the end of a text is one) and the unigrams they give."""

    tokens: int  # N
    types: int  # V
    texts: int
    once: int
    twice: int

    @property
    def discount(self) -> float:
        return self.once / (self.once + 2 * self.twice) if self.once and self.twice else 0.5

    def log10(self, counts: np.ndarray) -> np.ndarray:
        """Model log-probability of tokens seen so often in training."""
        if not self.tokens:
            return np.zeros(len(counts))
        unseen = self.discount * self.types / self.tokens
        return np.log10(np.where(counts > 0, (counts - self.discount) / self.tokens, unseen))

    def base_log10(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.tokens + self.types + 1))


#: Words of blocks that a task holds before it packs them.
RUN = 1_000_000


def _word_runs(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Rows (block, place, n, id): a block's words by place, packed."""
    block, place, n, number = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((place, block))
    block, place, n, number = block[order], place[order], n[order], number[order]
    first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.empty(0, np.int64)
    spans = list(zip(first.tolist(), [*first[1:].tolist(), len(block)], strict=True)) if len(block) else []
    return pa.RecordBatch.from_pydict({
        "block": pa.array(block[first], pa.int64()), "place": pa.array([pack(_steps(place[i:j])) for i, j in spans], pa.binary()),
        "n": pa.array([pack(n[i:j]) for i, j in spans], pa.binary()), "id": pa.array([pack(number[i:j]) for i, j in spans], pa.binary())})


def spread_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts and numbers of words (at, n, id), sent to the blocks that have them in packed runs."""
    held, size = [], 0
    for batch in batches:
        at, n, number = batch.column("at"), batch.column("n").to_numpy(), batch.column("id").to_numpy()
        word = np.repeat(np.arange(batch.num_rows), at.value_lengths().to_numpy(zero_copy_only=False))
        spots = at.flatten()
        held.append((spots.field("block").to_numpy(), spots.field("place").to_numpy().astype(np.int64), n[word], number[word]))
        size += len(word)
        if size >= RUN:
            yield _word_runs(held)
            held, size = [], 0
            trim()
    if held:
        yield _word_runs(held)
        trim()


def held_out(id_col: str = "doc_id"):
    """True where the id's crc32 leaves 2 when divided by 7 (null id: false, and not learned from)."""
    return F.coalesce(crc32_of(F.col(id_col)) % 7 == 2, F.lit(False))


def training(id_col: str = "doc_id"):
    return F.coalesce(crc32_of(F.col(id_col)) % 7 != 2, F.lit(False))


def pack(numbers: np.ndarray) -> bytes:
    """64-bit numbers by byte planes (most high bytes are alike), compressed."""
    planes = np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpacked(data: bytes, kind: type = np.int64) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _steps(numbers: np.ndarray) -> np.ndarray:
    return np.diff(numbers, prepend=np.int64(0))


def _dealt(buckets: int, *keys: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The keys' order by bucket (a hash of the keys), and the runs: bucket, first, last + 1."""
    mixed = np.zeros(len(keys[0]), np.uint64)
    for key in keys:
        mixed = (mixed ^ key.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
    bucket = (mixed % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int64)  # 16 bits: a radix sort
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.empty(0, np.int64)
    return order, list(zip(bucket[first].tolist(), first.tolist(), [*first[1:].tolist(), len(bucket)], strict=len(first) > 0))


@dataclass
class Histories:
    """A block's words that may have arcs, by number: ``ids`` ascending but for the last,
    which is END; ``symbol``: each place's index among them, -1 for other words."""

    ids: np.ndarray
    symbol: np.ndarray

    @classmethod
    def of(cls, id_of: np.ndarray) -> Histories:
        at = np.flatnonzero(id_of >= 0)
        at = at[np.argsort(id_of[at])]
        symbol = np.full(len(id_of), -1, np.int64)
        symbol[at] = np.arange(len(at))
        return cls(np.r_[id_of[at], END], symbol)

    @property
    def end(self) -> int:
        return len(self.ids) - 1

    def pairs(self, codes: np.ndarray, lengths: np.ndarray, flags: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of the texts, as history * len(ids) + symbol, and their number in flagged texts."""
        some, marked = [np.empty(0, np.int64)], []
        for d0, d1, w0, w1 in slices(lengths):
            history, sym, _ = _walk(self.symbol[codes[w0:w1]], lengths[d0:d1], self.end)
            both = (history >= 0) & (sym >= 0)
            pairs = history[both] * len(self.ids) + sym[both]
            some.append(np.unique(pairs))
            if flags is not None:
                marked.append(np.unique(pairs[np.repeat(flags[d0:d1], lengths[d0:d1] + 1)[both]], return_counts=True))
        every = np.concatenate(some)
        some.clear()
        every.sort()
        every = every[np.r_[True, every[1:] != every[:-1]]] if len(every) else every
        n = np.zeros(len(every), np.int64)
        for found, times in marked:
            n[np.searchsorted(every, found)] += times
        return every, n


def summed(told: pa.Table) -> pa.Table:
    """A bucket's pairs: their sums in the order of each run told (0: no arc), and what
    the arcs take from each history (bucket and block null)."""
    runs = [tuple(unpacked(r[c]) for c in ("history", "word", "n")) for r in told.select(["history", "word", "n"]).to_pylist()]
    ends = np.cumsum([len(r[0]) for r in runs])[:-1]
    names, history = np.unique(np.concatenate([np.cumsum(r[0]) for r in runs]), return_inverse=True)
    words, word = np.unique(np.concatenate([r[1] for r in runs]), return_inverse=True)
    pairs, at = np.unique(history * len(words) + word, return_inverse=True)
    n = np.bincount(at, weights=np.concatenate([r[2] for r in runs]), minlength=len(pairs)).astype(np.int64)
    arcs = np.flatnonzero(n)
    taken = np.bincount(pairs[arcs] // len(words), weights=n[arcs] - DISCOUNT, minlength=len(names))
    held = np.flatnonzero(taken)
    buckets = told["buckets"][0].as_py()
    order, parts = _dealt(buckets, names[held])
    held = held[order]
    answers = [pack(x) for x in np.split(n[at], ends)]
    none = [None] * len(parts)
    return pa.Table.from_pydict({
        "block": told["block"].to_pylist() + none, "bucket": told["bucket"].to_pylist() + [b for b, _, _ in parts],
        "n": answers + none, "history": [None] * len(answers) + [pack(_steps(names[held[i:j]])) for _, i, j in parts],
        "taken": [None] * len(answers) + [pack(taken[held[i:j]]) for _, i, j in parts]}, _SUMS)


def taken_of(table: pa.Table) -> pa.Table:
    """A bucket of histories: what all arcs take from each, in the order of each run wanted."""
    rows = table.select(["block", "bucket", "wanted", "history", "taken"]).to_pylist()
    told = [r for r in rows if r["history"] is not None]
    asked = [r for r in rows if r["wanted"] is not None]
    names, at = np.unique(np.concatenate([np.empty(0, np.int64), *[np.cumsum(unpacked(r["history"])) for r in told]]), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate([np.empty(0), *[unpacked(r["taken"], np.float64) for r in told]]), minlength=len(names))
    out = []
    for r in asked:
        wanted = np.cumsum(unpacked(r["wanted"]))
        answer = np.zeros(len(wanted))
        if len(names):
            place = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
            answer = np.where(names[place] == wanted, total[place], 0.0)
        out.append(pack(answer))
    return pa.Table.from_pydict({"block": [r["block"] for r in asked], "bucket": [r["bucket"] for r in asked],
                                 "n": [None] * len(out), "taken": out}, _TAKEN)


def _answers(found: pa.Table, column: str, runs: list[tuple[int, int, int]], order: np.ndarray, kind: type) -> np.ndarray:
    """The answers to a block's runs, put back into the order of its keys."""
    by = {b: x for b, x in zip(found["bucket"].to_pylist(), found[column].to_pylist(), strict=True) if x is not None}
    if by.keys() != {b for b, _, _ in runs}:
        raise ValueError("a block's runs and their answers differ")
    out = np.empty(len(order), kind)
    for b, i, j in runs:
        out[order[i:j]] = unpacked(by[b], kind)
    return out


def _walk(symbols: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token sequence of texts put one after the other: history state and symbol of
    each token (-1: root, no state word), and where each text starts."""
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64) if len(lengths) else np.empty(0, np.int64)
    n = int(lengths.sum()) + len(lengths)
    is_end = np.zeros(n, bool)
    is_end[starts + lengths] = True
    sym = np.empty(n, np.int64)
    sym[is_end] = end
    sym[~is_end] = symbols
    history = np.empty(n, np.int64)
    history[1:] = sym[:-1]
    history[starts] = end
    return history, sym, starts


def score(docs: DataFrame, flag: Column) -> DataFrame:
    """Log10 probabilities of every row of ``docs`` (doc_id, text), learning from the rows
    where the boolean column expression ``flag`` holds.

    Returns doc_id, n_tokens (words and the end), n_known (tokens seen in training),
    train_tokens, base_score (add-one unigrams), score (the automaton's). Null and empty
    texts are one token, the end. Without training rows every score is 0. A null doc_id is
    kept; repeated rows are learned from and scored each; other columns are ignored.
    ``docs`` is read several times and must give the same rows each time.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", flag.alias("flag"))

    def tell_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, numbered, BLOCK_BYTES):
            yield from word_batches(block, n=block.flagged().astype(np.int64), m=np.bincount(block.codes, minlength=len(block.words)))

    told = rows.mapInArrow(tell_words, "block long, place int, word string, n long, m long")
    # one row per distinct word; its list is at most one entry per block
    table = written(told.groupBy("word").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.collect_list(F.struct("block", "place")).alias("at"))
                    .withColumn("id", F.when(F.col("n") > 0, F.monotonically_increasing_id()).otherwise(F.lit(-1).cast("long"))), "words")
    texts = rows.filter("flag").count()
    r = table.agg(F.sum("n").alias("n"), F.sum((F.col("n") > 0).cast("long")).alias("v"), F.sum("m").alias("m"),
                  F.sum((F.col("n") == 1).cast("long")).alias("f1"), F.sum((F.col("n") == 2).cast("long")).alias("f2")).first()
    root = Root((r["n"] or 0) + texts, (r["v"] or 0) + (texts > 0), texts, (r["f1"] or 0) + (texts == 1), (r["f2"] or 0) + (texts == 2))
    buckets = 1 + (r["m"] or 0) // BUCKET

    by_word = table.select("at", "n", "id").mapInArrow(spread_words, "block long, place binary, n binary, id binary")

    def tell_streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, numbered, BLOCK_BYTES):
            yield stream_batch(block)

    def tell_pairs(streams: pa.Table, found: pa.Table) -> pa.Table:
        if not streams.num_rows:
            raise ValueError("words of a block without its texts: the input changed between two reads")
        runs = found.select(["place", "n", "id"]).to_pylist()
        place = np.concatenate([np.empty(0, np.int64), *[np.cumsum(unpacked(r["place"])) for r in runs]])
        count_of, id_of = np.zeros(len(place), np.int64), np.full(len(place), -1, np.int64)
        count_of[place] = np.concatenate([np.empty(0, np.int64), *[unpacked(r["n"]) for r in runs]])
        id_of[place] = np.concatenate([np.empty(0, np.int64), *[unpacked(r["id"]) for r in runs]])
        histories = Histories.of(id_of)
        out = []
        for s in streams.to_pylist():
            codes, lengths = unpack(s["stream"], s["n_words"]), np.array(s["lengths"], np.int64)
            pairs, n = histories.pairs(codes, lengths, np.array(s["flags"], bool))
            trim()
            history, word = histories.ids[pairs // len(histories.ids)], histories.ids[pairs % len(histories.ids)]
            order, runs = _dealt(buckets, history, word)
            for b, i, j in runs:
                at = order[i:j]
                out.append({"block": s["block"], "bucket": b, "history": pack(_steps(history[at])), "word": pack(word[at]), "n": pack(n[at])})
            del pairs, n, history, word
            order, runs = _dealt(buckets, histories.ids)
            out += [{"block": s["block"], "bucket": b, "wanted": pack(_steps(histories.ids[order[i:j]]))} for b, i, j in runs]
            out.append({"block": s["block"], "stream": s["stream"], "ids": pack(id_of), "counts": pack(count_of),
                        "doc_ids": s["doc_ids"], "flags": s["flags"], "lengths": s["lengths"]})
        trim()
        return pa.Table.from_pylist(out, _TOLD)

    def traverse(streams: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        for s in streams.to_pylist():
            all_lengths = np.array(s["lengths"], np.int64)
            all_codes = unpack(s["stream"], int(all_lengths.sum()))
            id_of, count_of = unpacked(s["ids"]), unpacked(s["counts"])
            histories = Histories.of(id_of)
            size = len(histories.ids)
            pairs, _ = histories.pairs(all_codes, all_lengths)
            order, runs = _dealt(buckets, histories.ids[pairs // size], histories.ids[pairs % size])
            pair_n = _answers(found, "n", runs, order, np.int64)
            pairs, pair_n = pairs[pair_n > 0], pair_n[pair_n > 0]
            trim()
            order, runs = _dealt(buckets, histories.ids)
            taken = _answers(found, "taken", runs, order, np.float64)
            total = np.empty(size)
            total[histories.symbol[id_of >= 0]], total[-1] = count_of[id_of >= 0], root.texts
            with np.errstate(divide="ignore", invalid="ignore"):
                backoff = np.log10(np.where(total > 0, (total - taken) / total, 1.0))
            for d0, d1, w0, w1 in slices(all_lengths):
                codes, lengths = all_codes[w0:w1], all_lengths[d0:d1]
                history, sym, starts = _walk(histories.symbol[codes], lengths, histories.end)
                counts = np.empty(len(sym), np.int64)
                is_end = np.zeros(len(sym), bool)
                is_end[starts + lengths] = True
                counts[is_end], counts[~is_end] = root.texts, count_of[codes]
                # failure arc to the root, then the root's arc
                step = root.log10(counts) + np.where(history >= 0, backoff[history], 0.0)
                # or the state's own arc
                wanted = np.where((history >= 0) & (sym >= 0), history * size + sym, -1)
                at = np.minimum(np.searchsorted(pairs, wanted), max(0, len(pairs) - 1))
                hit = (pairs[at] == wanted) if len(pairs) else np.zeros(len(sym), bool)
                step[hit] = np.log10((pair_n[at[hit]] - DISCOUNT) / total[history[hit]] + 10.0 ** step[hit])
                out.append(pa.table({
                    "doc_id": pa.array(s["doc_ids"][d0:d1], pa.int64()),
                    "n_tokens": lengths + 1, "n_known": np.add.reduceat((counts > 0).astype(np.int64), starts),
                    "base_score": np.add.reduceat(root.base_log10(counts), starts), "score": np.add.reduceat(step, starts)}))
        trim()
        return pa.concat_tables(out)

    told = written(rows.mapInArrow(tell_streams, STREAM_SCHEMA).groupBy("block").cogroup(by_word.groupBy("block"))
                   .applyInArrow(tell_pairs, TOLD_SCHEMA), "told")
    # a group is one bucket, of about BUCKET tokens
    sums = written(told.filter("history is not null").select("block", "bucket", "history", "word", "n", F.lit(buckets).cast("long").alias("buckets"))
                   .groupBy("bucket").applyInArrow(summed, "block long, bucket long, n binary, history binary, taken binary"), "sums")
    asked = told.filter("wanted is not null").select("block", "bucket", "wanted", *[F.lit(None).cast("binary").alias(c) for c in ("history", "taken")])
    given = sums.filter("history is not null").select("block", "bucket", F.lit(None).cast("binary").alias("wanted"), "history", "taken")
    taken = asked.unionByName(given).groupBy("bucket").applyInArrow(taken_of, "block long, bucket long, n binary, taken binary")
    answers = (sums.filter("n is not null").select("block", "bucket", "n", F.lit(None).cast("binary").alias("taken")).unionByName(taken))
    streams = told.filter("stream is not null").select("block", "stream", "ids", "counts", "doc_ids", "lengths")
    out = streams.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        traverse, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "n_tokens", "n_known", F.lit(root.tokens).cast("long").alias("train_tokens"), "base_score", "score")
