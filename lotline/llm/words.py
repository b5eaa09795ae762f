"""Words of a text for a tokenizer that drops white space (word_bpe_49k.json).

``split`` cuts a text into words so that encoding it equals encoding each word and
joining the ids: at ASCII white space always, and in words of plain letters, digits and
marks also where the tokenizer's own splitter cuts. Words are lower-cased where that
cannot change what the tokenizer's normalizer makes of them; words with characters
outside that plain set, apostrophes (contractions) or ``<`` (special tokens) stay whole.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

# letters with one lower-case form, in the same range, which no normalization changes
_LETTERS = "a-zà-öø-įı-ſ"
_UPPER = "A-ZÀ-ÖØ-Þ"
_PLAIN = rf"!-&(-;=-~{_LETTERS}{_UPPER}"
_PLAIN_TEXT = re.compile(rf"[\t\n\r {_PLAIN}]*")
_PLAIN_WORD = re.compile(rf"[{_PLAIN}]*")
_CUT = re.compile(rf"[{_LETTERS}]+|[0-9]|[^\s0-9{_LETTERS}]+")
_CUT_LINES = re.compile(rf"\n|[{_LETTERS}]+|[0-9]|[^\s0-9{_LETTERS}]+")
_SPACE = re.compile(r"[\t\n\r ]+")
#: Bytes of texts whose words are handled at a time, and words whose ids are kept.
SLICE_BYTES = 10_000_000
REMEMBERED = 200_000
#: Words that are encoded in one call, and in one text of it.
CALL, LINE = 10_000, 100


def split(text: str | None) -> list[str]:
    if not text:
        return []
    if _PLAIN_TEXT.fullmatch(text):
        return _CUT.findall(text.lower())
    out: list[str] = []
    for word in _SPACE.split(text):
        if _PLAIN_WORD.fullmatch(word):
            out += _CUT.findall(word.lower())
        else:
            out.append(word)
    return out


def vocabulary(path: str) -> str:
    """The tokenizer file's text, to be broadcast (its size is the vocabulary's, not the data's)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def load(json_text: str) -> Tokenizer:
    tok = Tokenizer.from_str(json_text)
    tok.no_truncation()
    tok.no_padding()
    return tok


def pieces(json_text: str) -> list[str]:
    """The id-to-piece table: the piece of every id."""
    vocabulary = load(json_text).get_vocab(with_added_tokens=True)
    out = [""] * (max(vocabulary.values()) + 1)
    for piece, i in vocabulary.items():
        out[i] = piece
    return out


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` at ``starts``, one after the other."""
    ends = np.cumsum(lengths)
    return flat[np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]


def _dictionary(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words between ASCII white space, the place of each word of the texts (null:
    none), and the words of each text. Empty words, at the ends of texts, may be among them."""
    lists = pc.ascii_split_whitespace(pc.fill_null(column, ""))
    found = pc.dictionary_encode(lists.flatten())
    return (found.dictionary.to_pylist(), found.indices.to_numpy(zero_copy_only=False).astype(np.int64),
            lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))


def _cut_all(names: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, list[int]]:
    """``split`` of many words: the distinct parts, the parts of each word one after the
    other, how many each word has, and the places of the words that stay whole."""
    plain = [_PLAIN_WORD.fullmatch(w) is not None for w in names]
    parts = _CUT_LINES.findall("\n".join([w for w, p in zip(names, plain, strict=True) if p]).lower())
    number = {w: i for i, w in enumerate(dict.fromkeys(parts))}
    feed = number.get("\n", -1)
    codes = np.fromiter(map(number.__getitem__, parts), np.int64, len(parts))
    is_plain = np.array(plain, bool)
    counts = np.ones(len(names), np.int64)
    counts[is_plain] = np.bincount(np.cumsum(codes == feed)[codes != feed], minlength=int(is_plain.sum()))[:int(is_plain.sum())]
    codes = codes[codes != feed]
    if feed >= 0:  # the line feed is no part
        del number["\n"]
        codes -= codes > feed
    whole = np.flatnonzero(~is_plain)
    out = np.empty(int(counts.sum()), np.int64)
    ends = np.cumsum(counts)
    mine = np.zeros(len(out), bool)
    mine[ends[whole] - 1] = True
    out[~mine] = codes
    out[mine] = np.arange(len(number), len(number) + len(whole))
    return [*number, *[names[i] for i in whole.tolist()]], out, counts, list(range(len(number), len(number) + len(whole)))


def numbered(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """``split`` of every text of a column: the distinct words, the place of each word of
    the texts, and the number of words of each text."""
    names, codes, per_text = _dictionary(column)
    parts, flat, counts, _ = _cut_all(names)
    starts = np.cumsum(counts) - counts
    out = gather(flat, starts[codes], counts[codes])
    ends = np.r_[0, np.cumsum(counts[codes])][np.r_[0, np.cumsum(per_text)]]
    empty = parts.index("") if "" in parts else -1
    if empty >= 0:  # no word
        keep = out != empty
        before = np.r_[0, np.cumsum(keep)]
        out, ends = out[keep], before[ends]
        out -= out > empty
        del parts[empty]
    return parts, out, np.diff(ends)


def trim() -> None:
    """Give memory that is no longer used back to the machine: Arrow's pool and the C
    allocator (where it has the call) would keep it, and a worker outlives many tasks."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """A column in runs of at most ``limit`` bytes of text, or one longer text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(column):
        start = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, start + limit, side="right")))
        yield column.slice(first, last - first)
        trim()
        first = last


class Encoder:
    """Encodes texts slice by slice; each distinct word of a slice is encoded once, or
    never if it is among the first REMEMBERED distinct words, whose ids are kept."""

    def __init__(self, json_text: str):
        self.tok = load(json_text)
        self.known: dict[str, bytes] = {}
        self.ends = np.zeros(self.tok.get_vocab_size(with_added_tokens=True), bool)
        for piece, i in self.tok.get_vocab(with_added_tokens=True).items():
            self.ends[i] = piece.endswith("</w>")

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that are one word to the tokenizer too: flat, and how many each has."""
        flat, lengths = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for i in range(0, len(words), CALL):
            part = words[i:i + CALL]
            # texts of many words are faster to encode; a word's last id tells where it ends
            lines = [" ".join(part[j:j + LINE]) for j in range(0, len(part), LINE)]
            ids = np.array([x for e in self.tok.encode_batch_fast(lines, add_special_tokens=False) for x in e.ids], np.uint32)
            last = np.flatnonzero(self.ends[ids])
            if len(last) != len(part):
                raise ValueError("the tokenizer cuts a word that split() does not")
            flat.append(ids)
            lengths.append(np.diff(last, prepend=-1))
        return np.concatenate(flat), np.concatenate(lengths)

    def _ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same, from memory as far as it goes."""
        known = self.known
        new = [w for w in words if w not in known]
        flat, lengths = self._words(new)
        raw, ends = flat.tobytes(), np.cumsum(lengths).tolist()
        fresh = {w: raw[4 * (e - n):4 * e] for w, e, n in zip(new, ends, lengths.tolist(), strict=True)}
        found = [known.get(w) or fresh[w] for w in words]
        for w in new[:max(0, REMEMBERED - len(known))]:
            known[w] = fresh[w]
        return np.frombuffer(b"".join(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def distinct(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words as ``split`` and ``numbered`` give them: flat, and how many each
        has. Words of plain letters are encoded many to a text, the others one by one."""
        is_plain = np.fromiter((_PLAIN_WORD.fullmatch(w) is not None for w in names), bool, len(names))
        flat, some = self._words([w for w, p in zip(names, is_plain.tolist(), strict=True) if p])
        rest = [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(
            [w for w, p in zip(names, is_plain.tolist(), strict=True) if not p], add_special_tokens=False)]
        found = np.r_[some, np.array([len(x) for x in rest], np.int64)]
        order = np.argsort(np.argsort(~is_plain, kind="stable"), kind="stable")
        return gather(np.concatenate([flat, *rest]), (np.cumsum(found) - found)[order], found[order]), found[order]

    def texts(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of every text (null: none) of a column."""
        for part in slices(column):
            yield from self._texts(part)

    def _texts(self, column: pa.Array) -> Iterator[np.ndarray]:
        names, codes, per_text = _dictionary(column)
        parts, cut, counts, whole = _cut_all(names)
        flat, lengths = self._ids(parts[:len(parts) - len(whole)])
        rest = [np.array(e.ids, np.uint32) for e in
                self.tok.encode_batch_fast([parts[i] for i in whole], add_special_tokens=False)]
        flat, lengths = np.concatenate([flat, *rest]), np.r_[lengths, np.array([len(x) for x in rest], np.int64)]
        starts = np.cumsum(lengths) - lengths
        # ids of each word between white space
        flat = gather(flat, starts[cut], lengths[cut])
        sums = np.r_[0, np.cumsum(lengths[cut])][np.r_[0, np.cumsum(counts)]]
        starts, lengths = sums[:-1], np.diff(sums)
        at = 0
        for n in per_text.tolist():
            part = codes[at:at + n]
            at += n
            yield gather(flat, starts[part], lengths[part])


_encoders: dict[int, Encoder] = {}


def encoder(json_text: str) -> Encoder:
    """This Python worker's encoder for a vocabulary; it outlives a task. The tokenizers library
    keeps tens of MB of every tokenizer that has encoded, also when that is gone, so
    tasks must not load their own."""
    key = hash(json_text)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(json_text)
    return _encoders[key]
