"""Language identification with hyperdimensional profiles.

Each letter slot has a random +1/-1 vector. A trigram is bound by multiplying the
vectors of its letters, permuted (rolled) by their place; a text is the bundle (sum) of
its trigram vectors, and a language prototype the bundle of its training texts. A
text gets the language whose prototype has the largest cosine with its own bundle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotline.llm.common import crc32_of

DIMS = 1024
#: Letter slots: 0 for the gap between words, 1 to 26 for a to z, other letters share the rest by code point.
SLOTS = 64
SEED = 20240229
#: Trigram counts a training task holds before it hands them on, in languages.
LANGS_HELD = 16


@lru_cache(maxsize=1)
def _slots() -> np.ndarray:
    """Slot of every code point (0: not a letter)."""
    table = np.zeros(0x110000, dtype=np.uint8)
    for cp in range(0x110000):
        if chr(cp).isalpha():
            table[cp] = cp - 96 if 97 <= cp <= 122 else 27 + (cp * 2654435761 >> 7) % (SLOTS - 27)
    return table


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, ...]:
    """The letter vectors, permuted for the first, second and third place of a trigram."""
    base = np.random.default_rng(SEED).choice(np.array([-1, 1], dtype=np.int8), size=(SLOTS, DIMS))
    return np.roll(base, 2, axis=1), np.roll(base, 1, axis=1), base


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigram codes of a text and their counts; empty without a letter."""
    cps = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    x = np.concatenate([[0], _slots()[cps], [0]]).astype(np.int32)
    keep = np.ones(len(x), dtype=bool)
    keep[1:] = (x[1:] > 0) | (x[:-1] > 0)  # runs of gaps become one
    x = x[keep]
    if len(x) < 3:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    return np.unique((x[:-2] * SLOTS + x[1:-1]) * SLOTS + x[2:], return_counts=True)


def bound(codes: np.ndarray) -> np.ndarray:
    """The bound vectors of trigram codes."""
    first, second, third = _letters()
    out = first[codes // (SLOTS * SLOTS)]
    out *= second[codes // SLOTS % SLOTS]
    out *= third[codes % SLOTS]
    return out


def bundle(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of the bound vectors, in steps of bounded memory."""
    total = np.zeros(DIMS)
    for i in range(0, len(codes), 4096):
        total += counts[i:i + 4096].astype(np.float32) @ bound(codes[i:i + 4096]).astype(np.float32)
    return total


def fit(docs: DataFrame) -> dict[str, np.ndarray]:
    """Unit prototype of every non-null ``lang`` among all rows of ``docs`` (text, lang).

    Trigrams are counted per task, summed by (lang, trigram) and bundled per language,
    so a language's group holds at most SLOTS**3 rows however many texts it has.
    Texts without a letter add nothing; languages without any trigram are left out.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}

        def rows() -> Iterator[pd.DataFrame]:
            for lang, c in held.items():
                at = np.flatnonzero(c)
                yield pd.DataFrame({"lang": lang, "code": at.astype(np.int32), "n": c[at]})
            held.clear()

        for pdf in frames:
            for text, lang in zip(pdf["text"], pdf["lang"], strict=True):
                if lang not in held:
                    if len(held) >= LANGS_HELD:
                        yield from rows()
                    held[lang] = np.zeros(SLOTS**3, dtype=np.int64)
                codes, counts = trigrams(text)
                held[lang][codes] += counts
        yield from rows()

    def prototype(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("code")
        total = bundle(pdf["code"].to_numpy(), pdf["n"].to_numpy())
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "vector": [total]})

    known = docs.select("text", "lang").filter("text is not null and lang is not null")
    counts = known.mapInPandas(count, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    found = counts.groupBy("lang").applyInPandas(prototype, "lang string, vector array<double>").collect()
    out = {}
    for r in sorted(found, key=lambda r: r["lang"]):
        v = np.array(r["vector"])
        if np.linalg.norm(v) > 0:
            out[r["lang"]] = v / np.linalg.norm(v)
    return out


def language_column(prototypes: dict[str, np.ndarray], text_col: str = "text"):
    """A column struct(lang_pred, score) for a text column."""
    langs = list(prototypes)
    matrix = np.array([prototypes[k] for k in langs]) if langs else np.zeros((0, DIMS))

    @F.pandas_udf("lang_pred string, score double")
    def classify(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            out = []
            for text in texts:
                codes, counts = trigrams(text) if text else ((), ())
                vector = bundle(codes, counts) if len(codes) else None
                size = np.linalg.norm(vector) if vector is not None else 0.0
                if not size or not langs:
                    out.append(("und", 0.0))
                    continue
                cosines = matrix @ vector / size
                best = int(np.argmax(cosines))
                out.append((langs[best], float(min(1.0, max(0.0, cosines[best])))))
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    return classify(F.col(text_col))


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (the cosine, 0 to 1); columns of these names are
    replaced, the others pass unchanged.

    ``und`` with score 0 for null texts and texts without a letter, and where nothing was
    learned; equal cosines go to the language first in the alphabet. The label column
    is not read.
    """
    kept = docs.drop("lang_pred", "score")
    out = kept.withColumn("__language", language_column(prototypes, text_col))
    return out.select(*kept.columns, F.col("__language.lang_pred").alias("lang_pred"), F.col("__language.score").alias("score"))


def held_out(id_col: str = "doc_id"):
    """True where the id's crc32 leaves 1 when divided by 3 (null id: false, and not learned from)."""
    return F.coalesce(crc32_of(F.col(id_col)) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.filter(crc32_of(F.col(id_col)) % 3 != 1)
