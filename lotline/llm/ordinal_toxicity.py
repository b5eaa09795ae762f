"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

Features of a text are its distinct lower-case words and their proper prefixes of 3 to
6 letters; those in MIN_DOCS toxic documents of a labelled sample are weighed by the fit.
Grades are 0 (not toxic) and 1, 2 (toxic with a number of distinct marked words up to, above
the median of the toxic sample; a word is marked if a feature of it has log-odds of
MIN_LOG_ODDS). The regularisation is by the square of a feature's log-odds. One weight
vector is shared by the ordered thresholds:
P(grade > k) = sigmoid(x.w - t_k), t_0 < t_1, and the expected severity is the sum of
these over k.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labelled documents the model is fitted on, about, at most.
TRAIN_DOCS = 20_000
#: Toxic documents that must hold a feature, and log-odds from which it marks a word (for the grades only).
MIN_DOCS = 5
MIN_LOG_ODDS = 2.0
#: Word pairs of a text, those of the smallest hashes, that make near copies if all are equal.
COPY_PAIRS = 8
PREFIXES = (3, 4, 5, 6)
#: Words whose features a task remembers.
REMEMBERED = 200_000

_WORD = re.compile(r"[^\W\d_]+")
_GRADES = 3


@dataclass
class OrdinalModel:
    """weights by feature, thresholds ascending; no weights: everything has grade 0."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = ()

    def severity(self, x: float) -> tuple[float, float]:
        """Expected severity and probability of a grade above 0 at the score ``x``."""
        over = [1.0 / (1.0 + np.exp(-np.clip(x - t, -50, 50))) for t in self.thresholds]
        return (float(sum(over)), float(over[0])) if over else (0.0, 0.0)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def features_of(word: str) -> list[str]:
    """A word and its proper prefixes, told apart by their first character."""
    return ["=" + word, *("<" + word[:n] for n in PREFIXES if len(word) > n)]


def copy_key(ws: list[str]) -> bytes:
    """Equal for near copies: the smallest hashes of the pairs of words (of a single word: its own)."""
    pairs = {xxhash.xxh3_64_intdigest(a + " " + b) for a, b in zip(ws, ws[1:], strict=False)}
    smallest = sorted(pairs or {xxhash.xxh3_64_intdigest(w) for w in ws})[:COPY_PAIRS]
    return np.array(smallest, np.uint64).tobytes()


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> OrdinalModel:
    """Fit on about ``train_docs`` labelled documents, picked by a hash of the id.

    ``docs``: doc_id, text; ``labels``: doc_id, toxic (0/1). Null ids, null labels and
    ids labelled both ways are left out; an id labelled twice alike counts once. Near
    copies (the COPY_PAIRS smallest hashes over pairs of words all equal) count once for the
    choice of features. Without toxic or without clean documents the model is empty.
    """
    known = (labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id")
             .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_top")).filter("toxic = _top"))
    n = known.count()
    if not n:
        return OrdinalModel()
    picked = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(1_000_003 * min(1.0, train_docs / n)) + 1
    sample = known.filter(picked).select(F.col("doc_id").alias("_id"), (F.col("toxic") > 0).alias("toxic"))
    # at most about train_docs rows of 9 bytes
    rows = (docs.select("doc_id", "text").filter("text is not null")
            .join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("text", "toxic"))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            keys, feats, tox = [], [], []
            for text, toxic in zip(pdf["text"], pdf["toxic"], strict=True):
                ws = words_of(text)
                keys.append(copy_key(ws))
                feats.append(sorted({f for w in set(ws) for f in features_of(w)}))
                tox.append(bool(toxic))
            if keys:
                yield pd.DataFrame({"key": keys, "toxic": tox, "features": feats})

    sets = rows.mapInPandas(count, "key binary, toxic boolean, features array<string>")
    one = sets.groupBy("key", "toxic").agg(F.min("features").alias("features"))
    one = one.select("toxic", F.explode("features").alias("feature"))
    # every set has a constant feature, so the class sizes come with the counts
    sizes = {r["toxic"]: r["n"] for r in sets.select("key", "toxic").distinct().groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    t_all, c_all = sizes.get(True, 0), sizes.get(False, 0)
    if not t_all or not c_all:
        return OrdinalModel()
    counts = one.groupBy("feature").agg(F.sum(F.col("toxic").cast("long")).alias("t"),
                                        F.sum((~F.col("toxic")).cast("long")).alias("c"))
    odds = (F.log((F.col("t") + 0.5) / (t_all + 1.0)) - F.log((F.col("c") + 0.5) / (c_all + 1.0)))
    # bounded by the sample: at most what its texts hold
    chosen = counts.withColumn("odds", odds).filter(F.col("t") >= MIN_DOCS).select("feature", "odds").orderBy("feature").collect()
    names = [r["feature"] for r in chosen]
    if not names:
        return OrdinalModel()
    index = docs.sparkSession.sparkContext.broadcast(
        {r["feature"]: i if r["odds"] < MIN_LOG_ODDS else -1 - i for i, r in enumerate(chosen)})  # marks are negative

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = index.value
        for pdf in frames:
            out = {"toxic": list(pdf["toxic"]), "idx": [], "marks": []}
            for text in pdf["text"]:
                of = [[known[f] for f in features_of(w) if f in known] for w in set(words_of(text))]
                out["idx"].append(np.array(sorted({i if i >= 0 else -1 - i for x in of for i in x}), np.int32).tobytes())
                out["marks"].append(sum(1 for x in of if min(x, default=0) < 0))
            if out["idx"]:
                yield pd.DataFrame(out)

    # bounded: about train_docs rows of 4 bytes a feature
    data = [{**r.asDict(), "idx": np.frombuffer(bytes(r["idx"]), np.int32)}
            for r in rows.mapInPandas(encode, "toxic boolean, idx binary, marks int").toLocalIterator()]
    # no feature is left out, but the less its log-odds, the closer the fit holds its weight to 0
    return _optimise(data, names, np.array([r["odds"] for r in chosen]) ** 2)


class _Sums:
    """Sums of ``values[places]`` over runs of the given lengths, piece by piece in the cache."""

    def __init__(self, lengths: np.ndarray, places: np.ndarray, piece: int = 100_000):
        self.out, self.pieces, first = np.zeros(len(lengths)), [], 0
        held, ends = np.flatnonzero(lengths), np.cumsum(lengths)[lengths > 0]
        starts = np.r_[0, ends[:-1]]
        while first < len(held):
            last = max(first + 1, int(np.searchsorted(ends, starts[first] + piece, side="right")))
            self.pieces.append((held[first:last], places[starts[first]:ends[last - 1]], starts[first:last] - starts[first]))
            first = last
        longest = max((len(x[1]) for x in self.pieces), default=0)
        self.places, self.values = np.empty(longest, np.intp), np.empty(longest)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        for held, places, starts in self.pieces:
            self.places[:len(places)] = places
            part = np.take(values, self.places[:len(places)], out=self.values[:len(places)], mode="clip")
            self.out[held] = np.add.reduceat(part, starts)
        return self.out


def _optimise(data: list, names: list[str], scale: np.ndarray | None = None, steps: int = 1200, l2: float = 2e-5, rate: float = 0.1) -> OrdinalModel:
    # the order of tasks does not matter
    data = sorted(data, key=lambda r: (r["toxic"], xxhash.xxh3_64_intdigest(np.asarray(r["idx"], np.int32).tobytes()), r["marks"]))
    toxic = np.array([r["toxic"] for r in data])
    marks = np.array([r["marks"] for r in data])
    middle = float(np.median(marks[toxic]))
    grade = np.where(toxic, np.where(marks > middle, 2, 1), 0)
    lengths = np.array([len(r["idx"]) for r in data], np.int64)
    idx = np.concatenate([np.asarray(r["idx"], np.int32) for r in data])
    by_document = _Sums(lengths, idx)
    # the documents of each feature, in order
    times = np.bincount(idx, minlength=len(names))
    free, documents = np.cumsum(times) - times, np.empty(len(idx), np.int32)
    for i, r in enumerate(data):
        documents[free[r["idx"]]] = i
        free[r["idx"]] += 1
    by_feature = _Sums(times, documents)
    n, k = len(data), _GRADES - 1
    weight = np.where(toxic, 0.5 / max(1, toxic.sum()), 0.5 / max(1, (~toxic).sum()))  # both classes alike
    scale = np.ones(len(names)) if scale is None else scale
    # parameters: weights before scaling, first threshold, log of the gap to the next
    p = np.zeros(len(names) + k)
    p[-k] = 1.0
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        w, t0, gap = scale * p[:-k], p[-2], np.exp(p[-1])
        x = by_document(w)
        s = [1.0 / (1.0 + np.exp(-np.clip(x - t, -40, 40))) for t in (t0, t0 + gap)]  # P(grade > k)
        # P(0) = 1-s0, P(1) = s0-s1, P(2) = s1
        mid = np.maximum(s[0] - s[1], 1e-12)
        d0, d1 = s[0] * (1 - s[0]), s[1] * (1 - s[1])
        g0 = np.where(grade == 0, -s[0], np.where(grade == 1, d0 / mid, 0.0))  # d log P / d (x - t0)
        g1 = np.where(grade == 2, 1 - s[1], np.where(grade == 1, -d1 / mid, 0.0))
        gx, gt0, gt1 = weight * (g0 + g1), -(weight * g0).sum(), -(weight * g1).sum()
        grad = np.concatenate([scale * by_feature(gx) - l2 * p[:-k], [gt0 + gt1, gt1 * gap]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        p = p + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = {f: float(x) for f, x in zip(names, scale * p[:-k], strict=True) if abs(x) > 1e-6}
    return OrdinalModel(weights, (float(p[-2]), float(p[-2] + np.exp(p[-1]))))


def severity_column(model: OrdinalModel, text_col: str = "text"):
    """A column struct(severity, p_toxic) for a text column; null text counts as empty."""

    shared = SparkSession.active().sparkContext.broadcast(model)

    @F.pandas_udf("severity double, p_toxic double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model, cache = shared.value, {}
        number = {f: i for i, f in enumerate(model.weights)}
        weights = list(model.weights.values())
        for texts in parts:
            out = []
            for text in texts:
                found: set[int] = set()
                for w in set(words_of(text)):
                    hit = cache.get(w)
                    if hit is None:
                        if len(cache) >= REMEMBERED:
                            cache.clear()
                        hit = cache[w] = tuple(number[f] for f in features_of(w) if f in number)
                    if hit:
                        found.update(hit)
                # an exact sum: the order does not matter
                out.append(model.severity(math.fsum(weights[i] for i in found)))
            yield pd.DataFrame(out, columns=["severity", "p_toxic"])

    return score(F.col(text_col))


def predict(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """``docs`` with severity (expected grade, 0 to 2), p_toxic (P(grade > 0)), grade
    (nearest whole severity) and toxic (p_toxic > 0.5); columns of these names are replaced.

    Null and empty texts have no features; an empty model gives 0 everywhere; repeated
    rows are scored alike; other columns pass unchanged.
    """
    kept = docs.drop("severity", "p_toxic", "grade", "toxic")
    out = kept.withColumn("__severity", severity_column(model, text_col))
    return out.select(*kept.columns, F.col("__severity.severity").alias("severity"), F.col("__severity.p_toxic").alias("p_toxic"),
                      F.round("__severity.severity").cast("int").alias("grade"), (F.col("__severity.p_toxic") > 0.5).alias("toxic"))
