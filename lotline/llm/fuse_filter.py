"""Static binary fuse filters (three places, eight bits a fingerprint) on arrays of 64-bit keys.

A filter is built once from a set of keys and never changed. It says of a key "maybe" or
"never"; every key of the set is a "maybe", of others about one in 256. It takes about
nine bits a key. The construction peels the keys whose place no other key shares, wave
after wave, and fills the places in the reverse order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

ATTEMPTS = 64


@dataclass(frozen=True)
class Filter:
    seed: int
    segment: int
    span: int
    prints: np.ndarray

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        """Which of ``keys`` (signed or unsigned 64-bit) may be in the set."""
        if not len(self.prints):
            return np.zeros(len(keys), bool)
        h = mixed(keys, self.seed)
        a, b, c = places(h, self.segment, self.span)
        return (self.prints[a] ^ self.prints[b] ^ self.prints[c]) == fingerprint(h)


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mix of key and seed (multiplications and shifts, a bijection for every seed)."""
    h = np.asarray(keys).astype(np.uint64, copy=False) + np.uint64(seed)
    for multiplier in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(multiplier)
    return h ^ (h >> np.uint64(33))


def fingerprint(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(32)) ^ h).astype(np.uint8)


def places(h: np.ndarray, segment: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Three places in consecutive segments; the first is dealt over ``span`` by the high bits."""
    mask = np.uint64(segment - 1)
    a = ((h >> np.uint64(32)) * np.uint64(span)) >> np.uint64(32)
    b = (a + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
    c = (a + np.uint64(2 * segment)) ^ (h & mask)
    return a.astype(np.int64), b.astype(np.int64), c.astype(np.int64)


def shape(n: int) -> tuple[int, int, int]:
    """(segment, span, size) for ``n`` keys, by the published rule for three places."""
    if n < 2:
        return 4, 4, 12
    segment = min(1 << 18, 1 << max(2, int(math.floor(math.log(n) / math.log(3.33) + 2.25))))
    factor = max(1.125, 0.875 + 0.25 * math.log(1_000_000) / math.log(n))
    segments = max(1, math.ceil(round(n * factor) / segment) - 2)
    return segment, segments * segment, (segments + 2) * segment


def build(keys: np.ndarray) -> Filter:
    """Filter of distinct ``keys``."""
    keys = np.unique(np.asarray(keys).astype(np.uint64, copy=False))
    if not len(keys):
        return Filter(0, 4, 4, np.empty(0, np.uint8))
    segment, span, size = shape(len(keys))
    for seed in range(1, ATTEMPTS + 1):
        h = mixed(keys, seed * 0x9E3779B97F4A7C15 % (1 << 64))
        at = np.stack(places(h, segment, span))
        waves = _peeled(at, size)
        if waves is not None:
            prints = np.zeros(size, np.uint8)
            wanted = fingerprint(h)
            for key, place in reversed(waves):
                # its own place is still 0, so the three give what the other two hold
                others = prints[at[0, key]] ^ prints[at[1, key]] ^ prints[at[2, key]]
                prints[place] = wanted[key] ^ others
            return Filter(seed * 0x9E3779B97F4A7C15 % (1 << 64), segment, span, prints)
    raise ValueError(f"no filter for {len(keys)} keys in {ATTEMPTS} attempts")


def _peeled(at: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Waves of (key, its own place); None where some keys never get a place of their own."""
    n = at.shape[1]
    held = np.bincount(at.ravel(), minlength=size)
    who = np.zeros(size, np.int64)  # the keys of a place, xor-ed: the key itself where there is one
    for row in at:
        np.bitwise_xor.at(who, row, np.arange(n))
    front, waves, done = np.flatnonzero(held == 1), [], 0
    while len(front):
        key, first = np.unique(who[front], return_index=True)
        waves.append((key, front[first]))
        done += len(key)
        touched = at[:, key].ravel()
        np.subtract.at(held, touched, 1)
        np.bitwise_xor.at(who, touched, np.tile(key, 3))
        touched = np.unique(touched)
        front = touched[held[touched] == 1]
    return waves if done == n else None
