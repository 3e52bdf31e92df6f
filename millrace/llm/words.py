"""Vectorised fingerprints of words and of runs of words.

A text's bytes become one numpy array. Prefix sums of byte * BASE**position (modulo 2**64) give the
polynomial hash of any stretch as a difference, shifted back by the inverse power; the same trick
over word hashes gives the hash of any run of words. No step loops over words in Python.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
#: Odd multipliers, one per lane.
BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    x = x + U(seed * 0x632BE59BD9B4E019 + 0x1234567 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=4)
def _powers(lane: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    n, base = 1 << bits, BASES[lane]
    steps = np.full(n, base, U)
    steps[0] = 1
    back = np.full(n, pow(base, -1, 1 << 64), U)
    back[0] = 1
    return np.multiply.accumulate(steps), np.multiply.accumulate(back)


def powers(n: int, lane: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(lane, max(20, int(n).bit_length()))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word of each text, first word number of each text, and byte spans (start, end) of the words."""
    joined = b" ".join(texts) + b" "
    data = np.frombuffer(joined, np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    up, back = powers(len(data) + 1, 0)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * back[starts], 1)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    first = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))
    return hashes, first, np.stack([starts, ends])


class Runs:
    """Hashes of runs of consecutive words."""

    def __init__(self, hashes: np.ndarray, lane: int = 0):
        self.up, self.back = powers(len(hashes) + 1, lane)
        self.sums = np.zeros(len(hashes) + 1, U)
        np.cumsum(mix(hashes, 2 + lane) * self.up[: len(hashes)], out=self.sums[1:])
        self.lane = lane

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Of words start..stop-1; the number of words is part of the value."""
        value = (self.sums[stop] - self.sums[start]) * self.back[start]
        return mix(value + (stop - start).astype(U) * U(0xD6E8FEB86659FD93), 4 + self.lane)


def windows(first: np.ndarray, size: int) -> np.ndarray:
    """Starts of all runs of `size` words that lie within one text."""
    total = int(first[-1])
    if total < size:
        return np.zeros(0, np.int64)
    ok = np.zeros(total + 1, np.int64)
    stop = np.maximum(first[1:] - size + 1, first[:-1])
    np.add.at(ok, first[:-1], 1)
    np.add.at(ok, stop, -1)
    return np.flatnonzero(np.cumsum(ok)[:total] > 0)
