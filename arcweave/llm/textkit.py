"""Words and rolling hashes of many texts at once, as numpy arrays over UTF-8 bytes.

Hashes are polynomial prefix sums modulo 2**64: with odd base b, the sum S[i] = c[0] + c[1] b + ... and
the span (s, e) has (S[e] - S[s]) * b**-s, the same wherever the span stands. Bytes first map to random
64-bit values and results pass a finalizer, so equal spans share a hash and others collide with
probability about 2**-64.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
WORD = ~SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Letters, digits and all bytes of other alphabets.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of splitmix."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Roller:
    """Prefix sums modulo 2**64 under one base; up to KEEP powers are kept and grow as needed."""

    KEEP = 1 << 20

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.byte = rng.integers(1, 2**64, 256, dtype=np.uint64)
        self.base = int(rng.integers(0, 2**63)) * 2 + 1
        self.inverse = pow(self.base, -1, 2**64)
        self.pow = self.inv = np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the base and of its inverse, n of each at least. Those of a very long text are made anew and not kept."""
        if len(self.pow) >= n:
            return self.pow, self.inv
        size, out = 1 << (n - 1).bit_length(), []
        for b in (self.base, self.inverse):
            p = np.ones(1, np.uint64)
            while len(p) < size:  # doubles: b**(k+i) = b**k * b**i
                p = np.concatenate([p, p * U(pow(b, len(p), 2**64))])
            out.append(p)
        if size <= self.KEEP:
            self.pow, self.inv = out
        return out[0], out[1]

    def prefix(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.powers(len(values))[0][: len(values)], out=out[1:])
        return out

    def span(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.powers(len(sums))[1][start]


#: Fixed seeds: hashes must agree between tasks and runs.
FIRST, SECOND = Roller(20240501), Roller(77001)


@dataclass
class Words:
    """Words of the texts of one slice: byte spans, hashes, and for each text its range of words."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return self.hi - self.lo

    def text_of(self) -> np.ndarray:
        """For each word the number of its text."""
        return np.repeat(np.arange(len(self.lo)), self.counts)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, inside: np.ndarray = WORD, roller: Roller = FIRST) -> Words:
    """Maximal runs of the bytes in `inside`, never across texts."""
    if lower:
        data = LOWER[data]
    n = len(data)
    own = np.zeros(n + 2, bool)
    own[1:-1] = inside[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    start = np.flatnonzero(own[1:-1] & (~own[:-2] | cut[:-1]))
    end = np.flatnonzero(own[1:-1] & (~own[2:] | cut[1:])) + 1
    at = np.searchsorted(start, offsets)
    sums = roller.prefix(roller.byte[data])
    h = mix(roller.span(sums, start, end) + (end - start).astype(np.uint64) * U(0x9E3779B97F4A7C15))
    return Words(data, start, end, at[:-1], at[1:], h)


def second_hash(w: Words) -> np.ndarray:
    """Another hash of each word, from its bytes by the other roller: two words that share one do not share both."""
    sums = SECOND.prefix(SECOND.byte[w.data])
    return mix(SECOND.span(sums, w.start, w.end) + (w.end - w.start).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def windows(w: Words, k: int, hashes: np.ndarray | None = None, roller: Roller = SECOND, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of each run of k words within a text; with `whole`, a text of 1 to k-1 words is one run."""
    h = w.hash if hashes is None else hashes
    n = len(h)
    sums = roller.prefix(h)
    last = np.repeat(w.hi, w.counts)
    at = np.flatnonzero(np.arange(n) + k <= last)
    got = mix(roller.span(sums, at, at + k) + U(k))
    if whole and len(short := np.flatnonzero((w.counts > 0) & (w.counts < k))):
        s, e = w.lo[short], w.hi[short]
        more = mix(roller.span(sums, s, e) + (e - s).astype(np.uint64))
        order = np.argsort(at := np.concatenate([at, s]), kind="stable")
        at, got = at[order], np.concatenate([got, more])[order]
    return at, got


def decoded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the slice, and the offsets counted in them."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(points) == len(data):
        return points, offsets
    ahead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=ahead[1:])
    return points, ahead[offsets]
