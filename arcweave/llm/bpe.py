"""Byte-level BPE through a compact hash table of pre-tokens, filled by the worker as it meets new ones.

Texts are cut into pre-tokens as arrays over code points; each pre-token is looked up by a 64-bit hash
in an open-addressing numpy table that gives its code points, which are compared, and its ids. What the table lacks is
encoded once and kept.
Texts with code points whose class differs between Unicode versions, or with a special token's string,
go to the tokenizers library whole.
"""

from __future__ import annotations

import json
import unicodedata
from functools import cached_property

import numpy as np

from arcweave.llm.textkit import FIRST, U, mix

STRANGE, BLANK, OTHER, LETTER, NUMBER = range(5)
#: Slots of a worker's table, and how full it may get; ids and code points kept beside it.
SLOTS, FULL, POOL, SIGNS = 1 << 19, 0.7, 1_500_000, 3_000_000
SUFFIXES = ("s", "t", "m", "d", "re", "ve", "ll")


def _classes() -> np.ndarray:
    out = np.full(0x250, OTHER, np.uint8)
    for c in range(0x250):
        kind = unicodedata.category(chr(c))
        out[c] = LETTER if kind[0] == "L" else NUMBER if kind[0] == "N" else OTHER
    out[[9, 10, 11, 12, 13, 32]] = BLANK
    out[[0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0]] = STRANGE  # blank in some libraries only
    return out


CLASSES = _classes()


def cuts(points: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where pre-tokens start: runs of letters, of digits or of other signs, each with one space before it;
    blanks before that space; and the short English endings after an apostrophe."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    run = np.ones(n, bool)  # a run of one class starts
    run[1:] = (kinds[1:] != kinds[:-1]) | edge[1:-1]
    blank = kinds == BLANK
    starts = run.copy()
    solid = np.flatnonzero(run & ~blank)
    before = solid[(solid > 0) & ~edge[solid]] - 1
    before = before[blank[before]]  # the last blank ahead of a solid run
    starts[before] = True
    starts[before[points[before] == 32] + 1] = False
    quotes = np.flatnonzero((points == 39) & starts)
    quotes = quotes[quotes + 1 < n]
    quotes = quotes[~edge[quotes + 1] & (kinds[quotes + 1] == LETTER)]
    for s in SUFFIXES:
        at = quotes[quotes + len(s) < n]
        for i, c in enumerate(s):
            at = at[(points[at + 1 + i] == ord(c)) & ~edge[at + 1 + i]]
        starts[at + 1] = False
        after = at + 1 + len(s)
        after = after[after < n]
        starts[after[~edge[after] & (kinds[after] == LETTER)]] = True
    return np.flatnonzero(starts)


def _bytes_of() -> dict[str, int]:
    """The printable sign that stands for each byte in the vocabulary file, and back."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def probed(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slot that has or could take each hash, whether it has it) in an open-addressing table of a power of two."""
    slot = (h & U(len(keys) - 1)).astype(np.int64)
    found = keys[slot] == h
    left = np.flatnonzero(~found & (keys[slot] != 0))
    while len(left):
        slot[left] = (slot[left] + 1) & (len(keys) - 1)
        k = keys[slot[left]]
        found[left] = k == h[left]
        left = left[(k != h[left]) & (k != 0)]
    return slot, found


def same_signs(points: np.ndarray, start: np.ndarray, end: np.ndarray, signs: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether each pre-token has the very code points that stand at `begin` in `signs`."""
    size = end - start
    ok = length == size
    own = np.flatnonzero(ok)
    size = size[own]
    ahead = np.cumsum(size) - size
    step = np.arange(int(size.sum()))
    equal = points[np.repeat(start[own] - ahead, size) + step] == signs[np.repeat(begin[own] - ahead, size) + step]
    wrong = np.flatnonzero(~equal)
    if len(wrong):
        ok[own[np.searchsorted(ahead, wrong, "right") - 1]] = False
    return ok


class Lengths:
    """The first tier: a compact hash table of frequent pre-tokens and the number of tokens of each, a few arrays that are
    broadcast once and used where they lie. Of pre-tokens with one hash the first is kept."""

    def __init__(self, keys: np.ndarray, texts: list[str], tokens: np.ndarray):
        size = 1 << max(4, (2 * len(texts)).bit_length())
        self.keys, self.tokens = np.zeros(size, np.uint64), np.zeros(size, np.uint16)
        self.begin, self.length = np.zeros(size, np.int32), np.zeros(size, np.uint16)
        self.signs = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        at = 0
        for h, text, n in zip(keys.tolist(), texts, tokens.tolist()):
            s = h & (size - 1)
            while self.keys[s] and self.keys[s] != h:
                s = (s + 1) & (size - 1)
            if not self.keys[s]:
                self.keys[s], self.tokens[s], self.begin[s], self.length[s] = h, n, at, len(text)
            at += len(text)

    def found(self, points: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether the table has each pre-token, number of its tokens)."""
        slot, have = probed(self.keys, h)
        own = slot[have]
        have[have] = same_signs(points, start[have], end[have], self.signs, self.begin[own], self.length[own])
        return have, np.where(have, self.tokens[slot], 0)


class Encoder:
    """Token ids of whole texts for one vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        self.path = path
        spec = json.load(open(path, encoding="utf-8"))
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.single = self._single(spec)
        self.keys = np.zeros(SLOTS, np.uint64)
        self.at = np.zeros(SLOTS, np.int32)
        self.size = np.zeros(SLOTS, np.uint16)
        self.pool = np.zeros(POOL, np.uint32)
        self.begin = np.zeros(SLOTS, np.int32)
        self.length = np.zeros(SLOTS, np.uint16)
        self.signs = np.zeros(SIGNS, np.uint32)
        self.filled = self.used = self.written = 0

    @cached_property
    def whole(self):
        """The library itself, loaded when the first text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _single(self, spec: dict):
        """A fast encoder of one pre-token; None if the file isn't plain byte-level BPE with ids in merge order."""
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model.get("merges", [])]
        if not plain or any(model["vocab"].get(m) != 256 + i for i, m in enumerate(merged)):
            return None
        import tiktoken

        code = _bytes_of()
        ranks = {bytes(code[c] for c in token): i for token, i in model["vocab"].items() if i < 256 + len(merged)}
        made = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
        return made._core_bpe.encode_single_piece

    def _slot(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return probed(self.keys, h)

    def add(self, h: int, points: np.ndarray, ids: list[int]) -> None:
        """Keeps the ids of a pre-token that the table lacks, as long as there is room."""
        if self.filled >= FULL * SLOTS or len(points) >= 1 << 16 or self.used + len(ids) > POOL or self.written + len(points) > SIGNS:
            return
        s, keys = h & (SLOTS - 1), self.keys
        while keys[s]:
            if keys[s] == h:  # another pre-token has this hash
                return
            s = (s + 1) & (SLOTS - 1)
        keys[s], self.at[s], self.size[s] = h, self.used, len(ids)
        self.begin[s], self.length[s] = self.written, len(points)
        self.pool[self.used : self.used + len(ids)] = ids
        self.signs[self.written : self.written + len(points)] = points
        self.used += len(ids)
        self.written += len(points)
        self.filled += 1

    def _same(self, points: np.ndarray, start: np.ndarray, end: np.ndarray, slot: np.ndarray) -> np.ndarray:
        return same_signs(points, start, end, self.signs, self.begin[slot], self.length[slot])

    def pretokens(self, points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(class of each code point, first and end of each pre-token, hash of each pre-token)."""
        kinds = np.full(len(points), STRANGE, np.uint8)
        low = points < 0x250
        kinds[low] = CLASSES[points[low]]
        start = cuts(points, at, kinds)
        end = np.append(start[1:], len(points))
        sums = FIRST.prefix(mix(points.astype(np.uint64) + U(1)))
        return kinds, start, end, mix(FIRST.span(sums, start, end) + (end - start).astype(np.uint64)) | U(1)

    def encode(self, data: np.ndarray, offsets: np.ndarray, points: np.ndarray, at: np.ndarray, want_ids: bool = True, lengths: Lengths | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """(tokens of each text, ids of all texts one after another or None). `lengths`, looked up before the worker's own
        table, is of use where no ids are wanted."""
        n = len(at) - 1
        kinds, start, end, h = self.pretokens(points, at)
        odd = np.zeros(n, bool)
        if self.single is None:
            odd[:] = True
        strange = np.flatnonzero(kinds == STRANGE)
        odd[np.searchsorted(at, strange, "right") - 1] = True
        raw = data.tobytes()
        for s in self.special:
            b, i = s.encode(), raw.find(s.encode())
            while i >= 0:
                odd[np.searchsorted(offsets, i, "right") - 1] = True
                i = raw.find(b, i + len(b))
        owner = np.searchsorted(at, start, "right") - 1
        if odd.any():
            keep = ~odd[owner]
            start, end, owner, h = start[keep], end[keep], owner[keep], h[keep]
        ahead = np.zeros(n)
        if lengths is not None and not want_ids:
            have, tokens = lengths.found(points, start, end, h)
            ahead = np.bincount(owner, tokens, n)
            start, end, owner, h = start[~have], end[~have], owner[~have], h[~have]
        slot, found = self._slot(h)
        if not found.all():
            _, first = np.unique(h[~found], return_index=True)
            for i in np.flatnonzero(~found)[first].tolist():
                own = points[start[i] : end[i]]
                self.add(int(h[i]), own, self.single(own.tobytes().decode("utf-32-le").encode()))
            slot, found = self._slot(h)
        found[found] = self._same(points, start[found], end[found], slot[found])
        extra: dict[int, list[int]] = {}
        if not found.all():  # the table is full, or another pre-token has the hash
            spill: dict[bytes, list[int]] = {}
            for i in np.flatnonzero(~found).tolist():
                own = points[start[i] : end[i]].tobytes()
                if own not in spill:
                    spill[own] = self.single(own.decode("utf-32-le").encode())
                extra[i] = spill[own]
        size = np.where(found, self.size[slot], 0).astype(np.int64)
        for i, ids in extra.items():
            size[i] = len(ids)
        counts = (ahead + np.bincount(owner, size, n)).astype(np.int64)
        whole = {int(r): self.whole.encode(raw[offsets[r] : offsets[r + 1]].decode("utf-8", "replace"), add_special_tokens=False).ids for r in np.flatnonzero(odd)}
        for r, ids in whole.items():
            counts[r] = len(ids)
        if not want_ids:
            return counts, None
        total = int(size.sum())
        ahead = np.cumsum(size) - size
        ids = self.pool[np.repeat(np.where(found, self.at[slot], 0) - ahead, size) + np.arange(total)] if not extra else self._mixed(slot, found, size, ahead, total, extra)
        if whole:
            first = np.searchsorted(owner, np.arange(n + 1))
            edge = np.append(ahead, total)[first]
            ids = np.concatenate([x for r in range(n) for x in ([np.array(whole[r], np.uint32)] if r in whole else [ids[edge[r] : edge[r + 1]]])])
        return counts, ids

    def _mixed(self, slot, found, size, ahead, total, extra):
        at = np.where(found, self.at[slot], 0)
        pick = np.repeat(at - ahead, size) + np.arange(total)
        out = self.pool[np.minimum(pick, POOL - 1)]
        for i, ids in extra.items():
            out[ahead[i] : ahead[i] + len(ids)] = ids
        return out


_OPEN: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of that file, kept between tasks."""
    if path not in _OPEN:
        _OPEN[path] = Encoder(path)
    return _OPEN[path]
