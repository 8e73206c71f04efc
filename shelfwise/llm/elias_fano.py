"""Elias-Fano sequences and a two-level n-gram trie in memory-mapped arrays."""

from __future__ import annotations

import os
import tempfile

import numpy as np

U = np.uint64
PAGE = 512  # bits of the upper part that share one directory entry
STEP = 1 << 16  # elements decoded at a time by a bulk search


class EliasFano:
    """A non-decreasing uint64 sequence: low bits packed, high parts in unary with a directory of counts."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, directory: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.directory = n, low_bits, low, high, directory

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        v, n = values.astype(U), len(values)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(1, np.int64))
        bits = max(0, ((int(v[-1]) + 1) // n).bit_length() - 1)
        low = []
        for i in range(0, n, STEP):  # STEP is a multiple of 8, so pieces end on bytes
            part = ((v[i : i + STEP, None] >> np.arange(bits, dtype=U)) & U(1)).astype(np.uint8)
            low.append(np.packbits(part.ravel(), bitorder="little"))
        at = (v >> U(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(-(-(int(at[-1]) + 1) // PAGE) * PAGE, np.uint8)
        flags[at] = 1
        directory = np.concatenate([[0], np.cumsum(flags.reshape(-1, PAGE).sum(1, dtype=np.int64))])
        return cls(n, bits, np.concatenate(low), np.packbits(flags, bitorder="little"), directory)

    def decode(self, i: int, j: int) -> np.ndarray:
        """Values i to j - 1."""
        if j <= i:
            return np.zeros(0, U)
        a = int(np.searchsorted(self.directory, i, side="right")) - 1
        b = int(np.searchsorted(self.directory, j, side="left"))
        ones = np.flatnonzero(np.unpackbits(np.asarray(self.high[a * PAGE // 8 : b * PAGE // 8]), bitorder="little"))
        skip = i - int(self.directory[a])
        high = ones[skip : skip + j - i] + a * PAGE - np.arange(i, j)
        out = high.astype(U) << U(self.low_bits)
        if self.low_bits:
            first, last = i * self.low_bits, j * self.low_bits
            bits = np.unpackbits(np.asarray(self.low[first // 8 : -(-last // 8)]), bitorder="little")[first % 8 :][: last - first].reshape(-1, self.low_bits)
            for k in range(self.low_bits):
                out |= bits[:, k].astype(U) << U(k)
        return out

    def at(self, index: np.ndarray) -> np.ndarray:
        """Values at sorted places."""
        out = np.zeros(len(index), U)
        for i in range(0, self.n, STEP):
            lo, hi = np.searchsorted(index, [i, i + STEP])
            if lo < hi:
                first = int(index[lo])
                out[lo:hi] = self.decode(first, int(index[hi - 1]) + 1)[index[lo:hi] - first]
        return out

    def find(self, wanted: np.ndarray, ranges: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Successor search for sorted values: the place of each one that occurs (its last one), else -1. With ranges (from,
        to) of places, one for each value, only the parts of the sequence that some range touches are decoded."""
        out = np.full(len(wanted), -1, np.int64)
        if not self.n or not len(wanted):
            return out
        steps, lo = np.arange(-(-self.n // STEP)), 0
        if ranges is not None:
            touched = np.zeros(len(steps) + 1, np.int64)
            np.add.at(touched, ranges[0] // STEP, 1)
            np.add.at(touched, (ranges[1] - 1) // STEP + 1, -1)
            steps = np.flatnonzero(np.cumsum(touched)[:-1])
        for i in (steps * STEP).tolist():
            part = self.decode(i, min(self.n, i + STEP))
            lo += int(np.searchsorted(wanted[lo:], part[0]))
            hi = int(np.searchsorted(wanted, part[-1], side="right"))
            if lo < hi:
                k = np.searchsorted(part, wanted[lo:hi])
                out[lo:hi] = np.where(part[k] == wanted[lo:hi], i + k, -1)
                lo = hi
        return out

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits], np.int64), self.low, self.high, self.directory]


class Trie:
    """Contexts, pointers to their successors, successors as context-relative values, and quantised log probabilities. One
    level of an n-gram trie: the contexts of the first are words, those of the next are places of the level before.

    A successor is kept as the rank of its word among the trie's successor words plus its context's base, which is one
    more than the value before the context's range, so the level is one increasing sequence.
    """

    def __init__(self, arrays: list[np.ndarray]):
        seqs = [EliasFano(*a[0].tolist(), *a[1:]) for a in (arrays[0:4], arrays[4:8], arrays[8:12], arrays[12:16])]
        self.contexts, self.pointers, self.words, self.successors = seqs
        self.codes, self.book = arrays[16], arrays[17]

    @classmethod
    def build(cls, context: np.ndarray, word: np.ndarray, log_prob: np.ndarray) -> Trie:
        """context, word: uint64, distinct pairs sorted by (context, word); log_prob: float."""
        contexts, start = np.unique(context, return_index=True)
        words, rank = np.unique(word, return_inverse=True)
        ends = np.append(start[1:], len(context))
        top = rank[ends - 1] + 1 if len(context) else np.zeros(0, np.int64)
        base = np.cumsum(top) - top
        values = np.repeat(base, ends - start) + rank
        # half of the levels at quantiles, half evenly spaced, so the rare extremes stay near their values too
        ends_of = (log_prob.min(), log_prob.max()) if len(log_prob) else (0.0, 0.0)
        book = np.unique(np.concatenate([np.quantile(log_prob, np.linspace(0, 1, 127)) if len(log_prob) else [], np.linspace(*ends_of, 128)]).astype(np.float16).astype(np.float32))
        middle = (book[1:] + book[:-1]) / 2
        codes = (np.searchsorted(middle, log_prob) + 1).astype(np.uint8)
        seqs = [EliasFano.build(x) for x in (contexts, np.append(start, len(context)), words, values)]
        return cls([a for s in seqs for a in s.arrays()] + [codes, book])

    def mapped(self) -> Trie:
        """The same trie over one memory-mapped file, which is unlinked at once and so cannot be left behind."""
        arrays = [a for s in (self.contexts, self.pointers, self.words, self.successors) for a in s.arrays()] + [self.codes, self.book]
        fd, path = tempfile.mkstemp()
        try:
            with os.fdopen(fd, "wb") as f:
                places = []
                for a in arrays:
                    f.write(b"\0" * (-f.tell() % 8))
                    places.append(f.tell())
                    f.write(np.ascontiguousarray(a).tobytes())
                f.write(b"\0" * 8)
            whole = np.memmap(path, np.uint8, "r")
        finally:
            os.unlink(path)
        return Trie([np.asarray(whole[p : p + a.nbytes]).view(a.dtype) for p, a in zip(places, arrays)])

    def lookup(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Codes (0: not in the trie) of pairs sorted by (context, word)."""
        out = np.zeros(len(context), np.uint8)
        if not len(context) or not self.contexts.n:
            return out
        asked, where = np.unique(context, return_inverse=True)
        rank = self.contexts.find(asked)
        known = rank >= 0
        lo, hi, base, top = (np.zeros(len(asked), np.int64) for _ in range(4))
        lo[known], hi[known] = self.pointers.at(rank[known]).astype(np.int64), self.pointers.at(rank[known] + 1).astype(np.int64)
        later = known & (lo > 0)
        base[later] = self.successors.at(lo[later] - 1).astype(np.int64) + 1
        top[known] = self.successors.at(hi[known] - 1).astype(np.int64)
        words, back = np.unique(word, return_inverse=True)
        ident = self.words.find(words)[back]
        value = base[where] + ident
        ok = known[where] & (ident >= 0) & (value <= top[where])
        place = self.successors.find(value[ok].astype(U), (lo[where[ok]], hi[where[ok]]))
        got = np.flatnonzero(ok)[place >= 0]
        out[got] = self.codes[place[place >= 0]]
        return out
