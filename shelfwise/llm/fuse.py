"""Static 3-wise binary fuse filters over 64-bit keys, in numpy."""

from __future__ import annotations

import math

import numpy as np

from .common import mix64

U = np.uint64


class BinaryFuse:
    """An immutable membership filter: no false negatives, false positives about 2**-16."""

    def __init__(self, seed: int, seg_len: int, seg_span: int, table: np.ndarray):
        self.seed, self.seg_len, self.seg_span, self.table = seed, seg_len, seg_span, table

    @staticmethod
    def _slots(h: np.ndarray, seg_len: int, seg_span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = U(seg_len - 1)
        a = ((h >> U(32)) * U(seg_span)) >> U(32)
        b = (a + U(seg_len)) ^ ((h >> U(18)) & mask)
        c = (a + U(2 * seg_len)) ^ (h & mask)
        return a.astype(np.int64), b.astype(np.int64), c.astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse:
        """keys: uint64; repeats count once. An empty set makes a filter that holds nothing."""
        keys = np.unique(keys.astype(U))
        n = len(keys)
        seg_len = min(1 << 18, 1 << max(2, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
        factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2))) if n > 1 else 2.0
        segments = max(1, -(-int(n * factor) // seg_len) - 2) if n else 1
        for seed in range(1, 200):
            seg_span = segments * seg_len
            size = seg_span + 2 * seg_len
            h = mix64(keys ^ U(seed * 0x9E3779B97F4A7C15 & (2**64 - 1)))
            slots = np.stack(cls._slots(h, seg_len, seg_span))
            count = np.bincount(slots.ravel(), minlength=size)
            held = np.zeros(size, np.int64)  # XOR of the indices of the keys that touch a slot
            for s in slots:
                np.bitwise_xor.at(held, s, np.arange(n))
            order, done = [], 0
            while len(free := np.flatnonzero(count == 1)):
                who, first = np.unique(held[free], return_index=True)
                order.append((who, free[first]))
                done += len(who)
                for s in slots[:, who]:
                    np.subtract.at(count, s, 1)
                    np.bitwise_xor.at(held, s, who)
            if done == n:
                break
            if seed % 10 == 0:
                segments += max(1, segments // 10)
        else:
            raise RuntimeError("no acyclic assignment was found")
        table = np.zeros(size, np.uint16)
        finger = (h ^ (h >> U(32))).astype(np.uint16)
        for who, at in reversed(order):  # slots of one round are touched by no other key of it
            a, b, c = slots[:, who]
            table[at] = finger[who] ^ table[a] ^ table[b] ^ table[c]
        return cls(seed, seg_len, seg_span, table if n else np.zeros(0, np.uint16))

    def __contains__(self, key: int) -> bool:
        return bool(self.holds(np.array([key], U))[0])

    def holds(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.table):
            return np.zeros(len(keys), bool)
        h = mix64(keys.astype(U) ^ U(self.seed * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        a, b, c = self._slots(h, self.seg_len, self.seg_span)
        return (h ^ (h >> U(32))).astype(np.uint16) == self.table[a] ^ self.table[b] ^ self.table[c]

    def to_bytes(self) -> bytes:
        return np.array([self.seed, self.seg_len, self.seg_span], "<i8").tobytes() + self.table.astype("<u2").tobytes()

    @classmethod
    def from_bytes(cls, b: bytes) -> BinaryFuse:
        seed, seg_len, seg_span = np.frombuffer(b[:24], "<i8").tolist()
        return cls(seed, seg_len, seg_span, np.frombuffer(b[24:], "<u2"))
