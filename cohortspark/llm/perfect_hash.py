"""Minimal perfect hashing of distinct 32-bit keys, with the keys themselves to verify a look-up.

Level by level, keys fall into twice as many places as keys are left; a key alone in its place marks it, the others go on.
A key's number is the count of marks before its own, so n keys get the numbers 0 to n - 1, at about three bits a key.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from cohortspark.llm.wordkit import mix

#: Places per key of a level.
SPACE = 2
#: Levels after which building is given up; the keys left shrink by a constant share per level.
LEVELS = 200


def places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return mix(keys.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(size)


@dataclass
class PerfectHash:
    """sizes: places of each level, multiples of 64; words: marks of all levels; keys: by number."""

    sizes: np.ndarray
    words: np.ndarray
    keys: np.ndarray

    def __post_init__(self):
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        """Hash of distinct keys."""
        left, sizes, words = keys, [], []
        while len(left):
            if len(sizes) == LEVELS:
                raise ValueError("keys repeat")
            size = -(-SPACE * len(left) // 64) * 64
            at = places(left, len(sizes), size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = left[~alone[at]]
        made = cls(np.array(sizes, np.int64), np.concatenate([np.zeros(0, np.uint64), *words]), np.zeros(len(keys), np.uint32))
        made.keys[made.numbers(keys)] = keys
        return made

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key; any number or -1 for a key that was not built in."""
        out = np.full(len(keys), -1, np.int64)
        left, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            at = places(keys[left], level, size)
            word, bit = base + (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            marks = self.words[word] >> bit
            hit = (marks & np.uint64(1)).astype(bool)
            lower = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[hit]] = (self.before[word] + np.bitwise_count(lower).astype(np.int64))[hit]
            left, base = left[~hit], base + size // 64
        return out

    def verified(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key, -1 where the key kept under that number is another one."""
        found = self.numbers(keys)
        known = found >= 0
        known[known] = self.keys[found[known]] == keys[known]
        return np.where(known, found, -1)

    def dump(self) -> dict[str, bytes]:
        return {"sizes": self.sizes.tobytes(), "words": self.words.tobytes(), "hash_keys": self.keys.tobytes()}

    @classmethod
    def load(cls, sizes: bytes, words: bytes, hash_keys: bytes) -> "PerfectHash":
        return cls(np.frombuffer(sizes, np.int64), np.frombuffer(words, np.uint64), np.frombuffer(hash_keys, np.uint32))
