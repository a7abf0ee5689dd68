"""Minimal perfect hashing of string keys, vectorised.

Level by level, keys that are alone at their bit of a bit array are settled
there; the others go on to the next, smaller level.  A key's slot is the number
of set bits before its own, so n keys fill slots 0..n-1 and a lookup probes
fewer than two bits on average, whatever n is.  A stored 32-bit fingerprint
tells keys that were never in the set.
"""

from __future__ import annotations

import struct

import numpy as np
import xxhash

LEVELS = 40
GAMMA = 2


def digests(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each key: one to place it, one as its fingerprint."""
    place = np.fromiter((xxhash.xxh64_intdigest(k, 1) for k in keys), np.uint64, len(keys))
    check = np.fromiter((xxhash.xxh32_intdigest(k, 2) for k in keys), np.uint32, len(keys))
    return place, check


def _mix(h: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h + np.uint64(0x9E3779B97F4A7C15) * np.uint64(level + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """levels: bit arrays; left: place hashes that never got a bit of their own (slots at the end)."""

    def __init__(self, levels: list[np.ndarray], left: np.ndarray):
        self.levels, self.left = levels, left
        self.ranks, n = [], 0
        for bits in levels:
            ones = np.cumsum(np.bitwise_count(bits.view("<u8")).astype(np.int64))
            self.ranks.append(n + np.concatenate([[0], ones[:-1]]) if len(ones) else np.zeros(0, np.int64))
            n += int(ones[-1]) if len(ones) else 0
        self.settled = n

    @classmethod
    def build(cls, place: np.ndarray) -> "PerfectHash":
        """Of distinct place hashes."""
        levels, rest = [], np.unique(place)
        for level in range(LEVELS):
            if not len(rest):
                break
            size = -(-GAMMA * len(rest) // 64) * 64
            at = _mix(rest, level) % np.uint64(size)
            count = np.bincount(at.astype(np.int64), minlength=size)
            levels.append(np.packbits(count == 1, bitorder="little"))
            rest = rest[count[at.astype(np.int64)] > 1]
        return cls(levels, rest)

    def slots(self, place: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where the key certainly isn't in the set."""
        out = np.full(len(place), -1, np.int64)
        todo = np.arange(len(place))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            if not len(todo):
                return out
            at = (_mix(place[todo], level) % np.uint64(len(bits) * 8)).astype(np.int64)
            hit = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            found, where = todo[hit], at[hit]
            words = bits.view("<u8")[where >> 6]
            below = words & ((np.uint64(1) << (where & 63).astype(np.uint64)) - np.uint64(1))
            out[found] = ranks[where >> 6] + np.bitwise_count(below)
            todo = todo[~hit]
        if len(todo) and len(self.left):
            k = np.searchsorted(self.left, place[todo]).clip(max=len(self.left) - 1)
            hit = self.left[k] == place[todo]
            out[todo[hit]] = self.settled + k[hit]
        return out

    def to_bytes(self) -> bytes:
        head = struct.pack("<II", len(self.levels), len(self.left)) + struct.pack(f"<{len(self.levels)}Q", *map(len, self.levels))
        return head + b"".join(x.tobytes() for x in self.levels) + self.left.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> "PerfectHash":
        n, left = struct.unpack_from("<II", data)
        sizes, at, levels = struct.unpack_from(f"<{n}Q", data, 8), 8 + 8 * n, []
        for size in sizes:
            levels.append(np.frombuffer(data, np.uint8, size, at).copy())
            at += size
        return cls(levels, np.frombuffer(data, "<u8", left, at))
