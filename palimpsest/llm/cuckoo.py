"""Cuckoo filters: approximate sets of 64-bit hashes that also forget."""

from __future__ import annotations

import struct

import numpy as np

SLOTS = 4
KICKS = 500
MIX = 0xFF51AFD7ED558CCD


class Cuckoo:
    """One table of 16-bit tags, four to a bucket; a hash lives in one of two buckets."""

    def __init__(self, buckets: int, tags: np.ndarray | None = None) -> None:
        self.mask = buckets - 1  # a power of two
        self.tags = np.zeros((buckets, SLOTS), np.uint16) if tags is None else tags

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tag, bucket, other bucket)"""
        hashes = hashes.astype(np.uint64)
        tag = (hashes >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)
        mask = np.uint64(self.mask)
        bucket = hashes & mask
        return tag.astype(np.uint16), bucket.astype(np.int64), (bucket ^ (self._turn(tag) & mask)).astype(np.int64)

    @staticmethod
    def _turn(tag: np.ndarray) -> np.ndarray:
        return (tag.astype(np.uint64) * np.uint64(MIX)) >> np.uint64(20)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        tag, a, b = self.places(hashes)
        return ((self.tags[a] == tag[:, None]) | (self.tags[b] == tag[:, None])).any(1)

    def insert(self, value: int) -> bool:
        """False if the table is full; it is then as before."""
        tag, a, b = (x[0] for x in self.places(np.array([value], np.uint64)))
        for at in (a, b):
            free = np.flatnonzero(self.tags[at] == 0)
            if len(free):
                self.tags[at, free[0]] = tag
                return True
        moved, at = [], int(b)
        for n in range(KICKS):
            slot = n % SLOTS
            out = self.tags[at, slot]
            self.tags[at, slot] = tag
            moved.append((at, slot, out))
            tag, at = out, int(at ^ (int(self._turn(np.array([out]))[0]) & self.mask))
            free = np.flatnonzero(self.tags[at] == 0)
            if len(free):
                self.tags[at, free[0]] = tag
                return True
        for at, slot, out in reversed(moved):
            self.tags[at, slot] = out
        return False

    def delete(self, value: int) -> bool:
        tag, a, b = (x[0] for x in self.places(np.array([value], np.uint64)))
        for at in (a, b):
            held = np.flatnonzero(self.tags[at] == tag)
            if len(held):
                self.tags[at, held[0]] = 0
                return True
        return False


class Filter:
    """Cuckoo tables of growing size; a full one is followed by one twice as large. No hash inserted and not deleted is missed.

    In one table equal tags of one bucket stand for each other, so any of them may go. Between tables of different size they do not:
    `deletable` says whether there is one table only, and where there are more, the filter is built anew from its hashes.
    """

    def __init__(self, tables: list[Cuckoo] | None = None) -> None:
        self.tables = tables or [Cuckoo(128)]

    @classmethod
    def of(cls, values: list[int]) -> Filter:
        """A filter with these hashes in one table with room for as many again, or more tables where their buckets collide."""
        buckets = 128
        while buckets * SLOTS < 2 * len(values):
            buckets *= 2
        one = cls([Cuckoo(buckets)])
        for v in values:
            one.insert(v)
        return one

    @property
    def deletable(self) -> bool:
        return len(self.tables) == 1

    def insert(self, value: int) -> None:
        while not any(t.insert(value) for t in self.tables[-1:]):
            self.tables.append(Cuckoo(2 * (self.tables[-1].mask + 1)))

    def delete(self, value: int) -> bool:
        if not self.deletable:
            raise ValueError("a filter of several tables is built anew instead")
        return self.tables[0].delete(value)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        found = np.zeros(len(hashes), bool)
        for t in self.tables:
            found |= t.contains(hashes)
        return found

    def to_bytes(self) -> bytes:
        return struct.pack("<I", len(self.tables)) + b"".join(struct.pack("<Q", t.mask + 1) + t.tags.tobytes() for t in self.tables)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Filter:
        count, at, tables = struct.unpack_from("<I", raw)[0], 4, []
        for _ in range(count):
            buckets = struct.unpack_from("<Q", raw, at)[0]
            tags = np.frombuffer(raw, np.uint16, buckets * SLOTS, at + 8).reshape(buckets, SLOTS).copy()
            tables.append(Cuckoo(buckets, tags))
            at += 8 + tags.nbytes
        return cls(tables)
