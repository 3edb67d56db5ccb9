"""Cuckoo filters over whole arrays of hashes: adding, looking up and removing run as rounds of array operations."""

from __future__ import annotations

import numpy as np

from tessera.llm.common import mix

SLOTS, ROUNDS = 4, 100


class Cuckoo:
    """A set of 128-bit digests, of which it keeps marks of 16 bits. It may say yes wrongly (about 8 in 65536 lookups), never no.

    A mark lies in one of two buckets, and either follows from the other and the mark. When no place is left, another table of the
    same size stands beside the first, so that digests that share mark and buckets share them in every table, and removing any one
    of their marks leaves the others found. Slots of a bucket are used from the left; 0 is a free one.
    """

    def __init__(self, buckets: int, raw: bytes = b"") -> None:
        self.buckets = buckets
        self.tables = [t.copy() for t in np.frombuffer(raw, np.uint16).reshape(-1, buckets, SLOTS)]

    def raw(self) -> bytes:
        return b"".join(t.tobytes() for t in self.tables)

    def _places(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marks and first buckets of digests, given as rows of two 64-bit halves."""
        marks = (digests[:, 1] % np.uint64(65535)).astype(np.uint16) + np.uint16(1)
        return marks, (digests[:, 0] & np.uint64(self.buckets - 1)).astype(np.int64)

    def _other(self, at: np.ndarray, marks: np.ndarray) -> np.ndarray:
        return at ^ (mix(marks.astype(np.uint64)) & np.uint64(self.buckets - 1)).astype(np.int64)

    def has(self, digests: np.ndarray) -> np.ndarray:
        marks, at = self._places(digests)
        found = np.zeros(len(marks), bool)
        for table in self.tables:
            for b in (at, self._other(at, marks)):
                found |= (table[b] == marks[:, None]).any(axis=1)
        return found

    def add(self, digests: np.ndarray) -> None:
        """Add digests that are not in the set yet, each once."""
        marks, at = self._places(digests)
        for i in range(len(digests) + 1):
            if not len(marks):
                return
            if i == len(self.tables):
                self.tables.append(np.zeros((self.buckets, SLOTS), np.uint16))
            marks, at = self._fill(self.tables[i], marks, at)

    def _fill(self, table: np.ndarray, marks: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Put marks into the table; returns those without a place and one of their buckets."""
        for turn in range(ROUNDS):
            order = np.argsort(at, kind="stable")
            marks, at = marks[order], at[order]
            starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            rank = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
            used = (table[at] != 0).sum(axis=1)
            fits = used + rank < SLOTS
            table[at[fits], (used + rank)[fits]] = marks[fits]
            marks, at, first = marks[~fits], at[~fits], (used + rank == np.maximum(used, SLOTS))[~fits]
            if not len(marks):
                break
            if turn:  # both buckets are full: one mark of each bucket makes room
                b, slot = at[first], turn % SLOTS
                marks[first], table[b, slot] = table[b, slot], marks[first]
            at = self._other(at, marks)
        return marks, at

    def remove(self, digests: np.ndarray) -> None:
        """Remove digests that were added, each once."""
        marks, at = self._places(digests)
        for table in self.tables:
            while len(marks):
                pair = np.minimum(at, self._other(at, marks)) * 65536 + marks
                turn = np.zeros(len(pair), bool)
                turn[np.unique(pair, return_index=True)[1]] = True
                gone = np.zeros(len(pair), bool)
                for b in (at, self._other(at, marks)):
                    k = np.flatnonzero(turn & ~gone)
                    same = table[b[k]] == marks[k][:, None]
                    k, slot = k[same.any(axis=1)], same.argmax(axis=1)[same.any(axis=1)]
                    table[b[k], slot] = 0
                    gone[k] = True
                    rows = np.unique(b[k])
                    table[rows] = np.sort(table[rows], axis=1)[:, ::-1]
                if not gone.any():
                    break
                marks, at = marks[~gone], at[~gone]
