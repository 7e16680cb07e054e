"""A compressed set of text positions with rank selection.

Positions are split by their high bits into containers of 65,536 places.  A
container is an ``array`` of its low halves, a ``bitmap`` of 65,536 bits or
``runs`` of (first, length), whichever is smallest.  Cumulative cardinalities
tell which container holds the k-th position; a select inside it gives the
position: by index, by counting bits of 64-bit words, or by the runs' own
cumulative lengths.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable

import numpy as np

PLACES = 1 << 16
_WORDS = PLACES // 64


class Container:
    """Sorted distinct numbers below 65,536."""

    def __init__(self, low: np.ndarray):
        self.size = len(low)
        breaks = np.flatnonzero(np.diff(low.astype(np.int32)) != 1) + 1
        cost = {"array": 2 * self.size, "bitmap": PLACES // 8, "runs": 4 * (len(breaks) + 1)}
        self.kind = min(cost, key=cost.__getitem__)
        if self.kind == "array":
            self.data = low.astype(np.uint16)
        elif self.kind == "runs":
            starts = np.concatenate([[0], breaks])
            self.data = low[starts].astype(np.uint16)
            self.before = starts.astype(np.uint32)  # members before each run
        else:
            bits = np.zeros(PLACES, np.uint8)
            bits[low] = 1
            self.data = np.packbits(bits, bitorder="little").view("<u8")
            counts = np.bitwise_count(self.data).astype(np.uint32)
            self.before = np.cumsum(counts) - counts  # members before each word

    def select(self, k: int) -> int:
        """The k-th member, from 0."""
        if self.kind == "array":
            return int(self.data[k])
        at = int(np.searchsorted(self.before, k, "right")) - 1
        rest = k - int(self.before[at])
        if self.kind == "runs":
            return int(self.data[at]) + rest
        word = int(self.data[at])
        for _ in range(rest):
            word &= word - 1
        return at * 64 + (word & -word).bit_length() - 1


class BoundarySet:
    """Sorted distinct positions, added container by container."""

    def __init__(self) -> None:
        self.keys: list[int] = []
        self.containers: list[Container] = []
        self.before: list[int] = []
        self.size = 0

    def append(self, key: int, low: np.ndarray) -> None:
        """The members of container ``key``, above all keys so far."""
        if len(low):
            self.keys.append(key)
            self.containers.append(Container(low))
            self.before.append(self.size)
            self.size += len(low)

    @classmethod
    def of(cls, positions: Iterable[int]) -> BoundarySet:
        out = cls()
        found = np.unique(np.fromiter(positions, np.int64))
        keys = found // PLACES
        for key in np.unique(keys):
            out.append(int(key), found[keys == key] % PLACES)
        return out

    def select(self, k: int) -> int:
        """The k-th position, from 0."""
        if not 0 <= k < self.size:
            raise IndexError(k)
        at = bisect_right(self.before, k) - 1
        return self.keys[at] * PLACES + self.containers[at].select(k - self.before[at])


def line_boundaries(text: str) -> BoundarySet:
    """0 and the ends of all lines, in code points; a line takes the break that ends it with it."""
    out = BoundarySet()
    carry = True  # whether the next container begins with a boundary
    for at in range(0, len(text) + 1, PLACES):
        part = text[at:at + PLACES]
        marks = np.zeros(len(part) + 1, bool)
        marks[0] = carry
        if part:
            marks[1:] = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4") == 10
        if at + len(part) == len(text):
            marks[-1] = True
        carry = bool(marks[PLACES]) if len(part) == PLACES else False
        out.append(at // PLACES, np.flatnonzero(marks[:PLACES]))
    return out
