"""External counting of pairs: sorted zstd runs, k-way merge, maxima per left id.

A record says that document ``doc`` of a slice holds the pair (left, right)
``times`` times.  ``cut_runs`` sorts a slice's records by radix of the left id,
pair and document and packs each radix as one run, in two sections: the pairs
with their numbers of documents, and the documents with their times.  The first
section is all that counting needs, so a pair that a third of all documents
hold is one entry a slice there.

``merge`` reads the blocks of any number of runs of a radix, in the order of
their first pairs: what lies below the first pair of the next block is final,
and a heap of the open blocks gives it in order, summed.  One block a run is
open at a time.  Runs that are sorted by left id give each left id's pairs one
after another, so ``with_maxima`` needs to hold the pairs of one left id only.

Numbers are stored as differences or as they are, byte plane by byte plane.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import zstandard

#: Pairs of a left and a right id are one number: left * WIDTH + right.
WIDTH = 1 << 24
#: Documents of a slice at most.
DOCS = 1 << 16

_HEAD = struct.Struct("<IB")


def _pack(*columns: np.ndarray) -> bytes:
    """The columns, each in the least width that holds it, compressed together."""
    out = []
    for c in columns:
        top = int(c.max(initial=0))
        width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
        planes = c.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
        out += [_HEAD.pack(len(c), width), planes.tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def _unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    out, at = [], 0
    while at < len(raw):
        n, width = _HEAD.unpack_from(raw, at)
        at += _HEAD.size
        planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(n).astype(np.int64))
        at += n * width
    return out


def pack_pairs(pairs: np.ndarray, *columns: np.ndarray) -> bytes:
    """Ascending pairs with columns of numbers from 0."""
    return _pack(pairs[:1], np.diff(pairs, prepend=pairs[:1]), *columns)


def unpack_pairs(data: bytes) -> list[np.ndarray]:
    first, gaps, *rest = _unpack(data)
    return [np.cumsum(gaps) + (first[0] if len(first) else 0), *rest]


def radix_of(left: np.ndarray, radices: int) -> np.ndarray:
    """The radix of left ids; neighbours are scattered."""
    return ((left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % radices


def cut_runs(pairs: np.ndarray, number: np.ndarray, docs: np.ndarray, times: np.ndarray,
             radices: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(radix, first pair, pairs section, documents section) of a slice's records (pairs[number], docs, times), in any
    order and with repeats.  All of ``pairs``, which may repeat, must be the pair of a record."""
    if not len(number):
        return
    distinct, own = np.unique(pairs, return_inverse=True)
    radix = radix_of(distinct // WIDTH, radices)
    by_radix = np.lexsort((distinct, radix))
    place = np.empty(len(distinct), np.int64)
    place[by_radix] = np.arange(len(distinct))
    distinct, radix = distinct[by_radix], radix[by_radix]
    key = place[own][number] * DOCS + docs
    bits = int(times.max()).bit_length()
    if bits + int(key.max()).bit_length() < 63:  # one number for both sorts faster
        key = np.sort(key << bits | times)
        key, times = key >> bits, key & ((1 << bits) - 1)
    else:
        order = np.argsort(key)
        key, times = key[order], times[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    times, key = np.add.reduceat(times, first), key[first]
    place, docs = key // DOCS, key % DOCS
    starts = np.flatnonzero(np.diff(place, prepend=-1))  # one for each distinct pair
    n_docs = np.diff(starts, append=len(place))
    gap = np.diff(docs, prepend=0)
    gap[starts] = docs[starts]
    edges = np.flatnonzero(np.diff(radix, prepend=-1))
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(distinct)]):
        part = slice(starts[a], starts[b] if b < len(starts) else len(place))
        yield int(radix[a]), int(distinct[a]), pack_pairs(distinct[a:b], n_docs[a:b]), _pack(gap[part], times[part])


def run_documents(n_docs: np.ndarray, section: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each record of a run: its pair's place in the run, its document and its times."""
    gap, times = _unpack(section)
    place = np.repeat(np.arange(len(n_docs)), n_docs)
    starts = np.cumsum(n_docs) - n_docs
    total = np.cumsum(gap)
    before = total[starts] - gap[starts]
    return place, total - np.repeat(before, n_docs), times


def merge(blocks: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ascending pairs with the sums of their counts, from blocks of any runs in the order of their first pairs."""
    heap: list[tuple[int, int, np.ndarray, np.ndarray]] = []

    def below(bound: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        while heap and heap[0][0] < bound:
            end = min(bound, int(heap[0][2][-1]) + 1)
            pairs, counts = [], []
            while heap and heap[0][0] < end:
                _, k, p, c = heapq.heappop(heap)
                n = int(np.searchsorted(p, end))
                pairs.append(p[:n])
                counts.append(c[:n])
                if n < len(p):
                    heapq.heappush(heap, (int(p[n]), k, p[n:], c[n:]))
            found, number = np.unique(np.concatenate(pairs), return_inverse=True)
            total = np.zeros(len(found), np.int64)
            np.add.at(total, number, np.concatenate(counts))
            yield found, total

    for k, (p, c) in enumerate(blocks):
        yield from below(int(p[0]))
        heapq.heappush(heap, (int(p[0]), k, p, c))
    yield from below(1 << 62)


def with_maxima(blocks: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pairs, counts, 1 where the count is the highest of its left id) of merged blocks."""
    def judged(pairs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        left = pairs // WIDTH
        starts = np.flatnonzero(np.diff(left, prepend=-1))
        top = np.repeat(np.maximum.reduceat(counts, starts), np.diff(starts, append=len(left)))
        return pairs, counts, (counts == top).astype(np.int64)

    rest_p, rest_c = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for p, c in blocks:
        p, c = np.concatenate([rest_p, p]), np.concatenate([rest_c, c])
        cut = int(np.searchsorted(p, (p[-1] // WIDTH) * WIDTH))  # the last left id may go on
        if cut:
            yield judged(p[:cut], c[:cut])
        rest_p, rest_c = p[cut:], c[cut:]
    if len(rest_p):
        yield judged(rest_p, rest_c)
