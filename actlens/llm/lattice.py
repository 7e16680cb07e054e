"""SentencePiece encoding and decoding: segmentations sampled without replacement.

A text's lattice has an edge for every vocabulary piece that matches at some
place, and the UTF-8 bytes of a character that no piece covers as one edge.
A piece's log-weight is ``alpha`` times the logarithm of its Zipf frequency
(the model's scores are ranks).  The segmentations of a text are ranked by
log-probability plus Gumbel noise, drawn top down: the best one is a plain
sample, each of the others the best of a subtree that branches off an
earlier one, and the bound of a subtree is its Gumbel maximum given what has
been drawn, so the search opens exactly the subtrees that it returns (an
A-star search whose bound is tight).  The k largest are k distinct
segmentations, drawn without replacement; the next bound is the threshold
kappa that gives each its inclusion score 1 - exp(-exp(log_prob - kappa)).

No piece spans a space inside or a line break, so a text's lattice is a
chain of units (spaces with the word after them, line breaks); the lattices
of a block's distinct units are built together.  All noise is hashed from
the row key, the sample and the place, so a rerun draws the same.

``encode`` is the library's own deterministic encoding and ``decode`` turns
ids back into text; every sampled segmentation decodes to its text.

Defined results: a null text is an empty one, which has one segmentation,
without ids; a text with fewer than k segmentations gives all of them, with
inclusion score 1; rows with equal doc_id and text draw the same; U+2581 in
a text decodes to a space, as in the library.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actlens.llm.common import give_back_memory, mix64, table, u64, uniform

SAMPLES = 2
ALPHA = 0.2
MODEL = "piece_bpe_32k.model"
#: Characters whose units are handled together.
BLOCK_CHARS = 4 << 20

_SPACE = "▁"
_UNIT = re.compile(r" +[^ \n]*|\n|[^ \n]+")
_ROLL = u64(0x9E3779B97F4A7C15)
_STEP = u64(0xD1B54A32D192ED03)
_UNITS_AHEAD = 32
with np.errstate(over="ignore"):
    _COUNT = np.arange(_UNITS_AHEAD + 1, dtype=np.uint64) * _STEP


class Vocabulary:
    """Pieces, weights and a table of the prefixes of pieces."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.processor.get_piece_size()
        names = [self.processor.id_to_piece(i) for i in range(size)]
        self.byte0 = names.index("<0x00>")
        normal = [i for i in range(size) if not (self.processor.is_control(i) or self.processor.is_unknown(i)
                                                 or self.processor.is_byte(i) or self.processor.is_unused(i))]
        if any("\n" in names[i] or _SPACE in names[i].lstrip(_SPACE) for i in normal):
            raise ValueError("the lattice needs a model whose pieces keep to words")
        rank = {i: -self.processor.get_score(i) for i in normal}
        zipf = sum(1 / (1 + r) for r in rank.values())
        self.weight = np.full(size, -np.inf)
        for i, r in rank.items():
            self.weight[i] = -alpha * math.log((1 + r) * zipf)
        self.byte_weight = -alpha * (math.log((1 + size) * zipf) + 2)
        self.longest = max(len(names[i]) for i in normal)
        known: dict[int, int] = {}
        for i in normal:
            h = 0
            for k, c in enumerate(names[i], 1):
                h = (h * int(_ROLL) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
                known[h] = i if k == len(names[i]) else known.get(h, -1)
        self.prefixes = pa.array(list(known), pa.uint64())
        self.piece_of = np.array(list(known.values()), np.int64)
        # one rounding for all: a unit with one segmentation has exactly its weight as log-sum
        self.weight = self.weight.astype(np.float32).astype(np.float64)
        self.byte_weight = float(np.float32(self.byte_weight))
        self.weight_of = self.weight.tolist()
        self.bytes_of = [b""] * size
        for i in normal:
            self.bytes_of[i] = names[i].replace(_SPACE, " ").encode()
        for b in range(256):
            self.bytes_of[self.byte0 + b] = bytes([b])
        self.all_bytes = pa.array(self.bytes_of, pa.large_binary())

    def byte_weights(self, points: np.ndarray) -> np.ndarray:
        """Weights of the bytes of characters."""
        return self.byte_weight * (1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))


@lru_cache(2)
def vocabulary(path: str, alpha: float) -> Vocabulary:
    return Vocabulary(path, alpha)


def units(text: str) -> list[str]:
    """The units of a text, with the space that the model puts before it."""
    return _UNIT.findall(" " + text) if text else []


class Lattices:
    """The lattices of many units: a node for each place of each unit, numbered from the units' ends backwards, and
    its edges one after another, longest first.

    An edge has a piece's id, or the complement of a code point whose bytes it stands for."""

    def __init__(self, vocab: Vocabulary, names: list[str], joined: tuple[str, np.ndarray] | None = None):
        """joined: the names in one text, and their lengths; else they are joined here."""
        self.vocab = vocab
        text, lens = joined or ("".join(names), np.fromiter(map(len, names), np.int64, len(names)))
        points = np.frombuffer(text.replace(" ", _SPACE).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(lens + 1)
        count = len(points) + len(lens)
        left = np.repeat(ends, lens + 1) - np.arange(1, count + 1)
        order = np.argsort(left.astype(np.uint16) if count and left.max() < 65536 else left, kind="stable")
        number = np.empty(count, np.int64)
        number[order] = np.arange(count)
        self.first = number[ends - lens - 1]
        # a group of nodes has the same number of characters before it to the end
        groups = np.cumsum(np.bincount(left)).tolist() if count else [0]
        inner = np.flatnonzero(left)
        node, ahead = number[inner], left[inner]
        del order
        counts = np.zeros(count, np.int64)
        found_at: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        at, h = np.arange(len(points)), np.zeros(len(points), np.uint64)
        with np.errstate(over="ignore"):
            for length in range(1, vocab.longest + 1):
                fits = ahead[at] >= length
                at, h = at[fits], h[fits]
                if not len(at):
                    break
                h = h * _ROLL + points[at + length - 1] + u64(1)
                found = pc.fill_null(pc.index_in(pa.array(h), value_set=vocab.prefixes), -1).to_numpy()
                there = found >= 0
                at, h = at[there], h[there]
                piece = vocab.piece_of[found[there]]
                whole = piece >= 0
                to, pieces = at[whole], piece[whole]
                if length == 1:  # a character without a piece has an edge of its bytes
                    bare = np.ones(len(points), bool)
                    bare[to] = False
                    bare = np.flatnonzero(bare)
                    to, pieces = np.concatenate([to, bare]), np.concatenate([pieces, ~points[bare].astype(np.int64)])
                nodes = node[to]
                counts[nodes] += 1
                found_at.append((nodes, pieces, number[inner[to] + length]))
        self.offsets = np.concatenate([[0], np.cumsum(counts)])
        total = int(self.offsets[-1])
        self.piece = np.zeros(total, np.int32)
        self.after = np.zeros(total, np.int64)
        free = self.offsets[:-1].copy()
        for length in range(len(found_at), 0, -1):
            nodes, pieces, after = found_at.pop()
            place = free[nodes]
            self.piece[place] = pieces
            self.after[place] = after
            free[nodes] += 1
        weight = self.vocab.weight.astype(np.float32)[np.maximum(self.piece, 0)]
        bare = np.flatnonzero(self.piece < 0)
        weight[bare] = self.vocab.byte_weights(~self.piece[bare])
        # from the ends backwards: the log-sum of all ways to the end
        self.sum = np.zeros(count)
        self.cdf = np.zeros(total, np.float32)
        self.is_end = np.arange(count) < len(lens)
        for a, b in zip(groups, groups[1:]):
            if a == b:
                continue
            own, of = counts[a:b], slice(int(self.offsets[a]), int(self.offsets[b]))
            flat = np.append(weight[of] + self.sum[self.after[of]], -np.inf)
            lanes = np.arange(int(own.max()))[:, None]
            edge = np.where(lanes < own, self.offsets[a:b] - of.start + lanes, len(flat) - 1)
            ways = flat[edge]
            most = ways.max(axis=0)
            part = np.cumsum(np.exp((ways - most).astype(np.float32)), axis=0)
            self.sum[a:b] = most + np.log(part[-1].astype(np.float64))
            flat = flat.astype(np.float32)
            flat[edge] = part / part[-1]
            self.cdf[of] = flat[:-1]
        self.cdf[self.offsets[len(lens) + 1:] - 1] = 2  # what rounding leaves is the shortest edge's

    def edges(self, node: int) -> Iterator[tuple[int, int, float]]:
        """Edges of a node: piece, node after it, weight."""
        of = slice(int(self.offsets[node]), int(self.offsets[node + 1]))
        for p, after in zip(self.piece[of].tolist(), self.after[of].tolist()):
            yield p, after, self.weight_at(p)

    def weight_at(self, piece: int) -> float:
        if piece >= 0:
            return self.vocab.weight_of[piece]
        c = ~piece
        return self.vocab.byte_weight * (1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000))

    def sample(self, of: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A segmentation for each unit of ``of``, noise from its key: pieces in order, the end of each unit's
        pieces and its log-probability."""
        node, who = self.first[of], np.arange(len(of))
        pieces, owners = [], []
        counts = np.zeros(len(of), np.int64)
        with np.errstate(over="ignore"):
            key = keys.copy()
            while len(who):
                key += _STEP
                noise = (mix64(key) >> u64(40)).astype(np.float32) * np.float32(2**-24)
                edge = self.offsets[node]
                on = np.flatnonzero(self.cdf[edge] <= noise)
                while len(on):  # a node's last edge is above any noise
                    edge[on] += 1
                    on = on[self.cdf[edge[on]] <= noise[on]]
                pieces.append(self.piece[edge])
                owners.append(who)
                counts[who] += 1
                node = self.after[edge]
                go = np.flatnonzero(~self.is_end[node])
                node, who, key = node[go], who[go], key[go]
        ends = np.cumsum(counts)
        begin = ends - counts
        piece = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        for step, (p, w) in enumerate(zip(pieces, owners)):
            piece[begin[w] + step] = p
        weights = self.vocab.weight[np.maximum(piece, 0)]
        bare = np.flatnonzero(piece < 0)
        weights[bare] = self.vocab.byte_weights(~piece[bare])
        sums = np.concatenate([[0.0], np.cumsum(weights)])
        log_prob = np.minimum(sums[ends] - sums[begin] - self.sum[self.first[of]], 0.0) if len(of) else np.empty(0)
        # one way only: nothing branches off
        log_prob[log_prob > -1e-7] = 0.0
        return piece, ends, log_prob

    def other(self, unit: int, taken: list[tuple[int, ...]], noise: Iterator[float]) -> tuple[tuple[int, ...], float]:
        """A segmentation that is none of ``taken`` (piece sequences), drawn in proportion: pieces, log-probability."""
        start = int(self.first[unit])
        done = {t: math.exp(self._log_prob(start, t)) for t in taken}
        node, log_prefix, pieces = start, 0.0, ()
        while not self.is_end[node]:
            options, masses = [], []
            here = float(self.sum[node])
            for p, after, weight in self.edges(node):
                step = weight + float(self.sum[after]) - here
                mine = [m for t, m in done.items() if t[: len(pieces) + 1] == (*pieces, p)]
                options.append((p, after, step))
                masses.append(0.0 if mine and self.is_end[after] else max(0.0, math.exp(log_prefix + step) - sum(mine)))
            total = sum(masses)
            if total <= 0:  # rounding: any way that isn't taken
                masses = [float((*pieces, p) not in done) for p, _, _ in options]
                total = sum(masses) or 1.0
            left, k = next(noise) * total, 0
            while k < len(masses) - 1 and (left >= masses[k] or masses[k] == 0):
                left -= masses[k]
                k += 1
            p, after, step = options[k]
            pieces, log_prefix, node = (*pieces, p), log_prefix + step, after
        return pieces, min(log_prefix, 0.0)

    def _log_prob(self, start: int, pieces: tuple[int, ...]) -> float:
        out = 0.0
        for p in pieces:
            out += self.weight_at(p)
        return out - float(self.sum[start])


def _noise(seed: int) -> Iterator[float]:
    at = 0
    while True:
        with np.errstate(over="ignore"):
            part = uniform(u64(seed) + np.arange(at, at + 64, dtype=np.uint64) * _STEP)
        yield from part.tolist()
        at += 64


def _later(bound: float, log_mass: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Gumbel maxima of subtrees with these masses, given that they are below ``bound``."""
    with np.errstate(divide="ignore"):
        return -np.logaddexp(-bound, np.log(-np.log(noise)) - log_mass)


def _log_rest(log_prob: np.ndarray) -> np.ndarray:
    """log(1 - exp(x))"""
    with np.errstate(divide="ignore"):
        return np.log(-np.expm1(log_prob))


class _Text:
    """The search over one text: ``fresh[k]`` has, for each unit, pieces and log-probability of the k-th plain sample."""

    def __init__(self, lattices: Lattices, of: np.ndarray, fresh: list[tuple], seed: int):
        self.lattices, self.of, self.fresh = lattices, of, fresh
        self.noise, self.seed, self.drawn = _noise(seed), np.full(1, seed, np.uint64), 0
        self.n = len(of)
        self.queue: list[tuple] = []
        self.serial = 0

    def _push(self, value: float, item: tuple) -> None:
        if value > -math.inf:
            self.serial += 1
            heapq.heappush(self.queue, (-value, self.serial, item))

    def _draw(self, count: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            self.drawn += 1
            return uniform(mix64(self.seed + u64(self.drawn) * _ROLL) + _COUNT[:count])

    def _open(self, path: dict, unit: int, log_prefix: float, bound: float, contains: bool, keep: int) -> None:
        """The subtrees that branch off ``path`` from ``unit`` on; contains: the largest of them is ``bound``."""
        upto = min(unit + _UNITS_AHEAD, self.n)
        own = path["log_prob"][unit:upto]
        before = log_prefix + np.concatenate([[0.0], np.cumsum(own)])
        masses = before[:-1] + _log_rest(own)
        if upto < self.n:
            masses = np.append(masses, before[-1] + _log_rest(np.array([path["log_prob"][upto:].sum()]))[0])
        if not len(masses) or masses.max() == -math.inf:
            return
        values = _later(bound, masses, self._draw(len(masses)))
        if contains:
            shares = np.cumsum(np.exp(masses - masses[np.isfinite(masses)].max()))
            k = int(np.searchsorted(shares, next(self.noise) * shares[-1], side="right"))
            values[min(k, len(values) - 1)] = bound
        for k in (-values).argsort(kind="stable")[:keep + 1].tolist():
            if unit + k < upto:
                item = ("branch", path, unit + k, float(before[k]), [self._pieces(path, unit + k)])
            else:
                item = ("rest", path, upto, float(before[-1]))
            self._push(float(values[k]), item)

    def _pieces(self, path: dict, unit: int) -> tuple[int, ...]:
        if unit in path["own"]:
            return path["own"][unit]
        piece, ends, _ = self.fresh[path["source"][unit]]
        return tuple(piece[ends[unit]:ends[unit + 1]].tolist())

    def run(self, k: int) -> list[tuple[dict, float, float, float]]:
        """(path, log-probability, perturbed, inclusion score) of the k best."""
        if not self.n:
            return [({"source": np.empty(0, int), "own": {}}, 0.0, 0.0, 1.0)]
        bound = -math.log(-math.log(next(self.noise)))
        path = {"source": np.zeros(self.n, int), "own": {}, "log_prob": self.fresh[0][2]}
        out = [(path, float(path["log_prob"].sum()), bound)]
        self._open(path, 0, 0.0, bound, False, k)
        while self.queue and len(out) < k:
            value, _, item = heapq.heappop(self.queue)
            value = -value
            if item[0] == "rest":
                self._open(item[1], item[2], item[3], value, True, k)
                continue
            _, parent, unit, log_prefix, taken = item
            pieces, log_prob = self.lattices.other(int(self.of[unit]), taken, self.noise)
            number = len(out)
            path = {"source": parent["source"].copy(), "own": {u: v for u, v in parent["own"].items() if u < unit}}
            path["source"][unit:] = number
            path["own"][unit] = pieces
            path["log_prob"] = np.concatenate([parent["log_prob"][:unit], [log_prob], self.fresh[number][2][unit + 1:]])
            out.append((path, float(path["log_prob"].sum()), value))
            self._open(path, unit + 1, log_prefix + log_prob, value, False, k)
            taken = [*taken, pieces]
            left = 1 - sum(math.exp(self.lattices._log_prob(int(self.lattices.first[self.of[unit]]), t)) for t in taken)
            if left > 1e-12:
                self._push(float(_later(value, np.array([log_prefix + math.log(left)]), self._draw(1))[0]),
                           ("branch", parent, unit, log_prefix, taken))
        kappa = -self.queue[0][0] if self.queue else -math.inf
        return [(p, lp, g, 1.0 if kappa == -math.inf else -math.expm1(-math.exp(min(lp - kappa, 50.0)))) for p, lp, g in out]

    def ids(self, path: dict) -> np.ndarray:
        own, source = path["own"], path["source"]
        # from each of these units on, one source, or one unit of the path's own
        stops = {0, self.n, *own, *(u + 1 for u in own), *(np.flatnonzero(source[1:] != source[:-1]) + 1).tolist()}
        stops = sorted(stops)
        pieces = [np.empty(0, np.int32)]
        for unit, upto in zip(stops, stops[1:]):
            if unit in own:
                pieces.append(np.array(own[unit], np.int32))
            else:
                piece, ends, _ = self.fresh[source[unit]]
                pieces.append(piece[ends[unit]:ends[upto]])
        piece = np.concatenate(pieces)
        bare = np.flatnonzero(piece < 0)
        if len(bare):
            point = ~piece[bare]
            counts = np.ones(len(piece), int)
            counts[bare] = 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000)
            text = point.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
            piece = np.repeat(piece, counts)
            piece[piece < 0] = self.lattices.vocab.byte0 + np.frombuffer(text, np.uint8)
        return piece


def _numbered(texts: list[str]) -> tuple[tuple[str, np.ndarray], np.ndarray, np.ndarray]:
    """The distinct units of texts, joined, and their lengths; the numbers of each text's units one after another, and where each text's begin."""
    encoded = [(" " + t).encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    begin = np.concatenate([[0], np.cumsum([len(e) for e in encoded])]).astype(np.int64)
    data = b"".join(encoded)
    byte = np.frombuffer(data, np.uint8)
    space, line = byte == 32, byte == 10
    starts = line.copy()
    starts[1:] |= line[:-1] | (space[1:] & ~space[:-1])
    starts[begin[:-1][begin[1:] > begin[:-1]]] = True
    offsets = np.append(np.flatnonzero(starts), len(data))
    found = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
    _, ends, names = found.dictionary.buffers()
    ends = np.frombuffer(ends, np.int64)[:len(found.dictionary) + 1]
    names = memoryview(names or b"")[:ends[-1]]
    # the bytes that begin a character
    chars = np.append(0, np.cumsum((np.frombuffer(names, np.uint8) & 0xC0) != 0x80))
    return (str(names, "utf-8", "surrogatepass"), np.diff(chars[ends])), found.indices.to_numpy().astype(np.int64), np.searchsorted(offsets[:-1], begin)


def segmentations(texts: list[str], keys: list[int], vocab: Vocabulary, k: int) -> Iterator[list[tuple]]:
    """For each text its k samples: (ids, log-probability, perturbed, inclusion score)."""
    joined, flat, stops = _numbered(texts)
    lattices = Lattices(vocab, [], joined)
    sizes = np.diff(stops)
    seeds = mix64(np.array([x & 0xFFFFFFFFFFFFFFFF for x in keys], np.uint64) + u64(1)) if keys else np.empty(0, np.uint64)
    place = np.arange(len(flat), dtype=np.uint64) - np.repeat(stops[:-1], sizes).astype(np.uint64)
    drawn = []
    with np.errstate(over="ignore"):
        for s in range(k):
            drawn.append(lattices.sample(flat, mix64(np.repeat(mix64(seeds + u64(s) * _ROLL), sizes) + place * _ROLL)))
    for row in range(len(texts)):
        a, b = int(stops[row]), int(stops[row + 1])
        fresh = []
        for piece, ends, log_prob in drawn:
            start = int(ends[a - 1]) if a else 0
            own = np.concatenate([[0], ends[a:b] - start])
            fresh.append((piece[start:start + int(own[-1])], own, log_prob[a:b]))
        search = _Text(lattices, flat[a:b], fresh, int(seeds[row]) ^ 0x5851F42D4C957F2D)
        yield [(search.ids(path), lp, g, score) for path, lp, g, score in search.run(k)]


def decode(ids: list[int], vocab: Vocabulary) -> str:
    """The text of a list of ids."""
    return b"".join(map(vocab.bytes_of.__getitem__, ids))[1:].decode("utf-8", "replace")


def encode(text: str, vocab: Vocabulary) -> list[int]:
    """The library's encoding."""
    return vocab.processor.encode(text)


def _sampler(path: str, alpha: float, k: int, block_chars: int, emit: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, alpha)
        for batch in batches:
            # a block's texts alone are Python strings at one time
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            at = 0
            while at < len(size):
                upto, total = at, 0
                while upto < len(size) and (upto == at or total + size[upto] <= block_chars):
                    total += size[upto]
                    upto += 1
                part = batch.slice(at, upto - at)
                ids, texts = part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]
                yield emit(ids, texts, list(segmentations(texts, [x or 0 for x in ids], vocab, k)), vocab)
                at = upto
                ids = texts = None
                give_back_memory()

    return run


def _with_ids(doc_ids: list, texts: list[str], found: list[list[tuple]], vocab: Vocabulary) -> pa.RecordBatch:
    flat = [s for samples in found for s in samples]
    token_ends = np.concatenate([[0], np.cumsum([len(s[0]) for s in flat])]).astype(np.int32)
    tokens = np.concatenate([np.empty(0, np.int32), *(s[0] for s in flat)]).astype(np.int32)
    ends = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32))
    lists = lambda values: pa.ListArray.from_arrays(ends, values)
    said = vocab.all_bytes.take(pa.array(tokens))
    data = memoryview(said.buffers()[2] or b"")
    at = np.frombuffer(said.buffers()[1], np.int64)[token_ends].tolist()
    spans = zip(at, at[1:])
    back = [all([bytes(data[a + 1:b]) == whole for _, (a, b) in zip(samples, spans)])
            for whole, samples in zip((t.replace(_SPACE, " ").encode() for t in texts), found)]
    return pa.RecordBatch.from_arrays(
        [pa.array(doc_ids, pa.int64()), lists(pa.ListArray.from_arrays(pa.array(token_ends), pa.array(tokens))),
         lists(pa.array([s[1] for s in flat], pa.float64())), lists(pa.array([s[2] for s in flat], pa.float64())),
         lists(pa.array([s[3] for s in flat], pa.float64())), pa.array(back, pa.bool_())],
        names=["doc_id", "ids", "log_prob", "perturbed", "inclusion", "round_trip"])


def _digests(doc_ids: list, texts: list[str], found: list[list[tuple]], vocab: Vocabulary) -> pa.RecordBatch:
    out = _with_ids(doc_ids, texts, found, vocab)
    shas = [hashlib.sha256(b"".join(s[0].astype("<u4").tobytes() + b"\xff" * 4 for s in samples)).hexdigest()
            for samples in found]
    counts = pa.ListArray.from_arrays(out.column(1).offsets, pa.array([len(s[0]) for samples in found for s in samples], pa.int64()))
    return pa.RecordBatch.from_arrays(
        [out.column(0), pa.array([len(s) for s in found], pa.int64()), counts, pa.array(shas, pa.string()),
         *(out.column(k) for k in (2, 3, 4, 5))],
        names=["doc_id", "n_samples", "n_tokens", "ids_sha256", "log_prob", "perturbed", "inclusion", "round_trip"])


def sampled(docs: DataFrame, k: int = SAMPLES, alpha: float = ALPHA, model: str | None = None,
            block_chars: int = BLOCK_CHARS, digests: bool = False) -> DataFrame:
    """Per document of ``docs`` (doc_id, text): k segmentations with log-probability, perturbed log-probability
    and inclusion score, best first, and whether all decode to the text.  With digests, counts and a SHA-256
    stand for the ids."""
    run = _sampler(model or public_tokenizers.path(MODEL), alpha, k, block_chars, _digests if digests else _with_ids)
    kinds = "log_prob array<double>, perturbed array<double>, inclusion array<double>, round_trip boolean"
    ids = "n_samples long, n_tokens array<long>, ids_sha256 string" if digests else "ids array<array<int>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, f"doc_id long, {ids}, {kinds}")


def op9_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document."""
    return sampled(table(spark, sf_dir, "documents"), digests=True)


def sampled_pieces(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The sampled segmentations of the documents that are left.  Blocks are smaller than elsewhere, as their ids
    are held until they are sent."""
    return sampled(docs, block_chars=BLOCK_CHARS // 4)
