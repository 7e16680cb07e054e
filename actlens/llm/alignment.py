"""Alignment of two tokenizers' tokens, with corpus-wide counts of the linked pairs.

Both tokenizers encode a space and the text.  The byte offsets at which tokens
of both end cut the tokens into groups; all pairs of a group are linked.  How
many documents hold a pair linked is counted externally (``spill``):

1. Texts are encoded and aligned in slices of whole documents.  A slice's
   records (pair, document, times) are sorted and cut by radix of the left id
   into zstd runs; runs and documents' figures are stored in one table.
2. The pair sections of a radix are merged, ``FAN`` runs to a task, until one
   run a radix is left; that one is in order of left ids and gets the highest
   count of each.
3. Runs meet the counts of their radix, ``GROUP`` slices to a task, and give
   back each document's sums; a slice's sums are added up and joined to its
   documents by place.

Every row belongs to a bounded slice, so neither equal ids nor a frequent pair
meets in one task: a pair has one entry a run in step 2, and in step 3 the
runs of a radix are dealt to as many tasks as there are groups of slices.
A document whose records pass ``RECORDS`` is cut by left ids, so that
no pair of it is in two runs.

Both tokenizers begin a new token at a space before a word, so words are
encoded and aligned once and remembered; a text with an empty word, a word
that ends in white space or a very long one is encoded whole, and so is every
text if the piece model hasn't that property.

Defined results: a null or empty text, or one that either tokenizer doesn't
give back byte by byte, has no tokens: zeros, and an empty string for the
groups.  Rows that repeat a doc_id, or have none, are documents of their own.
Columns other than doc_id and text aren't carried.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actlens.llm import spill
from actlens.llm.common import stored, table, task_segments

BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
RADICES = 32
FAN = 128
GROUP = 512
#: A slice is closed at so many words, bytes of text or documents, and holds at most so many records at one time.
SLICE_WORDS, SLICE_BYTES, SLICE_DOCS, RECORDS = 1 << 19, 8 << 20, 1 << 14, 1 << 21
#: Words that a worker remembers, and the longest of them.
REMEMBERED, LONGEST = 1 << 17, 64
_GROUPED = 256
_COUNTED = 1 << 16
_SPACE = "▁"
_INNER_SPACE = re.compile(r"\S ")


def byte_letters() -> dict[str, int]:
    """The byte that each letter of the byte-level alphabet stands for: printable bytes stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


class _Aligned:
    """Tokens of one byte string in groups."""

    def __init__(self, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray):
        self.a, self.b = a, b
        end_a, end_b = np.cumsum(size_a[a]), np.cumsum(size_b[b])
        self.ends = np.intersect1d(end_a, end_b, assume_unique=True)
        self.group_a, self.group_b = np.searchsorted(self.ends, end_a), np.searchsorted(self.ends, end_b)
        n = len(self.ends)
        self.n_a, self.n_b = np.bincount(self.group_a, minlength=n), np.bincount(self.group_b, minlength=n)

    def text(self, names: list[str], offset: int, ends: np.ndarray | None = None) -> str:
        """``a1,a2|b1;a3|b2`` and a line break; one more after each group that is marked in ``ends``.

        ``names`` has each left id with the two marks that can follow it, and from ``offset`` on each right id with
        its three, so that the text is looked up token by token."""
        out = np.empty(len(self.a) + len(self.b), np.int64)
        upto_a, upto_b = np.cumsum(self.n_a), np.cumsum(self.n_b)
        last = np.zeros(len(self.a), np.int64)
        last[upto_a - 1] = 1
        out[np.arange(len(self.a)) + (upto_b - self.n_b)[self.group_a]] = self.a * 2 + last
        last = np.zeros(len(self.b), np.int64)
        last[upto_b - 1] = 1
        last[upto_b[-1:] - 1] = 2
        if ends is not None:
            last[upto_b[ends] - 1] = 2
        out[np.arange(len(self.b)) + upto_a[self.group_b]] = offset + self.b * 3 + last
        return "".join(map(names.__getitem__, out.tolist()))

    def sides(self) -> tuple[np.ndarray, ...]:
        """Distinct ids of each group with their numbers: group, id, n of the left and of the right side."""
        out = []
        for group, ids in ((self.group_a, self.a), (self.group_b, self.b)):
            key, n = np.unique(group * spill.WIDTH + ids, return_counts=True)
            out += [key // spill.WIDTH, key % spill.WIDTH, n]
        return tuple(out)


def expand(group_a: np.ndarray, a: np.ndarray, n_a: np.ndarray, group_b: np.ndarray, b: np.ndarray,
           n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of each group: index of the left row, pair, times."""
    lo, hi = np.searchsorted(group_b, group_a), np.searchsorted(group_b, group_a, "right")
    width = hi - lo
    left = np.repeat(np.arange(len(a)), width)
    right = np.arange(len(left)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(lo, width)
    return left, a[left] * spill.WIDTH + b[right], n_a[left] * n_b[right]


class Aligner:
    """Both tokenizers, and what has been learned of single words."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.left = Tokenizer.from_file(path_a)
        self.left.encode_special_tokens = True
        letters = byte_letters()
        names = self.left.get_vocab()
        self.bytes_a = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            known = all(c in letters for c in name)
            self.bytes_a[i] = bytes(map(letters.__getitem__, name)) if known else name.encode()
        self.right = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.right.id_to_piece(i) for i in range(self.right.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.right.is_byte(i) else p.replace(_SPACE, " ").encode()
                        for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        if max(len(self.bytes_a), len(self.bytes_b)) > spill.WIDTH:
            raise ValueError(f"more than {spill.WIDTH} ids")
        self.names = [f"{i}{mark}" for i in range(len(self.bytes_a)) for mark in ",|"]
        self.offset = len(self.names)
        self.names += [f"{i}{mark}" for i in range(len(self.bytes_b)) for mark in ",;\n"]
        # tokens begin at the space before a word on both sides: then words are apart
        self.starts_a = np.array([t[:1] == b" " for t in self.bytes_a])
        self.starts_b = np.array([p[:1] == _SPACE for p in pieces])
        probe = "a  b  c​ﬁΩ "
        self.by_word = (not any(_SPACE in p.lstrip(_SPACE) for p in pieces)
                        # a space inside a token only after other white space, which no word ends in
                        and not any(_INNER_SPACE.search(t.decode(errors="replace")) for t in self.bytes_a)
                        and b"".join(map(self.bytes_b.__getitem__, self.right.encode(probe))) == b" " + probe.encode()
                        and b"".join(map(self.bytes_a.__getitem__, self._a(" " + probe))) == b" " + probe.encode()
                        and getattr(self.left.pre_tokenizer, "use_regex", False))
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.strings: list[str] = []
        #: per word: tokens on both sides, groups, links, place and number of its pairs
        self.figures = np.zeros((1 << 12, 6), np.int64)
        #: pairs of all words and their times, as they were learned
        self.pairs: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.n_pairs = 0
        #: per word: in how many slices it was
        self.uses = np.zeros(1 << 12, np.int32)

    def pairs_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of the words one after another, their times, and how many each word has."""
        place, n = self.figures[words, 4], self.figures[words, 5]
        at = np.repeat(place - np.cumsum(n) + n, n) + np.arange(n.sum())
        pairs, times = (np.concatenate(c)[at] for c in (self.pairs, self.times))
        return pairs, times, n

    def shrink(self) -> None:
        """Forget the words that were in one slice alone."""
        kept = np.flatnonzero(self.uses[:len(self.strings)] > 1)
        if not 0 < len(kept) <= REMEMBERED:
            self.forget()
            return
        number = np.full(len(self.strings), -1)
        number[kept] = np.arange(len(kept))
        pairs, times, n = self.pairs_of(kept)
        figures = self.figures[kept]
        figures[:, 4] = np.cumsum(n) - n
        old = np.fromiter(self.known.values(), np.int64, len(self.known))
        known = {w: k for w, k in zip(self.known, np.where(old >= 0, number[old], -1).tolist()) if k >= 0}
        strings = [self.strings[k] for k in kept.tolist()]
        self.forget()
        self.known, self.strings, self.figures, self.pairs, self.times = known, strings, figures, [pairs], [times]
        self.n_pairs, self.uses = len(pairs), np.ones(len(kept), np.int32)

    def _a(self, text: str) -> list[int]:
        return self.left.encode(text, add_special_tokens=False).ids

    def whole(self, text: str, a: list[int] | None = None) -> _Aligned | None:
        """The alignment of a space and the text; None if a side doesn't give its bytes back."""
        a, b = self._a(" " + text) if a is None else a, self.right.encode(text)
        want = b" " + text.encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != want or b"".join(map(self.bytes_b.__getitem__, b)) != want:
            return None
        return _Aligned(np.array(a, np.int64), np.array(b, np.int64), self.size_a, self.size_b)

    def learn(self, words: set[str]) -> None:
        """Words that are new; -1 for one that only a whole text can tell."""
        new = list(words - self.known.keys())
        self.known.update(dict.fromkeys(new, -1))
        apart = [w for w in new if w and len(w) <= LONGEST and not w[-1].isspace() and _SPACE not in w]
        groups = [apart[at:at + _GROUPED] for at in range(0, len(apart), _GROUPED)]
        joined = [" ".join(g) for g in groups]
        encoded = self.left.encode_batch_fast([" " + j for j in joined], add_special_tokens=False)
        for group, text, left in zip(groups, joined, encoded):
            found = self.whole(text, left.ids)
            if found is None or not self._take(group, found):
                for word in group:
                    if (one := self.whole(word)) is not None:
                        self._take([word], one)

    def _take(self, group: list[str], found: _Aligned) -> bool:
        """Remember the words of an aligned run of them; False if their tokens don't tell them apart."""
        first_a, first_b = np.flatnonzero(self.starts_a[found.a]), np.flatnonzero(self.starts_b[found.b])
        if len(group) == 1:
            first_a, first_b = first_a[:1], first_b[:1]
        if len(first_a) != len(group) or len(first_b) != len(group):
            return False
        cut = found.group_a[first_a]
        n_groups = len(found.ends)
        group_a, a, n_a, group_b, b, n_b = found.sides()
        left, pairs, times = expand(group_a, a, n_a, group_b, b, n_b)
        ends = np.searchsorted(group_a[left], [*cut[1:].tolist(), n_groups])
        first, n = len(self.strings), len(group)
        if first + n > len(self.figures):
            self.figures = np.concatenate([self.figures, np.zeros((max(n, len(self.figures)), 6), np.int64)])
        starts = np.concatenate([[0], ends[:-1]])
        self.figures[first:first + n] = np.column_stack([
            np.diff(first_a, append=len(found.a)), np.diff(first_b, append=len(found.b)), np.diff(cut, append=n_groups),
            np.add.reduceat(found.n_a * found.n_b, cut), self.n_pairs + starts, ends - starts])
        self.pairs.append(pairs)
        self.times.append(times)
        self.n_pairs += len(pairs)
        self.known.update(zip(group, range(first, first + n)))
        self.strings += found.text(self.names, self.offset, cut[1:] - 1).splitlines()
        return True


@lru_cache(1)
def aligner_of(path_a: str, path_b: str) -> Aligner:
    """One for all tasks of a worker, so that words are learned once."""
    return Aligner(path_a, path_b)


class _Slice:
    """Documents that are counted together."""

    def __init__(self, aligner: Aligner, digest: bool):
        self.aligner, self.digest = aligner, digest
        self.rows: list[tuple] = []  # doc_id, n_a, n_b, n_groups, n_links, groups
        self.words: list[np.ndarray] = []
        self.word_docs: list[int] = []
        self.wholes: list[tuple[int, _Aligned]] = []
        self.size = self.bytes = 0

    def _groups(self, text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest() if self.digest else text

    def add(self, doc_id: int | None, text: str, words: list[str]) -> None:
        at, aligner = len(self.rows), self.aligner
        self.size += len(words) + 1
        self.bytes += len(text)
        if not text:
            self.rows.append((doc_id, 0, 0, 0, 0, ""))
            return
        if aligner.by_word:
            index = np.fromiter(map(aligner.known.__getitem__, words), np.int64, len(words))
            if index.min() >= 0:
                self.words.append(index)
                self.word_docs.append(at)
                figures = aligner.figures[index, :4].sum(0).tolist()
                self.rows.append((doc_id, *figures, self._groups(";".join(map(aligner.strings.__getitem__, index.tolist())))))
                return
        found = aligner.whole(text)
        if found is None:
            self.rows.append((doc_id, 0, 0, 0, 0, ""))
            return
        self.wholes.append((at, found))
        self.size += len(found.a)
        self.rows.append((doc_id, len(found.a), len(found.b), len(found.ends), int((found.n_a * found.n_b).sum()),
                          self._groups(found.text(aligner.names, aligner.offset)[:-1])))

    def count_uses(self) -> None:
        aligner = self.aligner
        if (more := len(aligner.strings) - len(aligner.uses)) > 0:
            aligner.uses = np.concatenate([aligner.uses, np.zeros(more, np.int32)])
        if self.words:
            aligner.uses[np.unique(np.concatenate(self.words))] += 1

    def full(self) -> bool:
        return self.size >= SLICE_WORDS or self.bytes >= SLICE_BYTES or len(self.rows) >= SLICE_DOCS

    def runs(self, radices: int, most: int = RECORDS) -> Iterator[tuple[int, int, bytes, bytes]]:
        """The slice's runs; records are made for one part of the left ids after another if they are many."""
        aligner = self.aligner
        pairs = times = word_pairs = np.zeros(0, np.int64)
        docs = word = n_word = np.zeros(0, np.int64)
        if self.words:
            used, number = np.unique(np.concatenate(self.words), return_inverse=True)
            doc = np.repeat(self.word_docs, list(map(len, self.words)))
            key, n_word = np.unique(doc * len(used) + number, return_counts=True)
            docs, word = key // len(used), key % len(used)
            pairs, times, word_pairs = aligner.pairs_of(used)
        sides = [(at, found.sides()) for at, found in self.wholes]
        total = int(word_pairs[word].sum()) + sum(
            int((np.bincount(s[0]) * np.bincount(s[3])).sum()) for _, s in sides)
        parts = -(-total // most) or 1
        starts = np.cumsum(word_pairs) - word_pairs
        for part in range(parts):
            mine = lambda left: spill.radix_of(left, radices * parts) // radices == part
            keep = mine(pairs // spill.WIDTH) if parts > 1 else np.ones(len(pairs), bool)
            kept = np.concatenate([[0], np.cumsum(keep)])
            own_pairs, own_times = pairs[keep], times[keep]
            own_starts, own_n = kept[starts], kept[starts + word_pairs] - kept[starts]
            n = own_n[word] if len(word) else word
            at = np.repeat(own_starts[word] - np.cumsum(n) + n, n) + np.arange(n.sum()) if len(word) else word
            found = [(at, np.repeat(docs, n), own_times[at] * np.repeat(n_word, n))]
            listed = [own_pairs]
            for doc, (group_a, a, n_a, *right) in sides:
                left = mine(a) if parts > 1 else slice(None)
                _, p, t = expand(group_a[left], a[left], n_a[left], *right)
                found.append((np.arange(len(p)) + sum(map(len, listed)), np.full(len(p), doc), t))
                listed.append(p)
            yield from spill.cut_runs(np.concatenate(listed), *map(np.concatenate, zip(*found)), radices)


_ALIGNED = pa.schema([
    ("slice", pa.int64()), ("at", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
    ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.large_string()),
    ("radix", pa.int32()), ("first", pa.int64()), ("pairs", pa.large_binary()), ("docs", pa.large_binary())])
_ALIGNED_DDL = ("slice long, at int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, "
                "radix int, first long, pairs binary, docs binary")


def _aligned(path_a: str, path_b: str, radices: int, digest: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_of(path_a, path_b)
        numbers = task_segments()
        held = _Slice(aligner, digest)

        def close() -> Iterator[pa.RecordBatch]:
            number = next(numbers)
            held.count_uses()
            for at in range(0, len(held.rows), 1 << 10):
                some = held.rows[at:at + (1 << 10)]
                columns = [[number] * len(some), range(at, at + len(some)), *zip(*some)]
                yield _batch(dict(zip(_ALIGNED.names, columns)), len(some))
            for radix, first, pairs, docs in held.runs(radices):
                yield _batch({"slice": [number], "radix": [radix], "first": [first], "pairs": [pairs], "docs": [docs]}, 1)

        for batch in batches:
            for part in _slices(batch):
                ids, texts = part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]
                split = [t.split(" ") for t in texts]
                if aligner.by_word:
                    if len(aligner.known) > 2 * REMEMBERED and not held.rows:
                        aligner.shrink()
                    aligner.learn(set().union(*split))
                for row in zip(ids, texts, split):
                    held.add(*row)
                if held.full() or len(aligner.known) > 3 * REMEMBERED:
                    yield from close()
                    held = _Slice(aligner, digest)
        if held.rows:
            yield from close()

    return run


def _batch(columns: dict, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _ALIGNED], schema=_ALIGNED)


def _slices(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in parts of about ``most`` bytes, at least a row each."""
    at = total = 0
    for k, n in enumerate(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()):
        if total and total + n > most or k - at >= 4096:
            yield batch.slice(at, k - at)
            at, total = k, 0
        total += n
    if at < batch.num_rows:
        yield batch.slice(at)


def _merged(final: bool) -> Callable:
    """Blocks of a (radix, heap), in the order of their first pairs, merged to blocks of ``_COUNTED`` pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("radix", "heap", "pairs"))))
        for (radix, heap), group in groupby(rows, key=lambda r: r[:2]):
            blocks = spill.merge(spill.unpack_pairs(section)[:2] for *_, section in group)
            for columns in _recut(spill.with_maxima(blocks) if final else blocks, _COUNTED):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([radix], pa.int32()), pa.array([heap], pa.int64()), pa.array(columns[0][:1], pa.int64()),
                     pa.array([spill.pack_pairs(*columns)], pa.binary())], names=["radix", "run", "first", "pairs"])

    return run


def _recut(blocks: Iterator[tuple[np.ndarray, ...]], size: int) -> Iterator[list[np.ndarray]]:
    held: list[tuple[np.ndarray, ...]] = []
    n = 0
    for block in blocks:
        held.append(block)
        n += len(block[0])
        if n >= size:
            yield [np.concatenate(c) for c in zip(*held)]
            held, n = [], 0
    if n:
        yield [np.concatenate(c) for c in zip(*held)]


def merged_counts(runs: DataFrame, fan: int = FAN) -> DataFrame:
    """Counts of all pairs: rows (radix, first, pairs) with the sections of pairs, counts and marks of the highest; stored."""
    n = runs.groupBy("radix").count().agg(F.max("count")).first()[0] or 0
    found = runs.select("radix", F.monotonically_increasing_id().alias("run"), "first", "pairs")
    while True:
        heaps = max(1, -(-n // fan))
        dealt = found.withColumn("heap", F.pmod(F.xxhash64("run"), F.lit(heaps)).cast("long"))
        found = stored(dealt.repartition("radix", "heap").sortWithinPartitions("radix", "heap", "first").select(
            "radix", "heap", "pairs").mapInArrow(_merged(heaps == 1), "radix int, run long, first long, pairs binary"), "merged-pairs")
        if heaps == 1:
            return found.select("radix", "first", "pairs")
        n = heaps


def _given_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each document of a run: the counts of a (radix, share) come first, then its runs."""
    key, parts, table_ = None, [], None
    for batch in batches:
        for radix, share, slice_, pairs, docs in zip(
                *(batch.column(c).to_pylist() for c in ("radix", "share", "slice", "pairs", "docs"))):
            if key != (radix, share):
                key, parts, table_ = (radix, share), [], None
            if docs is None:
                parts.append(spill.unpack_pairs(pairs))
                continue
            if table_ is None:
                table_, parts = [np.concatenate(c) for c in zip(*parts)], []
            known, counts, best = table_
            own, n_docs = spill.unpack_pairs(pairs)
            place = np.searchsorted(known, own)
            if (known[place] != own).any():
                raise ValueError("a pair of a run wasn't counted")
            at, doc, times = spill.run_documents(n_docs, docs)
            sums = np.zeros((2, int(doc.max()) + 1), np.int64)
            np.add.at(sums[0], doc, times * best[place][at])
            np.add.at(sums[1], doc, times * counts[place][at])
            yield pa.RecordBatch.from_arrays(
                [pa.array([slice_], pa.int64()), pa.array([zstandard.compress(sums.tobytes(), 3)], pa.binary())],
                names=["slice", "sums"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a slice with the sums of its runs, which come first."""
    key, total = None, np.zeros((2, 0), np.int64)
    for batch in batches:
        slices, at = batch.column("slice").to_pylist(), batch.column("at")
        places = at.fill_null(-1).to_numpy(zero_copy_only=False)
        best, count = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        sums = batch.column("sums").to_pylist()
        for k, (slice_, packed) in enumerate(zip(slices, sums)):
            if slice_ != key:
                key, total = slice_, np.zeros((2, 0), np.int64)
            if packed is not None:
                more = np.frombuffer(zstandard.decompress(packed), np.int64).reshape(2, -1)
                if more.shape[1] > total.shape[1]:
                    total = np.pad(total, ((0, 0), (0, more.shape[1] - total.shape[1])))
                total[:, :more.shape[1]] += more
            elif places[k] < total.shape[1]:
                best[k], count[k] = total[:, places[k]]
        rows = np.flatnonzero(places >= 0)
        keep = batch.take(pa.array(rows))
        yield pa.RecordBatch.from_arrays(
            [*(keep.column(c) for c in _KEPT), pa.array(best[rows]), pa.array(count[rows])],
            names=[*_KEPT, "n_best", "count_sum"])


_KEPT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"]


def tokenizer_paths() -> tuple[str, str]:
    return public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECES)


def aligned_runs(docs: DataFrame, paths: tuple[str, str] | None = None, digest: bool = False,
                 radices: int = RADICES) -> DataFrame:
    """Rows of documents (with ``at``) and of runs (with ``radix``); stored."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return stored(rows.mapInArrow(_aligned(*(paths or tokenizer_paths()), radices, digest), _ALIGNED_DDL), "aligned")


def pair_counts(counts: DataFrame) -> DataFrame:
    """(left, right, documents, best) of the merged counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for section in batch.column(0).to_pylist():
                pairs, n, best = spill.unpack_pairs(section)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pairs // spill.WIDTH), pa.array(pairs % spill.WIDTH), pa.array(n), pa.array(best.astype(bool))],
                    names=["left", "right", "documents", "best"])

    return counts.select("pairs").mapInArrow(run, "left long, right long, documents long, best boolean")


def align(docs: DataFrame, paths: tuple[str, str] | None = None, digest: bool = False, radices: int = RADICES,
          fan: int = FAN, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, n_a, n_b, n_groups, n_links, groups, n_best, count_sum) and merged counts.

    ``groups`` is the text ``a1,a2|b1;a3|b2``, or its sha256 with ``digest``."""
    held = aligned_runs(docs, paths, digest, radices)
    runs = held.where("radix IS NOT NULL")
    slices = held.where("at = 0").count()
    counts = merged_counts(runs, fan)
    shares = max(1, -(-slices // group))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long")))
    sides = counts.select("radix", every.alias("share"), F.lit(-1).cast("long").alias("slice"), "first", "pairs",
                          F.lit(None).cast("binary").alias("docs")).unionByName(
        runs.select("radix", F.pmod(F.xxhash64("slice"), F.lit(shares)).cast("long").alias("share"), "slice",
                    "first", "pairs", "docs"))
    # slices are numbered from 0: the counts' -1 comes first
    sums = sides.repartition("radix", "share").sortWithinPartitions("radix", "share", "slice", "first").mapInArrow(
        _given_back, "slice long, sums binary")
    every_row = sums.select("slice", F.lit(None).cast("int").alias("at"), "sums", *(
        F.lit(None).cast("string" if c == "groups" else "long").alias(c) for c in _KEPT)).unionByName(
        held.where("at IS NOT NULL").select("slice", "at", F.lit(None).cast("binary").alias("sums"), *_KEPT))
    out = every_row.repartition("slice").sortWithinPartitions("slice", F.col("at").asc_nulls_first()).mapInArrow(
        _summed, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long")
    return out, counts


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: tokens on both sides, groups, links, and what the corpus says of its links."""
    docs, _ = align(table(spark, sf_dir, "documents"), digest=True)
    return docs.withColumnRenamed("groups", "groups_sha256")
