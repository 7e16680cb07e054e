"""Token ids in files coded with a static range asymmetric numeral system (rANS).

Texts are tokenised in ascending doc_id order and packed into shards, each a
run of consecutive documents.  One table of frequencies, counted over all
ids of the corpus and scaled to 2**SCALE_BITS, is shared by all shards.

A shard (little-endian): ``RNS1``, documents and blocks (u32), lanes and
scale bits (u16), CRC-32 of the table (u32), ids (u64); per document its id
(i64), whether it has one (u8) and its count of ids (u32); per block, as a
checkpoint to decode from, its count of ids, its count of words, the CRC-32
of its ids (u32 each) and the states of its lanes (u64 each); then the
blocks' words (u32).  Block ids go to the lanes in turn; a lane's 64-bit
state gives or takes a word whenever it leaves [2**31, 2**63).  Blocks share
nothing but the table: the lanes of all blocks of a shard are coded in step,
and any block can be read alone.

Shards are rows of a Parquet table (``content``), so that Spark's commit
protocol covers lost tasks on any store; the table of frequencies is stored
beside it.

Defined results: a null text is an empty one, which is its end id alone;
documents with equal doc_id stay separate, in the order of their texts; a
null doc_id comes first.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from actlens.llm.common import broadcast_rows, stored, table, task_segments

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
SHARD_IDS = 1 << 20
BLOCK_IDS = 1 << 16
LANES = 256
SCALE_BITS = 20

_HEAD = struct.Struct("<4sIIHHIQ")
_LOW = np.uint64(1 << 31)
_MASK = np.uint64((1 << SCALE_BITS) - 1)
_SCALE = np.uint64(SCALE_BITS)
_WORD = np.uint64(32)
_ROOM = np.uint64(31 - SCALE_BITS + 32)
_CACHED = 1 << 20
_GROUP = 256
#: Bytes of the texts that are encoded at a time.
_BYTES = 1 << 22
#: The byte-level alphabet, a character for each byte; a space in it.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_ALPHABET = np.zeros(256, "<u2")
_ALPHABET[_SHOWN] = _SHOWN
_ALPHABET[[b for b in range(256) if b not in _SHOWN]] = np.arange(256, 512 - len(_SHOWN))
_SPACE = "\u0120"
#: A plain word: Latin letters, figures, signs but apostrophes (which may take letters along), single line breaks between.
_PLAIN = re.compile("{0}+(?:\n{0}+)*".format("[!-&(-~\u00b5\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]"))
#: Tokens of letters alone (all bytes beyond ASCII count as such), of figures or of signs.
_ALIKE = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[!-/:-@\[-`{-~]+")


class Encoder:
    """The library's encoding of texts; words with the space before them are encoded once and remembered.

    The byte-level model splits a text at a space before it merges bytes, so the ids of a text are those of its
    words.  Not so after other white space: a text with a word that ends in it (or an empty one, between two
    spaces) goes to the library whole, and so does a text with a special token.

    No token holds letters and figures, signs or line breaks alike, but for those with an apostrophe.  So what the
    library's pattern would cut a plain word into is left apart by its model, and plain words go to the model
    right away, cut at spaces alone.

    A word is known by a number; the ids of all known words are one array, with the places where words end."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        names = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(names.values()) + 1, bool)
        self.begins[[i for name, i in names.items() if name.startswith(_SPACE)]] = True
        self.model = _plain_model(self.tokenizer)
        self._forget()

    def _forget(self) -> None:
        #: numbers of first words, and of words after a space; 0, which has no ids, where the text must go whole
        self.known: tuple[dict[str, int], dict[str, int]] = ({}, {})
        self.n_words = 0
        self.ids, self.ends = _Growing(self.dtype), _Growing(np.dtype(np.int64))
        self._add([""], np.zeros(0, self.dtype), np.zeros(1, np.int64), {})

    def _add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray, known: dict[str, int]) -> None:
        """Remember words, whose ids are one after another."""
        self.ends.add(len(self.ids) + np.cumsum(sizes))
        self.ids.add(ids)
        known.update(zip(words, range(self.n_words, self.n_words + len(words))))
        self.n_words += len(words)

    def _learn(self, words: set[str], space: str, known: dict[str, int]) -> None:
        new = words.difference(known)
        known.update(dict.fromkeys(new, 0))
        plain = [w for w in new if _PLAIN.fullmatch(w)] if space and self.model else []
        apart = [w for w in new.difference(plain) if w and not w[-1].isspace() and (space or not w[0].isspace())]
        if not space:
            for word, found in zip(apart, self.tokenizer.encode_batch_fast(apart, add_special_tokens=False)):
                self._add([word], np.array(found.ids, self.dtype), np.array([len(found.ids)]), known)
            return
        # many words in one call: a token that begins with a space begins a word
        for words_, model, form in ((plain, self.model, _byte_level), (apart, self.tokenizer, None)):
            groups = [words_[k:k + _GROUP] for k in range(0, len(words_), _GROUP)]
            joined = [" " + " ".join(g) for g in groups]
            texts = [form(t) for t in joined] if form else joined
            for group, text, found in zip(groups, joined, model.encode_batch_fast(texts, add_special_tokens=False) if texts else ()):
                ids = np.array(found.ids, self.dtype)
                starts = np.flatnonzero(self.begins[ids])
                if len(starts) != len(group) or any(s in text for s in self.special):
                    each = [self._whole(" " + word) for word in group]
                    self._add(group, np.concatenate(each), np.array([len(e) for e in each]), known)
                else:
                    self._add(group, ids, np.diff(starts, append=len(ids)), known)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed.  Words are gathered from texts with unknown ones alone."""
        if not texts:
            return []
        if self.n_words > _CACHED:
            self._forget()
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        edges = split.offsets.to_numpy()
        coded = split.values.dictionary_encode()
        codes = coded.indices.to_numpy().copy()
        words = coded.dictionary.to_numpy(zero_copy_only=False)
        heads = split.values.take(pa.array(edges[:-1])).to_pylist()
        first, known = self.known
        self._learn(set(heads), "", first)

        # each distinct word is looked up once; first words come after the others
        codes[edges[:-1]] = np.arange(len(words), len(words) + len(heads))
        number = np.fromiter(chain(map(known.get, words.tolist(), repeat(-1)), map(first.get, heads)), np.int64)
        rows = np.repeat(np.arange(len(texts)), np.diff(edges))
        missed = np.zeros(len(texts), bool)
        missed[rows[number[codes] < 0]] = True
        if missed.any():
            again = np.zeros(len(number), bool)
            again[codes[missed[rows]]] = True
            again = again[:len(words)]
            self._learn(set(words[again].tolist()), " ", known)
            again &= number[:len(words)] < 0
            number[:len(words)][again] = [known[w] for w in words[again].tolist()]

        numbers = number[codes]
        whole = np.zeros(len(texts), bool)
        whole[rows[numbers == 0]] = True  # a word without ids of its own
        whole |= [any(s in text for s in self.special) for text in texts]
        ends = self.ends.values()
        ends, n = ends[numbers], np.diff(ends, prepend=0)[numbers]
        total = np.cumsum(n)
        ids = self.ids.values()[np.repeat(ends - total, n) + np.arange(total[-1])].tobytes()
        cuts = (np.concatenate([[0], total])[edges] * self.dtype.itemsize).tolist()
        return [self._whole(text).tobytes() if apart else ids[a:b]
                for text, apart, a, b in zip(texts, whole.tolist(), cuts, cuts[1:])]


class _Growing:
    """An array that grows at its end."""

    def __init__(self, dtype: np.dtype):
        self.room = np.zeros(1 << 10, dtype)
        self.n = 0

    def __len__(self) -> int:
        return self.n

    def add(self, values: np.ndarray) -> None:
        while self.n + len(values) > len(self.room):
            self.room = np.concatenate([self.room, np.zeros_like(self.room)])
        self.room[self.n:self.n + len(values)] = values
        self.n += len(values)

    def values(self) -> np.ndarray:
        return self.room[:self.n]


def _byte_level(text: str) -> str:
    """A text in the byte-level alphabet, with a space before each that it holds."""
    return _ALPHABET[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-16-le").replace(_SPACE, " " + _SPACE)


def _plain_model(tokenizer):
    """The tokenizer's model behind a split at spaces, for plain words in the byte-level alphabet; None if the
    tokenizer's pattern isn't the usual one or a token would join what the pattern cuts a plain word into."""
    from tokenizers import Tokenizer, pre_tokenizers

    config = json.loads(tokenizer.to_str())
    usual = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if config["normalizer"] or {k: (config["pre_tokenizer"] or {}).get(k) for k in usual} != usual:
        return None
    byte_of = {chr(c): b for b, c in enumerate(_ALPHABET.tolist())}
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    for name in tokenizer.get_vocab().keys() - special:
        token = bytes([byte_of[c] for c in name]).removeprefix(b" ")
        text = re.sub("[\udc80-\udcff]", "\u00e9", token.decode(errors="surrogateescape"))  # part of a character: maybe a letter's
        if _PLAIN.fullmatch(text.replace("\n", "")) and not _ALIKE.fullmatch(token):
            return None
    model = Tokenizer.from_str(json.dumps(config | {"added_tokens": [], "pre_tokenizer": None, "post_processor": None}))
    model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
    return model


@lru_cache(1)
def encoder_of(path: str) -> Encoder:
    """One encoder for all tasks of a worker, so that words are learned once."""
    return Encoder(path)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows whose texts, the second column, have up to ``_BYTES`` bytes; a longer text alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


def _tokenised(path: str, end_id: int, shard_ids: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        end = np.array([end_id], encoder.dtype).tobytes()
        numbers = task_segments()
        ids: list = []
        packed: list[bytes] = []
        held = 0

        def shard() -> pa.RecordBatch:
            counts = np.array([len(p) // encoder.dtype.itemsize for p in packed], np.int64)
            number = next(numbers)
            return pa.RecordBatch.from_arrays(
                [pa.array([number >> 33], pa.int64()), pa.array([number & 0x1FFFFFFFF], pa.int64()),
                 pa.array([ids], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())),
                 pa.array([int(counts.sum())], pa.int64()),
                 pa.array([np.frombuffer(b"".join(packed), encoder.dtype).astype("<u4").tobytes()
                           if encoder.dtype.itemsize == 4 else b"".join(packed)], pa.binary())],
                names=["task", "shard", "doc_ids", "counts", "n_ids", "ids"])

        for batch in batches:
            for part in _parts(batch):
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc_id, found in zip(part.column(0).to_pylist(), encoder.encode(texts)):
                    ids.append(doc_id)
                    packed.append(found + end)
                    held += len(found) // encoder.dtype.itemsize + 1
                    if held >= shard_ids:
                        yield shard()
                        ids, packed, held = [], [], 0
        if ids:
            yield shard()

    return run


def token_shards(docs: DataFrame, path: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Shards (task, shard, doc_ids, counts, n_ids, ids) in ascending (doc_id, text) order; stored."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(
        _tokenised(path, end_id, shard_ids),
        "task long, shard long, doc_ids array<long>, counts array<long>, n_ids long, ids binary"), "token-shards")


def _unpacked(ids: bytes, count: int) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * count else "<u4")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for n, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts = np.bincount(_unpacked(ids, n))
            if len(counts) < len(total):
                counts.resize(len(total))
            elif len(total) < len(counts):
                total.resize(len(counts))
            total += counts
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**SCALE_BITS, at least 1 for each id that occurs."""
    out = np.zeros(len(counts), np.int64)
    seen = np.flatnonzero(counts)
    if not len(seen):
        return out
    share = counts[seen] * ((1 << SCALE_BITS) / counts.sum())
    whole = np.maximum(1, share.astype(np.int64))
    over = int(whole.sum()) - (1 << SCALE_BITS)
    for k in np.argsort(-whole, kind="stable"):
        if over <= 0:
            break
        less = min(over, int(whole[k]) - max(1, int(whole[k]) // 2))
        whole[k] -= less
        over -= less
    whole[np.argmax(whole)] -= over
    out[seen] = whole
    return out


def frequencies(shards: DataFrame, path: str) -> np.ndarray:
    """The shared table, from the ids of all shards; as long as the vocabulary at most."""
    from tokenizers import Tokenizer

    counts = shards.select("n_ids", "ids").mapInArrow(_counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    size = Tokenizer.from_file(path).get_vocab_size()
    rows = broadcast_rows(shards.sparkSession, counts, size + 1, "token ids")
    out = np.zeros(max([size, *(r.id + 1 for r in rows)]), np.int64)
    for r in rows:
        out[r.id] = r.n
    return np.trim_zeros(scaled(out), "b")


def encode_shard(ids: np.ndarray, doc_ids: list, counts: list[int], freq: np.ndarray,
                 block_ids: int = BLOCK_IDS, lanes: int = LANES) -> bytes:
    """The file content of one shard."""
    ids = ids.astype(np.int64)
    cum = np.concatenate([[0], np.cumsum(freq)])[:-1].astype(np.uint64)
    f = freq.astype(np.uint64)
    sizes = [min(block_ids, len(ids) - a) for a in range(0, len(ids), block_ids)]
    steps = -(-block_ids // lanes) if len(sizes) > 1 else -(-max(sizes, default=0) // lanes)
    grid = np.full((len(sizes), steps * lanes), -1, np.int64)
    for k, n in enumerate(sizes):
        grid[k, :n] = ids[k * block_ids:k * block_ids + n]
    grid = grid.reshape(len(sizes), steps, lanes)
    state = np.full((len(sizes), lanes), _LOW, np.uint64)
    words = np.zeros((len(sizes), steps, lanes), np.uint32)
    given = np.zeros((len(sizes), steps, lanes), bool)
    full = min(sizes, default=0) // lanes  # steps in which every lane of every block has an id
    for step in range(steps - 1, -1, -1):
        symbol = grid[:, step]
        live = None if step < full else symbol >= 0
        at = symbol if live is None else np.where(live, symbol, 0)
        own = f[at] if live is None else np.where(live, f[at], np.uint64(1))
        out = state >= own << _ROOM
        if live is not None:
            out &= live
        words[:, step] = state  # the low half
        given[:, step] = out
        x = state.copy()
        x[out] >>= _WORD
        q = x // own
        coded = (q << _SCALE) + (x - q * own) + cum[at]
        state = coded if live is None else np.where(live, coded, x)
    head = _HEAD.pack(b"RNS1", len(doc_ids), len(sizes), lanes, SCALE_BITS, zlib.crc32(freq.astype("<u4").tobytes()), len(ids))
    parts = [head, np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
             np.array([d is not None for d in doc_ids], "u1").tobytes(), np.array(counts, "<u4").tobytes()]
    streams = []
    for k, n in enumerate(sizes):
        stream = words[k][given[k]].astype("<u4").tobytes()
        crc = zlib.crc32(ids[k * block_ids:k * block_ids + n].astype("<u4").tobytes())
        parts.append(struct.pack("<III", n, len(stream) // 4, crc) + state[k].astype("<u8").tobytes())
        streams.append(stream)
    return b"".join(parts + streams)


class Table:
    """A table of frequencies, laid out for decoding."""

    def __init__(self, freq: np.ndarray):
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.int32), freq)
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(freq)])[:-1].astype(np.uint64)


def decode_shard(content: bytes, table_: Table, only: list[int] | None = None) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, counts and ids of a shard (with ``only``: ids of those blocks)."""
    magic, n_docs, n_blocks, lanes, scale, crc, _ = _HEAD.unpack_from(content)
    if magic != b"RNS1" or scale != SCALE_BITS or crc != table_.crc:
        raise ValueError("not a shard of this table")
    at = _HEAD.size
    doc_ids = np.frombuffer(content, "<i8", n_docs, at)
    there = np.frombuffer(content, "u1", n_docs, at + 8 * n_docs)
    counts = np.frombuffer(content, "<u4", n_docs, at + 9 * n_docs).astype(np.int64)
    at += 13 * n_docs
    heads, states = [], []
    for _ in range(n_blocks):
        heads.append(struct.unpack_from("<III", content, at))
        states.append(np.frombuffer(content, "<u8", lanes, at + 12))
        at += 12 + 8 * lanes
    offsets = np.concatenate([[0], np.cumsum([4 * h[1] for h in heads])]).astype(int) + at
    chosen = range(n_blocks) if only is None else only
    heads, states, offsets = [heads[k] for k in chosen], [states[k] for k in chosen], [offsets[k] for k in chosen]
    steps = max((-(-h[0] // lanes) for h in heads), default=0)
    longest = max((h[1] for h in heads), default=0)
    stream = np.zeros((len(heads), longest + 1), np.uint64)
    for k, h in enumerate(heads):
        stream[k, :h[1]] = np.frombuffer(content, "<u4", h[1], offsets[k])
    state = np.array(states, np.uint64).reshape(len(heads), lanes)
    sizes = np.array([h[0] for h in heads], np.int64)[:, None]
    full = int(sizes.min()) // lanes if len(heads) else 0
    out = np.zeros((len(heads), steps, lanes), np.int32)
    read = np.zeros(len(heads), np.int64)
    lane = np.arange(lanes)
    for step in range(steps):
        slot = state & _MASK
        symbol = table_.symbol[slot.view(np.int64)]
        out[:, step] = symbol
        x = table_.freq[symbol] * (state >> _SCALE) + slot - table_.cum[symbol]
        take = x < _LOW
        if step >= full:
            live = step * lanes + lane < sizes
            x = np.where(live, x, state)
            take &= live
        row, column = np.nonzero(take)
        counts_read = np.bincount(row, minlength=len(heads))
        rank = np.arange(len(row)) - np.repeat(np.cumsum(counts_read) - counts_read, counts_read)
        x[row, column] = (x[row, column] << _WORD) | stream[row, read[row] + rank]
        state = x
        read += counts_read
    blocks = [o.ravel()[:h[0]] for o, h in zip(out, heads)]
    for block, h in zip(blocks, heads):
        if zlib.crc32(block.astype("<u4").tobytes()) != h[2]:
            raise ValueError("a block's checksum differs")
    ids = np.concatenate(blocks) if blocks else np.empty(0, np.int32)
    return [int(d) if t else None for d, t in zip(doc_ids, there)], counts, ids


def _encoded(freq: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                task, shard, doc_ids, counts, n, ids = (c[row].as_py() for c in batch.columns)
                content = encode_shard(_unpacked(ids, n), doc_ids, counts, freq)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([task], pa.int64()), pa.array([shard], pa.int64()), pa.array([n], pa.int64()),
                     pa.array([content], pa.binary())], names=["task", "shard", "n_ids", "content"])

    return run


def write_token_files(docs: DataFrame, path: str, end_id: int = END_ID) -> tuple[DataFrame, DataFrame]:
    """The stored files (task, shard, n_ids, content) and table (id, freq) of ``docs``."""
    shards = token_shards(docs, path, end_id)
    freq = frequencies(shards, path)
    spark = docs.sparkSession
    seen = np.flatnonzero(freq)
    shared = stored(spark.createDataFrame([(int(i), int(freq[i])) for i in seen], "id long, freq long"), "token-table")
    files = stored(shards.mapInArrow(_encoded(freq), "task long, shard long, n_ids long, content binary"), "token-files")
    return files, shared


def _decoded(freq: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout = Table(freq)
        for batch in batches:
            for row in range(batch.num_rows):
                task, shard, content = (c[row].as_py() for c in batch.columns)
                doc_ids, counts, ids = decode_shard(content, layout)
                ends = np.cumsum(counts)
                packed = ids.astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([task] * len(counts), pa.int64()), pa.array([shard] * len(counts), pa.int64()),
                     pa.array(doc_ids, pa.int64()), pa.array(ends - counts, pa.int64()), pa.array(counts, pa.int64()),
                     pa.array([zlib.crc32(packed[e - n:e].tobytes()) for e, n in zip(ends.tolist(), counts.tolist())], pa.int64())],
                    names=["task", "shard", "doc_id", "offset", "n_tokens", "ids_crc32"])

    return run


def read_token_files(files: DataFrame, shared: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (ids before it), n_tokens, ids_crc32."""
    rows = broadcast_rows(files.sparkSession, shared, 1 << SCALE_BITS, "token table")
    freq = np.zeros(max((r.id for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        freq[r.id] = r.freq
    sizes = files.select("task", "shard", "n_ids")
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row per task, then one window per task: neither grows with the ids
    tasks = sizes.groupBy("task").agg(F.sum("n_ids").alias("n_ids")).select(
        "task", before(Window.partitionBy(F.lit(0)).orderBy("task")).alias("task_start"))
    starts = sizes.select("task", "shard", before(Window.partitionBy("task").orderBy("shard")).alias("shard_start")).join(
        tasks, "task").select("task", "shard", (F.col("task_start") + F.col("shard_start")).alias("first"))
    found = files.select("task", "shard", "content").mapInArrow(
        _decoded(freq), "task long, shard long, doc_id long, offset long, n_tokens long, ids_crc32 long")
    return found.join(starts, ["task", "shard"]).select(
        "doc_id", (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document written to token files and read back."""
    path = public_tokenizers.path(TOKENIZER)
    return read_token_files(*write_token_files(table(spark, sf_dir, "documents"), path))
