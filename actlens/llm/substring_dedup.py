"""Substring deduplication by content-defined chunks.

A gear rolling hash over the last 16 bytes cuts each text wherever its value
falls below a threshold, on average every ``MEAN_CHUNK`` bytes.  A cut depends
on those 16 bytes alone, so an insertion moves no cut further away and equal
passages are cut alike in every document; in long stretches without a cut a
looser threshold cuts, and in what is still long, such as periodic text, the
places of the least hash within ``MEAN_CHUNK`` bytes to both sides, which every
stretch has.  Periodic text has one of them a period; of such a series of equal
hashes, counted from its start, cuts are ``MEAN_CHUNK`` bytes apart or more, so that
its chunks are the same ones whatever is around it.  The unit of deduplication is the
digest of ``RUN`` consecutive chunks.  A unit that occurs in several documents
belongs to the one with the smallest doc_id; in the others, adjoining or
overlapping repeated units are merged, trimmed to whole words (or, where no white
space is within ``FAR_SPACE`` bytes, to code points) and removed if they hold
``MIN_WORDS`` words or ``MIN_BYTES`` bytes.
At the default sizes a repeated passage of over 50 words loses all but a few
words at its edges.

The documents are stored in segments of about ``SEGMENT_BYTES`` of text.
Each segment sends one entry for each distinct unit, however often it holds
it, to the bucket of its digest; the bucket names the owner to the segments
concerned, which cut their own texts.  A passage that a third of all
documents hold so costs one entry per segment, and no text moves but once.

Defined results: a null text stays null and an empty one empty; rows with
equal doc_id are one document (repeats among them stay); a null doc_id comes
after all others, and rows with it are one document; repeats inside a
document stay.  All columns stay; ``spans`` and ``whole_chars`` are added
(renamed if the table has such columns).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actlens.llm.common import binary_column, mix64, stored, table, task_segments, unused_name

MEAN_CHUNK = 16
RUN = 3
#: In stretches longer than this without a cut, the threshold rises fourfold, then local minima cut.
LONG_CHUNK = 64
MIN_WORDS = 12
MIN_BYTES = 256
FAR_SPACE = 64
SEGMENT_BYTES = 4 << 20
#: Bytes of text whose units share a bucket.
BUCKET_BYTES = 16 << 20

_GEAR = (mix64(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(48)).astype(np.uint16)
_CUT = 65536 // MEAN_CHUNK
_LAST_ID = np.iinfo(np.int64).max
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def _least(h: np.ndarray) -> np.ndarray:
    """Places of the least hash within MEAN_CHUNK places to both sides; of nearby equal ones, places
    MEAN_CHUNK apart or more, from the first."""
    around = np.pad(h, MEAN_CHUNK, constant_values=0xFFFF)
    least = np.flatnonzero(h == np.lib.stride_tricks.sliding_window_view(around, 2 * MEAN_CHUNK + 1).min(axis=1))
    taken, last = [], -MEAN_CHUNK
    for k in least.tolist():
        if k - last >= MEAN_CHUNK:
            taken.append(k)
            last = k
    return np.array(taken, np.int64)


def chunk_ends(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks of a text given as bytes."""
    h = _GEAR[data]
    for shift in (1, 2, 4, 8):
        h[shift:] += h[:-shift] << np.uint16(shift)
    cut = h < _CUT
    cut[1:] &= ~cut[:-1]
    ends = np.flatnonzero(cut) + 1
    ends = ends if len(ends) and ends[-1] == len(data) else np.append(ends, len(data))
    for loosest in (False, True):
        starts = np.concatenate([[0], ends[:-1]])
        long = np.flatnonzero(ends - starts > LONG_CHUNK)
        if not len(long):
            break
        more = [ends]
        for a, b in zip(starts[long].tolist(), ends[long].tolist()):
            if loosest:
                more.append(_least(h[a:b]) + a + 1)
                continue
            cut = h[a:b] < _CUT * 4
            cut[1:] &= ~cut[:-1]
            more.append(np.flatnonzero(cut) + a + 1)
        ends = np.unique(np.concatenate(more))
    return ends


def units(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and digests of the runs of RUN chunks (or of all chunks, if there are fewer)."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    ends = chunk_ends(data)
    starts = np.concatenate([[0], ends[:-1]])
    lengths = ends - starts
    place = np.arange(len(data), dtype=np.uint64) - np.repeat(starts, lengths).astype(np.uint64)
    with np.errstate(over="ignore"):
        chunk = np.add.reduceat(mix64((place << np.uint64(8)) | data), starts) + lengths.astype(np.uint64)
        run = min(RUN, len(ends))
        digest = np.full(len(ends) - run + 1, run, np.uint64)
        for k in range(run):
            digest = mix64(digest ^ chunk[k:len(ends) - run + 1 + k])
    return starts[: len(digest)], ends[run - 1:], digest


def trimmed(data: np.ndarray, start: int, end: int) -> tuple[int, int] | None:
    """The whole words of a stretch of bytes, or None if they are too few to remove."""
    space = _SPACE[data[start:end]]
    if start and not _SPACE[data[start - 1]] and not space[0]:
        near = np.flatnonzero(space[:FAR_SPACE])
        start += int(near[0]) if len(near) else 0
        while start < end and data[start] & 0xC0 == 0x80:
            start += 1
    if end < len(data) and not _SPACE[data[end]] and not _SPACE[data[end - 1]]:
        near = np.flatnonzero(space[::-1][:FAR_SPACE])
        end -= int(near[0]) if len(near) else 0
        while end > start and data[end] & 0xC0 == 0x80:
            end -= 1
    if end <= start:
        return None
    inside = ~_SPACE[data[start:end]]
    words = int(inside[0]) + int((inside[1:] & ~inside[:-1]).sum())
    return (start, end) if words >= MIN_WORDS or end - start >= MIN_BYTES else None


def repeated_spans(data: np.ndarray, doc_id: int, digests: np.ndarray, owners: np.ndarray) -> list[tuple[int, int]]:
    """Byte spans to remove, given the owner of each repeated digest (ascending)."""
    if not len(digests):
        return []
    starts, ends, own = units(data)
    at = np.searchsorted(digests, own)
    at[at == len(digests)] = 0
    hit = np.flatnonzero((digests[at] == own) & (owners[at] != doc_id)) if len(own) else []
    merged: list[list[int]] = []
    for a, b in zip(starts[hit].tolist(), ends[hit].tolist()):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = b
        else:
            merged.append([a, b])
    return [s for a, b in merged if (s := trimmed(data, a, b))]


def _numbered(text_at: int, segment_bytes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = task_segments()
        segment, size = next(numbers), 0
        for batch in batches:
            out = []
            for n in pc.binary_length(batch.column(text_at)).to_pylist():
                if size >= segment_bytes:
                    segment, size = next(numbers), 0
                size += (n or 0) + 64
                out.append(segment)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())],
                                             names=[*batch.schema.names, "segment"])

    return run


def _entries(buckets: int) -> Callable:
    """(segment, doc_id, text) -> (bucket, segment, payload) with the distinct units of a segment."""

    def rows(segment: int, ids: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
        digest = np.concatenate(found)
        doc = np.repeat(np.array(ids, np.int64), [len(x) for x in found])
        order = np.lexsort((doc, digest))
        digest, doc = digest[order], doc[order]
        first = np.flatnonzero(np.concatenate([[True], digest[1:] != digest[:-1]]))
        last = np.append(first[1:], len(digest)) - 1
        digest, least, several = digest[first], doc[first], doc[first] != doc[last]
        bucket = digest % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        digest, least, several, bucket = digest[order], least[order], several[order], bucket[order]
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        ends = np.append(cut[1:], len(bucket))
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket[cut].astype(np.int32)), pa.array([segment] * len(cut), pa.int64()),
             pa.array([digest[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()),
             pa.array([least[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()),
             pa.array([several[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary())],
            names=["bucket", "segment", "digests", "least", "several"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, ids, found = None, [], []
        for batch in batches:
            for s, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binary_column(batch.column(2))):
                if s != segment and found:
                    yield rows(segment, ids, found)
                    ids, found = [], []
                segment = s
                digests = units(np.frombuffer(text or b"", np.uint8))[2]
                if len(digests):
                    ids.append(_LAST_ID if doc_id is None else doc_id)
                    found.append(digests)
        if found:
            yield rows(segment, ids, found)

    return run


def _owners(group: pa.Table) -> pa.Table:
    """One bucket: the owner of each repeated unit, for each segment that holds it outside the owner."""
    segments = group["segment"].to_pylist()
    parts = [np.frombuffer(x, np.uint64) for x in group["digests"].to_pylist()]
    digest = np.concatenate(parts)
    least = np.concatenate([np.frombuffer(x, np.int64) for x in group["least"].to_pylist()])
    several = np.concatenate([np.frombuffer(x, bool) for x in group["several"].to_pylist()])
    segment = np.repeat(np.array(segments, np.int64), [len(p) for p in parts])
    order = np.lexsort((least, digest))
    digest, least, several, segment = digest[order], least[order], several[order], segment[order]
    first = np.flatnonzero(np.concatenate([[True], digest[1:] != digest[:-1]]))
    owner = np.repeat(least[first], np.diff(first, append=len(digest)))
    told = several | (least != owner)
    digest, owner, segment = digest[told], owner[told], segment[told]
    order = np.lexsort((digest, segment))
    digest, owner, segment = digest[order], owner[order], segment[order]
    cut = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]])) if len(segment) else np.empty(0, int)
    ends = np.append(cut[1:], len(segment)) if len(cut) else cut
    return pa.table({
        "segment": pa.array(segment[cut], pa.int64()),
        "digests": pa.array([digest[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()),
        "owners": pa.array([owner[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary())})


def _cutter(columns: list[str], id_column: str, text_column: str) -> Callable:
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        digests = np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in told["digests"].to_pylist())])
        owners = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(x, np.int64) for x in told["owners"].to_pylist())])
        order = np.argsort(digests)
        digests, owners = digests[order], owners[order]
        docs = docs.combine_chunks()
        texts, spans, whole = [], [], []
        for doc_id, text in zip(docs[id_column].to_pylist(), binary_column(docs[text_column])):
            data = np.frombuffer(text or b"", np.uint8)
            own = repeated_spans(data, _LAST_ID if doc_id is None else doc_id, digests, owners)
            points = np.cumsum((data & 0xC0) != 0x80) if own else None
            spans.append([{"from": int(points[a - 1]) if a else 0, "to": int(points[b - 1])} for a, b in own])
            whole.append(None if text is None else int(((data & 0xC0) != 0x80).sum()))
            if own:
                bounds = [0, *(x for s in own for x in s), len(text)]
                text = b"".join(text[a:b] for a, b in zip(bounds[::2], bounds[1::2]))
            texts.append(None if text is None else text.decode())
        out = {c: docs[c] for c in columns}
        out[text_column] = pa.array(texts, pa.string())
        kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        return pa.Table.from_arrays([*out.values(), pa.array(spans, kind), pa.array(whole, pa.int64())],
                                    names=[*columns, "spans", "whole_chars"])

    return run


def without_repeats(docs: DataFrame, segment_bytes: int = SEGMENT_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` (doc_id, text, other columns) with repeated passages cut from text, plus spans (from, to: code
    points of the whole text that were cut) and whole_chars (its length)."""
    names = docs.columns
    # positions for names: the columns of docs may clash with those of this operator
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])
    at = {n: f"c{k}" for k, n in reversed(list(enumerate(names)))}
    plain = plain.withColumn(at["doc_id"], F.col(at["doc_id"]).cast("long")).withColumn(at["text"], F.col(at["text"]).cast("string"))
    schema = T.StructType([*plain.schema.fields, T.StructField("segment", T.LongType())])
    held = stored(plain.mapInArrow(_numbered(plain.columns.index(at["text"]), segment_bytes), schema), "text-segments")
    total = held.agg(F.coalesce(F.sum(F.octet_length(at["text"])), F.lit(0)).alias("n")).first().n
    buckets = max(64, math.ceil(total / bucket_bytes))
    entries = held.select("segment", at["doc_id"], at["text"]).mapInArrow(
        _entries(buckets), "bucket int, segment long, digests binary, least binary, several binary")
    told = entries.groupBy("bucket").applyInArrow(_owners, "segment long, digests binary, owners binary")
    told = stored(told, "repeated-units")
    result = T.StructType([*plain.schema.fields,
                           T.StructField("spans", T.ArrayType(T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())]))),
                           T.StructField("whole_chars", T.LongType())])
    cut = held.groupBy("segment").cogroup(told.groupBy("segment")).applyInArrow(
        _cutter(plain.columns, at["doc_id"], at["text"]), result)
    return cut.toDF(*names, unused_name(docs, "spans"), unused_name(docs, "whole_chars"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that a document with a smaller doc_id has."""
    cut = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select(
        "doc_id", F.coalesce("whole_chars", F.lit(0)).alias("whole_chars"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("kept_chars"),
        F.size("spans").cast("long").alias("n_removed"), (F.size("spans") > 0).alias("repeated"), "text", "spans")


def cut_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents without repeated passages; a text of which white space alone is left goes with its row.
    n_chars becomes the length of the text that stays, other columns stay."""
    cut = without_repeats(docs)
    spans = cut.columns[-2]
    left = cut.where((F.size(F.col(spans)) == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    changed = F.size(F.col(spans)) > 0
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        left = left.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return left.select(*docs.columns)
