"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` stores the training tokens' postings: the documents are cut
into segments of about ``SEGMENT_WORDS`` words, and each stored row is one
segment with its own dictionary (term, number of postings) and the
delta-coded word positions of each term.  A segment is built by one task
from its own documents, so building shuffles nothing and no term, however
frequent, is gathered anywhere.

``phrase_hits`` and ``proximity_hits`` search the stored segments for test
phrases.  In each segment the lists of a phrase's terms are intersected
beginning with the rarest, each shifted by its offset in the phrase; a
phrase with a term that the segment lacks costs one lookup.  Test phrases
come in blocks of at most ``BLOCK_BYTES`` of text, one pass over the index
per block, so what is broadcast has a bound whatever the size of the test
set; the hits of all blocks are merged per document.

Defined results: a null text has no words; a null item text has no windows;
a null item_id is the empty string; item rows with the same item_id are one
item; documents with equal doc_id stay separate rows; an empty table gives
no rows, an empty test set no hits.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actlens.llm.common import binary_column, numbering, stored, table, task_segments, typed_batch, unused_name

SEGMENT_WORDS = 1 << 19
BLOCK_BYTES = 8 << 20
WINDOW = 10

# Word characters are those outside \x00-\x2F \x3A-\x60 \x7B-\x7F after lower-casing A-Z.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256))

_INDEX = pa.schema([
    ("segment", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("first_position", pa.binary()),
    ("n_words", pa.binary()), ("terms", pa.list_(pa.binary())), ("ends", pa.binary()), ("postings", pa.binary())])
_INDEX_DDL = ("segment long, doc_ids array<long>, first_position binary, n_words binary, "
              "terms array<binary>, ends binary, postings binary")
_HITS = pa.schema([
    ("segment", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()),
    ("spans", pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))),
    ("items", pa.list_(pa.string()))])
_HITS_DDL = ("segment long, place int, doc_id long, n_words long, "
             "spans array<struct<from:int,to:int>>, items array<string>")


def words(text: bytes | None) -> list[bytes]:
    """The words of a text given as UTF-8."""
    return [] if text is None else text.translate(_WORD_BYTES).split()


def _segment_row(segment: int, doc_ids: list, ids: list[np.ndarray], terms) -> pa.RecordBatch:
    lengths = np.array([len(x) for x in ids], np.uint32)
    # one empty position between documents: no phrase crosses it
    first = np.concatenate([[0], np.cumsum(lengths[:-1] + 1)]).astype(np.uint32) if len(ids) else lengths
    flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
    position = np.repeat(first - np.concatenate([[0], np.cumsum(lengths[:-1])]).astype(np.uint32), lengths) \
        + np.arange(len(flat), dtype=np.uint32)
    order = np.argsort(flat, kind="stable")
    position = position[order]
    ends = np.cumsum(np.bincount(flat, minlength=len(terms))).astype(np.uint32)
    deltas = np.diff(position, prepend=np.uint32(0)).astype(np.uint32)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else np.empty(0, np.int64)
    deltas[starts] = position[starts]
    return typed_batch(_INDEX, {
        "segment": [segment], "doc_ids": [doc_ids], "first_position": [first.tobytes()],
        "n_words": [lengths.tobytes()], "terms": [list(terms)], "ends": [ends.tobytes()],
        "postings": [deltas.tobytes()]})


def _indexer(segment_words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = task_segments()
        terms, doc_ids, ids, n = numbering(), [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), binary_column(batch.column(1))):
                found = words(text)
                doc_ids.append(doc_id)
                ids.append(np.fromiter(map(terms.__getitem__, found), np.int32, len(found)))
                n += len(found) + 1
                if n >= segment_words:
                    yield _segment_row(next(numbers), doc_ids, ids, terms)
                    terms, doc_ids, ids, n = numbering(), [], [], 0
        if doc_ids:
            yield _segment_row(next(numbers), doc_ids, ids, terms)

    return run


def build_index(docs: DataFrame, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """The positional index of ``docs`` (doc_id, text), stored in the shared folder; one row per segment."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return stored(rows.mapInArrow(_indexer(segment_words), _INDEX_DDL), "positional-index")


class Segment:
    """One row of the index, opened for searching."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        get = {name: batch.column(i)[row] for i, name in enumerate(batch.schema.names)}
        self.number = get["segment"].as_py()
        self.doc_ids = get["doc_ids"].as_py()
        self.first = np.frombuffer(get["first_position"].as_py(), np.uint32).astype(np.int64)
        self.n_words = np.frombuffer(get["n_words"].as_py(), np.uint32).astype(np.int64)
        self.terms = get["terms"].values
        self.ends = np.frombuffer(get["ends"].as_py(), np.uint32).astype(np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]])
        self._postings = np.frombuffer(get["postings"].as_py(), np.uint32)
        self._open: dict[int, np.ndarray] = {}

    def look_up(self, terms: pa.Array) -> np.ndarray:
        """The number of each term in this segment's dictionary, or -1."""
        return pc.fill_null(pc.index_in(terms, value_set=self.terms), -1).to_numpy(zero_copy_only=False)

    def positions(self, term: int) -> np.ndarray:
        if term not in self._open:
            part = self._postings[self.starts[term]:self.ends[term]]
            self._open[term] = np.cumsum(part, dtype=np.int64)
        return self._open[term]

    def count(self, numbers: np.ndarray) -> np.ndarray:
        if not len(self.ends):
            return np.zeros(numbers.shape, np.int64)
        return np.where(numbers >= 0, self.ends[numbers] - self.starts[numbers], 0)


def _among(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_values, x)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == x


def phrase_starts(segment: Segment, phrase: np.ndarray) -> np.ndarray:
    """Positions where the phrase (numbers of its terms, in order) occurs."""
    rarity = np.argsort(segment.count(phrase), kind="stable")
    found = segment.positions(int(phrase[rarity[0]])) - rarity[0]
    for k in rarity[1:]:
        if not len(found):
            break
        found = found[_among(segment.positions(int(phrase[k])), found + k)]
    return found


def proximity_starts(segment: Segment, phrase: np.ndarray, slop: int) -> np.ndarray:
    """First positions of runs of ``slop`` words (or up to the end of their document), beginning with one of the
    terms, that hold every term.  A term that the phrase has twice must occur twice."""
    needed, times = np.unique(phrase, return_counts=True)
    rarity = np.argsort(segment.count(needed), kind="stable")
    anchors = segment.positions(int(needed[rarity[0]]))
    starts = np.unique((anchors[:, None] - np.arange(slop)[None, :]).ravel())
    starts = starts[starts >= 0]
    doc = np.searchsorted(segment.first, starts, side="right") - 1
    stops = np.minimum(starts + slop, segment.first[doc] + segment.n_words[doc])
    begins = np.zeros(len(starts), bool)
    for k in rarity:
        if not len(starts):
            break
        at = segment.positions(int(needed[k]))
        low = np.searchsorted(at, starts)
        keep = np.searchsorted(at, stops) - low >= times[k]
        begins = (begins | _among(at, starts))[keep]
        starts, stops = starts[keep], stops[keep]
    return starts[begins[: len(starts)]]


def _one_document(segment: Segment, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document of each run and the run's first word in it."""
    doc = np.searchsorted(segment.first, starts, side="right") - 1
    word = starts - segment.first[doc]
    return doc, word


def _searcher(phrases: list[list[bytes]], owners: list[list[str]], slop: int | None) -> Callable:
    """phrases: distinct; owners: the items of each."""
    vocabulary = numbering()
    coded = [np.array([vocabulary[w] for w in p], np.int64) for p in phrases]
    terms = list(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(terms, pa.binary())
        width = max((len(c) for c in coded), default=1)
        grid = np.full((len(coded), width), -1, np.int64)
        for k, c in enumerate(coded):
            grid[k, : len(c)] = c
        for batch in batches:
            for row in range(batch.num_rows):
                segment = Segment(batch, row)
                spans: dict[int, list] = {}
                items: dict[int, set] = {}
                if len(coded) and len(segment.ends):
                    numbers = segment.look_up(known)
                    there = np.append(numbers >= 0, True)[grid].all(axis=1)
                    for k in np.flatnonzero(there):
                        phrase = numbers[coded[k]]
                        starts = phrase_starts(segment, phrase) if slop is None \
                            else proximity_starts(segment, phrase, slop)
                        if not len(starts):
                            continue
                        length = len(phrase) if slop is None else slop
                        doc, word = _one_document(segment, starts)
                        for d, w in zip(doc.tolist(), word.tolist()):
                            spans.setdefault(d, []).append((w, min(w + length, int(segment.n_words[d]))))
                            items.setdefault(d, set()).update(owners[k])
                n = len(segment.doc_ids)
                yield typed_batch(_HITS, {
                    "segment": [segment.number] * n, "place": range(n), "doc_id": segment.doc_ids,
                    "n_words": segment.n_words.tolist(),
                    "spans": [[{"from": a, "to": b} for a, b in _union(spans.get(d, []))] for d in range(n)],
                    "items": [sorted(items.get(d, ())) for d in range(n)]})

    return run


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def windows(item_words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    """``size`` consecutive words each; fewer words, but not none, are one window."""
    if not item_words:
        return []
    return list({tuple(item_words[k:k + size]): None for k in range(max(1, len(item_words) - size + 1))})


def _hits(index: DataFrame, items: DataFrame, window: int, slop: int | None, block_bytes: int) -> DataFrame:
    test = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
                        F.col("text").cast("string"))
    total = test.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    # twice as many blocks as fill: a block of hashed items stays below its bound in all likelihood
    blocks = max(1, math.ceil(2 * total / block_bytes)) if total > block_bytes else 1
    found = None
    for block in range(blocks):
        part = test.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        owners: dict[tuple, set[str]] = {}
        for row in part.toLocalIterator():
            for w in windows(words(row.text.encode() if row.text is not None else None), window):
                owners.setdefault(w, set()).add(row.item_id)
        run = _searcher([list(p) for p in owners], [sorted(x) for x in owners.values()], slop)
        hits = index.mapInArrow(run, _HITS_DDL)
        found = hits if found is None else found.unionByName(hits)
    return (
        found.groupBy("segment", "place")
        .agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
             F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
             F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        .withColumn("n_hit", F.aggregate(
            "spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
            lambda a, s: F.struct(
                (a["n"] + F.greatest(F.lit(0), s["to"] - F.greatest(a["end"], s["from"]))).alias("n"),
                F.greatest(a["end"], s["to"]).alias("end")),
            lambda a: a["n"]))
        .drop("segment", "place"))


def phrase_hits(index: DataFrame, items: DataFrame, window: int = WINDOW,
                block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per indexed document: doc_id, n_words, spans of words (from, to) inside occurrences of any window of
    ``items`` (item_id, text), items with occurring windows, n_hit words inside spans."""
    return _hits(index, items, window, None, block_bytes)


def proximity_hits(index: DataFrame, items: DataFrame, slop: int, window: int = WINDOW,
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """As ``phrase_hits``, for windows whose words all occur, in any order, within ``slop`` words."""
    return _hits(index, items, window, slop, block_bytes)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    hits = phrase_hits(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))



def keep_clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a word inside any occurrence of a benchmark window.  Columns stay; rows with equal
    doc_id are one document here, and go if any of them has such a word."""
    key = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hit_id = unused_name(docs, "hit_id")
    hits = phrase_hits(build_index(key), benchmark).where("n_hit > 0").select(
        F.col("doc_id").alias(hit_id)).distinct()
    return docs.join(hits, F.col("doc_id").cast("long").eqNullSafe(F.col(hit_id)), "left_anti")


ORACLE = r"""
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM lowered, sizes WHERE len(w) >= n)),
found AS (SELECT doc_id, k, g.n, item_id FROM grams g JOIN windows x ON g.n = x.n AND g.gram = x.gram),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM found) GROUP BY doc_id),
own AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT l.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM lowered l LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)
"""
