"""Trigram index for text search (O.65 - O.69 over a stored table).

``build_index`` stores the records once, with a row number, and reads the
stored fields again to write for every segment (a bounded run of rows) which
of them hold which trigram: one row a trigram and segment, with the rows as
delta-coded bytes.  Postings are laid out in directories by a hash of the
trigram and sorted by it, so a lookup reads the files of its own trigrams and
in them the row groups that hold them; records are laid out by the partition
that wrote them.  No row of a record is exploded or shuffled to build this:
what is shuffled are segments' postings, at most one row a trigram of each.

``indexed_search`` takes the needle's trigrams, rarest first by the stored
counts, intersects their postings segment by segment, reads the candidates'
partitions alone and applies ``search_condition`` to the candidates: the rows
are those of ``search`` with the same options.  A needle of fewer than three
characters, and one whose rarest trigram is in more than ``SCAN_SHARE`` of all
rows, is answered by the scan, which reads less then.

Trigrams are of fields folded one character at a time (lower case, final
sigma as sigma), so that what holds a needle in either case holds its folded
trigrams.  A field's trigrams never cross into the next field.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actlens.operators.search import META_SEARCH_FIELDS, SEARCH_FIELDS, SearchConfig, _js_trim_py, search, search_condition
from actlens.session import scratch_path

#: A prime, so that all three characters of a trigram take part in its remainder.
SHARDS = 61
#: Where the number of rows is kept among the trigrams' counts.
_TOTAL = -1
SEGMENT_ROWS = 1 << 16
SEGMENT_POSTINGS = 1 << 22
#: Trigrams whose postings are read: the rarest ones of the needle.
READ_GRAMS = 6
#: Above this share of all rows candidates aren't worth a join.
SCAN_SHARE = 0.2
#: Candidates of at most so many rows (8 bytes each) are broadcast; their number is bounded by the rarest trigram's count.
BROADCAST_ROWS = 1 << 20

_BITS = np.int64(21)


@dataclass(frozen=True)
class TextIndex:
    """Paths of a stored index."""

    rows: str
    postings: str
    counts: str
    schema: T.StructType

    def stored(self, spark: SparkSession) -> DataFrame:
        """The records with their number and directory."""
        return spark.read.schema(T.StructType([*self.schema.fields, T.StructField("_row", T.LongType()),
                                               T.StructField("_part", T.IntegerType())])).parquet(self.rows)

    def records(self, spark: SparkSession) -> DataFrame:
        return self.stored(spark).select(*self.schema.names)


#: No code point: what stands between two fields.
_BETWEEN = 0x1FFFFF


def _grams_of_all(fields: list[str]) -> np.ndarray:
    """Distinct trigrams of folded fields as numbers, ascending; none crosses from one field into the next."""
    ends = np.cumsum([len(f) + 1 for f in fields], dtype=np.int64) - 1
    points = np.frombuffer("\0".join(fields).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    if len(points) < 3:
        return np.zeros(0, np.int64)
    points[ends[:-1]] = _BETWEEN
    grams = points[:-2] << (2 * _BITS) | points[1:-1] << _BITS | points[2:]
    if len(fields) > 1:
        within = points != _BETWEEN
        grams = grams[within[:-2] & within[1:-1] & within[2:]]
    grams.sort()
    return grams[np.diff(grams, prepend=-1) != 0]


def grams_of(text: str) -> np.ndarray:
    """Distinct trigrams of a folded text as numbers, ascending."""
    return _grams_of_all([text])


def needle_grams(needle: str) -> np.ndarray:
    """Trigrams that every field holding the needle has.

    Those with a cased letter above U+24FF aren't used: what is a letter's lower case there depends on the version of
    Unicode, which Python and the JVM need not share."""
    folded = "".join(c.lower() for c in _js_trim_py(needle)).replace("ς", "σ")
    odd = [ord(c) > 0x24FF and (c.lower() != c or c.upper() != c) for c in folded]
    parts = [folded[k:k + 3] for k in range(len(folded) - 2) if not any(odd[k:k + 3])]
    return np.unique(np.concatenate([grams_of(p) for p in parts])) if parts else np.zeros(0, np.int64)


def _folded_fields() -> Column:
    """All searched fields of a record, folded; nulls left out."""
    values = [F.col(c).cast("string") for c in SEARCH_FIELDS]
    values += [F.col(f"metadata.{c}").cast("string") for c in META_SEARCH_FIELDS]
    listed = F.array(*values)
    empty = F.array().cast("array<string>")
    stages = F.col("metadata.stage_history")
    for more in (F.col("labels"), F.transform(stages, lambda s: s["stage"]), F.transform(stages, lambda s: s["date"].cast("string"))):
        listed = F.concat(listed, F.coalesce(more, empty))
    return F.transform(F.filter(listed, lambda x: x.isNotNull()), lambda x: F.translate(F.lower(x), "ς", "σ"))


def _packed(gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the numbers, 7 bits each, the last byte of a number below 128; and where each number ends."""
    gaps = gaps.astype(np.uint64)
    size = np.ones(len(gaps), np.int64)
    for k in range(1, 10):
        size += gaps >= np.uint64(1) << np.uint64(7 * k) if 7 * k < 64 else 0
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        more = (size[has] > k + 1).astype(np.uint8) << 7
        out[ends[has] - size[has] + k] = (gaps[has] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8) | more
    return out, ends


def encode_postings(rows: np.ndarray) -> bytes:
    """Ascending row numbers as differences of 7 bits a byte, the last byte of each below 128."""
    return _packed(np.diff(rows, prepend=0))[0].tobytes()


def _encode_runs(row: np.ndarray, starts: np.ndarray) -> pa.Array:
    """``encode_postings`` of each run of ``row`` that begins at ``starts``, all in one go."""
    gaps = np.diff(row, prepend=0)
    gaps[starts] = row[starts]
    data, ends = _packed(gaps)
    stops = np.concatenate([[0], ends[np.append(starts[1:], len(row)) - 1]]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(stops), pa.py_buffer(data)])


def decode_postings(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    place = np.arange(len(raw)) - np.repeat(starts, last - starts + 1) if len(last) else last
    parts = (raw & 127).astype(np.int64) << (7 * place)
    return np.cumsum(np.add.reduceat(parts, starts)) if len(last) else np.zeros(0, np.int64)


def _segments(segment_rows: int, segment_postings: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[int] = []
        grams: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            row = np.repeat(np.array(rows, np.int64), [len(g) for g in grams])
            gram = np.concatenate(grams)
            # rows came in ascending order, and stay so within a trigram
            order = np.argsort(gram, kind="stable")
            gram, row = gram[order], row[order]
            starts = np.flatnonzero(np.diff(gram, prepend=-1))
            return pa.RecordBatch.from_arrays(
                [pa.array(gram[starts]), pa.array(np.full(len(starts), rows[0], np.int64)),
                 pa.array(np.diff(starts, append=len(gram)).astype(np.int32)), _encode_runs(row, starts)],
                names=["gram", "segment", "n", "postings"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for row, fields in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    rows.append(row)
                    grams.append(_grams_of_all(fields))
                    held += len(grams[-1])
                    if held >= segment_postings or len(rows) >= segment_rows:
                        yield close()
                        rows, grams, held = [], [], 0
        if held:
            yield close()

    return run


def build_index(df: DataFrame, path: str | None = None, shards: int = SHARDS, segment_rows: int = SEGMENT_ROWS,
                segment_postings: int = SEGMENT_POSTINGS) -> TextIndex:
    """Store ``df`` (records with labels) and its index below ``path``, by default in the shared folder."""
    spark = df.sparkSession
    path = path or scratch_path(spark, "text-index")
    row = F.monotonically_increasing_id()
    df.withColumn("_row", row).withColumn("_part", F.shiftright(F.col("_row"), 33).cast("int")).write.partitionBy(
        "_part").parquet(f"{path}/rows")
    index = TextIndex(f"{path}/rows", f"{path}/postings", f"{path}/counts", df.schema)
    stored = index.stored(spark)
    # rows of a file come in order, and a file has the rows of one task
    segments = stored.select("_row", _folded_fields().alias("fields")).mapInArrow(
        _segments(segment_rows, segment_postings), "gram long, segment long, n int, postings binary")
    shard = (F.col("gram") % shards).cast("int").alias("shard")
    segments.select("*", shard).repartition(shards, "shard").sortWithinPartitions("shard", "gram", "segment").write.partitionBy(
        "shard").parquet(f"{path}/postings")
    postings = spark.read.schema(
        "gram long, segment long, n int, postings binary, shard int").parquet(f"{path}/postings")
    counts = postings.groupBy("shard", "gram").agg(F.sum("n").alias("n"))
    total = stored.agg(F.count("_row").alias("n")).withColumns({
        "shard": F.lit(_TOTAL), "gram": F.lit(_TOTAL).cast("long")})
    counts.unionByName(total).repartition(shards, "shard").sortWithinPartitions("shard", "gram").write.partitionBy(
        "shard").parquet(f"{path}/counts")
    return index


def _of_grams(df: DataFrame, grams: list[int], shards: int) -> DataFrame:
    """Rows of the trigrams, by directories and sorted values."""
    return df.where(F.col("shard").isin(*sorted({g % shards for g in grams})) & F.col("gram").isin(*grams))


@F.arrow_udf(T.ArrayType(T.LongType()))
def _common(postings: pa.Array) -> pa.Array:
    """Rows that all of a segment's postings hold, from the shortest one on."""
    out = []
    for parts in postings.to_pylist():
        parts = sorted(parts, key=len)
        rows = decode_postings(parts[0])
        for more in parts[1:]:
            if not len(rows):
                break
            rows = rows[np.isin(rows, decode_postings(more), assume_unique=True)]
        out.append(rows)
    return pa.array(out, pa.list_(pa.int64()))


def candidates(spark: SparkSession, index: TextIndex, needle: str, shards: int = SHARDS,
               scan_share: float = SCAN_SHARE) -> tuple[DataFrame, int] | None:
    """Rows (``_row``, ``_part``) that may hold the needle, and a bound of their number; None where a scan is due."""
    grams = needle_grams(needle).tolist()
    if not grams:
        return None
    counts = spark.read.schema("gram long, n long, shard int").parquet(index.counts)
    # as many rows as the needle has trigrams, and the total
    held = F.col("shard").isin(_TOTAL, *sorted({g % shards for g in grams})) & F.col("gram").isin(_TOTAL, *grams)
    known = {r.gram: r.n for r in counts.where(held).collect()}
    total = known.get(_TOTAL, 0)
    least = min((known.get(g, 0) for g in grams), default=0)
    if least > scan_share * total:
        return None
    rarest = sorted(grams, key=lambda g: (known.get(g, 0), g))[:READ_GRAMS]
    postings = spark.read.schema("gram long, segment long, n int, postings binary, shard int").parquet(index.postings)
    found = _of_grams(postings, rarest, shards).groupBy("segment").agg(
        F.collect_list("postings").alias("p")).where(F.size("p") == len(rarest))
    rows = found.select(F.explode(_common(F.col("p"))).alias("_row"))
    return rows.withColumn("_part", F.shiftright(F.col("_row"), 33).cast("int")), least


def indexed_search(spark: SparkSession, index: TextIndex, needle: str, cfg: SearchConfig = SearchConfig(),
                   shards: int = SHARDS, scan_share: float = SCAN_SHARE) -> DataFrame:
    """The rows of ``search`` over the indexed records."""
    records = index.stored(spark)
    condition = search_condition(needle, cfg)
    found = None if condition is None else candidates(spark, index, needle, shards, scan_share)
    if found is None:
        return search(records, needle, cfg).select(*index.schema.names)
    rows, bound = found
    if bound <= BROADCAST_ROWS:
        rows = F.broadcast(rows)
    return records.join(rows, ["_part", "_row"], "left_semi").where(condition).select(*index.schema.names)
