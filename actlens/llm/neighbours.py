"""Nearest neighbours by inner product: a block matrix join over int8 codes.

Every vector is coded once as int8 numbers and a scale, with the length of
what the code leaves out.  Queries are dealt to blocks and all vectors to
stripes; a tile is one block against one stripe.  A task gets the queries of
its tile first and then streams the stripe past them: a float32 product of
the codes is the exact integer product (or is taken in pieces that are), and

    x.y - x'.y'  =  (x - x').y' + x.(y - y')

bounds the error of the coded product x'.y' by |x - x'| |y'| + |x| |y - y'|.
A pair whose upper bound reaches the query's k-th best score so far survives,
is computed again in double precision from the original components, and goes
to the query's heap of k.  The heaps of a query's tiles are merged at the end.
The result is exact: only pairs that the bounds exclude are skipped.

A task holds one block of queries (``BLOCK_BYTES``), their heaps and one batch
of the stripe.  Rows are dealt by a hash of their place, so equal ids or
vectors don't meet in one task.  The grid has few blocks and many stripes,
as queries are the smaller side to copy.

Defined results: vectors that are null, empty, zero or hold null, infinite or
NaN components take no part; queries and candidates of different length
don't meet; rows that repeat an id are rows of their own, each a candidate of
the other; a null id is no query, and last among equal scores; a product that
is no number (sums beyond the range of doubles) is no neighbour.  Columns
other than the two named aren't carried.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from actlens.llm.common import stored, table

K = 20
QUERY_EVERY = 20
BLOCK_BYTES = 16 << 20
BLOCK_ROWS = 1 << 14
STRIPE_ROWS = 1 << 16
#: Tiles are dealt to at most so many tasks; more of them follow one another in a task.
MOST_TASKS = 10_000

_TILE_QUERIES, _TILE_ROWS = 512, 4096
#: float32 holds integers exactly up to 2**24; a product of two codes is at most 127 * 127.
_EXACT_DIMS = (1 << 24) // (127 * 127)
#: Rounding of double sums, relative to the product of lengths.
_SLACK = 1e-9
_LAST = -(1 << 63) - 1


def code_rows(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of the rows, their scales, the lengths of the coded rows and of what is left out."""
    top = np.abs(values).max(1)
    coded = np.rint(values / top[:, None] * 127).astype(np.int8)
    scale = top / 127  # 0 for the least doubles: then all is left out, and the bounds still hold
    back = coded * scale[:, None]
    return coded, scale, _length(back), _length(values - back)


def _length(rows: np.ndarray) -> np.ndarray:
    """Euclidean lengths, also of components whose squares leave the range of doubles."""
    top = np.abs(rows).max(1)
    top[top == 0] = 1
    return np.sqrt(np.square(rows / top[:, None]).sum(1)) * top


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, lists = batch.columns
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        for size in np.unique(sizes[sizes > 0]).tolist():
            at = np.flatnonzero(sizes == size)
            # nulls come as NaN
            values = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            good = np.isfinite(values).all(1) & (values != 0).any(1)
            values, at = values[good], at[good]
            if not len(at):
                continue
            codes, scale, length, left = code_rows(values.astype(np.float64))
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(at)), pa.array(np.full(len(at), size, np.int32)), _binary(codes),
                 pa.array(scale), pa.array(length), pa.array(left), _binary(values)],
                names=["vec_id", "dims", "codes", "scale", "length", "left", "values"])


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [
        None, pa.py_buffer(np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32)), pa.py_buffer(rows)])


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Equal-sized binary values as rows of int8, float32 or float64 numbers."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1]
    kind = {1: np.int8, 4: np.float32, 8: np.float64}[int(at[1] - at[0]) // dims]
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]].copy().view(kind).reshape(len(column), dims)


class _Rows:
    """Rows of a tile as matrices."""

    def __init__(self, batch: pa.RecordBatch):
        column = batch.column
        self.row = column("row").to_numpy()
        self.vec_id = column("vec_id").to_pylist()
        dims = column("dims")[0].as_py()
        self.codes = _matrix(column("codes"), dims).astype(np.float32)
        self.values = _matrix(column("values"), dims).astype(np.float64)
        self.scale, self.length, self.left = (column(c).to_numpy() for c in ("scale", "length", "left"))
        self.full = self.length + self.left  # at least the vector's own length


def coded_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of int8 codes held as float32; exact."""
    if a.shape[1] <= _EXACT_DIMS:
        return (a @ b.T).astype(np.float64)
    return sum((a[:, d:d + _EXACT_DIMS] @ b[:, d:d + _EXACT_DIMS].T).astype(np.float64)
               for d in range(0, a.shape[1], _EXACT_DIMS))


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of matching rows in double precision, added up component by component."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


class _Search:
    """The queries of a tile and the best candidates of each so far."""

    def __init__(self, queries: list[pa.RecordBatch], k: int):
        self.k = k
        whole = pa.Table.from_batches(queries).combine_chunks().to_batches()
        self.q = _Rows(whole[0])
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in self.q.row]
        self.least = np.full(len(self.heaps), -np.inf)

    def meet(self, batch: pa.RecordBatch) -> None:
        for at in range(0, batch.num_rows, _TILE_ROWS):
            rows = _Rows(batch.slice(at, _TILE_ROWS))
            for q in range(0, len(self.heaps), _TILE_QUERIES):
                self._tile(slice(q, q + _TILE_QUERIES), rows)

    def _tile(self, part: slice, c: _Rows) -> None:
        q, k = self.q, self.k
        near = coded_products(q.codes[part], c.codes) * q.scale[part, None] * c.scale
        error = q.left[part, None] * c.length + q.full[part, None] * c.left
        error += _SLACK * q.full[part, None] * c.full
        _, own_q, own_c = np.intersect1d(q.row[part], c.row, return_indices=True)
        upper, lower = near + error, near - error  # NaN where both leave the range of doubles
        np.nan_to_num(upper, copy=False, nan=np.inf, posinf=np.inf, neginf=-np.inf)
        np.nan_to_num(lower, copy=False, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        lower[own_q, own_c] = -np.inf
        least = self.least[part]
        if near.shape[1] > k and np.isneginf(least).any():
            least = np.maximum(least, np.partition(lower, -k, axis=1)[:, -k])
        wanted = upper >= least[:, None]
        wanted[own_q, own_c] = False  # never a candidate of itself
        found_q, found_c = np.nonzero(wanted)
        found_q += part.start
        for at in range(0, len(found_q), 1 << 15):
            some_q, some_c = found_q[at:at + (1 << 15)], found_c[at:at + (1 << 15)]
            scores = exact_products(q.values[some_q], c.values[some_c])
            number = ~np.isnan(scores)
            some_q, some_c, scores = some_q[number], some_c[number], scores[number]
            for i, j, score in zip(some_q.tolist(), some_c.tolist(), scores.tolist()):
                item = (score, _LAST if (name := c.vec_id[j]) is None else -name)
                heap = self.heaps[i]
                if len(heap) < k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
        for i in np.unique(found_q).tolist():
            if len(self.heaps[i]) == k:
                self.least[i] = self.heaps[i][0][0]

    def found(self) -> pa.RecordBatch:
        best = [sorted(h, reverse=True) for h in self.heaps]
        return pa.RecordBatch.from_arrays(
            [pa.array(self.q.row), pa.array(self.q.vec_id, pa.int64()),
             pa.array([[None if i == _LAST else -i for _, i in h] for h in best], pa.list_(pa.int64())),
             pa.array([[s for s, _ in h] for h in best], pa.list_(pa.float64()))],
            names=["row", "query_id", "ids", "scores"])


def _searched(k: int) -> Callable:
    """Rows sorted by tile and length, a tile's queries before its candidates."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, queries, search = None, [], None
        for batch in batches:
            tile, dims, kind = (batch.column(c).to_numpy() for c in ("tile", "dims", "is_candidate"))
            edges = np.flatnonzero((np.diff(tile) != 0) | (np.diff(dims) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                if a == b:
                    continue
                if key != (here := (int(tile[a]), int(dims[a]))):
                    if search:
                        yield search.found()
                    key, queries, search = here, [], None
                if not kind[a]:
                    queries.append(batch.slice(a, b - a))
                elif queries:
                    search = search or _Search(queries, k)
                    search.meet(batch.slice(a, b - a))
        if search:
            yield search.found()

    return run


def _merged(k: int) -> Callable:
    """The heaps of a query, from all its tiles, in rows that follow one another."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, name, lists = None, None, []
        out: list[tuple] = []

        def close() -> None:
            best = heapq.merge(*lists, reverse=True)
            out.extend((name, r, None if i == _LAST else -i, s) for r, (s, i) in enumerate(islice(best, k), 1))

        def rows() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
            found = [pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)]
            out.clear()
            return pa.RecordBatch.from_arrays(found, names=["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            for row, query_id, ids, scores in zip(*(c.to_pylist() for c in batch.columns)):
                if row != key:
                    close()
                    key, name, lists = row, query_id, []
                lists.append([(s, _LAST if i is None else -i) for s, i in zip(scores, ids)])
            yield rows()
        close()
        yield rows()

    return run


def coded_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """The vectors that take part, with their codes and a number of their own; stored."""
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))
    coded = rows.mapInArrow(_coded, "vec_id long, dims int, codes binary, scale double, length double, left double, values binary")
    return stored(coded.withColumn("row", F.monotonically_increasing_id()), "coded-vectors")


def nearest(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding",
            block_rows: int = BLOCK_ROWS, stripe_rows: int = STRIPE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows of each row with ``is_query``, a condition on vec_id."""
    coded = coded_vectors(vectors, id_col, vector_col)
    spark = coded.sparkSession
    queries = coded.where(is_query & F.col("vec_id").isNotNull())
    n, dims = coded.agg(F.count("row"), F.max("dims")).first()
    block_rows = max(1, min(block_rows, BLOCK_BYTES // (12 * max(dims or 1, 1))))
    blocks = max(1, -(-queries.count() // block_rows))
    stripes = max(1, -(-n // stripe_rows), -(-spark.sparkContext.defaultParallelism // blocks))
    block, stripe = (F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n)).cast("long") for salt, n in ((1, blocks), (2, stripes)))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    sides = queries.select("*", block.alias("block"), each(stripes).alias("stripe"), F.lit(0).alias("is_candidate")).unionByName(
        coded.select("*", each(blocks).alias("block"), stripe.alias("stripe"), F.lit(1).alias("is_candidate")))
    tiles = sides.withColumn("tile", F.col("block") * stripes + F.col("stripe")).drop("block", "stripe")
    tasks = min(blocks * stripes, MOST_TASKS)
    dealt = tiles.repartitionById(tasks, (F.col("tile") % tasks).cast("int"))
    found = dealt.sortWithinPartitions("tile", "dims", "is_candidate").mapInArrow(
        _searched(k), "row long, query_id long, ids array<long>, scores array<double>")
    return found.repartition("row").sortWithinPartitions("row").mapInArrow(
        _merged(k), "query_id long, rank int, vec_id long, score double")


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest other rows of every row of embeddings whose vec_id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0)


ORACLE = """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
  FROM e q JOIN e c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= 20"""
