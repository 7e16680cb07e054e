"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actlens.session import materialize, table

__all__ = ["binary_column", "mix64", "stored", "table", "task_segments", "typed_batch", "u64",
           "unused_name", "uniform"]


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to and read from the shared folder: the plan runs once and lost executors reread files."""
    return materialize(df, name)


def unused_name(df: DataFrame, name: str) -> str:
    """``name``, or the first ``name_2``, ``name_3``, ... that no column of ``df`` has (case ignored)."""
    taken = {c.lower() for c in df.columns}
    out, k = name, 2
    while out.lower() in taken:
        out, k = f"{name}_{k}", k + 1
    return out


def task_segments() -> Iterator[int]:
    """Numbers that are unique within a job and the same when a task is run again."""
    context = TaskContext.get()
    first = (context.partitionId() if context else 0) << 33
    while True:
        yield first
        first += 1


def binary_column(column: pa.Array) -> list[bytes | None]:
    """Values of a string column as UTF-8 bytes, without decoding them."""
    return column.cast(pa.large_binary()).to_pylist()


def typed_batch(schema: pa.Schema, columns: dict[str, Iterable]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, type=f.type) for f in schema],
        schema=schema)


def numbering() -> defaultdict:
    """A dictionary that numbers new keys 0, 1, 2, ..."""
    out: defaultdict = defaultdict()
    out.default_factory = out.__len__
    return out


def give_back_memory() -> None:
    """Return freed memory to the system: a worker lives on after its task, and what it has freed counts as its own."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


#: Only the GNU C library has it.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def u64(value: int) -> np.uint64:
    return np.uint64(value & 0xFFFFFFFFFFFFFFFF)


_S30, _S27, _S31, _S11 = np.uint64(30), np.uint64(27), np.uint64(31), np.uint64(11)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit integers that scatters them."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _S30)) * _M1
        x = (x ^ (x >> _S27)) * _M2
        return x ^ (x >> _S31)


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from hashed 64-bit integers."""
    return ((mix64(x) >> _S11).astype(np.float64) + 0.5) * 2.0**-53


def broadcast_rows(spark: SparkSession, df: DataFrame, limit: int, what: str) -> list:
    """Rows of a table whose size has a bound: at most ``limit`` rows may come to the driver."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows")
    return rows


def null_safe_text(column: str):
    return F.coalesce(F.col(column), F.lit(""))
