"""Distributed total order with consecutive positions.

``row_number()`` over an un-partitioned window moves every row into one
task.  Instead the rows are range-partitioned and sorted once, and each row
gets its partition and its place there *as data* before the table is written
to the shared folder.  What follows reads that stored table, so all of it
sees the same partitions: the row counts (one row per partition, bounded by
the partition count) become running offsets, which are broadcast.  A
partition without an offset fails the query instead of losing rows.

Callers that need an order but no position use ``orderBy`` alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actlens.session import materialize

_LOW_BITS = (1 << 33) - 1


def with_position(df: DataFrame, *order: Column | str, pos_col: str = "pos",
                  total_col: str | None = None, bound: int = 0, stored: dict[str, Column] | None = None) -> DataFrame:
    """Sort by ``order`` and add ``pos`` (1-based, consecutive);
    ``total_col`` adds the row total (taken from the per-partition counts).
    ``stored``: columns that are computed once, as the sorted rows are stored;
    before the sort they would be computed for its sample too.

    ``bound`` is for stored tables that may be small, as a query's matches
    are: at most so many rows, counted first, are numbered by one task,
    which saves storing them a second time."""
    if bound and (n := df.count()) <= bound:
        total = {total_col: F.lit(n).cast("long")} if total_col else {}
        return df.withColumns(stored or {}).withColumns({pos_col: F.row_number().over(Window.orderBy(*order)).cast("long"), **total})
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({
        **(stored or {}), "_pid": F.spark_partition_id(),
        "_idx": F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW_BITS)),
    })
    held = materialize(placed, "ordered")
    counts = held.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    extra = [F.sum("_n").over(Window.partitionBy()).cast("long").alias(total_col)] if total_col else []
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"), *extra)
    start = F.coalesce("_off", F.raise_error(F.lit("a partition has no offset")).cast("long"))
    out = held.join(F.broadcast(offsets), "_pid", "left").withColumn(pos_col, (start + F.col("_idx") + 1).cast("long"))
    return out.drop("_idx", "_pid", "_off")
