"""Versioned history of snapshots as validity intervals (O.19 - O.21).

A snapshot is a multiset of records.  The history holds one interval for each
different record of a key and each stretch of runs in which the snapshots had
it: (record, copies, valid_from, valid_to), open while ``valid_to`` is null.
Merging a snapshot closes the intervals of records that are gone or have
another number of copies, and opens those of records that are new, so a record
that vanishes and returns has two intervals.

Layout, below one path::

    records/attempt=A/        the records of the intervals that the merge A opened
    open/attempt=A/bucket=B/  the open intervals of bucket B after the merge A
    closed/attempt=A/         the intervals that the merge A closed
    manifest/run=R/           for each bucket the merge whose files hold it, and under -1 the run's own merge

An interval is its record's key and hash; the record is written once, by the
merge that opened the interval, and found by hash and ``valid_from``.  Keys
are dealt to buckets by hash.  A merge compares hashes (no record of the
history is read or written again for that), writes the open files of touched
buckets alone, to a place of its own (run and a random name), and its manifest
last: readers
follow the manifests, so a merge that dies leaves the history as it was, and
is simply run again.  Run names sort by time, so reading the state as of a run
skips by directory what had closed before.

Records are compared by the sha256 of their fields as JSON, nulls kept.
Rows with a null key are records like others.  All shuffles of a merge are by
that hash or by row: a key that holds a third of all rows has as many hashes as
different records, and equal records are counted map-side first.  The snapshot's
own rows are shuffled once at most, where the opened ones are too many to be
broadcast as row numbers.
"""

from __future__ import annotations

import datetime as dt
import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from actlens.operators.snapshot import DIFF_FIELDS
from actlens.session import materialize

BUCKETS = 64
_TS = "run%Y%m%dT%H%M%S%f"
#: The manifest's entry for the merge itself.
_OWN = -1


def run_name(run_ts: dt.datetime) -> str:
    return run_ts.strftime(_TS)


def run_time(run: Column) -> Column:
    return F.to_timestamp(run, "'run'yyyyMMdd'T'HHmmssSSSSSS")


class History:
    """The history stored below ``path``."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id", fields: list[str] | None = None, buckets: int = BUCKETS):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.fields = list(fields or DIFF_FIELDS)
        if key not in self.fields:
            raise ValueError(f"{key} isn't among the fields")
        self.buckets = buckets

    # -- state
    def _exists(self, name: str) -> bool:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def _manifests(self) -> dict[str, dict[int, str]]:
        """Per merged run, the run whose files hold each bucket: runs x buckets rows."""
        if not self._exists("manifest"):
            return {}
        out: dict[str, dict[int, str]] = {}
        for r in self.spark.read.schema("bucket int, files string, run string").parquet(f"{self.path}/manifest").collect():
            out.setdefault(r.run, {})[r.bucket] = r.files
        return out

    def runs(self) -> list[str]:
        """Merged runs, oldest first."""
        return sorted(self._manifests())

    def _read(self, kind: str, paths: list[str]) -> DataFrame | None:
        if not paths:
            return None
        return self.spark.read.option("basePath", f"{self.path}/{kind}").parquet(*(f"{self.path}/{kind}/{p}" for p in paths))

    def _open(self, manifest: dict[int, str], buckets: list[int] | None = None) -> DataFrame | None:
        """Open intervals of the buckets, from the files that the manifest names."""
        rows = self._read("open", [f"attempt={a}/bucket={b}" for b, a in sorted(manifest.items())
                                   if b != _OWN and (buckets is None or b in buckets)])
        return rows if rows is None else rows.withColumn("valid_to", F.lit(None).cast("string"))

    def _closed(self, manifests: dict[str, dict[int, str]], after: str = "") -> DataFrame | None:
        """Intervals that the merged runs after ``after`` closed."""
        rows = self._read("closed", [f"attempt={m[_OWN]}" for r, m in sorted(manifests.items()) if r > after])
        return rows if rows is None else rows.withColumn("valid_to", F.substring_index("attempt", "-", 1))

    # -- merge
    def _staged(self, df: DataFrame) -> DataFrame:
        record = df.select(*self.fields)
        hashed = F.unhex(F.sha2(F.to_json(F.struct(*self.fields), {"ignoreNullFields": "false"}), 256))
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        return record.withColumns({"_hash": hashed, "bucket": bucket})

    def merge(self, df: DataFrame, run_ts: dt.datetime) -> list[int]:
        """Add the snapshot of a run; returns the buckets that were rewritten.  The last run may be merged again."""
        run = run_name(run_ts)
        manifests = self._manifests()
        later = [r for r in manifests if r > run]
        if later:
            raise ValueError(f"{max(later)} was merged before {run}")
        before = manifests.get(max((r for r in manifests if r < run), default=""), {})
        attempt = f"{run}-{os.urandom(4).hex()}"
        staged = materialize(self._staged(df).withColumn("_row", F.monotonically_increasing_id()), "history-snapshot")
        columns = ["_key", "_hash", "copies", "valid_from", "bucket"]
        # the key goes with the hash; of equal rows the first is the record
        new = staged.groupBy("bucket", "_hash").agg(F.count(F.lit(1)).alias("copies"), F.first(self.key).alias("_new_key"),
                                                    F.min("_row").alias("_row"))
        held = self._open(before)
        if held is None:
            held = staged.limit(0).select(F.col(self.key).alias("_key"), "_hash", F.lit(0).cast("long").alias("copies"),
                                          F.lit("").alias("valid_from"), "bucket")
        # a hash has one open interval
        both = held.select("bucket", "_hash", F.col("copies").alias("was"), "valid_from", "_key").join(new, ["bucket", "_hash"], "full_outer")
        moved = materialize(both.where(~F.col("was").eqNullSafe(F.col("copies"))), "history-moved")
        touched = [r.bucket for r in moved.select("bucket").distinct().collect()]  # at most the number of buckets
        closing, opening = moved.where("was IS NOT NULL"), moved.where("copies IS NOT NULL")
        kept = opening.select(F.col("_new_key").alias("_key"), "_hash", "copies", F.lit(run).alias("valid_from"), "bucket")
        old = self._open(before, touched) if touched else None
        if old is not None:
            kept = kept.unionByName(old.join(closing.select("bucket", "_hash"), ["bucket", "_hash"], "left_anti").select(*columns))
        closed = closing.select("_key", "_hash", F.col("was").alias("copies"), "valid_from", "bucket")
        records = staged.join(opening.select("_row"), "_row", "left_semi").select(*self.fields, "_hash")
        records.write.parquet(f"{self.path}/records/attempt={attempt}")
        # rebalance: a bucket is a file or, if large, several
        kept.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/open/attempt={attempt}")
        closed.hint("rebalance").write.parquet(f"{self.path}/closed/attempt={attempt}")
        left = [b for b in touched if self._exists(f"open/attempt={attempt}/bucket={b}")]
        manifest = {b: a for b, a in before.items() if b not in touched} | {b: attempt for b in left} | {_OWN: attempt}
        self.spark.createDataFrame([*manifest.items()], "bucket int, files string").coalesce(1).write.mode("overwrite").parquet(
            f"{self.path}/manifest/run={run}")
        return sorted(touched)

    # -- reads
    def intervals(self) -> DataFrame:
        """All intervals: fields, copies, valid_from, valid_to (null while open)."""
        manifests = self._manifests()
        return self._whole(manifests, self._spans(manifests))

    def _spans(self, manifests: dict[str, dict[int, str]], after: str = "") -> DataFrame:
        """All intervals that were open after the run ``after``, without their records: _key, _hash, copies, valid_from, valid_to."""
        if not manifests:
            raise ValueError("no run was merged")
        columns = ["_key", "_hash", "copies", "valid_from", "valid_to"]
        parts = [p for p in (self._open(manifests[max(manifests)]), self._closed(manifests, after)) if p is not None]
        # every merge writes closed intervals, if only their schema
        return reduce(DataFrame.unionByName, [p.select(*columns) for p in parts or [self._closed(manifests).limit(0)]])

    def _whole(self, manifests: dict[str, dict[int, str]], spans: DataFrame, upto: str | None = None) -> DataFrame:
        """Intervals with their records, which the runs up to ``upto`` opened."""
        rows = self._read("records", [f"attempt={m[_OWN]}" for r, m in sorted(manifests.items()) if upto is None or r <= upto])
        records = rows.select(*self.fields, "_hash", F.substring_index("attempt", "-", 1).alias("valid_from"))
        return spans.drop("_key").join(records, ["_hash", "valid_from"]).select(*self.fields, "copies", "valid_from", "valid_to")

    def as_of(self, run_ts: dt.datetime) -> DataFrame:
        """The snapshot as of the last run up to ``run_ts``, with its repeated rows."""
        manifests = self._manifests()
        run = max((r for r in manifests if r <= run_name(run_ts)), default=None)
        if run is None:
            raise ValueError("no run up to then")
        valid = self._whole(manifests, self._spans(manifests, run).where(F.col("valid_from") <= run), run)
        return valid.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*self.fields)

    def changes(self, run_ts: dt.datetime) -> DataFrame:
        """The ``snapshot_diff`` of a merged run and the run before it, from the intervals alone."""
        run = run_name(run_ts)
        rows = self._spans(self._manifests())
        started, ended = F.col("valid_from"), F.col("valid_to")
        old = F.when((started < run) & (ended.isNull() | (ended >= run)), F.col("copies")).otherwise(0)
        new = F.when((started <= run) & (ended.isNull() | (ended > run)), F.col("copies")).otherwise(0)
        moved = (started == run) | ended.eqNullSafe(run)
        per_key = rows.groupBy(F.col("_key").alias(self.key)).agg(F.sum(old).cast("long").alias("n_old"), F.sum(new).cast("long").alias("n_new"),
                                             F.max(moved).alias("_moved"))
        status = F.when(F.col("n_old") == 0, "added").when(F.col("n_new") == 0, "removed").otherwise("changed")
        return per_key.where("_moved").select(self.key, status.alias("status"), "n_old", "n_new")

    def moved(self) -> tuple[str, DataFrame, DataFrame]:
        """The last run and the intervals that it opened and closed, from the files it wrote."""
        manifests = self._manifests()
        run = max(manifests)
        attempt = manifests[run][_OWN]
        opened = self._open({b: a for b, a in manifests[run].items() if a == attempt})
        closed = self._closed({run: manifests[run]})
        opened = closed.limit(0) if opened is None else opened.where(F.col("valid_from") == run)
        of = lambda spans, runs: self._whole(runs, spans.select("_key", "_hash", "copies", "valid_from", "valid_to")).select(
            *self.fields, "copies")
        return run, of(opened, {run: manifests[run]}), of(closed, manifests)

    def last_change(self) -> DataFrame:
        """O.21: per key, the latest run at which its records changed, the first run's included."""
        moved = F.greatest("valid_from", F.coalesce("valid_to", "valid_from"))
        return self._spans(self._manifests()).groupBy(F.col("_key").alias(self.key)).agg(run_time(F.max(moved)).alias("last_changed"))
