"""Summaries kept up between snapshots (O.61, O.70 - O.73).

For each of source, label, date, id and URL the store has how many records of
the newest snapshot hold each value.  These counts are sums, so a run adds
what its merge opened and subtracts what it closed (``History.moved``): it
reads and rewrites the buckets of the values that moved, and nothing else.
What isn't a sum is read off the counts: bounds of dates, exact numbers of
different ids and URLs, and of their later occurrences.  These are kept per
bucket in the manifest, which is all that ``summary`` reads.

Layout: ``data/attempt=A/kind=K/bucket=B`` and ``manifest/run=R``, written in
that order, as in ``history``.  A value is shuffled as its own counts alone,
summed map-side first, so a value of a third of all rows is one row a task.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from actlens.operators.history import History
from actlens.session import materialize

KINDS = ("source", "label", "date", "id", "url")
BUCKETS = 64
_MANIFEST = ("kind string, bucket int, attempt string, different long, total long, missing long, earliest string, latest string")


def _values() -> Column:
    """(kind, value) of a record: each of its labels, and one of every other kind."""
    one = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("value"))
    labels = F.transform(F.coalesce("labels", F.array().cast("array<string>")),
                         lambda x: F.struct(F.lit("label").alias("kind"), x.alias("value")))
    return F.concat(F.array(one("source", "source_system"), one("date", "date"), one("id", "id"), one("url", "url")), labels)


class Counters:
    """The counts stored below ``path``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _manifest(self, run: str | None = None, before: str | None = None) -> dict[tuple[str, int], tuple] | None:
        """The newest manifest, that of a run, or the newest one before a run: kinds x buckets rows."""
        if not History(self.spark, self.path)._exists("manifest"):
            return None
        rows = self.spark.read.schema(f"{_MANIFEST}, run string").parquet(f"{self.path}/manifest")
        runs = [r.run for r in rows.select("run").distinct().collect()]
        name = run or max((r for r in runs if before is None or r < before), default=None)
        if name is None or name not in runs:
            return None
        found = rows.where(F.col("run") == name).drop("run").collect()
        return {(r.kind, r.bucket): tuple(r) for r in found if r.kind is not None}

    def _read(self, manifest: dict[tuple[str, int], tuple], which: list[tuple[str, int]]) -> DataFrame:
        paths = [f"{self.path}/data/attempt={manifest[k][2]}/kind={k[0]}/bucket={k[1]}" for k in which if k in manifest and manifest[k][3]]
        schema = "value string, n long, attempt string, kind string, bucket int"
        if not paths:
            return self.spark.createDataFrame([], schema).select("kind", "bucket", "value", "n")
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*paths).select("kind", "bucket", "value", "n")

    def update(self, run: str, opened: DataFrame, closed: DataFrame) -> list[tuple[str, int]]:
        """Add the records (with ``copies``) that a run opened, subtract those it closed; returns the (kind, bucket) pairs that moved.
        The last run may be added again."""
        before = self._manifest(before=run) or {}
        signed = [df.select(_values().alias("v"), (F.col("copies") * sign).alias("d")) for df, sign in ((opened, 1), (closed, -1))]
        bucket = F.pmod(F.xxhash64("value"), F.lit(self.buckets)).cast("int")
        moved = signed[0].unionByName(signed[1]).select(F.explode("v").alias("v"), "d").select("v.kind", "v.value", "d")
        moved = materialize(moved.groupBy("kind", "value").agg(F.sum("d").alias("n")).where("n <> 0").select(
            "kind", bucket.alias("bucket"), "value", "n"), "counters-moved")
        touched = sorted((r.kind, r.bucket) for r in moved.select("kind", "bucket").distinct().collect())
        attempt = f"{run}-{os.urandom(4).hex()}"
        summed = self._read(before, touched).unionByName(moved).groupBy("kind", "bucket", "value").agg(F.sum("n").alias("n"))
        (summed.where("n <> 0").hint("rebalance", "kind", "bucket").write.partitionBy("kind", "bucket")
         .parquet(f"{self.path}/data/attempt={attempt}"))
        new = dict(before)
        if touched:
            held = self.spark.read.schema("value string, n long, kind string, bucket int").parquet(f"{self.path}/data/attempt={attempt}")
            named = F.when(F.col("value") != "", F.col("value"))
            found = {(r[0], r[1]): r for r in held.groupBy("kind", "bucket").agg(
                F.count(F.lit(1)), F.sum("n"), F.coalesce(F.sum(F.when(named.isNull(), F.col("n"))), F.lit(0)), F.min(named),
                F.max(named)).collect()}  # kinds x buckets rows
            for k in touched:
                r = found.get(k)
                new[k] = (*k, attempt, *(r[2:] if r else (0, 0, 0, None, None)))
        rows = list(new.values()) or [(None,) * 8]  # a run without any value is a run too
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/run={run}")
        return touched

    def summary(self, run: str | None = None) -> dict:
        """Totals of the newest run, or of one: from its manifest alone."""
        manifest = self._manifest(run)
        if manifest is None:
            raise ValueError("no such run")
        of = lambda kind, at: sum(m[at] for k, m in manifest.items() if k[0] == kind)
        dates = [d for k, m in manifest.items() if k[0] == "date" for d in m[6:] if d is not None]
        return {"total_actions": of("id", 4), "unique_ids": of("id", 3), "duplicate_ids": of("id", 4) - of("id", 3),
                "missing_id": of("id", 5), "unique_urls": of("url", 3), "duplicate_urls": of("url", 4) - of("url", 3),
                "missing_url": of("url", 5), "earliest": min(dates, default=""), "latest": max(dates, default="")}

    def counts(self, kind: str, run: str | None = None) -> DataFrame:
        """(value, n) of a kind."""
        manifest = self._manifest(run)
        if manifest is None:
            raise ValueError("no such run")
        return self._read(manifest, [k for k in manifest if k[0] == kind]).select("value", "n")
