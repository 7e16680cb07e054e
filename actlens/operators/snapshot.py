"""Snapshots and change detection (O.18 - O.21).

``snapshot_diff`` compares two snapshots as multisets of row hashes per id:
both sides are first aggregated to (id, hash, count) -- map-side combined --
and only then joined, so duplicated or hot ids never meet as row pairs.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actlens import rules

DIFF_FIELDS = ["id", "title", "date", "source_system", "url", "primary_entity", "summary", "labels", "metadata"]


def row_hash(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    fields = [f for f in (fields or DIFF_FIELDS) if f in df.columns]
    return df.withColumn("_h", F.xxhash64(*[F.col(f) for f in fields]))


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "id", fields: list[str] | None = None) -> DataFrame:
    """O.20: one row per key whose rows differ: ``added``, ``removed`` or
    ``changed``, with old / new row counts.  Empty result = unchanged."""
    def counts(df, side):
        return row_hash(df, fields).groupBy(key, "_h").agg(F.count(F.lit(1)).alias(side))

    pairs = counts(old, "n_old").join(counts(new, "n_new"), [key, "_h"], "full_outer")
    pairs = pairs.select(key, F.coalesce("n_old", F.lit(0)).alias("n_old"), F.coalesce("n_new", F.lit(0)).alias("n_new"))
    per_key = pairs.groupBy(key).agg(
        F.sum("n_old").cast("long").alias("n_old"),
        F.sum("n_new").cast("long").alias("n_new"),
        F.max((F.col("n_old") != F.col("n_new")).cast("int")).alias("_diff"),
    )
    status = (F.when(F.col("n_old") == 0, F.lit("added"))
              .when(F.col("n_new") == 0, F.lit("removed"))
              .otherwise(F.lit("changed")))
    return per_key.filter(F.col("_diff") == 1).select(key, status.alias("status"), "n_old", "n_new")


def has_changes(diff: DataFrame) -> bool:
    """The commit gate: any added / removed / changed key."""
    return not diff.isEmpty()


def write_snapshot(df: DataFrame, path: str, run_ts: dt.datetime) -> None:
    """O.19: add a snapshot partitioned by run date, run and source system;
    earlier runs stay readable, a run that is repeated replaces itself."""
    (df.withColumns({"run_date": F.lit(run_ts.strftime("%Y-%m-%d")), "run": F.lit(run_ts.strftime("run%Y%m%dT%H%M%S%f"))})
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("run_date", "run", "source_system").parquet(path))


def latest_snapshot(spark, path: str) -> DataFrame:
    """Rows of the newest run (partition-pruned read)."""
    snaps = spark.read.parquet(path)
    last = snaps.agg(F.max("run").alias("run"))
    return snaps.join(F.broadcast(last), "run").drop("run")  # one-row side


def last_change(history: DataFrame, key: str = "id") -> DataFrame:
    """O.21: per key, the latest run at which it changed.  ``history`` is a
    union of ``snapshot_diff`` results carrying ``run_ts``."""
    return history.groupBy(key).agg(F.max("run_ts").alias("last_changed"))


def export_json(df: DataFrame, path: str, summary: DataFrame | None = None) -> None:
    """O.18: rows as JSON lines (ordered by ``pos`` when present), and next to
    them the one-row summary (``export_summary``) and the list of labels."""
    rows = df.orderBy("pos") if "pos" in df.columns else df
    rows.write.mode("overwrite").json(f"{path}/actions")
    if summary is not None:
        summary.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")
    labels = df.sparkSession.createDataFrame([(k, x) for k, x in enumerate(rules.LABELS)], "pos int, label string")
    labels.coalesce(1).write.mode("overwrite").json(f"{path}/labels")


def write_feed(df: DataFrame, path: str) -> None:
    """O.22 sink: a feed view written as RSS-style ``<item>`` elements
    (title, link, pubDate, description, categories), newest first."""
    rows = df.orderBy("pos") if "pos" in df.columns else df
    (rows.select(F.col("title"), F.col("url").alias("link"), F.col("date").alias("pubDate"),
                 F.col("summary").alias("description"), F.col("labels").alias("category"))
     .write.mode("overwrite").format("xml").option("rootTag", "channel").option("rowTag", "item").save(path))
