"""Aggregates, export ordering and the export audit (O.17, O.70 - O.73).

Every aggregate is a hash aggregate with a map-side partial step; the only
global order is the export sort, done once by ``with_position``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actlens import rules
from actlens.functions.order import with_position
from actlens.operators.labels import label_counts

def one_row(*aggs: DataFrame) -> DataFrame:
    """Side-by-side combination of single-row aggregates: the first is the
    frame, each other one becomes a scalar subquery (one struct per input,
    evaluated once) -- no join operator at all."""
    cols = [F.col(c) for c in aggs[0].columns]
    for i, a in enumerate(aggs[1:]):
        packed = a.select(F.struct(*a.columns).alias("s")).scalar()
        cols += [packed.getField(c).alias(c) for c in a.columns]
    return aggs[0].select(*cols)


EXPORT_FIELDS = ["id", "title", "date", "source_system", "url", "primary_entity", "summary", "labels", "metadata"]


def export_table(df: DataFrame, tie: dict[str, bool] | None = None) -> DataFrame:
    """O.17: the nine exported fields, labels sorted, ordered by date then
    title, both descending; ties keep input order, giving ``pos``.  ``tie``:
    columns that stand for the input order, True for descending ones."""
    tie = tie or {"seq": False}
    keep = list(dict.fromkeys(["seq", *tie]))
    projected = df.select(*keep, *[F.sort_array("labels").alias("labels") if c == "labels" else F.col(c)
                                   for c in EXPORT_FIELDS])
    return with_position(projected, F.col("date").desc(), F.col("title").desc(),
                         *[F.col(c).desc() if down else F.col(c) for c, down in tie.items()])


def source_counts(df: DataFrame) -> DataFrame:
    """O.70: rows per source system."""
    return df.groupBy("source_system").agg(F.count(F.lit(1)).alias("n"))


def date_range(df: DataFrame) -> DataFrame:
    """O.71: earliest / latest non-empty date string; '' when there is none."""
    d = F.when(F.col("date") != "", F.col("date"))
    return df.agg(F.coalesce(F.min(d), F.lit("")).alias("earliest"),
                  F.coalesce(F.max(d), F.lit("")).alias("latest"))


def export_summary(df: DataFrame, run_ts: dt.datetime) -> DataFrame:
    """O.72: one row -- total, per-source counts, non-zero label counts (as
    maps), date range, generator and version."""
    src = source_counts(df).agg(F.map_from_entries(F.sort_array(F.collect_list(
        F.struct("source_system", "n")))).alias("source_counts"))  # <= 4 entries
    lab = label_counts(df, keep_zero=False).agg(F.map_from_entries(F.sort_array(F.collect_list(
        F.struct("label", "n")))).alias("label_counts"))  # <= 15 entries
    total = df.agg(F.count(F.lit(1)).alias("total_count"))
    # all inputs are single-row aggregates: the joins below are 1 x 1
    one = one_row(total, src, lab, date_range(df))
    return one.select(
        F.lit(run_ts.isoformat()).alias("last_updated"), "total_count", "source_counts", "label_counts",
        "earliest", "latest", F.lit("actlens").alias("generated_by"), F.lit("1.0").alias("version"),
    )


def export_audit(df: DataFrame) -> DataFrame:
    """O.73: one row -- missing fields, duplicate ids (errors) and URLs
    (warnings, one per later occurrence), distinct counts, valid flag."""
    falsy = lambda c: F.col(c).isNull() | (F.col(c) == "")
    per_id = df.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    per_url = df.groupBy("url").agg(F.count(F.lit(1)).alias("n"))
    missing = df.agg(
        F.count(F.lit(1)).alias("total_actions"),
        F.count(F.when(falsy("id"), 1)).alias("missing_id"),
        F.count(F.when(falsy("title"), 1)).alias("missing_title"),
        F.count(F.when(falsy("url"), 1)).alias("missing_url"),
    )
    ids = per_id.agg(F.count(F.lit(1)).alias("unique_ids"),
                     F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicate_ids"))
    urls = per_url.agg(F.count(F.lit(1)).alias("unique_urls"),
                       F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicate_urls"))
    one = one_row(missing, ids, urls)
    n_errors = F.col("missing_id") + F.col("missing_title") + F.col("missing_url") + F.col("duplicate_ids")
    return one.select(
        "total_actions", "unique_ids", "unique_urls", "missing_id", "missing_title", "missing_url",
        "duplicate_ids", "duplicate_urls",
        n_errors.cast("long").alias("n_errors"), F.col("duplicate_urls").alias("n_warnings"),
        (n_errors == 0).alias("valid"),
    )


def audit_flags(df: DataFrame) -> DataFrame:
    """Per-row audit marks: later occurrence of an id / a URL."""
    first_id = df.groupBy("id").agg(F.min("seq").alias("_fid"))
    first_url = df.groupBy("url").agg(F.min("seq").alias("_furl"))
    out = df.join(first_id, df["id"].eqNullSafe(first_id["id"]), "left").drop(first_id["id"])
    out = out.join(first_url, out["url"].eqNullSafe(first_url["url"]), "left").drop(first_url["url"])
    return out.withColumns({"dup_id": F.col("seq") > F.col("_fid"), "dup_url": F.col("seq") > F.col("_furl")}) \
        .drop("_fid", "_furl")


def audit_messages(df: DataFrame) -> DataFrame:
    """O.73: the audit's messages (seq, level, message): errors for missing
    fields and later occurrences of an id, warnings for those of a URL.  A
    missing id or URL that occurs again is a later occurrence too."""
    falsy = lambda c: F.col(c).isNull() | (F.col(c) == "")
    text = lambda c: F.coalesce(F.col(c), F.lit("None"))
    note = lambda level, *parts: F.struct(F.lit(level).alias("level"), F.concat(
        F.lit("Action "), F.col("seq").cast("string"), F.lit(": "), *parts).alias("message"))
    notes = F.array(
        *[F.when(falsy(c), note("error", F.lit(f"Missing {name}"))) for c, name in (("id", "ID"), ("title", "title"), ("url", "URL"))],
        F.when(F.col("dup_id"), note("error", F.lit("Duplicate ID "), text("id"))),
        F.when(F.col("dup_url"), note("warning", F.lit("Duplicate URL "), text("url"))))
    listed = audit_flags(df).select("seq", F.explode(F.filter(notes, lambda x: x.isNotNull())).alias("n"))
    return listed.select("seq", "n.level", "n.message")


def available_sources(df: DataFrame) -> DataFrame:
    """O.75: per-source counts over the four sources, zero-filled."""
    spark = df.sparkSession
    dim = F.broadcast(spark.createDataFrame([(s,) for s in rules.SOURCES], "source_system string"))  # 4 rows
    return dim.join(source_counts(df), "source_system", "left").select(
        "source_system", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
