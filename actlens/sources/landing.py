"""Landed files read with what is wrong with them set apart (O.13, O.27).

A feed file that isn't well-formed XML, or a JSON document that doesn't parse,
gives no rows and one quarantine row; all others are read.  Quarantine rows
are (source, file, place, reason, raw): ``place`` is a byte of the file or the
number of the document, ``raw`` the text there, at most ``RAW`` characters of
it (the whole stays where it landed).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actlens.operators import build as bld
from actlens.session import materialize
from actlens.sources import feeds

RAW = 500
QUARANTINE = "source string, file string, place long, reason string, raw string"


def no_quarantine(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], QUARANTINE)


def _file_problem(content: bytes) -> tuple[int, str] | None:
    parser = expat.ParserCreate()
    try:
        parser.Parse(content, True)
    except expat.ExpatError as e:
        return parser.ErrorByteIndex, expat.ErrorString(e.code)
    return None


def _problems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for k in range(batch.num_rows):  # one file at a time is in memory twice
            content = batch.column(1)[k].as_py()
            if (found := _file_problem(content)) is not None:
                place, reason = found
                at = max(0, min(place, len(content)) - RAW // 2)
                out.append((batch.column(0)[k].as_py(), place, reason, content[at:at + RAW].decode("utf-8", "replace")))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[c] for r in out], kind) for c, kind in enumerate((pa.string(), pa.int64(), pa.string(), pa.string()))],
            names=["file", "place", "reason", "raw"])


def broken_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, place, reason, raw) of files that aren't well-formed XML."""
    files = spark.read.format("binaryFile").load(path).select("_metadata.file_path", "content")
    return files.mapInArrow(_problems, "file string, place long, reason string, raw string")


def _whole_files(entries: DataFrame, broken: DataFrame) -> DataFrame:
    return entries.join(broken.select("file"), "file", "left_anti")


def land_act_feed(spark: SparkSession, path: str | list[str], run_ts: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """O.1 with its quarantine."""
    broken = broken_files(spark, path)
    rows = feeds.entries_with_file(spark, path, "entry", feeds.ATOM_ENTRY)
    good = _whole_files(rows, broken).select("seq", "title", F.col("link._href").alias("url"), "published", "content")
    return bld.parse_act_entry(good, run_ts), _of("LEGISLATION", broken)


def land_release_feed(spark: SparkSession, path: str | list[str], feed_type: str, run_ts: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """O.2 and O.43 with their quarantine: broken files, and items that the release rules refuse."""
    broken = broken_files(spark, path)
    rows = _whole_files(feeds.entries_with_file(spark, path, "item", feeds.RSS_ITEM), broken)
    raw = materialize(feeds.release_items(rows.select(
        "seq", "title", F.col("link").alias("url"), F.col("pubDate").alias("published"),
        F.col("description").alias("summary"), F.col("category").alias("tags")), feed_type, run_ts), "release-items")
    items = bld.enhance_release(raw)
    refused = items.where(~bld.valid_release(items)).select(
        F.lit("BEEHIVE").alias("source"), F.lit(None).cast("string").alias("file"), F.col("seq").cast("long").alias("place"),
        F.lit("release rules").alias("reason"), _raw(items))
    return items.where(bld.valid_release(items)), _of("BEEHIVE", broken).unionByName(refused)


def land_json(payloads: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_seq, payload) that parse as JSON, and the quarantine of the others."""
    payloads = materialize(payloads.withColumn("_parses", F.try_parse_json("payload").isNotNull()), "payloads")
    parses = F.col("_parses")
    bad = payloads.where(~parses).select(
        F.lit(source).alias("source"), F.lit(None).cast("string").alias("file"), F.col("doc_seq").cast("long").alias("place"),
        F.lit("not JSON").alias("reason"), F.substring(F.coalesce("payload", F.lit("")), 1, RAW).alias("raw"))
    return payloads.where(parses).drop("_parses"), bad


def land_bill_json(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """O.4 with its quarantine; ``seq`` orders documents and places in them."""
    good, bad = land_json(payloads, "PARLIAMENT")
    rows = feeds.read_bill_json(good).withColumn("summary", F.lit(None).cast("string"))
    return _in_order(rows), bad


def land_notice_json(payloads: DataFrame, run_ts: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """O.5 with its quarantine."""
    good, bad = land_json(payloads, "GAZETTE")
    return _in_order(feeds.read_notice_json(good, run_ts)), bad


def _in_order(rows: DataFrame) -> DataFrame:
    """One number for (doc_seq, pos): documents of a payload have fewer than 2**32 items."""
    return rows.withColumn("seq", F.shiftleft(F.col("doc_seq").cast("long"), 32) + F.col("pos")).drop("doc_seq", "pos")


def _of(source: str, broken: DataFrame) -> DataFrame:
    return broken.select(F.lit(source).alias("source"), "file", "place", "reason", "raw")


def _raw(df: DataFrame):
    return F.substring(F.to_json(F.struct(*[c for c in df.columns if not c.startswith("_")])), 1, RAW).alias("raw")
