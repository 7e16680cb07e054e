"""Feed and API payload readers (O.1 - O.5).

Schemas are explicit (never inferred: an inferred ``published`` would become
a UTC timestamp and lose the local calendar date).  XML uses Spark's
built-in XML source; JSON payloads are parsed with ``from_json`` so a bad
document yields NULLs instead of failing the job.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actlens import rules
from actlens.functions.dates import normalise_date, rfc2822_date
from actlens.functions.order import with_position
from actlens.functions.text import nonempty
from actlens.operators import build as bld

ATOM_ENTRY = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("link", T.StructType([T.StructField("_href", T.StringType())])),
    T.StructField("published", T.StringType()),
    T.StructField("content", T.StringType()),
])

RSS_ITEM = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("link", T.StringType()),
    T.StructField("pubDate", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("category", T.ArrayType(T.StringType())),
])


def entries_with_file(spark: SparkSession, path: str | list[str], tag: str, schema: T.StructType) -> DataFrame:
    """Elements of XML files with ``file`` and ``seq``, from 0 on: by file name, then by place in the file.  A file is
    read whole by one task (multiLine), so the ids of its rows rise with their places; how files are packed into tasks
    has no effect on ``seq``."""
    rows = (spark.read.format("xml").option("rowTag", tag).option("mode", "PERMISSIVE").option("multiLine", True)
            .schema(schema).load(path)
            .select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("_place")))
    return with_position(rows, "file", "_place", pos_col="seq").withColumn("seq", F.col("seq") - 1).drop("_place")


def _entries(spark: SparkSession, path: str, tag: str, schema: T.StructType) -> DataFrame:
    return entries_with_file(spark, path, tag, schema).drop("file")


def read_act_feed(spark: SparkSession, path: str, run_ts: dt.datetime) -> DataFrame:
    """O.1: Atom entries -> raw act items (only 'Information type: Acts')."""
    rows = _entries(spark, path, "entry", ATOM_ENTRY).select(
        "seq", "title", F.col("link._href").alias("url"), "published", "content")
    return bld.parse_act_entry(rows, run_ts)


def read_release_feed(spark: SparkSession, path: str, feed_type: str, run_ts: dt.datetime) -> DataFrame:
    """O.2: RSS items -> raw release items; items without title or url skipped."""
    return release_items(_entries(spark, path, "item", RSS_ITEM).select(
        "seq", "title", F.col("link").alias("url"), F.col("pubDate").alias("published"),
        F.col("description").alias("summary"), F.col("category").alias("tags")), feed_type, run_ts)


def release_items(items: DataFrame, feed_type: str, run_ts: dt.datetime, entity: str | None = None) -> DataFrame:
    """Feed item rows (seq, title, url, published, summary, tags) -> raw release
    items.  ``entity`` names a column that overrides the person found in the
    text (per-person feeds); those items have no portfolio, and a date that
    can't be read stays empty."""
    title, url = F.col("title"), F.col("url")
    person = bld.person_in_text(F.coalesce("summary", F.lit("")), title)
    if entity is not None:
        person = F.col(entity)
    date = F.coalesce(F.date_format(rfc2822_date(F.col("published")), "yyyy-MM-dd"),
                      normalise_date(F.col("published"), "release"),
                      F.lit(run_ts.strftime("%Y-%m-%d") if entity is None else None))
    return items.filter(nonempty(title).isNotNull() & nonempty(url).isNotNull()).select(
        "seq", "title", "url", date.alias("date"), F.coalesce("summary", F.lit("")).alias("summary"),
        F.lit("BEEHIVE").alias("source_system"),
        bld.feed_doc_type(F.lit(feed_type)).alias("document_type"),
        person.alias("primary_entity"),
        (bld.portfolio_from_feed(F.col("tags"), title) if entity is None else F.lit(None).cast("string")).alias("portfolio"),
    )


def person_feeds(spark: SparkSession) -> DataFrame:
    """O.3 dimension: per-person feed name -> term id and display name (5 rows)."""
    return spark.createDataFrame(rules.PERSON_FEEDS, "feed string, term_id int").withColumn(
        "entity", F.initcap(F.regexp_replace("feed", "_", " ")))


def read_person_feeds(spark: SparkSession, items: DataFrame, run_ts: dt.datetime) -> DataFrame:
    """O.3: items of per-person feeds (``term_id`` column) -> raw release
    items with entity from the feed name and type Press Release."""
    dim = F.broadcast(person_feeds(spark))  # fixed 5-row table
    joined = items.join(dim, "term_id")
    out = release_items(joined, "release", run_ts, entity="entity")
    return out.withColumn("document_type", F.lit("Press Release"))


def person_feed_fallback(main: DataFrame, person: DataFrame, limit: int | None = None) -> DataFrame:
    """O.3 gate: person-feed rows are used only when the main feeds gave no
    rows, or fewer than ``limit``."""
    n_main = main.agg(F.count(F.lit(1)).alias("_n")).scalar()  # scalar subquery, one value
    use_person = (n_main == 0) | (n_main < F.lit(limit or 0))
    return main.unionByName(person.filter(use_person), allowMissingColumns=True)


BILL_ITEM = ("struct<billNumber:string,bill_number:string,title:string,name:string,url:string,link:string,"
             "sponsor:string,sponsoringMember:string,introductionDate:string,dateIntroduced:string,"
             "lastModified:string,lastUpdated:string>")
BILL_DOC = f"struct<items:array<{BILL_ITEM}>,bills:array<{BILL_ITEM}>,results:array<{BILL_ITEM}>>"
NOTICE_DOC = ("struct<search:struct<results:array<struct<title:string,description:string,landing_url:string,"
              "date:string,creator:array<string>>>>>")
PARLIAMENT_BASE = "https://bills.parliament.nz"


def read_bill_json(payloads: DataFrame) -> DataFrame:
    """O.4: bill API documents (column ``payload``) -> raw bill rows.
    List under items, else bills, else results; alternate key names; a
    sponsor object contributes displayName, else name."""
    doc = F.from_json(F.col("payload"), BILL_DOC)
    items = F.coalesce(doc["items"], doc["bills"], doc["results"])
    exploded = payloads.select("doc_seq", F.posexplode(items).alias("pos", "it"))
    it = F.col("it")
    url = F.coalesce(it["url"], it["link"])
    sponsor_raw = F.coalesce(it["sponsor"], it["sponsoringMember"], F.lit(""))
    sponsor_obj = F.from_json(sponsor_raw, "struct<displayName:string,name:string>")
    sponsor = F.when(sponsor_raw.startswith("{"), F.coalesce(sponsor_obj["displayName"], sponsor_obj["name"], F.lit(""))) \
        .otherwise(sponsor_raw)
    return exploded.select(
        "doc_seq", "pos", F.coalesce(it["billNumber"], it["bill_number"]).alias("bill_number"),
        F.coalesce(it["title"], it["name"], F.lit("")).alias("title"),
        F.when(url.isNotNull() & ~url.startswith("http"),
               F.concat(F.lit(PARLIAMENT_BASE), F.when(url.startswith("/"), F.lit("")).otherwise(F.lit("/")), url))
        .otherwise(url).alias("url"),
        sponsor.alias("primary_entity"),
        F.coalesce(it["introductionDate"], it["dateIntroduced"]).alias("introduction_date"),
        F.coalesce(it["lastModified"], it["lastUpdated"]).alias("last_updated"),
        F.lit(rules.DEFAULT_PARLIAMENT_NUMBER).alias("parliament_number"),
    )


def read_notice_json(payloads: DataFrame, run_ts: dt.datetime) -> DataFrame:
    """O.5: notice API documents -> raw notice rows; creator = first element;
    rows without title or url dropped."""
    doc = F.from_json(F.col("payload"), NOTICE_DOC)
    exploded = payloads.select("doc_seq", F.posexplode(doc["search"]["results"]).alias("pos", "r"))
    r = F.col("r")
    creator = F.coalesce(F.try_element_at(r["creator"], F.lit(1)), F.lit(""))
    info = bld.notice_info(F.coalesce(r["landing_url"], F.lit("")))
    return exploded.filter(nonempty(r["title"]).isNotNull() & nonempty(r["landing_url"]).isNotNull()).select(
        "doc_seq", "pos", r["title"].alias("title"), r["landing_url"].alias("url"),
        F.coalesce(normalise_date(r["date"], "notice"), F.lit(run_ts.strftime("%Y-%m-%d"))).alias("date"),
        F.coalesce(nonempty(creator), F.lit("Government")).alias("primary_entity"),
        F.coalesce(r["description"], F.lit("")).alias("summary"),
        info["notice_number"].alias("notice_number"), info["notice_type"].alias("notice_type"),
        bld.notice_portfolio(r["title"], creator).alias("portfolio"),
    )
