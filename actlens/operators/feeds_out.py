"""Every feed of the site in one job (O.22): all, by source, by label, by both.

Each action belongs to several feeds -- two sources (its own and all) times
its labels and none.  What is sorted and numbered are keys alone (feed, date,
``seq`` and the number of the action's stored row), never its texts.

``feed_rows`` ranges the keys by (feed, newest first), so a feed that holds
all actions is as many partitions as it needs, and numbers them by offsets.

``write_feeds`` needs no order but one, as all feeds have the same: the keys
of actions are ranged newest first, each action's text goes to its partition
once, and there it is repeated for its feeds.  Every partition writes each of
its feeds as a channel document of its own, with head and tail; the names of a
feed's files are in the order of its items.  The actions that begin and end a
feed's document are looked up among the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actlens import rules
from actlens.operators.search import date_key
from actlens.session import materialize

SITE = "https://www.example.com/feed.xml"
ALL = "ALL"
_PLACE = (1 << 33) - 1
#: What places an action in its feeds.
_KEYS = ["seq", "date", "source_system", "labels"]
#: Partitions of documents for each that the stored actions are read in: its actions, repeated for their feeds, are sorted in memory.
_SPREAD = 4


def feeds() -> list[tuple[str, str | None]]:
    """(source, label) of every feed: each source and all of them, with each label and without."""
    return [(s, x) for s in [ALL, *rules.SOURCES] for x in [None, *rules.LABELS]]


def feed_name(source: Column, label: Column) -> Column:
    """``ALL``, ``GAZETTE``, ``ALL~Housing``, ``GAZETTE~Housing``."""
    return F.concat_ws("~", source, label)


def _feed_keys(source: Column, labels: Column) -> Column:
    """The feeds of an action as (source, label or null) structs."""
    known = F.array_distinct(F.filter(F.coalesce(labels, F.array().cast("array<string>")), lambda x: x.isin(rules.LABELS)))
    named = F.concat(F.array(F.lit(None).cast("string")), known)
    sources = F.when(source.isin(rules.SOURCES), F.array(F.lit(ALL), source)).otherwise(F.array(F.lit(ALL)))
    return F.flatten(F.transform(sources, lambda s: F.transform(named, lambda x: F.struct(s.alias("feed_source"), x.alias("feed_label")))))


def fan_out(df: DataFrame) -> DataFrame:
    """The rows of every feed: ``feed_source``, ``feed_label`` (null: any) and the action's columns."""
    each = df.withColumn("_feed", F.explode(_feed_keys(F.col("source_system"), F.col("labels"))))
    return each.select(*df.columns, "_feed.feed_source", "_feed.feed_label")


def feed_rows(df: DataFrame) -> DataFrame:
    """``fan_out`` with ``pos``, the place in the feed (1: newest): the feed's rows number themselves by partition offsets."""
    held = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "feed-actions")
    placed = _placed(fan_out(held.select("_row", *_KEYS)))
    # one row a feed and partition: their running sums are offsets
    parts = placed.groupBy("feed", "_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_idx").alias("_first"))
    before = Window.partitionBy("feed").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    start = parts.select("feed", "_pid", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    out = placed.join(F.broadcast(start), ["feed", "_pid"])
    out = out.withColumn("pos", F.col("_off") + F.col("_idx") - F.col("_first") + 1).drop("feed", "_pid", "_idx", "_off", "_first")
    if set(df.columns) - set(_KEYS):
        out = out.join(held.drop(*_KEYS), "_row")
    return out.select(*df.columns, "feed_source", "feed_label", "pos")


def _placed(rows: DataFrame) -> DataFrame:
    order = [F.col("feed"), date_key().desc_nulls_last(), F.col("seq")]
    named = rows.withColumn("feed", feed_name(F.col("feed_source"), F.col("feed_label")))
    return materialize(_numbered(named.repartitionByRange(*order).sortWithinPartitions(*order)), "feed-rows")


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"_pid": F.spark_partition_id(), "_idx": F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE))})


def _escaped(c: Column) -> Column:
    """Text of an XML element; characters that XML 1.0 can't hold are replaced."""
    text = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]", "�")
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def _element(tag: str, c: Column) -> Column:
    return F.when(c.isNotNull(), F.concat(F.lit(f"<{tag}>"), _escaped(c), F.lit(f"</{tag}>"))).otherwise(F.lit(""))


def _item() -> Column:
    categories = F.array_join(F.transform(F.coalesce("labels", F.array().cast("array<string>")), lambda x: _element("category", x)), "")
    return F.concat(F.lit("<item>"), _element("title", F.col("title")), _element("link", F.col("url")),
                    _element("guid", F.col("id")), _element("pubDate", F.col("date")), _element("description", F.col("summary")),
                    categories, F.lit("</item>"))


def _head(site: str) -> Column:
    source, label = F.col("feed_source"), F.col("feed_label")
    query = F.concat_ws("&", F.when(source != ALL, F.concat(F.lit("source="), source)),
                        F.when(label.isNotNull(), F.concat(F.lit("label="), F.replace(label, F.lit(" "), F.lit("%20")))))
    title = F.concat(F.lit("Public actions"), F.when(source != ALL, F.concat(F.lit(": "), source)).otherwise(F.lit("")),
                     F.when(label.isNotNull(), F.concat(F.lit(", "), label)).otherwise(F.lit("")))
    link = F.concat(F.lit(site), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<rss version="2.0"><channel>'), _element("title", title),
                    _element("link", link), _element("description", title), F.lit("\n"))


def _edges(keys: DataFrame) -> DataFrame:
    """Of ``keys`` (actions with partition and place) those that begin or end a document, with the feeds of these."""
    each = fan_out(keys).withColumn("feed", feed_name(F.col("feed_source"), F.col("feed_label")))
    ends = each.groupBy("_pid", "feed").agg(F.min_by("_row", "_idx").alias("opens"), F.max_by("_row", "_idx").alias("closes"))
    return ends.unpivot(["feed"], ["opens", "closes"], "_end", "_row").groupBy("_row").agg(*[
        F.collect_list(F.when(F.col("_end") == end, F.col("feed"))).alias(f"_{end}") for end in ("opens", "closes")])  # at most all feeds


def write_feeds(df: DataFrame, path: str, site: str = SITE, compression: str = "none") -> None:
    """All feeds as channel documents below ``path/feed=...``; ``compression`` is that of text files."""
    held = materialize(df.select(*_KEYS, _item().alias("_item")).withColumn("_row", F.monotonically_increasing_id()), "feed-items")
    order = [date_key().desc_nulls_last(), F.col("seq")]
    n = _SPREAD * max(1, held.rdd.getNumPartitions())
    keys = materialize(_numbered(held.select("_row", *_KEYS).repartitionByRange(n, *order).sortWithinPartitions(*order)), "feed-keys")
    places = keys.select("_row", "_pid", "_idx").join(_edges(keys), "_row", "left")
    dealt = held.select("_row", "source_system", "labels", "_item").join(places, "_row").repartitionById(n, F.col("_pid"))
    each = fan_out(dealt).withColumn("feed", feed_name(F.col("feed_source"), F.col("feed_label")))
    at = lambda end: F.coalesce(F.array_contains(end, F.col("feed")), F.lit(False))
    line = F.concat(F.when(at("_opens"), _head(site)).otherwise(F.lit("")), F.col("_item"),
                    F.when(at("_closes"), F.lit("\n</channel></rss>")).otherwise(F.lit("")))
    (each.select("feed", "_idx", line.alias("value")).sortWithinPartitions("feed", "_idx").select("feed", "value")
     .write.partitionBy("feed").option("compression", compression).text(path))
