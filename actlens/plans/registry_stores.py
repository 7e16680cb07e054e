"""Registered queries over stores that a job builds: the text index and the history of snapshots."""

from __future__ import annotations

import datetime as dt
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actlens import adapter
from actlens.operators import feeds_out
from actlens.operators import search as srch
from actlens.operators import text_index
from actlens.operators.counters import Counters
from actlens.operators.history import History, run_name
from actlens.plans import oracle as o
from actlens.plans.registry import _DATE_KEY, _SEARCH_CASES, _search_sql, _STAGE_NULLING, labelled, register
from actlens.session import scratch_path

# ------------------------------------------------------------- indexed search
#: The registered searches, and some that only the index has to answer.
_INDEXED = [_SEARCH_CASES[k] for k in ("search", "search_metadata", "search_stage_history", "search_exact", "search_number")] + [
    ("Bishop", {}), ("-v2", {"case_sensitive": True}), ("no such words", {}), ("2024-0", {"metadata": False}), ("Housing", {"stages": False})]


def _config(kw: dict) -> srch.SearchConfig:
    return srch.SearchConfig(case_sensitive=kw.get("case_sensitive", False), exact_match=kw.get("exact", False),
                             search_metadata=kw.get("metadata", True), search_stage_history=kw.get("stages", True))


@register("indexed_search", o.with_labelled(f", s AS ({_STAGE_NULLING}) " + " UNION ALL ".join(
    f"SELECT CAST({k} AS INTEGER) AS search, seq, id FROM s WHERE {_search_sql(needle, **kw)}" for k, (needle, kw) in enumerate(_INDEXED))))
def q_indexed_search(spark, sf):
    index = text_index.build_index(labelled(spark, sf))
    return reduce(DataFrame.unionByName, (
        text_index.indexed_search(spark, index, needle, _config(kw)).select(F.lit(k).alias("search"), "seq", "id")
        for k, (needle, kw) in enumerate(_INDEXED)))


# ------------------------------------------------------------------ history
# four runs of records keyed by base id (three versions each, so several rows a key); m = seq % 10:
# 1: all but m = 0; 2: all but m = 1, m = 2 renamed; 3: all but m = 3, m = 2 renamed, m = 4 twice;
# 4: all, m = 2 has its first name again, m = 5 has another URL
_RUNS = [dt.datetime(2025, 12, day) for day in (14, 15, 16, 17)]
_FIELDS = ["base", "id", "title", "date", "source_system", "url", "primary_entity", "summary", "labels", "metadata"]
_LAST = len(_RUNS)


def _runs(spark, sf) -> list[DataFrame]:
    acts = adapter.actions(spark, sf).withColumn("base", F.regexp_replace("id", "-v[0-9]+$", ""))
    m = F.col("seq") % 10
    renamed = acts.withColumn("title", F.when(m == 2, F.concat("title", F.lit(" (amended)"))).otherwise(F.col("title")))
    moved = acts.withColumn("url", F.when(m == 5, F.concat("url", F.lit("?moved"))).otherwise(F.col("url")))
    third = renamed.where(m != 3)
    return [acts.where(m != 0), renamed.where(m != 1), third.unionByName(third.where(m == 4)), moved]


@lru_cache(4)
def _stores(spark, sf) -> tuple[History, Counters]:
    """The four runs merged, and the summaries kept up beside them; built once a session for all queries of them."""
    history = History(spark, scratch_path(spark, "history"), key="base", fields=_FIELDS, buckets=4)
    counters = Counters(spark, scratch_path(spark, "counters"), buckets=4)
    for run_ts, df in zip(_RUNS, _runs(spark, sf)):
        history.merge(df, run_ts)
        counters.update(*history.moved())
    return history, counters


_RUNS_SQL = """, b AS (SELECT *, regexp_replace(id, '-v[0-9]+$', '') AS base, seq % 10 AS m FROM a),
r AS (SELECT 1 AS run, base, id, title, url FROM b WHERE m <> 0
  UNION ALL SELECT 2, base, id, CASE WHEN m = 2 THEN title || ' (amended)' ELSE title END, url FROM b WHERE m <> 1
  UNION ALL SELECT 3, base, id, CASE WHEN m = 2 THEN title || ' (amended)' ELSE title END, url FROM b WHERE m <> 3
  UNION ALL SELECT 3, base, id, title, url FROM b WHERE m = 4
  UNION ALL SELECT 4, base, id, title, CASE WHEN m = 5 THEN url || '?moved' ELSE url END FROM b),
n AS (SELECT base, id, title, url, count(*) FILTER (run = 1) AS c1, count(*) FILTER (run = 2) AS c2,
  count(*) FILTER (run = 3) AS c3, count(*) FILTER (run = 4) AS c4 FROM r GROUP BY base, id, title, url)"""


def _run_of(run_ts: dt.datetime) -> Column:
    return F.lit(run_ts.strftime("%Y-%m-%d")).alias("run")


def _runs_sql(select: str) -> str:
    return o.with_actions(_RUNS_SQL + select)


@register("history_as_of", _runs_sql("SELECT '2025-12-' || CAST(13 + run AS VARCHAR) AS run, base, id, title, url FROM r"))
def q_history_as_of(spark, sf):
    history, _ = _stores(spark, sf)
    return reduce(DataFrame.unionByName, (
        history.as_of(ts).select(_run_of(ts), "base", "id", "title", "url") for ts in _RUNS))


@register("history_changes", _runs_sql(" UNION ALL ".join(f"""
SELECT '2025-12-{13 + k}' AS run, base, CASE WHEN sum(c{k - 1}) = 0 THEN 'added' WHEN sum(c{k}) = 0 THEN 'removed' ELSE 'changed' END AS status,
  CAST(sum(c{k - 1}) AS BIGINT) AS n_old, CAST(sum(c{k}) AS BIGINT) AS n_new
FROM n GROUP BY base HAVING bool_or(c{k - 1} <> c{k})""" for k in range(2, _LAST + 1))))
def q_history_changes(spark, sf):
    history, _ = _stores(spark, sf)
    return reduce(DataFrame.unionByName, (history.changes(ts).select(_run_of(ts), "*") for ts in _RUNS[1:]))


@register("history_last_change", _runs_sql("""
SELECT base, TIMESTAMP '2025-12-13 00:00:00' + INTERVAL 1 DAY * max(
  CASE WHEN c4 <> c3 THEN 4 WHEN c3 <> c2 THEN 3 WHEN c2 <> c1 THEN 2 ELSE 1 END) AS last_changed FROM n GROUP BY base"""))
def q_history_last_change(spark, sf):
    return _stores(spark, sf)[0].last_change()


# ------------------------------------------------------------ kept summaries
_KEPT_SQL = """, k AS (SELECT r.run, r.id, r.url, x.date, x.source_system, x.labels
  FROM r JOIN (SELECT id, date, source_system, list_filter(string_split(coalesce(labels_in, ''), '|'), lambda s: s <> '') AS labels FROM b) x
  USING (id))
"""


@register("kept_summary", _runs_sql(_KEPT_SQL + """
SELECT '2025-12-' || CAST(13 + run AS VARCHAR) AS run, count(*) AS total_actions, count(DISTINCT id) AS unique_ids,
  count(*) - count(DISTINCT id) AS duplicate_ids, count(DISTINCT url) AS unique_urls, count(*) - count(DISTINCT url) AS duplicate_urls,
  min(nullif(date, '')) AS earliest, max(nullif(date, '')) AS latest FROM k GROUP BY run"""))
def q_kept_summary(spark, sf):
    _, counters = _stores(spark, sf)
    names = ["total_actions", "unique_ids", "duplicate_ids", "unique_urls", "duplicate_urls", "earliest", "latest"]
    rows = [(ts.strftime("%Y-%m-%d"), *(counters.summary(run_name(ts))[c] for c in names)) for ts in _RUNS]
    return spark.createDataFrame(rows, "run string, " + ", ".join(f"{c} {'string' if c in names[-2:] else 'long'}" for c in names))


@register("kept_counts", _runs_sql(_KEPT_SQL + f"""
SELECT 'source' AS kind, source_system AS value, count(*) AS n FROM k WHERE run = {_LAST} GROUP BY source_system
UNION ALL SELECT 'label', l, count(*) FROM (SELECT unnest(labels) AS l FROM k WHERE run = {_LAST}) GROUP BY l
UNION ALL SELECT 'url', url, count(*) FROM k WHERE run = {_LAST} GROUP BY url"""))
def q_kept_counts(spark, sf):
    _, counters = _stores(spark, sf)
    return reduce(DataFrame.unionByName, (counters.counts(kind).select(F.lit(kind).alias("kind"), "value", "n")
                                          for kind in ("source", "label", "url")))


# -------------------------------------------------------------------- feeds
_FEEDS_SQL = f""", f AS (SELECT seq, id, date, unnest(['ALL', source_system]) AS source, labels FROM lab),
g AS (SELECT seq, id, date, source, unnest(list_concat([''], labels)) AS label FROM f),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY source, label ORDER BY {_DATE_KEY} DESC NULLS LAST, seq) AS BIGINT) AS pos FROM g)
"""


@register("feed_fan_out", o.with_labelled(_FEEDS_SQL + "SELECT source, label, pos, seq FROM p"))
def q_feed_fan_out(spark, sf):
    return feeds_out.feed_rows(labelled(spark, sf).select("seq", "date", "source_system", "labels")).select(
        F.col("feed_source").alias("source"), F.coalesce("feed_label", F.lit("")).alias("label"), "pos", "seq")


@register("write_all_feeds", o.with_labelled(
    _FEEDS_SQL + "SELECT CASE WHEN label = '' THEN source ELSE source || '~' || label END AS feed, id FROM p"))
def q_write_all_feeds(spark, sf):
    """Every feed written as documents and read back."""
    path = scratch_path(spark, "feeds")
    feeds_out.write_feeds(labelled(spark, sf), path, compression="gzip")
    items = spark.read.format("xml").option("rowTag", "item").schema("guid string, feed string").load(path)
    return items.select("feed", F.col("guid").alias("id"))
