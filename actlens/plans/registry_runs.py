"""Registered queries of the contained run (O.13, O.27, O.74, O.80) over landed files, some of them broken."""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actlens import raw as rawmod
from actlens import rules
from actlens.plans import run as runs
from actlens.plans.registry import (_ACT_ITEM_CTE, _DATE_OK, _ID_OK, _LAST_PART, _RAW, _URL_OK, ORACLES, RUN_DATE, RUN_TS,
                                    _act_feed_path, _tiered_events, register)
from actlens.session import scratch_path
from actlens.sources import combine as comb
from actlens.sources import landing

#: Items of a landed JSON document; the documents whose number leaves 3 by 5 are cut short.
_DOC_ITEMS, _EVERY, _CUT = 20, 5, 3


def _documents(spark, sf, source: str, item, wrap) -> DataFrame:
    r = rawmod.raw_items(spark, sf).filter(F.col("source_system") == source)
    items = r.select(F.floor(F.col("seq") / _DOC_ITEMS).cast("long").alias("doc_seq"), "seq", item.alias("j"))
    docs = items.groupBy("doc_seq").agg(F.array_sort(F.collect_list(F.struct("seq", "j"))).alias("xs"))
    whole = wrap(F.array_join(F.transform("xs", lambda x: x["j"]), ","))
    return docs.select("doc_seq", F.when(F.col("doc_seq") % _EVERY == _CUT, F.left(whole, F.length(whole) - 2)).otherwise(whole)
                       .alias("payload"))


def _bills(spark, sf):
    item = F.to_json(F.struct(F.col("bill_number_raw").alias("billNumber"), "title", "url", F.col("creator").alias("sponsor"),
                              F.col("published").alias("introductionDate")))
    return landing.land_bill_json(_documents(spark, sf, "PARLIAMENT", item, lambda body: F.concat(F.lit('{"items": ['), body, F.lit("]}"))))


def _notices(spark, sf):
    item = F.to_json(F.struct("title", F.col("body").alias("description"), F.col("url").alias("landing_url"),
                              F.col("published").alias("date"), F.when(F.col("creator").isNotNull(), F.array("creator")).alias("creator")))
    return landing.land_notice_json(_documents(
        spark, sf, "GAZETTE", item, lambda body: F.concat(F.lit('{"search": {"results": ['), body, F.lit("]}}"))), RUN_TS)


def _acts(spark, sf):
    whole = _act_feed_path(spark, sf)
    broken = scratch_path(spark, "act-feed-broken")
    spark.createDataFrame([("<feed><entry><title>Cut Act</title><content>Information type: Acts</content>",)], "value string").coalesce(
        1).write.text(broken)
    return landing.land_act_feed(spark, [whole, broken], RUN_TS)


def _releases(spark, sf):
    r = rawmod.raw_items(spark, sf).filter(F.col("source_system") == "BEEHIVE")
    path = scratch_path(spark, "release-feed")
    tags = F.when(F.col("tags").isNull(), F.array().cast("array<string>")).otherwise(F.split("tags", r"\|"))
    (r.select("title", F.col("url").alias("link"), F.col("published").alias("pubDate"), F.col("body").alias("description"),
              tags.alias("category")).write.format("xml").option("rootTag", "channel").option("rowTag", "item").save(path))
    return landing.land_release_feed(spark, path, "releases", RUN_TS)


def _readers(spark, sf) -> dict:
    return {"PARLIAMENT": lambda: _bills(spark, sf), "LEGISLATION": lambda: _acts(spark, sf),
            "GAZETTE": lambda: _notices(spark, sf), "BEEHIVE": lambda: _releases(spark, sf)}


_READ = f"floor(seq / {_DOC_ITEMS})::BIGINT % {_EVERY} <> {_CUT}"
_SITE = "starts_with(url, 'https://www.beehive.govt.nz/') AND length(title) BETWEEN 10 AND 500"


def _run_sql(select: str, releases: bool = True) -> str:
    """CTEs: ``got`` (source, rows read, rows set apart) and ``u`` (records with the field that the schema check refuses)."""
    none = "" if releases else " AND false"
    return f"""WITH r AS ({_RAW}),
got AS (
  SELECT 'LEGISLATION' AS source, (SELECT count(*) FROM r WHERE contains(content, 'Information type: Acts')) AS n, 1 AS bad
  UNION ALL SELECT 'PARLIAMENT', count(*) FILTER ({_READ}), count(DISTINCT floor(seq / {_DOC_ITEMS})) FILTER (NOT ({_READ}))
    FROM r WHERE source_system = 'PARLIAMENT'
  UNION ALL SELECT 'GAZETTE', count(*) FILTER ({_READ} AND title <> '' AND url <> ''),
    count(DISTINCT floor(seq / {_DOC_ITEMS})) FILTER (NOT ({_READ})) FROM r WHERE source_system = 'GAZETTE'
  UNION ALL SELECT 'BEEHIVE', count(*) FILTER ({_SITE}), count(*) FILTER (NOT ({_SITE}))
    FROM r WHERE source_system = 'BEEHIVE' AND title <> '' AND url <> ''{none}),
v AS (
  SELECT b.id, b.date, r.url, 'LEGISLATION' AS source, b.commencement_date FROM ({ORACLES['build_act']}) b JOIN r USING (seq)
  UNION ALL SELECT b.id, b.date, r.url, 'GAZETTE', NULL FROM ({ORACLES['build_notice']}) b JOIN r USING (seq) WHERE {_READ}
  UNION ALL SELECT b.id, b.date, CASE WHEN r.url = '' THEN 'https://bills.parliament.nz/' ELSE r.url END, 'PARLIAMENT', NULL
    FROM ({ORACLES['build_bill']}) b JOIN r USING (seq) WHERE {_READ}
  UNION ALL SELECT 'bee-{RUN_TS.year}-' || substring(regexp_replace(coalesce({_LAST_PART}, 'unknown'), '[^a-zA-Z0-9]', '', 'g'), 1, 10) || '-v1',
    '{RUN_DATE}', url, 'BEEHIVE', NULL FROM r WHERE source_system = 'BEEHIVE' AND title <> '' AND url <> '' AND {_SITE}{none}),
u AS (SELECT source, CASE WHEN NOT {_ID_OK} THEN 'id' WHEN NOT ({_DATE_OK}) THEN 'date' WHEN NOT {_URL_OK} THEN 'url'
    WHEN commencement_date IS NOT NULL AND try_strptime(commencement_date, '%Y-%m-%d') IS NULL THEN 'commencement_date' END AS reason FROM v),
ok AS (SELECT got.source, (SELECT count(*) FROM u WHERE u.source = got.source AND reason IS NULL) AS n FROM got)
{select}"""


_METRICS_SQL = """
SELECT 'collect' AS stage, source, n + bad AS input_rows, n AS output_rows, CAST(bad AS BIGINT) AS rejected_rows, true AS success FROM got
UNION ALL SELECT 'convert', source, got.n, ok.n, got.n - ok.n, true FROM got JOIN ok USING (source){raised}
UNION ALL SELECT stage, source, n, n, 0, {did} FROM ok, (SELECT unnest(['validate', 'versions', 'labels']) AS stage) WHERE n > 0
UNION ALL SELECT stage, 'ALL', (SELECT CAST(sum(n) AS BIGINT) FROM ok), (SELECT CAST(sum(n) AS BIGINT) FROM ok), 0, {did}
  FROM (SELECT unnest(['validate', 'versions', 'labels', 'export']) AS stage)"""


def _metrics(found: runs.Run) -> DataFrame:
    return found.metrics.select("stage", "source", "input_rows", "output_rows", "rejected_rows", "success")


@lru_cache(4)
def _run(spark, sf) -> runs.Run:
    """One run over the landed files, for the queries of its tables."""
    return runs.run(spark, _readers(spark, sf), RUN_TS)


def _raises(*_):
    raise ValueError("on purpose")


@lru_cache(4)
def _failing_run(spark, sf) -> runs.Run:
    """A source and a stage that raise: the run goes on without the one and past the other."""
    readers = _readers(spark, sf) | {"BEEHIVE": _raises}
    return runs.run(spark, readers, RUN_TS, stages=runs.STAGES | {"versions": _raises})


@register("run_metrics", _run_sql(_METRICS_SQL.format(raised="", did="true")))
def q_run_metrics(spark, sf):
    return _metrics(_run(spark, sf))


@register("run_quarantine", _run_sql("""
SELECT 'collect' AS stage, source, CASE source WHEN 'LEGISLATION' THEN 'no element found' WHEN 'BEEHIVE' THEN 'release rules'
  ELSE 'not JSON' END AS reason, CAST(bad AS BIGINT) AS n FROM got WHERE bad > 0
UNION ALL SELECT 'convert', source, reason, count(*) FROM u WHERE reason IS NOT NULL GROUP BY source, reason"""))
def q_run_quarantine(spark, sf):
    return _run(spark, sf).quarantine.groupBy("stage", "source", "reason").agg(F.count(F.lit(1)).alias("n"))


@register("run_failures", _run_sql(_METRICS_SQL.format(raised=" WHERE source <> 'BEEHIVE'", did="stage <> 'versions'").replace(
    "true AS success FROM got", "source <> 'BEEHIVE' AS success FROM got", 1), releases=False))
def q_run_failures(spark, sf):
    return _metrics(_failing_run(spark, sf))


@register("run_summary", _run_sql("""
SELECT CAST((SELECT sum(n) FROM got) AS BIGINT) AS total_scraped, CAST((SELECT sum(n) FROM ok) AS BIGINT) AS total_processed,
  0.75 AS scraping_success_rate, CAST(2 AS DOUBLE) / 3 AS processing_success_rate, CAST(2 AS BIGINT) AS errors""", releases=False))
def q_run_summary(spark, sf):
    store = runs.RunStore(spark, scratch_path(spark, "run-store"))
    store.write(_failing_run(spark, sf))
    return runs.summary(store.read("metrics"), store.read("messages")).drop("elapsed", "warnings")


# ------------------------------------------------------------------ cascade
@register("cascade_sources", ORACLES["first_nonempty"])
def q_cascade_sources(spark, sf):
    """O.12 by readers: the rows of ``first_nonempty``, without reading the tiers behind the first that has rows."""
    events = _tiered_events(spark, sf)
    reader = lambda s, t: lambda: events.where((F.col("source_system") == s) & (F.col("tier") == t)).select("event_id")
    return comb.cascade_sources({s: [reader(s, t) for t in (1, 2, 3, 4)] for s in rules.SOURCES}).select(
        "source_system", "event_id", "tier")


#: The main feeds have two items less than the limit, as many and none.
_GATES = {"short": 10, "full": 8, "empty": 10}


def _gate_items(spark, sf, name: str):
    r = rawmod.raw_items(spark, sf).where("source_system = 'BEEHIVE' AND title <> '' AND url <> ''").select("seq", "url")
    main = r.where("false") if name == "empty" else r.where(F.col("seq") <= 4 * 8 + 3).orderBy("seq").limit(8)
    return main.withColumn("feed", F.lit("main")), r.where(F.col("seq") % 3 == 0).withColumn("feed", F.lit("person"))


@register("person_feed_gate", f"""WITH r AS ({_RAW}), i AS (SELECT seq, url FROM r WHERE source_system = 'BEEHIVE' AND title <> '' AND url <> ''),
m AS (SELECT * FROM i WHERE seq <= 35 ORDER BY seq LIMIT 8)
SELECT 'short' AS gate, 'main' AS feed, seq, url FROM m UNION ALL SELECT 'full', 'main', seq, url FROM m
UNION ALL SELECT g, 'person', seq, url FROM i, (SELECT unnest(['short', 'empty']) AS g) WHERE seq % 3 = 0""")
def q_person_feed_gate(spark, sf):
    """O.3: person feeds are read where the main feeds have fewer rows than the limit."""
    parts = []
    for name, limit in _GATES.items():
        main, person = _gate_items(spark, sf, name)
        found = comb.cascade([lambda m=main: m, lambda p=person: p], least=limit, add=True)
        parts.append(found.rows.select(F.lit(name).alias("gate"), "feed", "seq", "url"))
    return reduce(DataFrame.unionByName, parts)
