"""Registered queries: one Spark plan and (where SQL can express it) one
DuckDB oracle per inventory operator.  ``__spark_entry__`` only wires this.

Every query reads the driver tables (or data Spark derives from them) in
full.  Ordering operators emit their position as a column, because the
correctness comparison is order-insensitive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actlens import adapter
from actlens.operators import labels as lab
from actlens.operators import search as srch
from actlens.plans import oracle as o

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions with labels assigned (keyword sets + business rules)."""
    return lab.assign_labels(adapter.actions(spark, sf_dir))


def _labels_str(c: str = "labels"):
    return F.array_join(c, "|").alias(c)


# ----------------------------------------------------------------- labelling
@register("label_text", o.with_labelled("SELECT seq, label_text FROM lt"))
def q_label_text(spark, sf):
    return lab.label_text(adapter.actions(spark, sf)).select("seq", "label_text")


@register("keyword_labels", o.with_labelled(
    "SELECT seq, array_to_string(list_sort(list_filter(["
    + ", ".join(f"CASE WHEN {o._slug(x)} THEN {o.q(x)} END" for x in lab.rules.LABEL_KEYWORDS)
    + "], lambda x: x IS NOT NULL)), '|') AS labels FROM ltk"))
def q_keyword_labels(spark, sf):
    return lab.keyword_labels(adapter.actions(spark, sf)).select("seq", _labels_str())


@register("label_rules", o.with_labelled("SELECT seq, id, array_to_string(labels, '|') AS labels FROM lab"))
def q_label_rules(spark, sf):
    return labelled(spark, sf).select("seq", "id", _labels_str())


_COUNTS_SQL = """, lc AS (SELECT l AS label, count(*) AS n FROM (SELECT unnest(labels) AS l FROM lab) GROUP BY l),
dim AS (SELECT unnest([{labels}]) AS label)
SELECT dim.label, CAST(coalesce(lc.n, 0) AS BIGINT) AS n FROM dim LEFT JOIN lc ON dim.label = lc.label"""


@register("label_counts", o.with_labelled(_COUNTS_SQL.format(labels=", ".join(o.q(x) for x in lab.rules.LABELS))))
def q_label_counts(spark, sf):
    return lab.label_counts(labelled(spark, sf), keep_zero=True)


@register("label_counts_nonzero", o.with_labelled(
    _COUNTS_SQL.format(labels=", ".join(o.q(x) for x in lab.rules.LABELS)) + " WHERE coalesce(lc.n, 0) > 0"))
def q_label_counts_nonzero(spark, sf):
    return lab.label_counts(labelled(spark, sf), keep_zero=False)


# ------------------------------------------------------- filters and search
@register("filter_source", o.with_actions("SELECT seq, id FROM a WHERE source_system = 'GAZETTE'"))
def q_filter_source(spark, sf):
    return srch.filter_source(adapter.actions(spark, sf), "GAZETTE").select("seq", "id")


@register("filter_labels", o.with_labelled(
    "SELECT seq, array_to_string(labels, '|') AS labels FROM lab "
    "WHERE list_has_any(labels, ['Health', 'Education'])"))
def q_filter_labels(spark, sf):
    return srch.filter_labels(labelled(spark, sf), ["Health", "Education"]).select("seq", _labels_str())


_DATE_KEY = "CASE WHEN regexp_matches(date, '^\\d{4}-\\d{2}-\\d{2}$') THEN try_strptime(date, '%Y-%m-%d') END"


@register("sort_by_date", o.with_actions(
    f"SELECT seq, date, CAST(row_number() OVER (ORDER BY {_DATE_KEY} DESC NULLS LAST, seq) AS BIGINT) AS pos FROM a"))
def q_sort_by_date(spark, sf):
    return srch.sort_by_date(adapter.actions(spark, sf), "newest").select("seq", "date", "pos")


@register("sort_by_date_oldest", o.with_actions(
    f"SELECT seq, date, CAST(row_number() OVER (ORDER BY {_DATE_KEY} ASC NULLS LAST, seq) AS BIGINT) AS pos FROM a"))
def q_sort_by_date_oldest(spark, sf):
    return srch.sort_by_date(adapter.actions(spark, sf), "oldest").select("seq", "date", "pos")


def _js_trim_sql(expr: str) -> str:
    ws = r"[\t\n\x0B\f\r\p{Z}\x{FEFF}]"
    return f"regexp_replace({expr}, '^{ws}+|{ws}+$', '', 'g')"


def _field_match(expr: str, needle: str, case_sensitive=False, exact=False, numeric=False) -> str:
    v = f"CAST({expr} AS VARCHAR)"
    norm = _js_trim_sql(v)
    if not case_sensitive:
        norm = f"lower({norm})"
        needle = needle.lower()
    hit = f"{norm} = {o.q(needle)}" if exact else f"contains({norm}, {o.q(needle)})"
    truthy = f"{expr} <> 0" if numeric else f"{v} <> ''"
    return f"coalesce({truthy} AND {hit}, false)"


def _search_sql(needle: str, case_sensitive=False, exact=False, metadata=True, stages=True) -> str:
    kw = dict(case_sensitive=case_sensitive, exact=exact)
    parts = [_field_match(c, needle, **kw) for c in ["title", "summary", "primary_entity", "url", "id"]]
    parts.append(f"coalesce(list_bool_or(list_transform(labels, lambda x: {_field_match('x', needle, **kw)})), false)")
    if metadata:
        for c in ["bill_number", "act_number", "notice_number", "notice_type", "document_type", "portfolio"]:
            parts.append(_field_match(c, needle, **kw))
        parts.append(_field_match("parliament_number", needle, numeric=True, **kw))
        parts.append(_field_match("commencement_date", needle, **kw))
        if stages:
            for c in ["stage1", "stage1_date", "stage2", "stage2_date"]:
                parts.append(_field_match(c, needle, **kw))
    return "(" + " OR ".join(parts) + ")"


# stage entries exist only on PARLIAMENT rows with a non-null stage name
_STAGE_NULLING = (
    "SELECT * EXCLUDE (stage1, stage1_date, stage2, stage2_date), "
    "CASE WHEN source_system = 'PARLIAMENT' AND stage1 IS NOT NULL THEN stage1 END AS stage1, "
    "CASE WHEN source_system = 'PARLIAMENT' AND stage1 IS NOT NULL THEN stage1_date END AS stage1_date, "
    "CASE WHEN source_system = 'PARLIAMENT' AND stage2 IS NOT NULL THEN stage2 END AS stage2, "
    "CASE WHEN source_system = 'PARLIAMENT' AND stage2 IS NOT NULL THEN stage2_date END AS stage2_date FROM lab"
)


def _search_oracle(needle: str, **kw) -> str:
    return o.with_labelled(
        f", s AS ({_STAGE_NULLING}) SELECT seq, id FROM s WHERE {_search_sql(needle, **kw)}"
    )


_SEARCH_CASES = {
    # name: (needle, config)
    "search": ("housing", {}),
    "search_metadata": ("2024 No 1", {}),
    "search_stage_history": ("select committee", {}),
    "search_case_sensitive": ("HOUSING", {"case_sensitive": True}),
    "search_exact": ("Health", {"exact": True}),
    "search_no_metadata": ("2024-go", {"metadata": False}),
    "search_no_stages": ("First Reading", {"stages": False}),
    "search_number": ("54", {}),
    "search_unicode": ("Māori", {}),
}


def _make_search(needle: str, kw: dict):
    cfg = srch.SearchConfig(
        case_sensitive=kw.get("case_sensitive", False), exact_match=kw.get("exact", False),
        search_metadata=kw.get("metadata", True), search_stage_history=kw.get("stages", True),
    )

    def run(spark, sf):
        return srch.search(labelled(spark, sf), needle, cfg).select("seq", "id")
    return run


for _name, (_needle, _kw) in _SEARCH_CASES.items():
    register(_name, _search_oracle(_needle, **_kw))(_make_search(_needle, _kw))


@register("query", o.with_labelled(
    f", s AS ({_STAGE_NULLING}) SELECT seq, id, "
    f"CAST(row_number() OVER (ORDER BY {_DATE_KEY} DESC NULLS LAST, seq) AS BIGINT) AS pos FROM s "
    f"WHERE source_system = 'PARLIAMENT' AND {_search_sql('housing')} AND list_has_any(labels, ['Housing'])"))
def q_query(spark, sf):
    return srch.query(labelled(spark, sf), "housing", "PARLIAMENT", ["Housing"], "newest",
                      columns=["id"]).select("seq", "id", "pos")


@register("query_oldest_two_labels", o.with_labelled(
    f"SELECT seq, id, CAST(row_number() OVER (ORDER BY {_DATE_KEY} ASC NULLS LAST, seq) AS BIGINT) AS pos "
    f"FROM lab WHERE list_has_any(labels, ['Health', 'Tax'])"))
def q_query_oldest(spark, sf):
    return srch.query(labelled(spark, sf), "", "ALL", ["Health", "Tax"], "oldest", columns=["id"]).select("seq", "id", "pos")


@register("query_bad_params", o.with_labelled(
    f"SELECT seq, CAST(row_number() OVER (ORDER BY {_DATE_KEY} DESC NULLS LAST, seq) AS BIGINT) AS pos FROM lab"))
def q_query_bad(spark, sf):
    return srch.query(labelled(spark, sf), None, "NOWHERE", "Health", "sideways", columns=[]).select("seq", "pos")


@register("feed_view", o.with_labelled(
    f"SELECT seq, id, CAST(row_number() OVER (ORDER BY {_DATE_KEY} DESC NULLS LAST, seq) AS BIGINT) AS pos "
    f"FROM lab WHERE source_system = 'GAZETTE' AND list_has_any(labels, ['Justice'])"))
def q_feed_view(spark, sf):
    return srch.feed_view(labelled(spark, sf), "GAZETTE", "Justice", columns=["id"]).select("seq", "id", "pos")


# ------------------------------------------------------------------ shared
import datetime as _dt  # noqa: E402

from actlens.functions.dates import normalise_date  # noqa: E402
from actlens.operators import display as disp  # noqa: E402
from actlens.operators import snapshot as snap  # noqa: E402
from actlens.operators import stats as st  # noqa: E402
from actlens.operators import validate as val  # noqa: E402
from actlens.operators import versions as ver  # noqa: E402

RUN_TS = _dt.datetime(2025, 12, 16, 9, 30, 0)
RUN_DATE = RUN_TS.strftime("%Y-%m-%d")

_WS = o.WS
_VALIDATOR_FORMATS = ["%Y-%m-%d", "%d/%m/%Y", "%d-%m-%Y", "%Y/%m/%d", "%d %B %Y", "%d %b %Y", "%B %d, %Y"]


def _duck_parse(expr: str, formats: list[str]) -> str:
    s = o.ustrip(expr)
    return "coalesce(" + ", ".join(f"try_strptime({s}, {o.q(f)})" for f in formats) + ")"


def _duck_collapse(expr: str) -> str:
    return f"regexp_replace({o.ustrip(expr)}, '{_WS}+', ' ', 'g')"


_PREDEF = "[" + ", ".join(o.q(x) for x in lab.rules.LABELS) + "]"

_VALIDATE_CTE = f""", v0 AS (
  SELECT a.*,
    CASE WHEN labels_in IS NULL THEN []::VARCHAR[] ELSE list_filter(string_split(labels_in, '|'), lambda s: s <> '') END AS labels0,
    strftime({_duck_parse('date', _VALIDATOR_FORMATS)}, '%Y-%m-%d') AS parsed_date,
    lower(regexp_replace(id, '[^a-zA-Z0-9-]', '', 'g')) AS cleaned_id,
    {o.ustrip('url')} AS u
  FROM a
), v1 AS (
  SELECT v0.*,
    CASE WHEN url IS NULL OR url = '' THEN url
         WHEN starts_with(u, 'http://') OR starts_with(u, 'https://') THEN u
         WHEN starts_with(u, 'www.') THEN 'https://' || u
         WHEN contains(u, '.') AND NOT starts_with(u, '/') THEN 'https://' || u ELSE u END AS new_url,
    CASE WHEN id IS NULL OR id = '' THEN NULL
         WHEN regexp_matches(id, '^[a-z]{{3,8}}-\\d{{4}}-\\d{{3,6}}$') THEN id
         WHEN regexp_matches(cleaned_id, '^[a-z]{{3,8}}-\\d{{4}}-\\d{{3,6}}$') THEN cleaned_id ELSE id END AS new_id,
    CASE WHEN date IS NULL OR date = '' THEN '{RUN_DATE}' WHEN parsed_date IS NOT NULL THEN parsed_date
         WHEN regexp_matches({o.ustrip('date')}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN {o.ustrip('date')}
         ELSE '{RUN_DATE}' END AS new_date,
    regexp_replace({_duck_collapse('title')}, '(?i)^(?:New Zealand |NZ |Government |Official )+', '') AS new_title,
    CASE WHEN length({_duck_collapse('summary')}) > 1000 THEN substring({_duck_collapse('summary')}, 1, 997) || '...'
         ELSE {_duck_collapse('summary')} END AS new_summary,
    list_sort(list_distinct(list_filter(labels0, lambda x: list_contains({_PREDEF}, x)))) AS new_labels
  FROM v0
), v AS (
  SELECT v1.*,
    CASE WHEN primary_entity IS NOT NULL AND primary_entity <> '' THEN primary_entity
         WHEN portfolio = 'Finance' THEN 'Hon Nicola Willis' WHEN portfolio = 'Health' THEN 'Hon Dr Shane Reti'
         WHEN source_system = 'GAZETTE' AND contains(lower(new_title), 'appointment') THEN 'Governor-General'
         WHEN source_system IN ('PARLIAMENT', 'LEGISLATION') THEN 'Parliament' ELSE 'Government' END AS new_entity,
    list_concat(
      list_filter([
        CASE WHEN NOT regexp_matches(id, '^[a-z]{{3,8}}-\\d{{4}}-\\d{{3,6}}$')
              AND NOT regexp_matches(cleaned_id, '^[a-z]{{3,8}}-\\d{{4}}-\\d{{3,6}}$')
             THEN 'Item ' || seq || ': Invalid ID format ''' || id || '''' END,
        CASE WHEN parsed_date IS NULL AND NOT regexp_matches({o.ustrip('date')}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$')
             THEN 'Item ' || seq || ': Invalid date format ''' || date || '''' END
      ], lambda x: x IS NOT NULL),
      list_transform(list_filter(labels0, lambda x: NOT list_contains({_PREDEF}, x)),
                     lambda x: 'Item ' || seq || ': Unknown label ''' || x || '''')) AS errors
  FROM v1
)"""


def validated(spark, sf):
    return val.validate(adapter.actions(spark, sf), RUN_TS)


@register("validate", o.with_actions(_VALIDATE_CTE + """
SELECT seq, new_id AS id, new_date AS date, new_url AS url, new_title AS title, new_entity AS primary_entity,
       new_summary AS summary, array_to_string(new_labels, '|') AS labels,
       array_to_string(errors, '|') AS errors,
       (new_id <> id OR new_date <> date OR new_url <> url OR new_title <> title OR primary_entity IS NULL
        OR primary_entity = '' OR new_summary <> summary OR (len(labels0) > 0 AND new_labels <> labels0)) AS fixed
FROM v"""))
def q_validate(spark, sf):
    return validated(spark, sf).select(
        "seq", "id", "date", "url", "title", "primary_entity", "summary", _labels_str(),
        F.array_join("_errors", "|").alias("errors"), F.col("_fixed").alias("fixed"))


@register("validate_strict", o.with_actions(_VALIDATE_CTE + " SELECT seq, new_id AS id FROM v WHERE len(errors) = 0"))
def q_validate_strict(spark, sf):
    return val.validate(adapter.actions(spark, sf), RUN_TS, strict=True).select("seq", "id")


@register("validation_summary", o.with_actions(_VALIDATE_CTE + """
SELECT CAST(sum(len(errors)) AS BIGINT) AS row_errors,
       CAST(sum(CASE WHEN new_id <> id OR new_date <> date OR new_url <> url OR new_title <> title
                OR primary_entity IS NULL OR primary_entity = '' OR new_summary <> summary
                OR (len(labels0) > 0 AND new_labels <> labels0) THEN 1 ELSE 0 END) AS BIGINT) AS items_fixed,
       CAST(0 AS BIGINT) AS total_errors, CAST(count(*) AS BIGINT) AS rows FROM v"""))
def q_validation_summary(spark, sf):
    return val.validation_summary(validated(spark, sf))


@register("normalise_date", o.with_actions(
    f"SELECT seq, date AS raw, strftime({_duck_parse('date', _VALIDATOR_FORMATS)}, '%Y-%m-%d') AS iso FROM a"))
def q_normalise_date(spark, sf):
    return adapter.actions(spark, sf).select("seq", F.col("date").alias("raw"),
                                             normalise_date(F.col("date"), "validator").alias("iso"))


_SCHEMA_OK = (
    "regexp_matches(new_id, '^[a-z]{3,8}-\\d{4}-\\d{3,6}(?:-v\\d+)?$') "
    "AND regexp_matches(new_date, '^\\d{4}-(?:1[0-2]|0[1-9]|[1-9])-(?:3[01]|[12]\\d|0[1-9]|[1-9])$') "
    "AND try_strptime(new_date, '%Y-%m-%d') IS NOT NULL"
)


@register("schema_check", o.with_actions(_VALIDATE_CTE + f" SELECT seq, new_id AS id FROM v WHERE {_SCHEMA_OK}"))
def q_schema_check(spark, sf):
    return val.schema_check(validated(spark, sf)).select("seq", "id")


# ------------------------------------------------------------------ versions
_BASE = ("CASE WHEN base_id IS NOT NULL AND base_id <> '' THEN base_id "
         "WHEN contains(id, '-v') THEN regexp_replace(id, '^(.*)-v.*$', '\\1') ELSE id END")
_VNUM = ("coalesce(TRY_CAST(CASE WHEN regexp_matches(regexp_replace(coalesce(nullif(version, ''), '1'), '^v', ''), "
         "'^\\s*[+-]?\\d+\\s*$') THEN trim(regexp_replace(coalesce(nullif(version, ''), '1'), '^v', '')) END AS INTEGER), 1)")


@register("fill_base_id", o.with_actions(f"SELECT seq, {_BASE} AS base_id FROM a"))
def q_fill_base_id(spark, sf):
    return ver.fill_base_id(adapter.actions(spark, sf)).select("seq", "base_id")


@register("version_number", o.with_actions(f"SELECT seq, version, {_VNUM} AS version_num FROM a"))
def q_version_number(spark, sf):
    return adapter.actions(spark, sf).select("seq", "version", ver.version_number(F.col("version")).alias("version_num"))


@register("group_versions", o.with_actions(f"""
, g AS (SELECT seq, {_BASE} AS base_id, {_VNUM} AS version_num FROM a),
f AS (SELECT base_id, min(seq) AS group_seq FROM g GROUP BY base_id)
SELECT g.seq, g.base_id, g.version_num,
       CAST(row_number() OVER (ORDER BY f.group_seq, g.version_num DESC, g.seq) AS BIGINT) AS pos
FROM g JOIN f USING (base_id)"""))
def q_group_versions(spark, sf):
    return ver.group_versions(adapter.actions(spark, sf)).select("seq", "base_id", "version_num", "pos")


@register("version_stats", o.with_actions(f"""
, s AS (SELECT {_BASE} AS base_id, count(*) AS n FROM a GROUP BY 1)
SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS total_processed,
       CAST(coalesce(sum(CASE WHEN n > 1 THEN n - 1 END), 0) AS BIGINT) AS duplicates_found,
       CAST(coalesce(sum(CASE WHEN n > 1 THEN n END), 0) AS BIGINT) AS versions_preserved,
       CAST(count(CASE WHEN n > 1 THEN 1 END) AS BIGINT) AS base_actions FROM s"""))
def q_version_stats(spark, sf):
    return ver.version_stats(adapter.actions(spark, sf))


@register("latest_version", o.with_actions(f"""
, g AS (SELECT seq, {_BASE} AS base_id, {_VNUM} AS version_num FROM a)
SELECT base_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY base_id ORDER BY version_num DESC, seq) AS rn FROM g)
WHERE rn = 1"""))
def q_latest_version(spark, sf):
    return ver.latest_version(adapter.actions(spark, sf)).select("base_id", "seq")


@register("drop_same_url", o.with_actions(
    "SELECT url, min(seq) AS seq FROM a GROUP BY url"))
def q_drop_same_url(spark, sf):
    return ver.drop_same_url(adapter.actions(spark, sf)).select("url", "seq")


# bills x stages: every PARLIAMENT action's stage entries
_BILL_STAGES = """, bs AS (
  SELECT seq, bill_number, stage1 AS stage FROM a WHERE source_system = 'PARLIAMENT' AND stage1 IS NOT NULL
  UNION ALL
  SELECT seq, bill_number, stage2 AS stage FROM a WHERE source_system = 'PARLIAMENT' AND stage2 IS NOT NULL)"""


def _bill_stages(spark, sf):
    acts = adapter.actions(spark, sf).filter(F.col("source_system") == "PARLIAMENT")
    return acts.select("seq", F.col("metadata.bill_number").alias("bill_number"),
                       F.explode("metadata.stage_history").alias("s")).select("seq", "bill_number", "s.stage")


@register("latest_bill_per_stage", o.with_actions(_BILL_STAGES + """
SELECT split_part(bill_number, '-', 1) AS bill_base, stage, bill_number, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY split_part(bill_number, '-', 1), stage ORDER BY bill_number DESC, seq) AS rn
  FROM bs) WHERE rn = 1"""))
def q_latest_bill_per_stage(spark, sf):
    return ver.latest_bill_per_stage(_bill_stages(spark, sf)).select("bill_base", "stage", "bill_number", "seq")


_STAGE_CODES = ["1", "2", "SC", "COWH", "3", "RA", "X"]


@register("stage_name", """
SELECT conv_id, turn, code, CASE code WHEN '1' THEN 'First Reading' WHEN '2' THEN 'Second Reading'
  WHEN 'SC' THEN 'Select Committee' WHEN 'COWH' THEN 'Committee of Whole House' WHEN '3' THEN 'Third Reading'
  WHEN 'RA' THEN 'Royal Assent' ELSE code END AS stage
FROM (SELECT conv_id, turn, CASE turn % 7 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN 'SC' WHEN 3 THEN 'COWH'
  WHEN 4 THEN '3' WHEN 5 THEN 'RA' ELSE 'X' END AS code FROM conversations)""")
def q_stage_name(spark, sf):
    from actlens.session import table
    conv = table(spark, sf, "conversations")
    code = F.element_at(F.array(*[F.lit(c) for c in _STAGE_CODES]), (F.col("turn") % 7 + 1).cast("int"))
    return conv.select("conv_id", "turn", code.alias("code")).withColumn("stage", ver.stage_name(F.col("code")))


# ------------------------------------------------------------ stats / export
@register("source_counts", o.with_actions("SELECT source_system, CAST(count(*) AS BIGINT) AS n FROM a GROUP BY 1"))
def q_source_counts(spark, sf):
    return st.source_counts(adapter.actions(spark, sf))


@register("available_sources", o.with_actions(
    "SELECT s.source_system, CAST(count(a.seq) AS BIGINT) AS n FROM "
    "(SELECT unnest(['PARLIAMENT', 'LEGISLATION', 'GAZETTE', 'BEEHIVE']) AS source_system) s "
    "LEFT JOIN a ON a.source_system = s.source_system GROUP BY 1"))
def q_available_sources(spark, sf):
    return st.available_sources(adapter.actions(spark, sf))


@register("source_view", o.with_actions(
    "SELECT seq FROM a WHERE source_system = 'BEEHIVE' OR NOT EXISTS (SELECT 1 FROM a WHERE source_system = 'BEEHIVE')"))
def q_source_view(spark, sf):
    return srch.source_view(adapter.actions(spark, sf), "BEEHIVE").select("seq")


@register("source_view_fallback", o.with_actions(
    "SELECT seq FROM a WHERE source_system = 'UNKNOWN' OR NOT EXISTS (SELECT 1 FROM a WHERE source_system = 'UNKNOWN')"))
def q_source_view_fallback(spark, sf):
    return srch.source_view(adapter.actions(spark, sf), "UNKNOWN").select("seq")


@register("date_range", o.with_actions(_VALIDATE_CTE + """
SELECT coalesce(min(nullif(new_date, '')), '') AS earliest, coalesce(max(nullif(new_date, '')), '') AS latest FROM v"""))
def q_date_range(spark, sf):
    return st.date_range(validated(spark, sf))


@register("export_table", o.with_actions(_VALIDATE_CTE + """
SELECT seq, new_id AS id, new_date AS date, array_to_string(new_labels, '|') AS labels,
       CAST(row_number() OVER (ORDER BY new_date DESC, new_title DESC, seq) AS BIGINT) AS pos FROM v"""))
def q_export_table(spark, sf):
    from actlens.session import materialize
    return st.export_table(materialize(validated(spark, sf), "validated")).select("seq", "id", "date", _labels_str(), "pos")


@register("export_audit", o.with_actions("""
, i AS (SELECT id, count(*) AS n FROM a GROUP BY id), u AS (SELECT url, count(*) AS n FROM a GROUP BY url),
m AS (SELECT count(*) AS total_actions,
             count(CASE WHEN id IS NULL OR id = '' THEN 1 END) AS missing_id,
             count(CASE WHEN title IS NULL OR title = '' THEN 1 END) AS missing_title,
             count(CASE WHEN url IS NULL OR url = '' THEN 1 END) AS missing_url FROM a),
ii AS (SELECT count(*) AS unique_ids, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_ids FROM i),
uu AS (SELECT count(*) AS unique_urls, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_urls FROM u)
SELECT CAST(total_actions AS BIGINT) AS total_actions, CAST(unique_ids AS BIGINT) AS unique_ids,
       CAST(unique_urls AS BIGINT) AS unique_urls, CAST(missing_id AS BIGINT) AS missing_id,
       CAST(missing_title AS BIGINT) AS missing_title, CAST(missing_url AS BIGINT) AS missing_url,
       duplicate_ids, duplicate_urls,
       CAST(missing_id + missing_title + missing_url + duplicate_ids AS BIGINT) AS n_errors,
       duplicate_urls AS n_warnings, (missing_id + missing_title + missing_url + duplicate_ids) = 0 AS valid
FROM m, ii, uu"""))
def q_export_audit(spark, sf):
    return st.export_audit(adapter.actions(spark, sf))


@register("audit_flags", o.with_actions("""
SELECT seq, seq > min(seq) OVER (PARTITION BY id) AS dup_id, seq > min(seq) OVER (PARTITION BY url) AS dup_url FROM a"""))
def q_audit_flags(spark, sf):
    return st.audit_flags(adapter.actions(spark, sf)).select("seq", "dup_id", "dup_url")


@register("export_summary", o.with_labelled(f"""
SELECT '{RUN_TS.isoformat()}' AS last_updated, CAST(count(*) AS BIGINT) AS total_count,
  CAST(count(CASE WHEN source_system = 'PARLIAMENT' THEN 1 END) AS BIGINT) AS n_parliament,
  CAST(count(CASE WHEN source_system = 'LEGISLATION' THEN 1 END) AS BIGINT) AS n_legislation,
  CAST(count(CASE WHEN source_system = 'GAZETTE' THEN 1 END) AS BIGINT) AS n_gazette,
  CAST(count(CASE WHEN source_system = 'BEEHIVE' THEN 1 END) AS BIGINT) AS n_beehive,
  CAST(sum(len(labels)) AS BIGINT) AS n_labels,
  coalesce(min(nullif(date, '')), '') AS earliest, coalesce(max(nullif(date, '')), '') AS latest,
  'actlens' AS generated_by, '1.0' AS version FROM lab"""))
def q_export_summary(spark, sf):
    s = st.export_summary(labelled(spark, sf), RUN_TS)
    sc = lambda k: F.coalesce(F.col("source_counts")[k], F.lit(0)).cast("long")
    return s.select(
        "last_updated", "total_count",
        sc("PARLIAMENT").alias("n_parliament"), sc("LEGISLATION").alias("n_legislation"),
        sc("GAZETTE").alias("n_gazette"), sc("BEEHIVE").alias("n_beehive"),
        F.aggregate(F.map_values("label_counts"), F.lit(0).cast("long"), lambda acc, x: acc + x).alias("n_labels"),
        "earliest", "latest", "generated_by", "version")


# ---------------------------------------------------------------- snapshots
# old snapshot: doc_id % 10 <> 0; new: doc_id % 10 <> 1, titles changed where doc_id % 10 = 2
def _snapshots(spark, sf):
    acts = adapter.actions(spark, sf)
    old = acts.filter(F.col("seq") % 10 != 0)
    new = acts.filter(F.col("seq") % 10 != 1).withColumn(
        "title", F.when(F.col("seq") % 10 == 2, F.concat(F.col("title"), F.lit(" (amended)"))).otherwise(F.col("title")))
    return old, new


@register("snapshot_diff", o.with_actions("""
SELECT id, CASE WHEN seq % 10 = 0 THEN 'added' WHEN seq % 10 = 1 THEN 'removed' ELSE 'changed' END AS status,
       CAST(CASE WHEN seq % 10 = 0 THEN 0 ELSE 1 END AS BIGINT) AS n_old,
       CAST(CASE WHEN seq % 10 = 1 THEN 0 ELSE 1 END AS BIGINT) AS n_new
FROM a WHERE seq % 10 IN (0, 1, 2)"""))
def q_snapshot_diff(spark, sf):
    old, new = _snapshots(spark, sf)
    return snap.snapshot_diff(old, new)


@register("last_change", o.with_actions("""
SELECT id, max(run_ts) AS last_changed FROM (
  SELECT id, TIMESTAMP '2025-12-15 00:00:00' AS run_ts FROM a WHERE seq % 10 IN (0, 1, 2)
  UNION ALL
  SELECT id, TIMESTAMP '2025-12-16 00:00:00' AS run_ts FROM a WHERE seq % 10 = 3) GROUP BY id"""))
def q_last_change(spark, sf):
    old, new = _snapshots(spark, sf)
    newer = new.withColumn("title", F.when(F.col("seq") % 10 == 3, F.concat(F.col("title"), F.lit(" (2)")))
                           .otherwise(F.col("title")))
    d1 = snap.snapshot_diff(old, new).withColumn("run_ts", F.lit(_dt.datetime(2025, 12, 15)))
    d2 = snap.snapshot_diff(new, newer).withColumn("run_ts", F.lit(_dt.datetime(2025, 12, 16)))
    return snap.last_change(d1.unionByName(d2))


# ------------------------------------------------------------------ display
def _first_sentence_sql(expr: str, n: int = 200) -> str:
    clean = f"regexp_replace(regexp_replace(regexp_replace({expr}, '<[^>]+>', ' ', 'g'), '^{_WS}+|{_WS}+$', '', 'g'), '{_WS}+', ' ', 'g')"
    first = o.ustrip(f"regexp_extract({clean}, '^([^.!?]*)', 1)")
    cut = f"CASE WHEN length({first}) > {n} THEN substring({first}, 1, {n - 3}) || '...' ELSE {first} END"
    return (f"CASE WHEN {expr} IS NULL OR {expr} = '' THEN '[No content]' WHEN {clean} = '' THEN '[No readable content]' "
            f"WHEN ({cut}) = '' THEN '[Empty content]' ELSE {cut} END")


@register("first_sentence", f"SELECT page_id, {_first_sentence_sql('html')} AS first_sentence FROM pages")
def q_first_sentence(spark, sf):
    from actlens.session import table
    return table(spark, sf, "pages").select("page_id", disp.first_sentence(F.col("html")).alias("first_sentence"))


@register("audit_lines", o.with_actions(f"""
SELECT seq, title, {_first_sentence_sql('summary')} AS first_sentence, date,
       substring(url, 1, 80) || CASE WHEN length(url) > 80 THEN '...' ELSE '' END AS url,
       CAST(row_number() OVER (ORDER BY seq) AS BIGINT) AS item_number FROM a"""))
def q_audit_lines(spark, sf):
    return disp.audit_lines(adapter.actions(spark, sf))


@register("card_view", o.with_actions("""
SELECT seq, CASE source_system WHEN 'PARLIAMENT' THEN 'Parliament' WHEN 'LEGISLATION' THEN 'Legislation'
         WHEN 'GAZETTE' THEN 'Gazette' WHEN 'BEEHIVE' THEN 'Beehive' END AS source_label,
  coalesce(CAST(day(try_strptime(date, '%Y-%m-%d')) AS VARCHAR) || ' ' || strftime(try_strptime(date, '%Y-%m-%d'), '%B %Y'),
           'Invalid Date') AS date_text,
  CASE WHEN document_type IS NOT NULL AND document_type <> '' THEN document_type ||
       CASE WHEN portfolio IS NOT NULL AND portfolio <> '' THEN ' · ' || portfolio ELSE '' END END AS document_line,
  CASE WHEN act_number <> '' THEN act_number END AS act_line,
  CASE WHEN bill_number IS NOT NULL AND bill_number <> '' AND source_system = 'PARLIAMENT'
       THEN 'Bill ' || bill_number || ' · Latest: ' || coalesce(CASE WHEN stage2 IS NOT NULL THEN stage2 ELSE stage1 END, '') END AS bill_line
FROM a"""))
def q_card_view(spark, sf):
    return disp.card_view(adapter.actions(spark, sf))


# ------------------------------------------------------- greedy de-duplication
from actlens.operators import dedupe as dd  # noqa: E402

# The sequential scan replayed by a recursive CTE (one step per row).
_GREEDY_SQL = o.with_actions("""
, r0 AS (SELECT CAST(row_number() OVER (ORDER BY seq) AS BIGINT) AS i, seq, coalesce(url, '') AS ku,
                coalesce(title, 'None') || '_' || coalesce(date, 'None') AS kt FROM a),
scan AS (
  WITH RECURSIVE s(i, urls, tds, kept) AS (
    SELECT CAST(0 AS BIGINT), []::VARCHAR[], []::VARCHAR[], []::BIGINT[]
    UNION ALL
    SELECT s.i + 1,
      CASE WHEN NOT list_contains(s.urls, r0.ku) AND NOT list_contains(s.tds, r0.kt) THEN list_append(s.urls, r0.ku) ELSE s.urls END,
      CASE WHEN NOT list_contains(s.urls, r0.ku) AND NOT list_contains(s.tds, r0.kt) THEN list_append(s.tds, r0.kt) ELSE s.tds END,
      CASE WHEN NOT list_contains(s.urls, r0.ku) AND NOT list_contains(s.tds, r0.kt) THEN list_append(s.kept, r0.seq) ELSE s.kept END
    FROM s JOIN r0 ON r0.i = s.i + 1)
  SELECT kept FROM s ORDER BY i DESC LIMIT 1)
SELECT a.seq, a.url, a.title, a.date FROM a WHERE list_contains((SELECT kept FROM scan), a.seq)""")


@register("greedy_dedupe", _GREEDY_SQL)
def q_greedy_dedupe(spark, sf):
    return dd.greedy_dedupe(adapter.actions(spark, sf).select("seq", "url", "title", "date"))


# ----------------------------------------------------------------- builders
from actlens import raw as rawmod  # noqa: E402
from actlens.operators import build as bld  # noqa: E402

_RAW = rawmod.raw_sql("documents")


def _with_raw(select: str) -> str:
    return f"WITH r AS ({_RAW})\n{select}"


def _x(expr: str, pat: str, group: int = 1) -> str:
    """DuckDB: first match group or NULL."""
    return f"CASE WHEN regexp_matches({expr}, {o.q(pat)}) THEN regexp_extract({expr}, {o.q(pat)}, {group}) END"


def _clean_version_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR {x} = '' THEN '1' ELSE coalesce({_x(x, r'(\d+)\.?\d*')}, '1') END"


def _raw(spark, sf):
    return rawmod.raw_items(spark, sf)


_C_VERSION = o.ustrip(_x("content", r"Version:\s*([^<]+)"))


@register("clean_version", _with_raw(
    f"SELECT seq, {_clean_version_sql(_C_VERSION)} AS v_content, {_clean_version_sql('title')} AS v_title FROM r"))
def q_clean_version(spark, sf):
    c = bld.parse_content_fields(F.col("content"))
    return _raw(spark, sf).select("seq", bld.clean_version(c["c_version"]).alias("v_content"),
                                  bld.clean_version(F.col("title")).alias("v_title"))


@register("parse_content_fields", _with_raw(f"""
SELECT seq, {_x('content', r'Year:\s*(\d{4})')} AS c_year, {_x('content', r'No:\s*(\d+)')} AS c_number,
  {_C_VERSION} AS c_version,
  {o.ustrip(_x('content', r'Current as at date:\s*([^<]+)'))} AS c_current_as_at,
  {o.ustrip(_x('content', r'Status:\s*([^<]+)'))} AS c_status,
  {o.ustrip(_x('content', r'Legislation type:\s*([^<]+)'))} AS c_legislation_type FROM r"""))
def q_parse_content_fields(spark, sf):
    return _raw(spark, sf).select("seq", *[c.alias(k) for k, c in bld.parse_content_fields(F.col("content")).items()])


_U_YEAR = f"coalesce({_x('url', r'/act/public/(\d{4})/')}, '{RUN_TS.year}')"
_U_NUMBER = f"coalesce(CAST(CAST({_x('url', r'/act/public/\d{4}/(\d+)/')} AS BIGINT) AS VARCHAR), '')"
_U_VERSION = f"coalesce({_x('url', r'/(\d+)\.0/')}, {_x('url', r'/version/(\d+)')}, '1')"


@register("act_parts_from_url", _with_raw(
    f"SELECT seq, {_U_YEAR} AS u_year, {_U_NUMBER} AS u_number, {_U_VERSION} AS u_version FROM r"))
def q_act_parts_from_url(spark, sf):
    return _raw(spark, sf).select("seq", *[c.alias(k) for k, c in bld.act_parts_from_url(F.col("url"), RUN_TS).items()])


@register("act_entity", _with_raw(
    f"SELECT seq, {o.case_map('lower(title)', lab.rules.ACT_ENTITY, o.q('Parliament'), contains=True)} AS primary_entity FROM r"))
def q_act_entity(spark, sf):
    return _raw(spark, sf).select("seq", bld.act_entity(F.col("title")).alias("primary_entity"))


_ACT_PROFILE = ["%Y-%m-%d", "%d/%m/%Y", "%d-%m-%Y", "%d %B %Y", "%d %b %Y"]
_COMMENCE_PROFILE = ["%d/%m/%Y", "%d-%m-%Y", "%Y-%m-%d", "%d %B %Y", "%d %b %Y"]
_ACT_ITEM_CTE = f""", ai AS (
  SELECT seq, {o.ustrip("coalesce(title, '')")} AS title, url,
    coalesce({_x('content', r'Year:\s*(\d{4})')}, {_U_YEAR}) AS year,
    coalesce({_x('content', r'No:\s*(\d+)')}, {_U_NUMBER}) AS number,
    coalesce({_C_VERSION}, {_U_VERSION}) AS version,
    {o.ustrip(_x('content', r'Current as at date:\s*([^<]+)'))} AS current_as_at,
    {o.case_map("lower(coalesce(title, ''))", lab.rules.ACT_ENTITY, o.q('Parliament'), contains=True)} AS primary_entity,
    coalesce(CASE WHEN contains(published, 'T') THEN strftime(try_strptime(split_part(published, 'T', 1), '%Y-%m-%d'), '%Y-%m-%d')
                  ELSE strftime({_duck_parse('published', _ACT_PROFILE)}, '%Y-%m-%d') END, '{RUN_DATE}') AS date
  FROM r WHERE contains(content, 'Information type: Acts'))"""


@register("parse_act_entry", _with_raw(_ACT_ITEM_CTE + """
SELECT seq, title, url, CASE WHEN year <> '' AND number <> '' THEN year || ' No ' || number ELSE '' END AS act_number,
       year, number, primary_entity, date, version FROM ai"""))
def q_parse_act_entry(spark, sf):
    return bld.parse_act_entry(_raw(spark, sf), RUN_TS).select(
        "seq", "title", "url", "act_number", "year", "number", "primary_entity", "date", "version")


@register("build_act", _with_raw(_ACT_ITEM_CTE + f"""
SELECT seq, 'leg-' || year || '-' || CASE WHEN length(number) < 3 THEN lpad(number, 3, '0') ELSE number END
            || '-v' || {_clean_version_sql('version')} AS id,
       'Version ' || {_clean_version_sql('version')} || ' of ' || title AS summary, date,
       CASE WHEN current_as_at IS NOT NULL AND current_as_at <> ''
            THEN strftime({_duck_parse('current_as_at', _COMMENCE_PROFILE)}, '%Y-%m-%d') END AS commencement_date
FROM ai"""))
def q_build_act(spark, sf):
    acts = bld.build_act(bld.parse_act_entry(_raw(spark, sf), RUN_TS), RUN_TS)
    return acts.select("seq", "id", "summary", "date", F.col("metadata.commencement_date").alias("commencement_date"))


_NOTICE_PATS = [r"/notice/id/(\d{4})-([a-z]{2})(\d+)", r"/notice/(\d{4})-([a-z]{2})(\d+)", r"/(\d{4})-([a-z]{2})(\d+)"]


def _notice_sql() -> tuple[str, str]:
    whens_n = " ".join(f"WHEN regexp_matches(url, {o.q(p)}) THEN regexp_extract(url, {o.q(p)}, 1) || '-' || "
                       f"regexp_extract(url, {o.q(p)}, 2) || regexp_extract(url, {o.q(p)}, 3)" for p in _NOTICE_PATS)
    whens_c = " ".join(f"WHEN regexp_matches(url, {o.q(p)}) THEN regexp_extract(url, {o.q(p)}, 2)" for p in _NOTICE_PATS)
    number = f"CASE {whens_n} ELSE '' END"
    code = f"CASE {whens_c} END"
    ntype = f"coalesce({o.case_map(code, lab.rules.NOTICE_TYPES)}, 'General')"
    return number, ntype


_NN, _NT = _notice_sql()


@register("notice_info", _with_raw(f"SELECT seq, {_NN} AS notice_number, {_NT} AS notice_type FROM r"))
def q_notice_info(spark, sf):
    return _raw(spark, sf).select("seq", *[c.alias(k) for k, c in bld.notice_info(F.col("url")).items()])


_NPORT = o.case_map("lower(coalesce(title, '') || ' ' || coalesce(creator, ''))", lab.rules.NOTICE_PORTFOLIO, "''", contains=True)


@register("notice_portfolio", _with_raw(f"SELECT seq, {_NPORT} AS portfolio FROM r"))
def q_notice_portfolio(spark, sf):
    return _raw(spark, sf).select("seq", bld.notice_portfolio(F.col("title"), F.col("creator")).alias("portfolio"))


_HON = r"Hon\.?\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)"


@register("notice_entity", _with_raw(f"""
SELECT seq, CASE WHEN ({_NT}) = 'Vice Regal' THEN 'Governor-General'
  WHEN regexp_matches(title, {o.q(_HON)}) THEN 'Hon ' || regexp_extract(title, {o.q(_HON)}, 1)
  ELSE {o.case_map('lower(title)', lab.rules.NOTICE_DEPARTMENT, o.q('Government'), contains=True)} END AS primary_entity FROM r"""))
def q_notice_entity(spark, sf):
    info = bld.notice_info(F.col("url"))
    return _raw(spark, sf).select("seq", bld.notice_entity(F.col("title"), info["notice_type"]).alias("primary_entity"))


_NOTICE_PROFILE = ["%Y-%m-%d", "%d/%m/%Y", "%d-%m-%Y", "%d %B %Y", "%d %b %Y", "%B %d, %Y",
                   "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%SZ"]


def _notice_items(spark, sf):
    r = _raw(spark, sf).filter((F.col("source_system") == "GAZETTE") & (F.col("title") != "") & (F.col("url") != ""))
    info = bld.notice_info(F.col("url"))
    return r.select(
        "seq", "title", "url",
        F.coalesce(normalise_date(F.col("published"), "notice"), F.lit(RUN_DATE)).alias("date"),
        F.coalesce(F.when(F.col("creator") != "", F.col("creator")), F.lit("Government")).alias("primary_entity"),
        F.col("body").alias("summary"), info["notice_number"].alias("notice_number"),
        info["notice_type"].alias("notice_type"),
        bld.notice_portfolio(F.col("title"), F.col("creator")).alias("portfolio"))


_CLEAN_PUB = f"regexp_replace({o.ustrip('published')}, '[^\\w\\s,/:T-]', '', 'g')"


@register("build_notice", _with_raw(f"""
, ni AS (SELECT seq, {_NN} AS notice_number,
           coalesce(strftime(coalesce({', '.join(f"try_strptime({_CLEAN_PUB}, {o.q(f)})" for f in _NOTICE_PROFILE)}), '%Y-%m-%d'), '{RUN_DATE}') AS date
         FROM r WHERE source_system = 'GAZETTE' AND title <> '' AND url <> ''),
nd AS (SELECT *, right(regexp_replace(notice_number, '[^0-9]', '', 'g'), 6) AS last6 FROM ni)
SELECT seq, CASE WHEN notice_number <> '' THEN 'gaz-{RUN_TS.year}-' ||
         CASE WHEN last6 = '' THEN '{RUN_TS.strftime('%m%d%H')}' WHEN length(last6) < 3 THEN lpad(last6, 3, '0') ELSE last6 END
       ELSE 'gaz-{RUN_TS.year}-{RUN_TS.strftime('%H%M%S')[:3]}' END || '-v1' AS id, notice_number, date FROM nd"""))
def q_build_notice(spark, sf):
    return bld.build_notice(_notice_items(spark, sf), RUN_TS).select(
        "seq", "id", F.col("metadata.notice_number").alias("notice_number"), "date")


_URL_PATH = "regexp_extract(coalesce(url, ''), '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
_LAST_PART = f"list_filter(string_split({_URL_PATH}, '/'), lambda p: p <> '')[-1]"


@register("bill_number", _with_raw(f"""
SELECT seq, coalesce({_x('url', r'BILL(\d+)')}, {_x('title', r'(?i)Bill\s+(\d+)')},
                     CASE WHEN url IS NOT NULL AND url <> '' THEN {_LAST_PART} END, '') AS bill_number FROM r"""))
def q_bill_number(spark, sf):
    return _raw(spark, sf).select("seq", bld.bill_number(F.col("title"), F.col("url")).alias("bill_number"))


_BILL_PROFILE = ["%Y-%m-%d", "%d/%m/%Y", "%d-%m-%Y", "%d %B %Y", "%d %b %Y", "%B %d, %Y"]


@register("build_bill", _with_raw(f"""
, b AS (SELECT seq, substring(regexp_replace(coalesce(bill_number_raw, '000'), '[^0-9]', '', 'g'), 1, 6) AS d6,
               published FROM r WHERE source_system = 'PARLIAMENT')
SELECT seq, 'parl-{RUN_TS.year}-' || CASE WHEN d6 = '' THEN '000' WHEN length(d6) < 3 THEN lpad(d6, 3, '0') ELSE d6 END || '-v1' AS id,
  CASE WHEN published IS NULL OR published = '' THEN '{RUN_DATE}'
       ELSE coalesce(strftime({_duck_parse('published', _BILL_PROFILE)}, '%Y-%m-%d'), '{RUN_DATE}') END AS date,
  CAST(54 AS INTEGER) AS parliament_number FROM b"""))
def q_build_bill(spark, sf):
    r = _raw(spark, sf).filter(F.col("source_system") == "PARLIAMENT").select(
        "seq", "title", "url", F.col("bill_number_raw").alias("bill_number"),
        F.col("published").alias("introduction_date"), F.col("creator").alias("primary_entity"),
        F.lit(None).cast("int").alias("parliament_number"), F.lit(None).cast("string").alias("summary"))
    return bld.build_bill(r, RUN_TS).select("seq", "id", "date", F.col("metadata.parliament_number").alias("parliament_number"))


_PERSON_TITLE = (f"CASE WHEN regexp_matches(title, {o.q(_HON)}) THEN 'Hon ' || regexp_extract(title, {o.q(_HON)}, 1) "
                 f"WHEN regexp_matches(title, {o.q(bld.RT_HON_RE)}) THEN 'Rt Hon ' || regexp_extract(title, {o.q(bld.RT_HON_RE)}, 1) "
                 f"ELSE {o.case_map('lower(title)', lab.rules.MINISTER_SURNAMES, o.q('Government'), contains=True)} END")


@register("person_in_title", _with_raw(f"SELECT seq, {_PERSON_TITLE} AS primary_entity FROM r"))
def q_person_in_title(spark, sf):
    return _raw(spark, sf).select("seq", bld.person_in_title(F.col("title")).alias("primary_entity"))


_P1 = r"(?:Minister|Hon\.?\s+)" + bld.NAME_SEQ
_P2 = r"(?:Rt\.?\s+Hon\.?\s+)" + bld.NAME_SEQ


@register("person_in_text", _with_raw(f"""
SELECT seq, coalesce({_x("concat(title, ' ', body)", _P1, 0)}, {_x("concat(title, ' ', body)", _P2, 0)}, {_PERSON_TITLE}) AS primary_entity FROM r"""))
def q_person_in_text(spark, sf):
    r = _raw(spark, sf)
    return r.select("seq", bld.person_in_text(F.concat(F.col("title"), F.lit(" "), F.col("body")), F.col("title"))
                    .alias("primary_entity"))


def _url_portfolio_sql() -> str:
    parts = []
    for k, v in lab.rules.RELEASE_PORTFOLIO:
        parts.append(f"WHEN contains(lower(url), {o.q(k.replace(' ', '-'))}) OR contains(lower(url), {o.q(k.replace(' ', '_'))}) THEN {o.q(v)}")
    return "CASE WHEN url IS NULL OR url = '' THEN 'General' " + " ".join(parts) + " ELSE 'General' END"


_TAGS = "CASE WHEN tags IS NULL THEN []::VARCHAR[] ELSE string_split(tags, '|') END"


@register("portfolio_in", _with_raw(f"""
SELECT seq, {o.case_map('lower(title)', lab.rules.RELEASE_PORTFOLIO, "''", contains=True)} AS from_title,
  {_url_portfolio_sql()} AS from_url,
  coalesce(list_filter(list_transform({_TAGS}, lambda t: {o.case_map('lower(t)', lab.rules.RELEASE_PORTFOLIO, 'NULL', contains=True)}),
                       lambda x: x IS NOT NULL)[1],
           nullif({o.case_map('lower(title)', lab.rules.RELEASE_PORTFOLIO, "''", contains=True)}, ''), 'General') AS from_feed
FROM r"""))
def q_portfolio_in(spark, sf):
    r = _raw(spark, sf)
    tags = F.when(F.col("tags").isNull(), F.array().cast("array<string>")).otherwise(F.split(F.col("tags"), r"\|"))
    return r.select("seq", bld.portfolio_in_title(F.col("title")).alias("from_title"),
                    bld.portfolio_from_url(F.col("url")).alias("from_url"),
                    bld.portfolio_from_feed(tags, F.col("title")).alias("from_feed"))


@register("standardise_doc_type", _with_raw(f"""
SELECT seq, feed_type, coalesce({o.case_map('lower(feed_type)', lab.rules.DOCUMENT_TYPES)}, feed_type) AS document_type,
  CASE WHEN ends_with(feed_type, 's') THEN regexp_replace(upper(left(feed_type, 1)) || lower(substring(feed_type, 2)), 's+$', '')
       ELSE upper(left(feed_type, 1)) || lower(substring(feed_type, 2)) END AS feed_document_type FROM r"""))
def q_standardise_doc_type(spark, sf):
    r = _raw(spark, sf)
    return r.select("seq", "feed_type", bld.standardise_doc_type(F.col("feed_type")).alias("document_type"),
                    bld.feed_doc_type(F.col("feed_type")).alias("feed_document_type"))


_RKEY = (f"CASE WHEN url IS NOT NULL AND url <> '' AND {_LAST_PART} IS NOT NULL "
         f"THEN 'beehive_' || substring(regexp_replace({_LAST_PART}, '[^a-zA-Z0-9]', '', 'g'), 1, 15) "
         f"ELSE 'beehive_' || substring(md5(coalesce(title, '') || '_' || coalesce(published, '')), 1, 12) END")


@register("release_key", _with_raw(f"SELECT seq, {_RKEY} AS release_key FROM r"))
def q_release_key(spark, sf):
    return _raw(spark, sf).select("seq", bld.release_key(F.col("url"), F.col("title"), F.col("published")).alias("release_key"))


_RFC = r"(?i)^\s*(?:[A-Za-z]{3},\s*)?(\d{1,2})\s+(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+(\d{4})(?:\s|$)"


@register("keep_valid_release", _with_raw(f"""
SELECT seq FROM r WHERE source_system = 'BEEHIVE' AND title <> '' AND url <> '' AND published <> ''
  AND starts_with(url, 'https://www.beehive.govt.nz/') AND length(title) BETWEEN 10 AND 500
  AND ((regexp_matches(published, '^\\d{{4}}-(?:1[0-2]|0[1-9]|[1-9])-(?:3[01]|[12]\\d|0[1-9]|[1-9])$')
        AND try_strptime(published, '%Y-%m-%d') IS NOT NULL)
       OR (regexp_matches(published, {o.q(_RFC)})
           AND try_strptime(regexp_extract(published, {o.q(_RFC)}, 1) || ' ' || regexp_extract(published, {o.q(_RFC)}, 2)
                            || ' ' || regexp_extract(published, {o.q(_RFC)}, 3), '%d %b %Y') IS NOT NULL))"""))
def q_keep_valid_release(spark, sf):
    r = _raw(spark, sf).filter(F.col("source_system") == "BEEHIVE").withColumnRenamed("published", "date")
    return bld.keep_valid_release(r).select("seq")


@register("build_release", _with_raw(f"""
SELECT seq, 'bee-{RUN_TS.year}-' || substring(regexp_replace(coalesce({_LAST_PART}, 'unknown'), '[^a-zA-Z0-9]', '', 'g'), 1, 10)
       || '-v1' AS id FROM r WHERE source_system = 'BEEHIVE'"""))
def q_build_release(spark, sf):
    r = _raw(spark, sf).filter(F.col("source_system") == "BEEHIVE").select(
        "seq", "title", "url", F.col("published").alias("date"), F.lit(None).cast("string").alias("primary_entity"),
        F.col("body").alias("summary"), F.lit(None).cast("string").alias("document_type"),
        F.lit(None).cast("string").alias("portfolio"))
    return bld.build_release(r, RUN_TS).select("seq", "id")


# ------------------------------------------------------------------ sources
from actlens.session import scratch_path, table  # noqa: E402
from actlens.sources import combine as comb  # noqa: E402
from actlens.sources import feeds as fd  # noqa: E402
from actlens.sources import pages as pg  # noqa: E402

_TIERS = "CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 3 ELSE 4 END"
_EV_SOURCE = "CASE user_id % 4 WHEN 0 THEN 'PARLIAMENT' WHEN 1 THEN 'LEGISLATION' WHEN 2 THEN 'GAZETTE' ELSE 'BEEHIVE' END"
# tier 1 exists only for two sources, tier 2 for three: each source falls through differently
_EV_FILTER = "NOT (event_type = 'purchase' AND user_id % 4 >= 2) AND NOT (event_type = 'signup' AND user_id % 4 = 3)"


def _tiered_events(spark, sf):
    return table(spark, sf, "events").filter(F.expr(_EV_FILTER)).select(
        "event_id", F.expr(_EV_SOURCE).alias("source_system"), F.expr(_TIERS).alias("tier"))


@register("first_nonempty", f"""
WITH t AS (SELECT event_id, {_EV_SOURCE} AS source_system, {_TIERS} AS tier FROM events WHERE {_EV_FILTER})
SELECT source_system, event_id, tier FROM t WHERE tier = (SELECT min(tier) FROM t t2 WHERE t2.source_system = t.source_system)""")
def q_first_nonempty(spark, sf):
    return comb.first_nonempty(_tiered_events(spark, sf)).select("source_system", "event_id", "tier")


@register("union_sources", o.with_actions("""
SELECT seq, source_system, CAST(CASE source_system WHEN 'PARLIAMENT' THEN 0 WHEN 'LEGISLATION' THEN 1
  WHEN 'GAZETTE' THEN 2 ELSE 3 END AS INTEGER) AS source_rank FROM a"""))
def q_union_sources(spark, sf):
    acts = adapter.actions(spark, sf).select("seq", "source_system")
    parts = [(s, acts.filter(F.col("source_system") == s).drop("source_system")) for s in reversed(lab.rules.SOURCES)]
    return comb.union_sources(*parts).select("seq", "source_system", "source_rank")


@register("limit_per_source", o.with_actions("""
SELECT seq, source_system FROM (SELECT seq, source_system, row_number() OVER (PARTITION BY source_system ORDER BY seq) AS rn
FROM a) WHERE rn <= 25"""))
def q_limit_per_source(spark, sf):
    return comb.limit_per_source(adapter.actions(spark, sf), 25).select("seq", "source_system")


@register("limit_per_source_none", o.with_actions("SELECT seq, source_system FROM a"))
def q_limit_per_source_none(spark, sf):
    return comb.limit_per_source(adapter.actions(spark, sf), 0).select("seq", "source_system")


_DETAIL_SQL = """, det AS (SELECT l.doc_id AS seq, a.url, 'quality ' || CAST(l.quality AS VARCHAR) || ', toxic ' || CAST(l.toxic AS VARCHAR) AS summary
                FROM labels l JOIN a ON a.seq = l.doc_id),
d1 AS (SELECT url, min_by(summary, seq) AS summary FROM det GROUP BY url)"""


@register("enrich_from_detail", o.with_actions(_DETAIL_SQL + """
SELECT a.seq, a.url, coalesce(d1.summary, a.summary) AS summary FROM a LEFT JOIN d1 USING (url)"""))
def q_enrich_from_detail(spark, sf):
    acts = adapter.actions(spark, sf)
    labels_t = table(spark, sf, "labels")
    detail = labels_t.join(acts.select("seq", "url"), labels_t["doc_id"] == acts["seq"]).select(
        "seq", "url", F.concat(F.lit("quality "), F.col("quality").cast("string"), F.lit(", toxic "),
                               F.col("toxic").cast("string")).alias("summary"))
    return comb.enrich_from_detail(acts, detail).select("seq", "url", "summary")


_HREF_RE = 'href="([^"]*)"'


@register("absolute_url", f"""
WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '{_HREF_RE}', 1)) AS href FROM pages)
SELECT page_id, href, CASE WHEN starts_with(href, 'http') THEN href
  WHEN starts_with(href, '//') THEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*:)', 1) || href
  WHEN starts_with(href, '/') THEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || href
  ELSE CASE WHEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^?#]*/)', 1) <> ''
            THEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^?#]*/)', 1)
            ELSE regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || '/' END || href END AS abs_url
FROM l""")
def q_absolute_url(spark, sf):
    p = table(spark, sf, "pages")
    links = p.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit(_HREF_RE), 1)).alias("href"))
    return links.select("page_id", "href", comb.absolute_url(F.col("url"), F.col("href")).alias("abs_url"))


def _make_extract(kind):
    def run(spark, sf):
        pages_t = table(spark, sf, "pages")
        if pages_t.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
            pages_t = pages_t.repartition(spark.sparkContext.defaultParallelism)
        return pg.extract(pages_t, kind)
    return run


for _kind, _name in [("bill_rows", "extract_bill_rows"), ("notice_rows", "extract_notice_rows"),
                     ("notice_list", "extract_notice_list"), ("announcement_rows", "extract_page_rows"),
                     ("bill_detail", "extract_bill_detail"), ("announcement_detail", "extract_announcement_detail")]:
    register(_name)(_make_extract(_kind))


def _act_feed_path(spark, sf):
    r = rawmod.raw_items(spark, sf).filter(F.col("source_system") == "LEGISLATION")
    path = scratch_path(spark, "act-feed")
    (r.select("title", F.struct(F.col("url").alias("_href")).alias("link"), "published", "content")
      .write.format("xml").option("rootTag", "feed").option("rowTag", "entry").save(path))
    return path


@register("read_act_feed", _with_raw(_ACT_ITEM_CTE + """
SELECT title, url, CASE WHEN year <> '' AND number <> '' THEN year || ' No ' || number ELSE '' END AS act_number,
       year, number, primary_entity, date, version FROM ai"""))
def q_read_act_feed(spark, sf):
    return fd.read_act_feed(spark, _act_feed_path(spark, sf), RUN_TS).select(
        "title", "url", "act_number", "year", "number", "primary_entity", "date", "version")


@register("read_release_feed")
def q_read_release_feed(spark, sf):
    r = rawmod.raw_items(spark, sf).filter(F.col("source_system") == "BEEHIVE")
    path = scratch_path(spark, "release-feed")
    tags = F.when(F.col("tags").isNull(), F.array().cast("array<string>")).otherwise(F.split("tags", r"\|"))
    (r.select("title", F.col("url").alias("link"), F.col("published").alias("pubDate"),
              F.col("body").alias("description"), tags.alias("category"))
      .write.format("xml").option("rootTag", "channel").option("rowTag", "item").save(path))
    return fd.read_release_feed(spark, path, "releases", RUN_TS)


def _payloads(spark, sf, source, build_item, wrap):
    """Landed JSON documents of <= 50 items each, built by Spark from raw items."""
    r = rawmod.raw_items(spark, sf).filter(F.col("source_system") == source)
    items = r.select((F.col("seq") / 200).cast("long").alias("doc_seq"), "seq", build_item.alias("j"))
    docs = items.groupBy("doc_seq").agg(F.array_sort(F.collect_list(F.struct("seq", "j"))).alias("xs"))
    body = F.array_join(F.transform("xs", lambda x: x["j"]), ",")
    return docs.select("doc_seq", wrap(body).alias("payload"))


@register("read_bill_json")
def q_read_bill_json(spark, sf):
    alt = F.col("seq") % 2 == 0
    item = F.to_json(F.struct(
        F.when(alt, F.col("bill_number_raw")).alias("billNumber"), F.when(~alt, F.col("bill_number_raw")).alias("bill_number"),
        F.when(alt, F.col("title")).alias("title"), F.when(~alt, F.col("title")).alias("name"),
        F.when(alt, F.col("url")).alias("url"), F.when(~alt, F.regexp_replace("url", "^https://[^/]+", "")).alias("link"),
        F.when(alt, F.col("creator")).alias("sponsor"),
        F.when(~alt, F.struct(F.col("creator").alias("displayName"))).alias("sponsoringMember"),
        F.col("published").alias("introductionDate")))
    key = lambda body: F.concat(F.lit('{"'), F.element_at(F.array(F.lit("items"), F.lit("bills"), F.lit("results")),
                                                          (F.col("doc_seq") % 3 + 1).cast("int")),
                                F.lit('": ['), body, F.lit("]}"))
    return fd.read_bill_json(_payloads(spark, sf, "PARLIAMENT", item, key))


@register("read_notice_json")
def q_read_notice_json(spark, sf):
    item = F.to_json(F.struct(F.col("title"), F.col("body").alias("description"), F.col("url").alias("landing_url"),
                              F.col("published").alias("date"),
                              F.when(F.col("creator").isNotNull(), F.array("creator")).alias("creator")))
    wrap = lambda body: F.concat(F.lit('{"search": {"results": ['), body, F.lit("]}}"))
    return fd.read_notice_json(_payloads(spark, sf, "GAZETTE", item, wrap), RUN_TS)


@register("read_person_feeds")
def q_read_person_feeds(spark, sf):
    r = rawmod.raw_items(spark, sf).filter(F.col("source_system") == "BEEHIVE")
    term = F.element_at(F.array(*[F.lit(t) for _, t in lab.rules.PERSON_FEEDS]), (F.col("seq") % 5 + 1).cast("int"))
    items = r.select("seq", "title", "url", "published", F.col("body").alias("summary"),
                     F.when(F.col("tags").isNull(), F.array().cast("array<string>")).otherwise(F.split("tags", r"\|")).alias("tags"),
                     term.alias("term_id"))
    main = fd.release_items(items.filter(F.col("seq") < 0).drop("term_id"), "releases", RUN_TS)  # main feeds: empty
    return fd.person_feed_fallback(main, fd.read_person_feeds(spark, items, RUN_TS), limit=10)


# ----------------------------------------------------------------- pipeline
from actlens.plans import pipeline as pl  # noqa: E402

_PIPE_CTE = _VALIDATE_CTE + f""", pv AS (
  SELECT seq, new_id AS id, new_title AS title, new_date AS date, source_system, new_url AS url,
         new_entity AS primary_entity, {_duck_collapse('summary')} AS summary, nullif(trim(bill_number), '') AS bill_number,
         parliament_number, nullif(trim(act_number), '') AS act_number, nullif(trim(commencement_date), '') AS commencement_date,
         nullif(trim(notice_number), '') AS notice_number, nullif(trim(notice_type), '') AS notice_type,
         nullif(trim(document_type), '') AS document_type, nullif(trim(portfolio), '') AS portfolio,
         version, base_id, labels_in, stage1, stage1_date, stage2, stage2_date
  FROM v WHERE {_SCHEMA_OK.replace('new_id', 'new_id').replace('new_date', 'new_date')}),
gv AS (SELECT pv.seq, {_BASE} AS gbase, {_VNUM} AS vnum FROM pv),
gf AS (SELECT gbase, min(seq) AS gseq FROM gv GROUP BY gbase),
gp AS (SELECT gv.seq, row_number() OVER (ORDER BY gf.gseq, gv.vnum DESC, gv.seq) AS group_pos FROM gv JOIN gf USING (gbase)),
{o.labelled_ctes('pv')}"""


@register("pipeline", o.with_actions(_PIPE_CTE + """
SELECT lab.seq, lab.id, lab.date, array_to_string(lab.labels, '|') AS labels,
       CAST(row_number() OVER (ORDER BY lab.date DESC, lab.title DESC, gp.group_pos) AS BIGINT) AS pos
FROM lab JOIN gp USING (seq)"""))
def q_pipeline(spark, sf):
    out, _ = pl.pipeline(adapter.actions(spark, sf), RUN_TS, observe=False)
    return out.select("seq", "id", "date", _labels_str(), "pos")


@register("run_report")
def q_run_report(spark, sf):
    out, obs = pl.pipeline(adapter.actions(spark, sf), RUN_TS)
    out.write.format("noop").mode("overwrite").save()
    return pl.run_report(spark, obs, RUN_TS)


def _convert_parts(spark, sf):
    r = rawmod.raw_items(spark, sf)
    acts = bld.parse_act_entry(r.filter(F.col("source_system") == "LEGISLATION"), RUN_TS)
    notices = _notice_items(spark, sf)
    bills = r.filter(F.col("source_system") == "PARLIAMENT").select(
        "seq", "title", "url", F.col("bill_number_raw").alias("bill_number"),
        F.col("published").alias("introduction_date"), F.col("creator").alias("primary_entity"),
        F.lit(None).cast("int").alias("parliament_number"), F.lit(None).cast("string").alias("summary"))
    rel = fd.release_items(r.filter(F.col("source_system") == "BEEHIVE").select(
        "seq", "title", "url", "published", F.col("body").alias("summary"),
        F.when(F.col("tags").isNull(), F.array().cast("array<string>")).otherwise(F.split("tags", r"\|")).alias("tags")),
        "releases", RUN_TS)
    rel = bld.keep_valid_release(bld.enhance_release(rel))
    return {"LEGISLATION": acts, "GAZETTE": notices, "PARLIAMENT": bills, "BEEHIVE": rel}


_ID_OK = "regexp_matches(id, '^[a-z]{3,8}-\\d{4}-\\d{3,6}(?:-v\\d+)?$')"
_DATE_OK = ("regexp_matches(date, '^\\d{4}-(?:1[0-2]|0[1-9]|[1-9])-(?:3[01]|[12]\\d|0[1-9]|[1-9])$') "
            "AND try_strptime(date, '%Y-%m-%d') IS NOT NULL")
_URL_OK = "regexp_matches(url, " + o.q(val.URL_RE.replace("(?i)", "(?i)")) + ")"


_CONVERTED = f"""
WITH r AS ({_RAW}),
acts AS (SELECT b.seq, b.id, b.date, r.url, 'LEGISLATION' AS source_system, b.commencement_date
         FROM ({ORACLES['build_act']}) b JOIN r USING (seq)),
notices AS (SELECT b.seq, b.id, b.date, r.url, 'GAZETTE' AS source_system, NULL AS commencement_date
            FROM ({ORACLES['build_notice']}) b JOIN r USING (seq)),
bills AS (SELECT b.seq, b.id, b.date, r.url, 'PARLIAMENT' AS source_system, NULL AS commencement_date
          FROM ({ORACLES['build_bill']}) b JOIN r USING (seq)),
rel AS (SELECT seq, 'bee-{RUN_TS.year}-' || substring(regexp_replace(coalesce({_LAST_PART}, 'unknown'), '[^a-zA-Z0-9]', '', 'g'), 1, 10)
              || '-v1' AS id, '2025-01-01' AS date, url, 'BEEHIVE' AS source_system, NULL AS commencement_date
            FROM r WHERE source_system = 'BEEHIVE' AND title <> '' AND url <> ''
              AND starts_with(url, 'https://www.beehive.govt.nz/') AND length(title) BETWEEN 10 AND 500),
u AS (SELECT * FROM acts UNION ALL SELECT * FROM notices UNION ALL SELECT * FROM bills UNION ALL SELECT * FROM rel)"""


@register("convert", _CONVERTED + f"""
SELECT seq, id, source_system FROM u WHERE {_ID_OK} AND {_DATE_OK} AND {_URL_OK}
  AND (commencement_date IS NULL OR (regexp_matches(commencement_date, '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}$')
       AND try_strptime(commencement_date, '%Y-%m-%d') IS NOT NULL))""")
def q_convert(spark, sf):
    ok, _ = pl.convert(_convert_parts(spark, sf), RUN_TS)
    return ok.select("seq", "id", "source_system")


@register("convert_rejects", _CONVERTED + f"""
SELECT * FROM (SELECT seq, id, source_system, CASE WHEN NOT {_ID_OK} THEN 'id' WHEN NOT ({_DATE_OK}) THEN 'date' WHEN NOT {_URL_OK} THEN 'url'
  WHEN commencement_date IS NOT NULL AND try_strptime(commencement_date, '%Y-%m-%d') IS NULL THEN 'commencement_date' END AS reject_reason FROM u)
WHERE reject_reason IS NOT NULL""")
def q_convert_rejects(spark, sf):
    _, bad = pl.convert(_convert_parts(spark, sf), RUN_TS)
    return bad.select("seq", "id", "source_system", "reject_reason")


@register("enhance_release", _with_raw(f"""
SELECT seq, coalesce({o.case_map('lower(feed_type)', lab.rules.DOCUMENT_TYPES)}, feed_type) AS document_type,
  {_url_portfolio_sql()} AS portfolio, {_RKEY} AS release_key, 'BEEHIVE' AS source_system FROM r"""))
def q_enhance_release(spark, sf):
    r = _raw(spark, sf).select("seq", "title", "url", F.col("published").alias("date"),
                               F.col("feed_type").alias("document_type"), F.lit(None).cast("string").alias("portfolio"))
    return bld.enhance_release(r).select("seq", "document_type", "portfolio", "release_key", "source_system")


# ------------------------------------------ similar titles, streams, sinks
from actlens.operators import similar as sim  # noqa: E402
from actlens.streaming import incremental as inc  # noqa: E402


# Titles that grow by a word from block to block (chains of links) and one day in two formats.
_NEAR_TITLE = """concat(title, CASE CAST(floor(seq / 156) AS BIGINT) % 4
  WHEN 0 THEN '' WHEN 1 THEN 's' WHEN 2 THEN 's now' ELSE 's now in' END)"""
_NEAR_DATE = """CASE CAST(floor(seq / 13) AS BIGINT) % 3
  WHEN 0 THEN '2024-01-15' WHEN 1 THEN '15/1/2024' ELSE date END"""


@register("similar_titles", f"""WITH RECURSIVE a AS ({o.ADAPTER}), d AS (
  SELECT seq, source_system, {_NEAR_TITLE} AS title, {_NEAR_DATE} AS date FROM a),
n AS (SELECT seq, source_system, strftime({_duck_parse('date', _VALIDATOR_FORMATS)}, '%Y-%m-%d') AS day,
  trim(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS t FROM d),
c AS (SELECT day, t, min(seq) AS tid, count(*) AS copies FROM n WHERE day IS NOT NULL GROUP BY day, t),
p AS (SELECT x.tid AS a, y.tid AS b, round(1 - levenshtein(x.t, y.t) / greatest(length(x.t), length(y.t), 1), 6) AS score
  FROM c x JOIN c y ON x.day = y.day AND x.tid <> y.tid),
k AS (SELECT a, b, score FROM p WHERE score >= 0.8),
reach(tid, r) AS (SELECT tid, tid FROM c UNION SELECT reach.tid, k.b FROM reach JOIN k ON k.a = reach.r),
cl AS (SELECT tid, min(r) AS cluster FROM reach GROUP BY tid),
best AS (SELECT a AS tid, max(score) AS score FROM k GROUP BY a),
m AS (SELECT n.seq, n.source_system, cl.cluster, CASE WHEN c.copies > 1 THEN 1.0 ELSE best.score END AS score
  FROM n JOIN c ON n.day = c.day AND n.t = c.t JOIN cl ON cl.tid = c.tid LEFT JOIN best ON best.tid = c.tid),
z AS (SELECT cluster, count(DISTINCT source_system) AS n_sources, count(*) AS size FROM m GROUP BY cluster)
SELECT m.seq, m.cluster, m.source_system, CAST(m.score AS DOUBLE) AS score, z.n_sources, z.size
FROM m JOIN z ON m.cluster = z.cluster WHERE z.n_sources >= 2""")
def q_similar_titles(spark, sf):
    near = adapter.actions(spark, sf).select("seq", "source_system", F.expr(_NEAR_TITLE).alias("title"),
                                             F.expr(_NEAR_DATE).alias("date"))
    return sim.similar_titles(near)


@register("ingest_incremental")
def q_ingest_incremental(spark, sf):
    acts = adapter.actions(spark, sf).drop("lang")
    landing, output, ckpt = (scratch_path(spark, n) for n in ("landing", "ingested", "stream-ckpt"))
    for part in range(2):  # two nightly drops; the second re-delivers some URLs
        drop = acts.filter(F.col("seq") % 2 == part) if part == 0 else acts
        drop.withColumn("landed_at", F.lit(_dt.datetime(2025, 12, 15 + part))).write.mode("append").json(landing)
    inc.ingest_incremental(spark, landing, output, ckpt, RUN_TS)
    return spark.read.parquet(output).select("seq", "id", "url", _labels_str(), "batch_id")


@register("write_snapshot")
def q_write_snapshot(spark, sf):
    old, new = _snapshots(spark, sf)
    path = scratch_path(spark, "snapshots")
    snap.write_snapshot(old, path, _dt.datetime(2025, 12, 15))
    snap.write_snapshot(new, path, RUN_TS)
    return snap.latest_snapshot(spark, path).select("seq", "id", "title", "run_date", "source_system")


# ------------------------------------------- stage parsing, date profiles, feed sink
from actlens.functions.dates import PROFILES as _PROFILES  # noqa: E402

_STAGE_TEXT = """CASE turn % 6 WHEN 0 THEN 'First Reading' WHEN 1 THEN 'Second Reading' WHEN 2 THEN 'Select Committee'
  WHEN 3 THEN 'Committee of Whole House' WHEN 4 THEN 'Third Reading' ELSE 'Royal Assent' END
  || CASE conv_id % 4 WHEN 0 THEN ' - ' || CAST(1 + conv_id % 28 AS STRING) || '/' || CAST(1 + turn % 12 AS STRING) || '/2024'
                      WHEN 1 THEN ' - ' || CAST(1 + conv_id % 28 AS STRING) || ' March 2024'
                      WHEN 2 THEN ' - ' || role ELSE '' END"""
_STAGE_DATE_CELL = "CASE WHEN conv_id % 4 = 3 THEN '2024-0' || CAST(1 + turn % 9 AS STRING) || '-15' END"


@register("parse_stage", f"""
WITH s AS (SELECT conv_id, turn, {_STAGE_TEXT} AS text, {_STAGE_DATE_CELL} AS date_cell FROM conversations),
p AS (SELECT conv_id, turn,
        CASE WHEN contains(text, ' - ') THEN nullif(split_part(text, ' - ', 1), '') END AS st0,
        CASE WHEN contains(text, ' - ') THEN nullif(substring(text, instr(text, ' - ') + 3), '') END AS dt0,
        text, date_cell FROM s),
q AS (SELECT conv_id, turn, coalesce(st0, text) AS stage, coalesce(dt0, date_cell) AS date_s FROM p),
r AS (SELECT *, strftime({_duck_parse('date_s', _BILL_PROFILE)}, '%Y-%m-%d') AS iso FROM q)
SELECT conv_id, turn, CASE WHEN stage <> '' AND date_s <> '' AND iso IS NOT NULL THEN stage END AS stage,
       CASE WHEN stage <> '' AND date_s <> '' AND iso IS NOT NULL THEN iso END AS date FROM r""")
def q_parse_stage(spark, sf):
    conv = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.expr(_STAGE_TEXT).alias("text"), F.expr(_STAGE_DATE_CELL).alias("date_cell"))
    parsed = bld.parse_stage(F.col("text"), F.col("text"), F.col("date_cell"))
    return conv.select("conv_id", "turn", parsed["stage"].alias("stage"), parsed["date"].alias("date"))


def _profile_sql(profile: str) -> str:
    src = "published"
    if profile in ("notice", "release"):
        src = f"regexp_replace({o.ustrip('published')}, '[^\\w\\s,/:T-]', '', 'g')"
    parsed = "coalesce(" + ", ".join(f"try_strptime({o.ustrip(src)}, {o.q(f)})" for f in _PROFILES[profile]) + ")"
    if profile == "act":
        parsed = (f"CASE WHEN contains(published, 'T') THEN try_strptime(split_part(published, 'T', 1), '%Y-%m-%d') "
                  f"ELSE {parsed} END")
    return f"strftime({parsed}, '%Y-%m-%d') AS {profile}"


@register("date_profiles", _with_raw(
    "SELECT seq, published, " + ", ".join(_profile_sql(p) for p in _PROFILES) + " FROM r"))
def q_date_profiles(spark, sf):
    r = _raw(spark, sf)
    return r.select("seq", "published", *[normalise_date(F.col("published"), p).alias(p) for p in _PROFILES])


@register("write_feed")
def q_write_feed(spark, sf):
    path = scratch_path(spark, "feed")
    snap.write_feed(srch.feed_view(labelled(spark, sf), "ALL", "Housing"), path)
    return (spark.read.format("xml").option("rowTag", "item")
            .schema("title string, link string, pubDate string, description string, category array<string>").load(path))


@register("extract_bill_stages")
def q_extract_bill_stages(spark, sf):
    """O.10 stage list: stage elements of detail pages parsed by O.36."""
    rows = _make_extract("bill_stages")(spark, sf)
    parsed = bld.parse_stage(F.col("title"), F.nullif(F.col("extra"), F.lit("")), F.nullif(F.col("date_text"), F.lit("")))
    return rows.select("page_id", "pos", parsed["stage"].alias("stage"), parsed["date"].alias("date"))


# ---------------------------------------------- index, history and run stores
from actlens.plans import registry_messages, registry_runs, registry_stores  # noqa: E402, F401
