"""Registered queries of messages and of the export's side files (O.18, O.46, O.73, O.77)."""

from __future__ import annotations

from pyspark.sql import functions as F

from actlens import adapter, rules
from actlens.operators import display as disp
from actlens.operators import snapshot as snap
from actlens.operators import stats as st
from actlens.operators import validate as val
from actlens.plans import oracle as o
from actlens.plans.registry import (_VALIDATE_CTE, ORACLES, RUN_TS, _first_sentence_sql, _labels_str, labelled, register,
                                    validated)
from actlens.session import scratch_path


# ---------------------------------------------------------------- validation
@register("validation_errors", o.with_actions(_VALIDATE_CTE + """
SELECT seq, CAST(k - 1 AS INTEGER) AS place, errors[k] AS message FROM (SELECT seq, errors, unnest(range(1, len(errors) + 1)) AS k FROM v)"""))
def q_validation_errors(spark, sf):
    return val.validation_messages(validated(spark, sf))


@register("validation_fixed", o.with_actions(_VALIDATE_CTE + """
SELECT seq FROM v WHERE new_id <> id OR new_date <> date OR new_url <> url OR new_title <> title OR primary_entity IS NULL
  OR primary_entity = '' OR new_summary <> summary OR (len(labels0) > 0 AND new_labels <> labels0)"""))
def q_validation_fixed(spark, sf):
    return val.fixed_rows(validated(spark, sf))


@register("validate_strict_rejects", o.with_actions(
    _VALIDATE_CTE + " SELECT seq, new_id AS id, errors[1] AS first_error FROM v WHERE len(errors) > 0"))
def q_validate_strict_rejects(spark, sf):
    _, rejected = val.split_strict(validated(spark, sf))
    return rejected.select("seq", "id", F.col("_errors")[0].alias("first_error"))


# -------------------------------------------------------------------- audit
# records with missing and repeated fields
_HOLES = """SELECT seq, source_system,
  CASE seq % 43 WHEN 7 THEN NULL WHEN 8 THEN '' WHEN 9 THEN 'same-id' ELSE id END AS id,
  CASE seq % 37 WHEN 5 THEN NULL WHEN 6 THEN '' ELSE title END AS title,
  CASE seq % 41 WHEN 3 THEN NULL WHEN 4 THEN '' ELSE url END AS url FROM {a}"""


@register("audit_messages", o.with_actions(f""", h AS ({_HOLES.format(a='a')}),
f AS (SELECT *, seq > min(seq) OVER (PARTITION BY id) AS dup_id, seq > min(seq) OVER (PARTITION BY url) AS dup_url FROM h)
SELECT seq, 'error' AS level, 'Action ' || seq || ': Missing ID' AS message FROM f WHERE id IS NULL OR id = ''
UNION ALL SELECT seq, 'error', 'Action ' || seq || ': Missing title' FROM f WHERE title IS NULL OR title = ''
UNION ALL SELECT seq, 'error', 'Action ' || seq || ': Missing URL' FROM f WHERE url IS NULL OR url = ''
UNION ALL SELECT seq, 'error', 'Action ' || seq || ': Duplicate ID ' || coalesce(id, 'None') FROM f WHERE dup_id
UNION ALL SELECT seq, 'warning', 'Action ' || seq || ': Duplicate URL ' || coalesce(url, 'None') FROM f WHERE dup_url"""))
def q_audit_messages(spark, sf):
    holes = spark.sql(_HOLES.format(a="{a}"), a=adapter.actions(spark, sf))
    return st.audit_messages(holes)


@register("audit_sources", o.with_actions(
    f", h AS ({_HOLES.format(a='a')}) SELECT source_system, CAST(count(*) AS BIGINT) AS n FROM h GROUP BY source_system"))
def q_audit_sources(spark, sf):
    """The audit's distribution of sources."""
    return st.source_counts(spark.sql(_HOLES.format(a="{a}"), a=adapter.actions(spark, sf)))


# ------------------------------------------------------------------ display
_CONTENT = """SELECT seq, title, date, url, CASE WHEN seq % 5 = 0 THEN summary WHEN seq % 5 = 1 THEN '' END AS summary,
  CASE WHEN seq % 5 = 1 THEN concat('Described. ', summary) WHEN seq % 5 = 2 THEN '' END AS description,
  CASE WHEN seq % 5 = 2 THEN concat('Contained ', summary) END AS content,
  CASE WHEN seq % 5 = 3 THEN concat('<p>Body</p>', summary) WHEN seq % 5 = 2 THEN 'not reached' END AS body FROM {a}"""


@register("audit_lines_content", o.with_actions(f""", c AS ({_CONTENT.format(a='a')}),
t AS (SELECT seq, coalesce(nullif(summary, ''), nullif(description, ''), nullif(content, ''), nullif(body, ''), '') AS text FROM c)
SELECT seq, {_first_sentence_sql('text')} AS first_sentence FROM t"""))
def q_audit_lines_content(spark, sf):
    items = spark.sql(_CONTENT.format(a="{a}"), a=adapter.actions(spark, sf))
    return disp.audit_lines(items).select("seq", "first_sentence")


# ------------------------------------------------------------------- export
def _exported(spark, sf) -> str:
    path = scratch_path(spark, "export")
    rows = st.export_table(validated(spark, sf)).select("pos", "id", "title", "date", "source_system", "url", _labels_str())
    snap.export_json(rows, path, st.export_summary(labelled(spark, sf), RUN_TS))
    return path


@register("export_json", o.with_actions(_VALIDATE_CTE + """
SELECT CAST(row_number() OVER (ORDER BY new_date DESC, new_title DESC, seq) AS BIGINT) AS pos, new_id AS id, new_title AS title,
  new_date AS date, source_system, new_url AS url, array_to_string(new_labels, '|') AS labels FROM v"""))
def q_export_json(spark, sf):
    return spark.read.schema("pos long, id string, title string, date string, source_system string, url string, labels string").json(
        f"{_exported(spark, sf)}/actions")


@register("export_json_summary", ORACLES["export_summary"])
def q_export_json_summary(spark, sf):
    """The summary read back from the export."""
    s = spark.read.schema("last_updated string, total_count long, source_counts map<string, long>, label_counts map<string, long>, "
                          "earliest string, latest string, generated_by string, version string").json(f"{_exported(spark, sf)}/metadata")
    counts = [F.coalesce(F.col("source_counts")[k], F.lit(0).cast("long")).alias(f"n_{k.lower()}") for k in rules.SOURCES]
    n_labels = F.aggregate(F.map_values("label_counts"), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return s.select("last_updated", "total_count", *counts, n_labels.alias("n_labels"), "earliest", "latest", "generated_by", "version")


@register("export_json_labels", "SELECT CAST(k AS INTEGER) AS pos, l AS label FROM (SELECT unnest(range({n})) AS k, unnest([{labels}]) AS l)".format(
    n=len(rules.LABELS), labels=", ".join(o.q(x) for x in rules.LABELS)))
def q_export_json_labels(spark, sf):
    """The label list read back from the export."""
    return spark.read.schema("pos int, label string").json(f"{_exported(spark, sf)}/labels")
