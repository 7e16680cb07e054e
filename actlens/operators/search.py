"""Filters, search and the combined query (O.62 - O.69, O.22, O.75).

The query is one filter + one sort plan: search, source and label filters
are row predicates that Catalyst merges into a single ``Filter`` (the
source equality reaches the Parquet scan / partition directory when the
table is partitioned by ``source_system``); the date sort is the only
exchange.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actlens import rules
from actlens.functions.order import with_position
from actlens.session import materialize

# Whitespace as JavaScript's ``String.prototype.trim`` sees it.
JS_WS = r"[\t\n\x0B\f\r\p{Z}\x{FEFF}]"

SEARCH_FIELDS = ["title", "summary", "primary_entity", "url", "id"]
#: Matches of a query that one task sorts.
FEW = 1 << 14
META_SEARCH_FIELDS = [
    "bill_number", "act_number", "notice_number", "notice_type", "document_type",
    "portfolio", "parliament_number", "commencement_date",
]


@dataclass(frozen=True)
class SearchConfig:
    case_sensitive: bool = False
    exact_match: bool = False
    search_metadata: bool = True
    search_stage_history: bool = True


def _js_trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{JS_WS}+|{JS_WS}+$", "")


def _js_trim_py(s: str) -> str:
    import re
    return re.sub(r"^[\t\n\x0b\f\r\s﻿]+|[\t\n\x0b\f\r\s﻿]+$", "", s)


def _matches(value: Column, query: str, cfg: SearchConfig, numeric: bool = False) -> Column:
    """O.68: one field test; NULL, empty string or numeric 0 never matches."""
    q = _js_trim_py(query)
    v = value.cast("string")
    # the needle is trimmed, so the ends of a field matter to an exact match alone
    norm = _js_trim(v) if cfg.exact_match else v
    if not cfg.case_sensitive:
        norm = F.lower(norm)
        q = q.lower()
    hit = (norm == F.lit(q)) if cfg.exact_match else norm.contains(F.lit(q))
    truthy = (value != 0) if numeric else (v != "")
    return F.coalesce(truthy & hit, F.lit(False))


def search_condition(query: str, cfg: SearchConfig = SearchConfig()) -> Column | None:
    """O.65 - O.67 as one boolean column; None for a blank query."""
    if not _js_trim_py(query or ""):
        return None
    cond = None
    for name in SEARCH_FIELDS:
        m = _matches(F.col(name), query, cfg)
        cond = m if cond is None else cond | m
    cond = cond | F.coalesce(F.exists(F.col("labels"), lambda x: _matches(x, query, cfg)), F.lit(False))
    if cfg.search_metadata:
        for name in META_SEARCH_FIELDS:
            cond = cond | _matches(F.col(f"metadata.{name}"), query, cfg, name == "parliament_number")
        if cfg.search_stage_history:
            stage_hit = F.exists(
                F.col("metadata.stage_history"),
                lambda s: _matches(s["stage"], query, cfg) | _matches(s["date"], query, cfg),
            )
            cond = cond | F.coalesce(stage_hit, F.lit(False))
    return cond


def search(df: DataFrame, query: str, cfg: SearchConfig = SearchConfig()) -> DataFrame:
    cond = search_condition(query, cfg)
    return df if cond is None else df.filter(cond)


def filter_source(df: DataFrame, source: str = "ALL") -> DataFrame:
    """O.62: equality on ``source_system``; ALL is the identity."""
    return df if source == "ALL" else df.filter(F.col("source_system") == source)


def filter_labels(df: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """O.63: any-of; an empty list is the identity."""
    if not labels:
        return df
    wanted = F.array(*[F.lit(x) for x in labels])
    return df.filter(
        F.coalesce(F.arrays_overlap(F.coalesce(F.col("labels"), F.array().cast("array<string>")), wanted), F.lit(False))
    )


def date_key(c: str | Column = "date") -> Column:
    """Parsed record date; NULL when not an ISO ``YYYY-MM-DD`` calendar date."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def sort_order(order: str = "newest") -> list[Column]:
    key = date_key()
    first = key.desc_nulls_last() if order == "newest" else key.asc_nulls_last()
    return [first, F.col("seq").asc()]


def sort_by_date(df: DataFrame, order: str = "newest", total_col: str | None = None, bound: int = 0) -> DataFrame:
    """O.64: newest/oldest, unparseable dates last in both orders, stable."""
    return with_position(df, *sort_order(order), total_col=total_col, bound=bound)


def validate_state(query=None, source=None, labels=None, order=None) -> tuple[str, str, list[str], str]:
    """O.69 parameter check: bad values fall back to the defaults."""
    q = query if isinstance(query, str) else ""
    s = source if source in (["ALL"] + rules.SOURCES) else "ALL"
    ls = list(labels) if isinstance(labels, (list, tuple)) else []
    o = order if order in ("newest", "oldest") else "newest"
    return q, s, ls, o


def matches(df: DataFrame, text: str = "", source: str = "ALL", labels: list[str] | None = None,
            cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """The rows of a query without their order.  The source filter comes first:
    it prunes a stored table's directories, and over unstored labels it moves
    below the labelling, so only that source's rows are labelled."""
    return filter_labels(search(filter_source(df, source), text, cfg), labels)


def query(df: DataFrame, text: str = "", source: str = "ALL", labels: list[str] | None = None,
          order: str = "newest", cfg: SearchConfig = SearchConfig(), total_col: str | None = None,
          columns: list[str] | None = None) -> DataFrame:
    """O.69: search -> source -> labels -> sort; rows carry ``pos`` (and the
    number of matched rows in ``total_col`` when given).  ``columns`` narrows
    the matched rows (``seq`` and ``date`` stay, the order needs them)."""
    text, source, labels, order = validate_state(text, source, labels, order)
    out = _stored(matches(df, text, source, labels, cfg), columns)
    return sort_by_date(out, order, total_col=total_col, bound=FEW)


def _stored(matched: DataFrame, columns: list[str] | None) -> DataFrame:
    """The matched rows alone, stored: the sort's sampling pass would
    otherwise label and search the whole input a second time."""
    if columns is not None:
        matched = matched.select(*dict.fromkeys(["seq", "date", *columns]))
    return materialize(matched, "matched")


def query_with_total(df: DataFrame, *args, **kwargs) -> DataFrame:
    """``query`` whose rows also carry ``total_matched``: exact, taken from the
    per-partition counts of the ordering step (an ``observe`` metric would be
    counted again by every re-execution, e.g. a sort's sampling pass)."""
    return query(df, *args, total_col="total_matched", **kwargs)


def feed_view(df: DataFrame, source: str = "ALL", label: str | None = None,
              columns: list[str] | None = None) -> DataFrame:
    """O.22: the feed of all actions, by source, label or both, newest first."""
    out = filter_labels(filter_source(df, source), [label] if label else [])
    return sort_by_date(_stored(out, columns), "newest", bound=FEW)


def source_view(df: DataFrame, source: str) -> DataFrame:
    """O.75: rows of ``source``; falls back to ALL when that source is empty."""
    return df.sparkSession.sql(
        "SELECT * FROM {t} WHERE source_system = :s "
        "OR NOT EXISTS (SELECT 1 FROM {t} WHERE source_system = :s)",
        args={"s": source}, t=df,
    )
