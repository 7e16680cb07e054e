"""DuckDB oracle SQL fragments (written from the rules, not from the Spark code).

These texts run in DuckDB over the driver's pre-registered views.  Regexes
are RE2: word boundaries are spelled ``(^|[^\\p{L}\\p{N}_])`` because RE2's
``\\b`` is ASCII-only while the reference's is Unicode-aware.
"""

from __future__ import annotations

from actlens import rules
from actlens.adapter import adapter_sql

WS = r"[\t\n\x0B\f\r\x{1C}-\x{1F}\x{85}\p{Z}]"
NW = r"[^\p{L}\p{N}_]"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def ustrip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{WS}+|{WS}+$', '', 'g')"


def re_escape(s: str) -> str:
    out = []
    for ch in s:
        out.append(ch if (ch.isalnum() or ch in " _" or ord(ch) > 127) else "\\" + ch)
    return "".join(out)


def word_any(expr: str, keywords: list[str]) -> str:
    alts = "|".join(re_escape(k) for k in keywords)
    return f"regexp_matches({expr}, {q(f'(^|{NW})(?:{alts})($|{NW})')})"


def case_map(expr: str, table: list[tuple[str, str]], default: str = "NULL", contains: bool = False) -> str:
    parts = []
    for k, v in table:
        cond = f"contains({expr}, {q(k)})" if contains else f"{expr} = {q(k)}"
        parts.append(f"WHEN {cond} THEN {q(v)}")
    return "CASE " + " ".join(parts) + f" ELSE {default} END"


ADAPTER = adapter_sql("documents")

_LABEL_TEXT = (
    "lower(concat_ws(' ', {t}, {t}, {t}, nullif({s}, ''), nullif({e}, ''), nullif(bill_number, ''), "
    "nullif(act_number, ''), nullif(commencement_date, ''), nullif(notice_number, ''), nullif(notice_type, ''), "
    "nullif(document_type, ''), nullif(portfolio, ''), nullif(version, ''), nullif(portfolio, ''), nullif(portfolio, '')))"
).format(t=f"nullif({ustrip('title')}, '')", s=ustrip("summary"), e=ustrip("primary_entity"))


def _slug(label: str) -> str:
    return "k_" + label.lower().replace(" ", "_")


def labelled_ctes(source: str = "a") -> str:
    """CTEs ``lt`` (label text + keyword flags) and ``lab`` (final labels,
    ``labels`` as a sorted list) over the flat action CTE ``source``."""
    kw = ",\n    ".join(
        f"{word_any('label_text', kws)} AS {_slug(label)}" for label, kws in rules.LABEL_KEYWORDS.items()
    )
    plabel = case_map("portfolio", rules.PORTFOLIO_LABEL)
    flags = {}
    lt = "lower(coalesce(title, ''))"
    for label in rules.LABELS:
        flags[label] = [_slug(label)]
        flags[label].append(f"coalesce(({plabel}) = {q(label)}, false)")
    appoint = f"(source_system = 'GAZETTE' AND (contains({lt}, 'appointment') OR contains({lt}, 'appoint')))"
    judge = f"(contains({lt}, 'judge') OR contains({lt}, 'court'))"
    flags["Justice"].append(f"({appoint} AND {judge})")
    flags["Health"].append(f"({appoint} AND NOT {judge} AND contains({lt}, 'health'))")
    flags["Tax"].append(f"(contains({lt}, 'taxation') OR contains({lt}, 'tax'))")
    flags["Treaty of Waitangi"].append(f"(contains({lt}, 'treaty principles') OR contains({lt}, 'waitangi'))")
    flags["Justice"].append(f"(contains({lt}, 'gang') AND contains({lt}, 'legislation'))")
    h = {label: "(" + " OR ".join(v) + ")" for label, v in flags.items()}
    combined = f"({lt} || ' ' || lower(coalesce(summary, '')))"
    h2 = dict(h)
    h2["Housing"] = f"({h['Housing']} OR ({h['Infrastructure']} AND contains({lt}, 'housing')))"
    h2["Agriculture"] = (
        f"({h['Agriculture']} OR ({h['Economy']} AND (contains({combined}, 'agriculture') OR "
        f"contains({combined}, 'farming') OR contains({combined}, 'rural'))))"
    )
    any_label = " OR ".join(h2.values())
    h2["Economy"] = (
        f"({h2['Economy']} OR (NOT ({any_label}) AND source_system = 'LEGISLATION' AND contains({lt}, 'amendment') "
        f"AND NOT (contains({lt}, 'health') OR contains({lt}, 'education') OR contains({lt}, 'housing'))))"
    )
    items = ", ".join(f"CASE WHEN {h2[label]} THEN {q(label)} END" for label in rules.LABELS)
    return f"""lt AS (
  SELECT {source}.*, {_LABEL_TEXT} AS label_text FROM {source}
), ltk AS (
  SELECT lt.*,
    {kw}
  FROM lt
), lab AS (
  SELECT ltk.* EXCLUDE (labels_in),
    CASE WHEN label_text = '' THEN []::VARCHAR[]
         ELSE list_sort(list_filter([{items}], lambda x: x IS NOT NULL)) END AS labels
  FROM ltk
)"""


def with_labelled(select: str) -> str:
    return f"WITH a AS ({ADAPTER}),\n{labelled_ctes('a')}\n{select}"


def with_actions(select: str) -> str:
    return f"WITH a AS ({ADAPTER})\n{select}"
