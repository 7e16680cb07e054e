"""Date normalisation (O.44): ordered format lists, first parse wins.

Each format is written in ``strptime`` notation and becomes a regex shape
guard (``strptime`` rules: 4-digit year, 1-2 digit month/day, month names in
any case, a blank in the format matches any whitespace run) plus a
``try_to_date`` with the equivalent Spark pattern (calendar check).  All
JVM-side; no Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from actlens.functions.text import WS, utrim

_MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August",
           "September", "October", "November", "December"]
_DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

_CODES = {
    "%Y": (r"\d{4}", "yyyy"),
    "%m": (r"(?:1[0-2]|0[1-9]|[1-9])", "M"),
    "%d": (r"(?:3[01]|[12]\d|0[1-9]|[1-9])", "d"),
    "%B": ("(?:" + "|".join(_MONTHS) + ")", "MMMM"),
    "%b": ("(?:" + "|".join(m[:3] for m in _MONTHS) + ")", "MMM"),
    "%H": (r"(?:2[0-3]|[01]\d|\d)", "H"),
    "%M": (r"(?:[0-5]\d|\d)", "m"),
    "%S": (r"(?:6[01]|[0-5]\d|\d)", "s"),
    "%A": ("(?:" + "|".join(_DAYS) + ")", None),
    "%a": ("(?:" + "|".join(d[:3] for d in _DAYS) + ")", None),
}

# --- FIXED VALUES: format lists per profile, in the reference's order -----
PROFILES = {
    "validator": ["%Y-%m-%d", "%d/%m/%Y", "%d-%m-%Y", "%Y/%m/%d", "%d %B %Y", "%d %b %Y", "%B %d, %Y"],
    "bill": ["%Y-%m-%d", "%d/%m/%Y", "%d-%m-%Y", "%d %B %Y", "%d %b %Y", "%B %d, %Y"],
    "notice": ["%Y-%m-%d", "%d/%m/%Y", "%d-%m-%Y", "%d %B %Y", "%d %b %Y", "%B %d, %Y",
               "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%SZ"],
    "act": ["%Y-%m-%d", "%d/%m/%Y", "%d-%m-%Y", "%d %B %Y", "%d %b %Y"],
    "commencement": ["%d/%m/%Y", "%d-%m-%Y", "%Y-%m-%d", "%d %B %Y", "%d %b %Y"],
    "release": ["%Y-%m-%d", "%d/%m/%Y", "%d-%m-%Y", "%d %B %Y", "%d %b %Y", "%B %d, %Y", "%b %d, %Y",
                "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%SZ", "%d %B %Y - %H:%M", "%A, %d %B %Y", "%A %d %B %Y"],
}
# Profiles that first delete characters outside [\w\s,/:T-].
CLEANED = {"notice", "release"}


def _compile(fmt: str) -> tuple[str, str]:
    """strptime format -> (anchored case-insensitive regex, Spark pattern)."""
    rx, sp, i = [], [], 0
    while i < len(fmt):
        if fmt[i] == "%" and fmt[i:i + 2] in _CODES:
            r, p = _CODES[fmt[i:i + 2]]
            rx.append(r)
            if p is None:  # weekday: shape-checked, not parsed (no calendar check on it)
                sp.append(None)
            else:
                sp.append(p)
            i += 2
            continue
        ch = fmt[i]
        if ch.isspace():
            rx.append(f"{WS}+")
            sp.append(" ")
        else:
            rx.append("\\" + ch if not ch.isalnum() else ch)
            sp.append("'" + ch + "'" if ch.isalpha() else ch)
        i += 1
    return "(?i)^" + "".join(rx) + "$", sp


def _parse_one(s: Column, fmt: str) -> Column:
    regex, parts = _compile(fmt)
    # Pieces that Spark parses: drop weekday names (and the separator after
    # them) by rebuilding the string from captured fields.
    if None in parts:
        # weekday formats: cut the leading weekday token, parse the rest
        rest_fmt = fmt.split("%A", 1)[1].lstrip(",").lstrip() if "%A" in fmt else fmt.split("%a", 1)[1].lstrip(",").lstrip()
        _, rest_parts = _compile(rest_fmt)
        tail = F.regexp_replace(s, r"(?i)^[A-Za-z]+,?" + f"{WS}+", "")
        pattern = "".join(rest_parts)
        return F.when(s.rlike(regex), F.try_to_date(F.regexp_replace(tail, f"{WS}+", " "), pattern))
    pattern = "".join(parts)
    return F.when(s.rlike(regex), F.try_to_date(F.regexp_replace(s, f"{WS}+", " "), pattern))


def parse_date(c: Column, profile: str = "validator") -> Column:
    """First format of ``profile`` that parses (DateType), else NULL."""
    s = utrim(c)
    if profile in CLEANED:
        s = F.regexp_replace(s, r"(?U)[^\w\s,/:T-]", "")
    if profile == "act":
        # a capital T anywhere: the part before it must be Y-m-d
        before_t = F.substring_index(c, "T", 1)
        return F.when(c.contains("T"), _parse_one(before_t, "%Y-%m-%d")).otherwise(
            F.coalesce(*[_parse_one(s, f) for f in PROFILES["act"]])
        )
    return F.coalesce(*[_parse_one(s, f) for f in PROFILES[profile]])


def normalise_date(c: Column, profile: str = "validator") -> Column:
    """ISO ``YYYY-MM-DD`` string or NULL."""
    return F.date_format(parse_date(c, profile), "yyyy-MM-dd")


_RFC_MONTHS = "|".join(m[:3] for m in _MONTHS)


def rfc2822_date(c: Column) -> Column:
    """RFC 2822 feed dates (``Mon, 15 Dec 2025 10:00:00 +1300``): the local
    calendar date as written (weekday optional)."""
    rx = rf"(?i)^\s*(?:[A-Za-z]{{3}},\s*)?(\d{{1,2}})\s+({_RFC_MONTHS})\s+(\d{{4}})(?:\s|$)"
    day, mon, year = (F.regexp_extract(c, rx, i) for i in (1, 2, 3))
    return F.when(c.rlike(rx), F.try_to_date(F.concat_ws(" ", day, mon, year), "d MMM yyyy"))
