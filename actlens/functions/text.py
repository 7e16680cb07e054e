"""Unicode-aware string column helpers (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as Python's ``str.isspace`` / ``re`` ``\s`` see it: ASCII
# controls, the 0x1C-0x1F separators, NEL and every Unicode separator.
# Spark's ``trim`` removes only spaces and Java's ``\s`` is ASCII-only.
WS = r"[\t\n\x0B\f\r\x{1C}-\x{1F}\x{85}\p{Z}]"
# The same characters one by one.
_WS_CHARS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utrim(c: str | Column) -> Column:
    """Strip leading/trailing Unicode whitespace; reads the ends alone."""
    return F.btrim(col_(c), F.lit(_WS_CHARS))


def collapse_ws(c: str | Column) -> Column:
    """Trim, then turn every whitespace run into a single space.

    A run that is one space stays as it is, so only the other runs are replaced."""
    return F.regexp_replace(utrim(c), rf" {WS}+|[{WS}&&[^ ]]{WS}*", " ")


def nonempty(c: str | Column) -> Column:
    """NULL for NULL or empty strings, else the value (Python truthiness)."""
    c = col_(c)
    return F.when(c != "", c)


def zfill(c: str | Column, width: int) -> Column:
    """Left pad with zeros that never truncates (``str.zfill`` semantics
    for digit strings; Spark's ``lpad`` cuts longer values)."""
    c = col_(c)
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def regex_quote(text: str) -> str:
    """Escape a literal for a Java / RE2 pattern (no ``\\Q..\\E`` so the same
    pattern text runs in both engines)."""
    out = []
    for ch in text:
        if ch.isalnum() or ch == "_" or ord(ch) > 127:
            out.append(ch)
        elif ch == " ":
            out.append(" ")
        else:
            out.append("\\" + ch)
    return "".join(out)


def first_match(c: Column, table: list[tuple[str, str]], default: Column | str | None = None,
                contains: bool = True) -> Column:
    """Ordered "first keyword contained wins" lookup, as one CASE chain.

    ``table`` is a fixed list of (keyword, value); rank = list order.
    """
    expr = None
    for key, value in table:
        cond = c.contains(key) if contains else (c == key)
        expr = F.when(cond, F.lit(value)) if expr is None else expr.when(cond, F.lit(value))
    if expr is None:
        return F.lit(default) if not isinstance(default, Column) else default
    if default is None:
        return expr
    return expr.otherwise(default if isinstance(default, Column) else F.lit(default))


def map_lookup(c: Column, table: list[tuple[str, str]]) -> Column:
    """Exact-key lookup in a fixed dictionary (NULL when absent)."""
    m = F.create_map(*[F.lit(x) for kv in table for x in kv])
    return F.try_element_at(m, c)
