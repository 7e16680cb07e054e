"""Combining sources (O.12 - O.16)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actlens import rules

_SALTS = 64


def first_nonempty(df: DataFrame, source_col: str = "source_system", tier_col: str = "tier") -> DataFrame:
    """O.12: per source, keep the rows of the first (lowest) tier that has rows."""
    # one row per distinct source; no broadcast hint -- its size depends on
    # the data, so AQE picks a broadcast at runtime only when it is small
    best = df.groupBy(source_col).agg(F.min(tier_col).alias("_best"))
    return df.join(best, source_col).filter(F.col(tier_col) == F.col("_best")).drop("_best")


@dataclass(frozen=True)
class Cascade:
    """What a cascade read: the rows, the tiers they are from, and what the tiers that raised said."""

    rows: DataFrame | None
    used: list[int]
    problems: dict[int, str]


def cascade(tiers: Sequence[Callable[[], DataFrame]], least: int = 1, add: bool = False) -> Cascade:
    """O.12, O.3 with readers: a source's tiers are read one after another until one has ``least`` rows.

    A tier is probed for that many rows, no more, so its read stops there; later tiers' readers aren't called.  A tier
    that raises counts as empty.  With too few rows everywhere the first tier that has any gives its rows; with ``add``
    the tiers read so far are put together instead, and ``least`` is of them all (the person feeds are added so to
    main feeds with fewer rows than the limit)."""
    used: list[int] = []
    frames: list[DataFrame] = []
    problems: dict[int, str] = {}
    have = 0
    for k, read in enumerate(tiers):
        try:
            df = read()
            n = df.limit(least).count()  # the probe
        except Exception as e:  # noqa: BLE001 - a tier that can't be read is one without rows
            problems[k] = f"{type(e).__name__}: {(str(e).strip().splitlines() or [''])[0]}"
            continue
        if not n:
            continue
        if n >= least and not add:
            return Cascade(df, [k], problems)
        used, frames, have = [*used, k], [*frames, df], have + n
        if add and have >= least:
            break
    if not frames:
        return Cascade(None, [], problems)
    if not add:
        return Cascade(frames[0], used[:1], problems)
    return Cascade(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames), used, problems)


def cascade_sources(sources: dict[str, Sequence[Callable[[], DataFrame]]], least: int = 1) -> DataFrame | None:
    """The cascade of each source, with its name and the tier that gave its rows (``source_system``, ``tier``, from 1)."""
    out = None
    for name, tiers in sources.items():
        found = cascade(tiers, least)
        if found.rows is not None:
            tagged = found.rows.withColumns({"source_system": F.lit(name), "tier": F.lit(found.used[0] + 1)})
            out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def union_sources(*parts: tuple[str, DataFrame]) -> DataFrame:
    """O.13: tag each part with its source and append in the fixed source
    order; ``seq`` = (source rank, position within the part)."""
    out = None
    for name, df in parts:
        rank = rules.SOURCES.index(name) if name in rules.SOURCES else len(rules.SOURCES)
        tagged = df.withColumns({"source_system": F.lit(name), "source_rank": F.lit(rank)})
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def limit_per_source(df: DataFrame, n: int | None, order: str = "seq", source_col: str = "source_system") -> DataFrame:
    """O.14: first ``n`` rows per source in arrival order; None or 0 = no limit.

    Two steps for any ``n``: a source's rows are dealt over ``_SALTS`` groups,
    each of which keeps its first ``n``, and the first ``n`` of those stay.  A
    source holding a third of all rows so reaches one task with at most
    ``_SALTS * n`` of them."""
    if not n:
        return df
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(_SALTS)))
    for group in ([source_col, "_salt"], [source_col]):
        w = Window.partitionBy(*group).orderBy(F.col(order))
        salted = salted.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
    return salted.drop("_salt")


def enrich_from_detail(listing: DataFrame, detail: DataFrame, key: str = "url") -> DataFrame:
    """O.15: add detail fields by URL; rows without detail are unchanged.
    The detail side is reduced to one row per URL first (its first arrival)."""
    cols = [c for c in detail.columns if c != key]
    one = detail.groupBy(key).agg(F.min_by(F.struct(*cols), F.col("seq") if "seq" in cols else F.lit(0)).alias("_d"))
    enriched = listing.join(one, key, "left")
    updates = {c: F.coalesce(F.col(f"_d.{c}"), F.col(c)) if c in listing.columns else F.col(f"_d.{c}")
               for c in cols if c != "seq"}
    return enriched.withColumns(updates).drop("_d")


def absolute_url(base: Column, href: Column) -> Column:
    """O.16: links not starting with 'http' are resolved against the page:
    root-relative onto the site root, relative onto the page's folder."""
    site = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^?#]*/)", 1)
    return (F.when(href.startswith("http"), href)
            .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), href))
            .when(href.startswith("/"), F.concat(site, href))
            .otherwise(F.concat(F.when(folder != "", folder).otherwise(F.concat(site, F.lit("/"))), href)))
