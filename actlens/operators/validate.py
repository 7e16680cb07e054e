"""Validation and repair (O.45a-l), summary (O.46) and schema check (O.47).

Row-local column expressions only: no shuffle.  ``_errors`` lists the
messages of every failed rule and ``_fixed`` says whether any value was
repaired.  Strict mode keeps only rows without errors (the rejected rows are
available through ``split_strict``).  The reference's list index in messages
and generated ids is the arrival order ``seq``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actlens import rules
from actlens.functions.dates import normalise_date
from actlens.functions.text import collapse_ws, first_match, map_lookup, utrim, zfill
from actlens.operators.labels import let

ID_RE = r"^[a-z]{3,8}-\d{4}-\d{3,6}$"
ID_RE_VERSIONED = r"^[a-z]{3,8}-\d{4}-\d{3,6}(?:-v\d+)?$"
URL_RE = (r"(?i)^https?://(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+[A-Z]{2,6}\.?|localhost|"
          r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?::\d+)?(?:/?|[/?]\S+)$")
ISO_RE = r"^\d{4}-\d{2}-\d{2}$"
META_STRINGS = ["bill_number", "act_number", "commencement_date", "notice_number", "notice_type",
                "document_type", "portfolio", "version"]


def _falsy(c: Column) -> Column:
    return c.isNull() | (c == "")


def _err(cond: Column, msg: Column) -> Column:
    return F.when(cond, msg)


def _item(msg: str, *vals: Column) -> Column:
    return F.concat(F.lit("Item "), F.col("seq").cast("string"), F.lit(f": {msg}"), *vals)


def run_date_lit(run_ts: dt.datetime) -> Column:
    return F.lit(run_ts.strftime("%Y-%m-%d"))


def validate(df: DataFrame, run_ts: dt.datetime, strict: bool = False) -> DataFrame:
    """O.45: repair records; adds ``_errors`` and ``_fixed``."""
    title0, url0, src0, id0, date0 = (F.col(c) for c in ("title", "url", "source_system", "id", "date"))
    run_date = run_date_lit(run_ts)

    # 1. required fields
    missing = [_err(_falsy(F.col(f)), _item(f"Missing required field '{f}'")) for f in ("title", "url", "source_system")]

    # 2. source system: exact, alias, else BEEHIVE + error; missing -> from URL
    alias = map_lookup(F.lower(src0), rules.SOURCE_ALIASES)
    known = src0.isin(rules.SOURCES)
    src_from_url = first_match(F.lower(F.coalesce(url0, F.lit(""))), rules.URL_SOURCE, "BEEHIVE")
    source = (F.when(_falsy(src0), src_from_url)
              .when(known, src0).when(alias.isNotNull(), alias).otherwise(F.lit("BEEHIVE")))
    src_err = _err(~_falsy(src0) & ~known & alias.isNull(), _item("Invalid source_system '", src0, F.lit("'")))

    # 3. id: keep, clean, or generate
    cleaned = F.lower(F.regexp_replace(id0, "[^a-zA-Z0-9-]", ""))
    prefix = F.coalesce(map_lookup(source, rules.ID_PREFIX), F.lit("unknown"))
    year = F.when(~_falsy(date0) & (F.length(date0) >= 4), F.substring(date0, 1, 4)).otherwise(
        F.lit(str(run_ts.year)))
    # the reference appends clock milliseconds; a hash of the URL keeps it reproducible
    number = F.concat(zfill(F.col("seq").cast("string"), 3),
                      F.lpad(F.pmod(F.xxhash64(F.coalesce(url0, F.lit(""))), F.lit(1000)).cast("string"), 3, "0"))
    generated = F.concat_ws("-", prefix, year, number)
    new_id = (F.when(_falsy(id0), generated).when(id0.rlike(ID_RE), id0)
              .when(cleaned.rlike(ID_RE), cleaned).otherwise(id0))
    id_err = _err(~_falsy(id0) & ~id0.rlike(ID_RE) & ~cleaned.rlike(ID_RE),
                  _item("Invalid ID format '", id0, F.lit("'")))

    # 4. date: validator formats, else an ISO-shaped string as is, else run date
    parsed = normalise_date(date0, "validator")
    stripped = utrim(date0)
    new_date = (F.when(_falsy(date0), run_date).when(parsed.isNotNull(), parsed)
                .when(stripped.rlike(ISO_RE), stripped).otherwise(run_date))
    date_err = _err(~_falsy(date0) & parsed.isNull() & ~stripped.rlike(ISO_RE),
                    _item("Invalid date format '", date0, F.lit("'")))

    # 5. url: trim, add https:// to bare hosts, check
    u = utrim(url0)
    fixed_url = (F.when(u.startswith("http://") | u.startswith("https://"), u)
                 .when(u.startswith("www."), F.concat(F.lit("https://"), u))
                 .when(u.contains(".") & ~u.startswith("/"), F.concat(F.lit("https://"), u))
                 .otherwise(u))
    new_url = F.when(_falsy(url0), url0).otherwise(fixed_url)
    url_err = _err(~_falsy(url0) & ~fixed_url.rlike(URL_RE), _item("Invalid URL format '", fixed_url, F.lit("'")))

    # 6. title: collapse whitespace, strip leading boilerplate words
    prefixes = "|".join(p.strip() + " " for p in rules.TITLE_PREFIXES)
    new_title = F.when(_falsy(title0), title0).otherwise(
        F.regexp_replace(collapse_ws(title0), f"(?i)^(?:{prefixes})+", ""))

    # 7. primary entity: portfolio minister, gazette appointment, per-source default
    portfolio = F.col("metadata.portfolio")
    entity_guess = F.coalesce(
        F.when(~_falsy(portfolio), map_lookup(portfolio, rules.PORTFOLIO_MINISTER)),
        F.when((source == "GAZETTE") & F.lower(F.coalesce(new_title, F.lit(""))).contains("appointment"),
               F.lit("Governor-General")),
        map_lookup(source, rules.SOURCE_ENTITY),
        F.lit("Government"),
    )
    ent0 = F.col("primary_entity")
    new_entity = F.when(_falsy(ent0), entity_guess).otherwise(ent0)

    # 8. summary: collapse whitespace, cap at 1000 characters.  The collapse
    # runs over whole texts, so it is bound once (``let``) and the result
    # carries its own "changed" flag.
    summary0 = F.col("summary")

    def _cap(s):
        capped = F.when(F.length(s) > 1000, F.concat(F.substring(s, 1, 997), F.lit("..."))).otherwise(s)
        return F.struct(capped.alias("v"), F.coalesce(capped != summary0, F.lit(False)).alias("changed"))

    summary_fix = F.when(_falsy(summary0), F.struct(summary0.alias("v"), F.lit(False).alias("changed"))) \
        .otherwise(let(collapse_ws(summary0), _cap))

    # 9. labels: predefined only, distinct, sorted
    labels0 = F.coalesce(F.col("labels"), F.array().cast("array<string>"))
    predefined = F.array(*[F.lit(x) for x in rules.LABELS])
    new_labels = F.sort_array(F.array_distinct(F.filter(labels0, lambda x: F.array_contains(predefined, x))))
    label_errs = F.transform(
        F.filter(labels0, lambda x: ~F.array_contains(predefined, x)),
        lambda x: _item("Unknown label '", x, F.lit("'")),
    )

    # 10. metadata: trimmed strings, empty -> NULL
    meta_fields = []
    meta_changed = F.lit(False)
    for f in df.schema["metadata"].dataType.fieldNames():
        c = F.col(f"metadata.{f}")
        if f in META_STRINGS:
            new = F.when(c.isNull() | (c == ""), F.lit(None).cast("string")).otherwise(utrim(c))
            meta_changed = meta_changed | F.coalesce(c != F.coalesce(new, F.lit("\u0000")), F.lit(False))
            meta_fields.append(new.alias(f))
        else:
            meta_fields.append(c.alias(f))
    new_meta = F.struct(*meta_fields)

    errors = F.concat(
        F.filter(F.array(*missing, src_err, id_err, date_err, url_err), lambda x: x.isNotNull()),
        label_errs,
    )
    changed = [
        F.coalesce(source != src0, F.lit(True)),  # inferred or normalised
        F.coalesce(new_id != id0, F.lit(True)),
        F.coalesce(new_date != date0, F.lit(True)),
        F.coalesce(new_url != url0, F.lit(False)),
        F.coalesce(new_title != title0, F.lit(False)),
        _falsy(ent0),
        F.col("_summary_fix.changed"),
        (F.size(labels0) > 0) & (new_labels != labels0),
        meta_changed,
    ]
    fixed = changed[0]
    for c in changed[1:]:
        fixed = fixed | c
    staged = df.withColumn("_summary_fix", summary_fix)
    out = staged.withColumns({
        "title": new_title, "url": new_url, "source_system": source, "id": new_id, "date": new_date,
        "primary_entity": new_entity, "summary": F.col("_summary_fix.v"), "labels": new_labels, "metadata": new_meta,
        "_errors": errors, "_fixed": fixed,
    }).drop("_summary_fix")
    if strict:
        out = out.filter(F.size("_errors") == 0)
    return out


def split_strict(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted / rejected rows of a non-strict ``validate`` result."""
    ok = F.size("_errors") == 0
    return validated.filter(ok), validated.filter(~ok)


def validation_summary(validated: DataFrame, strict: bool = False) -> DataFrame:
    """O.46: one row -- error count, fixed count, error count the reference
    reports (only strict mode records row errors, S.14)."""
    n_err = F.sum(F.size("_errors")).cast("long")
    return validated.agg(
        n_err.alias("row_errors"),
        F.sum(F.col("_fixed").cast("int")).cast("long").alias("items_fixed"),
        (n_err if strict else F.lit(0).cast("long")).alias("total_errors"),
        F.count(F.lit(1)).alias("rows"),
    )


def validation_messages(validated: DataFrame) -> DataFrame:
    """O.46: the error list -- row number, place in the row's list and message."""
    return validated.select("seq", F.posexplode("_errors").alias("place", "message"))


def fixed_rows(validated: DataFrame) -> DataFrame:
    """O.46: numbers of the rows in which a value was changed."""
    return validated.filter("_fixed").select("seq")


def schema_check(df: DataFrame) -> DataFrame:
    """O.47: keep records the record schema accepts; ``reject_reason`` NULL.

    Use ``schema_rejects`` for the quarantine side."""
    return df.withColumn("reject_reason", reject_reason()).filter(F.col("reject_reason").isNull())


def schema_rejects(df: DataFrame) -> DataFrame:
    return df.withColumn("reject_reason", reject_reason()).filter(F.col("reject_reason").isNotNull())


def _strict_iso(c: Column) -> Column:
    """``strptime(v, '%Y-%m-%d')`` acceptance: 4-digit year, 1-2 digit parts, real date."""
    shape = c.rlike(r"^\d{4}-(?:1[0-2]|0[1-9]|[1-9])-(?:3[01]|[12]\d|0[1-9]|[1-9])$")
    return F.coalesce(shape & F.try_to_date(c, "yyyy-M-d").isNotNull(), F.lit(False))


def reject_reason() -> Column:
    """The first field that the record schema refuses; NULL for an accepted record."""
    hist = F.col("metadata.stage_history")
    bad_stage = F.coalesce(F.exists(hist, lambda s: _falsy(s["stage"]) | ~_strict_iso(s["date"])), F.lit(False))
    commence = F.col("metadata.commencement_date")
    return (
        F.when(F.col("id").isNull() | ~F.col("id").rlike(ID_RE_VERSIONED), F.lit("id"))
        .when(F.col("title").isNull(), F.lit("title"))
        .when(~_strict_iso(F.col("date")), F.lit("date"))
        .when(~F.col("source_system").isin(rules.SOURCES) | F.col("source_system").isNull(), F.lit("source_system"))
        .when(F.col("url").isNull() | ~F.col("url").rlike(URL_RE), F.lit("url"))
        .when(F.col("primary_entity").isNull(), F.lit("primary_entity"))
        .when(F.col("summary").isNull(), F.lit("summary"))
        .when(bad_stage, F.lit("stage_history"))
        .when(commence.isNotNull() & ~_strict_iso(commence), F.lit("commencement_date"))
    )
