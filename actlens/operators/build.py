"""Per-source record construction (O.23 - O.43): pure column expressions.

Clock-dependent parts of the reference (run year, run date, clock digits)
come from the ``run_ts`` parameter, never from ``current_date()``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actlens import rules
from actlens.functions.dates import normalise_date, rfc2822_date
from actlens.functions.text import first_match, map_lookup, nonempty, utrim, zfill

URL_PATH_RE = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"


def url_path(url: Column) -> Column:
    """``urlparse(url).path``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL_PATH_RE, 1)


def last_path_part(url: Column) -> Column:
    """Last non-empty path segment, NULL when there is none."""
    parts = F.filter(F.split(url_path(url), "/"), lambda p: p != "")
    return F.try_element_at(parts, F.lit(-1))


def _extract(c: Column, pattern: str, group: int = 1) -> Column:
    """First match group or NULL (Spark returns '' on no match)."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


# ----------------------------------------------------------------- acts
def clean_version(c: Column) -> Column:
    """O.30: first number in the text, else '1' (S.4: 'as at 27 ...' -> 27)."""
    return F.when(nonempty(c).isNull(), F.lit("1")).otherwise(F.coalesce(_extract(c, r"(\d+)\.?\d*"), F.lit("1")))


def parse_content_fields(content: Column) -> dict[str, Column]:
    """O.28: the six ``Key: value`` fields of an act feed entry."""
    return {
        "c_year": _extract(content, r"Year:\s*(\d{4})"),
        "c_number": _extract(content, r"No:\s*(\d+)"),
        "c_version": utrim(_extract(content, r"Version:\s*([^<]+)")),
        "c_current_as_at": utrim(_extract(content, r"Current as at date:\s*([^<]+)")),
        "c_status": utrim(_extract(content, r"Status:\s*([^<]+)")),
        "c_legislation_type": utrim(_extract(content, r"Legislation type:\s*([^<]+)")),
    }


def act_parts_from_url(url: Column, run_ts: dt.datetime) -> dict[str, Column]:
    """O.29: year (else run year), number without leading zeros, version."""
    num = _extract(url, r"/act/public/\d{4}/(\d+)/")
    return {
        "u_year": F.coalesce(_extract(url, r"/act/public/(\d{4})/"), F.lit(str(run_ts.year))),
        "u_number": F.coalesce(F.regexp_replace(num, "^0+(?=\\d)", ""), F.lit("")),
        "u_version": F.coalesce(_extract(url, r"/(\d+)\.0/"), _extract(url, r"/version/(\d+)"), F.lit("1")),
    }


def act_entity(title: Column) -> Column:
    """O.31: first keyword contained in the lower-cased title, else Parliament."""
    return first_match(F.lower(title), rules.ACT_ENTITY, "Parliament")


def parse_act_entry(raw: DataFrame, run_ts: dt.datetime) -> DataFrame:
    """O.1 row step: feed entry -> raw act item (entries without
    'Information type: Acts' are dropped)."""
    c = parse_content_fields(F.col("content"))
    u = act_parts_from_url(F.col("url"), run_ts)
    year = F.coalesce(c["c_year"], u["u_year"])
    number = F.coalesce(c["c_number"], u["u_number"])
    version = F.coalesce(c["c_version"], u["u_version"])
    act_number = F.when(nonempty(year).isNotNull() & nonempty(number).isNotNull(),
                        F.concat(year, F.lit(" No "), number)).otherwise(F.lit(""))
    return raw.filter(F.col("content").contains("Information type: Acts")).select(
        "seq", utrim(F.coalesce("title", F.lit(""))).alias("title"), "url",
        act_number.alias("act_number"), year.alias("year"), number.alias("number"),
        act_entity(F.coalesce("title", F.lit(""))).alias("primary_entity"),
        F.coalesce(normalise_date(F.col("published"), "act"), F.lit(run_ts.strftime("%Y-%m-%d"))).alias("date"),
        "published", c["c_current_as_at"].alias("current_as_at"), version.alias("version"),
    )


def build_act(raw: DataFrame, run_ts: dt.datetime) -> DataFrame:
    """O.23: ``leg-{year}-{number:03}-v{version}`` records."""
    version = clean_version(F.col("version"))
    base = F.concat(F.lit("leg-"), F.col("year"), F.lit("-"), zfill(F.col("number"), 3))
    commence = F.when(nonempty(F.col("current_as_at")).isNotNull(),
                      normalise_date(F.col("current_as_at"), "commencement"))
    return raw.select(
        "seq", F.concat(base, F.lit("-v"), version).alias("id"), "title",
        F.coalesce(nonempty(F.col("date")), F.lit(run_ts.strftime("%Y-%m-%d"))).alias("date"),
        F.lit("LEGISLATION").alias("source_system"), "url",
        F.coalesce("primary_entity", F.lit("Parliament")).alias("primary_entity"),
        F.concat(F.lit("Version "), version, F.lit(" of "), F.col("title")).alias("summary"),
        F.struct(F.col("act_number"), commence.alias("commencement_date"), version.alias("version")).alias("metadata"),
        version.alias("version"), base.alias("base_id"),
    )


# --------------------------------------------------------------- notices
def notice_info(url: Column) -> dict[str, Column]:
    """O.32: (notice number, notice type) from the first matching URL form."""
    pats = [r"/notice/id/(\d{4})-([a-z]{2})(\d+)", r"/notice/(\d{4})-([a-z]{2})(\d+)", r"/(\d{4})-([a-z]{2})(\d+)"]
    year = F.coalesce(*[_extract(url, p, 1) for p in pats])
    # groups must come from the same (first) matching pattern
    code = F.coalesce(*[F.when(url.rlike(p), F.regexp_extract(url, p, 2)) for p in pats])
    num = F.coalesce(*[F.when(url.rlike(p), F.regexp_extract(url, p, 3)) for p in pats])
    number = F.when(year.isNotNull(), F.concat(year, F.lit("-"), code, num)).otherwise(F.lit(""))
    ntype = F.when(year.isNotNull(), F.coalesce(map_lookup(code, rules.NOTICE_TYPES), F.lit("General"))) \
        .otherwise(F.lit("General"))
    return {"notice_number": number, "notice_type": ntype}


def notice_portfolio(title: Column, creator: Column) -> Column:
    """O.33: first portfolio keyword in 'title creator' (lower-case), else ''."""
    text = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(creator, F.lit(""))))
    return first_match(text, rules.NOTICE_PORTFOLIO, "")


HON_RE = r"Hon\.?\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)"


def notice_entity(title: Column, notice_type: Column) -> Column:
    """O.34: Governor-General, 'Hon X', department keyword, else Government."""
    hon = _extract(title, HON_RE)
    return (F.when(notice_type == "Vice Regal", F.lit("Governor-General"))
            .when(hon.isNotNull(), F.concat(F.lit("Hon "), hon))
            .otherwise(first_match(F.lower(title), rules.NOTICE_DEPARTMENT, "Government")))


def build_notice(raw: DataFrame, run_ts: dt.datetime) -> DataFrame:
    """O.24: ``gaz-{run year}-{last 6 digits, min 3}-v{version}``; no digits
    -> clock digits of ``run_ts``."""
    nn = F.col("notice_number")
    digits = F.regexp_replace(F.coalesce(nn, F.lit("")), "[^0-9]", "")
    last6 = F.when(F.length(digits) > 6, F.substring(digits, -6, 6)).otherwise(digits)
    clean = F.when(last6 == "", F.lit(run_ts.strftime("%m%d%H"))).otherwise(last6)
    year = str(run_ts.year)
    base = F.when(nonempty(nn).isNotNull(), F.concat(F.lit(f"gaz-{year}-"), zfill(clean, 3))) \
        .otherwise(F.lit(f"gaz-{year}-{run_ts.strftime('%H%M%S')[:3]}"))
    version = F.coalesce(F.col("version"), F.lit("1")) if "version" in raw.columns else F.lit("1")
    return raw.select(
        "seq", F.concat(base, F.lit("-v"), version).alias("id"), "title",
        F.coalesce("date", F.lit(run_ts.strftime("%Y-%m-%d"))).alias("date"),
        F.lit("GAZETTE").alias("source_system"), "url",
        F.coalesce("primary_entity", F.lit("Government")).alias("primary_entity"),
        F.coalesce("summary", F.lit("")).alias("summary"),
        F.struct(nn.alias("notice_number"), F.col("notice_type"), F.col("portfolio"), version.alias("version")).alias("metadata"),
        version.alias("version"), base.alias("base_id"),
    )


# ------------------------------------------------------------------ bills
def bill_number(title: Column, url: Column) -> Column:
    """O.35: BILL<n> in the URL, 'Bill n' in the title, last path part, else ''."""
    return F.coalesce(
        _extract(url, r"BILL(\d+)"), _extract(title, r"(?i)Bill\s+(\d+)"),
        F.when(nonempty(url).isNotNull(), last_path_part(url)), F.lit(""))


def parse_stage(text: Column, stage_cell: Column | None = None, date_cell: Column | None = None) -> Column:
    """O.36: 'Stage - Date' (split at the first ' - '), else the stage / date
    cells; the date must normalise (bill profile).  NULL when unusable."""
    has_sep = text.contains(" - ")
    stage = F.when(has_sep, F.substring_index(text, " - ", 1))
    date_s = F.when(has_sep, F.regexp_extract(text, r"(?s)^.*? - (.*)$", 1))
    if stage_cell is not None:
        stage = F.coalesce(nonempty(stage), stage_cell)
    if date_cell is not None:
        date_s = F.coalesce(nonempty(date_s), date_cell)
    iso = normalise_date(date_s, "bill")
    ok = nonempty(stage).isNotNull() & nonempty(date_s).isNotNull() & iso.isNotNull()
    return F.when(ok, F.struct(stage.alias("stage"), iso.alias("date")))


def build_bill(raw: DataFrame, run_ts: dt.datetime) -> DataFrame:
    """O.25: ``parl-{run year}-{first 6 digits, min 3, else 000}-v{version}``;
    date = introduction date normalised, else run date."""
    digits = F.regexp_replace(F.coalesce(F.col("bill_number"), F.lit("000")).cast("string"), "[^0-9]", "")
    first6 = F.substring(digits, 1, 6)
    clean = F.when(first6 == "", F.lit("000")).otherwise(first6)
    base = F.concat(F.lit(f"parl-{run_ts.year}-"), zfill(clean, 3))
    version = F.lit("1")
    run_date = F.lit(run_ts.strftime("%Y-%m-%d"))
    intro = F.col("introduction_date")
    date = F.when(nonempty(intro).isNull(), run_date).otherwise(F.coalesce(normalise_date(intro, "bill"), run_date))
    history = F.col("stage_history") if "stage_history" in raw.columns else F.lit(None).cast(
        "array<struct<stage:string,date:string>>")
    history = F.filter(F.coalesce(history, F.array().cast("array<struct<stage:string,date:string>>")),
                       lambda s: nonempty(s["stage"]).isNotNull() & nonempty(s["date"]).isNotNull())
    return raw.select(
        "seq", F.concat(base, F.lit("-v"), version).alias("id"), "title", date.alias("date"),
        F.lit("PARLIAMENT").alias("source_system"), "url",
        F.coalesce("primary_entity", F.lit("Unknown")).alias("primary_entity"),
        F.coalesce("summary", F.lit("")).alias("summary"),
        F.struct(F.col("bill_number"),
                 F.coalesce(F.col("parliament_number"), F.lit(rules.DEFAULT_PARLIAMENT_NUMBER)).cast("int").alias("parliament_number"),
                 history.alias("stage_history"), version.alias("version")).alias("metadata"),
        version.alias("version"), base.alias("base_id"),
    )


# --------------------------------------------------------------- releases
NAME_SEQ = r"([A-Z][a-z]+ (?:[A-Z][a-z]+ )*[A-Z][a-z]+)"
RT_HON_RE = r"Rt\.?\s+Hon\.?\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)"


def person_in_title(title: Column) -> Column:
    """O.38: 'Hon X', 'Rt Hon X' (unreachable after 'Hon', S.17), surname key, else Government."""
    hon = _extract(title, HON_RE)
    rt = _extract(title, RT_HON_RE)
    return (F.when(hon.isNotNull(), F.concat(F.lit("Hon "), hon))
            .when(rt.isNotNull(), F.concat(F.lit("Rt Hon "), rt))
            .otherwise(first_match(F.lower(title), rules.MINISTER_SURNAMES, "Government")))


def person_in_text(content: Column, title: Column) -> Column:
    """O.37: whole match of the two minister patterns over the text, else O.38."""
    p1 = r"(?:Minister|Hon\.?\s+)" + NAME_SEQ
    p2 = r"(?:Rt\.?\s+Hon\.?\s+)" + NAME_SEQ
    c = F.coalesce(content, F.lit(""))
    return F.coalesce(_extract(c, p1, 0), _extract(c, p2, 0), person_in_title(title))


def portfolio_in_title(title: Column) -> Column:
    """O.39 (listing form): first portfolio keyword in the title, else ''."""
    return first_match(F.lower(title), rules.RELEASE_PORTFOLIO, "")


def portfolio_from_url(url: Column) -> Column:
    """O.39 (URL form): keyword with '-' or '_' for spaces; default General."""
    u = F.lower(url)
    expr = None
    for key, value in rules.RELEASE_PORTFOLIO:
        cond = u.contains(key.replace(" ", "-")) | u.contains(key.replace(" ", "_"))
        expr = F.when(cond, F.lit(value)) if expr is None else expr.when(cond, F.lit(value))
    return F.when(nonempty(url).isNull(), F.lit("General")).otherwise(expr.otherwise(F.lit("General")))


def portfolio_from_feed(tags: Column, title: Column) -> Column:
    """O.39 (feed form): tags first (tag order, then keyword order), then the
    title, default General."""
    def tag_hit(tag):
        return first_match(F.lower(tag), rules.RELEASE_PORTFOLIO, None)
    hits = F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), tag_hit), lambda x: x.isNotNull())
    from_title = nonempty(portfolio_in_title(F.coalesce(title, F.lit(""))))
    return F.coalesce(F.try_element_at(hits, F.lit(1)), from_title, F.lit("General"))


def standardise_doc_type(c: Column) -> Column:
    """O.40: release / speech / feature / announcement -> names, else unchanged."""
    return F.coalesce(map_lookup(F.lower(c), rules.DOCUMENT_TYPES), c)


def feed_doc_type(feed_type: Column) -> Column:
    """Feed name -> document type: title-cased, one trailing 's' removed (S.16)."""
    t = F.initcap(feed_type)
    return F.when(feed_type.endswith("s"), F.regexp_replace(t, "s+$", "")).otherwise(t)


def release_key(url: Column, title: Column, date: Column) -> Column:
    """O.41: ``beehive_`` + 15 alphanumerics of the slug, else md5 prefix."""
    slug = last_path_part(url)
    by_slug = F.concat(F.lit("beehive_"), F.substring(F.regexp_replace(slug, "[^a-zA-Z0-9]", ""), 1, 15))
    by_hash = F.concat(F.lit("beehive_"), F.substring(F.md5(F.concat(F.coalesce(title, F.lit("")), F.lit("_"),
                                                                     F.coalesce(date, F.lit("")))), 1, 12))
    return F.when(nonempty(url).isNotNull() & slug.isNotNull(), by_slug).otherwise(by_hash)


def enhance_release(df: DataFrame) -> DataFrame:
    """O.42: standard document type, portfolio from URL when missing, key, source tag."""
    return df.withColumns({
        "document_type": standardise_doc_type(F.coalesce(F.col("document_type"), F.lit(""))),
        "portfolio": F.when(nonempty(F.col("portfolio")).isNull(), portfolio_from_url(F.col("url")))
                     .otherwise(F.col("portfolio")),
        "release_key": release_key(F.col("url"), F.col("title"), F.col("date")),
        "source_system": F.lit("BEEHIVE"),
    })


def valid_release(df: DataFrame) -> Column:
    """O.43 condition: title/url/date present, site prefix, ISO or RFC 2822
    date, title length 10..500."""
    title, url, date = F.col("title"), F.col("url"), F.col("date")
    iso_ok = date.rlike(r"^\d{4}-(?:1[0-2]|0[1-9]|[1-9])-(?:3[01]|[12]\d|0[1-9]|[1-9])$") & \
        F.try_to_date(date, "yyyy-M-d").isNotNull()
    date_ok = F.coalesce(iso_ok, F.lit(False)) | rfc2822_date(date).isNotNull()
    return F.coalesce(
        nonempty(title).isNotNull() & nonempty(url).isNotNull() & nonempty(date).isNotNull()
        & url.startswith("https://www.beehive.govt.nz/") & date_ok
        & (F.length(title) >= 10) & (F.length(title) <= 500), F.lit(False))


def keep_valid_release(df: DataFrame) -> DataFrame:
    return df.filter(valid_release(df))


def build_release(raw: DataFrame, run_ts: dt.datetime) -> DataFrame:
    """O.26: ``bee-{run year}-{first 10 alphanumerics of the last path part}-v1``."""
    slug = F.coalesce(last_path_part(F.col("url")), F.lit("unknown"))
    clean = F.substring(F.regexp_replace(slug, "[^a-zA-Z0-9]", ""), 1, 10)
    base = F.concat(F.lit(f"bee-{run_ts.year}-"), clean)
    version = F.lit("1")
    return raw.select(
        "seq", F.concat(base, F.lit("-v"), version).alias("id"), "title",
        F.coalesce("date", F.lit(run_ts.strftime("%Y-%m-%d"))).alias("date"),
        F.lit("BEEHIVE").alias("source_system"), "url",
        F.coalesce("primary_entity", F.lit("Government")).alias("primary_entity"),
        F.coalesce("summary", F.lit("")).alias("summary"),
        F.struct(F.coalesce(F.col("document_type"), F.lit("Press Release")).alias("document_type"),
                 F.col("portfolio"), version.alias("version")).alias("metadata"),
        version.alias("version"), base.alias("base_id"),
    )
