"""Display and audit text columns (O.76 - O.78)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actlens.functions.order import with_position
from actlens.functions.text import collapse_ws, map_lookup, nonempty, utrim
from actlens.operators.labels import let
from actlens.session import materialize

# --- FIXED VALUES: card labels per source ---------------------------------
SOURCE_LABEL = [("PARLIAMENT", "Parliament"), ("LEGISLATION", "Legislation"),
                ("GAZETTE", "Gazette"), ("BEEHIVE", "Beehive")]


def first_sentence(c: Column, max_length: int = 200) -> Column:
    """O.76: tags stripped, whitespace collapsed, text before the first
    ``[.!?]`` run, cut to ``max_length`` with '...'; placeholders when empty."""
    # clean text and sentence are bound once: as plain columns every use below would run their patterns again
    def worded(clean: Column) -> Column:
        return let(utrim(F.split(clean, "[.!?]+", 2).getItem(0)), lambda first: (
            F.when(clean == "", F.lit("[No readable content]")).when(first == "", F.lit("[Empty content]"))
            .when(F.length(first) > max_length, F.concat(F.substring(first, 1, max_length - 3), F.lit("..."))).otherwise(first)))

    return F.when(c.isNull() | (c == ""), F.lit("[No content]")).otherwise(let(collapse_ws(F.regexp_replace(c, "<[^>]+>", " ")), worded))


#: Fields that an item's text may be in, the first non-empty one counts.
CONTENT_FIELDS = ["summary", "description", "content", "body"]


def content(df: DataFrame) -> Column:
    """The text of an item: the first non-empty of the content fields that the table has."""
    return F.coalesce(*[nonempty(F.col(c)) for c in CONTENT_FIELDS if c in df.columns], F.lit(""))


def audit_lines(df: DataFrame) -> DataFrame:
    """O.77: running number, title, first sentence of the content, date,
    URL cut to 80 characters (+ '...')."""
    url = F.coalesce(F.col("url"), F.lit("[No URL]"))
    lines = df.select(
        "seq",
        F.coalesce(F.col("title"), F.lit("[No title]")).alias("title"),
        first_sentence(content(df)).alias("first_sentence"),
        F.coalesce(F.col("date"), F.lit("[No date]")).alias("date"),
        F.concat(F.substring(url, 1, 80), F.when(F.length(url) > 80, F.lit("...")).otherwise(F.lit(""))).alias("url"),
    )
    # stored first: the range partitioning samples its input, which would read and cut all texts twice
    return with_position(materialize(lines, "audit-lines"), F.col("seq"), pos_col="item_number")


def card_view(df: DataFrame) -> DataFrame:
    """O.78: source label, long date, document / act line, latest stage."""
    d = F.try_to_date(F.col("date"), "yyyy-MM-dd")
    meta = lambda f: F.col(f"metadata.{f}")
    doc_line = F.when(meta("document_type").isNotNull() & (meta("document_type") != ""),
                      F.concat(meta("document_type"),
                               F.when(meta("portfolio").isNotNull() & (meta("portfolio") != ""),
                                      F.concat(F.lit(" · "), meta("portfolio"))).otherwise(F.lit(""))))
    latest = F.try_element_at(meta("stage_history"), F.lit(-1))["stage"]
    bill_line = F.when(meta("bill_number").isNotNull() & (meta("bill_number") != "") & meta("stage_history").isNotNull(),
                       F.concat(F.lit("Bill "), meta("bill_number"), F.lit(" · Latest: "), F.coalesce(latest, F.lit(""))))
    return df.select(
        "seq",
        map_lookup(F.col("source_system"), SOURCE_LABEL).alias("source_label"),
        F.coalesce(F.date_format(d, "d MMMM yyyy"), F.lit("Invalid Date")).alias("date_text"),
        doc_line.alias("document_line"),
        F.when(meta("act_number") != "", meta("act_number")).alias("act_line"),
        bill_line.alias("bill_line"),
    )
