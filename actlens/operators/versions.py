"""Version grouping and keep-first / keep-latest de-duplication (O.48 - O.56).

Per-key picks use aggregates (``min``/``max_by``) rather than windows: they
combine map-side, so a key holding a third of all rows is reduced in every
task before the shuffle instead of landing whole in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actlens import rules
from actlens.functions.order import with_position
from actlens.functions.text import map_lookup


def base_id_col() -> Column:
    """O.48: base id, else the id without its last ``-v...`` part."""
    id_ = F.col("id")
    derived = F.when(id_.contains("-v"), F.regexp_replace(id_, r"(?s)^(.*)-v.*$", "$1")).otherwise(id_)
    return F.when(F.col("base_id").isNotNull() & (F.col("base_id") != ""), F.col("base_id")).otherwise(derived)


def fill_base_id(df: DataFrame) -> DataFrame:
    return df.withColumn("base_id", base_id_col())


def version_number(c: Column) -> Column:
    """O.50: one leading ``v`` stripped, integer, else 1 (missing -> 1)."""
    v = F.regexp_replace(F.when(c.isNull() | (c == ""), F.lit("1")).otherwise(c), "^v", "")
    as_int = F.when(v.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(v).try_cast("int"))
    return F.coalesce(as_int, F.lit(1))


def version_keys(df: DataFrame) -> DataFrame:
    """The sort keys of O.49 without its sort: ``group_seq`` (first appearance of the group) and ``version_num``."""
    with_base = fill_base_id(df).withColumn("version_num", version_number(F.col("version")))
    first_seen = with_base.groupBy("base_id").agg(F.min("seq").alias("group_seq"))
    return with_base.join(first_seen, "base_id")


def group_versions(df: DataFrame) -> DataFrame:
    """O.49: groups in first-appearance order, version descending inside a
    group, arrival order on ties; all versions kept.  Adds ``group_seq``,
    ``version_num`` and the output position ``pos``."""
    return with_position(version_keys(df), F.col("group_seq"), F.col("version_num").desc(), F.col("seq"))


def version_stats(df: DataFrame) -> DataFrame:
    """O.51: processed rows; surplus rows, rows and groups with >1 version."""
    sizes = fill_base_id(df).groupBy("base_id").agg(F.count(F.lit(1)).alias("n"))
    multi = F.col("n") > 1
    return sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_processed"),
        F.coalesce(F.sum(F.when(multi, F.col("n") - 1)), F.lit(0)).cast("long").alias("duplicates_found"),
        F.coalesce(F.sum(F.when(multi, F.col("n"))), F.lit(0)).cast("long").alias("versions_preserved"),
        F.count(F.when(multi, F.lit(1))).cast("long").alias("base_actions"),
    )


def _pick(df: DataFrame, key: list[str], order: Column) -> DataFrame:
    """One row per key: the row with the greatest ``order`` (map-side combined)."""
    cols = df.columns
    picked = df.groupBy(*key).agg(F.max_by(F.struct(*[F.col(c) for c in cols]), order).alias("_r"))
    return picked.select("_r.*")


def latest_version(df: DataFrame) -> DataFrame:
    """O.52: one row per base id -- highest version, first arrival on ties."""
    d = fill_base_id(df).withColumn("version_num", version_number(F.col("version")))
    return _pick(d, ["base_id"], F.struct(F.col("version_num"), -F.col("seq")))


def drop_same_url(df: DataFrame) -> DataFrame:
    """O.53: keep the first row per URL."""
    return _pick(df, ["url"], -F.col("seq"))


def latest_bill_per_stage(bills: DataFrame) -> DataFrame:
    """O.55: per (bill number before '-', stage) the greatest bill number as
    a string; first arrival on ties.  Input columns: bill_number, stage, seq."""
    keyed = bills.withColumn("bill_base", F.substring_index("bill_number", "-", 1))
    return _pick(keyed, ["bill_base", "stage"], F.struct(F.col("bill_number"), -F.col("seq")))


def stage_name(c: Column) -> Column:
    """O.56: stage code -> name, unknown codes unchanged."""
    return F.coalesce(map_lookup(c, rules.STAGE_CODES), c)
