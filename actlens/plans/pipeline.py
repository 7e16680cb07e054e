"""The batch run (O.80), conversion (O.27) and run report (O.74).

convert -> validate -> schema check -> group versions -> label -> schema
check -> export order.  Stage row counts are collected with
``DataFrame.observe`` below the stage-table writes.  Lost executors are
handled by Spark's task retries and the stored stage tables; a stage whose
logic fails fails the run (the reference skips such a stage and keeps its
input).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from actlens.functions.text import collapse_ws
from actlens.operators import build as bld
from actlens.operators import labels as lab
from actlens.operators import stats as st
from actlens.operators import validate as val
from actlens.operators import versions as ver
from actlens.session import checkpoint_dir, materialize

STAGES = ["input", "validated", "schema_ok", "grouped", "labelled", "exported"]


def convert(parts: dict[str, DataFrame], run_ts: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """O.27: per-source builders, then the record schema check.
    Returns (accepted, quarantine-with-reason)."""
    builders = {"LEGISLATION": bld.build_act, "GAZETTE": bld.build_notice,
                "PARLIAMENT": bld.build_bill, "BEEHIVE": bld.build_release}
    built = None
    for source, df in parts.items():
        b = builders[source](df, run_ts)
        b = b.select("seq", "id", "title", "date", "source_system", "url", "primary_entity", "summary",
                     F.to_json("metadata").alias("metadata_json"), F.col("metadata"), "version", "base_id")
        built = b if built is None else built.unionByName(b, allowMissingColumns=True)
    built = built.withColumn("labels", F.array().cast("array<string>"))
    return val.schema_check(built).drop("reject_reason"), val.schema_rejects(built)


def pipeline(raw: DataFrame, run_ts: dt.datetime, observe: bool = True):
    """O.80 over action records; returns (export-ordered rows, observations).

    Stage tables are written to the shared folder (validated, checked,
    labelled): each is computed once -- the export sort's sampling pass would
    otherwise recompute it -- and every observed stage lies directly below
    one of those writes with no sort in between, so the report counts each
    row once whatever the caller later does with the result."""
    checkpoint_dir(raw.sparkSession)
    obs = {name: Observation(name) for name in STAGES} if observe else {}

    def mark(df, name):
        return df.observe(obs[name], F.count(F.lit(1)).alias("rows")) if observe else df

    df = mark(raw, "input")
    # written before the schema check: its filter would otherwise be pushed
    # below the repair projection and evaluate the repairs twice
    # labels see the whole summary; the export has validation's cut one
    whole = df.withColumn("_text", collapse_ws("summary"))
    df = materialize(mark(val.validate(whole, run_ts), "validated").drop("_errors", "_fixed"), "validated")
    df = materialize(mark(val.schema_check(df).drop("reject_reason"), "schema_ok"), "checked")
    # version order as sort keys: the export's sort is the only one
    df = mark(ver.version_keys(df), "grouped")
    df = df.withColumns({"_cut": F.col("summary"), "summary": F.col("_text")})
    df = mark(lab.assign_labels(df).withColumn("summary", F.col("_cut")).drop("_cut", "_text"), "labelled")
    df = mark(val.schema_check(df).drop("reject_reason"), "exported")
    df = materialize(df, "labelled")
    return st.export_table(df, tie={"group_seq": False, "version_num": True, "seq": False}), obs


def run_report(spark, obs: dict, run_ts: dt.datetime) -> DataFrame:
    """O.74: per-stage input / output rows and success rates (one small
    table, built from the observed metrics after the run's action)."""
    rows = []
    prev = None
    for name in STAGES:
        n = int(obs[name].get.get("rows", 0)) if name in obs else 0
        rows.append((name, prev if prev is not None else n, n,
                     float(n) / prev if prev else 1.0, run_ts.isoformat()))
        prev = n
    return spark.createDataFrame(rows, "stage string, input_rows long, output_rows long, rate double, run_ts string")
