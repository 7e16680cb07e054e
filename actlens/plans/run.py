"""The batch run with its failures contained (O.13, O.27, O.74, O.80).

sources -> conversion -> validation -> version groups -> labels -> export.

* A source that can't be read gives no rows and one error; the others go on.
  What is wrong within a source (files, documents, items) is its quarantine.
* A record that the schema check refuses, at conversion or after any stage,
  goes to the quarantine with the field that failed.
* A stage that raises gives one error, and the next one reads the stage's own
  input again, which is a stored table.

Every stage's table is stored before anything is counted, so failures show
where they are contained, and all counts are counts of stored rows: a metric
gathered on the way (``observe``) would count rows again whenever a lost
executor makes Spark repeat a task's stage.

The run gives, besides the exported rows, three tables keyed by stage and
source: metrics, messages (errors and warnings, with the row's number) and the
quarantine.  ``RunStore`` keeps them by run and merges them between runs.
"""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actlens import rules
from actlens.functions.order import with_position
from actlens.functions.text import collapse_ws
from actlens.operators import build as bld
from actlens.operators import labels as lab
from actlens.operators import stats as st
from actlens.operators import validate as val
from actlens.operators import versions as ver
from actlens.session import checkpoint_dir, materialize
from actlens.sources.combine import limit_per_source
from actlens.sources.landing import RAW, no_quarantine

#: A record as every stage sees it.
RECORD = ("seq long, id string, title string, date string, source_system string, url string, primary_entity string, summary string, "
          "labels array<string>, metadata struct<bill_number: string, parliament_number: int, "
          "stage_history: array<struct<stage: string, date: string>>, act_number: string, commencement_date: string, "
          "notice_number: string, notice_type: string, document_type: string, portfolio: string, version: string>, "
          "version string, base_id string")
METRICS = ("stage string, source string, input_rows long, output_rows long, rejected_rows long, errors long, fixed long, "
           "success boolean, elapsed double")
MESSAGES = "stage string, source string, level string, row long, message string"
#: The source of metrics and messages that are of a whole stage.
ALL = "ALL"

BUILDERS = {"LEGISLATION": bld.build_act, "GAZETTE": bld.build_notice, "PARLIAMENT": bld.build_bill, "BEEHIVE": bld.build_release}

#: A source: raw items (with ``seq``) and the quarantine of what couldn't be read.
Reader = Callable[[], tuple[DataFrame, DataFrame]]
Stage = Callable[[DataFrame, dt.datetime], DataFrame]


def _validate(df: DataFrame, run_ts: dt.datetime) -> DataFrame:
    return val.validate(df, run_ts)


def _versions(df: DataFrame, run_ts: dt.datetime) -> DataFrame:
    return ver.version_keys(df)


def _labels(df: DataFrame, run_ts: dt.datetime) -> DataFrame:
    """Labels see the whole summary; the export has validation's cut one."""
    cut = df.withColumns({"_cut": F.col("summary"), "summary": F.col("_text")})
    return lab.assign_labels(cut).withColumn("summary", F.col("_cut")).drop("_cut")


STAGES: dict[str, Stage] = {"validate": _validate, "versions": _versions, "labels": _labels}


@dataclass
class Run:
    """What a run gave."""

    run_ts: dt.datetime
    rows: DataFrame
    quarantine: DataFrame
    metrics: DataFrame
    messages: DataFrame
    success: bool


@dataclass
class _Log:
    """Rows of metrics and messages by stage and source: as many as there are of these."""

    spark: SparkSession
    metrics: list[tuple] = field(default_factory=list)
    messages: list[tuple] = field(default_factory=list)
    #: tables that grow with the data
    tables: list[DataFrame] = field(default_factory=list)
    quarantine: list[DataFrame] = field(default_factory=list)

    def count(self, stage: str, source: str, read: int, written: int, rejected: int = 0, errors: int = 0, fixed: int = 0,
              ok: bool = True, since: float | None = None) -> None:
        elapsed = None if since is None else time.monotonic() - since
        self.metrics.append((stage, source, read, written, rejected, errors, fixed, ok, elapsed))

    def error(self, stage: str, source: str, problem: Exception) -> None:
        text = str(problem).strip().splitlines() or [""]
        self.messages.append((stage, source, "error", None, f"{type(problem).__name__}: {text[0]}"))

    def refuse(self, stage: str, rejects: DataFrame) -> None:
        """Records with ``reject_reason``: quarantine rows and a warning each."""
        kept = [c for c in rejects.columns if not c.startswith("_") and c != "reject_reason"]
        self.quarantine.append(rejects.select(
            F.lit(stage).alias("stage"), F.col("source_system").alias("source"), F.lit(None).cast("string").alias("file"),
            F.col("seq").alias("place"), F.col("reject_reason").alias("reason"),
            F.substring(F.to_json(F.struct(*kept)), 1, RAW).alias("raw")))
        self.tables.append(rejects.select(
            F.lit(stage).alias("stage"), F.col("source_system").alias("source"), F.lit("warning").alias("level"),
            F.col("seq").alias("row"), F.concat(F.lit("Record refused: "), "reject_reason").alias("message")))


def _checked(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame, dict[str, tuple[int, int, int, int]]]:
    """The stage's stored records that the schema check accepts, those that it refuses, and by source how many are
    accepted and refused, and how many errors and repairs validation noted.  Sources are the run's readers or, after
    validation, the four source systems."""
    return _counted(materialize(df.withColumn("reject_reason", val.reject_reason()), name))


def _counted(held: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, tuple[int, int, int, int]]]:
    """``_checked`` of stored records that have the schema check's ``reject_reason``."""
    refused = F.col("reject_reason").isNotNull()
    noted = [F.coalesce(F.sum(F.size("_errors")), F.lit(0)), F.coalesce(F.count_if("_fixed"), F.lit(0))] \
        if "_errors" in held.columns else [F.lit(0), F.lit(0)]
    counts = held.groupBy("source_system").agg(F.count_if(~refused), F.count_if(refused), *noted).collect()
    return held.where(~refused).drop("reject_reason"), held.where(refused), {r[0]: tuple(r[1:]) for r in counts}


def collect(readers: dict[str, Reader], log: _Log, limit: int | None = None) -> dict[str, DataFrame]:
    """Stored raw items of each source that could be read."""
    parts: dict[str, DataFrame] = {}
    for source, read in readers.items():
        start = time.monotonic()
        try:
            items, bad = read()
            items = limit_per_source(items.withColumn("_source", F.lit(source)), limit, source_col="_source").drop("_source")
            held = materialize(items, f"items-{source.lower()}")
            bad = materialize(bad, f"bad-{source.lower()}")
            n, refused = held.count(), bad.count()
        except Exception as e:  # noqa: BLE001 - whatever a source raises is contained here
            log.error("collect", source, e)
            log.quarantine.append(log.spark.createDataFrame(
                [("collect", source, None, None, log.messages[-1][4], None)], "stage string, source string, file string, place long, "
                "reason string, raw string"))
            log.count("collect", source, 0, 0, ok=False, since=start)
            continue
        parts[source] = held
        log.quarantine.append(bad.select(F.lit("collect").alias("stage"), "*"))
        log.tables.append(bad.select(
            F.lit("collect").alias("stage"), "source", F.lit("warning").alias("level"), F.col("place").alias("row"),
            F.concat(F.lit("Not read: "), "reason", F.coalesce(F.concat(F.lit(" in "), F.element_at(F.split("file", "/"), -1)), F.lit("")))
            .alias("message")))
        log.count("collect", source, n + refused, n, refused, since=start)
    return parts


def convert(parts: dict[str, DataFrame], run_ts: dt.datetime, log: _Log,
            builders: dict | None = None) -> tuple[DataFrame, dict[str, int]]:
    """O.27: accepted records in source order, numbered from 0 on, and their number by source; stored."""
    spark = log.spark
    builders = builders or BUILDERS
    built = spark.createDataFrame([], RECORD).withColumn("source_rank", F.lit(0))
    read: dict[str, tuple[int, float]] = {}
    collected = {m[1]: m[3] for m in log.metrics if m[0] == "collect"}
    for source in sorted(parts, key=lambda s: rules.SOURCES.index(s) if s in rules.SOURCES else len(rules.SOURCES)):
        start = time.monotonic()
        n = collected[source]
        try:
            records = builders[source](parts[source], run_ts)
            records = records.select("seq", "id", "title", "date", "source_system", "url", "primary_entity", "summary", "metadata",
                                     "version", "base_id").withColumns({
                                         "labels": F.array().cast("array<string>"), "source_rank": F.lit(len(read))})
            records = materialize(records, f"records-{source.lower()}")
        except Exception as e:  # noqa: BLE001
            log.error("convert", source, e)
            log.count("convert", source, n, 0, ok=False, since=start)
            continue
        read[source] = (n, start)
        built = built.unionByName(records, allowMissingColumns=True)
    # text and check are stored with the sorted records: numbering them reads few columns and isn't stored again
    ordered = with_position(built, "source_rank", "seq", stored={"_text": collapse_ws("summary"), "reject_reason": val.reject_reason()})
    good, bad, found = _counted(ordered.withColumn("seq", F.col("pos") - 1).drop("pos", "source_rank"))
    log.refuse("convert", bad)
    for source, (n, start) in read.items():
        log.count("convert", source, n, *found.get(source, (0, 0))[:2], since=start)
    return good, {source: c[0] for source, c in found.items() if c[0]}


def process(df: DataFrame, counts: dict[str, int], run_ts: dt.datetime, log: _Log,
            stages: dict[str, Stage] | None = None) -> tuple[DataFrame, dict[str, int]]:
    """The stages one after another; a stage that raises leaves its input to the next.  ``counts``: records by source."""
    for name, stage in (STAGES if stages is None else stages).items():
        start = time.monotonic()
        try:
            good, bad, found = _checked(stage(df, run_ts), f"stage-{name}")
        except Exception as e:  # noqa: BLE001
            log.error(name, ALL, e)
            for source, n in counts.items():
                log.count(name, source, n, n, ok=False)
            log.count(name, ALL, *(2 * [sum(counts.values())]), ok=False, since=start)
            continue
        log.refuse(name, bad)
        if "_errors" in good.columns:
            log.tables.append(good.unionByName(bad.drop("reject_reason")).select(
                F.lit(name).alias("stage"), F.col("source_system").alias("source"), F.lit("warning").alias("level"),
                F.col("seq").alias("row"), F.explode("_errors").alias("message")))
        for source in sorted({*counts, *found}, key=str):
            log.count(name, source, counts.get(source, 0), *found.get(source, (0, 0, 0, 0)))
        log.count(name, ALL, sum(counts.values()), *(sum(c[k] for c in found.values()) for k in range(4)), since=start)
        df, counts = good.drop("_errors", "_fixed"), {source: c[0] for source, c in found.items() if c[0]}
    return df, counts


def run(spark: SparkSession, readers: dict[str, Reader], run_ts: dt.datetime, limit: int | None = None,
        builders: dict | None = None, stages: dict[str, Stage] | None = None) -> Run:
    """The whole run; never raises for what a source, record or stage does."""
    checkpoint_dir(spark)
    log = _Log(spark)
    parts = collect(readers, log, limit)
    rows = spark.createDataFrame([], RECORD).withColumn("pos", F.lit(None).cast("long"))
    success = any(m[0] == "collect" and m[3] for m in log.metrics)
    if not success:
        log.messages.append(("collect", ALL, "error", None, "No data from any source"))
    else:
        df, counts = process(*convert(parts, run_ts, log, builders), run_ts, log, stages)
        start, n = time.monotonic(), sum(counts.values())
        try:
            tie = {"group_seq": False, "version_num": True, "seq": False} if "group_seq" in df.columns else None
            rows = materialize(st.export_table(df, tie=tie), "exported")
            log.count("export", ALL, n, rows.count(), since=start)
        except Exception as e:  # noqa: BLE001
            log.error("export", ALL, e)
            log.count("export", ALL, n, 0, ok=False, since=start)
            success = False
    quarantine = [no_quarantine(spark).select(F.lit("").alias("stage"), "*"), *log.quarantine]
    messages = [spark.createDataFrame(log.messages, MESSAGES), *log.tables]
    return Run(run_ts, rows, reduce(DataFrame.unionByName, quarantine), spark.createDataFrame(log.metrics, METRICS),
               reduce(DataFrame.unionByName, messages), success)


def summary(metrics: DataFrame, messages: DataFrame) -> DataFrame:
    """One row: scraped, processed, rates of sources and stages that did, errors and warnings."""
    collect_, stage = F.col("stage") == "collect", (F.col("source") == ALL) & F.col("stage").isin(*STAGES)
    rate = lambda of: F.avg(F.when(of, F.col("success").cast("double")))
    counted = metrics.agg(
        F.coalesce(F.sum(F.when(collect_, F.col("output_rows"))), F.lit(0)).cast("long").alias("total_scraped"),
        F.coalesce(F.sum(F.when(F.col("stage") == "export", F.col("output_rows"))), F.lit(0)).cast("long").alias("total_processed"),
        F.coalesce(rate(collect_), F.lit(0.0)).alias("scraping_success_rate"),
        F.coalesce(rate(stage), F.lit(0.0)).alias("processing_success_rate"),
        F.coalesce(F.sum("elapsed"), F.lit(0.0)).alias("elapsed"))
    return st.one_row(counted, messages.agg(F.count_if(F.col("level") == "error").alias("errors"),
                                            F.count_if(F.col("level") == "warning").alias("warnings")))


class RunStore:
    """Metrics, messages and quarantine of runs, in directories by run; a run that is written again replaces itself."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, found: Run) -> None:
        name = found.run_ts.strftime("run%Y%m%dT%H%M%S%f")
        for kind in ("metrics", "messages", "quarantine"):
            getattr(found, kind).write.mode("overwrite").parquet(f"{self.path}/{kind}/run={name}")

    def read(self, kind: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{kind}")

    def merged(self) -> DataFrame:
        """Over all runs, by stage and source: runs, failures, the sums of their counts, the last run and whether it did."""
        return self.read("metrics").groupBy("stage", "source").agg(
            F.count(F.lit(1)).alias("runs"), F.count_if(~F.col("success")).alias("failures"),
            *[F.sum(c).alias(c) for c in ("input_rows", "output_rows", "rejected_rows", "errors", "fixed", "elapsed")],
            F.max("run").alias("last_run"), F.max_by("success", "run").alias("last_success"))
