"""Order-dependent duplicate removal (O.54).

Sequential rule: scan in arrival order; drop a row when its URL or its
title+date was already seen on a *kept* row.  A row is a link between its URL
group and its title+date group, and the scan keeps a row unless an earlier
kept row shares one of them.

Rows first get the numbers of their groups (the first row of each), so that
all that follows handles three integers a row.  Undecided rows of at most
``bound`` are scanned in order by one task, which is all the job does for a
small table.  More of them are decided in rounds:

* A row that is the first undecided one of both groups is kept, and rows that
  share a group with it are dropped.
* Components of what is left are found by doubling (``functions.graph``);
  those of at most ``bound`` rows are scanned, each in order, by tasks that
  hold one component at a time.
* In larger ones a row with a single earlier undecided neighbour is its
  opposite.  Such rows form chains; doubling composes the opposites along a
  chain, so a chain of any length that begins with a kept row is decided in
  one round.  Only rows with two earlier neighbours or more wait for another.

Jobs so grow with the logarithm of a chain's length.  Groups are met by
aggregates and joins on a group's first rows alone; no pairs are formed.
Every round is stored in the shared folder, so lineage stays one round deep.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actlens.functions.graph import components
from actlens.session import checkpoint_dir, materialize, scratch_path

#: Rows that a task scans at one time: their group numbers are 16 bytes a row.
BOUND = 1 << 18


def _keys(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "_ku": F.coalesce(F.col("url"), F.lit("")),
        "_kt": F.concat(F.coalesce(F.col("title"), F.lit("None")), F.lit("_"),
                        F.coalesce(F.col("date"), F.lit("None"))),
    })


def _numbered(df: DataFrame) -> DataFrame:
    """(seq, u, t): each group's number is its first row's seq."""
    rows = _keys(df).select("seq", "_ku", "_kt")
    for key, number in (("_ku", "u"), ("_kt", "t")):
        rows = rows.join(rows.groupBy(key).agg(F.min("seq").alias(number)), key).drop(key)
    return rows


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kept rows of (component, seq, u, t) in that order."""
    here, used_u, used_t = None, set(), set()
    for batch in batches:
        kept = []
        for component, seq, u, t in zip(*(c.to_pylist() for c in batch.columns)):
            if component != here:
                here, used_u, used_t = component, set(), set()
            if u not in used_u and t not in used_t:
                used_u.add(u)
                used_t.add(t)
                kept.append(seq)
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64())], names=["seq"])


def _without(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows that share no group with a kept row."""
    return rows.join(kept.select("u"), "u", "left_anti").join(kept.select("t"), "t", "left_anti").select("seq", "u", "t")


def _firsts(rows: DataFrame) -> DataFrame:
    """Rows with the first and the second undecided row of both groups."""
    for key in ("u", "t"):
        first = rows.groupBy(key).agg(F.min("seq").alias(f"{key}1"))
        rows = rows.join(first, key)
        second = rows.where(F.col("seq") > F.col(f"{key}1")).groupBy(key).agg(F.min("seq").alias(f"{key}2"))
        rows = rows.join(second, key, "left")
    return rows


def _first_of_both(rows: DataFrame) -> DataFrame:
    first = lambda key: rows.groupBy(key).agg(F.min("seq").alias(f"{key}1"))
    return rows.join(first("u"), "u").join(first("t"), "t").where("seq = u1 AND seq = t1").select("seq", "u", "t")


def _chains(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) rows: firsts of both groups, and all that hangs on one by a chain of single earlier neighbours."""
    # before a row in its group: nothing, its first row alone, or more
    alone = lambda key: (F.when(F.col("seq") == F.col(f"{key}1"), F.lit(0))
                         .when(F.col("seq") == F.col(f"{key}2"), F.lit(1)).otherwise(F.lit(2)))
    judged = _firsts(rows).withColumns({"nu": alone("u"), "nt": alone("t")})
    single = ((F.col("nu") + F.col("nt") == 1) | ((F.col("nu") == 1) & (F.col("nt") == 1) & (F.col("u1") == F.col("t1"))))
    before = F.when(F.col("nu") == 1, F.col("u1")).otherwise(F.col("t1"))
    state = materialize(judged.select(
        "seq", "u", "t", F.when(F.col("nu") + F.col("nt") == 0, "kept").when(single, "opposite").otherwise("waits").alias("kind"),
        F.when(single, before).otherwise(F.col("seq")).alias("to"), single.cast("int").alias("flips")), "greedy-chains")
    links = state.select("seq", "to", "flips")
    while True:
        onward = links.select(F.col("seq").alias("to"), F.col("to").alias("next"), F.col("flips").alias("more"))
        links = materialize(links.join(onward, "to").select(
            "seq", F.col("next").alias("to"), ((F.col("flips") + F.col("more")) % 2).alias("flips"),
            (F.col("next") != F.col("to")).alias("moved")), "greedy-links")
        if links.where("moved").isEmpty():
            break
        links = links.drop("moved")
    anchors = state.where("kind = 'kept'").select(F.col("seq").alias("to"))
    decided = links.join(anchors, "to").select("seq", (F.col("flips") == 0).alias("stays"))
    found = materialize(state.select("seq", "u", "t").join(decided, "seq"), "greedy-decided")
    return found.where("stays").select("seq", "u", "t"), found.where("NOT stays").select("seq")


def greedy_dedupe(df: DataFrame, bound: int = BOUND) -> DataFrame:
    """Rows kept by the sequential scan (all columns of ``df``)."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    out_path = scratch_path(spark, "greedy-kept")
    keep = lambda rows: rows.select("seq").write.mode("append").parquet(out_path)
    undecided = materialize(_numbered(df), "greedy-rows")
    keep(undecided.limit(0))
    firsts = True
    while (n := undecided.count()) > bound:
        if firsts:  # in most tables this decides nearly all rows
            kept = materialize(_first_of_both(undecided), "greedy-round")
            keep(kept)
            undecided = materialize(_without(undecided, kept), "greedy-undecided")
            firsts = undecided.count() < n / 4
            continue
        undecided = _by_components(undecided, bound, keep)
        if undecided.isEmpty():
            break
        kept, dropped = _chains(undecided)
        keep(kept)
        undecided = materialize(_without(undecided.join(dropped, "seq", "left_anti"), kept), "greedy-undecided")
    small = undecided.withColumn("component", F.lit(0)).select("component", "seq", "u", "t")
    keep(small.repartition(1).sortWithinPartitions("seq").mapInArrow(_scan, "seq long"))  # at most ``bound`` rows
    return df.join(spark.read.parquet(out_path), "seq", "left_semi").select(*df.columns)


def _by_components(rows: DataFrame, bound: int, keep) -> DataFrame:
    """Scan the components of at most ``bound`` rows; returns the rows of larger ones."""
    nodes = rows.select(F.col("seq").alias("node"))
    first = lambda key: rows.groupBy(key).agg(F.min("seq").alias("b"))
    links = [rows.select(F.col("seq").alias("a"), key).join(first(key), key).select("a", "b") for key in ("u", "t")]
    label = components(nodes, materialize(links[0].unionByName(links[1]).where("a <> b"), "greedy-graph"))
    sizes = label.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    placed = materialize(rows.join(label.withColumnRenamed("node", "seq"), "seq").join(sizes, "component"), "greedy-placed")
    small = placed.where(F.col("n") <= bound).select("component", "seq", "u", "t")
    keep(small.repartition("component").sortWithinPartitions("component", "seq").mapInArrow(_scan, "seq long"))
    return materialize(placed.where(F.col("n") > bound).select("seq", "u", "t"), "greedy-large")
