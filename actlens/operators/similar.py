"""Similar titles across sources (O.57, specified in the reference, not coded).

Two records are linked if their dates, normalised, are the same day and their
normalised titles have ``1 - levenshtein / longer length >= threshold``.
Clusters are the components of these links; those that span two or more
sources are reported, each record with its best score within the cluster.
A record without a readable date is linked with nothing.

The links are complete, without comparing all titles of a day.  Records of
one day and title are first reduced to one class (map-side combining, so a
title that holds a third of all rows is one row).  If at most k edits
separate a title from a longer one, one of its k + 1 segments stands
unchanged in the longer one, at a place that the edits before and after it
bound; segments and the substrings at those places meet in an equi-join on
(day, length, segment number, segment), and the candidates are confirmed on
the whole titles.  Segments that many titles of a day share make large join
keys; these are left to AQE's skew splitting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actlens.functions.dates import normalise_date
from actlens.session import checkpoint_dir, materialize

#: Scores are rounded to six places; candidate bounds leave that much room.
_SLACK = 1e-6


def norm_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def _segment(size: Column, edits: Column, i: Column) -> tuple[Column, Column]:
    """Start (from 0) and length of segment ``i`` of ``edits + 1`` nearly equal ones."""
    base = F.floor(size / (edits + 1))
    plain = edits + 1 - (size - base * (edits + 1))  # the first so many have the base length
    start = i * base + F.greatest(i - plain, F.lit(0))
    return start.cast("int"), (base + (i >= plain).cast("int")).cast("int")


def title_links(classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, score), a and b the ids of two linked classes of ``classes`` (tid, day, t); each pair once."""
    loose = threshold - _SLACK
    size, i, place = F.col("size"), F.col("i"), F.col("place")
    edits = F.floor((1 - loose) * size / loose + _SLACK).cast("int")
    start, length = _segment(size, F.col("edits"), i)
    key = lambda at: F.xxhash64("day", "size", "i", F.col("t").substr(at + 1, F.col("length")))

    def segments(df: DataFrame) -> DataFrame:
        return (df.withColumn("edits", edits).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("edits"))))
                .withColumns({"start": start, "length": length}))

    full = F.length("t")
    whole = classes.filter(full > 0)
    index = segments(whole.withColumn("size", full)).select(
        F.col("tid").alias("a"), F.col("size").alias("a_size"), key(F.col("start")).alias("key"))
    more = full - size
    after = F.col("edits") - i
    low = F.greatest(F.lit(0), F.col("start") - i, F.col("start") + more - after)
    high = F.least(full - F.col("length"), F.col("start") + i, F.col("start") + more + after)
    probe = (segments(whole.withColumn("size", F.explode(F.sequence(F.ceil(full * loose).cast("int"), full))))
             .withColumns({"low": low, "high": high})
             .withColumn("place", F.explode(F.when(F.col("low") <= F.col("high"), F.sequence("low", "high"))))
             .select(F.col("tid").alias("b"), full.alias("b_size"), key(place).alias("key")))
    pairs = (index.join(probe, "key")
             .filter((F.col("a") != F.col("b")) & ((F.col("a_size") < F.col("b_size")) | (F.col("a") < F.col("b"))))
             .select("a", "b").distinct())
    side = lambda n: classes.select(F.col("tid").alias(n), F.col("day").alias(f"{n}_day"), F.col("t").alias(f"{n}_t"))
    longest = F.greatest(F.length("a_t"), F.length("b_t"))
    return (pairs.join(side("a"), "a").join(side("b"), "b").filter(F.col("a_day") == F.col("b_day"))
            .select("a", "b", F.round(1 - F.levenshtein("a_t", "b_t") / longest, 6).alias("score"))
            .filter(F.col("score") >= threshold))


def components(ids: DataFrame, links: DataFrame) -> DataFrame:
    """(tid, cluster): cluster = smallest id reachable through ``links`` (a, b); ends when no label moves."""
    edges = (links.select(F.col("a").alias("tid"), F.col("b").alias("other"))
             .unionByName(links.select(F.col("b").alias("tid"), F.col("a").alias("other")))
             .unionByName(ids.select("tid", F.col("tid").alias("other"))))
    label = ids.select("tid", F.col("tid").alias("cluster"))
    before = F.min(F.when(F.col("other") == F.col("tid"), F.col("cluster")))  # every id is its own neighbour
    while True:
        near = label.select(F.col("tid").alias("other"), "cluster")
        new = materialize(edges.join(near, "other").groupBy("tid").agg(
            F.min("cluster").alias("cluster"), before.alias("before")), "components")
        label = new.drop("before")
        if new.filter(F.col("cluster") < F.col("before")).isEmpty():
            return label


def similar_titles(df: DataFrame, threshold: float = 0.8, profile: str = "validator") -> DataFrame:
    """Members of cross-source similar-title clusters: seq, cluster (its first seq), source_system, score (best
    with another member), n_sources, size."""
    if not 0.5 < threshold <= 1:
        raise ValueError("the threshold must be above 0.5 and at most 1")
    checkpoint_dir(df.sparkSession)
    base = df.select("seq", "source_system", normalise_date(F.col("date"), profile).alias("day"),
                     norm_title(F.col("title")).alias("t")).filter(F.col("day").isNotNull())
    per_source = materialize(base.groupBy("day", "t", "source_system").agg(
        F.min("seq").alias("first"), F.count(F.lit(1)).alias("n")), "title-sources")
    classes = materialize(per_source.groupBy("day", "t").agg(
        F.min("first").alias("tid"), F.sum("n").alias("copies")), "title-classes")
    links = materialize(title_links(classes, threshold), "title-links")
    label = components(classes, links)
    best = links.select(F.explode(F.array("a", "b")).alias("tid"), "score").groupBy("tid").agg(F.max("score").alias("score"))
    labelled = classes.join(label, "tid")
    sizes = (per_source.join(labelled.select("day", "t", "cluster"), ["day", "t"])
             .groupBy("cluster", "source_system").agg(F.sum("n").alias("n"))
             .groupBy("cluster").agg(F.count(F.lit(1)).alias("n_sources"), F.sum("n").alias("size")))
    reported = (labelled.join(sizes.filter(F.col("n_sources") >= 2), "cluster").join(best, "tid", "left")
                .withColumn("score", F.when(F.col("copies") > 1, F.lit(1.0)).otherwise(F.col("score")))
                .select("day", "t", "cluster", "score", "n_sources", "size"))
    return base.join(reported, ["day", "t"]).select("seq", "cluster", "source_system", "score", "n_sources", "size")
