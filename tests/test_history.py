"""Histories of random snapshots against plain dictionaries."""

import collections
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from actlens.operators.history import History, run_name
from actlens.operators.snapshot import snapshot_diff

DDL = "id string, title string, metadata struct<a: string, b: int>"
TS = [dt.datetime(2025, 1, d, 3) for d in range(1, 7)]


def snapshots(seed, n=5):
    """Rows change, vanish, return and repeat; one key has many rows; some keys are null."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        rows = []
        for k in range(40):
            for _ in range(int(rng.choice([0, 1, 1, 1, 2]))):
                rows.append((f"id{k}", str(rng.choice(["x", "y", None])), None if rng.random() < 0.2 else ("m", int(rng.integers(2)))))
        rows += [("hot", f"t{int(rng.integers(30))}", None) for _ in range(60)]
        rows += [(None, str(rng.choice(["p", "q"])), ("m", None))] * int(rng.integers(3))
        out.append(rows)
    return out


def counted(df):
    return collections.Counter((r.id, r.title, r.metadata and tuple(r.metadata)) for r in df.collect())


def test_against_dictionaries(spark, tmp_path):
    runs = snapshots(1)
    history = History(spark, str(tmp_path / "h"), fields=["id", "title", "metadata"], buckets=7)
    frames = [spark.createDataFrame(rows, DDL).withColumn("extra", F.lit("not kept")) for rows in runs]
    for df, ts in zip(frames, TS):
        history.merge(df, ts)
    assert history.runs() == [run_name(t) for t in TS[:len(runs)]]
    for rows, ts in zip(runs, TS):
        assert counted(history.as_of(ts)) == collections.Counter(rows)
    assert counted(history.as_of(TS[2] + dt.timedelta(hours=5))) == collections.Counter(runs[2])
    with pytest.raises(ValueError):
        history.as_of(TS[0] - dt.timedelta(days=1))
    want = {}
    for k in range(len(runs)):
        now, old = collections.Counter(runs[k]), collections.Counter(runs[k - 1] if k else [])
        for row in {*now, *old}:
            if now[row] != old[row]:
                want[row[0]] = TS[k]
    assert {r.id: r.last_changed for r in history.last_change().collect()} == want
    for k in range(1, len(runs)):
        diff = {tuple(r) for r in snapshot_diff(frames[k - 1], frames[k], fields=["id", "title", "metadata"]).where("id IS NOT NULL").collect()}
        assert {tuple(r) for r in history.changes(TS[k]).where("id IS NOT NULL").collect()} == diff


def test_only_touched_buckets_are_written(spark, tmp_path):
    rows = [(f"id{k}", "t", None) for k in range(200)]
    history = History(spark, str(tmp_path / "h"), fields=["id", "title", "metadata"], buckets=16)
    assert history.merge(spark.createDataFrame(rows, DDL), TS[0]) == list(range(16))
    assert history.merge(spark.createDataFrame(rows, DDL), TS[1]) == []
    rows[3] = ("id3", "changed", None)
    touched = history.merge(spark.createDataFrame(rows, DDL), TS[2])
    assert len(touched) == 1
    written = sorted(p.name for p in (tmp_path / "h/open").glob(f"attempt={run_name(TS[2])}*/bucket=*"))
    assert written == [f"bucket={touched[0]}"]
    plan = history.as_of(TS[2])._jdf.queryExecution().executedPlan().toString()
    assert "closed/attempt" not in plan  # nothing closed after the last run
    assert counted(history.as_of(TS[0])) == collections.Counter((f"id{k}", "t", None) for k in range(200))


def test_vanish_and_return(spark, tmp_path):
    history = History(spark, str(tmp_path / "h"), fields=["id", "title", "metadata"], buckets=2)
    for ts, rows in zip(TS, [[("a", "t", None)], [], [("a", "t", None)], [("a", "t", None)] * 3, []]):
        history.merge(spark.createDataFrame(rows, DDL), ts)
    spans = sorted((r.copies, r.valid_from, r.valid_to) for r in history.intervals().collect())
    names = [run_name(t) for t in TS]
    assert spans == [(1, names[0], names[1]), (1, names[2], names[3]), (3, names[3], names[4])]
    assert [history.as_of(t).count() for t in TS[:5]] == [1, 0, 1, 3, 0]


def test_repeated_and_broken_merges(spark, tmp_path):
    runs = snapshots(8, 3)
    path = str(tmp_path / "h")
    history = History(spark, path, fields=["id", "title", "metadata"], buckets=5)
    frame = lambda k: spark.createDataFrame(runs[k], DDL)
    history.merge(frame(0), TS[0])
    history.merge(frame(2), TS[1])
    # a merge that died before its manifest left files behind
    junk = history._staged(frame(1)).withColumns({"copies": F.lit(1).cast("long"), "valid_from": F.lit(run_name(TS[2]))})
    junk.write.partitionBy("bucket").parquet(f"{path}/open/attempt={run_name(TS[2])}-dead")
    junk.write.parquet(f"{path}/closed/attempt={run_name(TS[2])}-dead")
    assert counted(history.as_of(TS[2])) == collections.Counter(runs[2])
    history.merge(frame(1), TS[1])  # the last run again, with other rows
    assert counted(history.as_of(TS[1])) == collections.Counter(runs[1])
    assert counted(history.as_of(TS[0])) == collections.Counter(runs[0])
    with pytest.raises(ValueError):
        history.merge(frame(0), TS[0])


def test_empty_first_snapshot(spark, tmp_path):
    history = History(spark, str(tmp_path / "h"), fields=["id", "title", "metadata"], buckets=3)
    with pytest.raises(ValueError):
        history.intervals()
    history.merge(spark.createDataFrame([], DDL), TS[0])
    assert history.as_of(TS[0]).collect() == [] and history.last_change().collect() == []
    history.merge(spark.createDataFrame([("a", "t", None)], DDL), TS[1])
    assert [history.as_of(t).count() for t in TS[:2]] == [0, 1]


def test_records_are_written_once(spark, tmp_path):
    """A record that stays is in the files of the merge that opened it alone, though others of its bucket move."""
    history = History(spark, str(tmp_path / "h"), fields=["id", "title", "metadata"], buckets=1)
    for day, ts in enumerate(TS[:4]):
        history.merge(spark.createDataFrame([(f"id{k}", f"day{day}" if k < 3 else "stays", None) for k in range(30)], DDL), ts)
    files = spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").parquet(
        *[str(tmp_path / "h" / kind) for kind in ("records", "open", "closed") if (tmp_path / "h" / kind).exists()])
    assert files.where("title = 'stays'").count() == 27
    assert files.where("title LIKE 'day%'").count() == 12
    assert counted(history.as_of(TS[1])) == collections.Counter((f"id{k}", "day1" if k < 3 else "stays", None) for k in range(30))
