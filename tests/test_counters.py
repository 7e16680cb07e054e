"""Kept summaries after adds, changes and removals against recounts."""

import collections
import datetime as dt

import numpy as np
import pytest

from actlens.operators import stats as st
from actlens.operators.counters import Counters
from actlens.operators.history import History, run_name

DDL = "id string, title string, date string, source_system string, url string, labels array<string>"
FIELDS = ["id", "title", "date", "source_system", "url", "labels"]
TS = [dt.datetime(2025, 3, d) for d in range(1, 6)]


def snapshots(seed):
    rng = np.random.default_rng(seed)
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]
    rows = {k: None for k in range(60)}
    out = []
    for run in range(4):
        for k in rows:
            if run == 0 or rng.random() < 0.25:
                rows[k] = [(pick(f"id{k}", f"id{k}", "same", None, ""), pick("t", "u"), pick("2024-01-0%d" % (1 + k % 9), "", None, "2023-12-31"),
                            pick("GAZETTE", "BEEHIVE", None), pick(f"u{k % 20}", None), pick(["Health"], ["Tax", "Health"], [], None))
                           ] * int(rng.integers(3))
        out.append([r for held in rows.values() for r in held])
    return out + [[]]


def test_against_recounts(spark, tmp_path):
    history = History(spark, str(tmp_path / "h"), fields=FIELDS, buckets=6)
    counters = Counters(spark, str(tmp_path / "c"), buckets=6)
    for rows, ts in zip(snapshots(3), TS):
        df = spark.createDataFrame(rows, DDL)
        history.merge(df, ts)
        counters.update(*history.moved())
        if ts == TS[1]:
            counters.update(*history.moved())  # the same run again
        audit = st.export_audit(df).first().asDict()
        bounds = st.date_range(df).first()
        want = {c: audit[c] for c in ("total_actions", "unique_ids", "duplicate_ids", "missing_id", "unique_urls", "duplicate_urls", "missing_url")}
        assert counters.summary() == want | {"earliest": bounds.earliest, "latest": bounds.latest}
        labels = collections.Counter(x for r in rows for x in r[5] or [])
        assert {r.value: r.n for r in counters.counts("label").collect()} == labels
        assert {r.value: r.n for r in counters.counts("source").collect()} == collections.Counter(r[3] for r in rows)
    assert counters.summary(run_name(TS[0]))["total_actions"] == len(snapshots(3)[0])


def test_reads_and_writes_what_moved(spark, tmp_path):
    history = History(spark, str(tmp_path / "h"), fields=FIELDS, buckets=4)
    counters = Counters(spark, str(tmp_path / "c"), buckets=32)
    rows = [(f"id{k}", "t", "2024-01-01", "GAZETTE", f"u{k}", ["Tax"]) for k in range(100)]
    for ts, changed in ((TS[0], rows), (TS[1], rows), (TS[2], rows[:-1] + [("id99", "t", "2024-01-01", "GAZETTE", "moved", ["Tax"])])):
        history.merge(spark.createDataFrame(changed, DDL), ts)
        touched = counters.update(*history.moved())
        if ts == TS[1]:
            assert touched == []
    # one URL went and one came
    assert {k for k, _ in touched} == {"url"} and len(touched) <= 2
    written = {p.parent.name for p in (tmp_path / "c/data").glob(f"attempt={run_name(TS[2])}*/kind=*/bucket=*")}
    assert written == {"kind=url"}
    with pytest.raises(ValueError):
        counters.summary("run-nowhere")
