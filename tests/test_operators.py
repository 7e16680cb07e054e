"""Hand-row unit tests (cases carried over from the reference's tests)."""

import datetime as dt
import random

import pytest

from pyspark.sql import functions as F

from actlens.adapter import nest
from actlens.operators import dedupe, display, labels, search, stats, validate, versions

RUN = dt.datetime(2025, 12, 16, 9, 30)


def actions(spark, rows):
    """rows: dicts of flat adapter columns; missing keys are NULL."""
    cols = ["seq", "id", "source_system", "title", "date", "url", "portfolio", "summary", "lang", "version",
            "base_id", "primary_entity", "bill_number", "parliament_number", "act_number", "commencement_date",
            "notice_number", "notice_type", "document_type", "stage1", "stage1_date", "stage2", "stage2_date",
            "labels_in"]
    schema = ", ".join(f"{c} {'long' if c == 'seq' else 'int' if c == 'parliament_number' else 'string'}" for c in cols)
    data = [tuple(r.get(c) for c in cols) for r in rows]
    return nest(spark.createDataFrame(data, schema))


def test_validate_repairs(spark):
    df = actions(spark, [dict(seq=0, title="Test Action", url="example.com/test", source_system="parliament",
                              date="15/12/2024", labels_in="Housing|InvalidLabel", summary="x")])
    r = validate.validate(df, RUN).collect()[0]
    assert r.url.startswith("https://")
    assert r.source_system == "PARLIAMENT"
    assert r.date == "2024-12-15"
    assert r.id and r.primary_entity == "Parliament"
    assert r.id.startswith("parl-15/1-")  # S.6: year from the raw date's first 4 characters
    assert r.labels == ["Housing"]
    assert any("Unknown label 'InvalidLabel'" in e for e in r._errors)


def test_validate_generates_id(spark):
    df = actions(spark, [dict(seq=0, title="t", url="https://a.nz/x", source_system="PARLIAMENT", date="2024-12-15")])
    assert validate.validate(df, RUN).collect()[0].id.startswith("parl-2024-")


def test_validate_strict_rejects(spark):
    df = actions(spark, [dict(seq=0, title="Only a title")])
    assert validate.validate(df, RUN, strict=True).count() == 0


def test_validate_dates(spark):
    df = actions(spark, [dict(seq=i, title="t", url="https://a.nz/x", source_system="GAZETTE", date=d)
                         for i, d in enumerate(["15/12/2024", "15 December 2024", "December 15, 2024", "soon"])])
    got = [r.date for r in validate.validate(df, RUN).orderBy("seq").collect()]
    assert got == ["2024-12-15", "2024-12-15", "2024-12-15", "2025-12-16"]


def _labels_of(spark, **kw):
    row = dict(seq=0, id="x-2024-001", source_system="LEGISLATION", url="https://a.nz", summary="", **kw)
    return labels.assign_labels(actions(spark, [row])).collect()[0].labels


def test_labels(spark):
    assert "Housing" in _labels_of(spark, title="Housing Development Bill")
    got = _labels_of(spark, title="Infrastructure Investment for Housing and Transport")
    assert {"Infrastructure", "Housing", "Transport"} <= set(got)
    assert "Justice" in _labels_of(spark, title="General Notice", portfolio="Justice")
    assert "Treaty of Waitangi" in _labels_of(spark, title="Treaty Principles Bill")
    got = _labels_of(spark, title="Taxation Annual Rates Act 2024", portfolio="Finance")
    assert {"Tax", "Economy"} <= set(got)
    assert "Tax" in _labels_of(spark, title="Syntax of notices")  # S.11: substring test
    assert _labels_of(spark, title="Statutes Amendment") == ["Economy"]  # rule 5


def test_label_gazette_appointment(spark):
    row = dict(seq=0, id="g-2024-001", source_system="GAZETTE", url="https://a.nz", summary="",
               title="Appointment of District Court Judge")
    assert "Justice" in labels.assign_labels(actions(spark, [row])).collect()[0].labels


def test_label_counts(spark):
    df = spark.createDataFrame([(["Housing", "Infrastructure"],), (["Housing", "Education"],), (["Health"],), ([],)],
                               "labels array<string>")
    got = {r.label: r.n for r in labels.label_counts(df).collect()}
    assert got["Housing"] == 2 and got["Health"] == 1 and got["Tax"] == 0
    assert len(got) == 15


def test_search_and_options(spark):
    rows = [dict(seq=0, id="parl-2024-001", title="Health reform", source_system="PARLIAMENT", url="https://a.nz/1",
                 summary="Māori & health", stage1="First Reading", stage1_date="2024-01-02", date="2024-01-05"),
            dict(seq=1, id="leg-2024-002", title="Roads", source_system="LEGISLATION", url="https://a.nz/2",
                 summary="roads", labels_in="Health", date="invalid-date"),
            dict(seq=2, id="gaz-2024-003", title="Notice", source_system="GAZETTE", url="https://a.nz/3",
                 summary="n", act_number="2024 No 5", date="2024-03-01")]
    df = actions(spark, rows)
    ids = lambda d: sorted(r.seq for r in d.collect())
    assert ids(search.search(df, "health")) == [0, 1]
    assert ids(search.search(df, "HEALTH", search.SearchConfig(case_sensitive=True))) == []
    assert ids(search.search(df, "Health", search.SearchConfig(exact_match=True))) == [1]
    assert ids(search.search(df, "2024 No 5")) == [2]
    assert ids(search.search(df, "2024 No 5", search.SearchConfig(search_metadata=False))) == []
    assert ids(search.search(df, "first reading")) == [0]
    assert ids(search.search(df, "first reading", search.SearchConfig(search_stage_history=False))) == []
    assert ids(search.search(df, "   ")) == [0, 1, 2]
    assert ids(search.search(df, "Māori")) == [0] and ids(search.search(df, "&")) == [0]
    order = [r.seq for r in search.sort_by_date(df, "newest").orderBy("pos").collect()]
    assert order == [2, 0, 1]  # invalid date last
    order = [r.seq for r in search.sort_by_date(df, "oldest").orderBy("pos").collect()]
    assert order == [0, 2, 1]
    assert search.query(df, "x", "BAD", "notalist", "sideways").count() == 0
    assert search.query(df, "", "BAD", None, "sideways").count() == 3


def test_export_order_and_audit(spark):
    df = actions(spark, [dict(seq=0, id="dup-2024-001", title="A", date="2024-12-01", url="https://a.nz/1"),
                         dict(seq=1, id="dup-2024-001", title="B", date="2024-12-15", url="https://a.nz/1")])
    order = [r.seq for r in stats.export_table(df).orderBy("pos").collect()]
    assert order == [1, 0]
    audit = stats.export_audit(df).collect()[0]
    assert not audit.valid and audit.duplicate_ids == 1 and audit.n_warnings == 1


def test_versions(spark):
    df = actions(spark, [dict(seq=0, id="leg-2024-001-v2", version="v2"), dict(seq=1, id="leg-2024-001-v10", version="10"),
                         dict(seq=2, id="leg-2024-001-v1"), dict(seq=3, id="leg-2024-002-v1")])
    g = versions.group_versions(df).orderBy("pos").collect()
    assert [r.seq for r in g] == [1, 0, 2, 3]
    assert versions.latest_version(df).filter(F.col("base_id") == "leg-2024-001").collect()[0].seq == 1
    st = versions.version_stats(df).collect()[0]
    assert (st.duplicates_found, st.versions_preserved, st.base_actions) == (2, 3, 1)


def test_first_sentence(spark):
    df = spark.createDataFrame([("Plain text. Second",), ("<p>Hi <b>there</b>!</p> more",), ("",), ("a" * 300,)], "t string")
    got = [r[0] for r in df.select(display.first_sentence(F.col("t"), 100)).collect()]
    assert got[0] == "Plain text" and got[1] == "Hi there" and got[2] == "[No content]"
    assert len(got[3]) == 100 and got[3].endswith("...")


def test_greedy_dedupe_matches_scan(spark):
    rnd = random.Random(7)
    for trial in range(3):
        rows = [(i, f"u{rnd.randrange(12)}", f"t{rnd.randrange(6)}", f"d{rnd.randrange(2)}") for i in range(80)]
        df = spark.createDataFrame(rows, "seq long, url string, title string, date string")
        got = sorted(r.seq for r in dedupe.greedy_dedupe(df).collect())
        assert got == kept_by_scan(rows)
    # S.7 triple: A=(u1,t1), B=(u2,t1), C=(u2,t2) keeps A and C
    df = spark.createDataFrame([(0, "u1", "t1", "d"), (1, "u2", "t1", "d"), (2, "u2", "t2", "d")],
                               "seq long, url string, title string, date string")
    assert sorted(r.seq for r in dedupe.greedy_dedupe(df).collect()) == [0, 2]


def test_empty_inputs(spark):
    df = actions(spark, [dict(seq=0, id="x")]).limit(0)
    assert validate.validate(df, RUN).count() == 0
    assert labels.assign_labels(df).count() == 0
    assert stats.export_table(df).count() == 0
    assert search.query(df, "a").count() == 0
    assert stats.export_audit(df).collect()[0].valid


def test_keyword_mask_single_scan_equals_per_label(spark):
    texts = ["water quality and tax credit rules", "co-governance of kāinga ora homes", "railways", "rentals",
             "public transport safety", "te whatu ora pharmac", "", "taxation", "work and income support"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    a = [r[0] for r in df.select(labels.keyword_mask(F.col("t"))).collect()]
    b = [r[0] for r in df.select(labels.keyword_mask_per_label(F.col("t"))).collect()]
    assert a == b
    assert a[2] == 0 and a[3] == 0  # no whole-word keyword inside 'railways' / 'rentals'


def test_query_total_matched_and_strict_split(spark):
    rows = [dict(seq=i, id=f"parl-2024-{i:03d}", title="Housing Bill" if i % 2 else "Roads", source_system="PARLIAMENT",
                 url=f"https://a.nz/{i}", date=f"2024-01-{1 + i:02d}", summary="s") for i in range(6)]
    df = labels.assign_labels(actions(spark, rows))
    out = search.query_with_total(df, "housing", "PARLIAMENT", ["Housing"], "newest")
    got = out.orderBy("pos").collect()
    assert [r.seq for r in got] == [5, 3, 1]
    assert {r.total_matched for r in got} == {3}
    bad = actions(spark, rows[:2] + [dict(seq=9, title="t", url="https://a.nz/9", source_system="nowhere")])
    ok, rejected = validate.split_strict(validate.validate(bad, RUN))
    assert sorted(r.seq for r in ok.collect()) == [0, 1]
    assert [r.seq for r in rejected.collect()] == [9]


def test_with_position_matches_python_sort(spark):
    from actlens.functions.order import with_position

    rnd = random.Random(11)
    rows = [(i, rnd.randrange(50), rnd.choice(["a", "b", None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "seq long, k int, s string").repartition(37)
    got = {r.seq: r.pos for r in with_position(df, F.col("k").desc(), F.col("s").asc_nulls_last(), F.col("seq"),
                                               total_col="n").collect()}
    expect = sorted(rows, key=lambda r: (-r[1], r[2] is None, r[2] or "", r[0]))
    assert [got[r[0]] for r in expect] == list(range(1, len(rows) + 1))


def kept_by_scan(rows):
    """seq of each (seq, url, title, date) whose url and whose title with date no kept row before it has."""
    urls, titles, keep = set(), set(), []
    for seq, url, title, date in sorted(rows):
        keys = (url or "", f"{title}_{date}")
        if keys[0] not in urls and keys[1] not in titles:
            urls.add(keys[0])
            titles.add(keys[1])
            keep.append(seq)
    return keep


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_with_position_keeps_every_wide_row(spark, coalesce):
    from actlens.functions.order import with_position

    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        df = spark.range(20_000).select("id", F.xxhash64("id").alias("k"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 16).alias("wide"))
        out = with_position(df, "k", "id", total_col="n")
        assert out.count() == 20_000 and out.select("n").distinct().collect()[0][0] == 20_000
        got = [r.pos for r in out.orderBy("k", "id").select("pos").collect()]
        assert got == list(range(1, 20_001))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_no_machine_local_folder_on_a_cluster():
    from actlens import session

    assert session.is_local("local[4]") and not session.is_local("local-cluster[2,1,1024]") and not session.is_local("yarn")


def test_active_session_stays_as_it_is(spark):
    from actlens.session import get_spark

    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "777")
    try:
        assert get_spark().conf.get("spark.sql.shuffle.partitions") == "777"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_first_sentence_reads_its_text_once(spark):
    from actlens.operators.display import audit_lines, first_sentence
    rows = [(1, "t", "<p>One  two. Three", "2024-01-01", "u"), (2, None, " <b></b> ", None, None), (3, "t", "?!", "d", "u" * 90)]
    df = spark.createDataFrame(rows, "seq long, title string, summary string, date string, url string")
    plan = df.select(first_sentence(F.col("summary")).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<[^>]+>") == 1
    got = [(r.item_number, r.first_sentence) for r in audit_lines(df).orderBy("seq").collect()]
    assert got == [(1, "One two"), (2, "[No readable content]"), (3, "[Empty content]")]
