"""The contained run: broken files, documents, sources, builders and stages."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from actlens.plans import run as runs
from actlens.sources import landing

TS = dt.datetime(2025, 12, 16, 9, 30)
ACT = ("<entry><title>Act {k}</title><link href='https://www.legislation.govt.nz/act/public/2024/0{k}/latest/whole.html'/>"
       "<published>2025-01-0{k}T10:00:00+13:00</published><content>Information type: Acts&lt;br /&gt;Year: 2024&lt;br /&gt;No: 00{k}&lt;br /&gt;"
       "Version: as enacted</content></entry>")
BILL = '{{"billNumber": "{k}", "title": "Bill {k}", "url": "https://bills.parliament.nz/v/6/BILL{k}", "introductionDate": "2025-02-03"}}'


@pytest.fixture()
def landed(spark, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    (feed / "a.xml").write_text("<feed>" + "".join(ACT.format(k=k) for k in (1, 2, 3)) + "</feed>")
    (feed / "b.xml").write_text("<feed>" + ACT.format(k=4) + ACT.format(k=5)[:80])
    (feed / "c.xml").write_text("<feed/>")
    bills = [(0, '{"items": [' + BILL.format(k=101) + "," + BILL.format(k=102) + "]}"), (1, '{"items": [' + BILL.format(k=103)),
             (2, "not json at all"), (3, None), (4, '{"items": []}'), (5, '{"results": [' + BILL.format(k="x") + "]}")]
    payloads = spark.createDataFrame(bills, "doc_seq long, payload string")
    return {"LEGISLATION": lambda: landing.land_act_feed(spark, str(feed), TS), "PARLIAMENT": lambda: landing.land_bill_json(payloads)}


def raises(*_):
    raise RuntimeError("on purpose\nwith more lines")


def table(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_broken_files_and_documents(spark, landed):
    found = runs.run(spark, landed, TS)
    assert found.success
    assert table(found.quarantine, "stage", "source", "reason", F.element_at(F.split("file", "/"), -1), F.when(F.col("reason") == "not JSON", F.col("place"))) == sorted([
        ("collect", "LEGISLATION", "unclosed token", "b.xml", None), ("collect", "PARLIAMENT", "not JSON", None, 1),
        ("collect", "PARLIAMENT", "not JSON", None, 2), ("collect", "PARLIAMENT", "not JSON", None, 3)], key=repr)
    raw = {r.place: r.raw for r in found.quarantine.where("reason = 'not JSON'").collect()}
    assert raw[2] == "not json at all" and raw[3] == ""
    got = {(r.stage, r.source): (r.input_rows, r.output_rows, r.rejected_rows, r.success) for r in found.metrics.collect()}
    assert got["collect", "LEGISLATION"] == (4, 3, 1, True) and got["collect", "PARLIAMENT"] == (6, 3, 3, True)
    assert got["convert", "LEGISLATION"] == (3, 3, 0, True) and got["convert", "PARLIAMENT"] == (3, 3, 0, True)
    for stage in runs.STAGES:
        assert got[stage, "ALL"] == (6, 6, 0, True)
    assert got["export", "ALL"] == (6, 6, 0, True)
    rows = found.rows.orderBy("pos").collect()
    assert [r.pos for r in rows] == [1, 2, 3, 4, 5, 6] and rows[0].date == "2025-02-03"
    # sources in their fixed order, records in the order they came
    assert [r.id for r in sorted(rows, key=lambda r: r.seq)][0].startswith("parl-") and sorted(r.seq for r in rows) == list(range(6))


def test_documents_and_records_are_stored_once(spark, landed, monkeypatch):
    """Quarantine and items read the same stored documents; ordered records hold their check and aren't stored again."""
    good, bad = landing.land_json(spark.createDataFrame([(1, "{}"), (2, "{"), (3, None)], "doc_seq long, payload string"), "GAZETTE")
    assert good.inputFiles() and set(good.inputFiles()) == set(bad.inputFiles())
    assert good.columns == ["doc_seq", "payload"] and [r.doc_seq for r in good.collect()] == [1]
    assert table(bad, "place", "raw") == [(2, "{"), (3, "")]
    names = []
    store = runs.materialize
    monkeypatch.setattr(runs, "materialize", lambda df, name: (names.append(name), store(df, name))[1])
    log = runs._Log(spark)
    records, counts = runs.convert(runs.collect(landed, log), TS, log)
    assert "converted" not in names and counts == {"LEGISLATION": 3, "PARLIAMENT": 3}
    assert sorted(r.seq for r in records.collect()) == list(range(6)) and "reject_reason" not in records.columns


def late(df, ts):
    """A stage whose plan only fails when it runs."""
    return df.withColumn("title", F.raise_error(F.lit("boom")).cast("string"))


def test_sources_and_builders_that_raise(spark, landed):
    fails_late = lambda: (spark.range(5).select(F.col("id").alias("seq"), F.raise_error(F.lit("boom")).cast("string").alias("title")),
                          landing.no_quarantine(spark))
    found = runs.run(spark, landed | {"GAZETTE": raises, "BEEHIVE": fails_late}, TS, builders=runs.BUILDERS | {"PARLIAMENT": raises})
    assert found.success and {r.source_system for r in found.rows.collect()} == {"LEGISLATION"}
    assert table(found.metrics.where("NOT success"), "stage", "source", "input_rows", "output_rows") == [
        ("collect", "BEEHIVE", 0, 0), ("collect", "GAZETTE", 0, 0), ("convert", "PARLIAMENT", 3, 0)]
    errors = {(r.stage, r.source): r.message for r in found.messages.where("level = 'error'").collect()}
    assert errors["collect", "GAZETTE"] == errors["convert", "PARLIAMENT"] == "RuntimeError: on purpose" and len(errors) == 3
    assert table(found.quarantine.where("source = 'GAZETTE'"), "reason") == [("RuntimeError: on purpose",)]
    one = runs.summary(found.metrics, found.messages).first()
    assert (one.total_scraped, one.total_processed, one.errors) == (6, 3, 3)
    assert one.scraping_success_rate == 0.5 and one.processing_success_rate == 1.0


@pytest.mark.parametrize("broken", [{"validate": late, "labels": raises}, {"versions": late}])
def test_stages_that_raise(spark, landed, broken):
    """A stage that spoils records comes first: the check sets them apart with the field, the others go on."""
    spoil = lambda df, ts: df.withColumn("url", F.when(F.col("seq") % 2 == 0, "nowhere").otherwise(F.col("url")))
    found = runs.run(spark, landed, TS, stages={"spoil": spoil, **runs.STAGES, **broken})
    assert found.success and sorted(r.seq for r in found.rows.collect()) == [1, 3, 5]
    assert table(found.quarantine.where("stage = 'spoil'"), "place", "reason") == [(0, "url"), (2, "url"), (4, "url")]
    assert table(found.messages.where("stage = 'spoil'"), "level", "row", "message") == [
        ("warning", k, "Record refused: url") for k in (0, 2, 4)]
    got = {r.stage: r.success for r in found.metrics.where("source = 'ALL'").collect()}
    assert got == dict.fromkeys(["spoil", "validate", "versions", "labels", "export"], True) | dict.fromkeys(broken, False)
    assert sorted(r.stage for r in found.messages.where("level = 'error'").collect()) == sorted(broken)


def test_nothing_to_read(spark):
    found = runs.run(spark, {"GAZETTE": raises}, TS)
    assert not found.success and found.rows.collect() == []
    assert "No data from any source" in [r.message for r in found.messages.collect()]
    assert not runs.run(spark, {}, TS).success


def test_store_merges_runs(spark, landed, tmp_path):
    store = runs.RunStore(spark, str(tmp_path / "runs"))
    store.write(runs.run(spark, landed, TS))
    second = runs.run(spark, landed | {"GAZETTE": raises}, TS + dt.timedelta(days=1), limit=1)
    store.write(second)
    store.write(second)  # again: replaces itself
    got = {(r.stage, r.source): r for r in store.merged().collect()}
    one = got["collect", "PARLIAMENT"]
    assert (one.runs, one.failures, one.output_rows, one.last_success) == (2, 0, 3 + 1, True)
    assert (got["collect", "GAZETTE"].runs, got["collect", "GAZETTE"].failures) == (1, 1)
    assert got["export", "ALL"].output_rows == 6 + 2
    assert store.read("quarantine").groupBy("run").count().count() == 2
