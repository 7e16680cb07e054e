"""All feeds from one job: each equal to its feed view, valid documents, newest first across files."""

import glob
import re
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from actlens import rules
from actlens.operators import feeds_out as fo
from actlens.operators import search as srch

DDL = ("seq long, id string, title string, date string, source_system string, url string, summary string, labels array<string>")


def actions(n=240):
    out = []
    for k in range(n):
        labels = [rules.LABELS[(k * 7) % 15], rules.LABELS[(k * 3) % 15]][:k % 3]
        date = f"2024-{1 + k % 12:02d}-{1 + k % 28:02d}" if k % 11 else "soon"
        out.append((k, f"id{k}", f"Title <{k}> & \x01more", date, rules.SOURCES[k % 4] if k % 17 else None, f"https://x/{k}",
                    None if k % 5 == 0 else "line\nbreak\r ]]>", labels if k % 13 else None))
    return out


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    df = spark.createDataFrame(actions(), DDL).repartition(5)
    path = str(tmp_path_factory.mktemp("feeds") / "out")
    fo.write_feeds(df, path)
    return df, path


def items(path, feed):
    out = []
    for name in sorted(glob.glob(f"{path}/feed={feed}/part-*")):
        channel = ET.parse(name).getroot().find("channel")  # every file is a document
        assert channel.find("title").text.startswith("Public actions") and channel.find("link").text
        out += [i.find("guid").text for i in channel.findall("item")]
    return out


def test_every_feed_is_its_view(spark, written):
    df, path = written
    rows = df.collect()
    key = lambda r: (r.date if re.match(r"^\d{4}-\d{2}-\d{2}$", r.date) else "", -r.seq)
    feeds = fo.feeds()
    assert len(feeds) == 80
    some = 0
    for source, label in feeds:
        want = sorted((r for r in rows if source in (fo.ALL, r.source_system) and (label is None or label in (r.labels or []))),
                      key=key, reverse=True)
        got = items(path, (source + (f"~{label}" if label else "")).replace(" ", " "))
        assert got == [r.id for r in want], (source, label)
        some += bool(got)
    assert some > 40
    view = srch.feed_view(df, "GAZETTE", rules.LABELS[0]).orderBy("pos").collect()
    assert items(path, f"GAZETTE~{rules.LABELS[0]}") == [r.id for r in view]


def test_texts_are_kept(spark, written):
    _, path = written
    found = {}
    for name in glob.glob(f"{path}/feed=ALL/part-*"):
        for i in ET.parse(name).getroot().find("channel").findall("item"):
            found[i.find("guid").text] = (i.find("title").text, i.find("description").text if i.find("description") is not None else None)
    assert found["id1"] == ("Title <1> & �more", "line\nbreak\r ]]>") and found["id5"][1] is None


def test_read_back(spark, written):
    df, path = written
    got = spark.read.format("xml").option("rowTag", "item").schema("guid string, category array<string>").load(f"{path}/feed=ALL")
    assert got.count() == df.count()


def test_positions(spark, written):
    df, _ = written
    rows = fo.feed_rows(df).where("feed_source = 'GAZETTE' AND feed_label IS NULL").select("pos", "id").orderBy("pos").collect()
    view = srch.feed_view(df, "GAZETTE").select("pos", "id").orderBy("pos").collect()
    assert rows == view


def test_no_actions(spark, tmp_path):
    df = spark.createDataFrame([], DDL)
    fo.write_feeds(df, str(tmp_path / "out"))
    assert fo.feed_rows(df).collect() == []


def test_texts_are_stored_once(spark, tmp_path, monkeypatch):
    """What is stored on the way has an action's texts once, whatever the number of its feeds."""
    stored = []

    def kept(df, name, *args):
        stored.append(out := materialize(df, name, *args))
        return out

    materialize = fo.materialize
    monkeypatch.setattr(fo, "materialize", kept)
    df = spark.createDataFrame(actions(90), DDL)
    fo.write_feeds(df, str(tmp_path / "out"), compression="gzip")
    rows = fo.feed_rows(df).select("title", "feed_source", "feed_label").collect()
    assert len(rows) > 300 and {r.title for r in rows} == {a[2] for a in actions(90)}
    wide = [d for d in stored if {"title", "summary", "_item"} & set(d.columns)]
    assert [d.count() for d in wide] == [90, 90]
    back = spark.read.format("xml").option("rowTag", "item").schema("guid string, feed string").load(str(tmp_path / "out"))
    assert back.count() == len(rows)
