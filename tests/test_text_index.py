"""The trigram index against the scan it stands for."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from actlens import adapter
from actlens.operators import labels as lab
from actlens.operators import search as srch
from actlens.operators import text_index as ti

SMALL = "/root/testdata/sf0.001"
FIELDS = ("seq long, id string, title string, summary string, primary_entity string, url string, labels array<string>, metadata struct<"
          "bill_number: string, act_number: string, notice_number: string, notice_type: string, document_type: string, portfolio: string, "
          "parliament_number: int, commencement_date: string, stage_history: array<struct<stage: string, date: string>>>")


@pytest.fixture(scope="module")
def real(spark):
    df = lab.assign_labels(adapter.actions(spark, SMALL))
    return df, ti.build_index(df, shards=5, segment_rows=17, segment_postings=9000)


def odd_records():
    meta = (None,) * 6 + (None, None, None)
    texts = ["ΟΔΟΣ ΑΣ", "οδοσα", "ΟΔΟΣΑΣ τέλος", "İstanbul", "i̇stanbul", "STRASSE Straße", "ﬁne", "Ⓐbc ABC", "\U00010400bcd", "\U00010428bcd",
             "  padded  ", "ab", "", None, "aXb", "日本語テキスト", "a\nb c", "x" * 70000 + "needle", "Health", " health "]
    rows = [(k, f"id-{k}", t, None, None, None, None, meta) for k, t in enumerate(texts)]
    rows += [(100, None, None, "whole summary", "Entity", "https://u/x", ["Housing", None, ""], meta),
             (101, "dup", "t", "s", "e", "u", [], ("54-1", "2024 No 1", "2024-go1", "General", "Speech", "Finance", 0, "2024-01-02",
                                                  [("First Reading", "2024-01-05"), None])),
             (102, "dup", "t", "s", "e", "u", [], ("54-1", None, None, None, None, None, 541, None, None)),
             (103, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(odd_records(), FIELDS).repartition(4)
    return df, ti.build_index(df, shards=3, segment_rows=4)


def seqs(df):
    return sorted(r.seq for r in df.select("seq").collect())


NEEDLES = ["οδοσ", "ΟΔΟΣΑ", "İst", "straße", "ﬁn", "Ⓐbc", "\U00010400bc", "  padded  ", "a", "axb", "語テキ", "\nb", "xneedle", "541", "SummaryEntity"]
SOME = [srch.SearchConfig(exact_match=True), srch.SearchConfig(search_metadata=False), srch.SearchConfig(search_stage_history=False)]
CASES = ([(n, srch.SearchConfig()) for n in NEEDLES] + [(n, srch.SearchConfig(case_sensitive=True)) for n in NEEDLES[:4]]
         + [("health", SOME[0]), ("54-1", SOME[1]), ("first reading", SOME[2])])


def test_odd_texts(spark, odd):
    df, index = odd
    conditions = [srch.search_condition(n, c) for n, c in CASES]
    hits = df.select("seq", *[F.coalesce(c, F.lit(False)).alias(f"c{k}") for k, c in enumerate(conditions)]).collect()
    for k, (needle, cfg) in enumerate(CASES):
        got = seqs(ti.indexed_search(spark, index, needle, cfg, shards=3, scan_share=1.0))
        assert got == sorted(r.seq for r in hits if r[f"c{k}"]), needle
    assert sum(r[f"c{k}"] for r in hits for k in range(len(CASES))) > 25
    assert seqs(ti.indexed_search(spark, index, "  ", shards=3)) == seqs(df)


def test_random_needles(spark, real):
    df, index = real
    rng = np.random.default_rng(5)
    texts = [v for r in df.select("title", "summary", "url", "id").limit(60).collect() for v in r if v]
    hits = 0
    for k in range(8):
        text = texts[rng.integers(len(texts))]
        at = int(rng.integers(max(1, len(text) - 12)))
        needle = text[at:at + int(rng.integers(3, 12))]
        cfg = srch.SearchConfig(case_sensitive=bool(k % 2))
        got = seqs(ti.indexed_search(spark, index, needle, cfg, shards=5, scan_share=1.0))
        assert got == seqs(srch.search(df, needle, cfg)), needle
        hits += bool(got)
    assert hits > 4


def test_scan_where_trigrams_tell_nothing(spark, real):
    df, index = real
    assert ti.candidates(spark, index, "ab", 5) is None
    assert ti.candidates(spark, index, "https://", 5) is None  # in every row
    assert ti.candidates(spark, index, "https://", 5, scan_share=1.0) is not None
    assert seqs(ti.indexed_search(spark, index, "https://", shards=5)) == seqs(srch.search(df, "https://"))


def test_reads_its_own_postings(spark, real):
    _, index = real
    found, bound = ti.candidates(spark, index, "housing", 5, scan_share=1.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [shard" in plan and "PushedFilters: [In(gram" in plan
    assert bound < index.records(spark).count()
    plan = ti.indexed_search(spark, index, "housing", shards=5, scan_share=1.0)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("rows", [[], [0], [5], [1, 2, 127, 128, 129, 70000, 1 << 33, (1 << 33) + 1, (1 << 50) + 7]])
def test_postings_round_trip(rows):
    assert ti.decode_postings(ti.encode_postings(np.array(rows, np.int64))).tolist() == rows


def test_empty_table(spark):
    df = spark.createDataFrame([], FIELDS)
    index = ti.build_index(df, shards=2)
    assert ti.indexed_search(spark, index, "housing", shards=2).collect() == []
