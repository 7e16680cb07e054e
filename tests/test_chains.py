"""Components by doubling, and the greedy scan on chains: against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from actlens.functions import graph
from actlens.operators import dedupe


def scan(rows):
    """The sequential rule over (seq, url, title)."""
    urls, titles, kept = set(), set(), []
    for seq, url, title in sorted(rows):
        if url not in urls and title not in titles:
            urls.add(url)
            titles.add(title)
            kept.append(seq)
    return kept


def chain(n, order=None):
    """Row k shares its URL with one neighbour and its title with the other."""
    seqs = list(range(n)) if order is None else order
    return [(int(seqs[k]), f"u{(k + 1) // 2}", f"t{k // 2}") for k in range(n)]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "seq long, url string, title string")
    return df.withColumn("date", F.lit("2025-01-01"))


def kept(spark, rows, bound):
    return sorted(r.seq for r in dedupe.greedy_dedupe(frame(spark, rows), bound).select("seq").collect())


def jobs(spark, group, fn):
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = fn()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setJobGroup("", "")


def test_components(spark):
    rng = np.random.default_rng(2)
    nodes, links = 300, [(int(a), int(b)) for a, b in rng.integers(0, 300, (170, 2))]
    links += [(k, k + 1) for k in range(400, 480)] + [(7, 7)]
    ids = list(range(nodes)) + list(range(400, 482))
    parent = {k: k for k in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = graph.components(spark.createDataFrame([(k,) for k in ids], "node long"), spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == {k: find(k) for k in ids}


def test_components_of_nothing(spark):
    none = spark.createDataFrame([], "a long, b long")
    assert graph.components(spark.createDataFrame([(3,)], "node long"), none).collect() == [(3, 3)]
    assert graph.components(spark.createDataFrame([], "node long"), none).collect() == []


@pytest.mark.parametrize("bound", [9])
def test_random_rows(spark, bound):
    rng = np.random.default_rng(bound)
    rows = [(k, f"u{rng.integers(90)}", f"t{rng.integers(70)}") for k in range(220)]
    assert kept(spark, rows, bound) == scan(rows)


def test_random_chain(spark):
    order = np.random.default_rng(3).permutation(120)
    rows = chain(160, order)
    assert kept(spark, rows, 20) == scan(rows)


def test_zigzag(spark):
    """Every second row has two earlier neighbours."""
    n = 90
    order = [k // 2 if k % 2 == 0 else n // 2 + k // 2 for k in range(n)]
    rows = chain(n, order)
    assert kept(spark, rows, 5) == scan(rows)


def test_long_chains_take_few_jobs(spark):
    counts = {}
    for n in (64, 1024):
        rows = chain(n)
        got, counts[n] = jobs(spark, f"chain-{n}", lambda: kept(spark, rows, 20))  # noqa: B023
        assert got == scan(rows) == list(range(0, n, 2))
    assert counts[1024] < 2 * counts[64]


def test_bounded_rows_are_one_scan(spark):
    rows = chain(100_000)
    assert kept(spark, rows, dedupe.BOUND) == list(range(0, 100_000, 2))


def test_empty(spark):
    assert kept(spark, [], 10) == []
