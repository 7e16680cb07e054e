"""Tiers as readers: what is read, what isn't, and what raises."""

import pytest

from actlens.sources.combine import cascade, cascade_sources


def rows(spark, n, start=0):
    return lambda: spark.range(start, start + n)


def never():
    raise AssertionError("this tier must not be read")


def broken():
    raise OSError("gone\nfor good")


def ids(found):
    return None if found is None else sorted(r.id for r in found.collect())


def test_later_tiers_are_not_read(spark):
    found = cascade([rows(spark, 3), never])
    assert (ids(found.rows), found.used, found.problems) == ([0, 1, 2], [0], {})
    found = cascade([rows(spark, 0), rows(spark, 2, 10), never])
    assert (ids(found.rows), found.used) == ([10, 11], [1])


def test_tier_that_raises_counts_as_empty(spark):
    found = cascade([broken, rows(spark, 1)])
    assert (ids(found.rows), found.used, found.problems) == ([0], [1], {0: "OSError: gone"})
    assert cascade([broken, rows(spark, 0)]).rows is None and cascade([]).rows is None


@pytest.mark.parametrize("n, read_person", [(0, True), (9, True), (10, False), (11, False)])
def test_gate(spark, n, read_person):
    person = rows(spark, 3, 100) if read_person else never
    found = cascade([rows(spark, n), person], least=10, add=True)
    assert ids(found.rows) == list(range(n)) + ([100, 101, 102] if read_person else [])


def test_too_few_rows_everywhere(spark):
    assert ids(cascade([rows(spark, 2), rows(spark, 3, 10)], least=5).rows) == [0, 1]


def test_sources(spark):
    out = cascade_sources({"A": [rows(spark, 0), rows(spark, 2)], "B": [rows(spark, 1, 5), never], "C": [broken]})
    assert sorted(tuple(r) for r in out.collect()) == [(0, "A", 2), (1, "A", 2), (5, "B", 1)]
    assert cascade_sources({"C": [broken]}) is None
