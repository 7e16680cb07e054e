"""Every registered query against its DuckDB oracle on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tools.oracle_check import canon, duck

SF = "/root/testdata/sf0.001"
SLOW = {"pipeline", "run_report", "convert", "convert_rejects", "greedy_dedupe", "indexed_search"}
NAMES = sorted(n for n in entry.oracle_sql() if n not in SLOW)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, con, name):
    sdf = entry.queries()[name](spark, SF)
    sc, sv = canon(sdf.columns, [tuple(r) for r in sdf.collect()])
    res = con.execute(entry.oracle_sql()[name])
    dc, dv = canon([d[0] for d in res.description], res.fetchall())
    assert sc == dc
    assert sv == dv


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["seq", "id", "pos"]
    df.collect()
