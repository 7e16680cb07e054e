"""Nearest neighbours against all pairs in plain Python; bounds of the codes."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from actlens.llm import neighbours as nb

SMALL = "/root/testdata/sf0.001"


def by_hand(rows, k, every):
    rows = [(i, v) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    out = []
    for a, (q, x) in enumerate(rows):
        if q is None or q % every:
            continue
        found = []
        for b, (c, y) in enumerate(rows):
            if a != b and len(x) == len(y):
                score = 0.0
                for s, t in zip(x, y):
                    score += s * t
                if score == score:
                    found.append((-score, float("inf") if c is None else c))
        out += [(q, r, None if c == float("inf") else c, -s) for r, (s, c) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def odd_rows(seed, n=400):
    rng = np.random.default_rng(seed)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(n)]
    rows += [(k, rows[k][1]) for k in range(0, 60, 3)]  # repeated rows
    rows += [(1000 + k, rows[20][1]) for k in range(40)]  # ties beyond k
    rows += [(-20, (rng.normal(size=8) * 1e150).tolist()), (2000, (rng.normal(size=8) * 1e-200).tolist()), (2020, [5e-324] + [0.0] * 7)]
    rows += [(None, rows[3][1]), (None, rows[3][1]), (2040, None), (2060, []), (2080, [0.0] * 8), (2100, [1.0, None] * 4),
             (2120, [float("nan")] * 8), (2140, [float("inf")] + [1.0] * 7), (2160, [1.0, 2.0]), (2161, [2.0, 1.0]), (2180, [-1.0] * 3)]
    return rows


@pytest.mark.parametrize("block_rows, stripe_rows, k", [(16384, 65536, 20), (7, 90, 20), (5, 33, 3)])
def test_against_all_pairs(spark, block_rows, stripe_rows, k):
    rows = odd_rows(block_rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).withColumns(
        {c: F.lit("x") for c in ("row", "tile", "dims", "codes", "score", "rank")})
    found = nb.nearest(df, F.col("vec_id") % 20 == 0, k, block_rows=block_rows, stripe_rows=stripe_rows)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == by_hand(rows, k, 20)


def test_float_vectors(spark):
    rows = [(i, np.float32(v).tolist()) for i, v in odd_rows(9, 200) if i not in (-20,) and v and None not in v]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(i, np.float32(v).astype(float).tolist()) for i, v in rows]
    assert sorted((tuple(r) for r in nb.nearest(df, F.col("vec_id") % 20 == 0).collect()), key=repr) == by_hand(rows, 20, 20)


def test_empty_table(spark):
    assert nb.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect() == []


def test_bounds_hold():
    rng = np.random.default_rng(4)
    for dims in (3, 64, 2500):
        x, y = (rng.normal(size=(200, dims)) * rng.lognormal(size=(200, 1)) * (1 + 50 * (rng.random((200, dims)) > 0.99)) for _ in range(2))
        (cx, sx, lx, ex), (cy, sy, ly, ey) = nb.code_rows(x), nb.code_rows(y)
        near = nb.coded_products(cx.astype(np.float32), cy.astype(np.float32))
        assert (near == cx.astype(np.int64) @ cy.astype(np.int64).T).all()
        error = ex[:, None] * ly + (lx + ex)[:, None] * ey
        assert (np.abs(near * sx[:, None] * sy - x @ y.T) <= error * (1 + 1e-9)).all()


def test_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS FROM '{SMALL}/embeddings.parquet'")
    want = con.sql(nb.ORACLE)
    got = nb.op12_neighbours(spark, SMALL)
    assert sorted(tuple(r) for r in got.select(*want.columns).collect()) == sorted(want.fetchall())
