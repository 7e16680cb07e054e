"""Boundary sets against sorted lists; fill-in-middle against plain Python on odd rows."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from actlens.llm import fill_in_middle as fim
from actlens.llm.boundaries import BoundarySet, line_boundaries


@pytest.mark.parametrize("positions, kinds", [
    ([0, 5, 9, 70000, 200001], {"array"}),
    (list(range(0, 65536, 2)) + [3 * 65536 + 1], {"bitmap", "array"}),
    (list(range(100, 30000)) + list(range(40000, 65536 + 500)), {"runs"}),
    (sorted(set(np.random.default_rng(1).integers(0, 300000, 40000).tolist())), {"bitmap"}),
    ([], set()),
])
def test_select(positions, kinds):
    found = BoundarySet.of(positions)
    assert {c.kind for c in found.containers} == kinds
    assert found.size == len(positions)
    some = range(len(positions)) if len(positions) < 1000 else np.random.default_rng(2).integers(0, len(positions), 3000).tolist()
    assert all(found.select(k) == positions[k] for k in some)
    with pytest.raises(IndexError):
        found.select(len(positions))


@pytest.mark.parametrize("text", [
    "", "\n", "a", "a\n", "a\nb", "\n\n\n", "é\n日本\n\U0001f600\n", "x" * 65535 + "\n", "x" * 65536 + "\ny", "x" * 65536,
    "\n" * 70000, "ab\n" * 50000 + "z", "x" * 200000])
def test_line_boundaries(text):
    ends = [0]
    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        ends.append(ends[-1] + len(line))
    found = line_boundaries(text)
    assert found.size == len(ends)
    assert all(found.select(k) == ends[k] for k in (range(len(ends)) if len(ends) < 500 else range(0, len(ends), 97)))


def by_hand(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(lines), "plain", None, None, text
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    spm = h[3] % 100 < spm
    return len(lines), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def odd_rows():
    rows = [(None, "a\nb\nc"), (1, None), (2, ""), (3, "one line"), (3, "one line"), (4, "\n\n\n"), (5, "a<S>b\nc"), (6, "x<\nS>\n<P"),
            (7, "日本\nのテキスト\n\U0001f600\n"), (8, "<\n<P\n<S\n>"), (9, "ab\n" * 60000 + "end"), (10, "x" * 300000), (-11, "k\nl")]
    return rows + [(20 + k, "\n".join(f"line {j}" for j in range(k))) for k in range(30)]


@pytest.mark.parametrize("rate, spm", [(100, 50), (60, 20)])
def test_against_plain_python(spark, rate, spm):
    docs = spark.createDataFrame(odd_rows(), "doc_id long, text string").withColumns(
        {c: F.lit(1) for c in ("n", "form", "cut_a", "output", "_c", "h1")})
    found = fim.fill_in_middle(docs, rate=rate, suffix_first=spm)
    found = found.withColumn("back", fim.restored(F.col("output"), F.col("form")))
    got = sorted(((r.doc_id, r.n, r.form, r.cut_a, None if r.cut_a is None else r.cut_b - r.cut_a, r.output) for r in found.collect()), key=repr)
    want = sorted(((i, *by_hand(i, t, rate=rate, spm=spm)) for i, t in odd_rows()), key=repr)
    assert got == want
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert all(r.back == r.text for r in found.collect())


def test_empty_table(spark):
    assert fim.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_marks_are_checked():
    with pytest.raises(ValueError):
        fim._check(("<P>", "<P>", "<M>"))
    with pytest.raises(ValueError):
        fim._check(("<<P>", "<S>", "<M>"))
