"""Fill-in-middle transformation: texts cut at two line ends and put in another order.

The line ends of a text are a compressed boundary set (``boundaries``); the
two drawn line numbers are looked up there, which gives the code points of
both cuts.  Python gets the text and the numbers and returns the offsets; the
texts themselves are cut and joined by column functions, with no shuffle.

Draws are the first 32-bit groups of sha256(``seed:doc_id``), so a document
gets the same cuts in every run and partition.  A text that holds a mark
stays plain; in every other output each mark occurs once, as no mark can
begin inside a text and end in a mark, so ``restored`` is exact.

Defined results: a null text is an empty one, which stays plain, with 0
lines; a null doc_id is the empty string in the draw; rows with the same
doc_id get the same draw and are transformed each on its own.  Columns other
than doc_id and text aren't carried, whatever their names.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actlens.llm.boundaries import line_boundaries
from actlens.llm.common import table

SEED = 7
MARKS = ("<P>", "<S>", "<M>")
#: Of 100 texts, those that are transformed, and those of them with the suffix first.
RATE = 100
SUFFIX_FIRST = 50

#: Rows of a batch that are Python strings at one time.
_ROWS = 64


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in ("n", "cut_a", "cut_b")]))
def _cuts(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    found = []
    for at in range(0, len(text), _ROWS):
        for t, a, b in zip(*(c.slice(at, _ROWS).to_pylist() for c in (text, h1, h2))):
            ends = line_boundaries(t)
            n = ends.size - 1
            a, b = sorted((a % (n + 1), b % (n + 1)))
            found.append((n, ends.select(a), ends.select(b)))
    columns = list(zip(*found)) or [[], [], []]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["n", "cut_a", "cut_b"])


def _check(marks: tuple[str, str, str]) -> None:
    for m in marks:
        if len(m) < 3 or m[0] != "<" or m[-1] != ">" or "<" in m[1:] or ">" in m[:-1]:
            raise ValueError(f"a mark is <...> without inner angles: {m}")
    if len(set(marks)) < 3:
        raise ValueError("the marks must differ")


def _part(text: Column, start: Column, end: Column) -> Column:
    """Code points start (from 0) to end."""
    return F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST,
                   marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """doc_id, text, n lines, form (plain, psm, spm), cut_a, cut_b (code points; null if plain), output."""
    _check(marks)
    p, s, m = marks
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring(draw, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn(
        "_c", _cuts(F.col("text"), h[0], h[1]))
    text = F.col("text")
    plain = (text == "") | text.contains(p) | text.contains(s) | text.contains(m) | (h[2] % 100 >= rate)
    rows = rows.select("doc_id", "text", F.col("_c.n").alias("n"), F.when(plain, "plain").when(
        h[3] % 100 < suffix_first, "spm").otherwise("psm").alias("form"), F.col("_c.cut_a").alias("cut_a"), F.col("_c.cut_b").alias("cut_b"))
    a, b = F.col("cut_a"), F.col("cut_b")
    prefix, middle, suffix = _part(text, F.lit(0), a), _part(text, a, b), _part(text, b, F.length(text))
    form = F.col("form")
    cut = form != "plain"
    return rows.select("doc_id", "text", "n", "form", F.when(cut, a).alias("cut_a"), F.when(cut, b).alias("cut_b"),
                       F.when(~cut, text).when(form == "psm", F.concat(F.lit(p), prefix, F.lit(s), suffix, F.lit(m), middle))
                       .otherwise(F.concat(F.lit(s), suffix, F.lit(p), prefix, F.lit(m), middle)).alias("output"))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text, from the output and its form alone."""
    p, s, m = marks

    def between(first: str, last: str) -> tuple[Column, Column, Column]:
        body = F.substring(output, F.lit(len(first) + 1), F.length(output))
        one = F.substring_index(body, last, 1)
        rest = F.substring(body, F.length(one) + len(last) + 1, F.length(body))
        two = F.substring_index(rest, m, 1)
        return one, two, F.substring(rest, F.length(two) + len(m) + 1, F.length(rest))

    prefix, suffix, middle = between(p, s)
    suffix2, prefix2, middle2 = between(s, p)
    return (F.when(form == "plain", output).when(form == "psm", F.concat(prefix, middle, suffix))
            .otherwise(F.concat(prefix2, middle2, suffix2)))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: lines, form, lengths of prefix and middle, digests of output and restored text."""
    rows = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select(F.col("doc_id"), "n", "form", F.col("cut_a").alias("prefix_chars"),
                       (F.col("cut_b") - F.col("cut_a")).alias("middle_chars"), digest(F.col("output")).alias("output_sha256"),
                       digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
l AS (SELECT *, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS lines,
  ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
  ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
k AS (SELECT *, len(lines) AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS a,
  greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS b FROM l),
f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100
    THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(lines[1:a], '') AS p, array_to_string(lines[a + 1:b], '') AS m, array_to_string(lines[b + 1:], '') AS s FROM k)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CAST(CASE WHEN form <> 'plain' THEN length(p) END AS BIGINT) AS prefix_chars,
  CAST(CASE WHEN form <> 'plain' THEN length(m) END AS BIGINT) AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM f"""
