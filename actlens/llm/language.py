"""Language identification by rank-order n-gram profiles.

A text's n-grams (one to three letters, lower case, words padded with a
boundary) are ranked by frequency.  ``learn`` counts the n-grams of every
labelled document, combines the counts per language in Spark and keeps the
``PROFILE`` most frequent of each language as its profile.  ``identify``
ranks a text's own most frequent n-grams and sums, for each language, how far
each is from its place in the profile (``PROFILE`` places if it isn't there);
the language with the smallest sum is the answer.

Defined results: a null text or one without a letter is ``und`` with score
0, and so is every text if nothing was learned; equal distances go to the
first language in string order, equally frequent n-grams are ranked by code
points.  The score is 1 less the distance as a share of the largest possible
one.  Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from actlens.llm.common import broadcast_rows, table

PROFILE = 400
#: More labels than there are languages in the world: beyond it, the labels can't be languages.
MAX_LANGUAGES = 10_000
UNDETERMINED = "und"

_MERGE_AT = 1 << 21
_BOUNDARY = np.uint64(1)
_SHIFT = np.uint64(21)


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes, ascending, and counts of the n-grams of a text.  A code is three fields of 21 bits:
    0 for an unused place, 1 for a word boundary, otherwise 2 more than the letter's code point."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    s = np.ones(len(points) + 2, np.uint64)
    s[1:-1][letter] = points[letter].astype(np.uint64) + np.uint64(2)
    inner = s != _BOUNDARY
    s = s[np.concatenate([[True], inner[1:] | inner[:-1]])]
    inner = s != _BOUNDARY
    two = (s[:-1] << _SHIFT) | s[1:]
    three = (two[:-1] << _SHIFT) | s[2:]
    codes = np.concatenate([s[inner], two, three[inner[1:-1]]])
    codes.sort()
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.diff(first, append=len(codes))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.concatenate([c for c, _ in parts])
    counts = np.concatenate([n for _, n in parts])
    order = np.argsort(codes)
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.add.reduceat(counts, first)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, list] = {}
    held: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            codes, counts = ngrams(text)
            if len(codes):
                totals.setdefault(lang, []).append((codes, counts))
                held[lang] = held.get(lang, 0) + len(codes)
                if held[lang] >= _MERGE_AT and len(totals[lang]) > 1:
                    totals[lang] = [_merged(totals[lang])]
                    held[lang] = 0
    for lang, parts in totals.items():
        codes, counts = _merged(parts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(counts)],
            names=["lang", "code", "n"])


def learn(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """Profiles (lang, code, place) from the rows of ``docs`` (lang, text) that have a lang."""
    counts = (
        docs.where(F.col("lang").isNotNull()).select(F.col("lang").cast("string"), F.col("text").cast("string"))
        .mapInArrow(_count, "lang string, code long, n long")
        .groupBy("lang", "code").agg(F.sum("n").alias("n")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    return counts.withColumn("place", place - 1).where(F.col("place") < size).select("lang", "code", "place")


def distances(text: str | None, languages: list[str], codes: np.ndarray, places: np.ndarray,
              size: int) -> tuple[np.ndarray, int] | None:
    """Out-of-place distance to each language and the largest possible one; None without letters.
    places: a row for each language, ``size`` where the profile lacks the code."""
    own, counts = ngrams(text)
    if not len(own) or not languages:
        return None
    ranked = own[np.argsort(-counts, kind="stable")[:size]]
    at = np.searchsorted(codes, ranked)
    at[at == len(codes)] = 0
    known = codes[at] == ranked
    apart = np.abs(places[:, at] - np.arange(len(ranked)))
    return np.where(known, np.where(places[:, at] == size, size, apart), size).sum(axis=1), size * len(ranked)


def identifier(profiles: DataFrame, size: int = PROFILE) -> Callable[[Column], Column]:
    """A column function: text -> struct(lang_pred, score).  The profiles, at most ``MAX_LANGUAGES`` of
    ``size`` rows each, go to every task."""
    rows = broadcast_rows(profiles.sparkSession, profiles, MAX_LANGUAGES * size, "language profiles")
    languages = sorted({r.lang for r in rows})
    codes = np.array(sorted({r.code for r in rows}), np.uint64)
    places = np.full((len(languages), len(codes)), size, np.int64)
    number = {x: k for k, x in enumerate(languages)}
    column = {int(c): k for k, c in enumerate(codes)}
    for r in rows:
        places[number[r.lang], column[r.code]] = r.place

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def identify(texts: pa.Array) -> pa.Array:
        names, scores = [], []
        for text in texts.to_pylist():
            found = distances(text, languages, codes, places, size)
            if found is None:
                names.append(UNDETERMINED)
                scores.append(0.0)
            else:
                best = int(found[0].argmin())
                names.append(languages[best])
                scores.append(1.0 - float(found[0][best]) / found[1])
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                          ["lang_pred", "score"])

    return identify


def held_out() -> Column:
    """The fold that nothing is learned from: crc32 of the doc_id as text, modulo 3, is 1 (null: the empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the labelled documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    identify = identifier(learn(docs.where(~held_out()).select("lang", "text")))
    found = docs.select("doc_id", held_out().alias("held_out"), identify(F.col("text").cast("string")).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


def keep_identified(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents whose language can be told: rejected are texts without a letter and texts that share
    no ranked n-gram with any profile (score 0).  Columns stay as they are."""
    identify = identifier(learn(docs.where(~held_out()).select("lang", "text")))
    return docs.where(identify(F.col("text").cast("string"))["score"] > 0)
