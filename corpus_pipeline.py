"""The corpus pipeline: five stages over ``documents``, each an operator of ``actlens.llm``.

Each stage takes (spark, docs, sf_dir) and returns what it keeps of docs, in
the columns of documents; its output is written as Parquet and read again as
the docs of the next.  The last returns the sampled segmentations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from actlens.llm import decontaminate, language, lattice, near_dedup, substring_dedup
from actlens.llm.common import stored, table


def _language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(spark, docs)


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one_of_each(spark, docs)


def _substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.cut_repeats(spark, docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(spark, docs, table(spark, sf_dir, "benchmark"))


def _pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lattice.sampled_pieces(spark, docs)


STAGES = [
    ("language", _language),
    ("near_dedup", _near_dedup),
    ("substring_dedup", _substring_dedup),
    ("decontaminate", _decontaminate),
    ("pieces", _pieces),
]

#: SQL expresses neither the profiles' ranks, nor the hashed cuts, nor the sampling: tests/llm has brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
