"""Actions derived from the driver's ``documents`` table.

The driver tables hold no government actions, so a fixed, portable SQL text
turns every document into one action record (ids with three versions per
base id, mixed date formats, repeated URLs and title+date pairs, per-source
metadata).  The same text is used by Spark and by the DuckDB oracles; only
the table reference differs.  The whole document text is the summary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actlens.session import ensure_parallel, table

# Portable SQL (Spark and DuckDB).  ``{documents}`` is the input table.
ADAPTER_SQL = """
SELECT
  doc_id AS seq,
  concat(CASE doc_id % 4 WHEN 0 THEN 'parl' WHEN 1 THEN 'leg' WHEN 2 THEN 'gaz' ELSE 'bee' END,
         '-2024-', lpad(CAST(CAST(floor(doc_id / 12) AS BIGINT) * 4 + doc_id % 4 AS STRING), 6, '0'),
         '-v', CAST(1 + CAST(floor(doc_id / 4) AS BIGINT) % 3 AS STRING)) AS id,
  CASE doc_id % 4 WHEN 0 THEN 'PARLIAMENT' WHEN 1 THEN 'LEGISLATION' WHEN 2 THEN 'GAZETTE' ELSE 'BEEHIVE' END AS source_system,
  CASE doc_id % 13
    WHEN 0 THEN 'Housing Development Bill' WHEN 1 THEN 'Taxation Annual Rates Act'
    WHEN 2 THEN 'Appointment of District Court Judge' WHEN 3 THEN 'Health NZ board update'
    WHEN 4 THEN 'Treaty Principles Bill' WHEN 5 THEN 'Land Transport Rule'
    WHEN 6 THEN 'Statutes Amendment' WHEN 7 THEN 'Gang Legislation Update'
    WHEN 8 THEN 'Rural business growth' WHEN 9 THEN 'Infrastructure for housing'
    WHEN 10 THEN 'Maori land claim' WHEN 11 THEN 'Syntax of notices' ELSE 'General notice' END AS title,
  CASE doc_id % 6
    WHEN 0 THEN concat('2024-', lpad(CAST(1 + doc_id % 12 AS STRING), 2, '0'), '-', lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0'))
    WHEN 1 THEN concat(CAST(1 + doc_id % 28 AS STRING), '/', CAST(1 + doc_id % 12 AS STRING), '/2024')
    WHEN 2 THEN concat(CAST(1 + doc_id % 28 AS STRING), ' December 2024')
    WHEN 3 THEN concat('June ', CAST(1 + doc_id % 28 AS STRING), ', 2024')
    WHEN 4 THEN concat(CAST(1 + doc_id % 28 AS STRING), '-', CAST(1 + doc_id % 12 AS STRING), '-2024')
    ELSE 'soon' END AS date,
  CASE WHEN doc_id % 10 < 4
    THEN concat('https://www.example.com/item/', CAST(CAST(floor(doc_id / 2) AS BIGINT) AS STRING))
    ELSE concat('https://', source, '.example.com/', lang, '/', CAST(doc_id AS STRING)) END AS url,
  CASE WHEN doc_id % 5 = 0 THEN 'Finance' WHEN doc_id % 5 = 1 THEN 'Health' ELSE NULL END AS portfolio,
  text AS summary,
  lang,
  CASE WHEN doc_id % 7 = 6 THEN NULL
       WHEN doc_id % 5 = 3 THEN concat('v', CAST(1 + CAST(floor(doc_id / 4) AS BIGINT) % 3 AS STRING))
       ELSE CAST(1 + CAST(floor(doc_id / 4) AS BIGINT) % 3 AS STRING) END AS version,
  CASE WHEN doc_id % 9 = 0 THEN '' ELSE NULL END AS base_id,
  CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'Hon Chris Bishop'
       ELSE CASE doc_id % 4 WHEN 0 THEN 'Parliament' WHEN 1 THEN 'Parliament' ELSE 'Government' END END AS primary_entity,
  CASE WHEN doc_id % 4 = 0
       THEN concat(CAST(100 + CAST(floor(doc_id / 12) AS BIGINT) % 50 AS STRING), '-', CAST(1 + CAST(floor(doc_id / 4) AS BIGINT) % 3 AS STRING))
       END AS bill_number,
  CASE WHEN doc_id % 4 = 0 THEN 54 END AS parliament_number,
  CASE WHEN doc_id % 4 = 1 THEN concat('2024 No ', CAST(CAST(floor(doc_id / 12) AS BIGINT) AS STRING)) END AS act_number,
  CASE WHEN doc_id % 4 = 1
       THEN concat('2024-', lpad(CAST(1 + doc_id % 12 AS STRING), 2, '0'), '-', lpad(CAST(1 + doc_id % 27 AS STRING), 2, '0'))
       END AS commencement_date,
  CASE WHEN doc_id % 4 = 2
       THEN concat('2024-', CASE CAST(floor(doc_id / 4) AS BIGINT) % 6 WHEN 0 THEN 'vr' WHEN 1 THEN 'go' WHEN 2 THEN 'al'
                                   WHEN 3 THEN 'dl' WHEN 4 THEN 'co' ELSE 'la' END, CAST(doc_id AS STRING))
       END AS notice_number,
  CASE WHEN doc_id % 4 = 2
       THEN CASE CAST(floor(doc_id / 4) AS BIGINT) % 6 WHEN 0 THEN 'Vice Regal' WHEN 1 THEN 'General' WHEN 2 THEN 'Advertising'
                 WHEN 3 THEN 'Deaths and Legacies' WHEN 4 THEN 'Corporate' ELSE 'Land' END
       END AS notice_type,
  CASE WHEN doc_id % 4 = 3
       THEN CASE doc_id % 3 WHEN 0 THEN 'Press Release' WHEN 1 THEN 'Speech' ELSE 'Feature Article' END
       END AS document_type,
  CASE WHEN doc_id % 4 = 0 THEN 'Introduction' END AS stage1,
  CASE WHEN doc_id % 4 = 0
       THEN concat('2024-', lpad(CAST(1 + doc_id % 12 AS STRING), 2, '0'), '-', lpad(CAST(1 + doc_id % 20 AS STRING), 2, '0'))
       END AS stage1_date,
  CASE WHEN doc_id % 8 = 0 THEN 'First Reading' WHEN doc_id % 8 = 4 THEN 'Select Committee' END AS stage2,
  CASE WHEN doc_id % 4 = 0
       THEN concat('2024-', lpad(CAST(1 + doc_id % 12 AS STRING), 2, '0'), '-', lpad(CAST(21 + doc_id % 7 AS STRING), 2, '0'))
       END AS stage2_date,
  CASE doc_id % 5 WHEN 0 THEN 'Housing|InvalidLabel|Housing' WHEN 1 THEN 'Health' WHEN 2 THEN ''
       WHEN 3 THEN 'Tax|Economy' ELSE NULL END AS labels_in
FROM {documents}
"""

METADATA_FIELDS = [
    "bill_number", "parliament_number", "stage_history", "act_number", "commencement_date",
    "notice_number", "notice_type", "document_type", "portfolio", "version",
]


def adapter_sql(documents: str = "documents") -> str:
    return ADAPTER_SQL.replace("{documents}", documents)


def flat_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat adapter rows (same columns as the oracle CTE)."""
    docs = ensure_parallel(table(spark, sf_dir, "documents"))
    return spark.sql(ADAPTER_SQL, documents=docs)


def nest(flat: DataFrame) -> DataFrame:
    """Flat adapter rows -> action records with nested metadata.

    ``metadata.version`` carries the version string; the top-level
    ``version`` keeps it too, as in the reference record.
    """
    stage = lambda n: F.when(
        F.col(f"stage{n}").isNotNull(),
        F.struct(F.col(f"stage{n}").alias("stage"), F.col(f"stage{n}_date").alias("date")),
    )
    history = F.when(
        F.col("source_system") == "PARLIAMENT",
        F.filter(F.array(stage(1), stage(2)), lambda s: s.isNotNull()),
    )
    labels = F.when(
        F.col("labels_in").isNotNull(),
        F.filter(F.split(F.col("labels_in"), r"\|"), lambda s: s != ""),
    ).otherwise(F.array().cast("array<string>"))
    metadata = F.struct(
        F.col("bill_number"),
        F.col("parliament_number").cast("int").alias("parliament_number"),
        history.alias("stage_history"),
        F.col("act_number"),
        F.col("commencement_date"),
        F.col("notice_number"),
        F.col("notice_type"),
        F.col("document_type"),
        F.col("portfolio"),
        F.col("version"),
    )
    return flat.select(
        "seq", "id", "title", "date", "source_system", "url", "primary_entity", "summary",
        labels.alias("labels"), metadata.alias("metadata"), "version", "base_id", "lang",
    )


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested action records built from ``documents``."""
    return nest(flat_actions(spark, sf_dir))
