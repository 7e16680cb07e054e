"""Raw per-source items derived from ``documents`` (portable Spark/DuckDB SQL).

Stands in for landed feed / API payload fields: one raw item per document,
with URL shapes, content blocks, dates and titles that exercise every branch
of the per-source builders.  The document text is the item body.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from actlens.session import ensure_parallel, table

RAW_SQL = """
SELECT
  doc_id AS seq,
  CASE doc_id % 4 WHEN 0 THEN 'PARLIAMENT' WHEN 1 THEN 'LEGISLATION' WHEN 2 THEN 'GAZETTE' ELSE 'BEEHIVE' END AS source_system,
  CASE doc_id % 11
    WHEN 0 THEN 'Hon Chris Bishop announces housing boost'
    WHEN 1 THEN 'Rt Hon Christopher Luxon speech to business leaders'
    WHEN 2 THEN 'Taxation (Annual Rates) Bill 2024'
    WHEN 3 THEN 'Crimes Amendment Bill 133'
    WHEN 4 THEN 'Appointment of District Court Judge'
    WHEN 5 THEN 'Health NZ board appointments: Internal Affairs notice'
    WHEN 6 THEN 'Minister Willis on trade and finance'
    WHEN 7 THEN 'Conservation week in the regions'
    WHEN 8 THEN 'Short'
    WHEN 9 THEN 'Road safety Education Act 2020'
    ELSE 'Vice regal notice: Hon. Judith Collins Defence' END AS title,
  text AS body,
  CASE doc_id % 4
    WHEN 1 THEN CASE WHEN doc_id % 17 = 0 THEN concat('https://www.legislation.govt.nz/regulation/public/', CAST(doc_id AS STRING))
                ELSE concat('https://www.legislation.govt.nz/act/public/', CAST(2000 + doc_id % 26 AS STRING), '/',
                            lpad(CAST(doc_id % 300 AS STRING), 4, '0'),
                            CASE doc_id % 3 WHEN 0 THEN concat('/', CAST(doc_id % 250 AS STRING), '.0/contents.html')
                                            WHEN 1 THEN concat('/version/', CAST(doc_id % 9 AS STRING))
                                            ELSE '/latest/whole.html' END) END
    WHEN 2 THEN CASE doc_id % 3
                WHEN 0 THEN concat('https://gazette.govt.nz/notice/id/', CAST(2020 + doc_id % 6 AS STRING), '-',
                                   CASE doc_id % 7 WHEN 0 THEN 'vr' WHEN 1 THEN 'go' WHEN 2 THEN 'al' WHEN 3 THEN 'dl'
                                                   WHEN 4 THEN 'co' WHEN 5 THEN 'la' ELSE 'zz' END, CAST(doc_id * 37 AS STRING))
                WHEN 1 THEN concat('https://gazette.govt.nz/notice/', CAST(2020 + doc_id % 6 AS STRING), '-go', CAST(doc_id AS STRING))
                ELSE concat('https://gazette.govt.nz/browse/', lang) END
    WHEN 0 THEN CASE doc_id % 3
                WHEN 0 THEN concat('https://bills.parliament.nz/v/6/BILL', CAST(doc_id * 13 % 1000003 AS STRING), '?Tab=history')
                WHEN 1 THEN concat('https://bills.parliament.nz/bills/', source, '-', CAST(doc_id AS STRING), '/')
                ELSE '' END
    ELSE CASE doc_id % 5
         WHEN 0 THEN concat('https://www.beehive.govt.nz/release/', lang, '-', source, '-update-', CAST(doc_id * 7 AS STRING))
         WHEN 1 THEN concat('https://www.beehive.govt.nz/speech/', source, '_', CAST(doc_id AS STRING))
         WHEN 2 THEN concat('https://www.beehive.govt.nz/portfolio/social-development/', CAST(doc_id AS STRING))
         WHEN 3 THEN 'https://www.beehive.govt.nz/'
         ELSE concat('http://example.org/', source) END
  END AS url,
  CASE WHEN doc_id % 4 = 1 AND doc_id % 19 <> 0 THEN concat(
       'Information type: ', CASE WHEN doc_id % 23 = 0 THEN 'Bills' ELSE 'Acts' END, '<br />',
       CASE WHEN doc_id % 5 = 0 THEN '' ELSE concat('Year: ', CAST(1990 + doc_id % 35 AS STRING), '<br />') END,
       CASE WHEN doc_id % 7 = 0 THEN '' ELSE concat('No: ', lpad(CAST(doc_id % 120 AS STRING), 3, '0'), '<br />') END,
       'Version: ', CASE doc_id % 4 WHEN 1 THEN concat('as at ', CAST(1 + doc_id % 28 AS STRING), ' November 2025')
                                    ELSE 'as enacted' END, '<br />',
       'Current as at date: ', CAST(1 + doc_id % 28 AS STRING), '/', CAST(1 + doc_id % 12 AS STRING), '/2025<br />',
       'Status: In force<br />Legislation type: Public')
  END AS content,
  CASE doc_id % 4
    WHEN 1 THEN CASE doc_id % 3 WHEN 0 THEN concat('2025-', lpad(CAST(1 + doc_id % 12 AS STRING), 2, '0'), '-',
                                                lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0'), 'T18:40:28+13:00')
                                WHEN 1 THEN concat(CAST(1 + doc_id % 28 AS STRING), ' March 2025') ELSE 'unknown' END
    WHEN 3 THEN CASE doc_id % 3 WHEN 0 THEN concat('Mon, ', CAST(1 + doc_id % 28 AS STRING), ' Dec 2025 10:00:00 +1300')
                                WHEN 1 THEN concat('2025-', lpad(CAST(1 + doc_id % 12 AS STRING), 2, '0'), '-05')
                                ELSE concat('Tuesday, ', CAST(1 + doc_id % 28 AS STRING), ' June 2025') END
    WHEN 2 THEN CASE doc_id % 3 WHEN 0 THEN concat(CAST(1 + doc_id % 28 AS STRING), ' Jul 2025')
                                WHEN 1 THEN concat('2025-07-', lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0'), 'T09:00:00Z')
                                ELSE concat(CAST(1 + doc_id % 28 AS STRING), '/13/2025') END
    ELSE CASE doc_id % 3 WHEN 0 THEN concat(CAST(1 + doc_id % 28 AS STRING), '/', CAST(1 + doc_id % 12 AS STRING), '/2024')
                         WHEN 1 THEN NULL ELSE concat('March ', CAST(1 + doc_id % 28 AS STRING), ', 2024') END
  END AS published,
  CASE doc_id % 6 WHEN 0 THEN 'Ministry of Justice' WHEN 1 THEN 'Department of Internal Affairs' WHEN 2 THEN ''
       WHEN 3 THEN NULL WHEN 4 THEN 'Foreign Affairs and Trade' ELSE 'Office of the Clerk' END AS creator,
  CASE doc_id % 5 WHEN 0 THEN 'Health|Finance' WHEN 1 THEN 'treasury matters' WHEN 2 THEN ''
       WHEN 3 THEN 'Emergency Management' ELSE NULL END AS tags,
  CASE doc_id % 4 WHEN 0 THEN 'release' WHEN 1 THEN 'speeches' WHEN 2 THEN 'Feature' ELSE 'announcement' END AS feed_type,
  CASE WHEN doc_id % 4 = 0 THEN concat(CAST(100 + doc_id % 90 AS STRING), '-', CAST(1 + doc_id % 3 AS STRING)) END AS bill_number_raw,
  lang, source
FROM {documents}
"""


def raw_sql(documents: str = "documents") -> str:
    return RAW_SQL.replace("{documents}", documents)


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ensure_parallel(table(spark, sf_dir, "documents"))
    return spark.sql(RAW_SQL, documents=docs)
