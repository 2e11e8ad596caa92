"""Test inputs of the engine's data model, as views over the driver's tables.

The same text runs in Spark and in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Entities with exact truth, from ``part``: legal-form variants, upper case, swapped words, street abbreviations, missing
#: and wrong postal codes, accents, deleted letters, landmarks, blank countries.
PART_ENTITIES = """
WITH p AS (SELECT CAST(p_partkey AS BIGINT) AS k, p_name, p_brand, p_type, CAST(p_size AS STRING) AS sz FROM {part}),
b AS (SELECT k,
  concat(p_name, ' ', lower(p_type), ' ', CAST(k % 97 AS STRING)) AS core,
  concat(split_part(p_name, ' ', 2), ' ', split_part(p_name, ' ', 1), ' ', lower(p_type), ' ', CAST(k % 97 AS STRING)) AS swapped,
  concat(sz, ' ', split_part(p_name, ' ', 1), ' ', lower(p_type)) AS street,
  CASE WHEN k % 3 = 1 THEN CAST(560000 + k % 700 AS STRING) ELSE CAST(10000 + k % 700 AS STRING) END AS postal,
  CASE WHEN k % 11 = 0 THEN '' WHEN k % 3 = 0 THEN 'US' WHEN k % 3 = 1 THEN 'India' ELSE 'France' END AS country
  FROM p)
SELECT 'S1' AS source, concat('S1-', CAST(k AS STRING)) AS entity_id,
  concat(core, CASE k % 4 WHEN 0 THEN ' Corporation' WHEN 1 THEN ' Private Limited' WHEN 2 THEN ' S.A.R.L.' ELSE ', LLC' END) AS business_name,
  concat(street, ' Street, ', postal) AS business_address, country FROM b
UNION ALL
SELECT 'S2', concat('S2-', CAST(k AS STRING)),
  concat(CASE WHEN k % 5 = 0 THEN swapped ELSE upper(core) END, CASE k % 4 WHEN 0 THEN ' Inc.' WHEN 1 THEN ' Pvt. Ltd.' WHEN 2 THEN ' Sarl' ELSE '' END),
  concat(street, ' St', CASE WHEN k % 7 = 0 THEN '' ELSE concat(' ', postal) END), country FROM b WHERE k % 3 <> 2
UNION ALL
SELECT 'S3', concat('S3-', CAST(k AS STRING)),
  concat(CASE WHEN k % 8 = 0 THEN replace(core, 'e', chr(233)) WHEN k % 8 = 4 THEN replace(core, 'l', '') ELSE core END, ' & Co'),
  concat('Near ', street, ' Rd., ', CASE WHEN k % 9 = 0 THEN '99999' ELSE postal END), country FROM b WHERE k % 2 = 0
"""

PART_TRUTH = """
SELECT concat('S1-', CAST(k AS STRING)) AS s1_id, concat('S2-', CAST(k AS STRING)) AS target_id FROM (SELECT p_partkey AS k FROM {part}) t WHERE k % 3 <> 2
UNION ALL
SELECT concat('S1-', CAST(k AS STRING)), concat('S3-', CAST(k AS STRING)) FROM (SELECT p_partkey AS k FROM {part}) t WHERE k % 2 = 0
"""

#: Noisy multilingual text with heavily repeated first lines, from ``documents``.
DOCUMENT_ENTITIES = """
SELECT concat('S', CAST(1 + doc_id % 3 AS STRING)) AS source,
  concat('S', CAST(1 + doc_id % 3 AS STRING), '-', CAST(doc_id AS STRING)) AS entity_id,
  split_part(text, chr(10), 1) AS business_name,
  split_part(text, chr(10), 2) AS business_address,
  lang AS country
FROM {documents}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    # dealt by its key: the small file is one split, but its texts are long to normalize
    n = 4 * spark.sparkContext.defaultParallelism
    entities = spark.sql(PART_ENTITIES, part=table(spark, sf_dir, "part").repartition(n, "p_partkey"))
    # no shuffle, but a bar: Spark would push what is made of the three branches into each and compile it three times
    return entities.coalesce(n)


def part_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PART_TRUTH, part=table(spark, sf_dir, "part"))


def document_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DOCUMENT_ENTITIES, documents=table(spark, sf_dir, "documents"))
