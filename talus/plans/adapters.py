"""Postings and companies made from the driver's tables, by one SQL text that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Role words by doc_id, skill phrases by two more remainders, invented values for the rest.
POSTINGS = """
SELECT doc_id AS ord,
  CASE doc_id % 8 WHEN 0 THEN 'Backend Engineer' WHEN 1 THEN 'Senior Backend Engineer' WHEN 2 THEN 'Data Analyst'
    WHEN 3 THEN 'Sales Manager' WHEN 4 THEN 'Junior Python Developer' WHEN 5 THEN 'Staff Engineer' WHEN 6 THEN 'SDE 1'
    ELSE 'Full Stack Developer' END AS title,
  CASE doc_id % 5 WHEN 0 THEN 'Acme Global' WHEN 1 THEN 'Initech Labs' WHEN 2 THEN 'Umbrella' WHEN 3 THEN 'Hooli Inc' ELSE 'Stark' END AS company,
  lang AS location, source AS site,
  CASE WHEN doc_id % 31 = 0 THEN '' ELSE '2024-01-' || lpad(cast(doc_id % 28 + 1 AS string), 2, '0') END AS date_posted,
  doc_id % 2 = 0 AS is_remote,
  CASE WHEN doc_id % 97 = 0 THEN '' ELSE 'https://jobs.example.org/' || md5(text) END AS job_url,
  'Skills: ' || CASE doc_id % 7 WHEN 0 THEN 'Python, Docker' WHEN 1 THEN 'Java and Spring' WHEN 2 THEN 'python, c++' WHEN 3 THEN 'Go; REST'
    WHEN 4 THEN 'Google restaurants' WHEN 5 THEN 'Python, Java, SQL.' ELSE 'SQL' END || '. ' ||
  CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN '3+ years.' WHEN 2 THEN '2-4 years.' WHEN 3 THEN '1 yr or 9 years.' WHEN 4 THEN '5 yrs. we mentor.' ELSE '25 years.' END
    || ' ' || text AS description,
  CASE doc_id % 4 WHEN 0 THEN '50000' WHEN 1 THEN '900000' WHEN 2 THEN '' ELSE '120000' END AS min_amount,
  CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '1500000' ELSE '95000' END AS max_amount,
  CASE doc_id % 5 WHEN 0 THEN 'monthly' WHEN 1 THEN 'hourly' ELSE 'yearly' END AS interval,
  CASE doc_id % 4 WHEN 0 THEN '201-500' WHEN 1 THEN '5,001-10,000' WHEN 2 THEN '10000+' ELSE '' END AS company_num_employees
FROM documents
"""

COMPANIES = """
SELECT s_suppkey AS ord,
  CASE s_suppkey % 9 WHEN 0 THEN 'Delta Corp' WHEN 1 THEN 'Nova Labs' WHEN 2 THEN 'Orbit Group' WHEN 3 THEN 'Tiny Services' WHEN 4 THEN 'Cowork Hub'
    WHEN 5 THEN 'Medical Point' WHEN 6 THEN 'Neural Forge' WHEN 7 THEN 'Plain Bakers' ELSE 'Northern Bank' END || ' ' || cast(s_suppkey % 40 AS string) AS company_name,
  CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'https://www.site' || cast(s_suppkey % 30 AS string) || '.org/' WHEN 2 THEN 'http://site' || cast(s_suppkey % 30 AS string) || '.org'
    ELSE 'https://firm' || cast(s_suppkey % 30 AS string) || '.io' END AS website,
  CASE s_suppkey % 3 WHEN 0 THEN 'Unknown' WHEN 1 THEN 'Software' ELSE '' END AS industry,
  '' AS description,
  CASE s_suppkey % 5 WHEN 0 THEN 'River Tower, 4' WHEN 1 THEN '' WHEN 2 THEN '2nd floor' ELSE 'Main street' END AS address,
  CASE s_suppkey % 7 WHEN 0 THEN 'Grand Plaza' ELSE '' END AS building_name,
  CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE 10.0 + (s_suppkey % 40) / 100.0 END AS latitude,
  CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE 20.0 + (s_suppkey % 40) / 100.0 END AS longitude,
  s_suppkey % 2 = 0 AS has_phone, CASE s_suppkey % 2 WHEN 0 THEN 'map' ELSE 'web' END AS src
FROM supplier
"""


def view(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    return spark.sql(sql.replace(f"FROM {name}", "FROM {t}"), t=spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, POSTINGS, "documents")


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, COMPANIES, "supplier")
