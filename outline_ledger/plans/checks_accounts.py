"""Checks of the account-code operators on codes derived from ``part``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import is_account_code, pad_account
from ..operators.accounts import flag_parents, suppression_set
from .catalog import query, sql_is_code
from .derived import register_views

# Code-like strings: 1-3 digit numbers, dotted codes with digits / letters,
# Cyrillic sub-accounts, trailing dots, 0/00/000, brand and type words.
CODES_SQL = """
SELECT p_partkey,
  CASE p_partkey % 10
    WHEN 0 THEN CAST(p_size AS STRING)
    WHEN 1 THEN CAST(p_size * 3 AS STRING)
    WHEN 2 THEN CAST(p_size AS STRING) || '.' || CAST(p_partkey % 100 AS STRING)
    WHEN 3 THEN CAST(p_size AS STRING) || '.' || substr(p_type, 1, 2)
    WHEN 4 THEN substr(p_type, 1, 2) || '.' || substr(p_brand, 1, 1)
    WHEN 5 THEN p_brand
    WHEN 6 THEN CAST(p_size % 10 AS STRING) || '.'
    WHEN 7 THEN CASE p_size % 4 WHEN 0 THEN '000' WHEN 1 THEN '00' WHEN 2 THEN '0' ELSE '0000' END
    WHEN 8 THEN CAST(p_size + 44 AS STRING) || CASE p_size % 3 WHEN 0 THEN '.Н' WHEN 1 THEN '.ФВ' ELSE '.ФВЖ' END
    ELSE CAST(p_size AS STRING) || '.' || CAST(p_partkey % 13 AS STRING) || '.' || substr(p_name, 1, 1)
  END AS code
FROM part
"""


@query("account_code_flag", f"""WITH c AS ({CODES_SQL})
SELECT p_partkey, code, {sql_is_code('code')} AS is_code FROM c""")
def account_code_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-40: account-code grammar as two regular expressions."""
    register_views(spark, sf_dir, ["part"])
    c = spark.sql(CODES_SQL)
    return c.select("p_partkey", "code", is_account_code("code").alias("is_code"))


@query("pad_account", f"""WITH c AS ({CODES_SQL})
SELECT p_partkey, code,
  CASE WHEN length(code) = 1 AND {sql_is_code('code')} THEN '0' || code ELSE code END AS padded,
  CASE WHEN length(code) = 1 THEN '0' || code ELSE code END AS padded_any
FROM c""")
def pad_account_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-41: zero-pad one-character codes (and any one-character value)."""
    register_views(spark, sf_dir, ["part"])
    c = spark.sql(CODES_SQL)
    return c.select("p_partkey", "code", pad_account("code").alias("padded"),
                    pad_account("code", require_code=False).alias("padded_any"))


# Contra accounts of an analysis register: (file, raw analytic cell, account).
PAIRS_SQL = """
SELECT 'analysis_' || p_type AS file_name, p_name AS raw_cell,
  CASE p_size % 6
    WHEN 0 THEN CAST(p_size + 44 AS STRING)
    WHEN 1 THEN CAST(p_size + 44 AS STRING) || '.' || lpad(CAST(p_partkey % 3 AS STRING), 2, '0')
    WHEN 2 THEN CASE WHEN p_partkey % 7 = 0 THEN '94.Н' ELSE '55.' || CAST(p_partkey % 4 AS STRING) END
    WHEN 3 THEN '0' || CAST(p_size % 10 AS STRING)
    WHEN 4 THEN CASE WHEN p_partkey % 5 = 0 THEN '57' ELSE '76.' || CAST(p_size + 5 AS STRING) END
    ELSE CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(p_partkey % 40 + 50 AS STRING) END
  END AS acct
FROM part
"""


@query("account_parents", f"""WITH p AS ({PAIRS_SQL}),
a AS (SELECT DISTINCT file_name, acct FROM p WHERE acct IS NOT NULL)
SELECT x.file_name, x.acct,
  EXISTS (SELECT 1 FROM a y WHERE y.file_name = x.file_name AND starts_with(y.acct, x.acct || '.')) AS is_parent
FROM a x""")
def account_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-42 / O-33: parent test by prefix explode + semi-join."""
    register_views(spark, sf_dir, ["part"])
    a = spark.sql(PAIRS_SQL).where(F.col("acct").isNotNull()).select("file_name", "acct").distinct()
    return flag_parents(a, ["file_name"], "acct").select("file_name", "acct", "is_parent")


@query("account_suppression", f"""WITH src AS ({PAIRS_SQL}),
pairs AS (SELECT DISTINCT file_name, raw_cell, acct FROM src WHERE acct IS NOT NULL),
cnt AS (SELECT file_name, acct, count(*) AS n FROM pairs GROUP BY file_name, acct),
d1 AS (
  SELECT file_name, acct FROM cnt WHERE n > 1
  UNION
  SELECT a.file_name, a.acct FROM cnt a
  WHERE EXISTS (SELECT 1 FROM cnt b WHERE b.file_name = a.file_name AND starts_with(b.acct, a.acct || '.'))
  UNION
  SELECT c.file_name, c.acct FROM cnt c
  WHERE contains(c.acct, '94') AND c.acct <> '94.Н'
    AND EXISTS (SELECT 1 FROM cnt x WHERE x.file_name = c.file_name AND x.acct = '94.Н')
  UNION
  SELECT file_name, acct FROM cnt
  WHERE (contains(acct, '55') AND acct <> '55') OR (contains(acct, '57') AND acct <> '57')),
d2 AS (SELECT * FROM d1 WHERE acct NOT IN ('55', '57'))
SELECT file_name, acct FROM d2
UNION
SELECT file_name, CAST(CAST(acct AS BIGINT) AS STRING) AS acct FROM d2 WHERE regexp_matches(acct, '^0[0-9]+$')""")
def account_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-43: set of accounts whose rows duplicate detail (incl. 94.Н, 55/57 rules)."""
    register_views(spark, sf_dir, ["part"])
    return suppression_set(spark.sql(PAIRS_SQL), ["file_name"], "raw_cell", "acct")
