"""Checks of the second-dialect journals (P-2, P-4) on `orders` and of the general trial
balances (P-11, P-12) on `customer`, from raw cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import (BALANCE_CLOSE_TITLE, BALANCE_OPEN_TITLE, BALANCE_TURN_TITLE_NONUPP, BALANCE_TURN_TITLE_UPP,
                         CUR_INDICATOR, JOURNAL_FILE_COL, MEASURES, OUTLINE_FILE_COL, QTY_INDICATOR)
from ..operators.ordered import RowOrder, ordinal
from ..operators.stage import stage
from .catalog import query
from .derived import register_views
from .journals import account_card_by_period, posting_report_by_period
from .registers import general_balance

# A file for each priority, in order of the orders; each order is a dated row, its quantity row and, in two of the
# files, its currency row.  Files "5-.." lack some quantity rows, so nothing is attached there by ordinal.
PERIOD_SQL = """
SELECT 'period_' || o_orderpriority AS file_name, o_orderkey AS k1, o_orderpriority AS pr,
  lpad(CAST(day(o_orderdate) AS STRING), 2, '0') || '.' || lpad(CAST(month(o_orderdate) AS STRING), 2, '0') || '.'
    || CAST(year(o_orderdate) AS STRING) AS day,
  CAST(o_orderdate AS DATE) AS o_date,
  CAST(o_custkey AS STRING) AS cust, CAST(o_custkey % 97 AS STRING) || '.25' AS q1, CAST(o_custkey % 89 AS STRING) || '.5' AS q2,
  CASE WHEN o_orderkey % 3 = 0 THEN 'USD' ELSE 'EUR' END AS cur,
  substr(o_orderpriority, 1, 1) <> '5' OR o_orderkey % 7 > 0 AS has_qty, substr(o_orderpriority, 1, 1) IN ('2', '3') AS has_cur
FROM orders"""
PERIOD_HEADER = ["Период", "Документ", "Аналитика Дт", "Аналитика Кт", "Показатель", "Дебет", None, None, "Кредит", None, None,
                 "Текущее сальдо"]
PERIOD_ORDER = RowOrder(order_cols=("k1", "k2"), block_cols=("b1",))
AFTER_ALL = 1 << 60


def _cells(*exprs: str):
    return F.array(*[F.expr(e).cast("string") for e in exprs])


def raw_period_journal(spark: SparkSession, sf_dir: str, card: bool) -> DataFrame:
    """raw_rows: the header, for cards the opening rows, the journal, the closing rows."""
    register_views(spark, sf_dir, ["orders"])
    base = spark.sql(PERIOD_SQL)
    # cards of the files "4-.." hold their quantities in the second cell
    first = "CASE WHEN substr(pr, 1, 1) = '4' THEN '0' ELSE q1 END" if card else "q1"
    money = _cells("day", "concat('Акт ', k1, '\\nот ', day)", "concat('Клиент ', cust)", "NULL", "'БУ'", "'62'", "q2", "NULL",
                   "'90.01'", "q1", "NULL", "'Д'")

    def special(mark, *c):
        return _cells("NULL", "NULL", "NULL", "NULL", f"'{mark}'", "NULL", c[0], c[1], "NULL", c[2], c[3], "NULL")

    parts = [base.select("file_name", "k1", F.lit(0).alias("k2"), money.alias("cells")),
             base.where("has_qty").select("file_name", "k1", F.lit(1), special(QTY_INDICATOR, first, "q2", first, "q1")),
             base.where("has_cur").select("file_name", "k1", F.lit(2), special(CUR_INDICATOR, "cur", "q2", "NULL", "q1"))]
    files = base.select("file_name").distinct()
    edge = special(QTY_INDICATOR, "'9'", "'9'", "'9'", "'9'"), special(CUR_INDICATOR, "'X'", "'9'", "'X'", "'9'")
    for k1 in [-1, AFTER_ALL] if card else [AFTER_ALL]:
        parts += [files.select("file_name", F.lit(k1), F.lit(1 + i), c) for i, c in enumerate(edge)]
    parts.append(files.select("file_name", F.lit(-2), F.lit(0), F.array(*[F.lit(h).cast("string") for h in PERIOD_HEADER])))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    rows = ordinal(rows.withColumn("b1", F.floor(F.col("k1") / 65536)), "row_no", PERIOD_ORDER)
    return stage(rows.select("file_name", "row_no", F.lit(0).alias("level"), F.lit(False).alias("italic"), "cells"), "period-raw")


def _period_sql(card: bool) -> str:
    dt = "CASE WHEN substr(pr, 1, 1) = '4' THEN q2 ELSE q1 END" if card else "q1"
    number = "CAST({} AS DECIMAL(18,4))"
    return f"""WITH base AS ({PERIOD_SQL}),
whole AS (SELECT file_name, bool_and(has_qty) AS q_ok, bool_and(has_cur) AS c_ok FROM base GROUP BY file_name)
SELECT file_name AS "{JOURNAL_FILE_COL}", CAST(o_date AS TIMESTAMP) AS "Период", 'Акт ' || k1 || '|от ' || day AS "Документ",
  'Клиент ' || cust AS "Аналитика Дт", '62' AS "Дебет", '90.01' AS "Кредит", 'Д' AS "Текущее сальдо",
  q2 AS "Дебет_значение", q1 AS "Кредит_значение",
  CASE WHEN q_ok THEN {number.format(dt)} END AS "Дебет_количество", CASE WHEN q_ok THEN {number.format("q1")} END AS "Кредит_количество",
  CASE WHEN c_ok THEN cur END AS "Дебет_валюта", CASE WHEN c_ok THEN {number.format("q2")} END AS "Дебет_валютное_количество",
  CASE WHEN c_ok THEN {number.format("q1")} END AS "Кредит_валютное_количество"
FROM base JOIN whole USING (file_name)"""


def _period_result(flat: DataFrame) -> DataFrame:
    return flat.select(JOURNAL_FILE_COL, "Период", *[F.array_join(c, "|").alias(c) for c in ("Документ", "Аналитика Дт")],
                       "Дебет", "Кредит", "Текущее сальдо", "Дебет_значение", "Кредит_значение", "Дебет_количество",
                       "Кредит_количество", "Дебет_валюта", "Дебет_валютное_количество", "Кредит_валютное_количество")


@query("posting_report_period", _period_sql(card=False))
def posting_report_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-2 from raw cells: dated rows with quantities and currencies by ordinal (O-28), none where the counts differ."""
    return _period_result(posting_report_by_period(raw_period_journal(spark, sf_dir, card=False))[0])


@query("account_card_period", _period_sql(card=True))
def account_card_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-4 from raw cells: also without the opening rows, quantities from the second cell where the first sums to 0 (O-39)."""
    return _period_result(account_card_by_period(raw_period_journal(spark, sf_dir, card=True))[0])


# A file for each nation; every third opening credit is blank, every fifth account has no name, nation 7 has no header.
BALANCE_SQL = """
SELECT 'general_' || CAST(c_nationkey AS STRING) AS file_name, c_custkey AS k1, c_nationkey AS nation,
  CAST(c_custkey % 90 + 1 AS STRING) AS acct, CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE c_name END AS name,
  CAST(c_custkey % 1000 AS STRING) || '.75' AS v0, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE CAST(c_custkey AS STRING) END AS v1,
  CAST(c_custkey % 77 AS STRING) AS v2, '' AS v3, 'нет' AS v4, '-' || CAST(c_custkey % 10 AS STRING) || '.5' AS v5
FROM customer"""
BALANCE_ORDER = RowOrder(order_cols=("k1",), block_rows=65536)
_BALANCE_FORMS = {
    # titles, row below them, cells of a data row
    "upp": (["Счет", None, "Наим.", BALANCE_OPEN_TITLE, None, None, BALANCE_TURN_TITLE_UPP, None, BALANCE_CLOSE_TITLE, None],
            [None, None, "Наименование", "Дебет", "Кредит", None, "Дебет", "Кредит", "Дебет", "Кредит"],
            ["acct", "NULL", "name", "v0", "v1", "'777'", "v2", "v3", "v4", "v5"]),
    "nonupp": (["Счет", "Наименование счета", BALANCE_OPEN_TITLE, None, BALANCE_TURN_TITLE_NONUPP, None, BALANCE_CLOSE_TITLE, None],
               [None, None, "Дебет", "Кредит", "Дебет", "Кредит", "Дебет", "Кредит"],
               ["acct", "name", "v0", "v1", "v2", "v3", "v4", "v5"]),
}


def raw_general_balance(spark: SparkSession, sf_dir: str, dialect: str) -> DataFrame:
    register_views(spark, sf_dir, ["customer"])
    titles, below, cells = _BALANCE_FORMS[dialect]
    base = spark.sql(BALANCE_SQL)
    data = ordinal(base.select("file_name", "k1", _cells(*cells).alias("cells")), "row_no", BALANCE_ORDER)
    files = base.select("file_name", "nation").distinct()
    rows = data.select("file_name", (F.col("row_no") + 3).alias("row_no"), "cells")
    for n, row in ((1, ["Ведомость"]), (2, titles), (3, below)):
        rows = rows.union(files.where("nation <> 7" if n == 2 else "true").select(
            "file_name", F.lit(n), F.array(*[F.lit(c).cast("string") for c in row])))
    rows = rows.select("file_name", "row_no", F.lit(0).alias("level"), F.lit(False).alias("italic"), "cells")
    return stage(rows, "general-raw")


def _balance_sql() -> str:
    cols = ", ".join(f"TRY_CAST(nullif(v{i}, '') AS DECIMAL(18,2)) AS \"{m}\"" for i, m in enumerate(MEASURES))
    return f"""WITH base AS ({BALANCE_SQL}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY k1) + 3 AS row_no FROM base)
SELECT file_name AS "{OUTLINE_FILE_COL}", row_no, CASE WHEN length(acct) = 1 THEN '0' || acct ELSE acct END AS "Счет",
  trim(name) AS "Наименование", {cols}
FROM numbered WHERE trim(name) <> '' AND nation <> 7"""


@query("general_balance_upp", _balance_sql())
def general_balance_upp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-11 from raw cells: a two-row header, padded accounts, named rows only (O-6, O-24)."""
    return general_balance(raw_general_balance(spark, sf_dir, "upp"))[0]


@query("general_balance_nonupp", _balance_sql())
def general_balance_nonupp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-12 from raw cells: the second dialect's titles."""
    return general_balance(raw_general_balance(spark, sf_dir, "nonupp"), dialect="nonupp")[0]


@query("general_balance_quarantine", f"""
SELECT DISTINCT file_name, 'header row not found' AS reason FROM ({BALANCE_SQL}) WHERE nation = 7""")
def general_balance_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S-9: the files that the general balance rejects."""
    return general_balance(raw_general_balance(spark, sf_dir, "upp"))[1]
