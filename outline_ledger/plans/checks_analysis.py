"""Checks of the account-analysis operators: contra-account fill, control
totals by account, reconciliation, relation-kind fill; plus register
classification and the batch union."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import REGISTER_RULES
from ..functions.scalars import is_account_code, pad_account
from ..operators.accounts import control_94, parent_accounts, remove_accounts
from ..operators.headers import classify_files, order_columns, union_registers
from ..operators.ordered import RowOrder, ffill
from ..operators.reconcile import account_check, account_totals
from ..operators.stage import stage
from .catalog import query, sql_is_code, sql_list, sql_str
from .derived import register_views

# Analysis register: each order is a heading row whose contra cell is an
# account code (or a service word), each lineitem a detail row under it.
ANALYSIS_SQL = """
SELECT 'analysis_' || CAST(o_orderkey % 4 AS STRING) AS file_name, o_orderkey AS ok, CAST(0 AS INT) AS kind,
  CAST(0 AS INT) AS ln, CAST(0 AS BIGINT) AS pk, CAST(0 AS BIGINT) AS sk, CAST(0 AS DECIMAL(18,2)) AS px,
  CASE o_custkey % 12
    WHEN 0 THEN '7' WHEN 1 THEN '60' WHEN 2 THEN '60.01' WHEN 3 THEN '60.02' WHEN 4 THEN '000'
    WHEN 5 THEN '94' WHEN 6 THEN '94.Н' WHEN 7 THEN '94.01' WHEN 8 THEN '55.1' WHEN 9 THEN 'Кол-во:'
    WHEN 10 THEN '12.5' ELSE '0' END AS cell,
  CAST(o_totalprice AS DECIMAL(18,2)) AS credit_amt,
  CAST(o_custkey AS DECIMAL(18,2)) AS debit_amt
FROM orders
UNION ALL
SELECT 'analysis_' || CAST(l_orderkey % 4 AS STRING), l_orderkey, CAST(1 AS INT), l_linenumber, l_partkey,
  l_suppkey, CAST(l_extendedprice AS DECIMAL(18,2)),
  'Поставщик ' || CAST(l_suppkey AS STRING),
  CAST(l_extendedprice AS DECIMAL(18,2)),
  CAST(l_quantity AS DECIMAL(18,2))
FROM lineitem
"""
A_ORDER = RowOrder(file_col="file_name", order_cols=("ok", "kind", "ln", "pk", "sk", "px"), block_rows=4096)
A_KEYS = ["file_name", "ok", "kind", "ln", "pk", "sk", "px"]
W_A = "PARTITION BY file_name ORDER BY ok, kind, ln, pk, sk, px"


def _analysis(spark, sf_dir):
    register_views(spark, sf_dir, ["orders", "lineitem"])
    return spark.sql(ANALYSIS_SQL)


def _contra_filled(spark, sf_dir):
    d = _analysis(spark, sf_dir)
    return ffill(d, {"contra": F.when(is_account_code("cell"), pad_account("cell"))}, A_ORDER)


SQL_CONTRA = f"""WITH a AS ({ANALYSIS_SQL})
SELECT {', '.join(A_KEYS)}, cell,
  last_value(CASE WHEN {sql_is_code('cell')} THEN
      CASE WHEN length(cell) = 1 THEN '0' || cell ELSE cell END END IGNORE NULLS)
    OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS contra
FROM a WINDOW w AS ({W_A})"""


@query("contra_ffill", SQL_CONTRA)
def contra_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-48 (+O-40/O-41): only account-code cells carry forward, zero-padded."""
    return _contra_filled(spark, sf_dir).select(*A_KEYS, "cell", "contra")


def control_by_account(a: DataFrame) -> DataFrame:
    """O-67: control totals by contra account before processing: code cells
    (and '0') only, zfill(2), O-44, O-34, minus parents / 55-57 (O-43 check
    variant: after grouping every account occurs once)."""
    valid = is_account_code("cell") | (F.col("cell") == "0")
    d = a.where(valid).withColumn("acct", F.when(F.length("cell") < 2, F.lpad("cell", 2, "0"))
                                  .otherwise(F.col("cell")))
    d = control_94(d, "acct", ["file_name"], dialect="upp")
    tot = account_totals(d, ["file_name", "acct"], ["credit_amt", "debit_amt"], "")
    par = parent_accounts(tot, ["file_name"], "acct")
    sub = tot.where((F.col("acct").contains("55") & (F.col("acct") != "55")) |
                    (F.col("acct").contains("57") & (F.col("acct") != "57"))).select("file_name", "acct")
    dele = par.unionByName(sub).distinct().where(~F.col("acct").isin("55", "57"))
    return remove_accounts(tot, dele, ["file_name"], "acct")


SQL_CONTROL = f"""WITH a AS ({ANALYSIS_SQL}),
v AS (SELECT file_name, CASE WHEN length(cell) < 2 THEN lpad(cell, 2, '0') ELSE cell END AS acct,
             credit_amt, debit_amt
      FROM a WHERE {sql_is_code('cell')} OR cell = '0'),
h AS (SELECT DISTINCT file_name FROM v WHERE acct = '94.Н'),
f AS (SELECT * FROM v WHERE NOT (file_name IN (SELECT file_name FROM h) AND acct <> '94.Н'
                                 AND (acct = '94' OR regexp_matches(acct, '^94\\..{{2}}$')))),
t AS (SELECT file_name, acct,
        CAST(coalesce(sum(coalesce(credit_amt, 0)), 0) AS DECIMAL(38,2)) AS credit_amt,
        CAST(coalesce(sum(coalesce(debit_amt, 0)), 0) AS DECIMAL(38,2)) AS debit_amt
      FROM f GROUP BY file_name, acct),
d AS (SELECT file_name, acct FROM t x
      WHERE (EXISTS (SELECT 1 FROM t y WHERE y.file_name = x.file_name AND starts_with(y.acct, x.acct || '.'))
             OR (contains(acct, '55') AND acct <> '55') OR (contains(acct, '57') AND acct <> '57'))
        AND acct NOT IN ('55', '57'))
SELECT * FROM t WHERE (file_name, acct) NOT IN (SELECT (file_name, acct) FROM d)"""


@query("contra_totals", SQL_CONTROL)
def contra_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-67 (+O-34, O-44, O-43): control totals by contra account."""
    return control_by_account(_analysis(spark, sf_dir)).select("file_name", "acct", "credit_amt", "debit_amt")


@query("reconcile_accounts", f"""WITH c AS ({SQL_CONTROL}),
r AS (SELECT file_name, contra AS acct,
        CAST(coalesce(sum(coalesce(credit_amt, 0)), 0) AS DECIMAL(38,2)) AS credit_amt,
        CAST(coalesce(sum(coalesce(debit_amt, 0)), 0) AS DECIMAL(38,2)) AS debit_amt
      FROM ({SQL_CONTRA.replace('SELECT ' + ', '.join(A_KEYS) + ', cell,', 'SELECT ' + ', '.join(A_KEYS) + ', cell, credit_amt, debit_amt,')})
      WHERE kind = 1 AND contra IS NOT NULL GROUP BY file_name, contra)
SELECT coalesce(c.file_name, r.file_name) AS file_name, coalesce(c.acct, r.acct) AS acct,
  CAST(coalesce(c.credit_amt, 0) AS DECIMAL(38,2)) AS credit_amt_base,
  CAST(coalesce(r.credit_amt, 0) AS DECIMAL(38,2)) AS credit_amt_current,
  CAST(round_even(coalesce(c.credit_amt, 0) - coalesce(r.credit_amt, 0), 0) AS DECIMAL(18,0)) AS "Разница_С_кред",
  CAST(coalesce(c.debit_amt, 0) AS DECIMAL(38,2)) AS debit_amt_base,
  CAST(coalesce(r.debit_amt, 0) AS DECIMAL(38,2)) AS debit_amt_current,
  CAST(round_even(coalesce(c.debit_amt, 0) - coalesce(r.debit_amt, 0), 0) AS DECIMAL(18,0)) AS "Разница_В_дебет"
FROM c FULL OUTER JOIN r ON c.file_name = r.file_name AND c.acct = r.acct""")
def reconcile_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-30 + O-70: control totals vs detail totals per contra account,
    full outer join, difference rounded half-to-even."""
    filled = stage(_contra_filled(spark, sf_dir), "contra")
    before = control_by_account(filled).withColumnsRenamed(
        {"credit_amt": "credit_amt_base", "debit_amt": "debit_amt_base"})
    after = account_totals(filled.where(F.col("kind") == 1).withColumnRenamed("contra", "acct"),
                           ["file_name", "acct"], ["credit_amt", "debit_amt"], "_current")
    return account_check(before, after, ["file_name", "acct"], ["credit_amt", "debit_amt"],
                         {"credit_amt": "Разница_С_кред", "debit_amt": "Разница_В_дебет"})


RELATION_SQL = """SELECT 'analysis_' || CAST(c_nationkey % 5 AS STRING) AS file_name, c_custkey,
  CAST(60 + c_nationkey % 10 AS STRING) AS acct,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS relation
FROM customer"""


@query("relation_fill", f"""WITH r AS ({RELATION_SQL}),
m AS (SELECT file_name, acct, min(relation) AS rel FROM r WHERE relation IS NOT NULL GROUP BY 1, 2)
SELECT r.file_name, r.c_custkey, r.acct, coalesce(r.relation, m.rel) AS relation
FROM r LEFT JOIN m ON r.file_name = m.file_name AND r.acct = m.acct""")
def relation_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-29: missing relation kind filled from the (account -> kind) map by key
    (the source aligns by row label after a renumbering merge; fixed here)."""
    register_views(spark, sf_dir, ["customer"])
    r = spark.sql(RELATION_SQL)
    m = r.where(F.col("relation").isNotNull()).groupBy("file_name", "acct").agg(F.min("relation").alias("__rel"))
    return r.join(m, on=["file_name", "acct"], how="left") \
        .select("file_name", "c_custkey", "acct", F.coalesce("relation", "__rel").alias("relation"))


# Raw header probe: per nation a file of the requested kind; its title rows,
# a header row (one of the rule sets, or an unknown one) and customer rows.
KINDS = ["card", "posting", "analisys", "turnover", "accountosv", "generalosv"]


def _raw_sql() -> str:
    headers = []
    for i, (kind, dialect, pattern) in enumerate(REGISTER_RULES):
        headers.append(f"WHEN {i} THEN {sql_str('|'.join(p.upper() if j % 2 else p.title() for j, p in enumerate(pattern)) + '|Прочее')}")
    return f"""SELECT 'file_' || CAST(c_nationkey AS STRING) AS file_name,
  CASE c_nationkey % 6 {' '.join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS))} END AS kind,
  CAST(c_custkey AS BIGINT) + 3 AS row_no,
  c_name || '|' || CAST(c_custkey AS STRING) || '|' || c_mktsegment AS line
FROM customer
UNION ALL
SELECT 'file_' || CAST(n_nationkey AS STRING),
  CASE n_nationkey % 6 {' '.join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS))} END,
  CAST(2 AS BIGINT),
  CASE (n_nationkey * 7) % 13 {' '.join(headers)} ELSE 'Счет|Неизвестно' END
FROM nation
UNION ALL
SELECT 'file_' || CAST(n_nationkey AS STRING),
  CASE n_nationkey % 6 {' '.join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS))} END,
  CAST(1 AS BIGINT), 'Отчет|' || n_name
FROM nation"""


def _rules_values() -> str:
    rows = []
    for i, (kind, dialect, pattern) in enumerate(REGISTER_RULES):
        rows.append(f"({sql_str(kind)}, {sql_str(dialect)}, {i}, [{sql_list(pattern)}])")
    return "VALUES " + ", ".join(rows)


@query("classify_registers", f"""WITH raw AS ({_raw_sql()}),
cells AS (SELECT file_name, kind, row_no,
            list_transform(string_split(line, '|'), lambda c: coalesce(lower(trim(c)), '')) AS cells
          FROM raw WHERE row_no <= 20),
rules(kind, dialect, priority, pattern) AS ({_rules_values()}),
hits AS (SELECT c.file_name, r.dialect, r.priority FROM cells c JOIN rules r ON c.kind = r.kind
         WHERE list_has_all(c.cells, r.pattern)),
files AS (SELECT DISTINCT file_name, kind FROM raw)
SELECT f.file_name, f.kind, arg_min(h.dialect, h.priority) AS dialect
FROM files f LEFT JOIN hits h ON f.file_name = h.file_name
GROUP BY f.file_name, f.kind""")
def classify_registers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-1: dialect of each file from its first 20 rows (first rule whose
    keyword set is contained in one row wins; none -> null = reject)."""
    register_views(spark, sf_dir, ["customer", "nation"])
    raw = spark.sql(_raw_sql()).withColumn("cells", F.split("line", r"\|")).drop("line")
    return classify_files(raw, file_col="file_name", kind_col="kind")


UNION_A = """SELECT 'gen_' || CAST(s_nationkey % 3 AS STRING) AS file_name, CAST(s_suppkey AS STRING) AS acct,
  CAST(s_acctbal AS DECIMAL(18,2)) AS debit_turn FROM supplier"""
UNION_B = """SELECT 'osv_' || CAST(c_nationkey % 3 AS STRING) AS file_name, CAST(c_custkey AS STRING) AS acct,
  c_mktsegment AS analytic, CAST(c_acctbal AS DECIMAL(18,2)) AS credit_turn FROM customer"""
UNION_C = """SELECT 'turn_' || o_orderpriority AS file_name, o_orderstatus AS analytic,
  CAST(o_totalprice AS DECIMAL(18,2)) AS debit_turn FROM orders"""


@query("registers_union", f"""SELECT file_name, acct, CAST(NULL AS VARCHAR) AS analytic, debit_turn,
  CAST(NULL AS DECIMAL(18,2)) AS credit_turn FROM ({UNION_A})
UNION ALL SELECT file_name, acct, analytic, NULL, credit_turn FROM ({UNION_B})
UNION ALL SELECT file_name, NULL, analytic, debit_turn, NULL FROM ({UNION_C})""")
def registers_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-65 + O-10: union by column name (missing -> null), canonical column order."""
    register_views(spark, sf_dir, ["supplier", "customer", "orders"])
    u = union_registers([spark.sql(UNION_A), spark.sql(UNION_B), spark.sql(UNION_C)])
    return order_columns(u, ["file_name", "acct", "analytic", "debit_turn", "credit_turn"])


# Orders per customer in key order; before every 5th order a subtotal row
# equal to that order plus the next one (if any) is injected.
SUBTOTAL_SQL = """
WITH o AS (
  SELECT o_custkey, o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS v,
         lead(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nv
  FROM orders)
SELECT 'analysis_' || CAST(o_custkey % 4 AS STRING) AS file_name, o_custkey, o_orderkey, CAST(1 AS INT) AS k, v
FROM o
UNION ALL
SELECT 'analysis_' || CAST(o_custkey % 4 AS STRING), o_custkey, o_orderkey, CAST(0 AS INT), v + coalesce(nv, 0)
FROM o WHERE o_orderkey % 5 = 0
"""


@query("hidden_subtotals", f"""WITH s AS ({SUBTOTAL_SQL}),
p AS (SELECT *, row_number() OVER w AS pos, sum(CAST(v AS DECIMAL(20,4))) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING
        AND CURRENT ROW) AS P FROM s WINDOW w AS (PARTITION BY file_name, o_custkey ORDER BY o_orderkey, k)),
j AS (SELECT a.*, (SELECT min(b.pos) FROM p b WHERE b.file_name = a.file_name AND b.o_custkey = a.o_custkey
                     AND b.pos > a.pos AND b.P >= a.P + a.v - 0.005) AS stop FROM p a)
SELECT j.file_name, j.o_custkey, j.o_orderkey, j.k, j.v,
  coalesce((SELECT b.P - j.P <= j.v + 0.005 FROM p b WHERE b.file_name = j.file_name AND b.o_custkey = j.o_custkey
            AND b.pos = j.stop), false) AS is_subtotal
FROM j""")
def hidden_subtotals_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-71: subtotal rows not marked in italics, found from prefix sums."""
    from ..operators.reconcile import hidden_subtotals
    register_views(spark, sf_dir, ["orders"])
    s = spark.sql(SUBTOTAL_SQL)
    out = hidden_subtotals(s, RowOrder("file_name", ("o_orderkey", "k"), block_rows=4096), ["o_custkey"], "v")
    return out.select("file_name", "o_custkey", "o_orderkey", "k", "v", "is_subtotal")
