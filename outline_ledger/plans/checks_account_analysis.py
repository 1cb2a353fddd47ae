"""Checks of the account analysis (P-5, P-6) from raw cells, and of the greedy removal (O-72).

The register is made from lineitem, one file per return flag: accounts and sub-accounts with a block
of contra accounts each, contra accounts with groups and suppliers.  File R has currency columns,
and its groups are not in italics; file N has no account at the first level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import (ANALYSIS_FROM_CREDIT as CREDIT, ANALYSIS_RELATION as RELATION, ANALYSIS_TO_DEBIT as DEBIT,
                         CURRENCY_TWIN_SUFFIX as CUR, INDICATOR_COLUMN, OUTLINE_FILE_COL, QTY_TWIN_SUFFIX as QTY)
from ..operators.analysis import account_gaps, side_removal
from ..operators.ordered import RowOrder, ordinal
from ..operators.stage import stage
from .analysis import CHECK_ACCOUNT, CHECK_DIFF, account_analysis, resolve_analysis
from .catalog import query
from .derived import register_views

# slot of a contra row within its block: code, has details
CODES = {0: "7", 1: "51", 3: "60.01", 4: "60.02", 5: "76.ФВ", 7: "94.Н", 8: "55", 9: "55.1"}

# kind: 0 opening row, 1 code row, 2 group row, 3 supplier row, 4 and 5 closing rows; the rows of slots 2 (60) and 6 (94)
# repeat those below them, and those of slot 9 (55.1) the row above
MONEY_SQL = """
WITH li AS (
  SELECT l_returnflag AS rf, CAST(60 + l_suppkey % 3 AS BIGINT) AS a1, CAST(l_linenumber AS BIGINT) AS a2,
    CAST(CASE l_partkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 5
         ELSE CASE WHEN l_suppkey % 2 = 0 THEN 7 ELSE 8 END END AS BIGINT) AS slot,
    CAST(l_suppkey % 5 AS BIGINT) AS g, l_suppkey AS s, l_orderkey % 2 AS side,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS amt, CAST(l_quantity AS DECIMAL(18,2)) AS qty
  FROM lineitem),
more AS (
  SELECT * FROM li
  UNION ALL SELECT rf, a1, a2, CAST(2 AS BIGINT), CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), side, amt, qty FROM li WHERE slot IN (3, 4)
  UNION ALL SELECT rf, a1, a2, CAST(6 AS BIGINT), CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), side, amt, qty FROM li WHERE slot = 7
  UNION ALL SELECT rf, a1, a2, CAST(9 AS BIGINT), CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), side, amt, qty FROM li WHERE slot = 8),
sums AS (
  SELECT rf, a1, a2, slot, g, s, CAST(1 + (1 - GROUPING(g)) + (1 - GROUPING(s)) AS BIGINT) AS kind,
    CAST(SUM(CASE WHEN side = 0 THEN amt END) AS DECIMAL(18,2)) AS credit,
    CAST(SUM(CASE WHEN side = 1 THEN amt END) AS DECIMAL(18,2)) AS debit,
    CAST(SUM(CASE WHEN side = 0 THEN qty END) AS DECIMAL(18,2)) AS credit_qty,
    CAST(SUM(CASE WHEN side = 1 THEN qty END) AS DECIMAL(18,2)) AS debit_qty
  FROM more GROUP BY GROUPING SETS ((rf, a1, a2, slot), (rf, a1, a2, slot, g), (rf, a1, a2, slot, g, s))),
blocks AS (SELECT DISTINCT rf, a1, a2 FROM li UNION ALL SELECT DISTINCT rf, a1, CAST(0 AS BIGINT) FROM li),
rows_ AS (
  SELECT rf, a1, a2, CAST(-1 AS BIGINT) AS slot, CAST(-1 AS BIGINT) AS g, CAST(-1 AS BIGINT) AS s, CAST(0 AS BIGINT) AS kind,
    CAST(NULL AS DECIMAL(18,2)) AS credit, CAST(NULL AS DECIMAL(18,2)) AS debit, CAST(NULL AS DECIMAL(18,2)) AS credit_qty,
    CAST(NULL AS DECIMAL(18,2)) AS debit_qty FROM blocks
  UNION ALL SELECT rf, a1, a2, slot, COALESCE(g, CAST(-1 AS BIGINT)), COALESCE(s, CAST(-1 AS BIGINT)), kind, credit, debit,
    credit_qty, debit_qty FROM sums WHERE slot IN (0, 3, 4, 5, 7) OR kind = 1
  UNION ALL SELECT rf, a1, a2, CAST(99 AS BIGINT), CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), k, NULL, NULL, NULL, NULL
    FROM blocks, (SELECT CAST(4 AS BIGINT) AS k UNION ALL SELECT CAST(5 AS BIGINT)) kk WHERE a2 > 0)
SELECT 'analysis_' || rf AS file_name, rf, a1, a2, slot, g, s, kind,
  CAST(CASE WHEN a2 = 0 THEN 0 ELSE 1 END AS INT) AS level,
  CASE WHEN kind <> 0 THEN NULL WHEN a2 = 0 THEN CASE WHEN rf = 'N' THEN 'Контрагент ' || CAST(a1 AS STRING) ELSE CAST(a1 AS STRING) END
       WHEN a2 = 7 THEN NULL ELSE CAST(a1 AS STRING) || '.0' || CAST(a2 AS STRING) END AS label,
  CASE kind WHEN 0 THEN 'Нач.сальдо' WHEN 4 THEN 'Оборот' WHEN 5 THEN 'Кон.сальдо' WHEN 2 THEN 'Группа ' || CAST(g AS STRING)
       WHEN 3 THEN 'Поставщик ' || CAST(s AS STRING)
       ELSE CASE slot WHEN 0 THEN '7' WHEN 1 THEN '51' WHEN 2 THEN '60' WHEN 3 THEN '60.01' WHEN 4 THEN '60.02' WHEN 5 THEN '76.ФВ'
                      WHEN 6 THEN '94' WHEN 7 THEN '94.Н' WHEN 8 THEN '55' ELSE '55.1' END END AS cell,
  CASE WHEN kind = 0 AND a2 > 0 AND a2 < 7 AND a2 % 3 > 0 THEN 'Вид ' || CAST(a2 % 3 AS STRING) END AS relation,
  kind = 2 AND rf <> 'R' AS italic,
  CASE WHEN kind = 1 AND slot = 5 AND rf = 'N' AND a1 = 60 AND a2 = 1 THEN CAST(COALESCE(credit, 0) + 5 AS DECIMAL(18,2)) ELSE credit END
    AS credit, debit, credit_qty, debit_qty
FROM rows_
"""
KEYS = ("a1", "a2", "slot", "g", "s", "kind")
M_ORDER = RowOrder("file_name", (*KEYS, "part"), ("a1", "a2", "slot"))


def _cells(spark: SparkSession, sf_dir: str, dialect: str) -> DataFrame:
    """raw_rows of the register: each file's own layout, service rows for quantities (and currency)."""
    register_views(spark, sf_dir, ["lineitem"])
    money = stage(spark.sql(MONEY_SQL), "money")
    rows = money.withColumn("part", F.lit(0))
    qty = money.where("credit IS NOT NULL OR debit IS NOT NULL").withColumns(
        {"part": F.lit(1), "label": F.lit(None).cast("string"), "relation": F.lit(None).cast("string"),
         "cell": F.lit("Кол-во:") if dialect == "upp" else F.col("cell"), "italic": F.lit(False), "credit": F.col("credit_qty"), "debit": F.col("debit_qty")})
    if dialect == "upp":
        rows = rows.union(qty.where("rf <> 'N'"))
    else:
        # quantity and currency rows in file A, currency rows alone in R
        cur = qty.withColumns({"part": F.lit(2), "credit": F.col("credit_qty") * 2, "debit": F.col("debit_qty") * 2})
        rows = (rows.withColumn("mark", F.lit("БУ")).union(qty.where("rf = 'A'").withColumn("mark", F.lit("Кол.")))
                .union(cur.where("rf <> 'N'").select(*rows.columns).withColumn("mark", F.lit("Вал."))))
    rows = stage(ordinal(rows, "row_no", M_ORDER), "numbered")
    credit, debit = F.col("credit").cast("string"), F.col("debit").cast("string")
    label, cell, kind = F.col("label"), F.col("cell"), F.col("relation")
    if dialect == "upp":
        twin = [(F.col(c) * 3).cast("string") for c in ("credit", "debit")]
        layouts = {"A": (["Счет", "Кор.счет", CREDIT, DEBIT, RELATION], [label, cell, credit, debit, kind]),
                   "R": (["Счет", "", "Кор.счет", CREDIT, CREDIT, DEBIT, DEBIT], [label, F.lit("?"), cell, credit, twin[0], debit, twin[1]]),
                   "N": ([" Счет", "Кор.счет", RELATION, CREDIT, None, DEBIT], [label, cell, kind, credit, F.lit("1"), debit])}
    else:
        mark = F.when(F.col("kind").isin(1, 2, 3), F.col("mark"))
        full = (["Счет", INDICATOR_COLUMN, "Кор. Счет", "Дебет", "Кредит", RELATION], [label, mark, cell, credit, debit, kind])
        layouts = {"A": full, "R": full, "N": (["Счет", "Кор. Счет", RELATION, "Дебет", "Кредит"], [label, cell, kind, credit, debit])}
    cells = F.coalesce(*[F.when(F.col("rf") == rf, F.array(*c)) for rf, (_, c) in layouts.items()])
    data = rows.select("file_name", (F.col("row_no") + 3).alias("row_no"), "level", "italic", cells.alias("cells"))
    heads = [(f"analysis_{rf}", n, 0, False, c) for rf, (titles, _) in layouts.items()
             for n, c in ((1, ["Анализ счета"]), (2, [None]), (3, titles))]
    # a file for each customer that must be rejected: no header, no column for a side, no outline, a row without a level
    register_views(spark, sf_dir, ["customer"])
    bad = spark.table("customer").select(F.concat(F.lit("bad_"), F.col("c_custkey").cast("string")).alias("file_name"),
                                         (F.col("c_custkey") % 4).alias("fault"), F.explode(F.array(F.lit(1), F.lit(2))).alias("row_no"))
    good = F.array(*[F.lit(c) for c in layouts["A"][0]])
    cells = (F.when(F.col("row_no") == 2, F.array(F.lit("60"), F.lit("51"), F.lit("1"), F.lit("2")))
             .when(F.col("fault") == 0, F.array(F.lit("Отчет"))).when(F.col("fault") == 1, F.array(F.lit("Счет"), F.lit("Сумма"))).otherwise(good))
    level = F.when(F.col("row_no") == 1, 0).when(F.col("fault") == 2, 0).when(F.col("fault") != 3, 1).cast("int")
    bad = bad.select("file_name", F.col("row_no").cast("long").alias("row_no"), level.alias("level"), F.lit(False).alias("italic"), cells.alias("cells"))
    return data.union(bad).union(spark.createDataFrame(heads, "file_name string, row_no long, level int, italic boolean, cells array<string>"))


# The flat rows by construction: suppliers, and the code rows without any (51 and 55); groups and the rows
# that repeat others are gone in every file.
def _flat_sql(dialect: str) -> str:
    qty_files = "rf <> 'N'" if dialect == "upp" else "rf = 'A'"
    cur = ("CAST(CASE WHEN rf = 'R' THEN {c} * 3 END AS DECIMAL(18,2))" if dialect == "upp"
           else "CAST(CASE WHEN rf = 'R' THEN {c}_qty * 2 END AS DECIMAL(18,2))")
    related = "rf <> 'R'" if dialect == "upp" else "true"
    twin = "m.rf = 'R'" if dialect == "upp" else "false"
    # the second dialect reads italics in all files, so groups of file R stay there
    kinds = "m.kind = 3 OR (m.kind = 1 AND m.slot IN (1, 8))" if dialect == "upp" else \
        "m.kind = 3 OR (m.kind = 2 AND m.rf = 'R') OR (m.kind = 1 AND m.slot IN (1, 8))"
    return f"""
WITH m AS (SELECT *, CASE WHEN kind = 0 AND label IS NULL THEN 'Не_заполнено'
                          WHEN kind IN (4, 5) THEN 'Не_заполнено' ELSE label END AS mark FROM ({MONEY_SQL})),
f AS (SELECT *, last_value(mark IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS analytic,
        last_value(CASE WHEN level = 0 THEN label END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p0
      FROM m WINDOW w AS (PARTITION BY file_name ORDER BY {', '.join(KEYS)}))
SELECT m.file_name AS "{OUTLINE_FILE_COL}",
  CASE WHEN rf = 'N' THEN 'Без_субсчетов' WHEN analytic = 'Не_заполнено' THEN p0 ELSE analytic END AS "Субсчет",
  analytic AS "Аналитика",
  CASE WHEN {related} AND a2 < 7 AND a2 % 3 > 0 THEN 'Вид ' || CAST(a2 % 3 AS VARCHAR) END AS "{RELATION}",
  CASE slot WHEN 0 THEN '07' WHEN 1 THEN '51' WHEN 3 THEN '60.01' WHEN 4 THEN '60.02' WHEN 5 THEN '76.ФВ' WHEN 7 THEN '94.Н' ELSE '55' END
    AS "Корр_счет",
  CASE WHEN m.kind = 1 THEN 'Не расшифровано' ELSE cell END AS "Субконто_корр_счета",
  CAST(credit AS DECIMAL(18,2)) AS "{CREDIT}",
  CAST(CASE WHEN {qty_files} THEN credit_qty END AS DECIMAL(18,2)) AS "{CREDIT + QTY}", {cur.format(c='credit')} AS "{CREDIT + CUR}",
  CAST(debit AS DECIMAL(18,2)) AS "{DEBIT}",
  CAST(CASE WHEN {qty_files} THEN debit_qty END AS DECIMAL(18,2)) AS "{DEBIT + QTY}", {cur.format(c='debit')} AS "{DEBIT + CUR}",
  p0 AS "Level_0",
  CASE WHEN analytic = 'Не_заполнено' AND rf <> 'N' THEN p0 ELSE analytic END AS "Level_1",
  CASE WHEN analytic = 'Не_заполнено' AND rf <> 'N' THEN analytic END AS "Level_2"
FROM f m WHERE {kinds}"""


FLAT_COLS = [OUTLINE_FILE_COL, "Субсчет", "Аналитика", RELATION, "Корр_счет", "Субконто_корр_счета", CREDIT, CREDIT + QTY, CREDIT + CUR,
             DEBIT, DEBIT + QTY, DEBIT + CUR, "Level_0", "Level_1", "Level_2"]


def _check_sql(dialect: str) -> str:
    n94 = "94.Н" if dialect == "upp" else "94"
    kinds = "kind = 3 OR (kind = 1 AND slot IN (1, 8))" + ("" if dialect == "upp" else " OR (kind = 2 AND rf = 'R')")
    return f"""
WITH m AS (SELECT *, CASE slot WHEN 0 THEN '07' WHEN 1 THEN '51' WHEN 3 THEN '60.01' WHEN 4 THEN '60.02' WHEN 5 THEN '76.ФВ'
             WHEN 7 THEN '94.Н' WHEN 8 THEN '55' END AS acct FROM ({MONEY_SQL})),
b AS (SELECT file_name, CASE WHEN acct = '94.Н' THEN '{n94}' ELSE acct END AS acct, sum(credit) AS c, sum(debit) AS d
      FROM m WHERE kind = 1 AND slot IN (0, 1, 3, 4, 5, 7, 8) GROUP BY ALL),
r AS (SELECT file_name, acct, sum(credit) AS c, sum(debit) AS d FROM m WHERE {kinds} GROUP BY ALL),
j AS (SELECT file_name, acct, coalesce(b.c, 0) AS bc, coalesce(b.d, 0) AS bd, coalesce(r.c, 0) AS rc, coalesce(r.d, 0) AS rd
      FROM b FULL JOIN r USING (file_name, acct))
SELECT acct AS "{CHECK_ACCOUNT}", CAST(bc AS DECIMAL(38,2)) AS "{CREDIT}_base", CAST(rc AS DECIMAL(38,2)) AS "{CREDIT}_current",
  CAST(bd AS DECIMAL(38,2)) AS "{DEBIT}_base", CAST(rd AS DECIMAL(38,2)) AS "{DEBIT}_current",
  CAST(round_even(bc - rc, 0) AS DECIMAL(18,0)) AS "{CHECK_DIFF[CREDIT]}",
  CAST(round_even(bd - rd, 0) AS DECIMAL(18,0)) AS "{CHECK_DIFF[DEBIT]}", file_name AS "{OUTLINE_FILE_COL}"
FROM j"""


def _flat(spark, sf_dir, dialect):
    flat, _, _ = account_analysis(_cells(spark, sf_dir, dialect), dialect=dialect)
    twin = {c: F.col(f"`{c}`").cast("decimal(18,2)") for c in (CREDIT + QTY, CREDIT + CUR, DEBIT + QTY, DEBIT + CUR)}
    return flat.withColumns(twin).select(*[F.col(f"`{c}`") for c in FLAT_COLS])


@query("account_analysis", _flat_sql("upp"))
def account_analysis_upp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-5: account analysis of the first dialect from raw cells, with currency twins and unmarked subtotals."""
    return _flat(spark, sf_dir, "upp")


@query("account_analysis_check", _check_sql("upp"))
def account_analysis_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-5: its check table by account, after the removal of unmarked subtotals."""
    return account_analysis(_cells(spark, sf_dir, "upp"))[1]


@query("account_analysis_indicator", _flat_sql("not_upp"))
def account_analysis_indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-6: account analysis of the second dialect, quantities and currency by the indicator column."""
    return _flat(spark, sf_dir, "not_upp")


@query("account_analysis_indicator_check", _check_sql("not_upp"))
def account_analysis_indicator_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-6: its check table by account."""
    return account_analysis(_cells(spark, sf_dir, "not_upp"), dialect="not_upp")[1]


@query("account_analysis_quarantine", """
SELECT 'bad_' || CAST(c_custkey AS VARCHAR) AS file_name, CASE c_custkey % 4 WHEN 0 THEN 'header row not found'
  WHEN 1 THEN 'required column not found' WHEN 2 THEN 'outline is empty' ELSE 'level or italic missing' END AS reason FROM customer""")
def account_analysis_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-9 / S-9: the rejected files of the batch, with reasons."""
    return resolve_analysis(_cells(spark, sf_dir, "upp"), "upp")[1]


# Orders by customer group; accounts share the prefix 60; every 5th order is preceded by a subtotal of it and the
# next, every 11th order is negative.  Control totals hold the true rows, in account 60.02 also every other
# subtotal, so that some candidates must be refused.
REMOVAL_SQL = """
WITH o AS (
  SELECT 'removal_' || CAST(o_custkey % 3 AS STRING) AS file_name,
    CASE o_custkey % 5 WHEN 0 THEN '60' WHEN 1 THEN '60.01' WHEN 2 THEN '60.02' WHEN 3 THEN '62' ELSE '76.ФВ' END AS acct, o_orderkey,
    CAST(CASE WHEN o_orderkey % 11 = 0 THEN -o_totalprice ELSE o_totalprice END AS DECIMAL(18,2)) AS v FROM orders),
n AS (SELECT *, lead(v) OVER (PARTITION BY file_name, acct ORDER BY o_orderkey) AS nv FROM o)
SELECT file_name, acct, CAST(o_orderkey * 2 + 1 AS BIGINT) AS row_no, v, true AS real FROM n
UNION ALL SELECT file_name, acct, CAST(o_orderkey * 2 AS BIGINT), CAST(v + COALESCE(nv, 0) AS DECIMAL(18,2)),
  acct = '62' OR (acct = '60.02' AND o_orderkey % 10 = 0) FROM n WHERE o_orderkey % 5 = 0
"""


@query("greedy_removal", f"""WITH RECURSIVE s AS ({REMOVAL_SQL}),
t AS (SELECT file_name, acct, sum(v) FILTER (real) AS base, sum(v) AS cur FROM s GROUP BY ALL),
d AS (SELECT *, round_even(base - cur, 0) AS diff FROM t),
open AS (SELECT file_name FROM d GROUP BY 1 HAVING sum(diff) <> 0),
targets AS (SELECT DISTINCT a.file_name, a.acct, a.base - a.cur AS gap, abs(a.diff) AS last FROM d a JOIN d p ON p.file_name = a.file_name
  AND p.diff <> 0 AND starts_with(a.acct, p.acct) WHERE a.file_name IN (SELECT file_name FROM open)),
p AS (SELECT *, row_number() OVER w AS pos, sum(v) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS P
      FROM s WINDOW w AS (PARTITION BY file_name, acct ORDER BY row_no)),
hits AS (SELECT a.file_name, a.acct, a.row_no, a.v FROM p a JOIN p b ON b.file_name = a.file_name AND b.acct = a.acct
    AND b.pos = (SELECT min(c.pos) FROM p c WHERE c.file_name = a.file_name AND c.acct = a.acct AND c.pos > a.pos AND c.P >= a.P + a.v - 0.005)
  WHERE b.P - a.P <= a.v + 0.005),
c AS (SELECT h.*, row_number() OVER (PARTITION BY file_name, acct ORDER BY row_no) AS n FROM hits h),
fold AS (
  SELECT file_name, acct, CAST(0 AS BIGINT) AS n, CAST(gap AS DECIMAL(38,2)) AS gap, CAST(last AS DECIMAL(38,2)) AS last, false AS taken,
    false AS stopped FROM targets
  UNION ALL
  SELECT f.file_name, f.acct, c.n, CASE WHEN ok THEN f.gap + c.v ELSE f.gap END, CASE WHEN ok THEN dev ELSE f.last END, ok,
    CASE WHEN ok THEN dev ELSE f.last END <= 1
  FROM fold f JOIN c ON c.file_name = f.file_name AND c.acct = f.acct AND c.n = f.n + 1,
    LATERAL (SELECT CAST(round_even(abs(f.gap + c.v), 0) AS DECIMAL(38,2)) AS dev), LATERAL (SELECT dev <= f.last AS ok)
  WHERE NOT f.stopped)
SELECT s.file_name, s.acct, s.row_no, s.v, coalesce(f.taken, false) AS removed, c.n IS NOT NULL AS candidate
FROM s LEFT JOIN (SELECT c.* FROM c SEMI JOIN targets USING (file_name, acct)) c ON c.file_name = s.file_name AND c.row_no = s.row_no
  AND c.acct = s.acct
LEFT JOIN fold f ON f.file_name = c.file_name AND f.acct = c.acct AND f.n = c.n""")
def greedy_removal_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-72 with O-86: one side of one pass, accounts sharing a prefix, negatives, candidates that are refused."""
    from ..operators.reconcile import hidden_subtotals
    register_views(spark, sf_dir, ["orders"])
    order = RowOrder("file_name", ("row_no",), block_rows=4096)
    s = stage(spark.sql(REMOVAL_SQL), "removal")
    control = s.groupBy("file_name", "acct").agg(F.sum(F.when(F.col("real"), F.col("v"))).alias("base_v"))
    work = s.select("file_name", "row_no", "acct", F.lit(True).alias("decoded"), "v")
    gaps = stage(account_gaps(work, control, ["v"]), "gaps")
    gone = side_removal(work, control, gaps, "v", order, block_rows=64).withColumn("removed", F.lit(True))
    found = hidden_subtotals(s.select("file_name", "row_no", "acct", "v"), order, ["acct"], "v")
    open_files = gaps.groupBy("file_name").agg(F.sum("diff_v").alias("d")).where("d <> 0").select("file_name")
    searched = gaps.join(open_files, "file_name", "left_semi").groupBy("file_name").agg(F.collect_list(
        F.when(F.col("diff_v") != 0, F.col("acct"))).alias("p"))
    return (found.join(gone, ["file_name", "row_no"], "left").join(searched, "file_name", "left")
            .select("file_name", "acct", "row_no", "v", F.coalesce("removed", F.lit(False)).alias("removed"),
                    (F.col("is_subtotal") & F.coalesce(F.exists("p", lambda p: F.col("acct").startswith(p)), F.lit(False))).alias("candidate")))
