"""Register-shaped inputs derived from the star-schema tables.

Each builder is one SQL text that runs unchanged in Spark SQL and in DuckDB, so
the Spark operators and the SQL oracle start from identical rows.  The
registers grow with the tables (every lineitem / order / customer row lands in
a register row); the order of a register is a tuple of non-null keys ``k1..k5``
and its blocks are cut by ``(k1, k2, k3 / 64)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordered import RowOrder
from ..operators.stage import stage

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]

# Outline register order and blocks (see module doc).
REGISTER_ORDER = RowOrder(file_col="file_name", order_cols=("k1", "k2", "k3", "k4", "k5"),
                          block_cols=("k1", "k2", "b3"))

# suppliers whose rows are numbered together
NUMBER_BLOCK = 1024

# the sums of a row of money
SUMS = ["q", "dt_turn", "kt_turn", "q_dt", "q_kt"]
SHORT, WIDE = "decimal(18,2)", "decimal(22,2)"

MEASURES = ["dt_open", "kt_open", "dt_turn", "kt_turn", "dt_close", "kt_close"]


def lineitem_outline_sql() -> str:
    """Turnover-like register from lineitem, one file per return flag.

    Outline: level 0 account (60..69), level 1 sub-account (60.01..), level 2
    supplier, level 3 order (leaf).  Every money row is followed by an
    unlabelled quantity row at the same level; each file ends with a total row
    (label 'Итого') and its quantity row.
    """
    return """
WITH li AS (
  SELECT 'turnover_' || l_returnflag AS file_name,
         CAST(60 + l_suppkey % 10 AS BIGINT) AS a1,
         CAST(l_linenumber AS BIGINT) AS a2,
         l_suppkey AS a3,
         l_orderkey AS a4,
         CAST(l_quantity AS DECIMAL(18,2)) AS qty,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS amt,
         l_linestatus AS st
  FROM lineitem
),
g AS (
  SELECT file_name, a1, a2, a3, a4,
         GROUPING(a1) AS g1, GROUPING(a2) AS g2, GROUPING(a3) AS g3, GROUPING(a4) AS g4,
         CAST(SUM(qty * 100) AS DECIMAL(22,2)) AS dt_open,
         CAST(SUM(CASE WHEN st = 'O' THEN qty * 10 ELSE 0 END) AS DECIMAL(22,2)) AS kt_open,
         CAST(SUM(CASE WHEN st = 'F' THEN amt ELSE 0 END) AS DECIMAL(22,2)) AS dt_turn,
         CAST(SUM(CASE WHEN st = 'O' THEN amt ELSE 0 END) AS DECIMAL(22,2)) AS kt_turn,
         CAST(SUM(CASE WHEN st = 'F' THEN qty ELSE 0 END) AS DECIMAL(22,2)) AS q_dt,
         CAST(SUM(CASE WHEN st = 'O' THEN qty ELSE 0 END) AS DECIMAL(22,2)) AS q_kt
  FROM li
  GROUP BY GROUPING SETS ((file_name), (file_name, a1), (file_name, a1, a2),
                          (file_name, a1, a2, a3), (file_name, a1, a2, a3, a4))
),
money AS (
  SELECT file_name,
         CASE WHEN g1 = 1 THEN CAST(99 AS BIGINT) ELSE a1 END AS k1,
         COALESCE(a2, CAST(-1 AS BIGINT)) AS k2,
         COALESCE(a3, CAST(-1 AS BIGINT)) AS k3,
         COALESCE(a4, CAST(-1 AS BIGINT)) AS k4,
         CASE WHEN g1 = 1 THEN 0 ELSE 3 - g2 - g3 - g4 END AS level,
         CASE WHEN g1 = 1 THEN 'Итого'
              WHEN g2 = 1 THEN CAST(a1 AS STRING)
              WHEN g3 = 1 THEN CAST(a1 AS STRING) || '.' || lpad(CAST(a2 AS STRING), 2, '0')
              WHEN g4 = 1 THEN 'Поставщик ' || CAST(a3 AS STRING)
              ELSE 'Заказ ' || CAST(a4 AS STRING) END AS label,
         dt_open, kt_open, dt_turn, kt_turn,
         CAST(dt_open + dt_turn AS DECIMAL(22,2)) AS dt_close,
         CAST(kt_open + kt_turn AS DECIMAL(22,2)) AS kt_close,
         q_dt, q_kt
  FROM g
)
SELECT file_name, k1, k2, k3, k4, CAST(0 AS BIGINT) AS k5,
       CAST(floor(k3 / 64) AS BIGINT) AS b3, CAST(level AS INT) AS level, label,
       dt_open, kt_open, dt_turn, kt_turn, dt_close, kt_close
FROM money
UNION ALL
SELECT file_name, k1, k2, k3, k4, CAST(1 AS BIGINT) AS k5,
       CAST(floor(k3 / 64) AS BIGINT) AS b3, CAST(level AS INT) AS level, CAST(NULL AS STRING) AS label,
       CAST(0 AS DECIMAL(22,2)) AS dt_open, CAST(0 AS DECIMAL(22,2)) AS kt_open,
       q_dt AS dt_turn, q_kt AS kt_turn,
       q_dt AS dt_close, q_kt AS kt_close
FROM money
"""


def lineitem_money(spark: SparkSession, sf_dir: str, block: int = 64) -> DataFrame:
    """The money rows of ``lineitem_outline_sql`` by the sums they are made of (``money_measures``, ``quantity_measures``), and ``b``, the
    block of ``block`` suppliers; the line items are exchanged once, by file, account and block.  Sums have 18 digits, which Spark keeps in
    a long; those of a row with a longer one are in ``wide``.

    Orders are grouped inside that exchange; the levels above sum up suppliers, combined before they are shuffled."""
    keys = ["file_name", "a1", "a2", "a3", "a4"]
    none = F.lit(-1).cast("bigint")
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.concat(F.lit("turnover_"), "l_returnflag").alias("file_name"), (60 + F.col("l_suppkey") % 10).cast("bigint").alias("a1"),
        F.col("l_linenumber").cast("bigint").alias("a2"), F.col("l_suppkey").alias("a3"), F.col("l_orderkey").alias("a4"),
        F.col("l_quantity").cast("decimal(18,2)").alias("qty"), F.col("l_extendedprice").cast("decimal(18,2)").alias("amt"),
        F.col("l_linestatus").alias("st"))

    def of(status, value):
        return F.sum(F.when(F.col("st") == status, value).otherwise(0))
    sums = dict(zip(SUMS, (F.sum("qty"), of("F", F.col("amt")), of("O", F.col("amt")), of("F", F.col("qty")), of("O", F.col("qty")))))
    again = [F.sum(c).alias(c) for c in sums]

    # one number of partitions, so that Spark keeps both parts where they are for what is ordered by block
    n, at = int(spark.conf.get("spark.sql.shuffle.partitions")), ["file_name", "k1", "k2", "b"]

    def placed(d, k1):
        return d.withColumns({"k1": k1, "k2": F.coalesce("a2", none), "b": F.floor(F.coalesce("a3", none) / block).cast("bigint")}).repartition(n, *at)
    order = (placed(item, F.col("a1")).groupBy(*at, *keys[2:])
             .agg(*[v.alias(c) for c, v in sums.items()]).withColumns({"total": F.lit(False), "level": F.lit(3)}))
    above = (item.groupBy(*keys[:4]).agg(*[v.alias(c) for c, v in sums.items()])
             .groupingSets([keys[:n] for n in (1, 2, 3, 4)], *keys[:4])
             .agg((F.grouping("a1") == 1).alias("total"), (3 - F.grouping("a2") - F.grouping("a3") - 1).alias("level"), *again)
             .withColumn("a4", F.lit(None).cast(item.schema["a4"].dataType)))
    above = placed(above, F.when(F.col("total"), F.lit(99).cast("bigint")).otherwise(F.col("a1"))).drop("a1")
    d = order.unionByName(above)
    total, account = F.col("total"), F.col("k1").cast("string")
    level = F.when(total, 0).otherwise(F.col("level")).cast("int")
    label = (F.when(total, F.lit("Итого")).when(level == 0, account)
             .when(level == 1, F.concat(account, F.lit("."), F.lpad(F.col("a2").cast("string"), 2, "0")))
             .when(level == 2, F.concat(F.lit("Поставщик "), F.col("a3").cast("string")))
             .otherwise(F.concat(F.lit("Заказ "), F.col("a4").cast("string"))))
    short = {c: F.col(c).try_cast(SHORT) for c in SUMS}
    long = F.lit(False)
    for c in SUMS:
        long = long | (F.abs(c) >= 10 ** 16)
    return d.select("file_name", "k1", "k2", F.coalesce("a3", none).alias("k3"), F.coalesce("a4", none).alias("k4"), "b",
                    level.alias("level"), label.alias("label"), *[v.alias(c) for c, v in short.items()],
                    F.when(long, F.struct(*[F.col(c).cast(WIDE).alias(c) for c in SUMS])).alias("wide"))


def lineitem_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``lineitem_outline_sql``; each money row makes its quantity row."""
    d = lineitem_money(spark, sf_dir)

    def row(k5, label, values):
        return F.struct(F.lit(k5).cast("bigint").alias("k5"), label.alias("label"), *[v.alias(m) for m, v in values.items()])
    rows = F.array(row(0, F.col("label"), money_measures()), row(1, F.lit(None).cast("string"), quantity_measures()))
    d = d.select("file_name", "k1", "k2", "k3", "k4", F.col("b").alias("b3"), "level", F.inline(rows))
    return d.select("file_name", "k1", "k2", "k3", "k4", "k5", "b3", "level", "label", *MEASURES)


def _sum(c: str) -> Column:
    return F.coalesce(F.col(c).cast(WIDE), F.col("wide")[c])


def money_measures() -> dict[str, Column]:
    """The measures of a row of ``lineitem_money``."""
    dt_open, kt_open = ((_sum(c) * times).cast(WIDE) for c, times in (("q", 100), ("q_kt", 10)))
    dt, kt = _sum("dt_turn"), _sum("kt_turn")
    return dict(zip(MEASURES, (dt_open, kt_open, dt, kt, (dt_open + dt).cast(WIDE), (kt_open + kt).cast(WIDE))))


def quantity_measures() -> dict[str, Column]:
    """The measures of its quantity row."""
    zero, dt, kt = F.lit(0).cast(WIDE), _sum("q_dt"), _sum("q_kt")
    return dict(zip(MEASURES, (zero, zero, dt, kt, dt, kt)))


def numbered(money: DataFrame, cases: list[tuple[Column, list[Column]]]) -> DataFrame:
    """Rows of the register from ``lineitem_money``, numbered in their files: the columns of ``money`` and of the structs that stand for its
    row, and ``row_no`` (from 1, by k1, k2, k3, k4, then the place among the structs).

    ``cases``: (condition, structs), the first that holds counts; the condition goes by the file.  So all rows of money of a file
    become as many rows, and only they are ranked, by (file, account, block); rows of equal keys take turns, as the order
    of the single rows asks for."""
    block = ["file_name", "k1", "k2", "b"]
    w = Window.partitionBy(*block).orderBy("k3", "k4")
    # counts run up to the last row of equal keys
    d = money.withColumns({"__rank": F.rank().over(w), "__rn": F.row_number().over(w), "__upto": F.count(F.lit(1)).over(w)})
    d = stage(d, "ranked")
    counts = d.groupBy(*block).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("file_name").orderBy(*block[1:]).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(c).alias(f"__{c}") for c in block], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    d = d.join(stage(counts, "offsets"), [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in block], "left")
    size, case = F.lit(0), F.lit(None).cast("int")
    for i, (holds, structs) in reversed([*enumerate(cases)]):
        size, case = F.when(holds, len(structs)).otherwise(size), F.when(holds, i).otherwise(case)
    first = (F.col("__before") + F.col("__rank") - 1) * size + F.col("__rn") - F.col("__rank") + 1
    d = d.select(*money.columns, first.alias("__first"), (F.col("__upto") - F.col("__rank") + 1).alias("__equal"), case.alias("__case"),
                 size.alias("__size"))
    of = money.select(cases[0][1][0].alias("row")).schema["row"].dataType.names
    # a read for each place: rows and columns that a plan does not ask for are not made
    out = []
    for k in range(max(len(structs) for _, structs in cases)):
        made = {c: F.coalesce(*[F.when(F.col("__case") == i, structs[k].getField(c)) for i, (_, structs) in enumerate(cases) if len(structs) > k])
                for c in of}
        out.append(d.where(F.col("__size") > k).select(
            *[c for c in money.columns if c not in of], *[v.alias(c) for c, v in made.items()],
            (F.col("__first") + k * F.col("__equal")).cast("long").alias("row_no")))
    return reduce(DataFrame.unionByName, out)


def register_views(spark, sf_dir: str, tables=TABLES) -> None:
    """Expose the driver tables to Spark SQL under their own names."""
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
