"""Checks of the journal operators on a posting journal derived from orders
(dated entry rows) and lineitem (continuation text rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import QUANTITY
from ..functions.scalars import parse_date, parse_number, parse_timestamp
from ..operators.journal import (attach_by_ordinal, distinct_first, entries_with, entry_ids,
                                 fill_entries, first_unique_columns, line_numbers, pivot_lines,
                                 special_rows, split_cell)
from ..operators.ordered import RowOrder, ordinal
from ..operators.stage import stage
from .catalog import query
from .derived import register_views
from .journals import account_card, posting_report


def _date_text(col: str) -> str:
    return (f"lpad(CAST(day({col}) AS STRING), 2, '0') || '.' || lpad(CAST(month({col}) AS STRING), 2, '0')"
            f" || '.' || CAST(year({col}) AS STRING)")


JOURNAL_SQL = f"""
SELECT 'posting_' || CAST(o_orderkey % 5 AS STRING) AS file_name,
       o_orderkey AS ok, CAST(0 AS INT) AS kind, CAST(0 AS INT) AS ln, CAST(0 AS BIGINT) AS pk,
       CAST(0 AS BIGINT) AS sk, CAST(0 AS DECIMAL(18,2)) AS px,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL
            WHEN o_orderkey % 13 = 0 THEN {_date_text('o_orderdate')} || ' 10:15:00'
            ELSE {_date_text('o_orderdate')} END AS date_text,
       'Документ ' || CAST(o_custkey % 50 AS STRING) AS document,
       CASE WHEN o_orderstatus = 'F' THEN '60.01' ELSE '62.02' END AS debit,
       CASE WHEN o_orderkey % 2 = 0 THEN '90.01' ELSE '51' END AS credit,
       CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
       o_orderpriority AS text,
       'Контрагент ' || CAST(o_custkey % 20 AS STRING) AS sub_dt,
       CASE WHEN o_orderkey % 3 = 0 THEN 'Контрагент ' || CAST(o_custkey % 20 AS STRING)
            ELSE o_orderstatus END AS sub_kt
FROM orders
UNION ALL
SELECT 'posting_' || CAST(l_orderkey % 5 AS STRING), l_orderkey, CAST(1 AS INT), l_linenumber, l_partkey,
       l_suppkey, CAST(l_extendedprice AS DECIMAL(18,2)),
       NULL, NULL, NULL, NULL,
       CASE WHEN l_linenumber % 4 = 0 THEN CAST(l_quantity AS DECIMAL(18,2)) END,
       CASE WHEN l_linenumber % 4 = 0 THEN 'Количество' ELSE l_returnflag || l_linestatus END,
       NULL, NULL
FROM lineitem
"""
JOURNAL_ORDER = RowOrder(file_col="file_name", order_cols=("ok", "kind", "ln", "pk", "sk", "px"),
                         block_rows=4096)
KEYS = ["file_name", "ok", "kind", "ln", "pk", "sk", "px"]
W_J = "PARTITION BY file_name ORDER BY ok, kind, ln, pk, sk, px"
ROWS = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def _journal(spark, sf_dir):
    register_views(spark, sf_dir, ["orders", "lineitem"])
    return spark.sql(JOURNAL_SQL)


def _with_ids(spark, sf_dir):
    return entry_ids(_journal(spark, sf_dir), JOURNAL_ORDER, document="document", out="entry_id")


def _filled(spark, sf_dir, *cols):
    """Dated rows: keys, date, entry_id and ``cols`` (without any: all); what is not asked for is not staged."""
    d = _with_ids(spark, sf_dir).withColumn("date", parse_timestamp("date_text"))
    d = d.select(*KEYS, *cols, "entry_id", "date") if cols else d
    d = fill_entries(stage(d, "ids"), JOURNAL_ORDER, ["date", "entry_id"])
    return d.where(F.col("date").isNotNull())


def _lines(spark, sf_dir):
    return line_numbers(stage(_filled(spark, sf_dir, "text"), "filled"), JOURNAL_ORDER, ["date", "entry_id"])


SQL_IDS = f"""WITH j AS ({JOURNAL_SQL})
SELECT *, CASE WHEN document IS NOT NULL THEN document || '_end' ||
          CAST(row_number() OVER (PARTITION BY file_name, document ORDER BY ok, kind, ln, pk, sk, px) AS STRING)
          END AS entry_id
FROM j"""
SQL_FILLED = f"""WITH i AS ({SQL_IDS}),
p AS (SELECT *, coalesce(try_strptime(date_text, '%d.%m.%Y %H:%M:%S'), try_strptime(date_text, '%d.%m.%Y')) AS d0
      FROM i),
f AS (SELECT * EXCLUDE (d0, entry_id),
        last_value(d0 IGNORE NULLS) OVER (w {ROWS}) AS date,
        last_value(entry_id IGNORE NULLS) OVER (w {ROWS}) AS entry_id
      FROM p WINDOW w AS ({W_J}))
SELECT * FROM f WHERE date IS NOT NULL"""
SQL_LINES = f"""WITH f AS ({SQL_FILLED})
SELECT *, CAST(row_number() OVER (PARTITION BY file_name, date, entry_id ORDER BY ok, kind, ln, pk, sk, px)
          AS BIGINT) AS line_no FROM f"""


@query("entry_ids", f"SELECT {', '.join(KEYS)}, entry_id FROM ({SQL_IDS})")
def entry_ids_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-45: document + '_end' + occurrence number."""
    return _with_ids(spark, sf_dir).select(*KEYS, "entry_id")


@query("entry_fill", f"SELECT {', '.join(KEYS)}, date, entry_id FROM ({SQL_FILLED})")
def entry_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-74 + O-46 + O-21: parse dates, forward fill date and entry, keep dated rows."""
    return _filled(spark, sf_dir).select(*KEYS, "date", "entry_id")


@query("entry_lines", f"SELECT {', '.join(KEYS)}, date, entry_id, line_no FROM ({SQL_LINES})")
def entry_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-47: line number within (date, entry)."""
    return _lines(spark, sf_dir).select(*KEYS, "date", "entry_id", "line_no")


@query("entry_text_lines", f"""SELECT file_name, date, entry_id, line_no, text FROM ({SQL_LINES})
WHERE text IS NOT NULL""")
def entry_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-47 + O-37 in long form: the text lines of each entry (service words kept)."""
    return _lines(spark, sf_dir).where("text IS NOT NULL").select("file_name", "date", "entry_id", "line_no", "text")


TEXT_WIDTH = 7  # an order has at most seven lines


@query("entry_text_pivot", f"""WITH j AS ({JOURNAL_SQL})
SELECT file_name, ok, {', '.join(f'max(CASE WHEN ln = {i} THEN text END) AS "{i}"' for i in range(1, TEXT_WIDTH + 1))}
FROM j WHERE kind = 1 GROUP BY file_name, ok""")
def entry_text_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-37: text lines of each order's entry, wide by line number (service words kept)."""
    lines = _journal(spark, sf_dir).where("kind = 1").groupBy("file_name", "ok", "ln").agg(F.max("text").alias("text"))
    return pivot_lines(lines, ["file_name", "ok"], "ln", "text", prefix="", width=TEXT_WIDTH)


FU_COLS = ["document", "debit", "credit", "sub_dt", "sub_kt", "text"]


def _fu_sql() -> str:
    cols = []
    for j, c in enumerate(FU_COLS):
        prev = " OR ".join(f"{c} = {p}" for p in FU_COLS[:j])
        cols.append(c if not prev else f"CASE WHEN {prev} THEN NULL ELSE {c} END AS {c}")
    return f"WITH j AS ({JOURNAL_SQL}) SELECT {', '.join(KEYS)}, {', '.join(cols)} FROM j WHERE kind = 0"


@query("entry_first_unique", _fu_sql())
def entry_first_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-64: a value repeated later in the same row becomes null."""
    d = _journal(spark, sf_dir).where(F.col("kind") == 0)
    return first_unique_columns(d, FU_COLS).select(*KEYS, *FU_COLS)


@query("entry_distinct_first", f"""SELECT {', '.join(KEYS)}, entry_id, debit, credit, text FROM ({SQL_FILLED})
QUALIFY row_number() OVER (PARTITION BY file_name, entry_id, debit, credit ORDER BY ok, kind, ln, pk, sk, px) = 1""")
def entry_distinct_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-38: first row (file order) of each (entry, debit, credit); nulls equal."""
    d = _filled(spark, sf_dir).select(*KEYS, "entry_id", "debit", "credit", "text")
    return distinct_first(d, JOURNAL_ORDER, ["entry_id", "debit", "credit"])


@query("entry_specials_join", f"""WITH f AS ({SQL_FILLED}),
q AS (SELECT file_name, entry_id, list(amount) AS qs FROM f WHERE text = 'Количество' GROUP BY file_name, entry_id)
SELECT e.file_name, e.entry_id, e.date, e.amount, unnest(coalesce(q.qs, [NULL])) AS qty
FROM (SELECT * FROM f WHERE kind = 0) e LEFT JOIN q ON e.file_name = q.file_name AND e.entry_id = q.entry_id""")
def entry_specials_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-25 + O-26/O-27: entries left-joined with their quantity rows (fan-out kept)."""
    f = stage(_filled(spark, sf_dir), "filled")
    specials, _ = special_rows(f, "text", [QUANTITY])
    entries = f.where(F.col("kind") == 0).select("file_name", "entry_id", "date", "amount")
    q = specials.select("file_name", "entry_id", F.col("amount").alias("qty"))
    return entries_with(entries, q, ["file_name", "entry_id"])


# ordinal attach: per nation, suppliers (all) vs suppliers without every 7th
# key in odd nations -> counts equal only in even nations.
SUPP_SQL = "SELECT 'nation_' || CAST(s_nationkey AS STRING) AS file_name, s_suppkey, s_name FROM supplier"
SUPP_B_SQL = SUPP_SQL + " WHERE NOT (s_nationkey % 2 = 1 AND s_suppkey % 7 = 0)"


@query("ordinal_attach", f"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY s_suppkey) AS k
                FROM ({SUPP_SQL})),
b AS (SELECT file_name, s_name AS b_name,
             row_number() OVER (PARTITION BY file_name ORDER BY s_suppkey DESC) AS k FROM ({SUPP_B_SQL})),
na AS (SELECT file_name, count(*) AS n FROM a GROUP BY 1),
nb AS (SELECT file_name, count(*) AS n FROM b GROUP BY 1),
ok AS (SELECT na.file_name FROM na JOIN nb ON na.file_name = nb.file_name AND na.n = nb.n)
SELECT a.file_name, a.s_suppkey, a.s_name, b.b_name
FROM a LEFT JOIN (SELECT * FROM b WHERE file_name IN (SELECT file_name FROM ok)) b
  ON a.file_name = b.file_name AND a.k = b.k""")
def ordinal_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-28: k-th right row attached to k-th left row only when counts agree."""
    register_views(spark, sf_dir, ["supplier"])
    a = spark.sql(SUPP_SQL)
    b = spark.sql(SUPP_B_SQL).select("file_name", F.col("s_name").alias("b_name"),
                                     (-F.col("s_suppkey")).alias("neg_key"))
    out = attach_by_ordinal(a, b, RowOrder("file_name", ("s_suppkey",), block_rows=4096),
                            RowOrder("file_name", ("neg_key",), block_rows=4096), ["b_name"])
    return out.select("file_name", "s_suppkey", "s_name", "b_name")


SPLIT_SQL = """SELECT p_partkey, replace(p_name, ' ', chr(10))
  || CASE WHEN p_size % 3 = 0 THEN chr(10) || p_brand ELSE '' END AS name_cell FROM part"""


@query("split_lines", f"""SELECT p_partkey, string_split(name_cell, chr(10))[1] AS name_1,
  string_split(name_cell, chr(10))[2] AS name_2, string_split(name_cell, chr(10))[3] AS name_3
FROM ({SPLIT_SQL})""")
def split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-61: multi-line cell -> name_1..name_m."""
    register_views(spark, sf_dir, ["part"])
    return split_cell(spark.sql(SPLIT_SQL), "name_cell", prefix="name_")


PARSE_SQL = f"""SELECT o_orderkey,
  CASE o_orderkey % 6
    WHEN 0 THEN {_date_text('o_orderdate')}
    WHEN 1 THEN {_date_text('o_orderdate')} || ' 23:59:58'
    WHEN 2 THEN '31.02.' || CAST(year(o_orderdate) AS STRING)
    WHEN 3 THEN 'нет даты'
    WHEN 4 THEN CAST(year(o_orderdate) AS STRING) || '-01-01'
    ELSE NULL END AS date_text,
  CASE WHEN o_orderkey % 5 = 0 THEN 'н/д' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) END AS amount_text
FROM orders"""


@query("journal_parse", f"""SELECT o_orderkey, date_text, amount_text,
  coalesce(try_strptime(date_text, '%d.%m.%Y %H:%M:%S'), try_strptime(date_text, '%d.%m.%Y')) AS ts,
  try_strptime(date_text, '%d.%m.%Y') AS day_only,
  coalesce(TRY_CAST(amount_text AS DECIMAL(18,4)), CAST(0 AS DECIMAL(18,4))) AS amount
FROM ({PARSE_SQL})""")
def journal_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O-74..O-76: two timestamp formats, date-only, numbers with bad -> 0."""
    register_views(spark, sf_dir, ["orders"])
    d = spark.sql(PARSE_SQL)
    return d.select("o_orderkey", "date_text", "amount_text", parse_timestamp("date_text").alias("ts"),
                    parse_date("date_text").alias("day_only"), parse_number("amount_text").alias("amount"))


# ------------------------------------------------------------ whole posting reports and cards
def raw_journal(spark: SparkSession, sf_dir: str, header: list, entry: list[str], quantity: list[str], text: list[str]) -> DataFrame:
    """raw_rows of the journal: a title row, the header row, then one row per journal row."""
    j = stage(ordinal(_journal(spark, sf_dir), "row_no", JOURNAL_ORDER).drop("ok", "ln", "pk", "sk", "px"), "journal-numbered")

    def cells(exprs):
        return F.array(*[F.expr(e).cast("string") for e in exprs])

    data = j.select("file_name", (F.col("row_no") + 2).alias("row_no"), F.lit(0).alias("level"), F.lit(False).alias("italic"),
                    F.when(F.col("kind") == 0, cells(entry)).when(F.col("text") == QUANTITY, cells(quantity))
                    .otherwise(cells(text)).alias("cells"))
    files = j.select("file_name").distinct()
    for n, row in ((1, ["Отчет"]), (2, header)):
        data = data.unionByName(files.select(
            "file_name", F.lit(n).cast("long").alias("row_no"), F.lit(0).alias("level"), F.lit(False).alias("italic"),
            F.array(*[F.lit(c).cast("string") for c in row]).alias("cells")))
    return data


def _texts_sql(cols: list[str], where: str) -> str:
    """DuckDB: per (file, entry, date) the lines of each text column, each value at its first place."""
    lists = [f"list(coalesce({c}, '') ORDER BY ok, kind, ln, pk, sk, px)" for c in cols]
    each = ", ".join(
        f"array_to_string(list_transform(u[n * {i} + 2:n * {i + 1} + 1], lambda x: coalesce(nullif(x, ''), '')), '|') AS t{i}"
        for i in range(len(cols)))
    return f"""SELECT file_name, date, entry_id, {each} FROM (
  SELECT file_name, date, entry_id, n, list_transform(a, lambda x, i: CASE WHEN list_position(a, x) = i THEN x END) AS u FROM (
    SELECT file_name, date, entry_id, count(*) AS n, list_concat([entry_id], {', '.join(lists) if len(lists) == 1 else
    _nested(lists)}) AS a FROM f WHERE {where} GROUP BY file_name, date, entry_id))"""


def _nested(lists: list[str]) -> str:
    return lists[0] if len(lists) == 1 else f"list_concat({lists[0]}, {_nested(lists[1:])})"


POSTING_HEADER = ["Дата", "Документ", "Содержание", "Дт", None, "Кт", None, "Сумма", "Субконто Дт", "Субконто Кт"]


@query("posting_report", f"""WITH f AS MATERIALIZED ({SQL_FILLED}),
t AS ({_texts_sql(["text", "sub_dt", "sub_kt"], "true")}),
e AS (SELECT * FROM f WHERE coalesce(text, '') <> 'Количество'
      QUALIFY row_number() OVER (PARTITION BY file_name, entry_id, debit, credit ORDER BY ok, kind, ln, pk, sk, px) = 1),
q AS (SELECT file_name, entry_id, amount + 1.5 AS dt, CAST(0 AS DECIMAL(18,4)) AS kt FROM f WHERE text = 'Количество')
SELECT e.file_name AS "Имя_файла", t.date AS "Дата", regexp_replace(e.entry_id, '_end[0-9]+$', '') AS "Документ",
  e.debit AS "Дт", e.credit AS "Кт", CAST(e.amount AS VARCHAR) AS "Сумма", t.t0 AS "Содержание", t.t1 AS "Субконто Дт",
  t.t2 AS "Субконто Кт", q.dt AS "Дт_количество", q.kt AS "Кт_количество"
FROM e LEFT JOIN t ON e.file_name = t.file_name AND e.entry_id = t.entry_id
LEFT JOIN q ON e.file_name = q.file_name AND e.entry_id = q.entry_id
WHERE e.debit IS NOT NULL OR e.credit IS NOT NULL""")
def posting_report_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-1 from raw cells: entries with their text lines and quantity rows."""
    raw = raw_journal(spark, sf_dir, POSTING_HEADER,
                      ["date_text", "document", "text", "debit", "NULL", "credit", "NULL", "amount", "sub_dt", "sub_kt"],
                      ["NULL", "NULL", "text", "amount", "'1.5'"], ["NULL", "NULL", "text"])
    flat, _ = posting_report(raw)
    return flat.select("Имя_файла", "Дата", "Документ", "Дт", "Кт", "Сумма",
                       *[F.array_join(c, "|", "").alias(c) for c in ("Содержание", "Субконто Дт", "Субконто Кт")],
                       "Дт_количество", "Кт_количество")


CARD_HEADER = ["Дата", "Документ", "Операция", "Дебет", None, "Кредит", None, None, "Текущее сальдо", None]


@query("account_card", f"""WITH f AS MATERIALIZED ({SQL_FILLED}),
p AS (SELECT * FROM f WHERE coalesce(text, '') <> 'Количество'),
t AS ({_texts_sql(["text"], "coalesce(text, '') <> 'Количество'")}),
e AS (SELECT * FROM p
      QUALIFY row_number() OVER (PARTITION BY file_name, entry_id, debit, credit ORDER BY ok, kind, ln, pk, sk, px) = 1),
q AS (SELECT file_name, entry_id, amount AS dt, amount + 2.25 AS kt FROM f WHERE text = 'Количество')
SELECT e.file_name AS "Имя_файла", t.date AS "Дата", regexp_replace(e.entry_id, '_end[0-9]+$', '') AS "Документ",
  e.debit AS "Дебет", e.credit AS "Кредит", CAST(e.amount AS VARCHAR) AS "Дебет_значение", t.t0 AS "Операция",
  q.dt AS "Дт_количество", q.kt AS "Кт_количество"
FROM e LEFT JOIN t ON e.file_name = t.file_name AND e.entry_id = t.entry_id
LEFT JOIN q ON e.file_name = q.file_name AND e.entry_id = q.entry_id
WHERE e.debit IS NOT NULL OR e.credit IS NOT NULL""")
def account_card_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P-3 from raw cells: entries with their operations and quantity rows (sums between the titles)."""
    raw = raw_journal(spark, sf_dir, CARD_HEADER,
                      ["date_text", "document", "text", "debit", "amount", "credit", "NULL", "NULL", "'Д'", "amount"],
                      ["NULL", "NULL", "'Кол-во'", "NULL", "amount", "NULL", "amount", "'2.25'"], ["NULL", "NULL", "text"])
    flat, _ = account_card(raw)
    return flat.select("Имя_файла", "Дата", "Документ", "Дебет", "Кредит", "Дебет_значение",
                       F.array_join("Операция", "|", "").alias("Операция"), "Дт_количество", "Кт_количество")
