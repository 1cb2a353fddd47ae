"""Literal fixtures (FIXTURES.md): worked example and quirk cases."""

from decimal import Decimal

from pyspark.sql import functions as F

from outline_ledger.functions.scalars import first_unique, is_account_code, pad_account
from outline_ledger.operators.headers import column_order, name_unnamed
from outline_ledger.operators.ordered import RowOrder
from outline_ledger.operators.outline import align_levels, drop_subtotals, exclude_service_rows, outline_paths
from outline_ledger.operators.accounts import suppression_set


def test_worked_example_account_balance(spark):
    rows = [("f", 1, 0, "60", Decimal("150")), ("f", 2, 1, "60.01", Decimal("100")),
            ("f", 3, 2, "ООО А", Decimal("70")), ("f", 4, 2, "ООО Б", Decimal("30")),
            ("f", 5, 1, "60.02", Decimal("50")), ("f", 6, 0, "Итого", Decimal("150"))]
    df = spark.createDataFrame(rows, "file_name string, row_no long, level int, label string, dt decimal(18,2)")
    o = RowOrder(block_rows=2)
    p = outline_paths(df, o)
    leaves = exclude_service_rows(drop_subtotals(p, o))
    got = sorted((r.row_no, r.Level_0, r.Level_1, r.Level_2) for r in leaves.collect())
    assert got == [(3, "60", "60.01", "ООО А"), (4, "60", "60.01", "ООО Б"), (5, "60", "60.02", None)]
    assert sum(r.dt for r in leaves.collect()) == Decimal("150")


def test_align_extra_leaf_under_account(spark):
    rows = [("f", 1, "60", "60.01", "ООО А"), ("f", 2, "60", "ООО В", None)]
    df = spark.createDataFrame(rows, "file_name string, c long, Level_0 string, Level_1 string, Level_2 string")
    out = align_levels(df, ["Level_0", "Level_1", "Level_2"], ["file_name"])
    got = {r.c: (r.Level_0, r.Level_1, r.Level_2, r.Level_3) for r in out.collect()}
    assert got[2] == ("60", "60", "ООО В", None)
    assert got[1] == ("60", "60.01", "ООО А", None)


def test_account_code_grammar(spark):
    cases = {"7": True, "07": True, "000": True, "12.5": True, "10.": True, "76.ФВ": True, "94.Н": True,
             "01.02.24": True, "123": False, "ФВ": False, "ФВ.Н": False, "Итого": False, None: False}
    df = spark.createDataFrame([(k,) for k in cases], "c string")
    got = {r.c: r.f for r in df.select("c", is_account_code("c").alias("f")).collect()}
    assert got == cases
    pads = {r.c: r.p for r in df.select("c", pad_account("c").alias("p")).collect()}
    assert pads["7"] == "07" and pads["12.5"] == "12.5" and pads[None] is None


def test_suppression_rules(spark):
    pairs = [("f", "a", "60"), ("f", "b", "60.01"), ("f", "c", "94"), ("f", "d", "94.Н"),
             ("f", "e", "55"), ("f", "g", "55.1"), ("f", "h", "76.55"), ("f", "i", "07"), ("f", "j", "07"),
             ("f", "k", "57")]
    df = spark.createDataFrame(pairs, "file_name string, raw string, acct string")
    got = {r.acct for r in suppression_set(df, ["file_name"], "raw", "acct").collect()}
    assert got == {"60", "94", "55.1", "76.55", "07", "7"}


def test_first_unique_and_names(spark):
    df = spark.createDataFrame([(["a", "b", "a", None, "b", "c"],)], "x array<string>")
    assert df.select(first_unique("x").alias("y")).first().y == ["a", "b", None, None, None, "c"]
    h = spark.createDataFrame([(["Дата", None, "Дебет", "", "", "Кредит"],)], "h array<string>")
    assert h.select(name_unnamed(F.col("h")).alias("n")).first().n == \
        ["Дата", "Дата_значение", "Дебет", "Дебет_значение", "Дебет_значение", "Кредит"]


def test_column_order():
    cols = ["x", "Level_1", "60_ко", "Количество_60_до", "Level_0", "Исх.файл", "60_до", "76.ФВ_до", "8.1_до"]
    assert column_order(cols, ["Исх.файл", "Субконто"]) == \
        ["Исх.файл", "Level_0", "Level_1", "8.1_до", "60_до", "60_ко", "76.ФВ_до", "Количество_60_до", "x"]
