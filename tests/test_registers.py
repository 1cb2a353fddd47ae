"""Register pipelines on literal raw rows: rejects, digits, header by title, column order."""

from decimal import Decimal

from pyspark.sql import functions as F

from outline_ledger.constants import MEASURES, TURNOVER_UPP_RENAME
from outline_ledger.operators.headers import column_order
from outline_ledger.plans.registers import combine, general_balance, turnover_register

SCHEMA = "file_name string, row_no long, level int, italic boolean, cells array<string>"
HEAD = ["Субконто", *TURNOVER_UPP_RENAME]


def _rows(name, rows):
    return [(name, i + 1, level, False, cells) for i, (level, cells) in enumerate(rows)]


def test_turnover_rejects_are_in_quarantine_only(spark):
    body = [(0, ["60", "1", "", "2", "", "3", ""]), (1, ["a", "1", "", "2.00", "", "3", ""]),
            (1, [None, "0.1234", "", "5", "", "", ""])]
    total = (0, ["Итого", "1", "", "2", "", "3", ""])
    rows = (_rows("good", [(0, HEAD), *body, total]) + _rows("no_total", [(0, HEAD), *body])
            + _rows("no_header", [(0, ["x"]), *body, total]) + _rows("flat", [(0, HEAD), (0, body[0][1]), total])
            + _rows("late", [(0, ["x"])] * 40 + [(0, HEAD), *body, total]))
    flat, check, quarantine, contra = turnover_register(spark.createDataFrame(rows, SCHEMA))
    assert {r["file_name"]: r["reason"] for r in quarantine.collect()} == {
        "no_total": "no total row", "no_header": "header row not found", "flat": "outline is empty",
        "late": "header row not found"}
    got = flat.collect()
    assert {r["Исх.файл"] for r in got} == {"good"} == {r["Исх.файл"] for r in check.collect()}
    assert contra.count() == 0
    assert [r["Количество_Дебет_начало"] for r in got] == [Decimal("0.1234")]


def test_contra_cells_of_leaves_only(spark):
    head = HEAD[:4] + ["60"] + HEAD[4:5] + ["62"] + HEAD[5:]
    row = ["1", "", "2", "7", "3", "8", "", ""]
    rows = _rows("f", [(0, head), (0, ["51", *row]), (1, ["leaf", *row]), (0, ["Итого", *row])])
    _, check, _, contra = turnover_register(spark.createDataFrame(rows, SCHEMA))
    assert sorted((r["row_no"], r["contra_account"], r["side"], int(r["value"])) for r in contra.collect()) == [
        (3, "60", "_до", 7), (3, "62", "_ко", 8)]


def test_general_balance(spark):
    top = ["Счет", None, None, "Сальдо на начало периода", None, "Оборот за период", None, "Сальдо на конец периода", None]
    sub = [None, None, "Наименование", "Дебет", "Кредит"]
    data = [["1", "77", "Cash", "1.00", "", "2", "3", "", "4"], ["2", "", "", "1", "", "", "", "", ""]]
    rows = (_rows("good", [(0, ["t"]), (0, top), (0, sub), *[(0, d) for d in data]])
            + _rows("no_header", [(0, ["x"])]) + _rows("no_name", [(0, top), (0, ["Дебет"]), (0, data[0])]))
    flat, quarantine = general_balance(spark.createDataFrame(rows, SCHEMA))
    got = flat.collect()
    assert [(r["Исх.файл"], r["Счет"], r["Наименование"]) for r in got] == [("good", "01", "Cash")]
    assert [got[0][m] for m in MEASURES] == [1, None, 2, 3, None, 4]
    assert {r["file_name"]: r["reason"] for r in quarantine.collect()} == {
        "no_header": "header row not found", "no_name": "required column not found"}


def test_column_order():
    cols = ["z", "76.ФВ_ко", "Level_10", "Level_2", "60_ко", "60_до", "Количество_60_до", "Субконто", "60.01_до", "76_до", "a",
            "Операция_1", "Level_", "ВалютнаяСумма_60_до", "Исх.файл", "x_до"]
    assert column_order(cols, ["Исх.файл", "Субконто", "absent"]) == [
        "Исх.файл", "Субконто", "Операция_1", "Level_2", "Level_10", "Level_", "60_до", "60_ко", "60.01_до", "76_до",
        "76.ФВ_ко", "x_до", "Количество_60_до", "ВалютнаяСумма_60_до", "z", "a"]


def test_combine(spark):
    a = spark.createDataFrame([("f", "60", None, 1)], "`Исх.файл` string, Level_0 string, Level_1 string, z int")
    b = spark.createDataFrame([("g", "60", 2)], "`Исх.файл` string, Level_0 string, `60_до` int")
    got = combine([a, b], ["Исх.файл"])
    assert got.columns == ["Исх.файл", "Level_0", "Level_1", "60_до", "z"] and got.count() == 2


def test_rows_are_projected_once_and_not_read_for_absent_contra_columns(spark, monkeypatch):
    from outline_ledger.plans import registers
    staged, stage = [], registers.stage
    monkeypatch.setattr(registers, "stage", lambda df, name: staged.append(name) or stage(df, name))
    titles = ["Субконто", *registers.TURNOVER_UPP_RENAME]
    rows = [("f", 1, 0, False, titles), ("f", 2, 0, False, ["60", *"123456"]), ("f", 3, 1, False, ["x", *"123456"]), ("f", 4, 0, False, ["Итого", *"123456"])]
    raw = spark.createDataFrame(rows, SCHEMA)
    flat, check, bad, contra = turnover_register(raw)
    assert staged[:3] == ["headers", "projected", "depths"] and staged.count("projected") == 1
    plan = registers.contra_long_raw(raw.withColumn("header_names", F.array(*[F.lit(t) for t in ("Субконто", *registers.MEASURES)])))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation <empty>" in text and "LogicalRDD" not in text
    assert [r["Субконто"] for r in flat.collect()] == ["x"] and contra.count() == 0 and bad.count() == 0
