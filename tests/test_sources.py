"""Workbook scan (S-1) on hand-built archives, sinks and chunk numbers."""

import os
import tempfile
import zipfile

import pytest

from outline_ledger.sources import workbook as W
from outline_ledger.sources.sinks import chunk_numbers, write_register
from outline_ledger.sources.workbook import read_workbooks

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _xlsx(path, rows, shared_name="xl/SharedStrings.xml"):
    """rows: list of (row_no, outline_level, [(text_or_number, italic, numfmt)])."""
    strings, sheet_rows = [], []
    for r, lvl, cells in rows:
        cs = []
        for j, (v, ital, fmt) in enumerate(cells):
            ref = chr(65 + j) + str(r)
            style = (3 if fmt else 1) if ital else (2 if fmt else 0)
            if isinstance(v, str):
                strings.append(v)
                cs.append(f'<c r="{ref}" t="s" s="{style}"><v>{len(strings) - 1}</v></c>')
            elif v is not None:
                cs.append(f'<c r="{ref}" s="{style}"><v>{v}</v></c>')
        attr = f' outlineLevel="{lvl}"' if lvl else ""
        sheet_rows.append(f'<row r="{r}"{attr}>{"".join(cs)}</row>')
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("[Content_Types].xml", "<Types/>")
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><bookViews>'
                   '<workbookView activeTab="0"/></bookViews><sheets>'
                   '<sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/'
                   'package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/>'
                   '</Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}"><numFmts><numFmt numFmtId="164" '
                   'formatCode="0.00"/></numFmts><fonts><font/><font><i/></font></fonts><cellXfs>'
                   '<xf fontId="0" numFmtId="0"/><xf fontId="1" numFmtId="0"/><xf fontId="0" numFmtId="164"/>'
                   '<xf fontId="1" numFmtId="164"/>'
                   '</cellXfs></styleSheet>')
        z.writestr(shared_name, f'<sst xmlns="{MAIN}">' + "".join(f"<si><t>{s}</t></si>" for s in strings)
                   + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{"".join(sheet_rows)}'
                   "</sheetData></worksheet>")


def test_read_workbooks(spark):
    d = tempfile.mkdtemp(prefix="wb-")
    _xlsx(os.path.join(d, "a.xlsx"), [
        (1, 0, [("Анализ счета", False, None)]),
        (2, 0, [("Счет", False, None), ("Кор.счет", False, None), ("С кред. счетов", False, None)]),
        (3, 0, [("60", False, None), (None, False, None), (100, False, None)]),
        (4, 1, [("60.01", False, None), (60.1, True, "0.00"), (100.5, False, None)]),
    ])
    _xlsx(os.path.join(d, "b.xlsx"), [(1, 0, [("t", False, None)]), (2, 2, [("x", False, None), (7, False, None)])],
          shared_name="xl/sharedStrings.xml")
    open(os.path.join(d, "notes.txt"), "w").write("skip me")
    rows = sorted(read_workbooks(spark, d).collect(), key=lambda r: (r.file_name, r.row_no))
    got = [(r.file_name, r.row_no, r.level, r.italic, r.cells) for r in rows]
    assert got == [
        ("a.xlsx", 2, 0, False, ["Счет", "Кор.счет", "С кред. счетов"]),
        ("a.xlsx", 3, 0, False, ["60", None, "100"]),
        ("a.xlsx", 4, 1, True, ["60.01", "60.1", "100.5"]),
        ("b.xlsx", 2, 2, False, ["x", "7"]),
    ]


def test_sinks_and_chunks(spark):
    df = spark.range(0, 25).selectExpr("id", "concat('f', id % 2) AS file_name")
    out = tempfile.mkdtemp(prefix="sink-")
    write_register(df, out + "/t", max_rows=5)
    back = spark.read.parquet(out + "/t")
    assert back.count() == 25 and set(back.columns) == {"id", "file_name"}
    ch = chunk_numbers(df, ["id"], size=10).collect()
    assert {r.id: r.chunk for r in ch} == {i: i // 10 + 1 for i in range(25)}


def test_data_keeps_digits_and_dates(spark):
    d = tempfile.mkdtemp(prefix="wb-")
    head = ["Субконто", "Нач. сальдо деб.", "Нач. сальдо кред.", "Деб. оборот"]
    _xlsx(os.path.join(d, "a.xlsx"), [
        (2, 0, [(h, False, None) for h in head] + [(60.1, False, "0.00")]
         + [(h, False, None) for h in ("Кред. оборот", "Кон. сальдо деб.", "Кон. сальдо кред.")]),
        (3, 1, [("x", False, None), (10.005, False, "0.00"), (1.2345, False, "0.00"), (1e-05, False, None)]),
    ])
    rows = {r.row_no: r.cells for r in read_workbooks(spark, d).collect()}
    assert rows[2][4] == "60.10" and rows[3] == ["x", "10.005", "1.2345", "0.00001"]
    assert W._date_text("45292.5", False) == "01.01.2024 12:00:00"
    assert W._is_date(14, "") and W._is_date(170, "dd\\.mm\\.yyyy") and not W._is_date(2, "0.00") and not W._is_date(171, '0.00" dm"')


def test_bad_and_missing_workbooks(spark):
    d = tempfile.mkdtemp(prefix="wb-")
    with pytest.raises(FileNotFoundError):
        read_workbooks(spark, d)
    _xlsx(os.path.join(d, "good.xlsx"), [(2, 0, [("x", False, None)])])
    open(os.path.join(d, "bad.xlsx"), "wb").write(b"no archive")
    raw = read_workbooks(spark, d)
    assert [r.file_name for r in W.unreadable(raw).collect()] == ["bad.xlsx"]
    assert raw.where("row_no > 0").count() == 1
