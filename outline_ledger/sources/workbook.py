"""S-1 / S-2 / S-4: spreadsheet registers -> ``raw_rows`` as a Spark job.

``binaryFile`` lists the folder (``*.xlsx``, non-recursive); ``mapInPandas``
parses each workbook inside its task with the standard library only
(``zipfile`` + ``xml.etree.iterparse``) and yields rows in bounded batches.
Parallelism is per file: Spark packs files into tasks by size.  Each row
carries its sheet row number (order), outline level and the italic flag of the
contra-account column (found by title in the first 30 rows).
"""

from __future__ import annotations

import io
import re
import zipfile
from datetime import datetime, timedelta
from decimal import Decimal
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..constants import OUTLINE_HEADER_SCAN_ROWS, REGISTER_RULES

RAW_SCHEMA = "file_name string, row_no long, level int, italic boolean, cells array<string>"
NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RNS = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# --- fixed values: titles of the contra-account column that carries italics -----
ITALIC_TITLES = ("Кор. Счет", "Кор.счет")
# built-in number formats of dates and times
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
BATCH_ROWS = 50_000


def _member(z: zipfile.ZipFile, name: str) -> str | None:
    """Archive member by case-insensitive name (some exports write
    xl/SharedStrings.xml)."""
    low = name.lower()
    for n in z.namelist():
        if n.lower() == low:
            return n
    return None


def _shared_strings(z):
    m = _member(z, "xl/sharedStrings.xml")
    if not m:
        return []
    out = []
    for _, el in ET.iterparse(z.open(m)):
        if el.tag == NS + "si":
            out.append("".join(t.text or "" for t in el.iter(NS + "t")))
            el.clear()
    return out


def _styles(z):
    """xf index -> (italic, number format code, number is a date)."""
    m = _member(z, "xl/styles.xml")
    if not m:
        return {}
    root = ET.parse(z.open(m)).getroot()
    fmts = {int(f.get("numFmtId")): f.get("formatCode") for f in root.iter(NS + "numFmt")}
    fonts = [f.find(NS + "i") is not None for f in root.find(NS + "fonts") or []]
    xfs = root.find(NS + "cellXfs")
    out = {}
    for i, xf in enumerate(xfs if xfs is not None else []):
        fid = int(xf.get("fontId", 0))
        number = int(xf.get("numFmtId", 0))
        out[i] = (fonts[fid] if fid < len(fonts) else False, fmts.get(number, ""), _is_date(number, fmts.get(number, "")))
    return out


def _active_sheet(z) -> str:
    wb = ET.parse(z.open(_member(z, "xl/workbook.xml"))).getroot()
    view = wb.find(f"{NS}bookViews/{NS}workbookView")
    active = int(view.get("activeTab", 0)) if view is not None else 0
    sheets = wb.find(NS + "sheets")
    rid = list(sheets)[active].get(RNS + "id")
    rels = ET.parse(z.open(_member(z, "xl/_rels/workbook.xml.rels"))).getroot()
    for r in rels:
        if r.get("Id") == rid:
            target = r.get("Target").lstrip("/")
            return target if target.startswith("xl/") else "xl/" + target
    return "xl/worksheets/sheet1.xml"


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + ord(ch) - 64
    return n - 1


def _displayed(v: str, fmt: str) -> str:
    """A header number as it is shown: decimals from a '0.00'-style format (keeps 60.10)."""
    m = re.search(r"0\.(0+)", fmt or "")
    return f"{float(v):.{len(m.group(1))}f}" if m else _stored(v)


def _stored(v: str) -> str:
    """A data number with all its digits, integers without '.0'."""
    x = Decimal(v)
    return str(int(x)) if x == x.to_integral_value() else format(x.normalize(), "f")


def _is_date(fmt_id: int, fmt: str) -> bool:
    """Built-in date formats, or a format with date letters outside quotes and brackets."""
    plain = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", fmt or "").lower()
    return fmt_id in DATE_FORMATS or bool(re.search(r"[ymdh]", plain.replace("general", "")))


def _date_text(v: str, epoch_1904: bool) -> str:
    """A serial day as 'dd.MM.yyyy HH:mm:ss', the text form that journals use."""
    start = datetime(1904, 1, 1) if epoch_1904 else datetime(1899, 12, 30)
    return (start + timedelta(seconds=round(float(v) * 86400))).strftime("%d.%m.%Y %H:%M:%S")


def _is_header(cells: list) -> bool:
    """Whether a row holds all titles of some register's header."""
    found = {c.strip().lower() for c in cells if c}
    return any(found.issuperset(titles) for _, _, titles in REGISTER_RULES)


def parse_workbook(data: bytes, file_name: str, skip_first: bool = True, scan_rows: int = OUTLINE_HEADER_SCAN_ROWS):
    """Yield (file_name, row_no, level, italic, cells) for one workbook.

    Data cells keep the stored value, dates become text; only numbers in the
    header row (account codes such as 60.10) are taken as they are shown.
    ``scan_rows``: rows searched for the title of the italic column.
    """
    z = zipfile.ZipFile(io.BytesIO(data))
    strings, styles = _shared_strings(z), _styles(z)
    book = ET.parse(z.open(_member(z, "xl/workbook.xml"))).getroot().find(NS + "workbookPr")
    epoch_1904 = book is not None and book.get("date1904") in ("1", "true")
    sheet = _member(z, _active_sheet(z))
    rows = []
    for _, el in ET.iterparse(z.open(sheet)):
        if el.tag != NS + "row":
            continue
        r = int(el.get("r"))
        level = int(el.get("outlineLevel", 0))
        cells, ital, shown = {}, {}, {}
        for c in el.iter(NS + "c"):
            idx = _col_index(c.get("r"))
            t, s = c.get("t"), int(c.get("s", 0))
            italic, fmt, is_date = styles.get(s, (False, "", False))
            v = c.find(NS + "v")
            if t == "s" and v is not None:
                text = strings[int(v.text)]
            elif t == "inlineStr":
                text = "".join(x.text or "" for x in c.iter(NS + "t"))
            elif t == "b" and v is not None:
                text = "True" if v.text == "1" else "False"
            elif v is not None and v.text is not None:
                text = v.text if t in ("str", "e", "d") else _date_text(v.text, epoch_1904) if is_date else _stored(v.text)
                if t not in ("str", "e", "d") and not is_date:
                    shown[idx] = _displayed(v.text, fmt)
            else:
                text = None
            cells[idx] = text
            ital[idx] = italic
        el.clear()
        width = max(cells) + 1 if cells else 0
        row = [cells.get(i) for i in range(width)]
        if shown and _is_header(row):
            row = [shown.get(i, x) for i, x in enumerate(row)]
        rows.append((r, level, row, ital))
    kor = None
    for r, _, cells, _ in rows:
        if r > scan_rows:
            break
        for i, c in enumerate(cells):
            if c in ITALIC_TITLES:
                kor = i
                break
        if kor is not None:
            break
    for r, level, cells, ital in rows:
        if skip_first and r == 1:
            continue
        italic = bool(ital.get(kor, False)) if kor is not None and r >= 2 else False
        yield file_name, r, level, italic, cells


def _rows_or_reason(data: bytes, name: str, skip_first: bool):
    try:
        yield from parse_workbook(data, name, skip_first)
    except (zipfile.BadZipFile, ET.ParseError, KeyError, ValueError, TypeError, AttributeError, IndexError) as e:
        yield name, 0, 0, False, [f"{type(e).__name__}: {e}"]


def unreadable(raw: DataFrame) -> DataFrame:
    """S-9: (file_name, reason) of the files that could not be read."""
    return raw.where("row_no = 0").selectExpr("file_name", "concat('unreadable workbook: ', cells[0]) AS reason")


def _parse_batches(skip_first: bool):
    def run(it):
        for pdf in it:
            for path, content in zip(pdf["path"], pdf["content"]):
                name = path.rsplit("/", 1)[-1]
                buf = []
                for row in _rows_or_reason(bytes(content), name, skip_first):
                    buf.append(row)
                    if len(buf) >= BATCH_ROWS:
                        yield pd.DataFrame(buf, columns=["file_name", "row_no", "level", "italic", "cells"])
                        buf = []
                if buf:
                    yield pd.DataFrame(buf, columns=["file_name", "row_no", "level", "italic", "cells"])
    return run


def read_workbooks(spark: SparkSession, folder: str, *, skip_first: bool = True,
                   glob: str = "*.xlsx") -> DataFrame:
    """All workbooks of a folder -> raw_rows.  A folder without any is an error; a file that is
    no readable workbook gives one row of row_no 0 whose cell says why, see ``unreadable``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob) \
        .option("recursiveFileLookup", "false").load(folder).select("path", "content")
    if not files.inputFiles():
        raise FileNotFoundError(f"no workbook in {folder}")
    return files.mapInPandas(_parse_batches(skip_first), RAW_SCHEMA)
