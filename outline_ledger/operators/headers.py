"""Header resolution and schema projection over ``raw_rows``.

``raw_rows(file_name, row_no, level, italic, cells ARRAY<STRING>)`` is the
normalised form of every register (see ``sources``).  This module:

* O-1 classifies each file's dialect from its first rows (rule table joined on
  the requested kind, broadcast: it has 12 rows);
* O-2 finds the header row by keyword; O-3/O-4 name the columns from it;
* O-9 turns file-level failures into quarantine rows;
* O-10 orders output columns; O-65 unions registers by name.

Header rows are a handful per file: they are gathered with small aggregates
and joined back by ``file_name``; data rows are never collected.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import HEADER_PROBE_ROWS, REGISTER_RULES

# --- fixed values: families of numbered output columns -------------------------
COLUMN_PREFIXES = ("Операция_", "Содержание_", "Документ_", "Аналитика Дт_", "Субконто Дт_",
                   "Аналитика Кт_", "Субконто Кт_", "Level_")
MEASURE_PREFIXES = ("Количество_", "ВалютнаяСумма_")


def normalized_cells(cells: Column) -> Column:
    """cell -> lower(trim(cell)), null -> ''."""
    return F.transform(cells, lambda c: F.coalesce(F.lower(F.trim(c)), F.lit("")))


def classify_files(raw: DataFrame, *, file_col: str = "file_name", kind_col: str = "kind",
                   row_col: str = "row_no", cells_col: str = "cells",
                   probe_rows: int = HEADER_PROBE_ROWS, out: str = "dialect") -> DataFrame:
    """O-1: per file, the first rule (in rule order) of the requested register
    kind whose keyword set is contained in the cells of one of the first
    ``probe_rows`` rows; null when none matches (the file is rejected)."""
    spark = raw.sparkSession
    rules = spark.createDataFrame(
        [(k, d, i, p) for i, (k, d, p) in enumerate(REGISTER_RULES)],
        "r_kind string, r_dialect string, r_priority int, r_pattern array<string>")
    probe = raw.where(F.col(row_col) <= probe_rows) \
        .select(file_col, kind_col, normalized_cells(F.col(cells_col)).alias("__cells"))
    hits = probe.join(F.broadcast(rules), on=F.col(kind_col) == F.col("r_kind")) \
        .where(F.size(F.array_except(F.col("r_pattern"), F.col("__cells"))) == 0) \
        .groupBy(file_col).agg(F.min_by("r_dialect", "r_priority").alias(out))
    files = raw.select(file_col, kind_col).distinct()
    return files.join(hits, on=file_col, how="left")


def union_registers(frames: list[DataFrame]) -> DataFrame:
    """O-65: UNION ALL by column name, missing columns null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


# the groups of output columns, in output order
_GROUPS = ("fixed", "family", "contra", "other")
_FAMILY = re.compile("(" + "|".join(map(re.escape, COLUMN_PREFIXES)) + r")(\d*)")
_CONTRA = re.compile(rf"({'|'.join(map(re.escape, MEASURE_PREFIXES))}|)(\d+(?:\.\d+)?)?\.?([^_]*)(_до|_ко)")


@dataclass(frozen=True, order=True)
class ColumnPlace:
    """Where a column goes: its group, then what orders columns within the group."""

    group: int
    major: int = 0
    number: float = 0
    text: str = ""
    minor: int = 0

    @classmethod
    def of(cls, name: str, position: int, desired: list[str]) -> ColumnPlace:
        if m := _FAMILY.fullmatch(name):
            return cls(_GROUPS.index("family"), COLUMN_PREFIXES.index(m[1]), float(m[2] or "inf"), name)
        if name in desired:
            return cls(_GROUPS.index("fixed"), desired.index(name))
        if m := _CONTRA.fullmatch(name):
            measure = (*("",), *MEASURE_PREFIXES).index(m[1])
            return cls(_GROUPS.index("contra"), measure, float(m[2] or "inf"), m[3], m[4] == "_ко")
        return cls(_GROUPS.index("other"), position)


def column_order(cols: list[str], desired: list[str]) -> list[str]:
    """O-10: the fixed names that are present, the numbered families by number (a
    member without a number last), contra-account columns by measure, account
    number, account letters and side (debit first), then the rest as they came."""
    places = {c: ColumnPlace.of(c, i, desired) for i, c in enumerate(cols)}
    return sorted(cols, key=places.__getitem__)


def order_columns(df: DataFrame, desired: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in column_order(df.columns, desired)])


def drop_empty_columns(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """O-12: drop columns that are null in every row (one aggregate job)."""
    cols = cols or df.columns
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    empty = [c for i, c in enumerate(cols) if counts[f"c{i}"] == 0]
    return df.drop(*empty) if empty else df


# ------------------------------------------------------------- header location
def header_rows(raw: DataFrame, match: Column, *, file_col: str = "file_name", row_col: str = "row_no",
                scan_rows: int | None = None) -> DataFrame:
    """O-2: the first row of each file satisfying ``match`` (a predicate over
    the row); returns (file, header_row_no, header cells)."""
    d = raw if scan_rows is None else raw.where(F.col(row_col) <= scan_rows)
    return d.where(F.coalesce(match, F.lit(False))).groupBy(file_col).agg(
        F.min_by(F.struct(F.col(row_col).alias("header_row"), F.col("cells").alias("header")),
                 F.col(row_col)).alias("__h")).select(file_col, "__h.header_row", "__h.header")


def name_unnamed(header: Column, *, style: str = "value") -> Column:
    """O-4: unnamed header cells take a name from the nearest named cell to the
    left: ``<left>_значение`` (style 'value') or ``NoNameCol <i>`` ('index');
    a leading unnamed cell becomes ``NoNameCol0`` / ``NoNameCol 1``."""
    trimmed = F.transform(header, lambda c: F.nullif(F.trim(c), F.lit("")))
    if style == "index":
        return F.transform(trimmed, lambda c, i: F.coalesce(c, F.concat(F.lit("NoNameCol "), (i + 1).cast("string"))))
    # nearest named cell to the left (chained unnamed cells take the original name)
    def left_name(i):
        before = F.filter(F.slice(trimmed, 1, F.greatest(i, F.lit(1))), lambda x: x.isNotNull())
        return F.try_element_at(before, F.lit(-1))
    return F.transform(trimmed, lambda c, i: F.coalesce(
        c, F.concat(F.coalesce(left_name(i), F.lit("NoNameCol0")), F.lit("_значение"))))


def project(raw: DataFrame, headers: DataFrame, names: list[str], *, file_col: str = "file_name",
            row_col: str = "row_no", keep: list[str] = ("level", "italic")) -> DataFrame:
    """O-3: data rows below each file's header, cells projected to the named
    columns (``names`` is the known set; cells under other names are dropped).
    Positions come from the file's own header, so files with different
    layouts share one plan."""
    d = raw.join(headers, on=file_col).where(F.col(row_col) > F.col("header_row"))
    cols = {}
    for n in names:
        pos = F.array_position(F.col("header_names"), F.lit(n))
        cols[n] = F.when(pos > 0, F.try_element_at(F.col("cells"), pos.cast("int")))
    keep = [k for k in keep if k in raw.columns]
    return d.select(file_col, row_col, *keep, *[c.alias(n) for n, c in cols.items()])
