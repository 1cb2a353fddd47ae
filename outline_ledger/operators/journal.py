"""Journal (posting report / account card) operators.

O-45 occurrence-numbered entry ids, O-46 forward fill of date and entry,
O-21 dated rows, O-47 line number within entry, O-37 text-line pivot,
O-64 first-unique per row, O-38 distinct-first, O-26/O-27 entry joins,
O-28 ordinal attach with a count guard, O-61 multi-line cell split,
O-25 special-row side streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import ENTRY_SUFFIX
from ..functions.scalars import first_unique
from .ordered import RowOrder, ffill, first_in_order, ordinal


def entry_ids(df: DataFrame, order: RowOrder, *, document: str, out: str) -> DataFrame:
    """O-45: ``document + '_end' + n`` where n counts earlier rows of the file
    with the same document text (1-based); null documents stay null."""
    d = ordinal(df, "__occ", order, keys=[document], where=F.col(document).isNotNull())
    return d.withColumn(out, F.when(F.col(document).isNotNull(),
                                    F.concat(F.col(document), F.lit(ENTRY_SUFFIX), F.col("__occ").cast("string"))))\
        .drop("__occ")


def fill_entries(df: DataFrame, order: RowOrder, cols: list[str]) -> DataFrame:
    """O-46: forward fill (date, entry id) over the file, after ids are made."""
    return ffill(df, {c: F.col(c) for c in cols}, order)


def line_numbers(df: DataFrame, order: RowOrder, keys: list[str], out: str = "line_no") -> DataFrame:
    """O-47: 1-based line number within (keys) in file order."""
    return ordinal(df, out, order, keys=keys)


def pivot_lines(df: DataFrame, keys: list[str], n: str, value: str, *, prefix: str,
                width: int | None = None, fill: str | None = None) -> DataFrame:
    """O-37: one column per line number, first non-null value.  The width is
    the largest line number (one small aggregate job) unless given; the pivot
    uses that explicit value list."""
    if width is None:
        width = int(df.agg(F.max(n)).first()[0] or 0)
    p = df.groupBy(*keys).pivot(n, list(range(1, width + 1))).agg(F.first(value, ignorenulls=True))
    p = p.withColumnsRenamed({str(i): f"{prefix}{i}" for i in range(1, width + 1)})
    if fill is not None:
        p = p.fillna(fill, subset=[f"{prefix}{i}" for i in range(1, width + 1)])
    return p


def first_unique_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """O-64: along the listed columns of a row, repeats of an earlier value
    become null (values compared as text)."""
    arr = F.array(*[F.col(c).cast("string") for c in cols])
    d = df.withColumn("__fu", first_unique(arr))
    return d.withColumns({c: F.when(F.element_at(F.col("__fu"), i + 1).isNotNull(), F.col(c))
                          for i, c in enumerate(cols)}).drop("__fu")


def distinct_first(df: DataFrame, order: RowOrder, keys: list[str]) -> DataFrame:
    """O-38: keep the first row in file order of each key combination (nulls
    equal); a grouped min_by, pre-combined map-side."""
    return first_in_order(df, keys, order)


def attach_by_ordinal(left: DataFrame, right: DataFrame, order_left: RowOrder, order_right: RowOrder,
                      right_cols: list[str]) -> DataFrame:
    """O-28: attach the k-th right row to the k-th left row of the same file,
    only when both sides have the same number of rows in that file; otherwise
    the right columns stay null (the source skips silently)."""
    f = order_left.file_col
    l2 = ordinal(left, "__k", order_left)
    r2 = ordinal(right, "__k", order_right).select(F.col(order_right.file_col).alias(f), "__k", *right_cols)
    cl = left.groupBy(f).agg(F.count(F.lit(1)).alias("__nl"))
    cr = right.groupBy(order_right.file_col).agg(F.count(F.lit(1)).alias("__nr")) \
        .withColumnRenamed(order_right.file_col, f)
    same = cl.join(cr, on=f).where(F.col("__nl") == F.col("__nr")).select(f)
    r3 = r2.join(same, on=f, how="left_semi")
    return l2.join(r3, on=[f, "__k"], how="left").drop("__k")


def split_cell(df: DataFrame, col: str, *, prefix: str, sep: str = "\n", width: int | None = None) -> DataFrame:
    """O-61: split a multi-line cell into ``prefix_1..m`` (m = most lines),
    dropping the original column."""
    parts = F.split(F.col(col), sep)
    d = df.withColumn("__parts", parts)
    if width is None:
        width = int(d.agg(F.max(F.size("__parts"))).first()[0] or 0)
    return d.withColumns({f"{prefix}{i}": F.try_element_at(F.col("__parts"), F.lit(i))
                          for i in range(1, width + 1)}).drop("__parts", col)


def special_rows(df: DataFrame, label: str, values: list[str]) -> tuple[DataFrame, DataFrame]:
    """O-25: split a journal into (special rows, the rest) by a label column."""
    is_special = F.coalesce(F.col(label).isin(values), F.lit(False))
    return df.where(is_special), df.where(~is_special)


def entries_with(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """O-26 / O-27: left equi-join entries with pivoted text or special rows;
    several right rows per key fan out, as in the source."""
    return left.join(right, on=on, how="left")


def column_sum_is_zero(df: DataFrame, file_col: str, col: Column, out: str) -> DataFrame:
    """O-39: per file, whether a column sums to zero (decides a fallback column)."""
    s = df.groupBy(file_col).agg((F.coalesce(F.sum(col), F.lit(0)) == 0).alias(out))
    return df.join(s, on=file_col, how="left")
