"""Outline (grouped rows) -> flat path columns, and the row filters that go
with it: O-50/O-51 paths, O-52 unlabelled quantity rows, O-22 trim after the
first total, O-55 subtotal (non-leaf) removal, O-15 service rows, O-58 level
alignment, O-59 deepest all-account level, O-62 missing labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import EXCLUDE_LABELS, NOT_FILLED, QUANTITY, TOTAL
from ..functions.scalars import apart, is_account_code
from .ordered import RowOrder, ffill, shift
from .stage import stage


def level_names(n_levels: int, prefix: str = "Level_") -> list[str]:
    return [f"{prefix}{k}" for k in range(n_levels)]


def max_level(df: DataFrame, level: str = "level") -> int:
    """Depth of the outline (one tiny aggregate job; decides the output width)."""
    v = df.agg(F.max(level)).first()[0]
    return int(v) if v is not None else 0


def outline_paths(df: DataFrame, order: RowOrder, *, label: str = "label", level: str = "level",
                  depth: int | None = None, prefix: str = "Level_",
                  path_label: Column | None = None) -> DataFrame:
    """O-50: ``Level_k`` = the last label seen at outline level k, null where the
    row is shallower than k.  Not scoped to the parent: a block that skips a
    level inherits the previous block's value there (kept as in the source).

    ``path_label`` (optional) is the label used for path building; O-51 passes a
    label that is null on quantity rows so they inherit their predecessor's path.
    """
    depth = max_level(df, level) if depth is None else depth
    lab = F.col(label) if path_label is None else path_label
    exprs = {f"{prefix}{k}": F.when(F.col(level) == k, lab) for k in range(depth + 1)}
    out = ffill(df, exprs, order)
    return out.withColumns({f"{prefix}{k}": F.when(F.col(level) >= k, F.col(f"{prefix}{k}"))
                            for k in range(depth + 1)})


def infer_quantity_rows(df: DataFrame, order: RowOrder, *, label: str = "label", level: str = "level",
                        marker: str = QUANTITY) -> DataFrame:
    """O-52: an unlabelled row at the same level as the row before it is a
    quantity row."""
    d = shift(df, {"__prev_level": (F.col(level), -1)}, order)
    return d.withColumn(label, F.when(F.col(label).isNull() & (F.col(level) == F.col("__prev_level")),
                                      F.lit(marker)).otherwise(F.col(label))).drop("__prev_level")


def first_label_key(df: DataFrame, order: RowOrder, label: str, value: str, out: str) -> DataFrame:
    """Per-file order key of the first row whose label equals ``value``."""
    return df.where(F.col(label) == value).groupBy(order.file_col) \
        .agg(F.min(order.order_key()).alias(out))


def trim_after_total(df: DataFrame, order: RowOrder, *, label: str = "label", total: str = TOTAL,
                     marker: str = QUANTITY) -> DataFrame:
    """O-22: drop quantity rows that come after the first total row of the file."""
    first = first_label_key(df, order, label, total, "__first_total")
    d = df.join(first, on=order.file_col, how="left")
    drop = (F.col(label) == marker) & F.col("__first_total").isNotNull() & \
        (order.order_key() > F.col("__first_total"))
    return d.where(~F.coalesce(drop, F.lit(False))).drop("__first_total")


def drop_subtotals(df: DataFrame, order: RowOrder, *, label: str = "label",
                   level: str = "level") -> DataFrame:
    """O-55: remove a row when the next remaining row is deeper (the row is a
    parent / subtotal of what follows).  A row's own path cell equals its label
    when the label is present, so the label test reduces to ``label is not
    null``.  The last row of a file has no next row and stays."""
    d = shift(df, {"__next_level": (F.col(level), 1)}, order)
    parent = (F.col("__next_level") > F.col(level)) & F.col(label).isNotNull()
    return d.where(~F.coalesce(parent, F.lit(False))).drop("__next_level")


def not_in(col: str | Column, values: list[str]) -> Column:
    """Null-safe ``~isin``: a null value is kept (pandas semantics)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(~c.isin(values), F.lit(True))


def exclude_service_rows(df: DataFrame, label: str = "label", values: list[str] = EXCLUDE_LABELS) -> DataFrame:
    """O-15: remove service rows (opening/closing/total lines)."""
    return df.where(not_in(label, values))


def mark_missing_label(df: DataFrame, *, label: str = "label", indicator: str | None = None,
                       pattern: str = "Кол.", marker: str = NOT_FILLED) -> DataFrame:
    """O-62: a missing label becomes ``Не_заполнено``; with an indicator column
    only rows whose indicator does not match ``pattern`` (regex) are marked."""
    cond = F.col(label).isNull()
    if indicator is not None:
        cond = cond & ~F.coalesce(F.col(indicator).rlike(pattern), F.lit(False))
    return df.withColumn(label, F.when(cond, F.lit(marker)).otherwise(F.col(label)))


def _leading_codes(levels: list[str]) -> Column:
    """Length of the leading run of account codes in a path."""
    out = F.lit(len(levels))
    for k, c in reversed([*enumerate(levels)]):
        out = F.when(~is_account_code(F.col(c)), F.lit(k)).otherwise(out)
    return out


def align_levels(df: DataFrame, level_cols: list[str], scope: list[str], *, width: int | None = None,
                 prefix: str = "Level_") -> DataFrame:
    """O-58: make account codes line up in the same columns.

    ``r`` = leading run of account codes of the row's path, ``D`` = max ``r`` in
    the scope (file, or the whole batch).  The last code of the run is repeated
    ``D - r`` times so analytics start at column ``D``.  Rows whose first level is
    not a code are left alone.  ``width`` defaults to ``n + D - 1`` (nothing is
    lost); pass ``len(level_cols)`` to truncate like the source.
    """
    n = len(level_cols)
    path = F.array(*[F.col(c) for c in level_cols])
    d = df.withColumns({"__r": _leading_codes(level_cols), level_cols[0]: apart(level_cols[0])})
    # staged, so its size is known: a join by the scope would send each file to one task
    facts = stage(d.groupBy(*scope).agg(F.max("__r").alias("__D")) if scope else d.agg(F.max("__r").alias("__D")), "code-runs")
    if scope:
        d = d.join(facts, on=scope, how="left")
    else:  # one-row fact: equi-join on a constant key, broadcast (size is one row)
        d = d.withColumn("__one", F.lit(1)).join(F.broadcast(facts.withColumn("__one", F.lit(1))),
                                                 on="__one").drop("__one")
    if width is None:
        dmax = facts.agg(F.max("__D")).first()[0] or 1
        width = n + max(int(dmax), 1) - 1
    r, D = F.col("__r"), F.col("__D")
    shifted = F.concat(F.slice(path, 1, r), F.array_repeat(F.element_at(path, r), D - r), F.slice(path, r + 1, n))
    # the other rows stay as they are
    d = d.withColumn("__path", apart(F.when((r >= 1) & (D > r), shifted)))
    cols = {f"{prefix}{k}": F.when(F.col("__path").isNull(), F.col(level_cols[k]) if k < n else F.lit(None))
            .otherwise(F.try_element_at(F.col("__path"), F.lit(k + 1))) for k in range(width)}
    return d.withColumns(cols).drop("__path", "__r", "__D")


def deepest_account_level(df: DataFrame, level_cols: list[str], scope: list[str],
                          out: str = "Субсчет") -> DataFrame:
    """O-59: per scope, the deepest ``Level_k`` whose every value is an account
    code; its value goes to ``out`` (null when no level qualifies)."""
    facts = df.groupBy(*scope).agg(*[
        F.bool_and(is_account_code(F.col(c))).alias(f"__all{k}") for k, c in enumerate(level_cols)])
    pick = None
    for k in range(len(level_cols) - 1, -1, -1):
        cond = F.col(f"__all{k}")
        pick = F.when(cond, F.lit(k)) if pick is None else pick.when(cond, F.lit(k))
    facts = stage(facts.select(*scope, pick.alias("__deep")), "deepest")
    d = df.join(facts, on=scope, how="left")
    val = None
    for k, c in enumerate(level_cols):
        val = F.when(F.col("__deep") == k, F.col(c)) if val is None else val.when(F.col("__deep") == k, F.col(c))
    return d.withColumn(out, val).drop("__deep")
