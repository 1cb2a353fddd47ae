"""Order-dependent primitives that stay parallel inside one huge file.

Registers are ordered tables: ``(file, order columns...)``.  A plain
``Window.partitionBy(file)`` puts a whole file on one task, which breaks when a
single file holds a large share of all rows.  Every primitive here partitions by
``(file, block)`` instead, where the block columns are monotone in the row order
(by default ``floor(row_no / block_rows)``), and repairs the block edges with a
small per-block table:

* forward fill: last non-null value per block, carried over preceding blocks;
* lead / lag: the first / last few rows of each block, read by neighbours;
* running count / ordinal: per-block counts, prefix-summed over blocks.

The per-block tables have one row per block (rows / block_rows), so they stay
small; Spark's size-checked broadcast (``autoBroadcastJoinThreshold``) or a
shuffle join on the block key handles them, and the big side is already hash
partitioned on ``(file, block)`` by the window, so it is not shuffled again.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stage import stage

DEFAULT_BLOCK_ROWS = 1 << 20


@dataclass(frozen=True)
class RowOrder:
    """How rows of a register are ordered.

    ``file_col`` scopes every operator (nothing crosses files).  ``order_cols``
    give the total order inside a file.  ``block_cols`` (optional) name columns
    whose lexicographic order is consistent with ``order_cols`` and that cut a
    file into bounded pieces; by default the first order column is bucketed into
    ranges of ``block_rows``.
    """

    file_col: str = "file_name"
    order_cols: tuple[str, ...] = ("row_no",)
    block_cols: tuple[str, ...] | None = None
    block_rows: int = DEFAULT_BLOCK_ROWS

    def with_order(self, *cols: str) -> "RowOrder":
        return RowOrder(self.file_col, tuple(cols), self.block_cols, self.block_rows)

    def block_exprs(self) -> list[Column]:
        if self.block_cols:
            return [F.col(c) for c in self.block_cols]
        return [F.floor(F.col(self.order_cols[0]) / F.lit(self.block_rows)).cast("long")]

    def order_exprs(self) -> list[Column]:
        return [F.col(c).asc_nulls_first() for c in self.order_cols]

    def order_key(self) -> Column:
        return F.struct(*[F.col(c) for c in self.order_cols])

    def file_window(self) -> Window:
        """Whole-file window; use only on bounded row sets (e.g. total rows)."""
        return Window.partitionBy(self.file_col).orderBy(*self.order_exprs())


_BLK = "__blk"


def _add_blocks(df: DataFrame, order: RowOrder) -> tuple[DataFrame, list[str]]:
    exprs = order.block_exprs()
    names = [f"{_BLK}{i}" for i in range(len(exprs))]
    return df.withColumns(dict(zip(names, exprs))), names


def _empty_like(arr: Column) -> Column:
    return F.filter(arr, lambda x: F.lit(False))


def ffill(df: DataFrame, exprs: dict[str, Column], order: RowOrder) -> DataFrame:
    """Forward fill: each output column is the last non-null value of its
    expression at or before the row, within the file (``ffill`` in pandas)."""
    if not exprs:
        return df
    d, bn = _add_blocks(df, order)
    tmp = {f"__ff{i}": e for i, e in enumerate(exprs.values())}
    d = d.withColumns(tmp)
    part = [F.col(order.file_col)] + [F.col(b) for b in bn]
    w = Window.partitionBy(*part).orderBy(*order.order_exprs()) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumns({f"{t}_loc": F.last(t, ignorenulls=True).over(w) for t in tmp})

    key = order.order_key()
    tails = d.groupBy(order.file_col, *bn).agg(
        *[F.max_by(F.col(t), F.when(F.col(t).isNotNull(), key)).alias(f"{t}_tail") for t in tmp])
    wb = Window.partitionBy(order.file_col).orderBy(*bn) \
        .rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.select(order.file_col, *bn,
                         *[F.last(f"{t}_tail", ignorenulls=True).over(wb).alias(f"{t}_carry")
                           for t in tmp])
    out = d.join(carry, on=[order.file_col, *bn], how="left")
    out = out.withColumns({name: F.coalesce(F.col(f"{t}_loc"), F.col(f"{t}_carry"))
                           for name, t in zip(exprs.keys(), tmp)})
    drop = list(tmp) + [f"{t}_loc" for t in tmp] + [f"{t}_carry" for t in tmp] + bn
    return out.drop(*drop)


def shift(df: DataFrame, specs: dict[str, tuple[Column, int]], order: RowOrder) -> DataFrame:
    """Lead (offset > 0) / lag (offset < 0) of expressions within the file."""
    if not specs:
        return df
    k_lead = max([k for _, k in specs.values() if k > 0], default=0)
    k_lag = max([-k for _, k in specs.values() if k < 0], default=0)
    d, bn = _add_blocks(df, order)
    tmp = {f"__sh{i}": e for i, (e, _) in enumerate(specs.values())}
    d = d.withColumns(tmp)
    part = [F.col(order.file_col)] + [F.col(b) for b in bn]
    w = Window.partitionBy(*part).orderBy(*order.order_exprs())
    # rows from the block end, exact up to K (capped at K + 1 beyond): read
    # from lead markers instead of a whole-partition count, so no block is
    # buffered in full
    kmax = max(k_lead, k_lag, 1)
    rd = F.lit(kmax + 1)
    for j in range(kmax, 0, -1):
        rd = F.when(F.lead(F.lit(1), j).over(w).isNull(), F.lit(j)).otherwise(rd)
    d = d.withColumn("__rn", F.row_number().over(w)).withColumn("__rd", rd)
    local = {}
    for i, (name, (_, k)) in enumerate(specs.items()):
        t = f"__sh{i}"
        local[f"{t}_loc"] = (F.lead(t, k) if k > 0 else F.lag(t, -k)).over(w)
    d = d.withColumns(local)

    head_n = max(k_lead, 1)
    vals = [F.col(t) for t in tmp]
    edges = d.where((F.col("__rn") <= head_n) | (F.col("__rd") <= k_lag)).groupBy(order.file_col, *bn).agg(
        F.array_sort(F.collect_list(F.when(F.col("__rn") <= head_n,
                                           F.struct(F.col("__rn").alias("p"), *vals))))
        .alias("__head"),
        F.array_sort(F.collect_list(F.when(F.col("__rd") <= k_lag,
                                           F.struct(F.col("__rd").alias("p"), *vals))))
        .alias("__tail"),
    )
    wb = Window.partitionBy(order.file_col).orderBy(*bn)
    nxt = [F.coalesce(F.lead("__head", j).over(wb), _empty_like(F.col("__head")))
           for j in range(1, k_lead + 1)]
    prv = [F.coalesce(F.lag("__tail", j).over(wb), _empty_like(F.col("__tail")))
           for j in range(1, k_lag + 1)]
    edges = edges.select(
        order.file_col, *bn,
        (F.concat(*nxt) if nxt else _empty_like(F.col("__head"))).alias("__next"),
        (F.concat(*prv) if prv else _empty_like(F.col("__tail"))).alias("__prev"),
    )
    out = d.join(edges, on=[order.file_col, *bn], how="left")
    res = {}
    for i, (name, (_, k)) in enumerate(specs.items()):
        t = f"__sh{i}"
        if k > 0:
            edge = F.try_element_at(F.col("__next"), (F.lit(k) - F.col("__rd") + 1).cast("int"))
            res[name] = F.when(F.col("__rd") > k, F.col(f"{t}_loc")).otherwise(edge.getField(t))
        else:
            j = -k
            edge = F.try_element_at(F.col("__prev"), (F.lit(j) - F.col("__rn") + 1).cast("int"))
            res[name] = F.when(F.col("__rn") > j, F.col(f"{t}_loc")).otherwise(edge.getField(t))
    out = out.withColumns(res)
    drop = list(tmp) + list(local) + bn + ["__rn", "__rd", "__next", "__prev"]
    return out.drop(*drop)


def ordinal(df: DataFrame, out: str, order: RowOrder, keys: Iterable[str] = (),
            where: Column | None = None) -> DataFrame:
    """1-based position of a row among the rows of its file sharing ``keys``
    (``groupby(keys).cumcount() + 1``).  Rows failing ``where`` get null and are
    not counted, nor shuffled: ``df`` is read once for them and once for the others.  Keys compare null-safely."""
    keys = list(keys)
    if where is not None:
        counts = F.coalesce(where, F.lit(False))
        rest = df.where(~counts).withColumn(out, F.lit(None).cast("long"))
        return ordinal(df.where(counts), out, order, keys).unionByName(rest)
    d, bn = _add_blocks(df, order)
    # keys in structs are equal where both are null, so one exchange serves the window and the join
    at = {f"__at{i}": F.struct(c) for i, c in enumerate([order.file_col, *keys, *bn])}
    d = d.withColumns(at)
    scope, blocks = list(at)[:len(at) - len(bn)], list(at)[len(at) - len(bn):]
    w = Window.partitionBy(*at).orderBy(*order.order_exprs())
    counts = d.groupBy(*at).agg(F.count(F.lit(1)).alias("__cnt"))
    wb = Window.partitionBy(*scope).orderBy(*blocks).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__off", F.coalesce(F.sum("__cnt").over(wb), F.lit(0))).drop("__cnt")
    joined = d.withColumn("__loc", F.row_number().over(w)).join(counts, on=list(at), how="left")
    joined = joined.withColumn(out, (F.col("__off") + F.col("__loc")).cast("long"))
    return joined.select(*[c for c in df.columns if c != out], out)


def first_in_order(df: DataFrame, keys: list[str], order: RowOrder) -> DataFrame:
    """Keep the first row (in file order) of every distinct key combination
    (``drop_duplicates(keep='first')``; nulls compare equal).  A grouped
    ``min_by`` with map-side partial aggregation, so a hot key is pre-combined
    before the shuffle."""
    cols = df.columns
    group = [order.file_col] + [k for k in keys if k != order.file_col]
    agg = df.groupBy(*group).agg(
        F.min_by(F.struct(*[F.col(c) for c in cols]), order.order_key()).alias("__first"))
    return agg.select("__first.*")


def last_rows(df: DataFrame, order: RowOrder, n: int, out: str = "__from_end") -> DataFrame:
    """Number rows from the end of their file (1 = last).  Meant for bounded
    row sets such as total rows; counts come from per-block aggregates."""
    d, bn = _add_blocks(df, order)
    part = [F.col(order.file_col)] + [F.col(b) for b in bn]
    desc = [F.col(c).desc_nulls_last() for c in order.order_cols]
    d = d.withColumn("__rdl", F.row_number().over(Window.partitionBy(*part).orderBy(*desc)))
    counts = d.groupBy(order.file_col, *bn).agg(F.count(F.lit(1)).alias("__c"))
    wb = Window.partitionBy(order.file_col).orderBy(*[F.col(b).desc() for b in bn]) \
        .rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__after", F.coalesce(F.sum("__c").over(wb), F.lit(0))).drop("__c")
    out_df = d.join(counts, on=[order.file_col, *bn], how="left") \
        .withColumn(out, (F.col("__after") + F.col("__rdl")).cast("long"))
    out_df = out_df.drop("__rdl", "__after", *bn)
    return out_df.where(F.col(out) <= n) if n else out_df


def with_file_facts(df: DataFrame, facts: DataFrame, order: RowOrder) -> DataFrame:
    """The rows of ``df`` whose file has a row in ``facts`` (at most one), with its columns.

    Joined by (file, block) from a staged table of one row for each block: Spark knows its size, and where it is
    too large to broadcast, a hot file is still spread over tasks."""
    d, bn = _add_blocks(df, order)
    blocks = d.select(order.file_col, *bn).distinct().join(facts, order.file_col)
    return d.join(stage(blocks, "file-facts"), [order.file_col, *bn]).drop(*bn)


def file_facts(df: DataFrame, file_col: str, **aggs: Column) -> DataFrame:
    """Small per-file aggregate (max level, header row, ...) to join back."""
    return df.groupBy(file_col).agg(*[c.alias(n) for n, c in aggs.items()])


def running(df: DataFrame, out: str, order: RowOrder, expr: Column, how: str = "sum") -> DataFrame:
    """Running sum / max of ``expr`` from the start of the file up to the row
    (nulls skipped): local running value per block + the combined value of all
    earlier blocks (a prefix over the small per-block table)."""
    d, bn = _add_blocks(df, order)
    d = d.withColumn("__x", expr)
    agg = F.sum if how == "sum" else F.max
    part = [F.col(order.file_col)] + [F.col(b) for b in bn]
    w = Window.partitionBy(*part).orderBy(*order.order_exprs()) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("__loc", agg("__x").over(w))
    blocks = d.groupBy(order.file_col, *bn).agg(agg("__x").alias("__b"))
    wb = Window.partitionBy(order.file_col).orderBy(*bn).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("__carry", agg("__b").over(wb)).drop("__b")
    j = d.join(blocks, on=[order.file_col, *bn], how="left")
    if how == "sum":
        val = F.when(F.col("__loc").isNull() & F.col("__carry").isNull(), F.lit(None)) \
            .otherwise(F.coalesce("__loc", F.lit(0)) + F.coalesce("__carry", F.lit(0)))
    else:
        val = F.greatest("__loc", "__carry")
    return j.withColumn(out, val).drop("__x", "__loc", "__carry", *bn)
