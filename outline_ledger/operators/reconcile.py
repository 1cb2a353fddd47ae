"""Reconciliation: control totals before processing vs the flat result after.

O-56 control row (second-to-last total), O-35 / O-68 / O-69 per-file nets,
O-31 side-by-side, O-70 half-even difference, O-34 / O-67 per-account sums,
O-30 full outer join, O-71 hidden-subtotal detection (O-72, their removal, is in ``analysis``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import OUTLINE_FILE_COL, TOTAL
from .ordered import RowOrder, last_rows

MONEY = "decimal(38,2)"  # totals of a 100 TB batch overflow decimal(18,2)

# --- fixed values: names of the per-file check table ----------------------------
OPEN = "Сальдо_начало"
TURN = "Оборот"
CLOSE = "Сальдо_конец"
BEFORE = "_до_обработки"
AFTER = "_после_обработки"
DIFF = "_разница"


def _z(c: Column) -> Column:
    return F.coalesce(c.cast(MONEY), F.lit(0).cast(MONEY))


def control_row(df: DataFrame, order: RowOrder, measures: list[str], *, label: str = "label",
                total: str = TOTAL) -> DataFrame:
    """O-56: per file, the second-to-last total row (or the only one).  Total
    rows are few per file, so the numbering runs on that small subset."""
    totals = last_rows(df.where(F.col(label) == total), order, 2, out="__from_end")
    pick = totals.groupBy(order.file_col).agg(
        F.max_by(F.struct(*[F.col(m) for m in measures]), F.col("__from_end")).alias("__ctl"))
    return pick.select(order.file_col, *[F.col(f"__ctl.{m}").alias(m) for m in measures])


def nets(df: DataFrame, file_col: str, *, debit_open: str | None, credit_open: str | None,
         debit_turn: list[str], credit_turn: list[str], debit_close: str | None,
         credit_close: str | None, suffix: str) -> DataFrame:
    """O-35: Σdebit − Σcredit for opening, turnover and closing per file; a
    missing column counts as 0."""
    def total(cols):
        cols = [c for c in cols if c]
        if not cols:
            return F.lit(0).cast(MONEY)
        acc = None
        for c in cols:
            s = _z(F.sum(_z(F.col(c))))
            acc = s if acc is None else acc + s
        return acc
    return df.groupBy(file_col).agg(
        (total([debit_open]) - total([credit_open])).cast(MONEY).alias(OPEN + suffix),
        (total(debit_turn) - total(credit_turn)).cast(MONEY).alias(TURN + suffix),
        (total([debit_close]) - total([credit_close])).cast(MONEY).alias(CLOSE + suffix),
    )


def file_check(before: DataFrame, after: DataFrame, file_col: str,
               out_file_col: str = OUTLINE_FILE_COL) -> DataFrame:
    """O-31 + O-70: before ‖ after per file, difference rounded half-to-even."""
    j = before.join(after, on=file_col, how="full")
    cols = []
    for stem in (OPEN, TURN, CLOSE):
        b, a = _z(F.col(stem + BEFORE)), _z(F.col(stem + AFTER))
        cols += [b.alias(stem + BEFORE), a.alias(stem + AFTER),
                 F.bround(b - a, 0).cast("decimal(18,0)").alias(stem + DIFF)]
    return j.select(*cols, F.col(file_col).alias(out_file_col))


def account_totals(df: DataFrame, keys: list[str], measures: list[str], suffix: str) -> DataFrame:
    """O-34: sum per (file, account); null keys dropped, nulls skipped, an
    all-null sum is 0."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return df.where(cond).groupBy(*keys).agg(
        *[_z(F.sum(_z(F.col(m)))).cast(MONEY).alias(m + suffix) for m in measures])


def account_check(before: DataFrame, after: DataFrame, keys: list[str], measures: list[str],
                  diff_names: dict[str, str]) -> DataFrame:
    """O-30 + O-70: full outer join of control vs result per account, missing
    side = 0, difference rounded half-to-even."""
    j = before.join(after, on=keys, how="full")
    out = [F.col(k) for k in keys]
    for m in measures:
        b, a = _z(F.col(m + "_base")), _z(F.col(m + "_current"))
        out += [b.alias(m + "_base"), a.alias(m + "_current"),
                F.bround(b - a, 0).cast("decimal(18,0)").alias(diff_names[m])]
    return j.select(*out)


def first_reaching(series: DataFrame, need: DataFrame, fan: int = 64) -> DataFrame:
    """For each (g, pos, T) of ``need`` the P of the first later row of ``series`` (g, pos = 1..n, P)
    with P >= T: (g, pos, __stopP); rows without one are absent.

    A tree of maxima over blocks of ``fan`` rows, ``fan`` blocks and so on: a search climbs until a
    later sibling's maximum reaches T, then descends.  Each step is a join on (group, parent), so no
    task holds a group; the number of steps is the tree's height.
    """
    from .stage import stage
    levels = [stage(series.select("__g", (F.col("__pos") - 1).alias("k"), F.col("__P").alias("m")), "maxima")]
    size = series.agg(F.max("__pos")).first()[0] or 0
    while size > fan:
        up = levels[-1].groupBy("__g", F.floor(F.col("k") / fan).alias("k")).agg(F.max("m").alias("m"))
        levels.append(stage(up, "maxima"))
        size = -(-size // fan)

    def siblings(level):
        return levels[level].select(F.col("__g").alias("g2"), F.floor(F.col("k") / fan).alias("parent"),
                                    F.col("k").alias("k2"), "m")

    waiting = stage(need.select("__g", "__pos", "__T", (F.col("__pos") - 1).alias("k")), "searches")
    found = []
    for level in range(len(levels)):
        hit = waiting.join(siblings(level), (F.col("__g") == F.col("g2")) & (F.floor(F.col("k") / fan) == F.col("parent"))
                           & (F.col("k2") > F.col("k")) & (F.col("m") >= F.col("__T")))
        hit = stage(hit.groupBy("__g", "__pos", "__T").agg(F.min("k2").alias("k")), "found")
        found.append(hit)
        waiting = stage(waiting.join(hit.select("__g", "__pos"), on=["__g", "__pos"], how="left_anti")
                        .withColumn("k", F.floor(F.col("k") / fan)), "searches")
    at = found[-1]
    for level in range(len(levels) - 2, -1, -1):
        down = at.join(siblings(level), (F.col("__g") == F.col("g2")) & (F.col("k") == F.col("parent"))
                       & (F.col("m") >= F.col("__T")))
        at = found[level].unionByName(down.groupBy("__g", "__pos", "__T").agg(F.min("k2").alias("k")))
    return at.join(levels[0].select("__g", "k", F.col("m").alias("__stopP")), on=["__g", "k"]).select(
        "__g", "__pos", "__stopP")


def hidden_subtotals(df: DataFrame, order: RowOrder, group: list[str], value: str, *,
                     tolerance: float = 0.005, out: str = "is_subtotal") -> DataFrame:
    """O-71: row i (non-null value v_i, in file order within its group) is a
    hidden subtotal if a run of the following rows adds up to it: scanning
    j = i+1.. with running sum S, the scan stops at the first S ≥ v_i − tol and
    the row is a hit iff that S ≤ v_i + tol.  The last row is never a hit.

    With prefix sums P and the running maximum Q of P, the stop index is the
    first j > i with P_j ≥ T_i = P_i + v_i − tol:
      * if T_i > Q_i, it is the first j with Q_j ≥ T_i (Q is monotone), found
        as an as-of lookup: thresholds and Q values are merged in one order and
        each threshold takes the next Q by a forward fill over the reversed
        order (block-wise, no pairwise join), and P_j = Q_j there;
      * otherwise, in a group without negative values, it is j = i + 1;
      * in groups with negative values it is looked up in a tree of block maxima
        (``first_reaching``), with the same decimal arithmetic.
    """
    from .ordered import ffill, ordinal, running, shift
    keys = [order.file_col] + group
    tol = F.lit(tolerance).cast("decimal(20,4)")
    g = RowOrder("__g", order.order_cols, order.block_cols, order.block_rows)
    d = df.withColumn("__g", F.to_json(F.struct(*[F.col(k).cast("string") for k in keys]))) \
        .withColumn("__v", F.col(value).cast("decimal(20,4)"))
    base = d.where(F.col("__v").isNotNull())
    base = ordinal(base, "__pos", g)
    base = running(base, "__P", g, F.col("__v"), "sum")
    base = running(base, "__Q", g, F.col("__P"), "max")
    base = shift(base, {"__Pn": (F.col("__P"), 1)}, g)
    base = base.withColumn("__T", F.col("__P") + F.col("__v") - tol)
    from .stage import stage
    base = stage(base, "subtotal-prefix")
    neg = base.groupBy("__g").agg(F.min("__v").alias("__minv"))
    base = base.join(neg, on="__g")

    # case A: as-of lookup on Q
    qa = base.where(F.col("__T") > F.col("__Q")).select(
        "__g", "__pos", F.col("__T").alias("__key"), F.lit(0).alias("__kind"), F.lit(None).cast("decimal(38,4)")
        .alias("__pay"), *[F.col(c) for c in order.order_cols])
    da = base.select("__g", "__pos", F.col("__Q").alias("__key"), F.lit(1).alias("__kind"),
                     F.col("__Q").cast("decimal(38,4)").alias("__pay"), *[F.col(c) for c in order.order_cols])
    m = qa.unionByName(da)
    st = da.groupBy("__g").agg(F.min("__key").alias("__lo"), F.max("__key").alias("__hi"),
                               F.count(F.lit(1)).alias("__n"))
    m = m.join(st, on="__g").withColumn(
        "__w", F.greatest((F.col("__hi") - F.col("__lo")).cast("double") * F.lit(order.block_rows)
                          / F.col("__n").cast("double"), F.lit(1e-9)))
    m = m.withColumn("__nk", -F.col("__key")).withColumn("__nkind", -F.col("__kind")) \
        .withColumn("__npos", -F.col("__pos")) \
        .withColumn("__blk", F.floor(F.col("__nk").cast("double") / F.col("__w")).cast("long"))
    rev = RowOrder("__g", ("__nk", "__nkind", "__npos"), ("__blk",))
    m = ffill(m, {"__next_q": F.col("__pay")}, rev)
    hit_a = m.where(F.col("__kind") == 0).select("__g", "__pos", F.col("__next_q").alias("__stopP"))
    a = base.join(hit_a, on=["__g", "__pos"], how="inner") \
        .where(F.col("__stopP").isNotNull() & ((F.col("__stopP") - F.col("__P")) <= (F.col("__v") + tol))) \
        .select("__g", "__pos")
    # case B without negatives: stop at the next row
    b = base.where((F.col("__T") <= F.col("__Q")) & (F.col("__minv") >= 0) & F.col("__Pn").isNotNull()
                   & ((F.col("__Pn") - F.col("__P")) <= (F.col("__v") + tol))).select("__g", "__pos")
    # case B with negatives: the first later prefix sum that reaches the threshold, by block maxima
    need = base.where((F.col("__T") <= F.col("__Q")) & (F.col("__minv") < 0)).select("__g", "__pos", "__T", "__P", "__v")
    series = base.join(need.select("__g").distinct(), on="__g", how="left_semi").select("__g", "__pos", "__P")
    stops = first_reaching(series, need.select("__g", "__pos", "__T"))
    c = need.join(stops, on=["__g", "__pos"]) \
        .where((F.col("__stopP") - F.col("__P")) <= (F.col("__v") + tol)).select("__g", "__pos")
    hits = a.unionByName(b).unionByName(c).withColumn(out, F.lit(True))
    res = base.join(hits, on=["__g", "__pos"], how="left")
    res = res.withColumn(out, F.coalesce(F.col(out), F.lit(False)))
    drop = ["__g", "__v", "__pos", "__P", "__Q", "__Pn", "__T", "__minv"]
    nulls = d.where(F.col("__v").isNull()).withColumn(out, F.lit(False))
    return res.drop(*drop).unionByName(nulls.drop("__g", "__v"))
