"""Register pipelines over ``raw_rows``: P-7/P-8 turnover on the outline chain,
P-11/P-12 general trial balance, P-13 batch combine.  Each works on the whole
batch of files at once; a file that is rejected is in the quarantine table and
in no other result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import (BALANCE_CLOSE_TITLE, BALANCE_OPEN_TITLE, BALANCE_TURN_TITLE_NONUPP,
                         BALANCE_TURN_TITLE_UPP, CREDIT_SIDE_SUFFIX, DEBIT_SIDE_SUFFIX, DEBIT_TURN, CREDIT_TURN, DEBIT_CLOSE,
                         MEASURES, OUTLINE_FILE_COL, OUTLINE_HEADER_SCAN_ROWS, TURNOVER_NONUPP_RENAME,
                         TURNOVER_UPP_RENAME)
from ..functions.scalars import parse_number
from ..operators.accounts import suppression_set
from ..operators.headers import header_rows, order_columns, union_registers
from ..operators.leaves import leaf_rows
from ..operators.measures import keep_rows_with_measures
from ..operators.ordered import RowOrder
from ..operators.outline import align_levels, exclude_service_rows, max_level
from ..operators.reconcile import AFTER, BEFORE, control_row, file_check, nets
from ..operators.stage import stage

RAW_ORDER = RowOrder(file_col="file_name", order_cols=("row_no",), block_rows=1 << 17)
LABEL = "Субконто"


def _quarantine(df: DataFrame, reason: str) -> DataFrame:
    return df.select("file_name").distinct().withColumn("reason", F.lit(reason))


def resolve_outline_header(raw: DataFrame, title: str, rename: dict[str, str],
                           scan_rows: int = OUTLINE_HEADER_SCAN_ROWS) -> tuple[DataFrame, DataFrame]:
    """O-2 / O-3 / O-7: header = first row (within ``scan_rows``) holding ``title``
    as an exact cell; cells renamed to canonical measures; files without it are
    quarantined."""
    match = F.exists(F.col("cells"), lambda c: F.trim(c) == title)
    hdr = header_rows(raw, match, scan_rows=scan_rows)
    mapping = F.create_map(*[x for k, v in rename.items() for x in (F.lit(k), F.lit(v))])
    # staged, so its size is known: a join by the file would send each file to one task
    hdr = stage(hdr.withColumn("header_names", F.transform(
        "header", lambda c: F.coalesce(F.element_at(mapping, F.trim(c)), F.trim(c)))), "headers")
    missing = raw.select("file_name").distinct().join(hdr, on="file_name", how="left_anti") \
        .withColumn("reason", F.lit("header row not found"))
    return hdr, missing


def project_measures(raw: DataFrame, hdr: DataFrame, label_title: str) -> DataFrame:
    """O-3 + O-76: data rows below the header; label and the six measures by
    header position, measures parsed to decimals (blank -> null)."""
    d = raw.join(hdr.select("file_name", "header_row", "header_names"), on="file_name") \
        .where(F.col("row_no") > F.col("header_row"))

    def cell(name):
        pos = F.array_position(F.col("header_names"), F.lit(name)).cast("int")
        return F.when(pos > 0, F.try_element_at(F.col("cells"), pos))
    cols = {LABEL: F.nullif(F.trim(cell(label_title)), F.lit(""))}
    for m in MEASURES:
        # money and quantity rows share these cells: quantities have four digits
        cols[m] = parse_number(cell(m), default_zero=False, scale=4)
    return d.select("file_name", "row_no", "level", "italic", "cells", "header_names",
                    *[c.alias(n) for n, c in cols.items()])


def contra_long_raw(rows: DataFrame) -> DataFrame:
    """O-60 on raw rows: cells between debit and credit turnover are debit-side
    contra accounts, between credit turnover and closing debit credit-side;
    suppressed accounts (O-43 over the header names of each file and side) are
    removed.  Long form ``(file_name, row_no, contra_account, side, value)``."""
    names = F.col("header_names")
    i_dt = F.array_position(names, F.lit(DEBIT_TURN))
    i_kt = F.array_position(names, F.lit(CREDIT_TURN))
    i_end = F.array_position(names, F.lit(DEBIT_CLOSE))
    # decided by the header rows: files without contra columns are not read
    z = rows.where((i_kt > i_dt + 1) | (i_end > i_kt + 1))
    z = z.select("file_name", "row_no", i_dt.alias("i_dt"), i_kt.alias("i_kt"), i_end.alias("i_end"),
                    F.posexplode(F.arrays_zip(names.alias("n"), F.col("cells").alias("v"))).alias("p", "nv"))
    z = z.withColumn("p", F.col("p") + 1).withColumn(
        "side", F.when((F.col("p") > F.col("i_dt")) & (F.col("p") < F.col("i_kt")), F.lit(DEBIT_SIDE_SUFFIX))
        .when((F.col("p") > F.col("i_kt")) & (F.col("p") < F.col("i_end")), F.lit(CREDIT_SIDE_SUFFIX)))
    z = z.where(F.col("side").isNotNull()).select(
        "file_name", "row_no", "side", F.trim(F.col("nv.n")).alias("contra_account"), F.col("p"),
        parse_number(F.nullif(F.trim(F.col("nv.v")), F.lit("")), default_zero=False, scale=4).alias("value"))
    heads = z.select("file_name", "side", F.col("p").cast("string").alias("pos"), "contra_account").distinct()
    sup = suppression_set(heads, ["file_name", "side"], "pos", "contra_account", add_unpadded=False)
    return z.join(sup, on=["file_name", "side", "contra_account"], how="left_anti") \
        .where(F.col("value").isNotNull()).drop("p")


def flatten_outline(rows: DataFrame, order: RowOrder = RAW_ORDER):
    """The outline chain (O-52, O-22, O-62, O-41, O-51/O-50, O-53, O-23, O-55, O-15, O-19) on
    staged projected rows with a ``Субконто`` label -> (leaf rows, control rows, depth)."""
    d = rows.withColumnRenamed(LABEL, "label")
    depth = max_level(d)
    ctl = control_row(d, order, MEASURES)
    d = exclude_service_rows(leaf_rows(d, order, MEASURES, depth=depth))
    d = keep_rows_with_measures(d, MEASURES)
    d = d.withColumns({m: F.col(m).cast("decimal(18,2)") for m in MEASURES})
    return d.withColumnRenamed("label", LABEL), ctl, depth


def turnover_register(raw: DataFrame, *, dialect: str = "upp", align: bool = False):
    """P-7 / P-8: turnover registers of all files -> (flat, check, quarantine, contra).

    ``flat``: one row per leaf with ``Исх.файл``, ``Субконто``, measures,
    lifted quantities and ``Level_k``; ``check``: per-file control totals
    before/after with half-even differences (turnover after = Σ_до − Σ_ко of
    contra columns, falling back to the two turnover columns when a file has
    none); ``quarantine``: files without a header, without outline, or
    without a total row; ``contra``: the contra-account cells of the leaf rows."""
    title, rename = ("Субконто", TURNOVER_UPP_RENAME) if dialect == "upp" else ("Счет", TURNOVER_NONUPP_RENAME)
    hdr, no_header = resolve_outline_header(raw, title, rename)
    rows = project_measures(raw, hdr, title)
    projected = stage(rows.drop("cells", "header_names"), "projected")
    facts = stage(projected.groupBy("file_name").agg(F.max("level").alias("__ml")), "depths")
    flat_outline = _quarantine(facts.where(F.col("__ml") == 0), "outline is empty")

    def outlined(d):
        return d.join(facts.where(F.col("__ml") > 0).select("file_name"), on="file_name", how="left_semi")
    good = outlined(projected)
    contra = contra_long_raw(outlined(rows))
    flat, ctl, depth = flatten_outline(good)
    ctl = stage(ctl, "control")
    flat = stage(flat.join(ctl.select("file_name").distinct(), on="file_name", how="left_semi"), "leaves")
    no_total = good.select("file_name").distinct().join(ctl, on="file_name", how="left_anti") \
        .withColumn("reason", F.lit("no total row"))
    before = nets(ctl, "file_name", debit_open=MEASURES[0], credit_open=MEASURES[1], debit_turn=[MEASURES[2]],
                  credit_turn=[MEASURES[3]], debit_close=MEASURES[4], credit_close=MEASURES[5], suffix=BEFORE)
    kept = contra.join(flat.select("file_name", "row_no"), on=["file_name", "row_no"], how="left_semi")
    side_tot = kept.groupBy("file_name").agg(
        F.sum(F.when(F.col("side") == DEBIT_SIDE_SUFFIX, F.col("value"))).alias("__do"),
        F.sum(F.when(F.col("side") == CREDIT_SIDE_SUFFIX, F.col("value"))).alias("__ko"))
    after = nets(flat, "file_name", debit_open=MEASURES[0], credit_open=MEASURES[1], debit_turn=[MEASURES[2]],
                 credit_turn=[MEASURES[3]], debit_close=MEASURES[4], credit_close=MEASURES[5], suffix=AFTER)
    turn_after = "Оборот" + AFTER
    after = after.join(side_tot, on="file_name", how="left").withColumn(
        turn_after, F.when(F.col("__do").isNotNull() | F.col("__ko").isNotNull(),
                           (F.coalesce("__do", F.lit(0)) - F.coalesce("__ko", F.lit(0))).cast("decimal(38,2)"))
        .otherwise(F.col(turn_after))).drop("__do", "__ko")
    check = file_check(before, after, "file_name")
    levels = [f"Level_{k}" for k in range(depth + 1)]
    if align:
        flat = align_levels(flat, levels, ["file_name"])
    out = flat.withColumnRenamed("file_name", OUTLINE_FILE_COL)
    quarantine = no_header.unionByName(flat_outline).unionByName(no_total)
    return out, check, quarantine, kept


def general_balance(raw: DataFrame, *, dialect: str = "upp", scan_rows: int = OUTLINE_HEADER_SCAN_ROWS):
    """P-11 / P-12: general trial balances -> (flat, quarantine).  Columns are found by
    title: the account, its name (first dialect: in the row below the titles) and, below
    the period titles, debit and credit (O-6).  One-character accounts are padded, unnamed
    rows dropped (O-24); a file without the header or one of its titles is quarantined."""
    titles = ["Счет", BALANCE_OPEN_TITLE, BALANCE_TURN_TITLE_UPP if dialect == "upp" else BALANCE_TURN_TITLE_NONUPP,
              BALANCE_CLOSE_TITLE]
    hdr = header_rows(raw, F.exists(F.col("cells"), lambda c: F.trim(c) == "Счет"), scan_rows=scan_rows)
    below = (raw.join(hdr, on="file_name").where(F.col("row_no") == F.col("header_row") + 1)
             .select("file_name", F.col("cells").alias("sub_header")))
    hdr = hdr.join(below, on="file_name", how="left")

    def place(cells, title):
        return F.array_position(F.transform(cells, lambda c: F.trim(c)), F.lit(title)).cast("int")

    # the name stands below its title in the first dialect, beside the titles in the second
    name_at = place("sub_header", "Наименование") if dialect == "upp" else place("header", "Наименование счета")
    hdr = hdr.select("file_name", "header_row", *[place("header", t).alias(f"p{i}") for i, t in enumerate(titles)],
                     F.coalesce(name_at, F.lit(0)).alias("pn"))
    whole = hdr.where(" AND ".join(f"p{i} > 0" for i in range(len(titles))) + " AND pn > 0")
    files = raw.select("file_name").distinct()
    quarantine = (files.join(hdr, on="file_name", how="left_anti").withColumn("reason", F.lit("header row not found"))
                  .unionByName(_quarantine(hdr.join(whole, on="file_name", how="left_anti"), "required column not found")))
    d = raw.join(whole, on="file_name").where(F.col("row_no") > F.col("header_row") + 1)

    def at(p):
        return F.nullif(F.trim(F.try_element_at(F.col("cells"), p)), F.lit(""))
    acct = at(F.col("p0"))
    cols = {"Счет": F.when(F.length(acct) == 1, F.concat(F.lit("0"), acct)).otherwise(acct), "Наименование": at(F.col("pn"))}
    for i in range(3):
        for side in (0, 1):
            cols[MEASURES[2 * i + side]] = parse_number(at(F.col(f"p{i + 1}") + side), default_zero=False, scale=2)
    out = d.select(F.col("file_name").alias(OUTLINE_FILE_COL), "row_no", *[c.alias(n) for n, c in cols.items()])
    return out.where(F.col("Наименование").isNotNull()), quarantine


def combine(flats: list[DataFrame], desired: list[str], *, align_batch: bool = True) -> DataFrame:
    """P-13: union the flat tables of a kind (by name), order columns, and
    align account levels once more over the whole batch."""
    u = union_registers(flats)
    levels = sorted([c for c in u.columns if c.startswith("Level_")], key=lambda c: int(c.split("_")[1]))
    if align_batch and levels:
        u = align_levels(u, levels, [])
    return order_columns(u, desired)
