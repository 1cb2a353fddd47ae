"""Block-wise ordered primitives must equal plain whole-file windows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from outline_ledger.operators.ordered import RowOrder, ffill, first_in_order, last_rows, ordinal, shift


def _table(spark, n=400, files=3, seed=7, gaps=True):
    rnd = random.Random(seed)
    rows = []
    for f in range(files):
        rn = 0
        for _ in range(n if f else n // 7):  # uneven files
            rn += rnd.choice([1, 1, 1, 5, 40]) if gaps else 1
            v = rnd.choice([None, None, rnd.randint(0, 9)])
            key = rnd.choice(["a", "b", None])
            rows.append((f"f{f}", rn, v, key))
    return spark.createDataFrame(rows, "file_name string, row_no long, v int, k string")


def _plain(df):
    w = Window.partitionBy("file_name").orderBy("row_no")
    return df.select(
        "file_name", "row_no",
        F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("ff"),
        F.lead("v", 1).over(w).alias("ld1"),
        F.lead("v", 2).over(w).alias("ld2"),
        F.lag("v", 1).over(w).alias("lg1"),
        F.lag("v", 3).over(w).alias("lg3"),
    )


def test_ffill_and_shift_match_plain_windows(spark):
    df = _table(spark)
    for block_rows in (3, 17, 1 << 20):
        order = RowOrder(block_rows=block_rows)
        got = ffill(df, {"ff": F.col("v")}, order)
        got = shift(got, {"ld1": (F.col("v"), 1), "ld2": (F.col("v"), 2),
                          "lg1": (F.col("v"), -1), "lg3": (F.col("v"), -3)}, order)
        got = got.select("file_name", "row_no", "ff", "ld1", "ld2", "lg1", "lg3")
        exp = _plain(df)
        assert sorted(got.collect()) == sorted(exp.collect()), block_rows


def test_ordinal_matches_row_number(spark):
    df = _table(spark, seed=11)
    w = Window.partitionBy("file_name", "k").orderBy("row_no")
    exp = df.where("v is not null").select("file_name", "row_no", F.row_number().over(w).alias("n"))
    exp = {(r.file_name, r.row_no): r.n for r in exp.collect()}
    for block_rows in (5, 1 << 20):
        got = ordinal(df, "n", RowOrder(block_rows=block_rows), keys=["k"], where=F.col("v").isNotNull())
        res = {(r.file_name, r.row_no): r.n for r in got.collect()}
        for key, n in res.items():
            assert n == exp.get(key), (key, n, exp.get(key))


def test_first_in_order_and_last_rows(spark):
    df = _table(spark, seed=3)
    first = first_in_order(df, ["k"], RowOrder())
    w = Window.partitionBy("file_name", "k").orderBy("row_no")
    exp = df.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
    assert sorted(first.collect()) == sorted(exp.select(*first.columns).collect())
    tail = last_rows(df, RowOrder(block_rows=7), 2).drop("__from_end")
    wd = Window.partitionBy("file_name").orderBy(F.desc("row_no"))
    exp2 = df.withColumn("r", F.row_number().over(wd)).where("r <= 2").drop("r")
    assert sorted(tail.collect()) == sorted(exp2.collect())
