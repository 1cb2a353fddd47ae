"""The balances' rows of money from one exchange equal the operators run one after the other, whatever the blocks."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from outline_ledger.constants import CUR_PREFIX, MEASURES, NOT_FILLED, QTY_PREFIX, QUANTITY
from outline_ledger.operators.ordered import RowOrder, ordinal
from outline_ledger.plans import balances
from outline_ledger.plans.derived import lineitem_money, lineitem_outline, lineitem_outline_sql, numbered

SCHEMA = ("file_name string, row_no long, level int, marked boolean, label string, what string, "
          + ", ".join(f"`{m}` decimal(18,4)" for m in MEASURES) + ", contra_values array<decimal(18,4)>")


def _rows(seed):
    rnd = random.Random(seed)
    rows = []
    for f, n, marked in (("plain", 160, False), ("marked", 90, True), ("one", 1, False), ("deep", 40, False)):
        for i in range(n):
            label = rnd.choice([None, None, None, QUANTITY, "60", "7", "60.01", "x", "Валютная сумма", "Валюта USD"])
            if f == "plain" and i in (100, 140):
                label = "Итого"
            what = rnd.choice([None, "quantity", "currency", "quantity"]) if marked else None
            rows.append((f, i * 3 + i % 2, rnd.randint(0, 3) + (f == "deep"), marked, label, what,
                         *[rnd.choice([None, Decimal(i)]) for _ in MEASURES], [Decimal(i)]))
    return rows


def _one_by_one(rows, width=3):
    """The rows of money by a plain walk over each file."""
    out = []
    for f in sorted({r[0] for r in rows}):
        mine = [dict(zip(["file", "no", "level", "marked", "label", "what", *MEASURES, "contra"], r)) for r in rows if r[0] == f]
        total = min((r["no"] for r in mine if r["label"] == "Итого"), default=None)
        kept, above = [], None
        for r in mine:
            label = r["label"]
            if not r["marked"]:
                r["what"] = ("quantity" if label == QUANTITY or label is None and r["level"] == above else "currency" if label == "Валютная сумма"
                             else "name" if label and label.startswith("Валюта") else "money")
            r["what"] = r["what"] or "money"
            above = r["level"]
            if not (r["what"] == "quantity" and not r["marked"] and total is not None and r["no"] > total):
                kept.append(r)
        path = {}
        money = [i for i, r in enumerate(kept) if r["what"] == "money"]
        for i in money:
            r = kept[i]
            name = "07" if r["label"] == "7" else r["label"] or NOT_FILLED
            path[r["level"]] = name
            below = []
            for x in kept[i + 1:i + 1 + width]:
                if x["what"] == "money":
                    break
                below.append(x)
            first = {w: next((x for x in below if x["what"] == w), None) for w in ("quantity", "currency", "name")}
            after = next((kept[j]["level"] for j in money if j > i), None)
            out.append((f, r["no"], name, after, *[path.get(k) if k <= r["level"] else None for k in range(5)],
                        first["quantity"] and first["quantity"][MEASURES[0]], first["currency"] and first["currency"][MEASURES[3]],
                        first["currency"] and first["currency"]["contra"], first["name"] and first["name"]["label"]))
    return out


@pytest.mark.parametrize("seed, block_rows", [(1, 1), (2, 5), (3, 17), (4, 100), (5, 1 << 17)])
def test_rows_of_money_by_blocks(spark, monkeypatch, seed, block_rows):
    monkeypatch.setattr(balances, "BLOCK_ROWS", block_rows)
    rows = _rows(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    kind = balances.ACCOUNT_BALANCE["upp"]
    got = balances.money_rows(df, balances._block_facts(df), kind, 4).select(
        "file_name", "row_no", "label", "next_level", *[f"Level_{k}" for k in range(5)], QTY_PREFIX + MEASURES[0], CUR_PREFIX + MEASURES[3],
        "contra_currency", balances.CURRENCY_NAME)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(tuple(
        x if not isinstance(x, Decimal) else x.quantize(Decimal("0.0001")) for x in r)).replace("[Decimal('", "[Decimal('") if r[-2] is None else
        str(tuple([x.quantize(Decimal("0.0001")) if isinstance(x, Decimal) else x for x in r[:-2]] + [[v.quantize(Decimal("0.0001")) for v in r[-2]], r[-1]]))
        for r in _one_by_one(rows))


def test_register_is_shuffled_once_by_blocks(spark):
    df = spark.createDataFrame(_rows(6), SCHEMA)
    facts = balances._block_facts(df)
    text = balances.row_kinds(df, facts, balances.TURNOVER["upp"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and text.split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1


def _line_items(spark, tmp_path):
    rnd = random.Random(3)
    maybe = [None] + [1] * 20
    rows = [(rnd.randint(1, 60), rnd.choice([None, *range(1, 30)]), rnd.randint(1, 3) if rnd.choice(maybe) else None, float(rnd.randint(1, 50)),
             rnd.randint(100, 99999) / 100 if rnd.choice(maybe) else None, rnd.choice(["A", "N", "R", None]), rnd.choice(["O", "F", None]))
            for _ in range(600)]
    spark.createDataFrame(rows + rows[:50], "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                                            "l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")


def test_register_from_one_exchange_equals_its_sql(spark, tmp_path):
    _line_items(spark, tmp_path)
    spark.read.parquet(f"{tmp_path}/lineitem.parquet").createOrReplaceTempView("lineitem")
    want, got = spark.sql(lineitem_outline_sql()), lineitem_outline(spark, str(tmp_path))
    assert got.dtypes == want.dtypes
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_numbers_of_money_rows_are_those_of_the_register(spark, tmp_path):
    """Also where keys are null or repeat; and the rows stay where their grouping put them."""
    _line_items(spark, tmp_path)
    money = lineitem_money(spark, str(tmp_path), 8)
    at = Window.partitionBy("file_name", "k1", "k2", "b").orderBy("k3", "k4")
    plan = money.withColumn("n", F.row_number().over(at))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "Exchange" not in plan.split("Union")[0]
    rows = [F.struct(F.lit(k).alias("k5")) for k in (0, 1)]
    got = numbered(money, [(F.col("file_name") == "turnover_R", [*rows, F.struct(F.lit(2).alias("k5"))]), (F.lit(True), rows)])
    reg = lineitem_outline(spark, str(tmp_path))
    reg = reg.unionByName(reg.where("k5 = 1 AND file_name = 'turnover_R'").withColumn("k5", F.lit(2).cast("long")))
    want = ordinal(reg, "row_no", RowOrder("file_name", ("k1", "k2", "k3", "k4", "k5"), ("k1", "k2", "b3")))
    keys = ["file_name", "k1", "k2", "k3", "k4", "k5", "row_no"]
    assert sorted(got.select(*keys).collect(), key=str) == sorted(want.select(*keys).collect(), key=str)


def test_register_is_ordered_where_it_was_grouped(spark, tmp_path):
    """Rows of the register's blocks are together already: no exchange comes between the grouping and windows by block."""
    _line_items(spark, tmp_path)
    marked = lineitem_outline(spark, str(tmp_path)).withColumn("above", F.lag("level").over(
        Window.partitionBy("file_name", "k1", "k2", "b3").orderBy("k3", "k4", "k5")))
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan and "Exchange" not in plan.split("Union")[0]


def test_ordinal_with_null_keys(spark):
    rows = [(f, i, k) for f in ("a", None) for k in (None, "x", "y") for i in range(7)]
    df = spark.createDataFrame(rows, "file_name string, row_no long, k string")
    got = ordinal(df, "n", RowOrder(block_rows=3), ["k"], F.col("row_no") != 2)
    assert {(r.file_name, r.k, r.row_no, r.n) for r in got.collect()} == {
        (f, k, i, None if i == 2 else i + 1 - (i > 2)) for f, i, k in rows}


def test_sums_of_more_than_18_digits(spark, tmp_path):
    rows = [(1, 5, 1, 1.0, 9e15, "A", s) for s in "OOFF"] + [(2, 5, 1, 2.0, 1.5, "A", "O")]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                                "l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.read.parquet(f"{tmp_path}/lineitem.parquet").createOrReplaceTempView("lineitem")
    want, got = spark.sql(lineitem_outline_sql()), lineitem_outline(spark, str(tmp_path))
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    assert lineitem_money(spark, str(tmp_path)).where("wide IS NOT NULL").count() > 0


def test_numbers_alone_need_no_sums(spark, tmp_path):
    """A pass over places in the register (its header rows) makes no measures."""
    _line_items(spark, tmp_path)
    rows = [F.struct(F.col("q_dt").alias("x")), F.struct(F.col("q_kt").alias("x"))]
    out = numbered(lineitem_money(spark, str(tmp_path), 8), [(F.lit(True), rows)])
    plan = out.select("file_name", "row_no")._jdf.queryExecution().optimizedPlan().toString()
    assert "q_dt" not in plan.split("Relation")[0] and "Generate" not in plan


def test_a_register_writes_its_rows_of_money_once(spark, monkeypatch):
    """Typed rows are deleted when they are ordered, leaves are read from the ordered rows."""
    staged, stage = {}, balances.stage
    monkeypatch.setattr(balances, "stage", lambda df, name: staged.setdefault(name, stage(df, name)))
    sub = ["Дебет", "Кредит"] * 3
    kind = balances.ACCOUNT_BALANCE["upp"]
    titles = [x for t in kind.periods for x in (t, None)]
    raw = [("a", 1, 0, ["Субконто", *titles]), ("a", 2, 0, [None, *sub]), ("a", 3, 0, ["60", *"123456"]), ("a", 4, 1, ["x", *"123456"]),
           ("a", 5, 1, [None, *"000011"]), ("a", 6, 0, ["Итого", *"123456"])]
    df = spark.createDataFrame([(f, n, lv, False, c) for f, n, lv, c in raw],
                               "file_name string, row_no long, level int, italic boolean, cells array<string>")
    flat, check, bad = balances.account_balance(df)
    assert [(r["Субконто"], r["Level_0"], r["Level_1"], r["Дебет_конец"], r["Количество_Дебет_конец"]) for r in flat.collect()] == \
        [("x", "60", "x", Decimal(5), Decimal(1))]
    assert bad.count() == 0 and check.count() == 1
    assert "leaves" not in staged and not spark._jvm.java.io.File(staged["rows"]._staged_path.removeprefix("file:")).exists()
    assert not any(f.dataType.typeName() == "struct" for f in staged["kinds"].schema.fields)
