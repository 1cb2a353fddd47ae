"""What keeps a hot file spread over tasks, and what is shuffled and staged, of journals and analyses."""
from pyspark.sql import functions as F

from outline_ledger.constants import ANALYSIS_FROM_CREDIT, ANALYSIS_TO_DEBIT
from outline_ledger.operators.ordered import RowOrder, ordinal, with_file_facts
from outline_ledger.plans import checks_journal, journals
from outline_ledger.plans.analysis import resolve_analysis
from tests.conftest import SF_SMALL

ORDER = RowOrder("file_name", ("row_no",), block_rows=4)


def test_rows_meet_their_files_facts_by_block(spark):
    df = spark.createDataFrame([("hot", n) for n in range(400)] + [("b", 1), ("c", 2), (None, 1), ("hot", None)], "file_name string, row_no long")
    facts = spark.createDataFrame([("hot", 1), ("b", 2)], "file_name string, fact int")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        out = with_file_facts(df, facts, ORDER)
        tasks = {r[0] for r in out.where("file_name = 'hot'").select(F.spark_partition_id()).distinct().collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(tasks) > 4
    assert out.columns == ["file_name", "row_no", "fact"]
    got = [tuple(r) for r in out.collect()]
    assert sorted(got) == sorted([("hot", n, 1) for n in range(400)] + [("b", 1, 2)])


def test_uncounted_rows_are_not_shuffled(spark):
    rows = [("a", n, "d" if n % 10 == 0 else None) for n in range(300)] + [(None, 1, "d"), (None, 2, None)]
    df = spark.createDataFrame(rows, "file_name string, row_no long, document string").repartition(3).localCheckpoint()
    out = ordinal(df, "n", ORDER, keys=["document"], where=F.col("document").isNotNull())
    got = {(r.file_name, r.row_no): r.n for r in out.collect()}
    assert got == {(f, n): (n // 10 + 1 if f else 1) if d else None for f, n, d in rows}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        again = ordinal(df, "n", ORDER, keys=["document"], where=F.col("document").isNotNull())
        plan = again._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "Union" in plan


def test_an_entrys_texts_are_dealt_by_entry_alone(spark):
    rows = spark.createDataFrame([("f", "e", n, f"t{n % 3}", "e") for n in range(5)], "file_name string, entry_id string, row_no long, x string, y string")
    rows = rows.withColumn("date", F.current_timestamp()).localCheckpoint()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = journals._entry_texts(rows, ["x", "y"])
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") <= 2  # one for each side of the union
    assert [(r.x, r.y) for r in out.collect()] == [(["t0", "t1", "t2", None, None], [None] * 5)]


def test_entry_lines_stage_what_they_need(spark, monkeypatch):
    staged, stage = {}, checks_journal.stage
    monkeypatch.setattr(checks_journal, "stage", lambda df, name: staged.update({name: df.columns}) or stage(df, name))
    checks_journal.entry_lines(spark, SF_SMALL)
    needed = sorted([*checks_journal.KEYS, "text", "entry_id", "date"])
    assert {name: sorted(cols) for name, cols in staged.items()} == {"ids": needed, "filled": needed}


def test_rows_of_an_analysis_are_spread(spark):
    head = ["Счет", "Кор.счет", ANALYSIS_FROM_CREDIT, ANALYSIS_TO_DEBIT]
    rows = [("hot", 1, 0, False, head)] + [("hot", 5 + (k << 17), 1, False, ["60", "51", "1", "2"]) for k in range(40)]
    raw = spark.createDataFrame(rows, "file_name string, row_no long, level int, italic boolean, cells array<string>")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        found, bad = resolve_analysis(raw, "upp")
        tasks = found.groupBy(F.spark_partition_id()).count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(r["count"] for r in tasks) == 40 and len(tasks) > 3
    assert bad.count() == 0
