import os

import pytest
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))


@pytest.fixture(scope="session", autouse=True)
def _workers_find_the_package(spark):
    spark.sparkContext.environment["PYTHONPATH"] = ROOT


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls, empty and very long texts, ties, repeated rows and clashing names."""
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    rows = [(1, base), (2, base), (2, base), (3, base + " phi"), (4, None), (5, ""), (6, "  \n\t "), (7, LONG), (8, LONG + " end"),
            (None, base), (None, None), (9, "one"), (10, "one"), (11, "Two words"), (12, "été naïve 漢字漢字漢字\nline\nline"),
            (13, "x" * 5000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    extra = {c: F.lit(7) for c in ("node", "key", "label", "n", "comp", "h1", "score", "leak", "part", "train", "a", "b")}
    return df.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s")} | extra)


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.where("false")
