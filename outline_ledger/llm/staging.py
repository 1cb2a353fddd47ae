"""Lineage cuts for the multi-pass operators.

``stage`` writes a table under the cluster's shared ``spark.checkpoint.dir`` and
reads it back, so a lost executor costs only the tasks of the running job.  While
it writes, Spark's own clean-up of a finished query's shuffle files is on: what
the staged table was made from is never read again, so its shuffle files need
not stay on disk until the driver collects garbage.  ``unstage`` deletes a table
that every later step has replaced.
"""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def _conf(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def arrow_batches(spark: SparkSession, rows: int):
    """While it is entered, Arrow batches have at most ``rows`` rows."""
    return _conf(spark, ARROW_ROWS, str(rows))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder of the cluster."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, codec: str = "zstd", arrow_rows: int = 1000) -> DataFrame:
    """``arrow_rows``: rows of an Arrow batch while the table is made; few where rows are large."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    with _conf(spark, SHUFFLE_CLEANUP, "true"), _conf(spark, ARROW_ROWS, str(arrow_rows)):
        df.write.mode("overwrite").option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._llm_path = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables; only for those that no returned plan reads."""
    for t in tables:
        path = getattr(t, "_llm_path", None)
        if path:
            spark = t.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a join side that may be broadcast; larger sides are shuffled.
BROADCAST_ROWS = 1_000_000


def small_side(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to be small; else as it is (a shuffle join).

    Meant for staged tables of narrow rows, whose count is a metadata read.
    """
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df
