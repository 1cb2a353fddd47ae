"""Lineage cuts between chain steps.

Order-dependent steps read their input twice (the rows, and a per-block edge
table derived from them).  Chained without a cut, every step would recompute
all earlier ones.  ``stage`` writes the intermediate result as parquet under
the cluster's shared ``spark.checkpoint.dir`` and reads it back, so each step
is computed once, survives executor loss, and later steps rescan columnar
files (with column pruning and filter pushdown) instead of recomputing.

What a staged table was made from is not read again, so Spark's own clean-up of a finished
query's shuffle files is on while it is written; and code of more than 8000 bytes a method, which the JVM
would interpret, is not fused into one method then.  ``unstage`` deletes a table that every later step has replaced.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..session import ensure_checkpoint_dir

WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.codegen.hugeMethodLimit": "8000"}


def stage(df: DataFrame, name: str = "stage", partition_by: list[str] | None = None) -> DataFrame:
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{root}/outline_ledger/{name}-{uuid.uuid4().hex}"
    w = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    before = {k: spark.conf.get(k, None) for k in WRITING}
    try:
        for k, v in WRITING.items():
            spark.conf.set(k, v)
        w.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.parquet(path)
    out._staged_path = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables; only for those that no returned plan reads."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._staged_path)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
