"""S-3 / S-5: already-extracted registers and the header probe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import HEADER_PROBE_ROWS
from .workbook import RAW_SCHEMA


def read_raw_rows(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """raw_rows stored as parquet (or json); schema enforced, row order kept in
    ``row_no``."""
    return spark.read.schema(RAW_SCHEMA).format(fmt).load(path)


def rows_from_lines(df: DataFrame, *, line: str = "line", sep: str = r"\|") -> DataFrame:
    """Delimited text lines -> cells arrays (for CSV-like exports)."""
    return df.withColumn("cells", F.split(F.col(line), sep)).drop(line)


def header_probe(raw: DataFrame, rows: int = HEADER_PROBE_ROWS, row_col: str = "row_no") -> DataFrame:
    """S-5: the first rows of every file (pushed down as a row_no filter)."""
    return raw.where(F.col(row_col) <= rows)
