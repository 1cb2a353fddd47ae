"""Incremental processing of a folder of raw registers.

The source processes whole files; here new raw_rows parquet files arriving in
a folder are picked up by Structured Streaming and each micro-batch (whole
files only: every parquet file holds complete registers) goes through the
batch pipeline and the sinks via ``foreachBatch``.  Progress lives in the
checkpoint location (use the shared ``spark.checkpoint.dir``), so a restarted
query resumes without reprocessing.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.workbook import RAW_SCHEMA
from ..sources.sinks import write_register


def process_folder(spark: SparkSession, src: str, out: str, checkpoint: str,
                   pipeline: Callable[[DataFrame], DataFrame], *, available_now: bool = True,
                   max_files_per_trigger: int | None = None):
    """Start a stream that flattens every new raw_rows file with ``pipeline``
    and writes each epoch's result under ``out/epoch=<n>``: a retried epoch
    replaces its own rows."""
    reader = spark.readStream.schema(RAW_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(src)

    def run(batch: DataFrame, epoch: int) -> None:
        if batch.isEmpty():
            return
        write_register(pipeline(batch), f"{out.rstrip('/')}/epoch={epoch}")

    w = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
