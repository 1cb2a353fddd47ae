import tempfile

from pyspark.sql import functions as F

from outline_ledger.streaming.folder import process_folder


def test_folder_stream_processes_whole_files(spark):
    src, out, ck = (tempfile.mkdtemp(prefix=p) for p in ("src-", "out-", "ck-"))
    rows = [("f1", 1, 0, False, ["60", "1"]), ("f1", 2, 1, False, ["60.01", "1"]),
            ("f2", 1, 0, False, ["62", "2"])]
    spark.createDataFrame(rows, "file_name string, row_no long, level int, italic boolean, cells array<string>") \
        .write.mode("append").parquet(src)

    def pipeline(b):
        return b.select("file_name", "row_no", F.col("cells")[0].alias("label"))
    q = process_folder(spark, src, out, ck, pipeline)
    q.awaitTermination(120)
    got = sorted((r.file_name, r.row_no, r.label) for r in spark.read.parquet(out).collect())
    assert got == [("f1", 1, "60"), ("f1", 2, "60.01"), ("f2", 1, "62")]
