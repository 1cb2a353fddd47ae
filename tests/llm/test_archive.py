import base64
import glob
import hashlib
import io
import zipfile

import pytest

from outline_ledger.llm import archive as A


def digest(x):
    return base64.b32encode(hashlib.sha1((x or "").encode()).digest()).decode()


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_writer_and_reader(zip64):
    z = A.ZipWriter(zip64)
    z.add("a", b"abc")
    z.add("é/b", b"")
    raw = z.finish(b"\n")
    other = zipfile.ZipFile(io.BytesIO(raw))
    assert other.testzip() is None and other.read("a") == b"abc" and other.comment == b"\n"
    r = A.ZipReader(lambda at, n: raw[at:at + n], len(raw))
    assert r.member("a") == b"abc" and r.member("é/b") == b"" and raw[r.place("a")[0]:][:3] == b"abc"
    damaged = raw.replace(b"abc", b"abd")
    with pytest.raises(ValueError):
        A.ZipReader(lambda at, n: damaged[at:at + n], len(damaged)).member("a")
    with pytest.raises(ValueError):
        A.ZipReader(lambda at, n: b"x" * n, 50)


def test_reads_archives_of_others():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("x", "hello")
    raw = out.getvalue()
    assert A.ZipReader(lambda at, n: raw[at:at + n], len(raw)).member("x") == b"hello"


def test_round_trip(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = pages.union(pages.where("page_id < 40").selectExpr("page_id + 100000", "url", "html")).collect()
    df = spark.createDataFrame(rows, pages.schema).repartition(3)
    got = {r["page_id"]: r for r in A.archive_round_trip(df).collect()}
    first = {}
    for r in sorted(rows, key=lambda r: r["page_id"]):
        first.setdefault(r["html"], r["page_id"])
    for r in rows:
        g, f = got[r["page_id"]], first[r["html"]]
        assert (g["payload_bytes"], g["payload_digest"]) == (len(r["html"].encode()), digest(r["html"]))
        assert (g["record_type"], g["refers_to"]) == (("response", None) if f == r["page_id"] else ("revisit", f))


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "u\r\nv", ""), (3, "u", "<p>é\r\n\r\nWARC/1.1" * 3000), (4, "u", "<p>é\r\n\r\nWARC/1.1" * 3000),
            (4, "u", "<p>é\r\n\r\nWARC/1.1" * 3000), (None, "u", ""), (5, "u", "x"), (5, "u", "x")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS sha1", "2 AS first")
    got = sorted((r["page_id"] or 0, r["payload_digest"], r["record_type"], r["refers_to"]) for r in A.archive_round_trip(df).collect())
    e, t, x = digest(""), digest(rows[2][2]), digest("x")
    assert got == sorted([(1, e, "response", None), (2, e, "revisit", 1), (3, t, "response", None), (4, t, "revisit", 3),
                          (4, t, "revisit", 3), (0, e, "response", None), (5, x, "response", None), (5, x, "response", None)],
                         key=lambda r: r[:3])
    path = A.write_archives(df, least_bytes=5, archive_bytes=100, zip64=True)
    full = {r["page_id"]: r for r in A.read_archives(spark, path).collect()}
    assert full[2]["record_type"] == "response" and full[3]["payload"].decode() == rows[2][2] and full[4]["payload"] == b""
    assert all(zipfile.ZipFile(f).testzip() is None for f in glob.glob(path.removeprefix("file:") + "/*.txt"))
    assert A.archive_round_trip(df.where("false")).count() == 0
