import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from outline_ledger.llm import collocations as C
from outline_ledger.llm import queries as Q

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows, least=10, top=2000):
    """(lang, text) rows -> the contract's result, phrases of each length counted on their own."""
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f[lang, *words[i:i + k]] += 1
    found = {k: v for k, v in f.items() if len(k) > 2 and v >= least}
    out, within = [], collections.defaultdict(int)
    for (lang, *w), b in found.items():
        for part in (w[:2], w[1:]) if len(w) == 3 else ():
            within[lang, *part] = max(within[lang, *part], b)
    for (lang, *words), a in found.items():
        if len(words) == 2 and 100 * within[lang, *words] >= 50 * a:
            continue
        cuts = [(1000000 * a * a // (f[lang, *words[:k]] * f[lang, *words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.append((lang, " ".join(words), a, f[lang, *words[:k]], f[lang, *words[k:]], n[lang], score))
    ranked = []
    for lang in n:
        of = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(r[0], i + 1, *r[1:]) for i, r in enumerate(of)]
    return sorted(ranked)


def check(spark, rows, **more):
    df = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(r) for r in C.collocations(df, **more).collect()) == by_hand(rows, **more)


def random_rows(seed, n):
    rng = random.Random(seed)
    words = ["The", "quick", "brown", "FOX", "été", "漢字", "a", "b", "c's", "x-y"]
    return [(rng.choice(["en", "fr", None, "und", ""]),
             "".join(rng.choice(words[:rng.choice([3, 6, 10])]) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", " \x0b"])
                     for _ in range(rng.randrange(60)))) for _ in range(n)]


def test_equals_brute_force(spark):
    check(spark, random_rows(1, 300))
    check(spark, random_rows(2, 40), least=3, top=7)


def test_chunks_slices_and_long_texts(spark, monkeypatch):
    rows = random_rows(3, 60)
    rows += [("en", "the quick brown fox. " * 4000), ("en", "the quick " * 3000), ("en", "x" * 50_000), (None, None), ("en", "")]
    told = by_hand(rows)
    # the arrays are made in this process, so that the small limits hold
    monkeypatch.setattr(C, "CHUNK_WORDS", 7)
    monkeypatch.setattr(C, "SLICE_BYTES", 64)
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] or "und" for r in rows]), pa.array([r[1] for r in rows])], ["lang", "text"])
    got = collections.Counter()
    slices = list(C._slices(batch))
    for i in range(0, len(slices), 50):
        part = slices[i:i + 50]
        for k in range(3):
            for b in C._windows([x[0] for x in part], [x[1] for x in part], k, 3):
                for r in b.to_pylist():
                    got[r["lang"], r["w1"], r["w2"], r["w3"]] += r["n"]
    want = collections.Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            want.update((lang or "und", *(w[i:i + 3] + ["", ""])[:3]) for i in range(len(w)))
    assert got == want
    monkeypatch.undo()
    df = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(r) for r in C.collocations(df).collect()) == told


def test_products_past_64_bits(spark):
    """Counts of billions: the score is exact."""
    df = spark.createDataFrame([("en", "a", "b", "", 4_000_000_007), ("en", "b", "", "", 3_999_999_999)],
                               "lang string, w1 string, w2 string, w3 string, n long")
    a, b = 4_000_000_007, 4_000_000_007 + 3_999_999_999
    with pytest.MonkeyPatch.context() as m:
        windows = df.union(df.sparkSession.createDataFrame([("en", "b", "", "", a)], df.schema))
        m.setattr(C, "count_windows", lambda docs, part, parts: windows.where(str(part == 0)))
        got = C.collocations(df.select("lang", F.lit("").alias("text"))).collect()
    assert [tuple(r)[2:] for r in got] == [("a b", a, a, b, a + b, 1000000 * a * a // (a * b))]


def test_empty_and_clashing_columns(spark, odd_docs, no_docs):
    assert C.collocations(no_docs).count() == 0
    more = odd_docs.withColumns({c: F.lit("z") for c in ("w1", "w2", "w3", "words", "phrase", "rank")})
    rows = [(r.lang, r.text) for r in odd_docs.collect()]
    assert sorted(tuple(r) for r in C.collocations(more, least=2).collect()) == by_hand(rows, least=2)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text").collect()]
    assert sorted(tuple(r) for r in Q.QUERIES["op12_collocations"](spark, sf).collect()) == by_hand(rows)
