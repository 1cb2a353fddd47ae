import collections
import math
import zlib

import pytest
from pyspark.sql import functions as F

from outline_ledger.llm.lm_scoring import lm_scores


def brute_force(rows):
    """doc -> (n_tokens, n_known, N, base, score) by dictionaries."""
    tokens = [(d, (t or "").encode().lower().split() + [None], train) for d, t, train in rows]
    c, b, starts = collections.Counter(), collections.Counter(), 0
    for _, t, train in tokens:
        if train:
            c.update(t)
            b.update(zip([0] + t[:-1], t))
            starts += 1
    n, v = sum(c.values()), len(c)
    follow = collections.Counter(u for u, _ in b)
    n1, n2 = (sum(x == k for x in b.values()) for k in (1, 2))
    disc = n1 / (n1 + 2 * n2) if n1 else 0.5
    out = []
    for d, t, _ in tokens:
        base = score = 0.0
        for u, w in zip([0] + t[:-1], t):
            p = (c[w] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            cu = starts if u == 0 else c[u]
            if cu and follow[u]:
                p = max(b[u, w] - disc, 0) / cu + disc * follow[u] / cu * p
            score += math.log10(p)
        out.append((d, len(t), sum(c[w] > 0 for w in t), n, base, score))
    return out


def compare(got, want):
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got), key=str)
    want = sorted(want, key=str)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda x: (str(x[0]), x[1])), sorted(want, key=lambda x: (str(x[0]), x[1]))):
        assert g[:4] == w[:4] and g[4:] == pytest.approx(w[4:], rel=1e-9)


@pytest.mark.parametrize("chunk, buckets", [(5_000, 3), (100_000, 7)])
def test_equals_brute_force(spark, chunk, buckets):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"], zlib.crc32(str(r["doc_id"]).encode()) % 5 != 1) for r in docs.collect()]
    got = lm_scores(docs.withColumn("train", F.expr("crc32(cast(doc_id AS string)) % 5 <> 1")), chunk, buckets).collect()
    compare(got, brute_force(rows))
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_odd_rows(spark, odd_docs, no_docs):
    df = odd_docs.withColumn("train", F.expr("doc_id % 3 <> 0"))
    rows = [(r["doc_id"], r["text"], bool(r["train"])) for r in df.collect()]
    compare(lm_scores(df, 50_000, 4).collect(), brute_force(rows))
    assert lm_scores(no_docs.withColumn("train", F.lit(True))).count() == 0
    none = lm_scores(odd_docs.withColumn("train", F.lit(False)), buckets=4).collect()
    assert {(r["train_tokens"], r["n_known"], r["score"]) for r in none} == {(0, 0, 0.0)}
