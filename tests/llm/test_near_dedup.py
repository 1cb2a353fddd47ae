import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from outline_ledger.llm import links, near_dedup as N, words as W


def sets_of(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_force(rows, k, percent):
    """doc_id -> (set size, component) by comparing all pairs."""
    sets = {}
    for d, t in rows:
        sets.setdefault(d, []).append(sets_of(t, k))
    up = {d: d for d in sets if d is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = list(up)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            for s in sets[a]:
                for t in sets[b]:
                    if s and t and 100 * len(s & t) >= percent * len(s | t):
                        x, y = root(a), root(b)
                        up[max(x, y)] = min(x, y)
    return {d: root(d) for d in ids}, sets


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_equals_brute_force(spark, k, percent):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rnd, rows = random.Random(4), [(r["doc_id"], r["text"]) for r in docs.collect()]
    base = [f"v{rnd.randrange(400)}" for _ in range(80)]  # a family of near copies at many similarities
    for i in range(60):
        w = list(base)
        for _ in range(rnd.randrange(6)):
            w[rnd.randrange(80)] = f"z{rnd.randrange(9)}"
        rows.append((10_000 + i, " ".join(w)))
    comp, sets = brute_force(rows, k, percent)
    got = N.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), k, percent).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == comp
    assert all(r["n_shingles"] == len(sets[r["doc_id"]][0]) and r["kept"] == (comp[r["doc_id"]] == r["doc_id"]) for r in got)


def test_odd_rows(spark, odd_docs, no_docs):
    got = N.near_duplicates(odd_docs, 3, 85).collect()
    comp, _ = brute_force([(r["doc_id"], r["text"]) for r in odd_docs.collect()], 3, 85)
    assert len(got) == odd_docs.count()
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == comp
    assert {(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None} == {(1, False), (None, False)}
    assert N.near_duplicates(no_docs).count() == 0


def test_word_hashes_are_per_word():
    texts = ["A bc\x0bA", "", None, "bc", "\t x" * 1000, "é" * 30]
    import pyarrow as pa
    (_, _, buf, at), = W.text_slices(pa.array(texts))
    h, first = W.word_hashes(buf, at)
    flat = [w for t in texts for w in (t or "").encode().lower().split()]
    assert len(h) == len(flat) and len(set(zip(flat, h.tolist()))) == len(set(flat)) == len(set(h.tolist()))
    assert list(np.diff(first)) == [len((t or "").split()) for t in texts]


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 4000)]
    got = {r["node"]: r["comp"] for r in links.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[i] == 1000 for i in range(1000, 1300))
    assert got[5000] == got[4000] == 4000
    assert links.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_sketch_bound_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(0)
    bound = N.max_xor_bits(85, 80, 512)
    offs, sets = [0], []
    for _ in range(400):  # pairs of Jaccard 0.85 or a little more
        n = int(rng.integers(20, 400))
        d = int(n * 0.15 / 1.15)
        common = rng.integers(1, 2**63, n, dtype=np.uint64)
        for _ in range(2):
            sets.append(np.sort(np.concatenate([common[d // 2 * 2:], rng.integers(1, 2**63, d // 2, dtype=np.uint64)])))
            offs.append(offs[-1] + len(sets[-1]))
    sk = N.odd_sketch(N.minhash(np.concatenate(sets), np.array(offs), 80), 512).view(np.uint64)
    assert np.bitwise_count(sk[::2] ^ sk[1::2]).sum(axis=1).max() <= bound


def test_extra_columns_do_not_matter(spark, odd_docs):
    plain = odd_docs.select("doc_id", "text")
    rows = [sorted(map(str, N.near_duplicates(d, 3, 85).collect())) for d in (plain, odd_docs.withColumn("bands", F.lit(1)))]
    assert rows[0] == rows[1]
