import numpy as np
import pytest

from outline_ledger.llm import topk_search as K


def brute_force(rows, queries, k):
    q = [(i, np.floor(np.array(v, float) * 256).astype(int)) for i, v in rows
         if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, v in q:
        if i in queries:
            best = sorted((-int(x @ v), j) for j, x in q if j != i and len(x) == len(v))[:k]
            out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(best)}
    return out


@pytest.mark.parametrize("block, qblock", [(40, 7), (1000, 100)])
def test_equals_brute_force(spark, block, qblock):
    rng = np.random.default_rng(2)
    rows = [(i, np.round(rng.standard_normal(9) * (3 if i % 7 else 0), 1).tolist()) for i in range(300)]
    rows += [(1000, None), (1001, [1.0, None]), (1002, [float("nan")] * 9), (1003, [float("inf")] * 9), (None, [1.0] * 9),
             (1004, []), (50_000, [1.0, 2.0]), (1006, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 AS block", "2 AS q")
    got = {tuple(r) for r in K.top_k(df, df.where("vec_id % 50 = 0"), 5, 256, block, qblock).collect()}
    assert got == brute_force(rows, set(range(0, 50_001, 50)), 5)


def test_ties_repeats_and_no_rows(spark):
    rows = [(i, [0.5, -0.25]) for i in (0, 3, 3, 1, 2, 9, 8, 7)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = [tuple(r)[1:3] for r in K.top_k(df, df.where("vec_id = 0"), 5).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 2), (3, 3), (4, 3), (5, 7)]
    assert K.top_k(df.where("false"), df.where("false")).count() == 0


def test_slices():
    rng = np.random.default_rng(3)
    x, q = rng.integers(-300, 300, (130, 6)), rng.integers(-300, 300, 6)
    bitmaps, low, bits = K.slices_of(x)
    total = sum(np.unpackbits(s.view(np.uint8), bitorder="little")[:130].astype(np.int64) << i
                for i, s in enumerate(K.score_slices(bitmaps, q)))
    want = x @ q
    assert len(set(total - want)) == 1 and set(K.top_rows(K.score_slices(bitmaps, q), 130, 4)) == set(
        np.flatnonzero(want >= np.sort(want)[-4]))


def test_large_components(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(4) * 10.0 ** rng.integers(0, 17)).tolist()) for i in range(120)]
    rows += [(200, [3e16] * 4), (250, [-3e16, 3e16, 3e16, 3e16]), (300, [1e16] * 4), (301, [1e300, -1e300, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    top, low = (1 << 63) - 1, -(1 << 63)

    def whole(v):
        return [max(low, min(top, int(np.floor(np.float64(c) * 256)))) for c in v]

    q = {i: whole(v) for i, v in rows}
    want = set()
    for i in range(0, 301, 50):
        if i in q:
            best = sorted((-sum(a * b for a, b in zip(q[i], x)), j) for j, x in q.items() if j != i)[:5]
            want |= {(i, n + 1, j, max(low, min(top, -s))) for n, (s, j) in enumerate(best)}
    got = K.top_k(df, df.where("vec_id % 50 = 0"), 5, 256, 40, 3).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and any(r["score"] == top for r in got)
