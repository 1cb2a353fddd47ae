import numpy as np

from outline_ledger.llm import queries, toxicity as T


def test_block_max_index_is_exact():
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(700):
        f = np.sort(rng.choice(60, rng.integers(1, 8), replace=False))
        w = rng.random(len(f))
        rows.append((f, w / np.linalg.norm(w)))
    index = T.BlockMaxIndex(rows, np.arange(700) % 2, list(range(700)), 60)
    dense = np.zeros((700, 60))
    for i, (f, w) in enumerate(rows):
        dense[i, f] = w
    for f, w in rows[:50]:
        e, sim = index.nearest(f, w, 25)
        want = np.sort(dense[:, f] @ w)[::-1][:25]
        want = want[want > 0]
        assert np.allclose(sim, want, atol=1e-6)
        assert all(abs(dense[index.ids[i], f] @ w - s) < 1e-6 for i, s in zip(e, sim))


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = queries.op3_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    hit = sum(r["toxic"] == 1 and r["predicted"] == 1 for r in got)
    assert hit >= 0.9 * sum(r["toxic"] == 1 for r in got)
    assert sum(r["toxic"] == 0 and r["predicted"] == 1 for r in got) <= 0.02 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(100 + i, f"good words here number{i}", 0) for i in range(60)] + [(200 + i, f"awful nasty words number{i}", 1) for i in range(20)]
    train = spark.createDataFrame(rows + [(300, None, 0), (301, "", 1), (302, "awful", None), (None, "awful thing", 1)],
                                  "doc_id bigint, text string, label int")
    got = T.score_toxicity(odd_docs, train).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["score"] < 0.3 for r in got)
    probe = spark.createDataFrame([(1, "So awful"), (2, "good words"), (2, "good words"), (3, None)], "doc_id bigint, text string")
    score = {r["doc_id"]: r for r in T.score_toxicity(probe, train).collect()}
    assert score[1]["score"] > 0.5 > score[2]["score"] and score[1]["evidence"][0]["label"] == 1 and not score[3]["evidence"]
    assert T.score_toxicity(no_docs, train).count() == 0
    assert {r["score"] for r in T.score_toxicity(probe, train.where("false")).collect()} == {0.0}
