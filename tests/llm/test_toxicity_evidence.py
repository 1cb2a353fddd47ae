import numpy as np

from outline_ledger.llm import toxicity as T


def test_toxic_words_that_clean_rows_use_too(spark):
    rows = [(i, f"plain calm words here n{i}", 0) for i in range(200)]
    rows += [(300 + i, f"awful plain calm words c{i}", 0) for i in range(4)]
    rows += [(400 + i, f"nasty plain calm words d{i}", 0) for i in range(4)]
    rows += [(500 + i, f"awful nasty stuff e{i} " + ("calm" if i % 2 else "here"), 1) for i in range(40)]
    rows += [(600 + i, f"stuff stuff g{i}", 0) for i in range(4)]
    train = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    probe = spark.createDataFrame([(1, "awful nasty stuff"), (2, "plain calm words")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in T.score_toxicity(probe, train).collect()}
    assert got[1]["score"] > 0.5 > 0.1 > got[2]["score"]
    assert {e["label"] for e in got[2]["evidence"]} == {0}  # clean examples vote


def test_short_and_long_texts_find_the_same_neighbours_as_all_cosines():
    rng = np.random.default_rng(2)

    def text(n):
        f = np.sort(rng.choice(200, n, replace=False))
        w = rng.random(n)
        return f, w / np.linalg.norm(w)

    rows = [text(rng.integers(1, 60)) for _ in range(900)]
    rows += rows[:40]  # ties
    labels = np.arange(940) % 2
    index = T.BlockMaxIndex(rows, labels, list(range(940)), 200)
    dense = np.zeros((940, 200))
    for i, at in enumerate(index.ids):
        dense[i, rows[at][0]] = rows[at][1]
    texts = [text(rng.integers(1, 90)) for _ in range(300)] + [(np.zeros(0, np.int64), np.zeros(0))] + rows[:30]
    for (f, w), (e, sim) in zip(texts, index.nearest_of_all(texts, 25), strict=True):
        all_sim = dense[:, f] @ w
        want = [i for i in np.lexsort((np.arange(940), -np.round(all_sim, 12)))[:25] if all_sim[i] > 0]
        assert list(e) == want and np.allclose(sim, all_sim[want], atol=1e-12)
        e1, sim1 = index.nearest(f, w, 25)
        assert list(e) == list(e1) and np.allclose(sim, sim1, atol=1e-12)
