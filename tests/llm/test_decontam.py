import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from outline_ledger.llm import decontam as D


def table_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@settings(deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=30), st.lists(st.integers(0, 5), max_size=30))
def test_lcs(a, b):
    assert D.lcs(np.array(a), np.array(b, np.int64)) == table_lcs(a, b)


def corpus(seed=5):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    common = ["the", "of", "and", "to"]

    def words(n):
        return [rnd.choice(common) if rnd.random() < 0.3 else rnd.choice(vocabulary) for _ in range(n)]

    items = [(i, " ".join(words(rnd.randrange(15, 120)))) for i in range(30)]
    docs, leaks = [], {}
    for d in range(300):
        w = words(rnd.randrange(20, 400))
        if d % 5 == 0:
            i, t = rnd.choice(items)
            t = t.split()
            if d % 10 == 0:  # a paraphrase: some words changed, dropped and put in
                for _ in range(len(t) // 8):
                    t[rnd.randrange(len(t))] = rnd.choice(vocabulary)
                del t[rnd.randrange(len(t))]
                t.insert(rnd.randrange(len(t)), rnd.choice(vocabulary))
            at = rnd.randrange(len(w))
            w[at:at] = [x.upper() + "," for x in t]
            leaks[d] = i
        docs.append((d, " ".join(w)))
    return docs, items, leaks


def test_finds_planted_passages_and_leaves_others(spark):
    docs, items, leaks = corpus()
    got = {r["doc_id"]: r for r in D.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"),
                                                 spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert {d for d, r in got.items() if r["leak"]} == set(leaks)
    assert all(got[d]["item_id"] == i for d, i in leaks.items())


def test_recall_against_all_pairs(spark):
    """All documents of the table that hold an item's words in order are found, and no others."""
    d = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    got = {r["doc_id"] for r in D.find_leaks(docs, items).where("leak").collect()}
    items = [" ".join(r["text"].split()) for r in items.collect()]
    want = {r["doc_id"] for r in docs.collect() if any(i in " ".join(r["text"].split()) for i in items)}
    assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 0.002 * docs.count()


def test_blocks_of_items(spark, monkeypatch):
    docs, items, leaks = corpus(9)
    monkeypatch.setattr(D, "ITEMS", 11)
    got = D.find_leaks(spark.createDataFrame(docs + docs[:3], "doc_id bigint, text string"),
                       spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert len(got) == 303 and {r["doc_id"] for r in got if r["leak"]} == set(leaks)


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"), (2, None),
                                   (3, ""), (None, "nothing like this is anywhere")], "item_id bigint, text string")
    got = D.find_leaks(odd_docs, items).collect()
    assert len(got) == odd_docs.count()
    assert {r["doc_id"] for r in got if r["leak"]} == {1, 2, 3, None}
    assert sorted(r["doc_id"] or 0 for r in D.drop_leaks(odd_docs, items).collect()) == [0, 0, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13]
    assert D.find_leaks(no_docs, items).count() == 0
    assert {r["leak"] for r in D.find_leaks(odd_docs, items.where("item_id > 1")).collect()} == {False}
