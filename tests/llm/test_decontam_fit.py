"""The retrieval's basis comes from all passages."""

import random

import numpy as np
from pyspark.sql import Row

from outline_ledger.llm import decontam


def test_basis_is_fitted_on_all_passages(spark, monkeypatch):
    monkeypatch.setattr(decontam, "FIT_PASSAGES", 4, raising=False)
    rnd = random.Random(4)
    items = decontam.Items([Row(item_id=i, text=" ".join(f"w{j}" for j in range(3 * i, 3 * i + 3))) for i in range(4)])
    d = len(items.vocab)
    docs = [[rnd.randint(0, d) for _ in range(rnd.randint(1, 32))] for _ in range(300)]
    coded = spark.createDataFrame([(np.array(x, np.int32).tobytes(),) for x in docs], "codes binary")
    idf = np.linspace(1, 3, d)
    got = decontam._singular_vectors(coded, items, idf, len(docs), 3)

    def unit(words):
        v = np.bincount(words, minlength=d + 1)[1:] * idf
        return v / (np.linalg.norm(v) or 1)
    rows = [unit(x) for x in docs] + [unit(p) * np.sqrt(len(docs) / len(items.pieces)) for _, p in items.pieces]
    want = np.linalg.svd(np.array(rows))[2][:3].T
    assert np.linalg.svd(want.T @ got)[1].min() > 0.999
