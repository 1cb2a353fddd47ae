import numpy as np

from outline_ledger.llm import decontam as D


def judged(text, item, pieces=(0,)):
    items = D.Items([{"item_id": 7, "text": item}])
    codes, _ = items.codes(*D._joined([text]))
    starts = [(32, 64, p, 0.9) for p in pieces]
    return D._judged(codes, starts, items, D.STRONG, D.WEAK)


def words(n, name):
    return [f"{name}{i}" for i in range(n)]


def test_unevenly_paraphrased_item():
    item = words(59, "w")
    copy = item[:30] + [w if i < 13 else f"other{i}" for i, w in enumerate(item[30:])]
    text = " ".join(words(32, "x") + copy + words(60, "y"))
    for pieces in ((0,), (0, 1)):
        leak, item_id, _, overlap, _ = judged(text, " ".join(item), pieces)
        assert leak and item_id == 7 and overlap == 43 / 59


def test_answer_beyond_a_paraphrased_piece():
    item = words(59, "w")
    copy = item[:30] + [f"other{i}" for i in range(21)] + item[-8:]
    text = " ".join(words(32, "x") + copy + words(60, "y"))
    leak, _, _, overlap, answer = judged(text, " ".join(item))
    assert leak and answer and D.WEAK <= overlap < D.STRONG


def test_half_an_item_without_its_answer_is_no_leak():
    item = words(59, "w")
    text = " ".join(words(32, "x") + item[:30] + words(60, "y"))
    assert not judged(text, " ".join(item))[0]
