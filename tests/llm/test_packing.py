import zlib

import numpy as np
from tokenizers import Tokenizer

from outline_ledger.llm import packing as P


def check(docs, pieces, length=P.LENGTH):
    tok = Tokenizer.from_file(P.tokenizer_path())
    ids = sorted([(str(r["doc_id"]), *tok.encode(r["text"] or "", add_special_tokens=False).ids, P.END_ID) for r in docs])
    got, open_ = [], None
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        a = np.frombuffer(p["ids"], "<u4")
        assert len(a) == p["length"] and zlib.crc32(p["ids"]) == p["ids_crc32"]
        open_ = (*open_, *a.tolist()) if p["start"] else (str(p["doc_id"]), *a.tolist())
        assert len(open_) - 1 == p["start"] + p["length"]
        assert p["continues"] == (len(open_) - 1 < p["doc_tokens"])
        if not p["continues"]:
            got.append(open_)
    assert sorted(got) == ids
    total, fill = sum(len(x) - 1 for x in ids), {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == fill.get(p["sequence_id"], 0)
        fill[p["sequence_id"]] = p["offset"] + p["length"]
    assert [fill[i] for i in range(len(fill))] == [length] * (total // length) + [total % length] * (total % length > 0)
    last = [p for p in pieces if p["sequence_id"] == len(fill) - 1]
    n = fill[len(fill) - 1]
    assert all(p["sequence_tokens"] == n and p["padded_length"] == (n if n & (n - 1) == 0 else length) for p in last)


def test_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)
    check(docs.collect(), P.pack(docs, with_ids=True).collect())


def test_odd_rows(spark, odd_docs, no_docs):
    check(odd_docs.collect(), P.pack(odd_docs, with_ids=True).collect())
    check(odd_docs.collect(), P.pack(odd_docs, with_ids=True, length=64).collect(), 64)
    assert P.pack(no_docs).count() == 0
    one = odd_docs.where("doc_id = 5")
    assert P.pack(one).first()["padded_length"] == 1
    texts = ["<|endoftext|>a", "It's  12 Ünïcödé x y", "é ΑΣ ΑΣ.", "\x1c a\x85b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    check(df.collect(), P.pack(df, with_ids=True).collect())


def test_words_of_latin_letters_go_to_the_model(monkeypatch):
    ids = P.WordIds(P.tokenizer_path())
    letters = [chr(c) for c in range(0xDF, 0x100)]
    words = [f"{a}{b}{c}" for a in ["", "st", "é"] for b in letters for c in ["", "rue", "ñ", ".", ",%%%", "×!"]]
    words += ["e\u0301te\u0301", "Été", "ÿ’s", "ø1", "ſtraße", "naïve-té", "É!!", "don't!!", "9$$$", "a1.###", "...", "a&&&b***", "x's.", "日本.", "Ã×."]
    want = [ids._encode([w.encode()])[0] for w in words]
    sent = []
    real = ids._encode
    monkeypatch.setattr(ids, "_encode", lambda w: sent.extend(w) or real(w))
    ids.learn({w.encode() for w in words})
    assert [ids[w.encode()] for w in words] == want
    assert "straße".encode() not in sent and not any(P._LATIN.fullmatch(w) for w in sent)
    assert "éen,%%%".encode() not in sent and P._stem("Onè,%%%".encode()) == ("onè".encode(), b",%%%")
