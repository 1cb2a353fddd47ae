import hashlib

from hypothesis import given
from hypothesis import strategies as st

from outline_ledger.llm import chat_format as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string, formatted string"


def test_escape_round_trip():
    texts = st.text(alphabet="<|\\>im_endstart\n a", max_size=40)

    @given(texts, texts)
    def check(role, text):
        assert C.unescape(C.escape(text)) == text and "<|" not in C.escape(text)
        v = C.PartVisitor()
        part = {"type": "text", "text": text}
        v.message(role, [part])
        v.message("assistant", [part])
        out = "".join(v.out)
        found = C.parse_conversation(out)
        assert [(r, "".join(p)) for r, p in found] == [(role, text), ("assistant", text)]
        assert "".join(C.unescape(out[a:b]) for a, b in v.spans[-1:]) == (text if text or role != "assistant" else "")
    check()


def test_plain_rows(spark):
    rows = [(1, 1, "assistant", "b<|im_end|>", "x"), (1, 0, "user", None, "x"), (2, None, None, "q", "x"), (None, 0, "user", "n", "x"),
            (3, 0, "assistant", "t", "x"), (3, 0, "assistant", "t", "x"), (4, 0, "assistant", "é" * 100_000, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["conv_id"]: r for r in C.read_back(C.format_conversations(C.text_messages(df))).collect()}

    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()

    assert set(got) == {1, 2, 3, 4, None}
    assert got[1]["turns_sha256"] == sha("user\n\nassistant\nb<|im_end|>\n") and got[1]["loss_sha256"] == sha("b<|im_end|>")
    assert got[2]["turns_sha256"] == sha("\nq\n") and got[2]["loss_chars"] == 0
    assert got[3]["n_turns"] == 2 and got[3]["loss_sha256"] == sha("tt")
    assert got[4]["loss_chars"] == 100_000
    assert C.read_back(C.format_conversations(C.text_messages(df.where("false")))).count() == 0


def test_typed_parts(spark):
    parts = [{"type": "text", "text": "see <|image 0|>"}, {"type": "image", "ref": "i.png", "width": 56, "height": 29},
             {"type": "audio", "ref": "a.wav", "seconds": 1.5}, {"type": "document", "ref": "d.pdf", "pages": 3}, None]
    full = [p and {k: p.get(k) for k in ("type", "text", "ref", "width", "height", "seconds", "pages")} for p in parts]
    df = spark.createDataFrame([(1, 0, "user", full), (1, 1, "assistant", None)],
                               f"conv_id bigint, turn bigint, role string, parts array<{C.PART}>")
    r = C.format_conversations(df).first()
    assert [(a["type"], a["ref"], a["tokens"]) for a in r["attachments"]] == [
        ("image", "i.png", 4), ("audio", "a.wav", 38), ("document", "d.pdf", 1536)]
    assert all(r["formatted"][a["at"]:].startswith(f"<|{a['type']} {a['number']}|>") for a in r["attachments"])
    assert C.parse_conversation(r["formatted"])[0][1] == ["see <|image 0|>", ("image", 0), ("audio", 1), ("document", 2)]
