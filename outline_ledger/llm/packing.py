"""Packing: concatenate all documents' tokens and cut them into sequences.

First pass: each task tokenizes its documents and writes their ids with the position of
each document in the task's own token run.  The runs' totals, one row for each task, get
prefix sums; with them every document knows its place in the one long run.  Second
pass: fixed windows cut the documents where they cross a multiple of the sequence
length; each piece is a record, and ``continues`` marks those that a boundary cuts.
No token is shuffled and only the very last sequence can be short.  A short sequence is
padded to the full length, except where its length is a power of two.

Defined cases: null text is empty (the document is its end token alone); a null doc_id and
repeated rows are packed like any other row; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import small_side, stage

LENGTH, END_ID, TOKENIZER = 4096, 2, "word_bpe_49k.json"
#: Words whose ids a worker remembers; then it starts anew.
REMEMBER = 1_000_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


#: Lower-case words of the letters of Latin-1, in UTF-8; they have no other composed form.
_LATIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
_LETTER_END = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])\Z")
#: Characters that stand for bytes in byte-level tokenizers: themselves if they can be seen, the others in order from 256.
_SEEN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LEVEL = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SEEN)}


class WordIds(dict):
    """word (bytes between ASCII white space) -> its ids as uint32 bytes.

    Exact for tokenizers that drop white space and never look across it.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        # lower-case words reach the BPE model as they are in the usual tokenizers
        self.plain = self._passes(b"a", b"the", b"tokenizers", b"zqxvkjw")
        # those of Latin-1 letters as their bytes in byte-level ones
        letters = [chr(c) for c in range(0xDF, 0x100) if c != 0xF7]
        self.latin = self.plain and self._passes(*[w.encode() for x in letters for w in (x, f"a{x}", f"{x}z{x}", f"{x}en")])

    def _passes(self, *words: bytes) -> bool:
        return all(self._encode([w]) == [self._model(w)] for w in words)

    def _encode(self, words: list) -> list:
        found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _model(self, word: bytes) -> bytes:
        return array("I", [t.id for t in self.tokenizer.model.tokenize(word.decode("latin-1").translate(_BYTE_LEVEL))]).tobytes()

    def learn(self, words: set) -> None:
        if len(self) > REMEMBER:
            self.clear()
        new = [(w, *_stem(w)) for w in words if w not in self]
        unknown = list({part for _, *parts in new for part in parts if part not in self})
        rest = []
        for w in unknown:
            if self.plain and w.isalpha() and w.islower() or self.latin and _LATIN.fullmatch(w):
                self[w] = self._model(w)
            else:
                rest.append(w)
        for i in range(0, len(rest), 20_000):
            self.update(zip(rest[i:i + 20_000], self._encode(rest[i:i + 20_000])))
        for w, stem, mark in new:
            self[w] = self[stem] + self[mark]


def _stem(word: bytes) -> tuple[bytes, bytes]:
    """Two parts whose ids make up the word's: the tokenizer lower-cases, and cuts between a letter
    and a run of punctuation, so a word in other case or before a comma need not be encoded again."""
    if b"<" in word:  # the names of special tokens keep their case
        return word, b""
    low = word.lower()
    stem = low.rstrip(b".,;:!?$%&*#")
    if len(stem) < len(low) and _LETTER_END.search(stem):
        return stem, low[len(stem):]
    return low, b""


_WORD_IDS: dict[str, WordIds] = {}


def token_bytes(texts: list, path: str) -> list:
    """Ids of each text (bytes) as little-endian uint32 bytes."""
    ids = _WORD_IDS.get(path) or _WORD_IDS.setdefault(path, WordIds(path))
    split = [t.split() for t in texts]
    ids.learn(set().union(*split))
    return [b"".join(map(ids.__getitem__, s)) for s in split]


def _texts(column):
    """Lists of texts as bytes, some hundred thousand bytes at a time; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    lo, size = 0, 0
    for hi, n in enumerate(pc.binary_length(column).to_pylist(), 1):
        size += n
        if size >= 1 << 19 or hi == len(column):
            yield lo, hi, column.slice(lo, hi - lo).to_pylist()
            lo, size = hi, 0


def _tokenized(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    def run(batches):
        part, at, end = TaskContext.get().partitionId(), 0, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for lo, hi, texts in _texts(batch.column(1)):
                ids = [t + end for t in token_bytes(texts, path)]
                n = np.array([len(t) // 4 for t in ids], np.int64)
                first = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.full(len(n), part, np.int32)),
                     pa.array(first), pa.array(n), pa.array(ids, pa.binary())],
                    names=["doc_id", "part", "first", "n", "ids"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {id_type}, part int, first bigint, n bigint, ids binary")


def pack(docs: DataFrame, path: str | None = None, end_id: int = END_ID, length: int = LENGTH,
         with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, continues,
    sequence_tokens and padded_length of its sequence; with ``with_ids`` also its ids (uint32 bytes)."""
    path = path or tokenizer_path()
    tokens = stage(_tokenized(docs, path, end_id), "pack-tokens")
    # one row for each task of the first pass
    totals = tokens.groupBy("part").agg(F.sum("n").alias("sum"))
    whole = Window.orderBy("part")
    bases = stage(totals.select("part", (F.sum("sum").over(whole) - F.col("sum")).alias("base"),
                                F.sum("sum").over(Window.partitionBy()).alias("total")), "pack-bases")
    placed = tokens.join(small_side(bases), "part").select("doc_id", "n", "ids", "total",
                                                           (F.col("base") + F.col("first")).alias("at"))

    def run(batches):
        for batch in batches:
            out = [[] for _ in names]
            for doc, n, ids, total, at in zip(*[batch.column(c).to_pylist() for c in range(5)]):
                cuts = [0, *range(length - at % length, n, length), n]
                for a, b in zip(cuts, cuts[1:]):
                    seq = (at + a) // length
                    filled = min(length, total - seq * length)
                    piece = ids[4 * a:4 * b]
                    row = [doc, a, b - a, zlib.crc32(piece), n, seq, (at + a) % length, b < n, filled,
                           filled if filled & (filled - 1) == 0 else length, piece]
                    for c, v in zip(out, row):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    id_type = docs.schema["doc_id"].dataType
    cols = [("doc_id", id_type.simpleString())] + [(c, "bigint") for c in (
        "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [
        ("continues", "boolean"), ("sequence_tokens", "bigint"), ("padded_length", "bigint")]
    names = [c for c, _ in cols] + ["ids"] * with_ids
    from pyspark.sql.pandas.types import to_arrow_type
    types = [to_arrow_type(id_type)] + [pa.int64()] * 6 + [pa.bool_()] + [pa.int64()] * 2 + [pa.binary()] * with_ids
    return placed.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in cols) + ", ids binary" * with_ids)
