"""Phrase collocation mining by top-order marginalisation.

Only the longest windows are counted: for each word the columns w1, w2, w3 lead to the word and the
two behind it in its piece, padded with '' at the piece's end.  Windows whose tail is rare are then
folded into their padded form (their count stays in every prefix), and one ROLLUP over
(lang, w1, w2, w3) sums the successively shorter prefixes: words, pairs and all words of a lang.
No phrase length is exploded on its own: a suffix of a phrase is the prefix of the window that
starts one word later.

Scale.  A task counts the windows of about a million words at a time (NumPy), so frequent windows
are combined before the one large shuffle, which is by (lang, w1, w2): a frequent word spreads over
its followers, and a frequent pair has one row for each chunk and third word.  The aggregate and the
folding need no other shuffle.  The pairs (w1, w2) are dealt to ``PASSES`` parts by hash, counted one
after the other, so only one part's shuffle files are on disk at a time.  Texts are cut at piece ends, so a very long text is not held whole
in working arrays.  Within a chunk words are told apart by 64-bit hashes, between chunks by their text.

Defined cases: null text is empty; null lang is 'und' (as the text 'und'); repeated rows count each;
doc_id and extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage
from .words import U, _powers, _T1, _T2, mix

LEAST = 10
TOP = 2000
CHUNK_WORDS = 1 << 20
PASSES = 2
SLICE_BYTES = 1 << 22
PIECE_ENDS = ".,;:!?\x0A\x0B\x0C\x0D"

_END = np.zeros(256, bool)
_END[[ord(c) for c in PIECE_ENDS]] = True
_GAP = _END.copy()
_GAP[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_SCHEMA = pa.schema([("lang", pa.string()), ("w1", pa.string()), ("w2", pa.string()), ("w3", pa.string()), ("n", pa.int64())])


def _slices(batch):
    """(lang, bytes) of all texts of a batch; long texts are cut behind piece ends."""
    for lang, text in zip(batch.column(0), batch.column(1).cast(pa.large_binary())):
        buf = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid else np.zeros(0, np.uint8)
        lo = 0
        while len(buf) - lo > SLICE_BYTES:
            ends = np.flatnonzero(_END[buf[lo:lo + SLICE_BYTES]])
            if not len(ends):
                # one piece fills the slice: it ends at the next piece end
                rest = np.flatnonzero(_END[buf[lo + SLICE_BYTES:]])
                cut = lo + SLICE_BYTES + int(rest[0]) + 1 if len(rest) else len(buf)
            else:
                cut = lo + int(ends[-1]) + 1
            yield lang.as_py(), buf[lo:cut]
            lo = cut
        yield lang.as_py(), buf[lo:]


def _windows(langs: list, rows: list, part: int = 0, parts: int = 1):
    """Counted windows of the texts ``rows`` (bytes), text i of lang ``langs[i]``, as Arrow batches;
    of those whose pair (w1, w2) is of part ``part`` by its hash."""
    # every text ends in a piece end, so no word or window goes over its edge
    buf = _LOWER[np.concatenate([x for r in rows for x in (r, np.full(1, 10, np.uint8))])]
    word = ~_GAP[buf]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    starts = np.flatnonzero(begin)
    if not len(starts):
        return
    until = np.flatnonzero(word & ~np.append(word[1:], False)) + 1
    piece = np.cumsum(_END[buf])[starts]
    owner = np.searchsorted(np.cumsum([len(r) + 1 for r in rows]), starts, "right")
    codes_of = {x: i for i, x in enumerate(dict.fromkeys(langs))}
    lang = np.array([codes_of[x] for x in langs], np.uint64)[owner]
    s0 = int(starts[0])
    pos = np.arange(len(buf) - s0) - (starts - s0)[np.cumsum(begin[s0:]) - 1]
    p1, p2 = _powers(int((np.append(starts[1:], len(buf)) - starts).max()) + 1)
    live = word[s0:]
    v1, v2 = _T1[buf[s0:]] * p1[pos] * live, _T2[buf[s0:]] * p2[pos] * live
    h = mix(np.add.reduceat(v1, starts - s0) ^ mix(np.add.reduceat(v2, starts - s0)))
    # the part of a pair must not hang on this chunk's numbers of the langs
    plain, h = h, h ^ mix(lang + U(1))
    del v1, v2, pos, live
    names = pa.array(list(codes_of), pa.string())
    for lo in range(0, len(starts), CHUNK_WORDS):
        hi = min(lo + CHUNK_WORDS, len(starts))
        # two words more, which the last windows lead to
        _, at, code = np.unique(h[lo:hi + 2], return_index=True, return_inverse=True)
        code = code.astype(np.uint64) + U(1)
        here, n = piece[lo:hi + 2], hi - lo
        code, here = np.append(code, [U(0)] * 2), np.append(here, [-1, -1])
        w2 = np.where(here[1:n + 1] == here[:n], code[1:n + 1], U(0))
        w3 = np.where(here[2:n + 2] == here[:n], code[2:n + 2], U(0))
        keys = (code[:n] << U(42)) | (w2 << U(21)) | w3
        if parts > 1:
            of = np.append(U(0), plain[lo:hi + 2][at])
            keys = keys[mix(of[code[:n]] ^ mix(of[w2] + U(1))) % U(parts) == part]
        keys, count = np.unique(keys, return_counts=True)
        first = at + lo
        data = pa.py_buffer(b"".join(buf[a:b].tobytes() for a, b in zip(starts[first], until[first])))
        size = np.concatenate([[0, 0], np.cumsum(until[first] - starts[first])]).astype(np.int64)
        texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first) + 1, [None, pa.py_buffer(size), data])
        mask = U((1 << 21) - 1)
        ones = (keys >> U(42)).astype(np.int64)
        langs_of = names.take(pa.array(lang[first].astype(np.int64)[ones - 1]))
        cols = [texts.take(pa.array(k.astype(np.int64))).cast(pa.binary()).cast(pa.string())
                for k in (keys >> U(42), (keys >> U(21)) & mask, keys & mask)]
        table = pa.RecordBatch.from_arrays([langs_of, *cols, pa.array(count.astype(np.int64))], schema=_SCHEMA)
        for i in range(0, len(table), 50_000):
            yield table.slice(i, 50_000)


def count_windows(docs: DataFrame, part: int = 0, parts: int = 1, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """(lang, text) -> (lang, w1, w2, w3, n): padded windows of three words, combined within each chunk."""
    def run(batches):
        langs, rows, size = [], [], 0
        for batch in batches:
            for lang, buf in _slices(batch):
                langs.append(lang)
                rows.append(buf)
                size += len(buf)
                # six bytes a word and its gap
                if size >= 6 * chunk_words:
                    yield from _windows(langs, rows, part, parts)
                    langs, rows, size = [], [], 0
        if rows:
            yield from _windows(langs, rows, part, parts)
    return docs.mapInArrow(run, "lang string, w1 string, w2 string, w3 string, n long")


def phrase_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, text) -> staged (lang, w1, w2, w3, n, words): counts of phrases of 1 to 3 words that occur ``least``
    times and, with 0 words, of all words of each lang."""
    folded = None
    for part in range(PASSES):
        windows = count_windows(docs, part, PASSES).repartition("lang", "w1", "w2")
        top = windows.groupBy("lang", "w1", "w2", "w3").agg(F.sum("n").alias("n"))
        # a rare window counts in its prefixes only; the same clustering serves both aggregates
        short = top.withColumn("w3", F.when(F.col("n") >= least, F.col("w3")).otherwise(F.lit("")))
        short = stage(short.groupBy("lang", "w1", "w2", "w3").agg(F.sum("n").alias("n")), "windows", arrow_rows=64)
        folded = folded.union(short) if folded else short
    folded.createOrReplaceTempView("collocation_windows")
    sums = folded.sparkSession.sql("""
        SELECT lang, w1, w2, w3, sum(n) AS n, 3 - bit_count(grouping_id()) AS words
        FROM collocation_windows GROUP BY lang, ROLLUP (w1, w2, w3)""")
    padded = "(words = 3 AND w3 = '') OR (words = 2 AND w2 = '')"
    sums = sums.where(f"NOT ({padded}) AND (n >= {int(least)} OR words = 0)")
    return stage(sums.select("lang", "w1", "w2", "w3", "n", F.col("words").cast("int").alias("words")), "phrases")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = 50) -> DataFrame:
    """(lang, text) -> each lang's ``top`` phrases: (lang, rank, phrase, a, l, r, n, score).

    ``share``: a phrase goes if a longer one that holds its words has so many hundredths of its count.
    """
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    grams = phrase_counts(docs, least)

    def of(words, names, count):
        cols = [F.col(f"w{i + 1}").alias(x) for i, x in enumerate(names)]
        return grams.where(F.col("words") == words).select("lang", *cols, F.col("n").alias(count))
    one, two, three = of(1, ["x"], "fx"), of(2, ["x", "y"], "fxy"), of(3, ["x", "y", "z"], "a")
    last = {c: one.select("lang", F.col("x").alias(c), F.col("fx").alias(f"f{c}")) for c in ("y", "z")}
    # counts pass 64 bits when multiplied; decimals of 38 digits hold the products and DIV is exact
    score = "CAST(CAST({a} AS DECIMAL(14,0)) * {a} * 1000000 DIV (CAST({l} AS DECIMAL(14,0)) * {r}) AS BIGINT)"

    def scored(df, a, l, r):
        wide = {k: f"CAST({v} AS DECIMAL(14,0))" for k, v in {"a": a, "l": l, "r": r}.items()}
        return F.expr(score.format(**wide))
    longer = (three.select("lang", "x", "y", "a").union(three.select("lang", "y", "z", "a"))
              .groupBy("lang", "x", "y").agg(F.max("a").alias("within")))
    pairs = (two.join(one, ["lang", "x"]).join(last["y"], ["lang", "y"]).join(longer, ["lang", "x", "y"], "left")
             .where(f"within IS NULL OR 100 * within < {int(share)} * fxy")
             .select("lang", F.concat_ws(" ", "x", "y").alias("phrase"), F.col("fxy").alias("a"), F.col("fx").alias("l"),
                     F.col("fy").alias("r"), scored(None, "fxy", "fx", "fy").alias("score")))
    tail = two.select("lang", F.col("x").alias("y"), F.col("y").alias("z"), F.col("fxy").alias("fyz"))
    triples = (three.join(one, ["lang", "x"]).join(two, ["lang", "x", "y"]).join(tail, ["lang", "y", "z"])
               .join(last["z"], ["lang", "z"])
               .withColumn("s1", scored(None, "a", "fx", "fyz")).withColumn("s2", scored(None, "a", "fxy", "fz")))
    first = F.col("s1") <= F.col("s2")
    triples = triples.select("lang", F.concat_ws(" ", "x", "y", "z").alias("phrase"), "a",
                             F.when(first, F.col("fx")).otherwise(F.col("fxy")).alias("l"),
                             F.when(first, F.col("fyz")).otherwise(F.col("fz")).alias("r"),
                             F.least("s1", "s2").alias("score"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = pairs.union(triples).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    total = of(0, [], "n")
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
