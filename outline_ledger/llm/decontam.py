"""Benchmark decontamination by latent semantic retrieval.

1. The benchmark's items, in blocks of bounded size, give the vocabulary; all documents'
   words (A-Z as a-z, cut at white space and ASCII punctuation) become codes in it, 0 for others.
2. Passages are runs of ``BLOCK`` words and of two neighbouring runs.  Document
   frequencies over all passages give the idf.  Terms in more than ``MAX_DF`` of the passages are
   stop terms without weight, except for items that would keep fewer than ``LEAST_TERMS`` terms;
   the last check below counts all words.
3. Randomised SVD of the TF-IDF passages of all documents and of the (weighted) items.  Every
   task adds up its part of A'(A omega) for a seeded random omega; the parts are summed
   in Spark by groups of rows, and the driver solves the small Nystroem problem for the
   right singular vectors.  Vocabulary and rank bound all that reaches the driver.
4. All passages and items are projected; pairs with a cosine of ``COSINE`` or more are
   candidates.
5. A candidate's words around the passage meet the item's words by longest common
   subsequence.  A document is a leak of an item if the subsequences cover at least ``STRONG``
   of the item's words, or at least ``WEAK`` and the item's answer (its last words) is found too.

Items longer than ``PIECE`` words are searched in pieces.  Around every candidate piece the whole
item and its answer are compared; matches of candidate pieces at different places add up.  Defined
cases: null texts are empty; empty documents and items match nothing; a null item_id
is an item like others; repeated rows each have their result; other columns are ignored; no
items: nothing is a leak; an empty documents table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .staging import small_side, stage, unstage
from .words import U, text_slices, word_hashes

BLOCK, PIECE, RANK, OVERSAMPLE = 32, 48, 256, 16
COSINE, STRONG, WEAK, ANSWER, ANSWER_WORDS = 0.45, 0.7, 0.5, 0.75, 8
ITEMS, ITEM_WORDS = 256, 100_000
MAX_DF, LEAST_TERMS = 0.02, 4


class Items:
    """A block of items: their vocabulary, pieces and answers as codes (1..)."""

    def __init__(self, rows: list):
        self.ids = [r["item_id"] for r in rows]
        buf, at = _joined([r["text"] for r in rows])
        h, first = word_hashes(buf, at, plain=True)
        self.vocab = np.unique(h)
        codes = np.searchsorted(self.vocab, h) + 1
        self.words = [codes[a:b] for a, b in zip(first, first[1:])]
        self.pieces = [(i, p) for i, w in enumerate(self.words) if len(w)
                       for p in np.array_split(w, -(-len(w) // PIECE))]
        self.lists = [p.tolist() for _, p in self.pieces]
        # words of the item before and after each piece
        self.reach = [(b, len(w) - b - len(p)) for w in self.words if len(w)
                      for b, p in _places(np.array_split(w, -(-len(w) // PIECE)))]

    def codes(self, buf, rows):
        h, first = word_hashes(buf, rows, plain=True)
        if not len(h):
            return np.zeros(0, np.int32), first
        at = np.minimum(np.searchsorted(self.vocab, h), len(self.vocab) - 1)
        return np.where(self.vocab[at] == h, at + 1, 0).astype(np.int32), first


def _places(pieces: list) -> list:
    return list(zip(np.cumsum([0] + [len(p) for p in pieces]).tolist(), pieces))


def _joined(texts: list):
    raw = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])


def item_blocks(benchmark: DataFrame):
    """Lists of items of at most ``ITEMS`` items and about ``ITEM_WORDS`` words, one at a time."""
    held, size = [], 0
    for r in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        held.append(r)
        size += (r["text"] or "").count(" ") + 1
        if len(held) >= ITEMS or size >= ITEM_WORDS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _decoded(batch):
    """(codes of all rows of a batch, start of each row's, start of each run, run of each row's first)."""
    col = batch.column("codes").cast(pa.large_binary())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    at = (offsets - offsets[0]) // 4
    data = col.buffers()[2]
    codes = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]].view(np.int32) if data else np.zeros(0, np.int32)
    runs = -(-np.diff(at) // BLOCK)
    first = np.concatenate([[0], np.cumsum(runs)])
    start = np.arange(first[-1]) - np.repeat(first[:-1], runs)
    return codes, at, np.repeat(at[:-1], runs) + start * BLOCK, first


def _known(codes: np.ndarray, runs: np.ndarray, idf: np.ndarray | None = None):
    """(terms, their run) of the codes that are in the vocabulary and, with ``idf``, have weight."""
    hit = np.flatnonzero(codes if idf is None else np.append(0, idf)[codes])
    return codes[hit] - 1, np.searchsorted(runs, hit, "right") - 1


def _weights(items: Items, passages: int, df: np.ndarray) -> np.ndarray:
    """idf of each term, 0 for stop terms."""
    idf = np.log((passages + 1) / (df + 1)) + 1
    kept = df <= MAX_DF * passages
    for _, p in items.pieces:
        if kept[p - 1].sum() < LEAST_TERMS:
            kept[p - 1] = True
    return np.where(kept, idf, 0.0)


def _frequencies(coded: DataFrame, d: int):
    """(passages, df of each term): a vocabulary's length of rows reaches the driver."""
    def run(batches):
        df = np.zeros(d + 1, np.int64)
        for batch in batches:
            codes, _, runs, _ = _decoded(batch)
            t, r = _known(codes, runs)
            df[:d] += np.bincount(np.unique(r * d + t) % d, minlength=d)
            df[d] += len(runs)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(df)), pa.array(df[df > 0])], names=["t", "df"])

    rows = coded.select("codes").mapInArrow(run, "t bigint, df bigint").groupBy("t").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(d + 1, np.int64)
    for r in rows:
        df[r["t"]] = r["df"]
    return int(df[d]), df[:d]


def _sum_by_run(weights: np.ndarray, runs: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows of ``weights`` over equal neighbours of ``runs``, for runs 0..n-1."""
    out = np.zeros((n, weights.shape[1]), np.float32)
    if len(runs):
        cut = np.flatnonzero(np.append(True, runs[1:] != runs[:-1]))
        out[runs[cut]] = np.add.reduceat(weights, cut, axis=0)
    return out


def _sketch_part(codes, runs, idf, omega, g) -> None:
    """g += A'(A omega) of the TF-IDF rows of unit length."""
    for lo in range(0, len(runs), 512):  # bounded memory
        a, b = runs[lo], runs[lo + 512] if lo + 512 < len(runs) else len(codes)
        t, r = _known(codes[a:b], runs[lo:lo + 512] - a, idf)
        if not len(t):
            continue
        d = len(idf)
        key, tf = np.unique(r * d + t, return_counts=True)
        r, t = key // d, key % d
        w = tf * idf[t]
        norm = np.sqrt(np.bincount(r, w * w))
        w = (w / norm[r]).astype(np.float32)
        y = _sum_by_run(omega[t] * w[:, None], r, int(r[-1]) + 1)
        by = np.argsort(t, kind="stable")
        cut = np.flatnonzero(np.append(True, t[by][1:] != t[by][:-1]))
        g[t[by][cut]] += np.add.reduceat(y[r[by]] * w[by, None], cut, axis=0)


def _singular_vectors(coded: DataFrame, items: Items, idf: np.ndarray, passages: int, rank: int, seed: int = 7):
    """Right singular vectors (d, rank) of the passages of documents and items."""
    d, spark = len(idf), coded.sparkSession
    width = min(d, rank + OVERSAMPLE)
    rows_per_group = 64

    def omega():
        return np.random.default_rng(seed).standard_normal((d, width)).astype(np.float32)

    def run(batches):
        om, g = omega(), np.zeros((d, width))
        for batch in batches:
            codes, _, runs, _ = _decoded(batch)
            _sketch_part(codes, runs, idf, om, g)
        for k in range(0, d, rows_per_group):
            yield pa.RecordBatch.from_arrays(
                [pa.array([k]), pa.array([g[k:k + rows_per_group].astype(np.float32).tobytes()], pa.binary())], names=["k", "g"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in pdf["g"])
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "g": [total.tobytes()]})

    # as many partial sums as the cluster runs tasks, whatever the number of passages
    few = coded.select("codes").coalesce(2 * spark.sparkContext.defaultParallelism)
    parts = few.mapInArrow(run, "k bigint, g binary").groupBy("k").applyInPandas(add, "k bigint, g binary").collect()
    om, g = omega().astype(np.float64), np.zeros((d, width))
    for r in parts:
        g[r["k"]:r["k"] + rows_per_group] = np.frombuffer(r["g"], np.float64).reshape(-1, width)
    mine = np.zeros((d, width), np.float32)
    words = np.concatenate([p for _, p in items.pieces])
    _sketch_part(words, np.cumsum([0] + [len(p) for _, p in items.pieces])[:-1], idf, omega(), mine)
    # items count as much as all passages together
    g += mine * (max(1, passages) / len(items.pieces))
    core = om.T @ g
    value, vector = np.linalg.eigh((core + core.T) / 2)
    kept = value > max(value.max(), 0) * 1e-6  # the rest is rounding of the single-precision sums
    if not kept.any():
        return np.zeros((d, 1), np.float32)
    b = g @ (vector[:, kept] / np.sqrt(value[kept]))
    return np.linalg.svd(b, full_matrices=False)[0][:, :rank].astype(np.float32)


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a row of the table as the bits of one integer."""
    masks: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        m = masks.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _near_lcs(piece: np.ndarray, text: np.ndarray) -> tuple[int, np.ndarray]:
    """Best LCS of a piece with a stretch of about its own length, and that stretch."""
    size, step = len(piece) * 4 // 3 + 4, max(1, len(piece) // 4)
    best, at = 0, text[:0]
    for i in range(0, max(1, len(text) - size + step), step):
        n = lcs(piece, text[i:i + size])
        if n > best:
            best, at = n, text[max(0, i - size):i + 2 * size]
    return best, at


def find_leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, strong: float = STRONG,
               weak: float = WEAK, rank: int = RANK) -> DataFrame:
    """For every row of docs (doc_id, text): doc_id, leak, item_id (of the best match; null if none),
    similarity, overlap (share of the item's words) and answer (found)."""
    found = None
    for rows in item_blocks(benchmark):
        items = Items(rows)
        if items.pieces:
            part = _search_block(docs, items, benchmark.schema["item_id"].dataType, cosine, strong, weak, rank)
            found = part if found is None else _better(found, part)
    if found is None:
        t = benchmark.schema["item_id"].dataType
        found = docs.select("doc_id", F.lit(False).alias("leak"), F.lit(None).cast(t).alias("item_id"),
                            F.lit(None).cast("double").alias("similarity"), F.lit(0.0).alias("overlap"),
                            F.lit(False).alias("answer"))
    return found


def _better(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of two blocks' results the stronger for each document."""
    key = F.struct("leak", "overlap", "similarity", "answer", "item_id")
    both = a.union(b).groupBy("doc_id").agg(F.max(key).alias("m"), (F.count(F.lit(1)) / 2).cast("int").alias("n"))
    return (both.withColumn("n", F.explode(F.sequence(F.lit(1), "n")))
            .select("doc_id", "m.leak", "m.item_id", "m.similarity", "m.overlap", "m.answer"))


def _search_block(docs, items: Items, item_type, cosine, strong, weak, rank) -> DataFrame:
    spark, doc_type = docs.sparkSession, docs.schema["doc_id"].dataType
    shared_items = spark.sparkContext.broadcast(items)

    def encode(batches):
        for batch in batches:
            for lo, hi, buf, at in text_slices(batch.column(1)):
                codes, first = shared_items.value.codes(buf, at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo),
                     pa.array([codes[a:b].tobytes() for a, b in zip(first, first[1:])], pa.binary())],
                    names=["doc_id", "codes"])

    coded = stage(docs.select("doc_id", "text").mapInArrow(
        encode, f"doc_id {doc_type.simpleString()}, codes binary"), "leak-codes")
    passages, df = _frequencies(coded, len(items.vocab))
    idf = _weights(items, passages, df)
    base = _singular_vectors(coded, items, idf, passages, rank)
    term = (base * idf[:, None]).astype(np.float32)  # a term's part of a passage's projection
    query = np.stack([term[p - 1].sum(axis=0) for _, p in items.pieces])
    query /= np.maximum(np.linalg.norm(query, axis=1, keepdims=True), 1e-12)
    shared = spark.sparkContext.broadcast((term, query, idf))
    fields = [("doc_id", to_arrow_type(doc_type)), ("leak", pa.bool_()), ("item_id", to_arrow_type(item_type)),
              ("similarity", pa.float64()), ("overlap", pa.float64()), ("answer", pa.bool_())]

    def search(batches):
        items, (term, query, idf) = shared_items.value, shared.value
        for batch in batches:
            codes, at, runs, first = _decoded(batch)
            pairs = _candidates(codes, runs, first, term, query, idf, cosine)
            out = [_judged(codes[at[i]:at[i + 1]], pairs.get(i, ()), items, strong, weak) for i in range(len(at) - 1)]
            cols = [batch.column(0)] + [pa.array([o[c] for o in out], t) for c, (_, t) in enumerate(fields[1:])]
            yield pa.RecordBatch.from_arrays(cols, names=[n for n, _ in fields])

    leaks = stage(coded.mapInArrow(
        search, f"doc_id {doc_type.simpleString()}, leak boolean, item_id {item_type.simpleString()}, similarity double, "
                "overlap double, answer boolean"), "leaks")
    unstage(coded)
    return leaks


def _candidates(codes, runs, first, term, query, idf, cosine) -> dict:
    """row -> [(first word of the passage, words, piece, cosine)]."""
    found: dict[int, list] = {}
    row_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    step = 1024
    for lo in range(0, len(runs), step):
        # one run more, so that pairs across the cut are seen
        hi, top = min(lo + step, len(runs)), min(lo + step + 1, len(runs))
        a, b = runs[lo], runs[top] if top < len(runs) else len(codes)
        t, r = _known(codes[a:b], runs[lo:top] - a, idf)
        z = _sum_by_run(term[t], r, top - lo)
        dot, sq = z @ query.T, np.einsum("ij,ij->i", z, z)
        single = dot / np.sqrt(np.maximum(sq, 1e-12))[:, None]
        same = row_of[lo:top][1:] == row_of[lo:top][:-1]
        both_sq = sq[1:] + sq[:-1] + 2 * np.einsum("ij,ij->i", z[1:], z[:-1])
        double = (dot[1:] + dot[:-1]) / np.sqrt(np.maximum(both_sq, 1e-12))[:, None]
        double[~same] = 0
        for sim, n in ((single[:hi - lo], 1), (double[:hi - lo], 2)):
            for i, p in zip(*np.nonzero(sim >= cosine)):
                row = int(row_of[lo + i])
                start = int(runs[lo + i] - runs[first[row]])
                found.setdefault(row, []).append((start, n * BLOCK, int(p), float(sim[i, p])))
    return found


def _judged(words, pairs, items: Items, strong, weak) -> tuple:
    """(leak, item_id, similarity, overlap, answer) of the best item of a document."""
    best: dict[int, tuple] = {}
    seen: dict[tuple, set] = {}
    long: dict[int, list] = {}
    for start, n, p, sim in pairs:
        item, piece = items.pieces[p]
        if len(piece) < len(items.words[item]):
            long.setdefault(item, []).append((start, n, p, sim))
            continue
        text = words[max(0, start - BLOCK):start + n + BLOCK]
        if (start, n) not in seen:
            seen[start, n] = set(text.tolist())
        here = seen[start, n]
        if sum(w in here for w in items.lists[p]) < weak * len(piece):
            continue
        k, around = _near_lcs(piece, text)
        if k > best.get(p, (0,))[0]:
            best[p] = (k, sim, around, item)
    total: dict[int, list] = {}
    for k, sim, around, item in best.values():
        t = total.setdefault(item, [0, 0.0, False])
        t[0] += k
        t[1] = max(t[1], sim)
        answer = items.words[item][-ANSWER_WORDS:]
        t[2] = t[2] or lcs(answer, around) >= ANSWER * len(answer)
    for item, spots in long.items():
        found = _judged_whole(words, item, spots, items, weak)
        if found:
            total[item] = found
    ranked = [((k / len(items.words[i]) >= strong) or (k / len(items.words[i]) >= weak and found),
               k / len(items.words[i]), sim, found, i) for i, (k, sim, found) in total.items()]
    if not ranked:
        return False, None, None, 0.0, False
    leak, overlap, sim, found, i = max(ranked, key=lambda x: (x[0], x[1], x[2], -x[4]))
    return bool(leak), items.ids[i], float(sim), float(overlap), bool(found)


def _judged_whole(words, item: int, spots, items: Items, weak) -> list | None:
    """[matched words, similarity, answer] of an item of several pieces."""
    whole = items.words[item]
    answer = whole[-ANSWER_WORDS:]
    texts = {}
    for start, n, p, sim in spots:
        before, after = items.reach[p]
        # as far as the rest of the item may be stretched
        at = max(0, start - before * 4 // 3 - BLOCK), start + n + after * 4 // 3 + BLOCK
        texts.setdefault(at, {})[p] = max(sim, texts.get(at, {}).get(p, 0.0))
    here = set().union(*(words[a:b].tolist() for a, b in texts))
    if sum(w in here for w in whole.tolist()) < weak * len(whole):
        return None
    most, found, by_piece = 0, False, {}
    for (a, b), pieces in texts.items():
        text = words[a:b]
        k, around = _near_lcs(whole, text)
        most = max(most, k)
        found = found or lcs(answer, around) >= ANSWER * len(answer)
        for p in pieces:
            k, around = _near_lcs(items.pieces[p][1], text)
            by_piece[p] = max(by_piece.get(p, 0), k)
            found = found or lcs(answer, around) >= ANSWER * len(answer)
    return [max(most, sum(by_piece.values())), max(s for t in texts.values() for s in t.values()), found]


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """``docs`` without the documents that leak an item; rows of null doc_id stay."""
    leaks = find_leaks(docs.select("doc_id", "text"), benchmark, **params).where("leak").select("doc_id").distinct()
    return docs.join(small_side(stage(leaks, "leak-ids")), "doc_id", "left_anti")
