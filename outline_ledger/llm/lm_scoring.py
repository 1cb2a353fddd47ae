"""LM scoring: a bigram model as a weighted backoff automaton.

Tokens are the words of a text (A-Z as a-z) and one end token.  States are the words and
the start of a text; a state u has an arc for every token w that followed it in
training, with log10(max(c(uw) - D, 0) / c(u) + lambda(u) p(w)), and a failure arc of weight
log10 lambda(u), lambda(u) = D * T(u) / c(u), to the root, whose arcs are the additive
unigrams p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)); T(u) counts the different followers, D is
n1 / (n1 + 2 n2) from the counts of bigrams.  Every state's arcs and its failure arc sum
to 1.  A text is read once from left to right; the state is the last token.

The model grows with the corpus, so it is never gathered anywhere:

1. Each task turns its texts into chunks: token codes, the hashes of the chunk's different
   words, its different bigrams and their training counts (NumPy, compressed).
2. The counts go to ``buckets`` by the hash of the history word.  Words that hold a large
   share of some chunk are dealt by the follower's hash instead, so no bucket holds the
   followers of a very frequent word; their T(u) is summed in a second, small step.
3. A bucket adds up the counts of all chunks and answers each chunk, in the chunk's own
   order: c(u), T(u) and c(uw).
4. Each chunk meets its answers and walks its texts through the automaton.

Defined cases: null text is empty (one end token); a null doc_id is not training; repeated
rows count each; extra columns are ignored; an empty training set gives N = V = 0
and base probabilities of 1; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import stage, unstage
from .words import U, mix, text_slices, word_hashes

CHUNK_TOKENS = 2_000_000
END, START = U(0x656E64), U(0x7374617274)


def _pack(a: np.ndarray) -> bytes:
    """Little-endian bytes by byte plane, compressed."""
    b = np.ascontiguousarray(a)
    return zlib.compress(b.view(np.uint8).reshape(len(b), b.itemsize).T.tobytes(), 1)


def _unpack(b: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(b), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype)


def _chunks(docs: DataFrame, chunk_tokens: int) -> DataFrame:
    """One row per chunk: ids and training marks of its texts, token counts, codes, word hashes."""
    def run(batches):
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for lo, hi, buf, at in text_slices(batch.column(1)):
                h, first = word_hashes(buf, at)
                n = np.diff(first) + 1
                tokens = np.insert(h, first[1:], END)
                held.append((batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), n, tokens))
                size += len(tokens)
                if size >= chunk_tokens:
                    yield out(part, number, held)
                    number, held, size = number + 1, [], 0
        if held:
            yield out(part, number, held)

    def out(part, number, held):
        ids = pa.concat_arrays([x[0] for x in held])
        train = pa.concat_arrays([x[1] for x in held])
        n = np.concatenate([x[2] for x in held]).astype(np.int32)
        words, codes = np.unique(np.concatenate([x[3] for x in held]), return_inverse=True)
        lists = pa.array([0, len(n)], pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array([part * 1_000_000 + number], pa.int64()), pa.ListArray.from_arrays(lists, ids),
             pa.ListArray.from_arrays(lists, train), pa.array([_pack(n)]), pa.array([_pack(codes.astype(np.uint32))]),
             pa.array([words.tobytes()], pa.binary())],
            names=["chunk", "ids", "train", "n", "codes", "words"])

    return docs.select(F.col("doc_id").cast("string"), "text", "train").mapInArrow(
        run, "chunk bigint, ids array<string>, train array<boolean>, n binary, codes binary, words binary")


def _bigrams(n: np.ndarray, codes: np.ndarray, train: np.ndarray, n_words: int):
    """Of a chunk: history of each token (n_words is the start), key of each token's bigram,
    the sorted different keys, each token's place in them, mark of training tokens."""
    start = np.cumsum(n) - n
    hist = np.empty(len(codes), np.int64)
    hist[1:] = codes[:-1]
    hist[start] = n_words
    key = hist * n_words + codes
    keys, place = np.unique(key, return_inverse=True)
    return hist, keys, place, np.repeat(train, n)


def _requests(row, hot: np.ndarray, buckets: int):
    """Of a chunk: its words, tokens, bigrams and training counts, and for each bucket which bigrams
    (``order`` cut at ``cut``, by history and follower) and words (``word_order``) it is asked for."""
    words = np.frombuffer(row["words"], U)
    codes = _unpack(row["codes"], np.uint32).astype(np.int64)
    n, train = _unpack(row["n"], np.int32), np.array(row["train"], bool)
    hist, keys, place, tt = _bigrams(n, codes, train, len(words))
    cw = np.bincount(codes[tt], minlength=len(words)).astype(np.uint32)
    cb = np.bincount(place[tt], minlength=len(keys)).astype(np.uint32)
    hu, hw = keys // len(words), keys % len(words)
    known = np.append(words, START)
    is_hot = np.isin(known, hot)
    deal = np.where(is_hot[hu], mix(known[hw] ^ U(0x5151)), mix(known[hu])) % U(buckets)
    order = np.lexsort((known[hw], known[hu], deal))
    word_deal = mix(words) % U(buckets)
    word_order = np.argsort(word_deal, kind="stable")  # words are sorted, so they are in each bucket
    word_cut = np.searchsorted(word_deal[word_order], np.arange(buckets + 1, dtype=U))
    cut = np.searchsorted(deal[order], np.arange(buckets + 1, dtype=U))
    return words, known, codes, n, hist, place, cw, cb, hu, hw, order, cut, word_order, word_cut


def _runs(u: np.ndarray):
    """(values, first places) of the runs of equal neighbours."""
    at = np.flatnonzero(np.append(True, u[1:] != u[:-1])[:len(u)])
    return u[at], at


def _ask(chunks: DataFrame, hot, buckets: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                words, known, _, _, _, _, cw, cb, hu, hw, order, cut, worder, wcut = _requests(row, hot.value, buckets)
                for b in range(buckets):
                    i, w = order[cut[b]:cut[b + 1]], worder[wcut[b]:wcut[b + 1]]
                    if not len(i) and not len(w):
                        continue
                    u, run_at = _runs(hu[i])
                    own = words[w]
                    at = np.minimum(np.searchsorted(own, known[u]), max(len(own) - 1, 0))
                    far = own[at] != known[u] if len(own) else np.ones(len(u), bool)
                    at[far] = len(own) + np.arange(int(far.sum()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b], pa.int32()), pa.array([row["chunk"]], pa.int64()),
                         *[pa.array([x], pa.binary()) for x in (
                             own.tobytes(), _pack(cw[w]), known[u[far]].tobytes(),
                             _pack(np.diff(at, prepend=0).astype(np.int32)),
                             _pack(np.diff(np.append(run_at, len(i))).astype(np.uint32)),
                             known[hw[i]].tobytes(), _pack(cb[i]))]],
                        names=["bucket", "chunk", "words", "cw", "far", "hist", "runs", "next", "cb"])

    return chunks.select("chunk", "train", "n", "codes", "words").mapInArrow(
        run, "bucket int, chunk bigint, words binary, cw binary, far binary, hist binary, runs binary, "
             "next binary, cb binary")


def _answer(pdf: pd.DataFrame, hot: np.ndarray) -> pd.DataFrame:
    """Counts of one bucket over all chunks, handed back in each chunk's order, and (chunk -1)
    the bucket's sums with its part of the followers of hot words."""
    bucket = int(pdf["bucket"].iloc[0])
    words = [np.frombuffer(x, U) for x in pdf["words"]]
    wu, winv = np.unique(np.concatenate(words), return_inverse=True)
    wc = np.bincount(winv, np.concatenate([_unpack(x, np.uint32) for x in pdf["cw"]]), len(wu)).astype(np.int64)
    hist = [np.append(w, np.frombuffer(f, U))[np.cumsum(_unpack(h, np.int32))]
            for w, f, h in zip(words, pdf["far"], pdf["hist"])]
    nxt = [np.frombuffer(x, U) for x in pdf["next"]]
    hu, hinv = np.unique(np.concatenate([np.repeat(h, _unpack(r, np.uint32)) for h, r in zip(hist, pdf["runs"])]),
                         return_inverse=True)
    follower = np.concatenate(nxt)
    order = np.lexsort((follower, hinv))
    new = np.ones(len(order), bool)
    new[1:] = (hinv[order][1:] != hinv[order][:-1]) | (follower[order][1:] != follower[order][:-1])
    group = np.cumsum(new) - 1
    cb = np.concatenate([_unpack(x, np.uint32) for x in pdf["cb"]])
    count = np.bincount(group, cb[order], int(new.sum())).astype(np.int64)
    place = np.empty(len(order), np.int64)
    place[order] = group
    follow = np.bincount(hinv[order][new][count > 0], minlength=len(hu)).astype(np.int64)
    out, wat, bat = [], 0, 0
    for chunk, w, h, x in zip(pdf["chunk"], words, hist, nxt):
        out.append((bucket, int(chunk), _pack(wc[winv[wat:wat + len(w)]].astype(np.uint64)),
                    _pack(follow[np.searchsorted(hu, h)].astype(np.uint64)),
                    _pack(count[place[bat:bat + len(x)]].astype(np.uint64)), None, None, None, None, None, None))
        wat, bat = wat + len(w), bat + len(x)
    big = np.flatnonzero(np.isin(hu, hot) & (follow > 0))
    out.append((bucket, -1, None, None, None, int(wc.sum()), int((wc > 0).sum()),
                int((count == 1).sum()), int((count == 2).sum()), hu[big].view(np.int64).tolist(), follow[big].tolist()))
    return pd.DataFrame(out, columns=["bucket", "chunk", "cw", "follow", "cb", "tokens", "types", "n1", "n2", "u", "t"])


_ANSWER = ("bucket int, chunk bigint, cw binary, follow binary, cb binary, tokens bigint, types bigint, n1 bigint, "
           "n2 bigint, u array<bigint>, t array<bigint>")


def lm_scores(docs: DataFrame, chunk_tokens: int = CHUNK_TOKENS, buckets: int | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row.

    ``docs``: doc_id, text, train (boolean).
    """
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = stage(_chunks(docs.withColumn("train", F.coalesce("train", F.lit(False))), chunk_tokens), "lm-chunks")
    hot_share = 1 / (4 * buckets)
    hot_rows = _hot_words(chunks, hot_share).collect()  # at most 4 * buckets words
    hot = np.array([r["word"] for r in hot_rows], np.int64).view(U)
    shared_hot = spark.sparkContext.broadcast(hot)
    asked = _ask(chunks, shared_hot, buckets)
    answers = stage(asked.groupBy("bucket").applyInPandas(lambda pdf: _answer(pdf, shared_hot.value), _ANSWER),
                    "lm-answers", arrow_rows=4)
    sums = answers.where("chunk = -1")
    tot = sums.agg(F.sum("tokens").alias("n"), F.sum("types").alias("v"), F.sum("n1").alias("n1"),
                   F.sum("n2").alias("n2")).first()
    pairs = sums.select(F.explode(F.arrays_zip("u", "t")).alias("p")).groupBy("p.u").agg(F.sum("p.t").alias("t"))
    hot_t = {r["u"]: r["t"] for r in pairs.collect()}  # hot words only
    hot_follow = np.array([hot_t.get(int(x), 0) for x in hot.view(np.int64)], np.int64)
    train_docs = chunks.select(F.explode("train").alias("x")).where("x").count()
    n_all, v_all = tot["n"] or 0, tot["v"] or 0
    n1, n2 = tot["n1"] or 0, tot["n2"] or 0
    model = spark.sparkContext.broadcast((hot, hot_follow, n_all, v_all, n1 / (n1 + 2 * n2) if n1 else 0.5, train_docs))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def walk(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        hot, hot_follow, n_all, v_all, disc, train_docs = model.value
        frames = [_score_chunk(row, right, hot, hot_follow, n_all, v_all, disc, train_docs, buckets)
                  for row in left.to_dict("records")]
        return pd.concat(frames) if frames else pd.DataFrame(columns=_COLUMNS)

    own = answers.where("chunk >= 0").select("bucket", "chunk", "cw", "follow", "cb")
    scored = (chunks.groupBy("chunk").cogroup(own.groupBy("chunk"))
              .applyInPandas(walk, "doc_id string, n_tokens bigint, n_known bigint, base_score double, score double"))
    out = stage(scored, "lm-scores")
    unstage(chunks, answers)
    return out.select(F.col("doc_id").cast(id_type), "n_tokens", "n_known",
                      F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")


_COLUMNS = ["doc_id", "n_tokens", "n_known", "base_score", "score"]


def _score_chunk(row, answers, hot, hot_follow, n_all, v_all, disc, train_docs, buckets) -> pd.DataFrame:
    """Walk every text of a chunk through the part of the automaton that it touches."""
    words, known, codes, n, hist, place, _, _, hu, _, order, cut, worder, wcut = _requests(row, hot, buckets)
    cw, cb = np.zeros(len(words), np.int64), np.zeros(len(hu), np.int64)
    follow = np.zeros(len(known), np.int64)
    for b, x, t, y in zip(answers["bucket"], answers["cw"], answers["follow"], answers["cb"]):
        cw[worder[wcut[b]:wcut[b + 1]]] = _unpack(x, np.uint64)
        i = order[cut[b]:cut[b + 1]]
        cb[i] = _unpack(y, np.uint64)
        follow[_runs(hu[i])[0]] = _unpack(t, np.uint64)
    if len(hot):
        by = np.argsort(hot)
        at = np.minimum(np.searchsorted(hot[by], known), len(hot) - 1)
        same = hot[by][at] == known
        follow[same] = hot_follow[by][at[same]]
    root = (cw + 0.5) / (n_all + 0.5 * (v_all + 1))
    log_root = np.log10(root) if n_all else np.zeros(len(root))
    c_hist = np.append(cw, train_docs).astype(float)
    has = (c_hist > 0) & (follow > 0)
    fail = np.where(has, disc * follow / np.maximum(c_hist, 1), 1.0)
    w = codes
    arc = np.maximum(cb[place] - disc, 0) / np.maximum(c_hist[hist], 1)
    p = np.where(has[hist], arc + fail[hist] * root[w], root[w])
    start = np.cumsum(n) - n
    return pd.DataFrame({
        "doc_id": row["ids"], "n_tokens": n.astype(np.int64),
        "n_known": np.add.reduceat((cw > 0)[w].astype(np.int64), start),
        "base_score": np.add.reduceat(log_root[w], start),
        "score": np.add.reduceat(np.log10(p) if n_all else np.zeros(len(w)), start)})


def _hot_words(chunks: DataFrame, share: float) -> DataFrame:
    """The start state, and words that the chunks where they hold ``share`` of the tokens hold to
    at least ``share`` of all tokens; a word with twice that share is always among them."""
    def run(batches):
        for batch in batches:
            for codes, words in zip(*[batch.column(c).to_pylist() for c in (0, 1)]):
                c = np.bincount(_unpack(codes, np.uint32))
                many = c >= share * c.sum()
                word = np.append(np.frombuffer(words, U)[many], START)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(word.view(np.int64)), pa.array(np.append(c[many], c.sum()))], names=["word", "c"])

    found = (chunks.select("codes", "words").mapInArrow(run, "word bigint, c bigint")
             .groupBy("word").agg(F.sum("c").alias("c")))
    found = stage(found, "lm-hot", arrow_rows=4)
    total = found.where(F.col("word") == int(START)).select(F.max("c")).first()[0] or 0
    return found.where(F.col("c") >= share * total).select("word")
