"""Toxicity: nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

Fit.  Features are a text's words and their first 4 and 5 bytes (A-Z as a-z).  Document
frequencies in each class come from all training rows; the vocabulary is the
``features`` features most associated with either label (log-likelihood ratio of at least
``least_g2``), so that examples of both have vectors and vote.  Examples are at most ``examples`` training rows of each class, the
distinct texts of smallest hash; both bounds are parameters, so index and vocabulary have a fixed
size whatever the corpus.  An example's vector is sqrt(tf) * idf * the squared log ratio of the
feature's shares in the classes over the vocabulary, scaled to length 1; so common words that
only length makes significant weigh little, whichever label they lean to.

Score.  Every text looks up its whole text's features.  Postings of a feature lie in
blocks of examples with the block's largest weight; blocks are taken by falling bound, those whose bounds cannot reach the current k-th similarity are skipped, the others are
scored exactly: all texts take this path, ``TEXTS`` of them at a time, and a block is multiplied (in
float32) with those texts whose bounds call for it, and what may be among the nearest by more than rounding is scored exactly.  The ``neighbours`` nearest vote with weight sim^2 / (1 - sim + 0.05), times the
number of training rows that an example of its class stands for; the
score is the weighted share of label 1, smoothed toward the base rate of examples
with no feature.  A text without any feature gets that rate; so does an empty text.

Only text and label of training rows are inputs.  Defined cases: null text is empty;
a null label or one other than 0 and 1 is not a training row; repeated rows count each;
with no training row of label 1 every score is 0; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import small_side, stage, unstage
from .words import U, mix, text_slices, word_hashes

FEATURES, LEAST_G2, EXAMPLES, NEIGHBOURS, BLOCK = 4096, 15.0, 4000, 25, 64
TEXTS, SLACK = 128, 1e-4
PREFIXES = (4, 5)


def _features(buf: np.ndarray, rows: np.ndarray):
    """(feature hashes, row of each) of all occurrences; short words have no prefixes."""
    h, at, *more = word_hashes(buf, rows, PREFIXES)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(at))
    return np.concatenate([h, *more]), np.tile(row, 1 + len(more))


def _class_counts(train: DataFrame) -> DataFrame:
    """(f, toxic, clean): rows of each class that hold the feature; f = 0 counts all rows."""
    def merged(parts):
        f, inv = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return f, *[np.bincount(inv, np.concatenate([p[i] for p in parts]), len(f)).astype(np.int64) for i in (1, 2)]

    def run(batches):
        held, size = [], 0
        for batch in batches:
            label = batch.column(1).to_numpy()
            for lo, hi, buf, at in text_slices(batch.column(0)):
                h, row = _features(buf, at)
                _, first = np.unique(h ^ mix(row.astype(U) + U(1)), return_index=True)
                first = first[h[first] != 0]
                f = np.concatenate([h[first], np.zeros(hi - lo, U)])
                y = np.concatenate([label[lo:hi][row[first]], label[lo:hi]])
                held.append(merged([(f, y, 1 - y)]))
                size += len(held[-1][0])
                if size > 3_000_000:  # bounded memory: what was merged goes on to Spark
                    held = [merged(held)]
                    size = len(held[0][0])
                    if size > 1_500_000:
                        yield out(held.pop())
                        size = 0
        if held:
            yield out(merged(held))

    def out(m):
        return pa.RecordBatch.from_arrays([pa.array(m[0].view(np.int64)), pa.array(m[1]), pa.array(m[2])],
                                          names=["f", "toxic", "clean"])

    counts = train.select("text", "label").mapInArrow(run, "f bigint, toxic bigint, clean bigint")
    return counts.groupBy("f").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _vocabulary(train: DataFrame, features: int, least_g2: float):
    """Sorted feature hashes and their weights; at most ``features`` rows reach the driver."""
    counts = stage(_class_counts(train), "toxic-counts")
    total = counts.where("f = 0").first()
    if total is None or not total["toxic"] or not total["clean"]:
        return np.zeros(0, U), np.zeros(0), total["toxic"] if total else 0
    t, c = float(total["toxic"]), float(total["clean"])

    def term(n, e):
        return F.when(n > 0, n * F.log(n / e)).otherwise(0.0)

    n = F.col("toxic") + F.col("clean")
    g2 = 2 * (term(F.col("toxic"), n * (t / (t + c))) + term(F.col("clean"), n * (c / (t + c)))
              + term(t - F.col("toxic"), (t + c - n) * (t / (t + c))) + term(c - F.col("clean"), (t + c - n) * (c / (t + c))))
    top = (counts.where(F.col("f") != 0)
           .select("f", "toxic", "clean", n.alias("n"), g2.alias("g2")).where(F.col("g2") >= least_g2)
           .orderBy(F.desc("g2"), "f").limit(features).collect())
    f = np.array([r["f"] for r in top], np.int64).view(U)
    idf = np.log((t + c + 1) / (np.array([r["n"] for r in top], float) + 1)) + 1
    share = [(np.array([r[y] for r in top], float) + 0.5) / (rows + 1) for y, rows in (("toxic", t), ("clean", c))]
    weight = idf * np.log(share[0] / share[1]) ** 2
    order = np.argsort(f)
    return f[order], weight[order], total["toxic"]


def vectors(buf: np.ndarray, rows: np.ndarray, vocab: np.ndarray, idf: np.ndarray):
    """For each row (feature indexes, weights of length 1) over the vocabulary."""
    n = len(rows) - 1
    if not len(vocab):
        return [(np.zeros(0, np.int64), np.zeros(0))] * n
    h, row = _features(buf, rows)
    at = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
    hit = np.flatnonzero(vocab[at] == h)
    key, tf = np.unique(row[hit] * len(vocab) + at[hit], return_counts=True)
    r, f = key // len(vocab), key % len(vocab)
    w = np.sqrt(tf) * idf[f]
    norm = np.sqrt(np.bincount(r, w * w, n))
    w = w / np.maximum(norm[r], 1e-300) if len(r) else w
    cut = np.searchsorted(r, np.arange(n + 1))
    return [(f[a:b], w[a:b]) for a, b in zip(cut, cut[1:])]


class BlockMaxIndex:
    """Postings of unit vectors in blocks of ``BLOCK`` examples, with each block's largest weight."""

    def __init__(self, examples: list, labels: np.ndarray, ids: list, n_features: int):
        # like vectors lie in like blocks, so that bounds are tight
        order = sorted(range(len(examples)), key=lambda i: (tuple(examples[i][0][np.argsort(-examples[i][1])][:3]), i))
        self.labels, self.ids = labels[order], [ids[i] for i in order]
        f = np.concatenate([examples[i][0] for i in order] or [np.zeros(0, np.int64)])
        w = np.concatenate([examples[i][1] for i in order] or [np.zeros(0)])
        e = np.repeat(np.arange(len(order)), [len(examples[i][0]) for i in order])
        by = np.argsort(f, kind="stable")
        f, self.weight, self.example = f[by], w[by], e[by]
        self.at = np.searchsorted(f, np.arange(n_features + 1))
        self.n_blocks = -(-max(len(order), 1) // BLOCK)
        self.block_max = np.zeros((n_features, self.n_blocks), np.float32)
        np.maximum.at(self.block_max, (f, self.example // BLOCK), self.weight.astype(np.float32))

        # each block's own features and their weights, a column for each of its examples
        own = np.unique(f * self.n_blocks + self.example // BLOCK)
        self.block_features = [np.sort(own[own % self.n_blocks == b] // self.n_blocks) for b in range(self.n_blocks)]
        self.n_features = n_features
        by = np.argsort(self.example, kind="stable")
        self.row_f, self.row_w = f[by], self.weight[by]
        self.row_at = np.searchsorted(self.example[by], np.arange(len(order) + 1))

    def _weights(self, b: int) -> np.ndarray:
        """Weights of block ``b`` by its features and examples; made once in each process that scores."""
        if "matrices" not in self.__dict__:
            self.matrices = {}
            f = np.repeat(np.arange(self.n_features), np.diff(self.at))
            block = self.example // BLOCK
            by = np.argsort(block, kind="stable")
            cut = np.searchsorted(block[by], np.arange(self.n_blocks + 1))
            for i, mine in enumerate(self.block_features):
                p = by[cut[i]:cut[i + 1]]
                m = np.zeros((len(mine), min(BLOCK, len(self.labels) - i * BLOCK)), np.float32)
                m[np.searchsorted(mine, f[p]), self.example[p] - i * BLOCK] = self.weight[p]
                self.matrices[i] = m
        return self.matrices[b]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "matrices"}

    def nearest_of_all(self, texts: list, k: int) -> list:
        """The exact k largest cosines of each text (f, w) as (examples, similarities); ties to the lower example."""
        out = []
        for lo in range(0, len(texts), TEXTS):
            out += self._nearest(texts[lo:lo + TEXTS], k)
        return out

    def _nearest(self, texts: list, k: int) -> list:
        q = np.zeros((self.n_features, len(texts)), np.float32)
        for r, (f, w) in enumerate(texts):
            q[f, r] = w
        bound = np.stack([w.astype(np.float32) @ self.block_max[f] for f, w in texts]) * np.float32(1.00001)
        found = np.zeros((len(self.labels), len(texts)), np.float32)
        floor = np.zeros(len(texts))
        # blocks of the highest bounds first: they set the similarity that the others must reach
        by = np.argsort(-bound, axis=1, kind="stable")
        first = min(-(-2 * k // BLOCK), self.n_blocks)
        leading = np.zeros(bound.shape, bool)
        np.put_along_axis(leading, by[:, :first], True, axis=1)
        for part in (leading, ~leading):
            turn = part & (bound > 0) & (bound >= floor[:, None] - SLACK)
            for b in np.flatnonzero(turn.any(axis=0)):
                rows, here = np.flatnonzero(turn[:, b]), slice(b * BLOCK, b * BLOCK + BLOCK)
                mine = q[self.block_features[b]]  # a column for each text
                if 2 * len(rows) > len(texts):
                    found[here] = self._weights(b).T @ mine
                else:
                    found[here, rows] = self._weights(b).T @ mine[:, rows]
            if part is leading and len(self.labels) > k:
                best = (by[:, :first, None] * BLOCK + np.arange(BLOCK)).reshape(len(texts), -1)
                seen = np.where(best < len(self.labels), found[np.minimum(best, len(self.labels) - 1), np.arange(len(texts))[:, None]], 0)
                floor = np.partition(seen, -k, axis=1)[:, -k] if seen.shape[1] > k else floor
        out = []
        full = np.zeros(self.n_features)
        for row, (f, w) in zip(np.ascontiguousarray(found.T), texts):
            # all that can be among the k by more than the rounding of float32, with exact similarities
            least = max(np.partition(row, -k)[-k] - SLACK, 0) if len(row) > k else 0
            e = np.flatnonzero((row >= least) & (row > 0))
            full[f] = w
            cut = np.cumsum(np.append(0, self.row_at[e + 1] - self.row_at[e]))
            at = np.repeat(self.row_at[e] - cut[:-1], np.diff(cut)) + np.arange(cut[-1])
            sim = np.bincount(np.repeat(np.arange(len(e)), np.diff(cut)), full[self.row_f[at]] * self.row_w[at], len(e))
            full[f] = 0
            best = np.lexsort((e, -np.round(sim, 12)))[:k]
            out.append((e[best], sim[best]))
        return out

    def nearest(self, f: np.ndarray, w: np.ndarray, k: int):
        """``nearest_of_all`` of one text."""
        return self._nearest([(f, w)], k)[0]


def score_toxicity(docs: DataFrame, train: DataFrame, features: int = FEATURES, least_g2: float = LEAST_G2,
                   examples: int = EXAMPLES, neighbours: int = NEIGHBOURS) -> DataFrame:
    """doc_id, score (0 to 1), evidence (nearest examples: doc_id, label, similarity) for every row of docs.

    ``train``: doc_id (only named in the evidence), text, label (0 or 1).
    """
    train = stage(train.where("label IN (0, 1)").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("long").alias("label")), "toxic-train")
    vocab, idf, n_toxic = _vocabulary(train, features, least_g2)
    # the example set: a fixed number of rows of each class, reduced to vocabulary vectors
    spark = docs.sparkSession
    pick = train.withColumn("h", F.xxhash64("text"))
    chosen = []
    for y in (0, 1) if n_toxic else ():
        # one row for each distinct text, so copies don't crowd out others
        of = pick.where(F.col("label") == y)
        first = of.groupBy("h").agg(F.min("doc_id").alias("doc_id")).orderBy("h").limit(examples)
        chosen += _example_vectors(of.join(F.broadcast(first), ["h", "doc_id"]), vocab, idf).collect()
    n_clean = train.where("label = 0").count()
    unstage(train)
    found = [(np.frombuffer(r["f"], np.int64), np.frombuffer(r["w"], np.float64)) for r in chosen]
    label = np.array([r["label"] for r in chosen], np.int64)
    full = [i for i, (f, _) in enumerate(found) if len(f)]
    none = [y for (f, _), y in zip(found, label) if not len(f)]
    totals = np.bincount(label, minlength=2) if len(label) else np.array([1, 0])
    # shares in the training rows, not in the balanced examples
    weight = np.array([1.0, 1.0])
    if n_toxic:
        weight = np.array([n_clean / max(1, totals[0]), n_toxic / max(1, totals[1])])
    c = np.bincount(np.array(none, np.int64), minlength=2) * weight if none else np.zeros(2)
    base = float((c[1] + 0.5) / (c.sum() + 1 + 0.5 / 0.01)) if n_toxic else 0.0
    index = BlockMaxIndex([found[i] for i in full], label[full], [chosen[i]["doc_id"] for i in full], len(vocab))
    shared = spark.sparkContext.broadcast((vocab, idf, index, weight / weight.min()))

    def run(batches):
        vocab, idf, index, stands_for = shared.value
        for batch in batches:
            for lo, hi, buf, at in text_slices(batch.column(1)):
                score, evidence = [], []
                of = vectors(buf, at, vocab, idf)
                found = index.nearest_of_all(of, neighbours) if len(index.labels) else [((), ())] * len(of)
                for e, sim in found:
                    s, near = base, []
                    if len(e):
                        v = sim * sim / (1.05 - np.minimum(sim, 1.0)) * stands_for[index.labels[e]]
                        s = float((v @ index.labels[e] + base) / (v.sum() + 1))
                        near = [{"doc_id": index.ids[i], "label": int(index.labels[i]), "similarity": float(x)}
                                for i, x in zip(e, sim)]
                    score.append(min(1.0, max(0.0, s)))
                    evidence.append(near)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(score, pa.float64()), pa.array(evidence, near_type)],
                    names=["doc_id", "score", "evidence"])

    from pyspark.sql.pandas.types import to_arrow_type
    tid, did = train.schema["doc_id"].dataType, docs.schema["doc_id"].dataType
    near_type = pa.list_(pa.struct([("doc_id", to_arrow_type(tid)), ("label", pa.int64()), ("similarity", pa.float64())]))
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {did.simpleString()}, score double, "
             f"evidence array<struct<doc_id:{tid.simpleString()},label:bigint,similarity:double>>")


def _example_vectors(rows: DataFrame, vocab: np.ndarray, idf: np.ndarray) -> DataFrame:
    def run(batches):
        for batch in batches:
            for lo, hi, buf, at in text_slices(batch.column(1)):
                v = vectors(buf, at, vocab, idf)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo),
                     pa.array([f.astype(np.int64).tobytes() for f, _ in v], pa.binary()),
                     pa.array([w.astype(np.float64).tobytes() for _, w in v], pa.binary())],
                    names=["doc_id", "label", "f", "w"])

    t = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", "label").mapInArrow(run, f"doc_id {t}, label bigint, f binary, w binary")


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled documents whose crc32(doc_id as text) mod 4 is not 2."""
    named = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select("doc_id", F.col("toxic").alias("label"))
    named = named.where("crc32(cast(doc_id AS string)) % 4 <> 2")
    return docs.select("doc_id", "text").join(small_side(named), "doc_id")
