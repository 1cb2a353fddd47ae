"""MinHash near-dedup with odd sketches.

A document's set holds its distinct ``k``-word shingles (A-Z as a-z); with fewer words
the whole sequence is the one shingle; without words the set is empty and links with
nothing.  Two documents are linked if 100 * intersection >= percent * union.

1. One pass over the texts (NumPy in Arrow batches, no shuffle of text) gives each
   document its set size, a 128-bit digest of the set, band keys of its MinHash samples
   and its odd sketch: every sample toggles one bit of a bitmap.
2. Documents with equal sets meet in a class (one row each way, combined before the
   shuffle); only class representatives go on.
3. ``links`` turns band buckets into candidate pairs.  A pair goes on if the population
   count of the XOR of its odd sketches is within the bound that a pair at the
   threshold exceeds with negligible probability (``max_xor_bits``).  A second bitmap, the
   parity of the whole set, sharpens this for small sets: two such bitmaps differ in at
   most as many bits as the sets in members, so its bound loses no pair at all.
4. The sets of the remaining documents are made again from the full texts, and the pairs
   are confirmed on them exactly.  Union-find gives the components.

Defined cases: null text is empty; a null doc_id is never linked and its component is
null unless its set equals that of a numbered document; rows that repeat a doc_id count
as one document with both sets' links; other columns are ignored; empty table: no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .links import components, cross_pairs, multi_buckets, star_pairs, verified_pairs, xor_bits
from .staging import small_side, stage, unstage
from .words import U, mix, text_slices, word_hashes

BANDS, ROWS, SKETCH_BITS = 20, 4, 512


def shingles(buf: np.ndarray, rows: np.ndarray, k: int):
    """(distinct shingle hashes of all rows, sorted in each; offset of each row's first)."""
    h, at = word_hashes(buf, rows)
    odd = mix(np.arange(1, k + 2, dtype=U)) | U(1)
    n = len(h)
    acc = np.zeros(max(n - k + 1, 0), U)
    for j in range(k):
        acc += h[j:n - k + 1 + j] * odd[j] if n >= k else U(0)
    acc = mix(acc)
    parts, offs = [], np.zeros(len(at), np.int64)
    for d in range(len(at) - 1):
        a, b = at[d], at[d + 1]
        if b - a >= k:
            u = np.unique(acc[a:b - k + 1])
        elif b > a:
            u = mix((h[a:b] * odd[:b - a]).sum(keepdims=True) + odd[k:k + 1] * U(b - a))
        else:
            u = acc[:0]
        parts.append(u)
        offs[d + 1] = offs[d] + len(u)
    return (np.concatenate(parts) if parts else acc[:0]), offs


def _reduce(op, values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """op over each row's values; 0 for rows without."""
    out = np.zeros(len(offs) - 1, values.dtype)
    full = np.flatnonzero(np.diff(offs))
    if len(full):
        out[full] = op.reduceat(values, offs[:-1][full])
    return out


def minhash(sets: np.ndarray, offs: np.ndarray, samples: int) -> np.ndarray:
    """(rows, samples) smallest values of 32-bit hashes of each set; 0 for empty sets."""
    x = (sets >> U(32)).astype(np.uint32)
    mul = (mix(np.arange(1, samples + 1, dtype=U) * U(77)) >> U(32)).astype(np.uint32) | np.uint32(1)
    add = (mix(np.arange(1, samples + 1, dtype=U) * U(991)) >> U(32)).astype(np.uint32)
    return np.stack([_reduce(np.minimum, x * mul[j] + add[j], offs) for j in range(samples)], axis=1)


def odd_sketch(samples: np.ndarray, bits: int) -> np.ndarray:
    """(rows, bits / 64) int64: the parity bitmap of each row's MinHash samples."""
    r, k = samples.shape
    bit = (mix(samples.astype(U) + (np.arange(k, dtype=U) << U(33))) % U(bits)).astype(np.int64)
    count = np.bincount((np.arange(r)[:, None] * bits + bit).ravel(), minlength=r * bits)
    return np.packbits((count & 1).astype(np.uint8).reshape(r, bits), axis=1).view(np.int64)


def parity(sets: np.ndarray, offs: np.ndarray, bits: int) -> np.ndarray:
    """(rows, bits / 64) int64: the parity bitmap of each row's whole set."""
    r = len(offs) - 1
    at = np.repeat(np.arange(r), np.diff(offs)) * bits + (sets % U(bits)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=r * bits) & 1).astype(np.uint8).reshape(r, bits), axis=1).view(np.int64)


def max_xor_bits(percent: int, samples: int, bits: int) -> int:
    """XOR bits that a pair at the threshold exceeds with negligible probability: 4.5 standard
    deviations above the mean; pairs above the threshold have fewer."""
    p = 1 - percent / 100

    def bits_of(differ):  # each differing sample toggles one bit in each sketch
        return bits / 2 * (1 - (1 - 2 / bits) ** (2 * differ))

    mean, sd = samples * p, math.sqrt(samples * p * (1 - p))
    spread = math.hypot(bits_of(mean + sd) - bits_of(mean), math.sqrt(bits_of(mean) * bits_of(mean) / bits) + 1)
    return math.ceil(bits_of(mean) + 4.5 * spread)


def _lists(a: np.ndarray) -> pa.Array:
    r, w = a.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (r + 1) * w, w, dtype=np.int32)),
                                    pa.array(np.ascontiguousarray(a).ravel().view(np.int64)))


def _signatures(docs: DataFrame, k: int, bands: int, rows: int, bits: int) -> DataFrame:
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        odd = mix(np.arange(11, 11 + rows, dtype=U)) | U(1)
        for batch in batches:
            for lo, hi, buf, at in text_slices(batch.column(1)):
                sets, offs = shingles(buf, at, k)
                m = minhash(sets, offs, bands * rows)
                keys = (m.astype(U).reshape(len(m), bands, rows) * odd).sum(axis=2, dtype=U)
                keys = mix(keys + mix(np.arange(1, bands + 1, dtype=U) * U(0x10001)))
                d1 = _reduce(np.add, mix(sets ^ U(0x1234567)), offs).view(np.int64)
                d2 = _reduce(np.add, mix(sets ^ U(0x89ABCDEF01)), offs).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(offs)), pa.array(d1), pa.array(d2),
                     _lists(keys), _lists(np.hstack([odd_sketch(m, bits), parity(sets, offs, bits)]))],
                    names=["doc_id", "n_shingles", "d1", "d2", "bands", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {id_type}, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>, sketch array<bigint>")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for lo, hi, buf, at in text_slices(batch.column(1)):
                sets, offs = shingles(buf, at, k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo),
                     pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(sets.view(np.int64)))],
                    names=["node", "s"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"node {id_type}, s array<bigint>")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS,
                    bits: int = SKETCH_BITS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept for every row of ``docs``."""
    sig = stage(_signatures(docs, k, bands, rows, bits), "near-signatures")
    classes = stage(sig.where("n_shingles > 0").groupBy("n_shingles", "d1", "d2")
                    .agg(F.min("doc_id").alias("node")).where("node IS NOT NULL"), "near-classes")
    reps = stage(sig.join(classes.withColumnRenamed("node", "doc_id"), ["n_shingles", "d1", "d2", "doc_id"])
                 .select(F.col("doc_id").alias("node"), "n_shingles", "bands", "sketch"), "near-representatives")
    multi = stage(multi_buckets(reps.select("node", F.explode("bands").alias("key"))), "near-buckets")
    words, samples = bits // 64, bands * rows
    sketches = reps.select("node", F.col("n_shingles").alias("n"),
                           *[F.get("sketch", F.lit(i)).alias(f"s{i}") for i in range(2 * words)])
    total = F.col("nx") + F.col("ny")
    near = ((100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny"))
            & (xor_bits("xs", "ys", range(words)) <= max_xor_bits(percent, samples, bits))
            & (xor_bits("xs", "ys", range(words, 2 * words)) * (100 + percent) <= total * (100 - percent)))

    def close_stars() -> DataFrame:
        def side(c):
            return sketches.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"),
                                   *[F.col(f"s{i}").alias(f"{c}s{i}") for i in range(2 * words)])
        pairs = star_pairs(multi).toDF("x", "y")
        return (pairs.join(side("x"), "x").join(side("y"), "y").where(near)
                .select(F.col("x").alias("a"), F.col("y").alias("b")))

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = stage(pairs, "near-pairs")
        nodes = stage(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "near-nodes")
        sets = stage(_sets(docs.select("doc_id", "text").join(small_side(nodes), "doc_id", "left_semi"), k),
                     "near-sets")
        links = verified_pairs(pairs, sets, percent, "near-links")
        unstage(pairs, nodes, sets)
        return links

    links = confirmed(close_stars())
    labels = stage(components(links, "near-cc"), "near-labels")
    more = confirmed(cross_pairs(multi, labels, sketches, 2 * words, near))
    if more.limit(1).count():
        labels = stage(components(links.union(more), "near-cc"), "near-labels")
    named = (classes.join(labels, "node", "left")
             .select("n_shingles", "d1", "d2", F.coalesce("comp", "node").alias("component_id")))
    rows_ = sig.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("d1"))
                       .otherwise(F.xxhash64("doc_id")).alias("d1"), "d2")
    unstage(reps, multi)
    out = rows_.join(named, ["n_shingles", "d1", "d2"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
                      F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(False)).alias("kept"))
