"""Exact top-k inner products by a bit-sliced index.

Vectors are quantised to integers.  A block of rows is indexed by bitmaps: for each
dimension the values, less the block's smallest, are cut into bit slices of one bit per row.
A query's inner product is a sum of slices with bitmap arithmetic: each set bit of the
query's component adds the slices of that dimension, shifted, for negative components their
complements, and carry-save adders reduce the bitmaps of each weight to the score's
slices.  The top rows are selected from the most significant slice downward; rows at the
boundary are resolved exactly, ties to the smaller vec_id.

Blocks meet blocks of queries (a stated query set against all rows); each pair yields
at most k + 1 rows for a query, and the last ranking is over these.  A block holds at most
``BLOCK_ROWS`` rows, so the memory of a task does not depend on the input.

Defined cases: vectors that are null, hold null or non-finite components or have another
length than the query take no part in its ranking; finite components of any size count (a quantised
one beyond 64 bits as the nearest long), ranks go by the exact inner products, and a score beyond 64 bits
is returned as the nearest long; a null vec_id takes no part; rows that
repeat a vec_id are candidates each (not for their own id); other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage, unstage

BLOCK_ROWS, QUERY_ROWS = 16_384, 256
LOW = (1 << 62) - 1  # a score's low bits, stored apart from the high ones


def slices_of(x: np.ndarray):
    """(bitmaps (dims, bits, words) of x - low, low per dimension, bits)."""
    rows, dims = x.shape
    low = x.min(axis=0)
    v = x.astype(np.uint64) - low.astype(np.uint64)  # differences of 64-bit numbers, without a sign
    bits = max(1, int(v.max()).bit_length())
    words = -(-rows // 64)
    out = np.zeros((dims, bits, words * 8), np.uint8)
    for b in range(bits):
        out[:, b, :-(-rows // 8)] = np.packbits(((v >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), axis=0, bitorder="little").T
    return out.view(np.uint64), low, bits


def score_slices(bitmaps: np.ndarray, query: np.ndarray):
    """Bit slices (least first) of sum(|q| * v) over dimensions, v complemented where q < 0."""
    columns: dict[int, list] = {}
    for d in np.flatnonzero(query):
        m = abs(int(query[d]))
        s = bitmaps[d] if query[d] > 0 else ~bitmaps[d]
        for j in range(m.bit_length()):
            if m >> j & 1:
                for i in range(len(s)):
                    columns.setdefault(i + j, []).append(s[i])
    out, w = [], 0
    while columns:
        col = columns.pop(w, [])
        x = np.stack(col) if col else np.zeros((0, bitmaps.shape[-1]), np.uint64)
        carries = []
        while len(x) > 2:
            n = len(x) // 3 * 3
            a, b, c = x[0:n:3], x[1:n:3], x[2:n:3]
            t = a ^ b
            carries.append((a & b) | (t & c))
            x = np.concatenate([t ^ c, x[n:]])
        if len(x) == 2:
            carries.append((x[0] & x[1])[None])
            x = (x[0] ^ x[1])[None]
        out.append(x[0] if len(x) else np.zeros(bitmaps.shape[-1], np.uint64))
        if carries:
            columns.setdefault(w + 1, []).extend(np.concatenate(carries))
        w += 1
    return out


def _count(b: np.ndarray) -> int:
    return int(np.bitwise_count(b).sum())


def top_rows(slices: list, rows: int, k: int) -> np.ndarray:
    """Row numbers of the k largest scores, all rows of the boundary score included."""
    words = -(-rows // 64)
    some = np.zeros(words * 64, np.uint8)
    some[:rows] = 1
    equal = np.packbits(some, bitorder="little").view(np.uint64)
    sure = np.zeros(words, np.uint64)
    need = k
    for s in reversed(slices):
        high = equal & s
        n = _count(high)
        if n >= need:
            equal = high
        else:
            sure |= high
            need -= n
            equal = equal & ~s
    both = np.unpackbits((sure | equal).view(np.uint8), bitorder="little")
    return np.flatnonzero(both[:rows])


def _scores(x: np.ndarray, query: np.ndarray):
    """Inner products without overflow: 64-bit numbers where they suffice, else Python's."""
    top = [max((abs(int(v)) for v in (a.min(), a.max())), default=0) for a in (x, query)] if x.size else [0, 0]
    if top[0] * top[1] * len(query) < 1 << 63:
        return x @ query
    return x.astype(object) @ query.astype(object)


def _quantised(vectors: DataFrame, scale: int) -> DataFrame:
    v = (vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
         .where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
         .where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))))
    return v.select("vec_id", F.transform("v", lambda x: F.floor(x * scale)).alias("q"), F.size("v").alias("dims"))


def _blocked(rows: DataFrame, size: int, tag: str) -> DataFrame:
    """Rows dealt evenly into blocks of about ``size``: (dims, block) with packed ids and values."""
    counts = {r["dims"]: r["count"] for r in rows.groupBy("dims").count().collect()}  # a row per length
    block = F.lit(0)
    for dims, n in counts.items():
        block = F.when(F.col("dims") == dims, F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(-(-n // size)))).otherwise(block)

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [pdf.iloc[i:i + 2 * size] for i in range(0, len(pdf), 2 * size)]  # repeated ids share a block
        return pd.DataFrame([(int(p["dims"].iloc[0]), int(p["block"].iloc[0]), p["vec_id"].to_numpy(np.int64).tobytes(),
                              np.stack(p["q"]).astype(np.int64).tobytes()) for p in parts],
                            columns=["dims", "block", "ids", "q"])

    dealt = rows.withColumn("block", block.cast("long"))
    return stage(dealt.groupBy("dims", "block").applyInPandas(packed, "dims int, block bigint, ids binary, q binary"), tag)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256,
          block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best rows of ``vectors``, its own id left out.

    Both tables: vec_id (integer), embedding (array of numbers).
    """
    index = _blocked(_quantised(vectors, scale), block_rows, "topk-index")
    asked = _blocked(_quantised(queries, scale).dropDuplicates(["vec_id"]), query_rows, "topk-queries")
    blocks = index.select("dims", "block").distinct().groupBy("dims").agg(F.collect_list("block").alias("blocks"))
    spread = (asked.select("dims", F.col("ids").alias("query_ids"), F.col("q").alias("queries"))
              .join(blocks, "dims").withColumn("block", F.explode("blocks")).drop("blocks"))
    pairs = index.join(spread, ["dims", "block"]).repartition("block", F.xxhash64("query_ids"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                x = np.frombuffer(row["q"], np.int64).reshape(len(ids), row["dims"])
                order = np.argsort(ids, kind="stable")
                ids, x = ids[order], x[order]
                bitmaps, _, _ = slices_of(x)
                out = [[], [], [], []]
                own = np.frombuffer(row["query_ids"], np.int64)
                for qid, q in zip(own, np.frombuffer(row["queries"], np.int64).reshape(len(own), row["dims"])):
                    same = int(np.searchsorted(ids, qid, "right") - np.searchsorted(ids, qid))
                    best = top_rows(score_slices(bitmaps, q), len(ids), k + same)
                    best = best[ids[best] != qid]
                    score = _scores(x[best], q)
                    keep = sorted(range(len(best)), key=lambda i: (-int(score[i]), ids[best[i]]))[:k]
                    out[0] += [int(qid)] * len(keep)
                    out[1] += ids[best[keep]].tolist()
                    out[2] += [Decimal(int(score[i]) >> 62) for i in keep]
                    out[3] += [int(score[i]) & LOW for i in keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.decimal128(38, 0) if n == "high" else pa.int64()) for n, c in zip(names, out)], names=names)

    names = ["query_id", "vec_id", "high", "low"]
    found = stage(pairs.mapInArrow(run, "query_id bigint, vec_id bigint, high decimal(38,0), low bigint"), "topk-found",
                  arrow_rows=4)
    unstage(index, asked)
    best = Window.partitionBy("query_id").orderBy(F.desc("high"), F.desc("low"), "vec_id")
    fits = F.col("high").between(-2, 1)
    score = (F.when(fits, F.when(fits, F.col("high")).cast("long") * F.lit(LOW + 1) + F.col("low"))
             .when(F.col("high") > 0, F.lit((1 << 63) - 1)).otherwise(F.lit(-(1 << 63))))
    found = found.withColumn("score", score.cast("long"))
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
