"""Candidate pairs out of buckets, and connected components, in DataFrame operations.

A bucket is a set of nodes that share a band.  Pairs come in rounds, so that a
bucket of near copies never yields all its pairs:

1. ``star_pairs``: every member with the smallest members of some of its buckets.  The
   caller verifies them and labels the components.
2. ``cross_pairs``: in each bucket, members outside the bucket's largest component
   with the members that carry another label.  Pairs inside a component add
   nothing, so after this round every pair of a bucket is either verified or
   already in one component: no link is lost, and a group that round 1 joined
   yields no second pair.

Where members of a large bucket are linked to each other but not to its leader, ``neighbour_pairs`` between
the two joins most of them at a cost in proportion to the bucket's size; it only saves pairs in the last round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage, unstage


def multi_buckets(buckets: DataFrame) -> DataFrame:
    """(key, node) -> (key, node, leader) for the buckets that hold two nodes or more."""
    heads = (buckets.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("_last"))
             .where("leader < _last").select("key", "leader"))
    return buckets.join(heads, "key").select("key", "node", "leader")


def star_pairs(multi: DataFrame, leaders: int = 1) -> DataFrame:
    """(a, b), a > b: each member with some leaders of its buckets, the ``leaders`` that it shares most
    buckets with and the smallest one; so a node has at most ``leaders`` + 1 pairs.  More leaders
    cost verifications here and save pairs in ``cross_pairs``."""
    per = multi.where("node > leader").groupBy("node", "leader").agg(F.count(F.lit(1)).alias("n"))
    # a node has no more leaders than bands
    of = per.groupBy("node").agg(F.collect_list(F.struct("n", "leader")).alias("l"), F.min("leader").alias("least"))
    best = F.slice(F.sort_array("l", asc=False), 1, leaders).getField("leader")
    return of.select(F.col("node").alias("a"), F.explode(F.array_union(best, F.array("least"))).alias("b"))


def xor_bits(x: str, y: str, words: range) -> Column:
    """Population count of the XOR of two bitmaps held in columns ``{x}0``.. and ``{y}0``.."""
    total = F.lit(0)
    for i in words:
        total = total + F.bit_count(F.col(f"{x}{i}").bitwiseXOR(F.col(f"{y}{i}")))
    return total


def _mixed(multi: DataFrame, labels: DataFrame, sketches: DataFrame) -> DataFrame:
    """The members of buckets of several components, with comp, the bucket's largest component (main) and their sketch."""
    lab = multi.join(labels, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    per = lab.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    main = (per.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("m"), F.count(F.lit(1)).alias("c"))
            .where("c > 1").select("key", F.col("m.comp").alias("main")))
    return lab.join(main, "key").join(sketches, "node")


def neighbour_pairs(multi: DataFrame, labels: DataFrame, sketches: DataFrame, words: int, near: Column, reach: int = 3) -> DataFrame:
    """Distinct (a, b), a > b: each member of a bucket with the next ``reach`` ones in the order of their sketches, where
    they are of different components and ``near``.  Sketches that begin alike lie side by side."""
    w = Window.partitionBy("key").orderBy(*[f"s{i}" for i in range(words)], "node")
    own = F.struct("node", "comp", "n", *[f"s{i}" for i in range(words)])
    pairs = _mixed(multi, labels, sketches).select(own.alias("x"), *[F.lead(own, k).over(w).alias(f"y{k}") for k in range(1, reach + 1)])
    pairs = pairs.select("x", F.explode(F.array(*[f"y{k}" for k in range(1, reach + 1)])).alias("y")).where("x.comp <> y.comp")
    pairs = pairs.select(F.col("x.node").alias("x"), F.col("y.node").alias("y"),
                         *[F.col(f"{c}.n").alias(f"n{c}") for c in "xy"],
                         *[F.col(f"{c}.s{i}").alias(f"{c}s{i}") for c in "xy" for i in range(words)])
    return pairs.where(near).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def near_members(multi: DataFrame, labels: DataFrame, sketches: DataFrame, words: int, near: Column) -> DataFrame:
    """(key, node) of the members that are ``near`` a member of their bucket of another component: those that
    ``cross_pairs`` may pair, found without making the pairs."""
    mixed = _mixed(multi, labels, sketches)

    def side(c):
        return mixed.select(F.col("key").alias(f"{c}k"), F.col("node").alias(c), F.col("comp").alias(f"{c}c"), F.col("n").alias(f"n{c}"),
                            *[F.col(f"s{i}").alias(f"{c}s{i}") for i in range(words)])

    return side("x").join(side("y"), F.expr("xk = yk AND xc <> yc") & near, "left_semi").select(F.col("xk").alias("key"), F.col("x").alias("node"))


def cross_pairs(multi: DataFrame, labels: DataFrame, sketches: DataFrame, words: int, near: Column) -> DataFrame:
    """Distinct (a, b), a > b, that share a bucket and are of different components.

    ``labels`` (node, comp) holds linked nodes; any other node is a component of its own.
    ``sketches`` (node, n, s0..) has set sizes and bitmaps of ``words`` longs; the join itself
    drops pairs that are not ``near`` (a condition on nx, xs0.. and ny, ys0..), so members of a
    bucket that are not similar yield no rows.
    """
    mixed = _mixed(multi, labels, sketches)

    def side(c):
        return mixed.select(F.col("key").alias(f"{c}k"), F.col("node").alias(c), F.col("comp").alias(f"{c}c"),
                            (F.col("comp") != F.col("main")).alias(f"{c}o"), F.col("n").alias(f"n{c}"),
                            *[F.col(f"s{i}").alias(f"{c}s{i}") for i in range(words)])

    both = side("x").where("xo").join(side("y"), F.expr("xk = yk AND xc <> yc AND (NOT yo OR x < y)")
                                      & near)
    return both.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def verified_pairs(pairs: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """The pairs whose full sets (node, s: array of distinct longs) have a Jaccard similarity
    of at least ``percent`` hundredths, staged as (a, b)."""
    both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
            .where(100 * F.least(F.size("sa"), F.size("sb")) >= percent * F.greatest(F.size("sa"), F.size("sb"))))
    inter = F.size(F.array_intersect("sa", "sb"))
    good = both.where(100 * inter >= percent * (F.size("sa") + F.size("sb") - inter))
    return stage(good.select("a", "b"), name)


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(a, b) -> (node, comp): comp is the smallest node reachable; nodes without an edge are absent.

    Alternating star contraction: every node hands its larger neighbours, then its
    smaller ones, to the smallest it knows.  Each round is an aggregate (combined
    before the shuffle) and a join that may be split for a hot node; the edge list
    never grows.  It ends when a round changes nothing.  Empty input: no rows.
    """
    cur = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                .distinct(), f"{name}-edges")
    before = _mark(cur)
    while before[0]:
        # large star: larger neighbours of u move to the smallest of u's neighbourhood
        both = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).union(cur.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = (both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
               .where("a <> b").distinct())
        # small star: u and its smaller neighbours move to the smallest of them
        low2 = big.groupBy("a").agg(F.min("b").alias("m"))
        nxt = big.join(low2, "a")
        nxt = (nxt.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"),
                          F.col("m").alias("b")).where("a <> b").distinct())
        nxt = stage(nxt, f"{name}-round")
        unstage(cur)
        cur, mark = nxt, _mark(nxt)
        if mark == before:
            break
        before = mark
    roots = cur.select(F.col("b").alias("node")).distinct()
    return cur.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(
        roots.select("node", F.col("node").alias("comp")))


def _mark(df: DataFrame) -> tuple:
    """Count and order-free checksum of an edge list; two scalars reach the driver."""
    r = df.agg(F.count(F.lit(1)).alias("n"),
               F.sum((F.xxhash64("a", "b") % F.lit(1_000_000_007)).cast("decimal(20,0)")).alias("h")).first()
    return (r["n"], r["h"])
