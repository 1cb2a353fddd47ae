"""Conversation structure repair: bidirectional Dijkstra over the edit lattice.

A conversation is a sequence of turns.  Edits turn it into one whose role initials match
``(s?(ua)+)?``: Keep (cost 0), Rerole to user or assistant (1), Delete (2, the only edit of a
blank or repeated turn) and Insert an empty user or assistant turn (5); an undeleted truncated
turn adds 5.  A lattice node is (turns consumed, state of the pattern); from a node each edit
leads to at most one other, so an audit (the edits' initials) names one path.  A forward and a
reverse heap meet; both go on until no crossing of equal cost is left, the nodes on cheapest paths
are marked from all crossings, and a walk over them that takes the least initial gives the
least concatenated audit.  (No cheapest audit between two nodes is a proper prefix of another:
the rest would be a cycle of inserts, which costs.)

Scale.  Rows are range-partitioned by (conversation, turn, ...) and numbered, so one conversation
may lie in many partitions and blocks of ``block_rows`` rows.  Conversations inside a block are
solved there.  A conversation over several blocks is solved in pieces: the costs between the four
states at both ends of each piece, a scan of these 4 x 4 tables (one row for each block), then each
piece again towards its known exit costs, from each possible entry.  Runs of deletions are one
lattice edge ("DI" is less than "ID", so no insert stands inside a run).  Texts are not gathered: the
repaired turns are streamed, by block for the rows, by conversation for the digest, which is a
serial chain by definition.  Python holds one block's initials and flags, one Arrow batch of texts
and one audit; the audit of a conversation is one value of the result.

Defined cases: a null role or text is one space; a null conv_id is a conversation of its own; a
null turn comes first; equal turns are ordered by role, then text (its first 256 characters, then
a hash); equal rows count each, the later ones are duplicates; a role's initial is its
first character, so other roles than user, assistant and system can be kept where that initial
fits; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import arrow_batches, stage

WHITE = "\x20\x09\x0A\x0B\x0C\x0D"
BLOCK_ROWS = 4096

# states of the pattern: nothing yet, after system, after user, after assistant
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
_KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
# the state after a turn whose role may be chosen
_NEXT = (USER, USER, ASSISTANT, USER)
_LEGAL = {"su", "ua", "au"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
# the end of the conversation in each state: inserts that complete the pattern
CLOSING = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}


# ---------------------------------------------------------------------- lattice
def _steps(items: list, i: int, q: int):
    """(initials, cost, turns consumed, state) of the edits at a node, initials ascending.

    An item is an int (that many turns that must go) or (role initial, is truncated).  Nothing is
    inserted behind the last item: ``CLOSING`` does that.
    """
    if i == len(items):
        return
    item = items[i]
    if isinstance(item, int):
        yield "D" * item, DELETE * item, i + 1, q
        yield "I", INSERT, i, _NEXT[q]
        return
    initial, cut = item
    more = TRUNCATED * cut
    yield "D", DELETE, i + 1, q
    yield "I", INSERT, i, _NEXT[q]
    if (q, initial) in _KEEP:
        yield "K", more, i + 1, _KEEP[q, initial]
    yield "R", REROLE + more, i + 1, _NEXT[q]


def _back(items: list, i: int, q: int):
    """(cost, turns consumed, state) of the nodes from which an edit leads to this one."""
    if i < len(items):
        for p in STATES:
            if _NEXT[p] == q:
                yield INSERT, i, p
    if i:
        for p in STATES:
            for _, cost, j, r in _steps(items, i - 1, p):
                if j == i and r == q:
                    yield cost, i - 1, p


def least_edits(items: list, entry: int, exits: dict) -> tuple[int, str, int] | None:
    """(cost, audit, exit state) of the cheapest path from (0, entry) to a state of ``exits``
    (state -> further cost) behind the last item, the least audit among equals; None if there is none."""
    far, last = float("inf"), len(items)
    ahead, behind = {(0, entry): 0}, {(last, q): c for q, c in exits.items()}
    heap_f, heap_r = [(0, 0, entry)], [(c, last, q) for q, c in exits.items()]
    heapq.heapify(heap_r)
    done_f, done_r, best = set(), set(), behind.get((0, entry), far)
    while heap_f and heap_r and heap_f[0][0] + heap_r[0][0] <= best:
        if heap_f[0][0] <= heap_r[0][0]:
            c, i, q = heapq.heappop(heap_f)
            if (i, q) in done_f:
                continue
            done_f.add((i, q))
            for _, w, j, r in _steps(items, i, q):
                if c + w < ahead.get((j, r), far):
                    ahead[j, r] = c + w
                    heapq.heappush(heap_f, (c + w, j, r))
                    best = min(best, c + w + behind.get((j, r), far))
        else:
            c, i, q = heapq.heappop(heap_r)
            if (i, q) in done_r:
                continue
            done_r.add((i, q))
            for w, j, r in _back(items, i, q):
                if c + w < behind.get((j, r), far):
                    behind[j, r] = c + w
                    heapq.heappush(heap_r, (c + w, j, r))
                    best = min(best, c + w + ahead.get((j, r), far))
    if best == far:
        return None
    # cost from the entry of every node on a cheapest path, spread from all crossings to both sides
    crossings = [v for v, c in ahead.items() if c + behind.get(v, far) == best]
    on = {v: ahead[v] for v in crossings}
    todo = list(crossings)
    while todo:
        v = todo.pop()
        for w, j, r in _back(items, *v):
            if (j, r) not in on and (j, r) in done_f and ahead[j, r] + w == on[v] == ahead.get(v):
                on[j, r] = ahead[j, r]
                todo.append((j, r))
    todo = list(crossings)
    while todo:
        v = todo.pop()
        for _, w, j, r in _steps(items, *v):
            if (j, r) in done_r and behind[j, r] + w + on[v] == best and (j, r) not in on:
                on[j, r] = on[v] + w
                todo.append((j, r))
    audit, i, q = [], 0, entry
    while i < last:
        for initials, w, j, r in _steps(items, i, q):
            if on.get((j, r)) == on[i, q] + w:
                audit.append(initials)
                i, q = j, r
                break
    return int(best), "".join(audit), q


def _items(initials: list, kinds: list, copies: list) -> tuple[list, list, list]:
    """Lattice items, the initials of all turns and the numbers of blank, repeated and truncated turns."""
    items, seen, counts = [], [], [0, 0, 0]

    def gone(n):
        if items and isinstance(items[-1], int):
            items[-1] += n
        else:
            items.append(n)
    for initial, kind, n in zip(initials, kinds, copies):
        if not n:
            continue
        seen += [initial] * n
        if kind in (1, 2):
            counts[kind - 1] += n
            gone(n)
            continue
        counts[2] += kind == 3
        items.append((initial, kind == 3))
        if n > 1:
            counts[1] += n - 1
            gone(n - 1)
    return items, seen, counts


_CLOSE_COST = {q: INSERT * len(c) for q, c in CLOSING.items()}
_FRAGMENT = ("block long, ck string, whole boolean, blank long, duplicate long, truncated long, illegal long, "
             "first string, last string, cost long, audit string, costs array<long>")


def _solve_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """The conversations and pieces of conversations in one block of rows."""
    pdf = pdf.sort_values("rid")
    out, block = [], int(pdf["block"].iloc[0])
    keys = pdf["ck"].tolist()
    cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
    initial, kind, copies = pdf["initial"].tolist(), pdf["kind"].tolist(), pdf["copies"].tolist()
    for lo, hi in zip(cuts, cuts[1:]):
        items, seen, counts = _items(initial[lo:hi], kind[lo:hi], copies[lo:hi])
        illegal = sum(a + b not in _LEGAL for a, b in zip(seen, seen[1:]))
        ends = (seen[0], seen[-1]) if seen else (None, None)
        if lo and hi < len(keys):
            cost, audit, q = least_edits(items, START, _CLOSE_COST)
            row = (True, *counts, illegal, *ends, cost, audit + CLOSING[q], None)
        else:
            table = [least_edits(items, p, {q: 0}) for p in STATES for q in STATES]
            row = (False, *counts, illegal, *ends, None, None, [t[0] if t else -1 for t in table])
        out.append((block, keys[lo], *row))
    return pd.DataFrame(out, columns=[c.split()[0] for c in _FRAGMENT.split(", ")])


def _exit_costs(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each piece of one conversation, the cost from each of its exit states to the end."""
    pdf = pdf.sort_values("block")
    after, out = [_CLOSE_COST[q] for q in STATES], []
    for block, costs in zip(pdf["block"][::-1], pdf["costs"][::-1]):
        out.append((block, pdf["ck"].iloc[0], after))
        after = [min((costs[4 * p + q] + after[q] for q in STATES if costs[4 * p + q] >= 0 and after[q] >= 0),
                     default=-1) for p in STATES]
    return pd.DataFrame(out, columns=["block", "ck", "after"])


def _solve_piece(pdf: pd.DataFrame) -> pd.DataFrame:
    """Audit and exit of one piece for each state that it may be entered in."""
    pdf = pdf.sort_values("rid")
    items, _, _ = _items(pdf["initial"].tolist(), pdf["kind"].tolist(), pdf["copies"].tolist())
    exits = {q: int(c) for q, c in enumerate(pdf["after"].iloc[0]) if c >= 0}
    found = [least_edits(items, p, exits) for p in STATES]
    return pd.DataFrame([(pdf["block"].iloc[0], pdf["ck"].iloc[0], [f[0] if f else -1 for f in found],
                          [f[1] if f else "" for f in found], [f[2] if f else -1 for f in found])],
                        columns=["block", "ck", "total", "audits", "exits"])


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """The pieces of one conversation in order: entry state and audit of each, and what their ends add."""
    pdf = pdf.sort_values("block")
    out, state, before = [], START, None
    for k, (_, r) in enumerate(pdf.iterrows()):
        joint = int(before is not None and r["first"] is not None and before + r["first"] not in _LEGAL)
        audit, entry, cost = r["audits"][state], state, r["total"][state] if not k else 0
        state = int(r["exits"][state])
        if k == len(pdf) - 1:
            audit += CLOSING[state]
        out.append((r["block"], r["ck"], r["blank"], r["duplicate"], r["truncated"], r["illegal"] + joint, cost, entry, audit))
        before = r["last"] if r["last"] is not None else before
    return pd.DataFrame(out, columns=["block", "ck", "blank", "duplicate", "truncated", "illegal", "cost", "entry", "audit"])


# ------------------------------------------------------------------------- rows
def ordered_turns(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(conv_id, turn, role, text, copies) -> staged turns in order: ck (the conversation's key), turn,
    role, text, copies, rid (rises with the order), block, initial and kind (0 sound, 1 blank,
    2 duplicate, 3 truncated; of a row with two copies the second one is a duplicate, or blank)."""
    spark = rows.sparkSession
    turns = rows.select(F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("ck"), "turn",
                        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "copies",
                        F.monotonically_increasing_id().alias("src"))
    # equal rows differ in src alone, so a value that fills many rows still splits into ranges
    keys = [F.col("ck"), F.col("turn").asc_nulls_first(), F.substring("role", 1, 16), F.substring("text", 1, 256),
            F.xxhash64("role", "text"), F.col("src")]
    held = turns.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("src")
    held = stage(held.withColumn("rid", F.monotonically_increasing_id()), "turns", arrow_rows=64)
    bare = F.rtrim("text", F.lit(WHITE))
    flags = held.select("ck", "rid", "copies", F.substring("role", 1, 1).alias("initial"),
                        F.floor(F.col("rid") / block_rows).alias("block"), (bare == "").alias("blank"),
                        (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("open"),
                        F.sha2(F.concat(F.col("role"), F.lit("\x00"), F.col("text")), 256).alias("said"))
    live = flags.where("copies > 0 AND NOT blank")
    # the first place of what was said: a grouped minimum, combined before the shuffle
    first = live.groupBy("ck", "said").agg(F.min("rid").alias("rid"), F.count(F.lit(1)).alias("times"))
    again = live.join(first.where("times > 1").select("ck", "said", F.col("rid").alias("at")), ["ck", "said"]).where("rid > at")
    kind = (F.when(F.col("blank"), 1).when(F.col("again"), 2).when(F.col("open"), 3).otherwise(0))
    flags = flags.join(again.select("rid", F.lit(True).alias("again")), "rid", "left")
    return held, stage(flags.select("ck", "rid", "block", "copies", "initial", kind.alias("kind")), "turn-flags")


def solve(flags: DataFrame) -> DataFrame:
    """(block, ck, blank, duplicate, truncated, illegal, cost, entry, audit): the pieces of all conversations,
    one for each block that a conversation lies in; their sums and joined audits are the conversation's."""
    parts = stage(flags.groupBy("block").applyInPandas(_solve_block, _FRAGMENT), "turn-pieces")
    whole = parts.where("whole").select("block", "ck", "blank", "duplicate", "truncated", "illegal", "cost",
                                        F.lit(START).alias("entry"), "audit")
    cut = parts.where("NOT whole")
    after = stage(cut.groupBy("ck").applyInPandas(_exit_costs, "block long, ck string, after array<long>"), "turn-exits")
    found = (flags.join(after, ["block", "ck"]).groupBy("block", "ck")
             .applyInPandas(_solve_piece, "block long, ck string, total array<long>, audits array<string>, exits array<long>"))
    pieces = found.join(cut.drop("audit", "cost", "costs", "whole"), ["block", "ck"])
    chained = pieces.groupBy("ck").applyInPandas(
        _chain, "block long, ck string, blank long, duplicate long, truncated long, illegal long, cost long, entry int, audit string")
    return stage(whole.unionByName(chained), "turn-audits")


class _Repairer:
    """Applies an audit to turns as they come: yields (edit, role, text) of what stays."""

    def __init__(self, audit: str, state: int):
        self.audit, self.at, self.state = audit, 0, state

    def _inserts(self):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self.state = _NEXT[self.state]
            yield "I", "user" if self.state == USER else "assistant", ""

    def take(self, role: str, text: str):
        yield from self._inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = _KEEP[self.state, role[:1]]
            yield edit, role, text
        elif edit == "R":
            self.state = _NEXT[self.state]
            yield edit, "user" if self.state == USER else "assistant", text

    def end(self):
        yield from self._inserts()


def _streamed(held: DataFrame, heads: DataFrame, by: str) -> DataFrame:
    """Each group's head (rid -1: entry state and audit), then its turns, in order."""
    order = list(dict.fromkeys([by, "ck", "rid"]))
    rows = held.where("copies > 0").select(*order, "role", "text", "copies", F.lit(None).cast("int").alias("entry"),
                                           F.lit(None).cast("string").alias("audit"))
    tops = heads.withColumn("rid", F.lit(-1).cast("long")).select(*order, F.lit(None).cast("string").alias("role"),
                        F.lit(None).cast("string").alias("text"), F.lit(0).alias("copies"), F.col("entry").cast("int"), "audit")
    return rows.union(tops).repartition(by).sortWithinPartitions(*order)


def repaired_turns(held: DataFrame, pieces: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The repaired turns of all conversations: (ck, block, place, edit, role, text); ``place`` counts
    from 0 within a conversation's part of a block."""
    spark = held.sparkSession
    rows = _streamed(held.withColumn("block", F.floor(F.col("rid") / block_rows)), pieces, "block")

    def run(batches):
        repair, key, place = None, None, 0

        def rows_of(out):
            return pa.RecordBatch.from_pylist(out, pa.schema([("ck", pa.string()), ("block", pa.int64()), ("place", pa.int64()),
                                                              ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            out = []

            def put(found):
                nonlocal place
                for edit, role, text in found:
                    out.append({"ck": key[1], "block": key[0], "place": place, "edit": edit, "role": role, "text": text})
                    place += 1
            for r in batch.to_pylist():
                if r["rid"] < 0:
                    if repair:
                        put(repair.end())
                    repair, key, place = _Repairer(r["audit"], r["entry"]), (r["block"], r["ck"]), 0
                else:
                    for _ in range(r["copies"]):
                        put(repair.take(r["role"], r["text"]))
            yield rows_of(out)
        if repair:
            out = []
            put(repair.end())
            yield rows_of(out)
    with arrow_batches(spark, 64):
        return rows.mapInArrow(run, "ck string, block long, place long, edit string, role string, text string")


def repaired_digests(held: DataFrame, whole: DataFrame) -> DataFrame:
    """(ck, repaired_sha256): SHA-256 of the repaired ``role:text`` lines, joined by newlines."""
    rows = _streamed(held, whole, "ck")

    def run(batches):
        repair, key, digest, empty, out = None, None, None, True, []

        def add(found):
            nonlocal empty
            for _, role, text in found:
                digest.update((("" if empty else "\n") + role + ":" + text).encode("utf-8", "surrogatepass"))
                empty = False

        def rows_of(out):
            return pa.RecordBatch.from_pylist(out, pa.schema([("ck", pa.string()), ("repaired_sha256", pa.string())]))
        for batch in batches:
            for r in batch.to_pylist():
                if r["rid"] < 0:
                    if repair:
                        add(repair.end())
                        out.append({"ck": key, "repaired_sha256": digest.hexdigest()})
                    repair, key, digest, empty = _Repairer(r["audit"], START), r["ck"], hashlib.sha256(), True
                else:
                    for _ in range(r["copies"]):
                        add(repair.take(r["role"], r["text"]))
            yield rows_of(out)
            out = []
        if repair:
            add(repair.end())
            yield rows_of([{"ck": key, "repaired_sha256": digest.hexdigest()}])
    return rows.mapInArrow(run, "ck string, repaired_sha256 string")


def repair_conversations(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(conv_id, turn, role, text, copies) -> (report, repaired turns).

    ``copies`` 0 stands for a turn that is lost: it adds nothing, but its conversation is reported.
    """
    held, flags = ordered_turns(rows, block_rows)
    pieces = solve(flags)
    counts = pieces.groupBy("ck").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
                                      F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "audit"))),
                                                               lambda x: x["audit"]), "").alias("audit"))
    whole = stage(counts.withColumn("entry", F.lit(START)), "turn-reports")
    wide = "decimal(20,0)"
    turns = held.where("copies > 0").groupBy("ck").agg(
        (F.max("turn").cast(wide) - F.min("turn").cast(wide) + 1 - F.count_distinct("turn")).alias("gaps"))
    with arrow_batches(rows.sparkSession, 64):
        digests = stage(repaired_digests(held, whole), "turn-digests", arrow_rows=64)
    conv_id = F.when(F.col("ck") != "", F.expr("substring(ck, 2)")).cast(rows.schema["conv_id"].dataType)
    report = (whole.join(digests, "ck").join(turns, "ck", "left")
              .select(conv_id.alias("conv_id"), F.coalesce(F.col("gaps").try_cast("long"), F.lit(0)).cast("long").alias("gaps"),
                      "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))
    return report, repaired_turns(held, pieces, block_rows)


def damaged(rows: DataFrame) -> DataFrame:
    """The turns after damage by the remainder of crc32(conv_id:turn) by 20: 0 drops a turn (copies 0),
    1 empties its text, 2 takes out its full stops, exclamation and question marks, 3 repeats it, 4 makes its role user."""
    def text_of(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    return rows.select("conv_id", "turn", F.when(fault == 4, F.lit("user")).otherwise(text_of("role")).alias("role"),
                       F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(text_of("text"), ".!?", ""))
                       .otherwise(text_of("text")).alias("text"),
                       F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"))
