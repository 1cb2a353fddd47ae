import hashlib
import itertools
import random
import zlib

from pyspark.sql import functions as F

from outline_ledger.llm import queries as Q
from outline_ledger.llm import turn_repair as T

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if role is None else role), (" " if text is None else text)
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
        role = "user" if fault == 4 else role
        out += [(turn, role, text)] * (2 if fault == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def by_hand(rows):
    """The contract's row of one conversation, by a plain table over (turns, last role)."""
    live, seen, kinds = damage(rows), set(), []
    for _, role, text in live:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        kinds.append("blank" if not bare else "duplicate" if (role, text) in seen else
                     "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {"": (0, "", ())}

    def better(to, q, cost, audit, out):
        if q not in to or (cost, audit) < to[q][:2]:
            to[q] = (cost, audit, out)

    def inserted(states):
        for _ in range(3):
            for q, (c, a, out) in list(states.items()):
                better(states, NEXT[q], c + 5, a + "I", out + (("user" if NEXT[q] == "u" else "assistant") + ":",))
        return states
    for (_, role, text), kind in zip(live, kinds):
        to = {}
        for q, (c, a, out) in inserted(best).items():
            better(to, q, c + 2, a + "D", out)
            if kind in ("blank", "duplicate"):
                continue
            more = 5 * (kind == "truncated")
            if role[:1] == NEXT[q] or (q == "" and role[:1] == "s"):
                better(to, role[:1], c + more, a + "K", out + (f"{role}:{text}",))
            better(to, NEXT[q], c + 1 + more, a + "R", out + (("user" if NEXT[q] == "u" else "assistant") + ":" + text,))
        best = to
    cost, audit, out = min(v for q, v in inserted(best).items() if q in ("", "a"))
    turns = [t for t, _, _ in live if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(live, live[1:]))
    sha = hashlib.sha256("\n".join(out).encode()).hexdigest()
    return (gaps, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha), out


def check(spark, rows, block_rows=T.BLOCK_ROWS, kind="conv_id bigint, turn bigint, role string, text string"):
    df = spark.createDataFrame(rows, kind)
    report, turns = T.repair_conversations(T.damaged(df), block_rows)
    got = {r[0]: tuple(r[1:]) for r in report.collect()}
    told = {c: by_hand([r for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert got == {c: v[0] for c, v in told.items()}
    lines = {}
    for r in sorted(turns.collect(), key=lambda r: (r.block, r.place)):
        lines.setdefault(None if r.ck == "" else int(r.ck[1:]), []).append(f"{r.role}:{r.text}")
    assert lines == {c: list(v[1]) for c, v in told.items() if v[1]}


def random_rows(seed, conversations, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(conversations):
        for t in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = rng.choice(["Fine.", "Yes!", "why?", "cut off", "", " \t", None, f"Word {rng.randrange(5)}.", f"x {t}. \n"])
            rows.append((c if c else None, rng.choice([t, t, t, t + 3, None]), role, text))
    return rows


def test_equals_brute_force(spark):
    check(spark, random_rows(1, 120, 12))


def test_conversations_over_many_blocks(spark):
    check(spark, random_rows(2, 6, 90), block_rows=4)
    check(spark, random_rows(3, 25, 9), block_rows=2)


def test_hot_conversation_repeated_rows(spark):
    rows = [(7, 3, "user", "Same. words.")] * 300 + [(7, t, "assistant", "cut") for t in range(300)] + random_rows(4, 9, 9)
    check(spark, rows, block_rows=16)


def test_lattice_against_all_edit_sequences():
    rng = random.Random(5)
    for _ in range(300):
        turns = [rng.choice([1, ("u", 0), ("a", 0), ("s", 0), ("u", 1), ("a", 1), ("t", 0)]) for _ in range(rng.randrange(5))]
        best = None
        for audit in itertools.chain.from_iterable(itertools.product("DIKR", repeat=n) for n in range(len(turns) + 3)):
            i, q, cost = 0, 0, 0
            for e in audit:
                steps = {x[0][:1]: x for x in T._steps(turns, i, q)} if i < len(turns) else {"I": ("I", 5, i, T._NEXT[q])}
                if e not in steps:
                    break
                _, w, i, q = steps[e]
                cost += w
            else:
                if i == len(turns) and q in (0, 3):
                    best = min(best or (cost, audit), (cost, audit))
        items = []
        for t in turns:
            if t == 1 and items and isinstance(items[-1], int):
                items[-1] += 1
            else:
                items.append(t)
        cost, audit, q = T.least_edits(items, 0, T._CLOSE_COST)
        assert (cost, audit + T.CLOSING[q]) == (best[0], "".join(best[1]))


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame(random_rows(6, 5, 5), "conv_id bigint, turn bigint, role string, text string")
    more = df.withColumns({c: F.lit(1) for c in ("ck", "rid", "block", "copies", "kind", "src", "audit", "cost")})
    assert T.repair_conversations(T.damaged(df.where("false")))[0].count() == 0
    assert (sorted(T.repair_conversations(T.damaged(more))[0].collect(), key=str)
            == sorted(T.repair_conversations(T.damaged(df))[0].collect(), key=str))


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r[1:]) for r in Q.QUERIES["op11_turn_repair"](spark, sf).collect()}
    assert got == {c: by_hand([r for r in rows if r[0] == c])[0] for c in {r[0] for r in rows}}
