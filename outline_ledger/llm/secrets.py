"""Secret scans: fixed patterns, and password guess cost by dynamic programming.

Base kinds are plain patterns: ``assign`` (a key word, ``:`` or ``=``, a value of 8 characters or more),
``access`` (AKIA...), ``hex`` (runs of 32 or more).  The method adds ``guess``: the value in a credential
context (``pwd is ...``, ``login -> ...``, ``Bearer ...``) whose cheapest segmentation is expensive to
guess.  A value is cut into dictionary words (by rank, with capitals and letter look-alikes),
dates, repeats of a unit, keyboard walks or alphabet runs, and brute-force spans; a table over
the positions keeps the least log10 of guesses, each segment paying for its place too.  Values of
``least_log10`` or more are secrets; ``winter2024`` or ``qwerty123`` are not.  A repeat takes the whole run of its unit.

One pass over the rows, no shuffle; a task holds one Arrow batch and the word list (at most the
50,256 entries of the vocabulary file, whose path is a parameter).  Whole texts are scanned; the
table is linear in a value's length, with segments of bounded length other than walks and spans.

Defined cases: null text is empty; an empty text or one without a hit has no spans; null doc_ids and
repeated rows give a row each; positions are code points, ends are exclusive; a value inside a base
span is not reported again; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import math
import re

import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import arrow_batches

KINDS = ("assign", "access", "hex", "guess")
LEAST_LOG10 = 8.0
LEAST_VALUE = 6

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CONTEXT = re.compile(
    r"""(?<![a-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|secret)[_ -]?key|credentials?|login|bearer)"""
    r"""["']?(?:[ \t]*(?::=|=>|->|[:=])[ \t]*|[ \t]+(?:is|was)[ \t]+|[ \t]+(?=\S*[0-9]))["'`]?([^\s"'`<>,;()\[\]{}]+)""", re.A | re.I)

# costs, in log10 of guesses
PLACE = math.log10(2)
_CLASSES = ((str.isdigit, 1.0), (str.islower, math.log10(26)), (str.isupper, math.log10(26)))
_OTHER, _WIDE = math.log10(33), 3.0
WALK_START, WALK_ON, WALK_TURN = math.log10(47), math.log10(1.3), math.log10(4.6)
YEAR, DAY = math.log10(120), math.log10(365)
LONGEST_WORD, LONGEST_UNIT = 24, 8
_DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])"
                   r"|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:(?:19|20)\d\d|\d\d)", re.A)
_YEAR = re.compile(r"(?:19|20)\d\d", re.A)
_LOOKALIKE = str.maketrans("4@310$57", "aaeiosst")
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_SHIFTED = str.maketrans('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./")
_AT = {c: (x, y) for y, row in enumerate(_ROWS) for x, c in enumerate(row)}


@functools.lru_cache(2)
def word_ranks(path: str) -> dict[str, int]:
    """Words that the vocabulary file holds with a space before them, by their order in it."""
    ranks: dict[str, int] = {}
    with open(path, "rb") as f:
        for line in f:
            token = base64.b64decode(line.split()[0]).decode("utf-8", "ignore")
            word = token[1:].lower()
            if token[:1] == " " and 3 <= len(word) <= LONGEST_WORD and word.isalpha():
                ranks.setdefault(word, len(ranks) + 1)
    return ranks


def _step(a: str, b: str) -> tuple | None:
    """The direction from one character to the next on the keyboard or in the alphabet."""
    if abs(ord(a) - ord(b)) == 1 and ((a.isdigit() and b.isdigit()) or (a.isalpha() and b.isalpha())):
        return ("run", ord(b) - ord(a))
    p, q = _AT.get(a), _AT.get(b)
    if p and q:
        d = (q[0] - p[0], q[1] - p[1])
        if d in ((1, 0), (-1, 0), (0, 1), (0, -1), (-1, 1), (1, -1)):
            return d
    return None


def _words_from(value: str, low: str, i: int, ranks: dict):
    for j in range(i + 3, min(len(value), i + LONGEST_WORD) + 1):
        part = low[i:j]
        rank, more = ranks.get(part), 0.0
        if rank is None:
            plain = part.translate(_LOOKALIKE)
            if plain == part:
                continue
            rank, more = ranks.get(plain), PLACE
            if rank is None:
                continue
        shown = value[i:j]
        if shown != part:
            capitals = sum(c.isupper() for c in shown)
            more += PLACE if shown[0].isupper() and capitals == 1 or shown.isupper() else math.log10(max(2, math.comb(len(shown), capitals)))
        yield j, math.log10(rank) + more


def guess_log10(value: str, ranks: dict, units: bool = True) -> float:
    """Least log10 of guesses over all segmentations of ``value``; 0 for the empty one."""
    n, low = len(value), value.lower().translate(_SHIFTED)
    if len(low) != n:
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value).translate(_SHIFTED)
    far = float("inf")
    best, force = [0.0] + [far] * n, far
    walks: dict = {}
    for i in range(n):
        here = best[i] + PLACE
        c = value[i]
        one = next((w for is_in, w in _CLASSES if c.isascii() and is_in(c)), _OTHER if c.isascii() else _WIDE)
        # brute force goes on, or starts here
        force = min(force, here) + one
        best[i + 1] = min(best[i + 1], force)
        # walks that reach this character, by their last direction
        d = _step(low[i - 1], low[i]) if i else None
        going = {None: here + WALK_START}
        if d:
            going[d] = min(w + (WALK_ON if e in (d, None) else WALK_TURN) for e, w in walks.items())
        walks = going
        best[i + 1] = min(best[i + 1], *walks.values())
        for j, cost in _words_from(value, low, i, ranks):
            best[j] = min(best[j], here + cost)
        m = _DATE.match(value, i)
        if m:
            best[m.end()] = min(best[m.end()], here + YEAR + DAY + (PLACE if m[1] or m[2] else 0))
        if _YEAR.match(value, i):
            best[i + 4] = min(best[i + 4], here + YEAR)
        for p in range(1, min(LONGEST_UNIT, (n - i) // 2) + 1 if units else 0):
            # a repeat is a whole run: it starts where its period does and takes as many units as there are
            if value[i] != value[i + p] or (i and value[i - 1] == value[i - 1 + p]):
                continue
            j = i + p
            while j < n and value[j] == value[j - p]:
                j += 1
            k = (j - i) // p
            if k > 1 and k * p > 2:
                end = i + k * p
                best[end] = min(best[end], here + guess_log10(value[i:i + p], ranks, False) + math.log10(k))
    return best[n]


def _spans(text: str, ranks: dict, cost_of, least_log10: float) -> list:
    found = [(m.start(), 0, m.end(), cost_of(m[2])) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), None) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end(), None) for m in HEX.finditer(text)]
    base = sorted((lo, hi) for lo, _, hi, _ in found)
    at = 0
    reach = 0
    for m in CONTEXT.finditer(text):
        lo, value = m.start(1), m[1].rstrip(".!?:")
        while at < len(base) and base[at][0] <= lo:
            reach, at = max(reach, base[at][1]), at + 1
        if len(value) < LEAST_VALUE or lo < reach:
            continue
        cost = cost_of(value)
        if cost >= least_log10:
            found.append((lo, 3, lo + len(value), cost))
    return [{"kind": KINDS[k], "start": lo, "end": hi, "log10_guesses": c} for lo, k, hi, c in sorted(found, key=lambda x: x[:3])]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("log10_guesses", pa.float64())])


def find_secrets(docs: DataFrame, least_log10: float = LEAST_LOG10, words: str | None = None) -> DataFrame:
    """(doc_id, text) -> (doc_id, found: array of (kind, start, end, log10_guesses) by start, then kind).

    ``words``: the vocabulary file of the word ranks, in base64 lines of tokens by rank.
    """
    path = words or public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = docs.select("doc_id", "text")

    def run(batches):
        ranks = word_ranks(path)
        cost_of = functools.lru_cache(4096)(lambda value: guess_log10(value, ranks))
        for batch in batches:
            found = [_spans(t.as_py() or "", ranks, cost_of, least_log10) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(_SPAN))], ["doc_id", "found"])
    with arrow_batches(docs.sparkSession, 1000):
        kind = docs.schema["doc_id"].dataType.simpleString()
        return docs.mapInArrow(run, f"doc_id {kind}, found array<struct<kind:string,start:bigint,end:bigint,log10_guesses:double>>")


def span_list(found: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
