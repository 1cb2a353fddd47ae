"""Chat formatting with typed content parts.

A message's content is a list of parts: text, image, audio, document.  A visitor walks the
parts of all messages of a conversation in order.  Text is written escaped; every other
part becomes a numbered placeholder, and its reference and the number of tokens that it
expands to are recorded.  A conversation is

    <|im_start|>role\\ntext<|im_end|>\\n   for each message.

Escaping is reversible: in texts, each ``<``, backslashes, ``|`` gets one more backslash, so
``<|`` in a formatted conversation is always the template's.  In roles a backslash is
doubled and a line end written as ``\\n``.  The loss mask is a list of character spans: the texts of
the assistant's messages, without markers and placeholders.

Defined cases: null text or part list: empty; null role: the empty role; messages are in
order of turn (null first), then role and text, so rows that repeat are both kept; rows of
null conv_id are one conversation; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 512

PART = ("struct<type:string,text:string,ref:string,width:bigint,height:bigint,seconds:double,pages:bigint>")

_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_MESSAGE = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
_PLACE = re.compile(r"<\|(image|audio|document) (\d+)\|>")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def _role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _unrole(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class PartVisitor:
    """Collects the formatted text, the loss spans and the attachments of a conversation."""

    def __init__(self):
        self.out, self.size, self.spans, self.attachments = [], 0, [], []

    def put(self, s: str) -> None:
        self.out.append(s)
        self.size += len(s)

    def message(self, role: str | None, parts: list | None) -> None:
        role = role or ""
        self.put(f"{START}{_role(role)}\n")
        for part in parts or []:
            if part:
                getattr(self, f"visit_{part['type'] or 'text'}", self.unknown)(part, role == "assistant")
        self.put(f"{END}\n")

    def visit_text(self, part: dict, loss: bool) -> None:
        text = escape(part["text"] or "")
        if loss and text:
            self.spans.append((self.size, self.size + len(text)))
        self.put(text)

    def visit_image(self, part: dict, loss: bool) -> None:
        self.attach(part, math.ceil((part["width"] or 0) / PATCH) * math.ceil((part["height"] or 0) / PATCH))

    def visit_audio(self, part: dict, loss: bool) -> None:
        self.attach(part, math.ceil((part["seconds"] or 0) * AUDIO_RATE))

    def visit_document(self, part: dict, loss: bool) -> None:
        self.attach(part, (part["pages"] or 0) * PAGE_TOKENS)

    def unknown(self, part: dict, loss: bool) -> None:
        raise ValueError(f"no such part type: {part['type']}")

    def attach(self, part: dict, tokens: int) -> None:
        number = len(self.attachments)
        self.attachments.append({"number": number, "type": part["type"], "ref": part["ref"], "at": self.size,
                                 "tokens": tokens})
        self.put(f"<|{part['type']} {number}|>")


def parse_conversation(formatted: str) -> list[tuple[str, list]]:
    """Messages as (role, parts): strings, and (type, number) for placeholders."""
    found, at = [], 0
    for m in _MESSAGE.finditer(formatted):
        if m.start() != at:
            raise ValueError("text outside messages")
        at, parts, p = m.end(), [], 0
        for x in _PLACE.finditer(m[2]):
            parts += [unescape(m[2][p:x.start()])] * (x.start() > p) + [(x[1], int(x[2]))]
            p = x.end()
        found.append((_unrole(m[1]), parts + [unescape(m[2][p:])] * (len(m[2]) > p)))
    if at != len(formatted):
        raise ValueError("text outside messages")
    return found


def text_messages(rows: DataFrame) -> DataFrame:
    """Plain rows (conv_id, turn, role, text) as messages with one text part."""
    return rows.select("conv_id", "turn", "role", F.array(F.struct(
        F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"),
        F.lit(None).cast("bigint").alias("width"), F.lit(None).cast("bigint").alias("height"),
        F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("bigint").alias("pages"))).cast(
            f"array<{PART}>").alias("parts"))


def format_conversations(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans, attachments from messages (conv_id, turn, role, parts)."""
    whole = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(
        F.struct("turn", "role", F.col("parts").cast(f"array<{PART}>").alias("parts")))).alias("messages"))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    attachment = pa.struct([("number", pa.int64()), ("type", pa.string()), ("ref", pa.string()), ("at", pa.int64()),
                            ("tokens", pa.int64())])

    def run(batches):
        for batch in batches:
            done = []
            for conversation in batch.column(1).to_pylist():
                v = PartVisitor()
                for m in conversation:
                    v.message(m["role"], m["parts"])
                done.append(("".join(v.out), [{"start": a, "end": b} for a, b in v.spans], v.attachments))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([d[0] for d in done], pa.string()),
                 pa.array([d[1] for d in done], pa.list_(span)), pa.array([d[2] for d in done], pa.list_(attachment))],
                names=["conv_id", "formatted", "loss_spans", "attachments"])

    id_type = messages.schema["conv_id"].dataType.simpleString()
    return whole.mapInArrow(run, f"conv_id {id_type}, formatted string, loss_spans array<struct<start:bigint,end:bigint>>, "
                                 "attachments array<struct<number:bigint,type:string,ref:string,at:bigint,tokens:bigint>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what a formatted conversation says: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars, attachment_tokens."""
    def run(batches):
        for batch in batches:
            rows = []
            for text, spans, attached in zip(*[batch.column(c).to_pylist() for c in ("formatted", "loss_spans", "attachments")]):
                turns = parse_conversation(text)
                plain = "".join(f"{role}\n{''.join(p for p in parts if isinstance(p, str))}\n" for role, parts in turns)
                loss = "".join(unescape(text[s["start"]:s["end"]]) for s in spans)
                rows.append((len(turns), hashlib.sha256(plain.encode()).hexdigest(), len(loss),
                             hashlib.sha256(loss.encode()).hexdigest(), len(text), sum(a["tokens"] for a in attached)))
            cols = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.string() if i in (1, 3) else pa.int64()) for i, c in enumerate(cols)]],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars",
                       "attachment_tokens"])

    id_type = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(run, f"conv_id {id_type}, n_turns bigint, turns_sha256 string, loss_chars bigint, "
                                     "loss_sha256 string, formatted_chars bigint, attachment_tokens bigint")
