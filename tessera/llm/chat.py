"""Chat formatting (operator 4): typed content parts, flattened by a visitor into a marked-up text.

A message's content is a list of parts (kind, text, ref and, where known, width and height, seconds or pages).  The
visitor turns text parts into escaped text and image, audio and document parts into placeholders; every attachment is
recorded in order with its kind, reference and own text (a transcript, say) and the number of tokens that its
placeholder expands to, which follows from its size, length or pages.  Other kinds count as documents and keep their
name in the record.  The template marks turns:

    <s>[ROLE]role[BODY]text</s>

A backslash before `<`, `[` or `\\` takes their meaning away; all three are escaped inside texts and roles, so no text
can open or close a turn or stand for a placeholder, and `parse_parts` gives back exactly what went in.

Conversations stream through their partition in order: rows are dealt by conv_id and sorted, and one turn is held at a
time, so a conversation of any length needs the memory of its longest turn.

Defined results: a null text, content or part is empty; a null role is an empty role; turns of one number are ordered by role
and text, null turns come first; repeated rows are turns of their own; rows with a null conv_id form one conversation
of their own; a size that isn't positive and finite (or is 2^31 or more) is unknown; an empty table gives only what was added to it; other columns are passed over.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from math import ceil
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OPEN, BODY, CLOSE = "<s>[ROLE]", "[BODY]", "</s>"
#: Tokens of an image's patch of so many pixels to a side, of a second and of a page; and of attachments that don't say.
PATCH, PER_SECOND, PER_PAGE = 28, 25, 1024
UNKNOWN = {"image": 576, "audio": 250, "document": 1024}
PART = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
_PLAIN = re.compile(r"\\(.)", re.S)
_PIECE = re.compile(r"\[([A-Z]+):(\d+)\]|((?:[^\\\[]|\\.)+)", re.S)
_TURN = re.compile(r"<s>\[ROLE\]([^\\<\[]*(?:\\.[^\\<\[]*)*)\[BODY\]([^\\<]*(?:\\.[^\\<]*)*)</s>", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\<").replace("[", "\\[")


def unescape(text: str) -> str:
    return _PLAIN.sub(r"\1", text)


def _size(part: dict, name: str) -> float | None:
    """A size that is known: positive, finite, and small enough to count tokens by."""
    x = part.get(name)
    return x if x is not None and 0 < x < 1 << 31 else None


class Attachment(NamedTuple):
    turn: int
    position: int
    kind: str
    ref: str
    text: str
    n_tokens: int


class Visitor:
    """Flattens one message's parts; attachments of the conversation are numbered on from `first`."""

    def __init__(self, turn: int, first: int = 0) -> None:
        self.turn, self.next = turn, first
        self.out: list[str] = []
        self.attachments: list[Attachment] = []

    def visit(self, part: dict | None) -> None:
        if part:
            getattr(self, f"visit_{part.get('kind') or 'text'}", self.visit_document)(part)

    def visit_text(self, part: dict) -> None:
        self.out.append(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        sides = _size(part, "width"), _size(part, "height")
        self.place("image", part, ceil(sides[0] / PATCH) * ceil(sides[1] / PATCH) if all(sides) else None)

    def visit_audio(self, part: dict) -> None:
        self.place("audio", part, ceil(seconds * PER_SECOND) if (seconds := _size(part, "seconds")) else None)

    def visit_document(self, part: dict) -> None:
        self.place("document", part, pages * PER_PAGE if (pages := _size(part, "pages")) else None)

    def place(self, kind: str, part: dict, n_tokens: int | None) -> None:
        # A bare bracket can't come from a text: those are escaped.
        self.out.append(f"[{kind.upper()}:{self.next}]")
        self.attachments.append(Attachment(self.turn, self.next, part.get("kind") or kind, part.get("ref") or "", part.get("text") or "", UNKNOWN[kind] if n_tokens is None else n_tokens))
        self.next += 1


def format_turn(role: str | None, parts: Iterable[dict] | None, turn: int = 0, first: int = 0) -> tuple[str, list[Attachment]]:
    visitor = Visitor(turn, first)
    for part in parts or ():
        visitor.visit(part)
    return f"{OPEN}{escape(role or '')}{BODY}{''.join(visitor.out)}{CLOSE}", visitor.attachments


def parse_parts(formatted: str) -> Iterator[tuple[str, list[tuple[str, str | int]]]]:
    """(role, parts) of each turn of a formatted conversation; a part is ("text", text) or (kind, position)."""
    for m in _TURN.finditer(formatted):
        yield unescape(m[1]), [("text", unescape(p[3])) if p[1] is None else (p[1].lower(), int(p[2])) for p in _PIECE.finditer(m[2])]


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn; placeholders aren't text."""
    for role, parts in parse_parts(formatted):
        yield role, "".join(x for kind, x in parts if kind == "text")


def _streamed(turns: DataFrame) -> DataFrame:
    """Conversations whole and in order within partitions."""
    text = F.array_join(F.transform("content", lambda p: F.coalesce(p["text"], F.lit(""))), "")
    keys = ["conv_id", "turn", "role", text, F.to_json(F.struct("content"))]
    return turns.select("conv_id", "turn", "role", "content").repartition("conv_id").sortWithinPartitions(*keys)


def format_turns(turns: DataFrame) -> DataFrame:
    """A row for each turn of (conv_id, turn, role, content): conv_id, at (its place in the conversation), formatted,
    loss_mask (assistant turns) and attachments.  A conversation's text is its rows' texts in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, at, first, begun = None, 0, 0, False
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if not begun or row["conv_id"] != conv:
                    conv, at, first, begun = row["conv_id"], 0, 0, True
                text, found = format_turn(row["role"], row["content"], at, first)
                rows.append({"conv_id": conv, "at": at, "formatted": text, "loss_mask": row["role"] == "assistant", "attachments": [a._asdict() for a in found]})
                at, first = at + 1, first + len(found)
            yield pa.RecordBatch.from_pylist(rows, _FORMATTED)

    return _streamed(turns).mapInArrow(run, "conv_id long, at long, formatted string, loss_mask boolean, attachments array<struct<turn:long,position:long,kind:string,ref:string,text:string,n_tokens:long>>")


_FORMATTED = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("formatted", pa.string()), ("loss_mask", pa.bool_()), ("attachments", pa.list_(pa.struct([("turn", pa.int64()), ("position", pa.int64()), ("kind", pa.string()), ("ref", pa.string()), ("text", pa.string()), ("n_tokens", pa.int64())])))])


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted turns, which have to come in order as format_turns gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, begun, state = None, False, None
        for batch in batches:
            done = []
            for row in batch.select(["conv_id", "formatted", "loss_mask"]).to_pylist():
                if not begun or row["conv_id"] != conv:
                    if begun:
                        done.append(state.row(conv))
                    conv, begun, state = row["conv_id"], True, _Digest()
                state.add(row["formatted"])
            if done:
                yield pa.RecordBatch.from_pylist(done, _DIGESTS)
        if begun:
            yield pa.RecordBatch.from_pylist([state.row(conv)], _DIGESTS)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


class _Digest:
    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, formatted: str) -> None:
        self.chars += len(formatted)
        for role, text in parse(formatted):
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode())
            if role == "assistant":
                self.loss.update(text.encode())
                self.loss_chars += len(text)

    def row(self, conv: int | None) -> dict:
        return {"conv_id": conv, "n_turns": self.n_turns, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars}


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that says what other templates take for control strings."""
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(added)
    content = F.array(F.struct(F.lit("text").alias("kind"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref")))
    return digest(format_turns(turns.withColumn("content", content)))


#: formatted_chars counts the template's 19 characters a turn and a backslash before each `\\`, `<` and `[`.
OP4_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(19 + length(regexp_replace(role, '[\\<\[]', '..', 'g')) + length(regexp_replace(text, '[\\<\[]', '..', 'g')))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""
