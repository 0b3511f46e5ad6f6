"""Conversation structure repair (operator 12): the cheapest edits that give a conversation legal turns.

A conversation is legal when its roles' initials are `(s?(ua)+)?`.  Each row is kept (cost 0), gets another role (1), is
deleted (2; blank rows and duplicates have to be) or has rows with an empty text put in before or after it (5 each);
truncated rows that stay cost 5 more.  `audits` gives the edits as initials, D, I, K and R, in order, and of all cheapest
ones the least by ASCII.

What edits a conversation needs depends on its rows' roles and faults alone, one symbol a row: its signature.  Distinct
signatures, sorted, are walked as a prefix trie, one shared path at a time; a layer of the dynamic programme is computed
once for each node (of each partition: they are dealt by ranges, so a prefix is shared across few) and a terminal node
gives its answer.  Signatures are read from the conversation's end, so a layer tells what the rest of a conversation
costs from each state on; options of a state differ in their first letter, which is therefore enough to find the least
audit.  Memory is that of the longest signature, a few dozen bytes for each of its rows.

Texts travel once, at the end: signatures come from digests.  A conversation is read row by row in its order, in one
task, since its audit is one value and its digest depends on the order; a conversation of a third of all rows costs that
task time, not memory (besides the audit).

Defined results: a null role or text is one space; null turns come first; rows of one turn are ordered by role and the
SHA-256 of the text; repeated rows are rows of their own (and so duplicates); rows with a null conv_id are one
conversation; a conversation whose rows are all gone has an empty audit; an empty table gives an empty result; other
columns are passed over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.store import kept

SPACES = " \t\n\x0b\x0c\r"
SOUND, TRUNCATED, DUPLICATE, BLANK = range(4)
#: What edits cost, and what a truncated row that stays costs besides.
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
#: A row that has to go.
GONE = "x"
#: States: nothing yet, after the system row, after a user's, after an assistant's; and the role that each waits for.
START, SYSTEM, USER, ASSISTANT = range(4)
WANTS = ("user", "user", "assistant", "user")
THEN = (USER, USER, ASSISTANT, USER)
#: Signatures are dealt by so many of their last rows.
DEALT_BY = 256
_NEVER = 1 << 60
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")


def damaged(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) with the faults that a checksum of conv_id and turn deals out; copies: how
    often the row is there, 0 to 2."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    fault = F.crc32(F.encode(key, "UTF-8")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    text = F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text)
    return turns.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"))


def _ordered(turns: DataFrame) -> tuple[DataFrame, list[Column]]:
    """Rows with a digest of their text, and their order within a conversation."""
    copies = F.col("copies") if "copies" in turns.columns else F.lit(1)
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copies"))
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256))), [F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]


def signatures(turns: DataFrame) -> DataFrame:
    """Per conversation of (conv_id, turn, role, text and, if there, copies): its counts and its signature, which has one
    symbol for each row, from the last to the first: the role's initial, or `o`, in capitals if truncated, or `x`."""
    rows, order = _ordered(turns)
    last = F.right(F.rtrim(F.col("text"), F.lit(SPACES)), F.lit(1))
    rows = rows.select("conv_id", "turn", "role", "digest", "copies", F.when(last == "", BLANK).when(last.isin(".", "!", "?"), SOUND).otherwise(TRUNCATED).alias("fault"))
    # Rows of no copy don't count as seen; those that are there stand apart from them.
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "digest", F.col("copies") > 0).orderBy(F.asc_nulls_first("turn"))) > 1
    initial = F.substring("role", 1, 1)
    rows = rows.withColumn("fault", F.when(seen & (F.col("fault") != BLANK), DUPLICATE).otherwise(F.col("fault"))).withColumn("initial", F.when(initial.isin("s", "u", "a"), initial).otherwise("o"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None
        for batch in batches:
            done = []
            for of, turn, initial, fault, copies in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "fault", "copies"))):
                if state is None or of != conv:
                    if state is not None:
                        done.append(state.row(conv))
                    conv, state = of, _Signature()
                for k in range(copies):
                    state.add(turn, initial, fault if not k or fault == BLANK else DUPLICATE)
            if done:
                yield pa.RecordBatch.from_pylist(done, fields)
        if state is not None:
            yield pa.RecordBatch.from_pylist([state.row(conv)], fields)

    kind = turns.schema["conv_id"].dataType.simpleString()
    fields = pa.schema([("conv_id", _arrow(turns, "conv_id")), *((c, pa.int64()) for c in _COUNTS), ("signature", pa.string())])
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", *order).select("conv_id", "turn", "initial", "fault", "copies")
    return ordered.mapInArrow(run, f"conv_id {kind}, {', '.join(f'{c} long' for c in _COUNTS)}, signature string")


def _arrow(rows: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema[column].dataType)


class _Signature:
    """Counts and symbols of a conversation whose rows come in order."""

    def __init__(self) -> None:
        self.symbols, self.before = bytearray(), ""
        self.faults, self.illegal = [0, 0, 0, 0], 0
        self.first = self.last = None
        self.distinct = 0

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        self.faults[fault] += 1
        self.illegal += bool(self.before) and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.distinct += turn != self.last
            self.last = turn
        self.symbols += (GONE if fault >= DUPLICATE else initial.upper() if fault == TRUNCATED else initial).encode()

    def row(self, conv) -> dict:
        gaps = 0 if self.first is None else min(self.last - self.first + 1 - self.distinct, (1 << 63) - 1)
        return {"conv_id": conv, "gaps": gaps, "blank": self.faults[BLANK], "duplicate": self.faults[DUPLICATE], "truncated": self.faults[TRUNCATED], "illegal": self.illegal, "signature": self.symbols[::-1].decode()}


def _least(options: list[tuple[int, str]]) -> tuple[int, str]:
    return min(options, default=(_NEVER, ""))


def _with_inserts(base: list[tuple[int, str]]) -> tuple[tuple[int, str], ...]:
    user = min(base[USER], (INSERT + base[ASSISTANT][0], "I"))
    assistant = min(base[ASSISTANT], (INSERT + base[USER][0], "I"))
    return min(base[START], (INSERT + user[0], "I")), min(base[SYSTEM], (INSERT + user[0], "I")), user, assistant


#: The layer of no rows: for each state the least cost to a legal end and the first letter of the least audit.
END = _with_inserts([(0, ""), (_NEVER, ""), (_NEVER, ""), (0, "")])


def kept_state(state: int, symbol: str) -> int | None:
    """The state after a row that stays as it is; None where it can't."""
    initial = symbol.lower()
    if initial == "s":
        return SYSTEM if state == START else None
    return THEN[state] if initial == WANTS[state][0] else None


def layer(symbol: str, rest: tuple[tuple[int, str], ...]) -> tuple[tuple[int, str], ...]:
    """The layer of a row and what follows it."""
    base, stays = [], CUT if symbol.isupper() else 0
    for state in range(4):
        options = [(DELETE + rest[state][0], "D")]
        if symbol != GONE:
            to = kept_state(state, symbol)
            if to is not None:
                options.append((stays + rest[to][0], "K"))
            options.append((stays + REROLE + rest[THEN[state]][0], "R"))
        base.append(_least(options))
    return _with_inserts(base)


def walk(signatures: Iterator[str]) -> Iterator[tuple[str, int, str]]:
    """(signature, cost, audit) of sorted signatures; of a trie's layers only those of the path to the present node are
    held, and each node's is computed once."""
    path, layers = "", [END]
    for signature in signatures:
        shared = sum(1 for _ in takewhile(lambda pair: pair[0] == pair[1], zip(path, signature)))
        del layers[shared + 1 :]
        for symbol in signature[shared:]:
            layers.append(layer(symbol, layers[-1]))
        path = signature
        audit, at, state = [], len(signature), START
        while letter := layers[at][state][1]:
            audit.append(letter)
            if letter == "K":
                state = kept_state(state, signature[at - 1])
            elif letter != "D":
                state = THEN[state]
            at -= letter != "I"
        yield signature, layers[-1][START][0], "".join(audit)


def answers(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit) of each distinct signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for answer in walk(s for batch in batches for s in batch.column("signature").to_pylist()):
            found.append(answer)
            size += len(answer[0])
            if size > 1 << 20 or len(found) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found)], ["signature", "cost", "audit"])
                found, size = [], 0
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found)], ["signature", "cost", "audit"])

    distinct = signatures.select("signature").distinct()
    dealt = distinct.repartitionByRange(F.substring("signature", 1, DEALT_BY)).sortWithinPartitions("signature")
    return dealt.mapInArrow(run, "signature string, cost long, audit string")


def audits(turns: DataFrame) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost and audit."""
    found = kept(signatures(turns), "signatures")
    # Both sides are plain tables, so a signature that a third of all conversations have can be split.
    return found.join(kept(answers(found), "answers"), "signature").select("conv_id", *_COUNTS, "cost", "audit")


def repaired(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """The rows (conv_id, at, edit, role, text) of the repaired conversations, each whole and in order in a partition: a
    conversation's audit comes before its rows and tells what becomes of each."""
    rows, order = _ordered(turns)
    heads = audits.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"), F.lit(1).alias("copies"), F.lit(None).cast("binary").alias("digest"))
    both = heads.unionByName(rows.withColumn("kind", F.lit(1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, edits = None, None
        for batch in batches:
            out, size = [], 0
            for of, kind, role, text, copies in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text", "copies"))):
                if not kind:
                    if edits is not None:
                        out.extend({"conv_id": conv, **row} for row in edits.rest())
                    conv, edits = of, _Edits(text)
                    continue
                for _ in range(copies):
                    out.extend({"conv_id": conv, **row} for row in edits.take(role, text))
                size += len(text)
                if size > 1 << 20:
                    yield pa.RecordBatch.from_pylist(out, fields)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, fields)
        if edits is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, **row} for row in edits.rest()], fields)

    kind = turns.schema["conv_id"].dataType.simpleString()
    fields = pa.schema([("conv_id", _arrow(turns, "conv_id")), ("at", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *order).select("conv_id", "kind", "role", "text", "copies")
    return ordered.mapInArrow(run, f"conv_id {kind}, at long, edit string, role string, text string")


class _Edits:
    """Applies an audit to rows that come in order."""

    def __init__(self, audit: str) -> None:
        self.letters, self.state, self.at = iter(audit), START, 0

    def _row(self, edit: str, role: str, text: str, state: int) -> dict:
        self.at, self.state = self.at + 1, state
        return {"at": self.at - 1, "edit": edit, "role": role, "text": text}

    def _inserted(self) -> dict:
        return self._row("I", WANTS[self.state], "", THEN[self.state])

    def take(self, role: str, text: str) -> Iterator[dict]:
        for letter in self.letters:
            if letter == "I":
                yield self._inserted()
                continue
            if letter == "K":
                yield self._row("K", role, text, kept_state(self.state, role[:1]))
            elif letter == "R":
                yield self._row("R", WANTS[self.state], text, THEN[self.state])
            return

    def rest(self) -> Iterator[dict]:
        for _ in self.letters:
            yield self._inserted()


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of rows that come as `repaired` gives them: `role:text`, joined by newlines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None
        for batch in batches:
            done = []
            for of, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if state is None or of != conv:
                    if state is not None:
                        done.append({"conv_id": conv, "repaired_sha256": state.hexdigest()})
                    conv, state = of, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            if done:
                yield pa.RecordBatch.from_pylist(done, fields)
        if state is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "repaired_sha256": state.hexdigest()}], fields)

    fields = pa.schema([("conv_id", _arrow(repaired, "conv_id")), ("repaired_sha256", pa.string())])
    return repaired.mapInArrow(run, f"conv_id {repaired.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by a checksum and repaired."""
    turns = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    found = kept(audits(turns), "audits")
    sums = digests(repaired(turns, found)).select(F.col("conv_id").alias("_conv"), "repaired_sha256")
    whole = found.join(sums, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return whole.select("conv_id", *_COUNTS, "cost", "audit", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


#: The programme from each conversation's last row to its first: for each state (s, y, u, a: nothing yet, after the system
#: row, a user's, an assistant's) the least (cost, audit).
OP12_SQL = r"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)),
      lambda x, b: list_reduce(list_concat([xor(x, b)], range(8)), lambda y, i: xor(y >> 1, 3988292384 * (y & 1)))) AS crc
  FROM conversations
), faulty AS (
  SELECT *, xor(crc, 4294967295) % 20 AS f FROM given
), rows AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM faulty CROSS JOIN (VALUES (1), (2)) AS c(copy) WHERE f <> 0 AND (copy = 1 OR f = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos FROM rows
), judged AS (
  SELECT *, left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS ini_before, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS seen
  FROM placed
), signed AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN seen THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM judged
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE ini_before || ini NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM signed GROUP BY conv_id
), layers AS (
  SELECT conv_id, n + 1 AS pos, {'c': 0::BIGINT, 'a': ''} AS s, {'c': 10::BIGINT, 'a': 'II'} AS y, {'c': 5::BIGINT, 'a': 'I'} AS u, {'c': 0::BIGINT, 'a': ''} AS a FROM counted
  UNION ALL
  SELECT conv_id, pos, list_sort([b_s, {'c': nu.c + 5, 'a': 'I' || nu.a}])[1], list_sort([b_y, {'c': nu.c + 5, 'a': 'I' || nu.a}])[1], nu, na FROM (
    SELECT *, list_sort([b_u, {'c': b_a.c + 5, 'a': 'I' || b_a.a}])[1] AS nu, list_sort([b_a, {'c': b_u.c + 5, 'a': 'I' || b_u.a}])[1] AS na FROM (
      SELECT conv_id, pos,
        list_sort([{'c': l.s.c + 2, 'a': 'D' || l.s.a}, {'c': l.y.c + CASE WHEN x.ini = 's' THEN x.stays ELSE 1000000000 END, 'a': 'K' || l.y.a}, {'c': l.u.c + CASE WHEN x.ini = 'u' THEN x.stays ELSE 1000000000 END, 'a': 'K' || l.u.a}, {'c': l.u.c + 1 + x.stays, 'a': 'R' || l.u.a}])[1] AS b_s,
        list_sort([{'c': l.y.c + 2, 'a': 'D' || l.y.a}, {'c': l.u.c + CASE WHEN x.ini = 'u' THEN x.stays ELSE 1000000000 END, 'a': 'K' || l.u.a}, {'c': l.u.c + 1 + x.stays, 'a': 'R' || l.u.a}])[1] AS b_y,
        list_sort([{'c': l.u.c + 2, 'a': 'D' || l.u.a}, {'c': l.a.c + CASE WHEN x.ini = 'a' THEN x.stays ELSE 1000000000 END, 'a': 'K' || l.a.a}, {'c': l.a.c + 1 + x.stays, 'a': 'R' || l.a.a}])[1] AS b_u,
        list_sort([{'c': l.a.c + 2, 'a': 'D' || l.a.a}, {'c': l.u.c + CASE WHEN x.ini = 'u' THEN x.stays ELSE 1000000000 END, 'a': 'K' || l.u.a}, {'c': l.u.c + 1 + x.stays, 'a': 'R' || l.u.a}])[1] AS b_a
      FROM (SELECT l.conv_id, x.pos, l, x FROM layers AS l
        JOIN (SELECT conv_id, pos, ini, CASE fault WHEN '' THEN 0 WHEN 'truncated' THEN 5 ELSE 1000000000 END::BIGINT AS stays FROM signed) AS x
        ON x.conv_id IS NOT DISTINCT FROM l.conv_id AND x.pos = l.pos - 1)
    )
  )
), answered AS (
  SELECT conv_id, s.c AS cost, s.a AS audit FROM layers WHERE pos = 1
), letters AS (
  SELECT conv_id, e, j, count(*) FILTER (WHERE e <> 'I') OVER (PARTITION BY conv_id ORDER BY j) AS pos, count(*) FILTER (WHERE e <> 'D') OVER (PARTITION BY conv_id ORDER BY j) AS o
  FROM (SELECT conv_id, unnest(string_split(audit, '')) AS e, generate_subscripts(string_split(audit, ''), 1) AS j FROM answered WHERE audit <> '')
), outcome AS (
  SELECT l.conv_id, l.e, l.o, x.role, CASE WHEN l.e = 'I' THEN '' ELSE x.text END AS text, bool_or(l.o = 1 AND l.e = 'K' AND x.ini = 's') OVER (PARTITION BY l.conv_id) AS headed
  FROM letters AS l LEFT JOIN signed AS x ON x.conv_id IS NOT DISTINCT FROM l.conv_id AND x.pos = l.pos WHERE l.e <> 'D'
), texts AS (
  SELECT conv_id, string_agg((CASE WHEN e = 'K' THEN role WHEN (o - headed::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY o) AS whole FROM outcome GROUP BY conv_id
)
SELECT i.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
  coalesce(a.cost, 0) AS cost, coalesce(a.audit, '') AS audit, sha256(coalesce(t.whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS i LEFT JOIN counted AS c ON c.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN answered AS a ON a.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN texts AS t ON t.conv_id IS NOT DISTINCT FROM i.conv_id
"""
