"""Operator 11: repair of conversations by the cheapest edits, found by a dynamic programme over persistent audits.

Rows of a conversation come in order and are kept, given another role, deleted, or preceded by inserted rows, so that role initials become (s?(ua)+)?. Where in that pattern a
repair stands is one of four states. For each state the cheapest edits so far are kept, of equal cost those whose audit (the edits' initials) is least.

An audit is a node that links to the audit it goes on from, so all states share what they have in common and a step adds a few nodes. A node has ancestors at
powers of two and a rolling hash. Two audits of equal cost are compared at the end of their longest common prefix, which is found by jumps to ancestors with different hashes; that the
hashes of the prefix are equal is verified by its edits, so collisions of hashes change nothing.

Rows stream through: what all four states have in common is final, and is given out and forgotten as they come. So a task holds the rows on which states still
differ, not the conversation. A conversation is one task's work, as the hash of its repaired text can't be made of parts.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Costs of edits, and of a truncated row that isn't deleted.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, after a system row, after a user row, after an assistant row; a repair may end in FINAL.
START, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (START, ASSISTANT)
INTO = {"s": (SYSTEM, (START,)), "u": (USER, (START, SYSTEM, ASSISTANT)), "a": (ASSISTANT, (USER,))}
#: Rows held, and bytes of them, after which what is final is given out.
HELD_ROWS, HELD_BYTES = 1024, 4 << 20
PRIME, BASE = (1 << 61) - 1, 0x1F3D5B79A8642


class Audits:
    """Strings that share prefixes: node 0 is empty, any other is a node and one more character."""

    def __init__(self, prime: int = PRIME):
        self.prime = prime
        self.clear()

    def clear(self) -> None:
        self.char, self.depth, self.hash, self.up = [""], [0], [0], [[]]
        self.same: set[tuple[int, int]] = set()

    def add(self, node: int, char: str) -> int:
        new, ups = len(self.char), [node]
        while len(self.up[ups[-1]]) >= len(ups):  # the ancestor 2^k above is 2^(k-1) above that 2^(k-1) above
            ups.append(self.up[ups[-1]][len(ups) - 1])
        self.char.append(char)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * BASE + ord(char)) % self.prime)
        self.up.append(ups)
        return new

    def above(self, node: int, steps: int) -> int:
        while steps:
            k = steps.bit_length() - 1
            node, steps = self.up[node][k], steps - (1 << k)
        return node

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.char[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def common_prefix(self, a: int, b: int) -> int:
        """How many characters two nodes begin with alike."""
        n = min(self.depth[a], self.depth[b])
        a, b = self.above(a, self.depth[a] - n), self.above(b, self.depth[b] - n)
        if self.hash[a] != self.hash[b]:
            for k in reversed(range(n.bit_length())):
                if k < len(self.up[a]) and self.hash[self.up[a][k]] != self.hash[self.up[b][k]]:
                    a, b = self.up[a][k], self.up[b][k]
            a, b = self.up[a][0], self.up[b][0]
        return self._verified(a, b)

    def _verified(self, a: int, b: int) -> int:
        """The common prefix of two nodes of equal depth and hash: all of it unless the hashes collide."""
        pairs, alike = [], self.depth[a]
        while a != b and (a, b) not in self.same:
            pairs.append((a, b))
            if self.char[a] != self.char[b]:
                alike = self.depth[a] - 1
                pairs.clear()
            a, b = self.up[a][0], self.up[b][0]
        self.same.update(pairs)
        return alike

    def less(self, a: int, b: int) -> bool:
        n = self.common_prefix(a, b)
        if n in (self.depth[a], self.depth[b]):
            return self.depth[a] < self.depth[b]
        return self.char[self.above(a, self.depth[a] - n - 1)] < self.char[self.above(b, self.depth[b] - n - 1)]


class Repair:
    """The programme of one conversation. cost and node by state; None where a state can't be reached."""

    def __init__(self, audits: Audits):
        audits.clear()
        self.audits = audits
        self.best: list[tuple[int, int] | None] = [(0, 0), None, None, None]
        self._insert()

    def _least(self, options: list[tuple[int, int, str]]) -> tuple[int, int] | None:
        """The cheapest of (cost, node, character or none), of equal ones that of the least audit, as (cost, node)."""
        if not options:
            return None
        cost = min(o[0] for o in options)
        nodes = [self.audits.add(node, char) if char else node for c, node, char in options if c == cost]
        least = nodes[0]
        for node in nodes[1:]:
            if self.audits.less(node, least):
                least = node
        return cost, least

    def _options(self, role: str, cost: int, char: str) -> list[tuple[int, int, str]]:
        return [(self.best[s][0] + cost, self.best[s][1], char) for s in INTO[role][1] if self.best[s]]

    def _insert(self) -> None:
        """Rows inserted where the programme stands: a user row, an assistant row, or one after the other; more never pay."""
        for role in "ua":
            state, own = INTO[role][0], self.best[INTO[role][0]]
            self.best[state] = self._least([*([(*own, "")] if own else []), *self._options(role, INSERT, "I")])

    def row(self, initial: str, gone: bool, truncated: bool) -> None:
        """Edits one row: by the initial of its role, whether it must be deleted, and whether it is truncated."""
        into = [[(b[0] + DELETE, b[1], "D")] if b else [] for b in self.best]
        if not gone:
            more = TRUNCATED * truncated
            for role in "ua":
                into[INTO[role][0]] += self._options(role, REROLE + more, "R")
            if initial in INTO:
                into[INTO[initial][0]] += self._options(initial, more, "K")
        self.best = [self._least(o) for o in into]
        self._insert()
        # after an assistant row whatever may follow is as cheap as after a system row, and at most a deleted system row dearer than at the start
        if own := self.best[ASSISTANT]:
            for state, more in ((START, DELETE), (SYSTEM, 0)):
                if self.best[state] and self.best[state][0] > own[0] + more:
                    self.best[state] = None

    def agreed(self) -> str:
        """What all states' audits begin with, which no later row changes. It is forgotten: audits go on from there."""
        live = [b[1] for b in self.best if b]
        n = min(self.audits.depth[x] for x in live)
        for x in live[1:]:
            n = min(n, self.audits.common_prefix(live[0], x))
        prefix = self.audits.text(live[0])[:n]
        self._restart([b and (b[0], self.audits.text(b[1])[n:]) for b in self.best])
        return prefix

    def _restart(self, rest: list[tuple[int, str] | None]) -> None:
        self.audits.clear()
        known: dict[tuple[int, str], int] = {}

        def node(text: str) -> int:
            at = 0
            for char in text:
                if (at, char) not in known:
                    known[at, char] = self.audits.add(at, char)
                at = known[at, char]
            return at

        self.best = [r and (r[0], node(r[1])) for r in rest]

    def last(self) -> tuple[int, str]:
        """Cost of all, and the rest of the audit."""
        cost, node = self._least([(*self.best[s], "") for s in FINAL if self.best[s]])
        return cost, self.audits.text(node)


def edited(audit: str, rows: deque, state: int) -> Iterator[tuple[str, dict | None, str | None, str | None, int]]:
    """(edit, row or None, role, text, state after) of each edit; takes the rows it is about from the left of rows. A deleted row has no role and text."""
    for edit in audit:
        row = None if edit == "I" else rows.popleft()
        if edit == "D":
            yield edit, row, None, None, state
            continue
        if edit == "K":
            state, role = INTO[row["role"][:1]][0], row["role"]
        else:
            state, role = (ASSISTANT, "assistant") if state == USER else (USER, "user")
        yield edit, row, role, "" if edit == "I" else row["text"], state


def repaired(rows: Iterable[dict], prime: int = PRIME, held_rows: int = HELD_ROWS, held_bytes: int = HELD_BYTES) -> Iterator[tuple]:
    """("edit", conv_id, edit, row or None, role, text) of each edit of conversations in order, then ("end", conv_id, cost, None, None, None) of each.

    rows are dictionaries of conv_id, place (null for a conversation without rows), role, text, fault and what else there is, sorted by conversation and place.
    """
    audits = Audits(prime)
    now, at, pending, size, state = None, object(), deque(), 0, START
    most_rows, most_bytes = held_rows, held_bytes

    def given(audit):
        nonlocal state
        for edit, row, role, text, state in edited(audit, pending, state):
            yield "edit", at, edit, row, role, text

    def ended():
        cost, audit = now.last()
        yield from given(audit)
        yield "end", at, cost, None, None, None

    for row in rows:
        if now is None or row["conv_id"] != at:
            if now:
                yield from ended()
            now, at, size, state = Repair(audits), row["conv_id"], 0, START
            most_rows, most_bytes = held_rows, held_bytes
        if row["place"] is None:
            continue
        pending.append(row)
        size += len(row["text"])
        now.row(row["role"][:1], row["fault"] in ("blank", "duplicate"), row["fault"] == "truncated")
        if len(pending) >= most_rows or size > most_bytes:
            yield from given(now.agreed())
            size = sum(len(r["text"]) for r in pending)
            most_rows, most_bytes = max(held_rows, 2 * len(pending)), max(held_bytes, 2 * size)
    if now:
        yield from ended()


def with_faults(rows: DataFrame) -> DataFrame:
    """Adds fault (blank, duplicate, truncated or null: the first that holds) and place to rows of conversations (conv_id, turn, role, text, times).

    A row counts as so many rows as times says, one after the other; with 0 it only keeps its conversation, without a place. Rows are in order of turn, nulls first, equal turns of role and text;
    place numbers equal ones. One shuffle, by conversation.
    """
    there = rows.withColumn("place", F.explode_outer(F.when(F.col("times") > 0, F.sequence(F.lit(1), F.col("times"))))).drop("times").repartition("conv_id")
    last = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    earlier = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("place").isNull(), F.asc_nulls_first("turn"), "place")
    fault = F.when(F.col("place").isNull(), None).when(last == "", "blank").when(F.row_number().over(earlier) > 1, "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    return there.withColumn("fault", fault)


def _streamed(rows: DataFrame, run, schema: str) -> DataFrame:
    """run over each task's rows as dictionaries, conversations one after the other in order of their places."""
    common.prepare(rows.sparkSession)
    names = ["conv_id", "turn", "role", "text", "place", "fault"]
    ordered = rows.select(*names).sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text", F.asc_nulls_first("place"))

    def work(batches):
        import pyarrow as pa

        def each():
            for batch in common.short(batches, 4096):
                for values in zip(*(c.to_pylist() for c in batch.columns)):
                    yield dict(zip(names, values))

        kinds = {"long": pa.int64(), "string": pa.string()}
        columns = [x.split() for x in schema.split(", ")]
        out, size = [], 0

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*out), columns)], [n for n, _ in columns])

        for row in run(each()):
            out.append(row)
            size += sum(len(v) for v in row if isinstance(v, str))
            if len(out) == 4096 or size > common.BATCH_BYTES:
                yield batch_of()
                out, size = [], 0
        if out:
            yield batch_of()

    return ordered.mapInArrow(work, schema)


def repair_conversations(rows: DataFrame) -> DataFrame:
    """The edits of conversations (conv_id, turn, role, text): conv_id, step (from 0), edit (K, R, D or I), turn, fault, role and text after the edit (null where deleted).

    Nulls in role and text count as one space; an empty role has no initial, so its row can't be kept as it is; null conv_ids are one conversation. Rows in order of turn (nulls first), equal turns of role and text.
    """

    def run(each):
        step = 0
        for kind, conv, edit, row, role, text in repaired(each):
            if kind == "end":
                step = 0
                continue
            yield conv, step, edit, row and row["turn"], row and row["fault"], role, text
            step += 1

    filled = rows.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")), F.lit(1).alias("times"))
    return _streamed(with_faults(filled), run, "conv_id long, step long, edit string, turn long, fault string, role string, text string")


def damaged(rows: DataFrame) -> DataFrame:
    """The query's damage by crc32 of conv_id:turn, nulls as one space: conv_id, turn, role, text and times (0: dropped, 2: repeated)."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(space("conv_id"), F.lit(":"), space("turn")), "UTF-8")) % 20
    text = F.when(kind == 0, "").when(kind == 1, "").when(kind == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times"))


LEGAL = ("su", "ua", "au")
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def digests(each: Iterable[dict]) -> Iterator[tuple]:
    """A row of RESULT for each conversation of a task; holds the audit and counts of one."""

    def fresh():
        return {"blank": 0, "duplicate": 0, "truncated": 0}, bytearray(), hashlib.sha256()

    faults, audit, sha = fresh()
    low = high = before = None
    turns = illegal = 0
    first = True
    for kind, conv, edit, row, role, text in repaired(each):
        if kind == "end":
            gaps = high - low + 1 - turns if turns else 0
            yield conv, gaps if gaps < 1 << 63 else None, *faults.values(), illegal, edit, audit.decode(), sha.hexdigest()
            faults, audit, sha = fresh()
            low = high = before = None
            turns, illegal, first = 0, 0, True
            continue
        audit += edit.encode()
        if row:
            if row["fault"]:
                faults[row["fault"]] += 1
            if row["turn"] is not None and row["turn"] != high:  # in order
                low, high, turns = row["turn"] if low is None else low, row["turn"], turns + 1
            illegal += before is not None and before + row["role"][:1] not in LEGAL
            before = row["role"][:1]
        if role is not None:
            sha.update(("" if first else "\n").encode() + role.encode() + b":" + text.encode())
            first = False


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations and their cheapest repair: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Null conv_ids are one conversation; gaps that pass the longs are null. An empty table gives no rows.
    """
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return _streamed(with_faults(damaged(rows)), digests, RESULT)


def _least_of(*options: str) -> str:
    return f"list_min([{', '.join(options)}])"


def _more(state: str, cost: str, edit: str, text: str = "''") -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{edit}', 't': {state}.t || {text}}}"


def _if(test: str, option: str) -> str:
    return f"CASE WHEN {test} THEN {option} ELSE {_NEVER} END"


#: A state that can't be reached, the bits of crc32 by halvings, and the programme by states of {cost, audit, text}: edits of a row, then inserted rows.
_NEVER = "{'c': CAST(1000000000 AS BIGINT), 'a': '', 't': ''}"
_HALF = "xor(x >> 1, (x & 1) * 3988292384)"
_CRC = f"""list_reduce(list_transform(string_split(k, ''), lambda h: CAST(ascii(h) AS BIGINT)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: {_HALF}), CAST(4294967295 AS BIGINT))"""
_ANEW, _KEPT = "chr(10) || '{}:' || text", "chr(10) || role || ':' || text"
_INTO_USER = [_if("NOT gone", _more(f"s{k}", f"{REROLE} + extra", "R", _ANEW.format("user"))) for k in (0, 1, 3)]
_KEEP_USER = [_if("NOT gone AND initial = 'u'", _more(f"s{k}", "extra", "K", _KEPT)) for k in (0, 1, 3)]
_EDITED = f"""
    {_more('s0', str(DELETE), 'D')} AS e0,
    {_least_of(_more('s1', str(DELETE), 'D'), _if("NOT gone AND initial = 's'", _more('s0', 'extra', 'K', _KEPT)))} AS e1,
    {_least_of(_more('s2', str(DELETE), 'D'), *_INTO_USER, *_KEEP_USER)} AS e2,
    {_least_of(_more('s3', str(DELETE), 'D'), _if('NOT gone', _more('s2', f'{REROLE} + extra', 'R', _ANEW.format('assistant'))), _if("NOT gone AND initial = 'a'", _more('s2', 'extra', 'K', _KEPT)))} AS e3"""
_USER = _least_of("e2", *(_more(f"e{k}", str(INSERT), "I", "chr(10) || 'user:'") for k in (0, 1, 3)))
_ASSISTANT = _least_of("e3", _more("i2", str(INSERT), "I", "chr(10) || 'assistant:'"))
OP11_SQL = f"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), c AS (
  SELECT *, xor({_CRC}, 4294967295) % 20 AS kind FROM k
), d AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM c WHERE kind <> 0
), f AS (
  SELECT *, row_number() OVER w AS n, lag(role[1]) OVER w AS before, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
), r AS (
  SELECT *, role[1] AS initial, CASE WHEN body = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN body[-1] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM f
), p AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS n, {{'c': CAST(0 AS BIGINT), 'a': '', 't': ''}} AS s0, {_NEVER} AS s1, {{'c': CAST({INSERT} AS BIGINT), 'a': 'I', 't': chr(10) || 'user:'}} AS s2, {{'c': CAST({2 * INSERT} AS BIGINT), 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS s3 FROM conversations
  UNION ALL
  SELECT conv_id, n, e0, e1, i2, {_ASSISTANT} FROM (
    SELECT *, {_USER} AS i2 FROM (
      SELECT conv_id, n, {_EDITED} FROM (
        SELECT p.conv_id, r.n, s0, s1, s2, s3, role, text, initial, fault IN ('blank', 'duplicate') AS gone, CASE fault WHEN 'truncated' THEN {TRUNCATED} ELSE 0 END AS extra FROM p JOIN r ON p.conv_id IS NOT DISTINCT FROM r.conv_id AND r.n = p.n + 1)))
), b AS (
  SELECT conv_id, arg_max({_least_of('s0', 's3')}, n) AS b FROM p GROUP BY conv_id
), g AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated, count_if(before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id
)
SELECT b.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, b.c AS cost, b.a AS audit, sha256(substr(b.t, 2)) AS repaired_sha256
FROM b LEFT JOIN g ON b.conv_id IS NOT DISTINCT FROM g.conv_id
"""
