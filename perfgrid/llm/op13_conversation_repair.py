"""Repair of conversations by the cheapest edits, streamed in the order of turns.

Rows are repartitioned by conversation and sorted by turn (NULL first, then role and text); a task reads
them once, in Arrow batches, and carries a dynamic programme over four states across them:
nothing written yet, a system row written, a user row last, an assistant row last. For each state
it holds the least cost, the order of the state's edits among those of the other states (for
ties), and a running SHA-256 of the repaired text, so that texts are read once and never kept.
Backpointers take four bytes a row; those of a long conversation are spilled to the shared folder in
chunks and read back from the end. Memory does not grow with a conversation, but for its audit string.

A row's first fault counts: blank, duplicate (role and text seen earlier; settled before by grouped
minima, not by a set in the task), truncated (does not end in . ! or ?). Edits: Keep 0,
Rerole to user or assistant 1, Delete 2 (the only edit for blank and duplicate rows), Insert an empty
user or assistant row 5; a truncated row that stays costs 5 more. The roles' first letters of
the result follow ``(s?(ua)+)?``; of equally cheap edits the least audit string in ASCII is taken.

NULL roles and texts count as one space. A NULL turn sorts first and takes no part in gaps. Rows
with a NULL conv_id are one conversation. Rows of one turn are ordered by role and text; repeated rows are
duplicates of the first. A role without one of the letters s, u, a first cannot be kept.
A conversation of which no row is left has zeros, an empty audit and the hash of the empty string.
An empty table gives no rows; other columns are not read. One conversation is one task's stream,
as its hash runs over the whole text.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perfgrid.llm.common import load, new_folder, query, table
from perfgrid.llm.op5_packed_ids import _fs as file_system
from perfgrid.session import broadcast_checked

BLANKS = " \t\n\v\f\r"
START, SYSTEM, USER, ASSISTANT = range(4)
NEEDS = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}  # the role that may follow
ROLE = {"u": b"user:", "a": b"assistant:"}
#: what may happen at a row, in ASCII order: inserts before it, then its own edit
MOVES = sorted(["D", *("I" * n + e for n in range(3) for e in "KR")])
FAULTS = BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def written(state: int, letter: str) -> int:
    return {"s": SYSTEM, "u": USER, "a": ASSISTANT}[letter]


def moves_of(initial: str, fault: int) -> list[tuple[int, int, int, int, str]]:
    """(state, move, next state, cost, letters written) of a row with this role initial and fault."""
    out = []
    for state in range(4):
        for number, move in enumerate(MOVES):
            if move == "D":
                out.append((state, number, state, 2, ""))
                continue
            if fault in (BLANK, DUPLICATE):
                continue
            at, letters = state, ""
            for _ in move[:-1]:
                letters += NEEDS[at]
                at = written(at, NEEDS[at])
            letter = NEEDS[at] if move[-1] == "R" or initial == NEEDS[at] else "s" if at == START and initial == "s" else None
            if letter is not None:
                out.append((state, number, written(at, letter), 5 * (len(move) - 1) + (move[-1] == "R") + 5 * (fault == TRUNCATED), letters + letter))
    return out


TABLE = {(i, f): moves_of(i, f) for i in ("s", "u", "a", "") for f in (0, *FAULTS)}


class Pointers:
    """One byte for each state and row: 8 times the state before plus the move. Spilled in chunks."""

    def __init__(self, folder: str, spill_bytes: int):
        self.path, self.limit, self.held, self.spilled, self.out = f"{folder}/{uuid.uuid4().hex}", spill_bytes, bytearray(), 0, None

    def add(self, four: bytes) -> None:
        self.held += four
        if len(self.held) >= self.limit:
            if self.out is None:
                fs, at = file_system(self.path)
                fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
                self.out = fs.open_output_stream(at)
            self.out.write(bytes(self.held))
            self.spilled += len(self.held)
            self.held.clear()

    def chunks_backwards(self) -> Iterator[bytes]:
        yield bytes(self.held)
        if self.out is not None:
            self.out.close()
            fs, at = file_system(self.path)
            with fs.open_input_file(at) as f:
                for start in range(self.spilled - self.limit, -1, -self.limit):
                    yield f.read_at(self.limit, start)
            fs.delete_file(at)

    def audit(self, state: int, end: str) -> str:
        parts, of_move = [end], [m for m in MOVES]
        for chunk in self.chunks_backwards():
            back = []
            for at in range(len(chunk) - 4, -1, -4):
                b = chunk[at + state]
                back.append(of_move[b & 7])
                state = b >> 3
            parts.append("".join(reversed(back)))
        return "".join(reversed(parts))


class Repair:
    """State of one conversation."""

    def __init__(self, conv_id, folder: str, spill_bytes: int):
        self.conv_id, self.pointers = conv_id, Pointers(folder, spill_bytes)
        self.cost, self.order, self.sha = [0, None, None, None], [0, 0, 0, 0], [hashlib.sha256(), None, None, None]
        self.faults, self.illegal, self.last, self.rows = [0, 0, 0, 0], 0, None, 0
        self.low = self.high = self.turn = None
        self.turns, self.before = 0, None

    def add(self, turn, role: str, text: str, fault: int, tied: bool) -> None:
        if tied and self.before == (turn, role, text) and fault != BLANK:
            fault = DUPLICATE
        self.before, self.rows = (turn, role, text), self.rows + 1
        if turn is not None and turn != self.turn:
            self.low, self.high, self.turn, self.turns = turn if self.low is None else self.low, turn, turn, self.turns + 1
        initial = role[:1]
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial
        self.faults[fault] += 1
        best: list = [None] * 4
        for move in TABLE[initial if initial in ("s", "u", "a") else "", fault]:
            c = self.cost[move[0]]
            if c is not None:
                key = (c + move[3]) * 64 + self.order[move[0]] * 8 + move[1]
                old = best[move[2]]
                if old is None or key < old[0]:
                    best[move[2]] = (key, move)
        body, own, sha = text.encode(), role.encode() + b":", [None] * 4
        for state, b in enumerate(best):
            if b is not None:
                sha[state] = self.write(self.sha[b[1][0]].copy(), b[1], body, own)
        alive = sorted((b[0] & 63, s) for s, b in enumerate(best) if b is not None)
        self.order = [0] * 4
        for place, (_, s) in enumerate(alive):
            self.order[s] = place
        self.cost = [None if b is None else b[0] >> 6 for b in best]
        self.sha = sha
        self.pointers.add(bytes(0 if b is None else b[1][0] * 8 + b[1][1] for b in best))

    @staticmethod
    def write(sha, move, body: bytes, own: bytes):
        state, number, _, _, letters = move
        fresh = state == START
        for n, letter in enumerate(letters):
            mine = n == len(letters) - 1
            head = own if mine and MOVES[number][-1] == "K" else ROLE[letter]
            sha.update(head if fresh else b"\n" + head)
            fresh = False
            if mine:
                sha.update(body)
        return sha

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        ends = {START: "", ASSISTANT: "", USER: "I", SYSTEM: "II"}
        _, _, state = min((c + 5 * len(ends[s]), self.order[s], s) for s, c in enumerate(self.cost) if c is not None)
        sha, at = self.sha[state], state
        for _ in ends[state]:
            sha.update(b"\n" + ROLE[NEEDS[at]])
            at = written(at, NEEDS[at])
        cost = self.cost[state] + 5 * len(ends[state])
        audit = self.pointers.audit(state, ends[state])
        return self.conv_id, gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[TRUNCATED], self.illegal, cost, audit, sha.hexdigest()


def prepared(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, there, fault, tied), written; ``there`` false marks a row that only
    names its conversation, ``tied`` a row that is a duplicate if it equals the row before."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    r = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), F.coalesce("there", F.lit(True)).alias("there"))
    key = F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)
    r = r.withColumn("_c", space("conv_id")).withColumn("_d", F.when(F.col("there"), key))
    seen = r.filter("there").groupBy("_c", "_d").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("turn")).alias("first")).filter("n > 1").drop("n")
    r = r.join(broadcast_checked(table(seen, "seen"), 256), ["_c", "_d"], "left").drop("_d")
    later = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    core = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(core == "", BLANK).when(later, DUPLICATE).when(~F.substring(core, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    return r.select("conv_id", "_c", "turn", "role", "text", "there", fault.alias("fault"), (F.col("first").isNotNull() & ~later).alias("tied"))


def in_order(rows: DataFrame) -> DataFrame:
    order = ("_c", F.asc_nulls_first("turn"), "role", "text")
    return rows.repartition("_c").sortWithinPartitions(*order)


def repair_plans(turns: DataFrame, spill_bytes: int = 1 << 20) -> DataFrame:
    """One row for each conversation of (conv_id, turn, role, text, there): faults, gaps, illegal neighbours,
    the cost and audit of the cheapest repair and the hash of the repaired text."""
    if "there" not in turns.columns:
        turns = turns.withColumn("there", F.lit(True))
    folder, spill_bytes = new_folder(turns.sparkSession, "backpointers"), max(4, spill_bytes // 4 * 4)
    names = [f.split()[0] for f in RESULT.split(", ")]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, current, out = None, None, []

        def flush():
            cols = list(zip(*out)) or [[] for _ in names]
            types = [pa.int64()] * 7 + [pa.string()] * 2
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                for c, conv, turn, role, text, there, fault, tied in zip(*(x.to_pylist() for x in part.columns)):
                    if c != current:
                        if now is not None:
                            out.append(now.result())
                        current, now = c, Repair(conv, folder, spill_bytes)
                    if there:
                        now.add(turn, role, text, fault, tied)
            if len(out) >= 256:
                yield flush()
        if now is not None:
            out.append(now.result())
        yield flush()

    rows = in_order(prepared(turns)).select("_c", "conv_id", "turn", "role", "text", "there", "fault", "tied")
    return rows.mapInArrow(stream, RESULT)


def repaired_turns(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the rows of the repaired conversations, places from 0."""
    if "there" not in turns.columns:
        turns = turns.withColumn("there", F.lit(True))
    number = F.row_number().over(Window.partitionBy("_c").orderBy(F.asc_nulls_first("turn"), "role", "text")) - 1
    rows = prepared(turns).filter("there").select("_c", number.alias("at"), "role", "text")
    steps = F.posexplode(F.regexp_extract_all("audit", F.lit("I*[KRD]|I+$"), F.lit(0)))
    steps = plans.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("_c"), steps.alias("at", "step"))
    edits = steps.join(rows, ["_c", "at"], "left").select("conv_id", "_c", "at", "role", "text", F.posexplode(F.regexp_extract_all("step", F.lit("."), F.lit(0))).alias("sub", "edit")).filter("edit <> 'D'")
    first = Window.partitionBy("_c").orderBy("at", "sub")
    e = edits.withColumn("place", (F.row_number().over(first) - 1).cast("long"))
    system = F.max(F.when((F.col("place") == 0) & (F.col("edit") == "K") & F.col("role").startswith("s"), 1).otherwise(0)).over(Window.partitionBy("_c"))
    role = F.when(F.col("edit") == "K", F.col("role")).when((F.col("place") - F.col("_s")) % 2 == 0, "user").otherwise("assistant")
    return e.withColumn("_s", system).select("conv_id", "place", role.alias("role"), F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of ``conversations`` damaged by a checksum of conversation and turn; NULLs become a space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    r = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).alias("_h"))
    r = r.withColumn("text", F.when(F.col("_h") <= 1, "").when(F.col("_h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    r = r.withColumn("role", F.when(F.col("_h") == 4, "user").otherwise(F.col("role"))).withColumn("there", F.col("_h") != 0)
    return r.withColumn("_n", F.explode(F.when(F.col("_h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_h", "_n")


def _moves_sql() -> str:
    """The moves of all rows that are neither blank nor duplicate, as SQL values."""
    rows = []
    for initial in ("s", "u", "a", ""):
        for state, number, to, cost, letters in moves_of(initial, 0):
            move = MOVES[number]
            lead = letters[:-1] if move[-1] == "R" or move[-1] == "K" else ""
            rows.append(f"('{initial}', {state}, {to}, {cost}, '{move}', '{lead}', '{letters[-1:]}')")
    return ", ".join(rows)


SQL = f"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             list_concat([4294967295], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)) AS bytes FROM conversations),
h AS (SELECT k.*, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS h FROM k, tab),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
             CASE WHEN h = 1 THEN '' WHEN h = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE h <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core FROM d),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again, lag(role) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM o),
r AS (SELECT *, CASE WHEN core = '' THEN 1 WHEN again THEN 2 WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
             CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '' END AS initial FROM f),
moves AS (SELECT * FROM (VALUES {_moves_sql()}) AS m(initial, state, next, price, move, lead, letter)),
step AS (SELECT DISTINCT conv_id, 0::BIGINT AS n, 0 AS state, 0 AS cost, '' AS audit, '' AS body FROM conversations
    UNION ALL
    SELECT conv_id, n, next, cost, audit, body FROM (
        SELECT s.conv_id, r.n, m.next, s.cost + m.price + CASE WHEN r.fault = 3 AND m.move <> 'D' THEN 5 ELSE 0 END AS cost, s.audit || m.move AS audit,
               CASE WHEN m.move = 'D' THEN s.body ELSE s.body || CASE WHEN s.state = 0 THEN '' ELSE chr(10) END
                 || replace(replace(m.lead, 'u', 'user:' || chr(10)), 'a', 'assistant:' || chr(10))
                 || CASE WHEN right(m.move, 1) = 'K' THEN r.role WHEN m.letter = 'u' THEN 'user' ELSE 'assistant' END || ':' || r.text END AS body,
               row_number() OVER (PARTITION BY s.conv_id, m.next ORDER BY s.cost + m.price + CASE WHEN r.fault = 3 AND m.move <> 'D' THEN 5 ELSE 0 END, s.audit || m.move) AS best
        FROM step s JOIN r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.n = s.n + 1
        JOIN moves m ON m.initial = r.initial AND m.state = s.state AND (r.fault NOT IN (1, 2) OR m.move = 'D')) WHERE best = 1),
e AS (SELECT conv_id, n, cost + CASE state WHEN 2 THEN 5 WHEN 1 THEN 10 ELSE 0 END AS cost, audit || CASE state WHEN 2 THEN 'I' WHEN 1 THEN 'II' ELSE '' END AS audit,
             body || CASE state WHEN 2 THEN chr(10) || 'assistant:' WHEN 1 THEN chr(10) || 'user:' || chr(10) || 'assistant:' ELSE '' END AS body FROM step),
b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, cost, audit) = 1),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
             count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (n > 1 AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT b.conv_id, coalesce(g.gaps, 0)::BIGINT AS gaps, coalesce(g.blank, 0)::BIGINT AS blank, coalesce(g.duplicate, 0)::BIGINT AS duplicate, coalesce(g.truncated, 0)::BIGINT AS truncated,
       coalesce(g.illegal, 0)::BIGINT AS illegal, b.cost::BIGINT AS cost, b.audit, sha256(b.body) AS repaired_sha256
FROM b LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM b.conv_id
"""


@query("op13_conversation_repair", SQL)
def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_plans(damaged(load(spark, sf_dir, "conversations")))
