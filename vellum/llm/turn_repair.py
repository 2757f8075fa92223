"""Repair of conversations by the cheapest edits: a rank-compressed dynamic program.

Rows of a conversation, in order, are kept, given another role or deleted, and empty turns are inserted,
so that the roles' initials read s?(ua)+ or nothing. Among the cheapest ways the one with the least audit
(its edits' initials) is wanted.

Edits are put together as macros: a run of inserts and the edit of the row that follows. The macros' codes
are prefix-free and are taken in their ASCII order, so audits compare like sequences of codes and a layer of
the program (after each row, one entry for each state of the pattern) needs no audit strings: an entry has
its cost, its rank among the layer's audits, and a pointer to the entry and code it came from. Ranks of the
next layer are those of (rank of the parent, code). Audits are read off the pointers afterwards. Costs count
from the layer's least, so few layers differ; each is worked out once for each kind of row and looked up.

A conversation's rows are never gathered with their texts. Rows are dealt by ranges of (conversation, turn,
role, text), so that a long conversation spans many tasks; what meets in one task is a letter for each of
its rows, no longer than the audit that is to be returned, and edits go back to the rows by blocks. Texts
equal to earlier ones are found by an aggregate and a join.

Defined cases: null turn comes first; null conversation id is one conversation; a null role or text is one
blank. Rows of one turn come in the order of role and text; equal rows are adjacent. A role with another
initial than s, u or a cannot be kept. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import bounded_arrow, materialize, shuffle_parts

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Macro codes in ASCII order.
CODES = ("D", "ID", "IID", "IIK", "IIR", "IK", "IR", "K", "R")
#: States of the pattern: nothing yet, after s, after u, after a. What an inserted turn leads to, and its role.
AFTER_INSERT = (2, 2, 3, 2)
ENDS = (0, 3)
#: A row's letter is A + 4 * class (s, u, a, other) + fault.
FAULTS = ("", "truncated", "duplicate", "blank")
BLOCK = 8192
LAST = 1 << 62
EMPTY = hashlib.sha256(b"").hexdigest()


def moves(kind: int) -> list[tuple[int, int, int, int]]:
    """(from, code, to, cost) of a row: what each state may become."""
    cls, fault = kind >> 2, FAULTS[kind & 3]
    out = []
    for start in range(4):
        for code, letters in enumerate(CODES):
            state, cost = start, 0
            for _ in letters[:-1]:
                state, cost = AFTER_INSERT[state], cost + INSERT
            last = letters[-1]
            if last == "D":
                out.append((start, code, state, cost + DELETE))
                continue
            if fault in ("blank", "duplicate"):
                continue
            cost += TRUNCATED if fault == "truncated" else 0
            if last == "R":
                out.append((start, code, AFTER_INSERT[state], cost + REROLE))
            elif cls == 0 and state == 0 or cls == 1 and state != 2 or cls == 2 and state == 2:
                out.append((start, code, cls + 1, cost + KEEP))
    return out


MOVES = [moves(k) for k in range(16)]
#: An entry of a layer: (cost above the least, rank), or None where the state can't be reached.
Layer = tuple[tuple[int, int] | None, ...]


def advance(layer: Layer, kind: int) -> tuple[Layer, int, tuple[int, ...]]:
    """(next layer, the cost of its least entry, for each state 9 * parent + code or -1)."""
    best: list[tuple[int, int, int, int] | None] = [None] * 4
    for start, code, to, cost in MOVES[kind]:
        if layer[start] is not None:
            held, rank = layer[start]
            way = (held + cost, rank, code, start)
            if best[to] is None or way < best[to]:
                best[to] = way
    least = min(x[0] for x in best if x)
    order = {key: k for k, key in enumerate(sorted({x[1:3] for x in best if x}))}
    return tuple((x[0] - least, order[x[1:3]]) if x else None for x in best), least, tuple(9 * x[3] + x[2] if x else -1 for x in best)


class Repairs:
    """Layers met so far and where each kind of row leads from them."""

    def __init__(self):
        start: Layer = ((0, 0), None, None, None)
        self.layers, self.numbers, self.next = [start], {start: 0}, {}

    def step(self, at: int, kind: int) -> tuple[int, int, tuple[int, ...]]:
        layer, cost, back = advance(self.layers[at], kind)
        number = self.numbers.setdefault(layer, len(self.layers))
        if number == len(self.layers):
            self.layers.append(layer)
        self.next[at, kind] = out = (number, cost, back)
        return out

    def solve(self, kinds: bytes) -> tuple[int, bytes, int]:
        """(cost, for each row the letter 48 + 9 * state before + code, 3 * last state + inserts at the end)."""
        at, cost, path, known = 0, 0, array("q"), self.next
        for k in kinds:
            path.append(at << 4 | k - 65)
            at, more, _ = known.get((at, k - 65)) or self.step(at, k - 65)
            cost += more
        ways = []
        for state, entry in enumerate(self.layers[at]):
            for run in range(3) if entry else ():
                to = state
                for _ in range(run):
                    to = AFTER_INSERT[to]
                if to in ENDS:
                    ways.append((entry[0] + INSERT * run, entry[1], run, state))
        more, _, run, state = min(ways)
        end, letters = 3 * state + run, bytearray(len(path))
        for i in range(len(path) - 1, -1, -1):
            way = known[path[i] >> 4, path[i] & 15][2][state]
            letters[i] = 48 + way
            state = way // 9
        return cost + more, bytes(letters), end


def inserted(state: int, run: int) -> list[str]:
    out = []
    for _ in range(run):
        state = AFTER_INSERT[state]
        out.append("user" if state == 2 else "assistant")
    return out


def rerole(state: int, run: int) -> str:
    return inserted(state, run + 1)[-1]


SPACE = r"\x20\x09-\x0D"


def _order(turn: Column) -> Column:
    return F.struct(turn.isNotNull().alias("known"), turn.alias("turn"))


def marked_rows(turns: DataFrame, parts: int) -> DataFrame:
    """(c, conv_id, turn, role, text, kind, pos): rows in order, each with its letter, a row for each copy."""
    name = F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))
    rows = turns.select("conv_id", name.alias("c"), "turn", F.coalesce(F.col("role"), F.lit(" ")).alias("role"), F.coalesce(F.col("text"), F.lit(" ")).alias("text"))
    rows = rows.groupBy("c", "conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("said", F.sha2(F.encode(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), "utf-8"), 256))
    first = rows.groupBy("c", "said").agg(F.min(_order(F.col("turn"))).alias("first"))
    rows = rows.join(first, ["c", "said"]).withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    seen = (F.col("copy") > 1) | (F.col("first") != _order(F.col("turn")))
    blank = ~F.col("text").rlike(rf"[^{SPACE}]")
    fault = F.when(blank, 3).when(seen, 2).when(~F.col("text").rlike(rf"[.!?][{SPACE}]*\z"), 1).otherwise(0)
    initial = F.substring("role", 1, 1)
    cls = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    keys = ["c", F.col("turn").isNotNull(), "turn", "role", "text", "copy"]
    placed = rows.withColumn("kind", F.char(F.lit(65) + 4 * cls + fault)).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return placed.select("c", "conv_id", "turn", "role", "text", "kind", F.monotonically_increasing_id().alias("pos"))


def repair(turns: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(a row for each conversation: c, conv_id, gaps, faults, illegal, cost, audit; the repaired turns: c, pos, k, role, text, edit)."""
    spark = turns.sparkSession
    bounded_arrow(spark)
    rows = materialize(marked_rows(turns, shuffle_parts(spark)), "turns")
    place = {"part": F.shiftright("pos", 33), "block": F.expr(f"(pos & {(1 << 33) - 1}) div {block}")}
    placed = rows.withColumns(place)
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "kind"))), lambda x: x["kind"]), "")
    blocks = placed.groupBy("c", "part", "block").agg(letters.alias("kinds"), F.min("pos").alias("base"))
    held = blocks.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("part", "block", "base", "kinds"))).alias("blocks"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairs = Repairs()
        fields = "blank duplicate truncated illegal cost".split()
        for batch in batches:
            out = []
            for c, parts in zip(batch.column("c").to_pylist(), batch.column("blocks").to_pylist(), strict=True):
                kinds = "".join(x["kinds"] for x in parts).encode()
                cost, ways, end = repairs.solve(kinds)
                audit = "".join(CODES[(x - 48) % 9] for x in ways) + "I" * (end % 3)
                cls, fault = kinds.translate(_CLASS), kinds.translate(_FAULT)
                illegal = len(kinds) - 1 - sum(_pairs(cls, p) for p in (b"su", b"ua", b"au"))
                pieces, at = [], 0
                for x in parts:
                    pieces.append({"part": x["part"], "block": x["block"], "base": x["base"], "ways": ways[at : at + len(x["kinds"])].decode()})
                    at += len(x["kinds"])
                out.append({"c": c, "blank": fault.count(b"3"), "duplicate": fault.count(b"2"), "truncated": fault.count(b"1"), "illegal": illegal, "cost": cost, "audit": audit, "end": end, "pieces": pieces})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("c", pa.string()), *((x, pa.int64()) for x in fields), ("audit", pa.string()), ("end", pa.int64()), ("pieces", _PIECES)]))

    solved = materialize(held.mapInArrow(solve, "c string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, end long, pieces array<struct<part:long,block:long,base:long,ways:string>>"), "audits")
    turn = F.col("turn").cast("decimal(20,0)")
    spread = rows.groupBy("c", "conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("c", "conv_id").agg(F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    summary = spread.join(solved.drop("pieces", "end"), "c")
    pieces = solved.select("c", F.explode("pieces").alias("x")).select("c", "x.*")
    edited = placed.join(pieces, ["c", "part", "block"]).withColumn("way", F.ascii(F.substr("ways", (F.col("pos") - F.col("base") + 1).cast("int"), F.lit(1))) - 47)
    turn_of = lambda role, text, edit: F.struct(role.alias("role"), text.alias("text"), F.lit(edit).alias("edit"))
    new = F.element_at(F.array(*(F.array(*(F.lit(r) for r in inserted(s, len(c) - 1))).cast("array<string>") for s in range(4) for c in CODES)), F.col("way"))
    role = F.element_at(F.array(*(F.lit(rerole(s, len(c) - 1) if c[-1] == "R" else None).cast("string") for s in range(4) for c in CODES)), F.col("way"))
    edit = F.element_at(F.array(*(F.lit(c[-1]) for _ in range(4) for c in CODES)), F.col("way"))
    own = F.when(edit == "K", F.array(turn_of(F.col("role"), F.col("text"), "K"))).when(edit == "R", F.array(turn_of(role, F.col("text"), "R"))).otherwise(F.array().cast("array<struct<role:string,text:string,edit:string>>"))
    made = F.concat(F.transform(new, lambda x: turn_of(x, F.lit(""), "I")), own)
    body = edited.select("c", "pos", F.posexplode(made).alias("k", "x")).select("c", "pos", "k", "x.*")
    ends = F.element_at(F.array(*(F.array(*(F.lit(r) for r in inserted(s, n))).cast("array<string>") for s in range(4) for n in range(3))), (F.col("end") + 1).cast("int"))
    tail = solved.select("c", F.lit(LAST).alias("pos"), F.posexplode(ends).alias("k", "role")).select("c", "pos", "k", "role", F.lit("").alias("text"), F.lit("I").alias("edit"))
    return summary, body.unionByName(tail)


_CLASS = bytes("suao"[(x - 65) >> 2].encode()[0] if 65 <= x < 81 else x for x in range(256))
_FAULT = bytes(48 + ((x - 65) & 3) if 65 <= x < 81 else x for x in range(256))
_PIECES = pa.list_(pa.struct([("part", pa.int64()), ("block", pa.int64()), ("base", pa.int64()), ("ways", pa.string())]))


def _pairs(text: bytes, pair: bytes) -> int:
    """Occurrences of two different letters in a row."""
    return text.count(pair)


def text_digests(repaired: DataFrame) -> DataFrame:
    """(c, repaired_sha256): of ``role:text`` joined by line feeds. A SHA-256 reads its text in order, so a conversation's lines stream through one task; none is held."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            done = []
            for c, line in zip(batch.column("c").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if c != at:
                    if at is not None:
                        done.append((at, state.hexdigest()))
                    at, state = c, hashlib.sha256(line.encode())
                else:
                    state.update(b"\n" + line.encode())
            if done:
                yield _digests(done)
        if at is not None:
            yield _digests([(at, state.hexdigest())])

    lines = repaired.select("c", "pos", "k", F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.repartition(shuffle_parts(repaired.sparkSession), "c").sortWithinPartitions("c", "pos", "k").select("c", "line").mapInArrow(digest, "c string, repaired_sha256 string")


def _digests(rows: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows, strict=True)], ["c", "repaired_sha256"])


def damage(turns: DataFrame) -> DataFrame:
    """Faults by crc32 of ``conv_id:turn`` modulo 20: 0 row lost, 1 text lost, 2 sentence ends lost, 3 row twice, 4 role user. Nulls are one blank."""
    blank = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), (F.crc32(F.encode(F.concat(blank("conv_id"), F.lit(":"), blank("turn")), "utf-8")) % 20).alias("harm"))
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.where("harm <> 0").select("conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "harm")
    return rows.withColumn("copy", F.explode(F.expr("sequence(1, if(harm = 3, 2, 1))"))).select("conv_id", "turn", "role", "text")


def digest(conversations: DataFrame) -> DataFrame:
    """One row for each conversation: its faults after ``damage``, the cheapest repair and its digest."""
    summary, repaired = repair(damage(conversations))
    found = summary.join(text_digests(repaired), "c", "left").drop("conv_id")
    name = F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))
    every = conversations.select("conv_id").distinct().withColumn("c", name).join(found, "c", "left")
    zeros = [F.coalesce(F.col(x), F.lit(0)).cast("long").alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY)).alias("repaired_sha256"))


ORACLE_SQL = r"""
WITH RECURSIVE crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) AS r(i))),
h AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: unicode(x)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS harm
  FROM conversations, crc
),
d AS (
  SELECT coalesce(conv_id::VARCHAR, ' ') AS c, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role, CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM h, range(CASE WHEN harm = 3 THEN 2 ELSE 1 END) WHERE harm <> 0
),
g AS (SELECT *, row_number() OVER (PARTITION BY c, turn, role, text) AS copy FROM d),
f AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, copy) AS i, role[1] AS initial,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY turn NULLS FIRST, copy) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault
  FROM g
),
runs(start, run, state) AS (VALUES (0, 0, 0), (0, 1, 2), (0, 2, 3), (1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 2), (2, 1, 3), (2, 2, 2), (3, 0, 3), (3, 1, 2), (3, 2, 3)),
edits(edit, initial, state, after_, cost) AS (
  SELECT 'D', NULL::VARCHAR, s, s, 4 FROM range(4) AS r(s) UNION ALL SELECT 'R', NULL::VARCHAR, s, CASE WHEN s = 2 THEN 3 ELSE 2 END, 3 FROM range(4) AS r(s)
  UNION ALL VALUES ('K', 's', 0, 1, 0), ('K', 'u', 0, 2, 0), ('K', 'u', 1, 2, 0), ('K', 'u', 3, 2, 0), ('K', 'a', 2, 3, 0)
),
moves AS (SELECT start, after_, repeat('I', run) || edit AS code, edit, initial, 3 * run + cost AS cost FROM runs JOIN edits USING (state)),
walk AS (
  SELECT c, 0::BIGINT AS i, 0::BIGINT AS state, {'cost': 0::BIGINT, 'audit': ''} AS way FROM (SELECT DISTINCT c FROM f)
  UNION ALL
  SELECT w.c, f.i, m.after_::BIGINT, min({'cost': (w.way.cost + m.cost + CASE WHEN m.edit <> 'D' AND f.fault = 'truncated' THEN 3 ELSE 0 END)::BIGINT, 'audit': w.way.audit || m.code})
  FROM walk AS w JOIN f ON f.c = w.c AND f.i = w.i + 1 JOIN moves AS m ON m.start = w.state AND (m.initial IS NULL OR m.initial = f.initial) AND (m.edit = 'D' OR f.fault NOT IN ('blank', 'duplicate'))
  GROUP BY w.c, f.i, m.after_
),
ends AS (
  SELECT c, min({'cost': (way.cost + 3 * run)::BIGINT, 'audit': way.audit || repeat('I', run)}) AS way
  FROM walk JOIN runs ON runs.start = walk.state AND runs.state IN (0, 3) WHERE i = (SELECT count(*) FROM f WHERE f.c = walk.c) GROUP BY c
),
letters AS (SELECT c, k, letter, sum((letter <> 'I')::INT) OVER w AS i, sum((letter <> 'D')::INT) OVER w AS o, sum((letter <> 'D')::INT) OVER (PARTITION BY c) % 2 AS odd FROM (SELECT c, k, way.audit[k] AS letter FROM ends, unnest(range(1, len(way.audit) + 1)) AS u(k)) WINDOW w AS (PARTITION BY c ORDER BY k)),
fixed AS (
  SELECT l.c, string_agg(CASE WHEN letter = 'K' THEN f.role WHEN (o - odd) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY k) AS text
  FROM letters AS l LEFT JOIN f ON f.c = l.c AND f.i = l.i WHERE letter <> 'D' GROUP BY l.c
),
tally AS (
  SELECT c, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND coalesce(before || initial, '') NOT IN ('su', 'ua', 'au')) AS illegal,
    coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps
  FROM (SELECT *, lag(initial) OVER (PARTITION BY c ORDER BY i) AS before FROM f) GROUP BY c
)
SELECT v.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(way.cost, 0) AS cost, coalesce(way.audit, '') AS audit, sha256(coalesce(x.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS v LEFT JOIN tally AS t ON t.c = coalesce(v.conv_id::VARCHAR, ' ') LEFT JOIN ends AS e ON e.c = t.c LEFT JOIN fixed AS x ON x.c = t.c
"""
