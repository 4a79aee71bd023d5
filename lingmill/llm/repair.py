"""Conversations brought back to the grammar (s?(ua)+)? at least cost: system, then user and assistant in turn.

A turn may be kept (K, free), given the role that the grammar wants next (R, 3), deleted (D, 4;
blank turns and repeats must go) and an empty turn may be inserted anywhere (I, 3); a truncated
turn that stays adds 3. Of the cheapest ways the one with the least letters in ASCII order is taken.

Turns are numbered in the order of (conv_id, turn, role, text) by a range sort and dealt, light, by
blocks of 64 numbers to hash partitions. There a recursive DuckDB query goes through all
conversations of a batch at once: each recursion takes the next turn of every piece, and keeps for
each state of the grammar, from each state that a piece may begin in, the least cost and its
letters. A conversation that spans blocks has its pieces composed by the same query, a piece a
recursion, 64 pieces at a time and as often as it takes, so that one of any length is no task of
its own. Equal-cost letters after the same turns are never one the beginning of the other (a longer
one would hold paid insertions more), so the least per state is enough. Only the repaired turns'
digest goes through one conversation in order: its rows stream through a task, none is held.

Defined cases: a null role, text, turn or conv_id reads as one space, null turns come first and
null conv_ids are one conversation; rows of one turn go by role, then text; equal rows are repeats;
a conversation without rows after damage is empty; initials other than s, u and a fit nowhere; an
empty table gives no rows; other columns are ignored, whatever their names; long texts are whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..stages import numbered
from .common import keep, map_arrow, scope, stage, table

#: Costs, and what the grammar takes in each state (0 empty, 1 after system, 2 after user, 3 after assistant).
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
TAKES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, DONE = range(4), (0, 3)
ROLES = {"u": "user", "a": "assistant"}
INITIALS, FAULTS = "sua", ("none", "blank", "duplicate", "truncated")
#: Turns of a block, and pieces that are composed at a time; turns of a DuckDB batch.
BLOCK, BATCH = 64, 16_384
#: Characters of a text that take part in the bounds of the range sort.
HEAD = 64


def wanted(state: int) -> str:
    """The initial, user or assistant, that the grammar takes next."""
    return next(r for r in "ua" if (state, r) in TAKES)


def moves() -> list[tuple[int, int, int, int, str]]:
    """(kind, state, next state, cost, letters) of what can be done with a turn; kind is 4 * initial + fault."""
    out = []
    for kind in range(4 * len(FAULTS)):
        initial, fault = (INITIALS + "?")[kind // 4], FAULTS[kind % 4]
        for start in STATES:
            out.append((kind, start, start, DELETE, "D"))
            if fault in ("blank", "duplicate"):
                continue
            stays = TRUNCATED if fault == "truncated" else 0
            # Two insertions in a row lead back, so before a turn that stays there is one at most.
            for letters, state, cost in (("", start, stays), ("I", TAKES[start, wanted(start)], stays + INSERT)):
                if (state, initial) in TAKES:
                    out.append((kind, start, TAKES[state, initial], cost, letters + "K"))
                out.append((kind, start, TAKES[state, wanted(state)], cost + REROLE, letters + "R"))
    return out


def endings() -> list[tuple[int, int, str]]:
    """(state, cost, letters) of the insertions that end a conversation."""
    out = []
    for start in STATES:
        state, letters = start, ""
        while state not in DONE:
            state, letters = TAKES[state, wanted(state)], letters + "I"
        out.append((start, INSERT * len(letters), letters))
    return out


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the rows after the damage that their numbers' CRC draws."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    plain = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    drawn = plain.withColumn("draw", F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20).filter("draw <> 0")
    role = F.when(F.col("draw") == 4, "user").otherwise(F.col("role"))
    left = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return drawn.select("conv_id", "turn", role.alias("role"), left.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def ordered(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with their number, at, in the order of conversations."""
    headed = rows.withColumn("head", F.left("text", F.lit(HEAD)))
    return stage(numbered(headed, ["conv_id", "turn", "role", "head"], "at", within=["text"]).select("conv_id", "at", "turn", "role", "text"), "turns")


def kinds(rows: DataFrame) -> DataFrame:
    """conv_id, at, kind of ordered rows."""
    same = F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.length("role").cast("string"), F.concat("role", "text")).cast("binary")))
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    own = F.when(last == "", 1).when(~last.isin(".", "!", "?"), 3).otherwise(0)
    initial = F.instr(F.lit(INITIALS), F.left("role", F.lit(1)))
    initial = F.when((F.col("role") == "") | (initial == 0), len(INITIALS)).otherwise(initial - 1)
    light = rows.select("conv_id", "at", initial.alias("initial"), own.alias("own"), same.alias("same"))
    twice = light.groupBy("same").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    fault = F.when((F.col("own") != 1) & (F.col("at") > F.col("first")), 2).otherwise(F.col("own"))
    return light.join(twice, "same", "left").select("conv_id", "at", (4 * F.col("initial") + fault).cast("int").alias("kind"))


#: step(piece, t, kind), move(kind, state, next, cost, letters), begin(piece, state): the least way through every piece.
RECURSION = """
WITH RECURSIVE best AS (
    SELECT piece, 0 AS t, state AS start, state, CAST(0 AS BIGINT) AS cost, '' AS letters FROM begin
    UNION ALL
    SELECT piece, t, start, state, least.cost, least.letters FROM (
        SELECT b.piece, b.t + 1 AS t, b.start, m.next AS state, min({'cost': b.cost + m.cost, 'letters': b.letters || m.letters}) AS least
        FROM best b JOIN step s ON s.piece = b.piece AND s.t = b.t JOIN move m ON m.kind = s.kind AND m.state = b.state
        GROUP BY ALL)
), last AS (SELECT piece, max(t) + 1 AS t FROM step GROUP BY piece)
SELECT best.piece, start, state, cost, letters FROM best JOIN last USING (piece, t)
"""
PIECE = "conv_id long, block long, start int, state int, cost long, letters string, marks string"


def _least(con, piece: np.ndarray, t: np.ndarray, kind: np.ndarray, move: pa.Table, begin: pa.Table) -> pa.Table:
    con.register("step", pa.table({"piece": piece, "t": t, "kind": kind}))
    con.register("move", move)
    con.register("begin", begin)
    got = con.sql(RECURSION).to_arrow_table()
    for name in ("step", "move", "begin"):
        con.unregister(name)
    return got


def _connection():
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})


def _whole(batches: Iterator[pa.RecordBatch], group, most: int) -> Iterator[pa.Table]:
    """The rows again, in tables of about most rows that end where a group does."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < most:
            continue
        all_rows = pa.Table.from_batches(held)
        names = group(all_rows)
        border = int(np.flatnonzero(names != names[-1])[-1]) + 1 if (names != names[-1]).any() else 0
        if border:
            yield all_rows.slice(0, border)
        rest = all_rows.slice(border)
        held, rows = rest.to_batches(), rest.num_rows
    if rows:
        yield pa.Table.from_batches(held)


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """A number column with nulls as a number of their own."""
    return column.fill_null(-(1 << 63)).to_numpy()


def _runs(*columns: np.ndarray) -> np.ndarray:
    """The number of the run of equal rows that each row lies in."""
    fresh = np.zeros(len(columns[0]), bool)
    for c in columns:
        fresh[1:] |= c[1:] != c[:-1]
    return np.cumsum(fresh)


def _out(got: pa.Table, conv: pa.ChunkedArray, block: np.ndarray, marks: list[str]) -> Iterator[pa.RecordBatch]:
    of = got["piece"].to_numpy()
    cols = [conv.take(pa.array(of)).combine_chunks(), pa.array(block[of]), *(got[c].combine_chunks().cast(k) for c, k in (("start", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("letters", pa.string()))), pa.array(marks, pa.string()).take(pa.array(of))]
    yield pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in PIECE.split(", ")])


def pieces(kinds_of: DataFrame) -> DataFrame:
    """The least ways through every part of a conversation that lies in one block, from and to every state."""
    columns = list(zip(*moves(), strict=True))
    known = pa.table(dict(zip(("kind", "state", "next", "cost", "letters"), columns, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _connection()
        for rows in _whole(batches, lambda r: r["block"].to_numpy(), BATCH):
            conv, block, kind = _numbers(rows["conv_id"]), rows["block"].to_numpy(), rows["kind"].to_numpy()
            piece = _runs(block, conv)
            first = np.flatnonzero(np.diff(piece, prepend=-1))
            # A piece inside its block begins a conversation; the first one of a block may go on with one.
            inner = np.diff(block[first], prepend=block[0] - 1) == 0
            begin = [(p, s) for p, inside in enumerate(inner.tolist()) for s in (STATES if not inside else (0,))]
            known_begin = pa.table({"piece": [p for p, _ in begin], "state": [s for _, s in begin]})
            got = _least(con, piece, np.arange(len(piece)) - first[piece], kind, known, known_begin)
            marks = "".join(f"{k:x}" for k in kind.tolist())
            ends = [*first[1:].tolist(), len(kind)]
            yield from _out(got, rows["conv_id"].take(pa.array(first)), block[first], [marks[a:b] for a, b in zip(first.tolist(), ends, strict=True)])

    dealt = kinds_of.withColumn("block", F.expr(f"at div {BLOCK}")).repartition("block").sortWithinPartitions("block", "at")
    return map_arrow(dealt.select("conv_id", "block", "kind"), run, PIECE)


def composed(parts: DataFrame, up: bool) -> DataFrame:
    """Pieces of a conversation as one; only those of one span of 64 blocks, where up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _connection()
        for rows in _whole(batches, lambda r: _runs(_numbers(r["conv_id"]), r["span"].to_numpy()), BATCH):
            conv, span, block = _numbers(rows["conv_id"]), rows["span"].to_numpy(), rows["block"].to_numpy()
            piece, kind = _runs(conv, span), _runs(conv, block)
            first_step = np.flatnonzero(np.diff(kind, prepend=-1))
            of = piece[first_step]
            begins = np.flatnonzero(np.diff(of, prepend=-1))
            move = pa.table({"kind": kind, "state": rows["start"], "next": rows["state"], "cost": rows["cost"], "letters": rows["letters"]})
            in_first = (np.arange(len(first_step)) == begins[of])[kind]
            begin = pa.table({"piece": piece[in_first], "state": rows["start"].filter(pa.array(in_first))}).group_by(["piece", "state"]).aggregate([])
            got = _least(con, of, np.arange(len(of)) - begins[of], np.arange(len(of)), move, begin)
            step_marks = rows["marks"].take(pa.array(first_step)).to_pylist()
            ends = [*begins[1:].tolist(), len(of)]
            at = first_step[begins]
            yield from _out(got, rows["conv_id"].take(pa.array(at)), span[at], ["".join(step_marks[a:b]) for a, b in zip(begins.tolist(), ends, strict=True)])

    span = F.expr(f"block div {BLOCK}") if up else F.lit(0).cast("long")
    dealt = parts.withColumn("span", span).repartition("conv_id", "span").sortWithinPartitions("conv_id", "span", "block", "start", "state")
    return map_arrow(dealt.select("conv_id", "span", "block", "start", "state", "cost", "letters", "marks"), run, PIECE)


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, cost, audit (letters) and marks (kinds, a hexadecimal digit a turn) of ordered rows."""
    parts = stage(pieces(kinds(rows)), "pieces")
    whole = []
    while True:
        many = parts.groupBy("conv_id").agg(F.min("block").alias("low"), F.max("block").alias("high")).filter("low < high")
        most = many.agg(F.max(F.col("high") - F.col("low") + 1)).first()[0]
        if most is None:
            break
        # A few pieces a conversation are composed at once, however they lie to the spans.
        up, many = most > BLOCK, many.withColumnRenamed("conv_id", "of")
        one = F.col("conv_id").eqNullSafe(F.col("of"))
        whole.append(parts.join(many, one, "left_anti"))
        parts = stage(composed(parts.join(many, one, "left_semi"), up), "composed")
    for other in whole:
        parts = parts.unionByName(other)
    end = F.create_map(*(F.lit(x) for state, _, letters in endings() for x in (state, letters)))[F.col("state")]
    least = F.min(F.struct((F.col("cost") + INSERT * F.length(end)).alias("cost"), F.concat("letters", end).alias("audit"), "marks")).alias("least")
    return parts.filter("start = 0").groupBy("conv_id").agg(least).select("conv_id", "least.*")


def steps(letters: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(letter, role, text) of a conversation's audit; deleted turns come with their letter."""
    state = 0
    for letter in letters:
        role, text = ("", "") if letter == "I" else next(turns)
        if letter != "D":
            role = role if letter == "K" else ROLES[wanted(state)]
            state = TAKES[state, role[0]]
        yield letter, role, text


def _streamed(rows: DataFrame, audit: DataFrame, convs: DataFrame) -> DataFrame:
    """Every conversation's audit, and its rows behind it in order, in hash partitions."""
    known = convs.join(audit.withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of")), "left")
    head = known.select("conv_id", F.lit(-1).cast("long").alias("at"), F.lit(None).cast("long").alias("turn"), F.coalesce("marks", F.lit("")).alias("role"), F.coalesce("audit", F.lit("")).alias("text"), F.coalesce("cost", F.lit(0)).alias("cost"))
    return head.unionByName(rows.withColumn("cost", F.lit(0).cast("long"))).repartition("conv_id").sortWithinPartitions("conv_id", "at")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """(conv_id, marks, audit, cost) and the rows (turn, role, text) of each conversation, read as they come."""

    def flat() -> Iterator[tuple]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield from zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True)

    rows, ahead = flat(), []

    def own() -> Iterator[tuple]:
        for row in rows:
            if row[1] < 0:
                ahead.append(row)
                return
            yield row[2:5]

    ahead += [r for r in (next(rows, None),) if r]
    while ahead:
        conv, _, _, marks, audit, cost = ahead.pop()
        mine = own()
        yield (conv, marks, audit, cost), mine
        for _ in mine:  # up to the next conversation's audit
            pass


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in REPORT.split(", ")]
    types = [pa.string() if "string" in f else pa.int64() for f in REPORT.split(", ")]
    out: list[tuple] = []
    for (conv, marks, audit, cost), rows in _conversations(batches):
        seen: list[int] = []  # least and last turn so far, and distinct ones

        def told(rows: Iterator[tuple] = rows, seen: list[int] = seen) -> Iterator[tuple[str, str]]:
            for turn, role, text in rows:
                if turn is not None and not seen:
                    seen += [turn, turn, 1]
                elif turn is not None and turn != seen[1]:
                    seen[1:] = [turn, seen[2] + 1]
                yield role, text

        digest, between = hashlib.sha256(), b""
        for letter, role, text in steps(audit, told()):
            if letter != "D":
                digest.update(between + f"{role}:{text}".encode())
                between = b"\n"
        fault = [int(m, 16) % 4 for m in marks]
        initials = "".join((INITIALS + "?")[int(m, 16) // 4] for m in marks)
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out.append((conv, seen[1] - seen[0] + 1 - seen[2] if seen else 0, *(fault.count(k) for k in (1, 2, 3)), illegal, cost, audit, digest.hexdigest()))
        if len(out) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


TURNS = "conv_id long, place long, action string, role string, text string"


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, types = [f.split()[0] for f in TURNS.split(", ")], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    out: list[tuple] = []
    for (conv, _, audit, _), rows in _conversations(batches):
        place = 0
        for letter, role, text in steps(audit, (r[1:] for r in rows)):
            out.append((conv, None if letter == "D" else place, letter, role, text))
            place += letter != "D"
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def _walked(turns: DataFrame, given: DataFrame, run, schema: str) -> DataFrame:
    rows = ordered(turns)
    with scope():
        told = audits(rows)
        streamed = _streamed(rows, told, given.select(F.col("conv_id").cast("long").alias("conv_id")).distinct())
        return keep(map_arrow(streamed, run, schema), "repaired")


def repair(turns: DataFrame) -> DataFrame:
    """conv_id, place, action (K, R, D, I), role, text: every turn of the repaired conversations; deleted ones have no place."""
    return _walked(turns, turns, _repaired, TURNS)


def report(turns: DataFrame, given: DataFrame) -> DataFrame:
    """What was wrong with each conversation of given, whose rows are now turns, and what the repair did."""
    return _walked(turns, given, _report, REPORT)


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return report(damaged(turns), turns)


SQL = r"""
WITH RECURSIVE tab AS (
    SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) AS tab
), named AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS name
    FROM conversations
), drawn AS (
    SELECT named.*, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(name) + 1), lambda i: CAST(ascii(substr(name, i, 1)) AS BIGINT))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) % 20 AS draw
    FROM named, tab
), damaged AS (
    SELECT conv, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role, CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE WHEN draw = 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM drawn WHERE draw <> 0
), placed AS (
    SELECT conv, turn, role, text, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS t, left(role, 1) AS initial, regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g') AS solid FROM damaged
), judged AS (
    SELECT *, CASE WHEN solid = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY t) > 1 THEN 'duplicate' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
        lag(initial) OVER (PARTITION BY conv ORDER BY t) AS previous
    FROM placed
), counted AS (
    SELECT conv, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (previous IS NOT NULL AND previous || initial NOT IN ('su', 'ua', 'au')) AS illegal
    FROM judged GROUP BY conv
), grammar(state, initial, next) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), ways AS (
    SELECT conv, 0 AS t, 0 AS state, 0 AS cost, '' AS audit, '' AS done FROM counted
    UNION ALL
    SELECT conv, t, state, w.cost, w.audit, w.done FROM (
        SELECT w.conv, j.t, o.state, min({'cost': w.cost + o.cost, 'audit': w.audit || o.audit, 'done': w.done || o.done}) AS w
        FROM ways w JOIN judged j ON j.conv = w.conv AND j.t = w.t + 1, LATERAL (
            SELECT w.state AS state, 4 AS cost, 'D' AS audit, '' AS done
            UNION ALL
            SELECT g.next, 3 * CAST(j.fault = 'truncated' AS INTEGER) + 3 * length(a.audit) + CASE WHEN k THEN 0 ELSE 3 END, a.audit || CASE WHEN k THEN 'K' ELSE 'R' END,
                a.done || CASE WHEN k THEN j.role WHEN g.initial = 'u' THEN 'user' ELSE 'assistant' END || ':' || j.text || chr(10)
            FROM (SELECT w.state AS state, '' AS audit, '' AS done
                UNION ALL SELECT next, 'I', CASE initial WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || chr(10) FROM grammar WHERE grammar.state = w.state AND initial <> 's') a
            JOIN grammar g ON g.state = a.state, (VALUES (true), (false)) kept(k)
            WHERE j.fault NOT IN ('blank', 'duplicate') AND CASE WHEN k THEN g.initial = j.initial ELSE g.initial <> 's' END
        ) o GROUP BY ALL)
), ended AS (
    SELECT c.conv, min(CASE w.state WHEN 1 THEN {'cost': w.cost + 6, 'audit': w.audit || 'II', 'done': w.done || 'user:' || chr(10) || 'assistant:' || chr(10)}
        WHEN 2 THEN {'cost': w.cost + 3, 'audit': w.audit || 'I', 'done': w.done || 'assistant:' || chr(10)} ELSE {'cost': w.cost, 'audit': w.audit, 'done': w.done} END) AS e
    FROM counted c JOIN ways w ON w.conv = c.conv AND w.t = c.n GROUP BY c.conv
)
SELECT g.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    CAST(coalesce(e.cost, 0) AS BIGINT) AS cost, coalesce(e.audit, '') AS audit, sha256(coalesce(left(e.done, length(e.done) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM named) g LEFT JOIN counted USING (conv) LEFT JOIN ended USING (conv)
"""
