"""Conversation repair against a search over all edits, and on long and odd conversations."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from lingmill.llm import repair

SOLID = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if draw == 0:
            continue
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        out += [(conv, turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    return out


def faults(turns):
    seen, out = set(), []
    for role, text in turns:
        solid = SOLID.findall(text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(turns):
    """(cost, audit, repaired) by best-first search over edit sequences; written roles are checked by a pattern alone."""
    fault = faults(turns)
    heap, done = [(0, "", 0, "", "")], set()
    fits = re.compile("s?(ua)*u?")
    while heap:
        cost, audit, at, roles, written = heapq.heappop(heap)
        if (at, roles) in done:
            continue
        done.add((at, roles))
        if at == len(turns) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, written
        after = [(3, "I", at, r, r + ":") for r in ("user", "assistant")] if audit[-2:] != "II" else []
        if at < len(turns):
            role, text = turns[at]
            after.append((4, "D", at + 1, "", ""))
            if fault[at] not in ("blank", "duplicate"):
                late = 3 * (fault[at] == "truncated")
                after += [(late, "K", at + 1, role, f"{role}:{text}"), *((late + 3, "R", at + 1, r, f"{r}:{text}") for r in ("user", "assistant"))]
        for extra, letter, to, role, line in after:
            grown = roles + role[:1]
            if (letter == "D" or role[:1]) and fits.fullmatch(grown):
                heapq.heappush(heap, (cost + extra, audit + letter, to, grown, written + "\n" + line if letter != "D" and written else written + line))


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))


def plainly(rows):
    left = ordered(damage(rows))
    out = []
    for conv in {r[0] for r in rows}:
        mine = [r for r in left if r[0] == conv]
        turns = [r[2:] for r in mine]
        known = {r[1] for r in mine if r[1] is not None}
        initials = [r[:1] for r, _ in turns]
        fault = faults(turns)
        cost, audit, written = cheapest(turns)
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out.append((conv, max(known) - min(known) + 1 - len(known) if known else 0, *(fault.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(written.encode()).hexdigest()))
    return out


def made(seed, n):
    pick = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "unknown"]
    texts = ["yes.", "no!", "cut off", "", " \t", None, "really? ", "é.", "\x0b."]
    return [(pick.choice([*range(n // 5), None]), pick.choice([*range(9), None]), pick.choice(roles), pick.choice(texts)) for _ in range(n)]


def run(spark, folder, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.withColumns({c: F.lit("e") for c in ("at", "block", "kind", "same", "draw", "copy", "of", "head", "span")}).write.parquet(f"{folder}/conversations.parquet")
    return sorted(map(tuple, repair.op12_repair(spark, str(folder)).collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    return made(5, 400)


def test_equals_search_over_all_edits(spark, tmp_path, rows):
    assert run(spark, tmp_path, rows) == sorted(plainly(rows), key=repr)


def test_sql_equals_search_too(rows):
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    rel = con.execute(repair.SQL)
    at = [[d[0] for d in rel.description].index(f.split()[0]) for f in repair.REPORT.split(", ")]
    assert sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr) == sorted(plainly(rows), key=repr)


def least_by_turn(turns):
    """(cost, audit) of a long conversation, turn by turn."""
    best = {0: (0, "")}
    for (role, _), fault in zip(turns, faults(turns), strict=True):
        kind = 4 * (repair.INITIALS + "?").index(role[:1] if role[:1] in ("s", "u", "a") else "?") + repair.FAULTS.index(fault or "none")
        after = {}
        for k, state, to, cost, letters in repair.moves():
            if k == kind and state in best:
                after.setdefault(to, []).append((best[state][0] + cost, best[state][1] + letters))
        best = {s: min(ways) for s, ways in after.items()}
    return min((best[s][0] + c, best[s][1] + letters) for s, c, letters in repair.endings() if s in best)


def test_long_conversation_is_composed_of_pieces(spark, tmp_path):
    """Far more turns than 64 blocks of 64, among short conversations that cross borders."""
    pick = random.Random(3)
    long = [(7, t, pick.choice(["user", "assistant", "assistant", "user", "system"]), f"text {t if pick.random() < 0.9 else 3}" + pick.choice(["", ".", "!"])) for t in range(9000)]
    short = [(c, t, pick.choice(["user", "assistant"]), f"{c} {t}.") for c in [*range(6), *range(8, 400)] for t in range(pick.randint(1, 9))]
    got = {r[0]: r for r in run(spark, tmp_path, long + short)}
    turns = [r[2:] for r in ordered(damage(long))]
    cost, audit = least_by_turn(turns)
    assert got[7][6:8] == (cost, audit)
    lines = [f"{role}:{text}" for letter, role, text in repair.steps(audit, iter(turns)) if letter != "D"]
    assert got[7][8] == hashlib.sha256("\n".join(lines).encode()).hexdigest()
    for want in plainly(short):
        assert got[want[0]] == want


def test_repaired_turns_follow_the_grammar(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = repair.repair(repair.damaged(df)).collect()
    by = {}
    for r in sorted((r for r in turns if r.place is not None), key=lambda r: (r.conv_id is None, r.conv_id or 0, r.place)):
        by.setdefault(r.conv_id, []).append(r)
    assert by and all(re.fullmatch("s?(ua)+", "".join(r.role[0] for r in part)) and [r.place for r in part] == [*range(len(part))] for part in by.values())
    assert {r.action for r in turns} == set("KRDI")


def test_empty_table_and_conversations_that_vanish(spark, tmp_path):
    assert run(spark, tmp_path / "none", []) == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert run(spark, tmp_path / "gone", [(gone, 0, "user", "hi.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
