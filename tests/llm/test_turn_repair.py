import hashlib
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.llm import turn_repair as R

SCHEMA = "conv_id long, turn long, role string, text string, p int, i string, kind long"
WORD = re.compile(r"[^\x20\x09-\x0D]")


def after_damage(rows):
    """Rows of each conversation after the damage, in order; dropped ones leave an empty list."""
    out = {}
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kept = out.setdefault(conv, [])
        c = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if c == 0:
            continue
        text = "" if c == 1 else re.sub("[.!?]", "", text) if c == 2 else text
        kept += [(turn, "user" if c == 4 else role, text)] * (2 if c == 3 else 1)
    for kept in out.values():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def brute(rows):
    """All edits tried from every row and state, comparing cost and then the audit itself."""
    seen, faults = set(), []
    for _, role, text in rows:
        marks = WORD.findall(text)
        faults.append("b" if not marks else "d" if (role, text) in seen else "" if marks[-1] in ".!?" else "t")
        seen.add((role, text))
    legal = {"": "su", "s": "u", "u": "a", "a": "u"}
    want = {"": "u", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(i, state, inserts):
        ways = []
        if i == len(rows) and state in ("", "a"):
            ways.append((0, "", ()))
        if inserts < 3:
            c, a, t = best(i, want[state], inserts + 1)
            ways.append((c + 3, "I" + a, (("user" if want[state] == "u" else "assistant", ""), *t)))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, t = best(i + 1, state, 0)
            ways.append((c + 4, "D" + a, t))
            if faults[i] not in ("b", "d"):
                more = 3 * (faults[i] == "t")
                if role[:1] and role[:1] in legal[state]:
                    c, a, t = best(i + 1, role[:1], 0)
                    ways.append((c + more, "K" + a, ((role, text), *t)))
                c, a, t = best(i + 1, want[state], 0)
                ways.append((c + 3 + more, "R" + a, (("user" if want[state] == "u" else "assistant", text), *t)))
        return min(ways, key=lambda w: w[:2]) if ways else (10**9, "", ())

    for i in range(len(rows), -1, -1):  # from the end, so that no call nests deeply
        for state in ("", "s", "u", "a"):
            best(i, state, 0)
    cost, audit, out = best(0, "", 0)
    turns = [r[0] for r in rows if r[0] is not None]
    initials = [r[1][:1] for r in rows]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, digest)


def made(n, longest=9, seed=0):
    """Conversations of all kinds, some with odd rows."""
    import random

    r = random.Random(seed)
    rows = []
    for conv in range(n):
        turn = 0
        for _ in range(r.randint(1, longest)):
            turn += r.choice([0, 1, 1, 1, 2, 5])
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = r.choice(["One.", "Two!", "cut off", "", " \t", None, "Why?", f"n{turn}.", "Ends. \n", "ab\x00c"])
            rows.append((conv if conv else None, None if r.random() < 0.05 else turn, role, text, 1, "i", 2))
    return rows


def results(df):
    return {r.conv_id: tuple(r[c] for c in R.COLUMNS[1:]) for r in df.collect()}


def test_equals_brute_force(spark):
    rows = made(150)
    got = results(R.repaired(spark.createDataFrame(rows, SCHEMA)))
    assert got == {c: brute(tuple(v)) for c, v in after_damage(rows).items()}


def test_one_conversation_over_many_partitions(spark):
    """A conversation that holds most rows lies in every partition and is solved in pieces."""
    import random

    r = random.Random(4)
    rows = [(7, t // 2, r.choice(["user", "assistant", "tool"]), r.choice(["A.", "B", f"t{t}!", " "]), 1, "i", 2) for t in range(900)]
    rows += [(7, None, "user", "the same row.", 1, "i", 2)] * 300 + made(20, seed=3)
    df = spark.createDataFrame(rows, SCHEMA)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        got = results(R.repaired(df))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == {c: brute(tuple(v)) for c, v in after_damage(rows).items()}


def test_pieces_equal_whole():
    """Tables of pieces, of any length, lead to the states of the whole."""
    import random

    r = random.Random(1)
    for _ in range(300):
        kinds = bytes(r.randrange(16) for _ in range(r.randint(1, 40)))
        whole = R.best_states(kinds)
        cuts = sorted({0, len(kinds), *[r.randint(0, len(kinds)) for _ in range(3)]})
        pieces = R.Crossing([R.ROWS.table(kinds[a:b]) for a, b in zip(cuts, cuts[1:])])
        steps = range(len(cuts) - 1)
        assert [whole[c] for c in cuts] == pieces.states(steps, R.EMPTY, pieces.final(steps))


def test_long_conversation_is_linear():
    kinds = bytes([1, 2, 9, 4] * 50_000)
    states = R.best_states(kinds)
    assert len(states) == len(kinds) + 1


def test_empty_table_and_dropped_rows(spark):
    assert R.repaired(spark.createDataFrame([], SCHEMA)).count() == 0
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    got = results(R.repaired(spark.createDataFrame([(gone, 0, "user", "x", 0, "", 0)], SCHEMA)))
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_registered_query(spark, sf):
    from trackloom.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = results(QUERIES["op13_conversation_repair"](spark, sf))
    assert got == {c: brute(tuple(v)) for c, v in after_damage(rows).items()}
