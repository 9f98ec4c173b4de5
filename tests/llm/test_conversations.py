"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from vigilspark.llm import conversations as C
from vigilspark.llm import queries

SPACE = " \t\n\x0b\x0c\r"
COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Cheapest-first search over (row, roles so far), the plain way; ``rows``: (turn, role, text) in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        plain = text.strip(SPACE)
        faults.append("blank" if not plain else "duplicate" if (role, text) in seen else "truncated" if plain[-1] not in ".!?" else None)
        seen.add((role, text))
    grammar = re.compile(r"(s?(ua)+)?")
    prefix = re.compile(r"s?(ua)*u?")
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, k, roles, out = heapq.heappop(heap)
        tail = roles[-1:]
        if (k, tail) in done:
            continue
        done.add((k, tail))
        if k == len(rows) and grammar.fullmatch(roles):
            break
        def put(more, letter, role, text, ahead):
            if letter == "D":
                heapq.heappush(heap, (cost + more, audit + letter, k + ahead, roles, out))
            elif role[:1] and prefix.fullmatch(roles + role[:1]):
                heapq.heappush(heap, (cost + more, audit + letter, k + ahead, roles + role[:1], (*out, f"{role}:{text}")))
        for role in ("user", "assistant"):
            put(3, "I", role, "", 0)
        if k < len(rows):
            _, role, text = rows[k]
            put(4, "D", "", "", 1)
            if faults[k] in (None, "truncated"):
                extra = 3 if faults[k] else 0
                put(extra, "K", role, text, 1)
                for new in ("user", "assistant"):
                    put(extra + 3, "R", new, text, 1)
    turns = [t for t, *_ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest(),
    )


def expected(rows, damage=False):
    """``rows``: (conv, turn, role, text), any order."""
    held = {}
    for conv, turn, role, text in rows:
        kept = held.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else None
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        kept += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    return {conv: brute(sorted(kept, key=order)) for conv, kept in held.items()}


def got(df):
    rows = [tuple(r[c] for c in COLUMNS) for r in df.collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def some_rows(seed, conversations=60):
    rng, rows = random.Random(seed), []
    for conv in range(conversations):
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            text = rng.choice(["Yes.", "Yes.", "No", " \t", "", None, "Why?\n", "Long text that stops", "Été!", "ok . "])
            rows.append((conv, rng.choice([turn, turn, turn + 3, None]), role, text))
    return rows + [(None, 1, "user", "a."), (None, 2, "assistant", "b."), (7, 10**12, "user", "far.")]


def test_repair_equals_search(spark):
    rows = some_rows(1)
    want = expected(rows)
    assert got(C.repair_conversations(spark.createDataFrame(rows, SCHEMA))) == want
    assert {len(r[5:]) for r in want.values()} == {3} and len({r[6] for r in want.values()}) > 20


@pytest.mark.parametrize("rows_a_piece", [1, 3])
def test_pieces_give_the_same(spark, rows_a_piece):
    """Pieces of one or a few rows, and a hot conversation cut by partition borders."""
    rng = random.Random(2)
    hot = [(5000, k // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", f"t{k}.", ""])) for k in range(120)]
    rows = some_rows(3, 20) + hot
    want = expected(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    for table in (df, df.repartition(7)):
        found = got(C.repair_conversations(table, piece_rows=rows_a_piece))
        assert {k: (found[k], v) for k, v in want.items() if found[k] != v} == {}


def test_awkward_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.repair_conversations(empty).count() == 0
    rows = [(1, 1, "user", "x" * 300_000 + "."), (1, 2, "assistant", "y."), (2, None, None, None), (3, 1, "user", "a."), (3, 1, "user", "a.")]
    wide = spark.createDataFrame([(*r, "z", 5, "q") for r in rows], SCHEMA + ", audit string, cost int, piece string")
    assert got(C.repair_conversations(wide)) == expected(rows)
    nothing = C.repair_conversations(spark.createDataFrame(rows, SCHEMA), live=__import__("pyspark").sql.functions.lit(False))
    blank = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got(nothing) == {1: blank, 2: blank, 3: blank}


def test_prefixes_of_equal_cost_never_tie():
    rng = random.Random(4)
    for _ in range(200):
        rows = [(rng.choice(["s", "u", "a", "t", ""]), rng.choice([None, None, "truncated", "blank", "duplicate"])) for _ in range(rng.randrange(9))]
        cut = rng.randrange(len(rows) + 1)
        whole = C.run(C.closed(C.entered(C.START)), rows)
        left = C.run(C.closed(C.entered(C.START)), rows[:cut])
        tables = [C.run(C.entered(s), rows[cut:]) for s in range(4)]
        joined = [min((left[s][0] + tables[s][e][0], left[s][1] + tables[s][e][1]) for s in range(4)) for e in range(4)]
        assert [w for w in whole if w[0] < C.FAR[0]] == [j for j in joined if j[0] < C.FAR[0]]


def test_op11_equals_search(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = expected(rows, damage=True)
    assert got(queries.QUERIES["op11_conversation_repair"](spark, sf)) == want
    assert sum(r[5] > 0 for r in want.values()) > 3
