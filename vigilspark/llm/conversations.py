"""Repair of conversation structure by a forward Viterbi pass over four grammar states.

A conversation is good if the first letters of its roles read ``(s?(ua)+)?``.
Rows are kept (cost 0), given another role (3), deleted (4) or inserted (3); the
states of the grammar are START, SYSTEM, USER and ASSISTANT, and every state
carries the least (cost, audit string) that reaches it.  After each row inserts
close the layer: at most two in a row, as a third would come back to a state
already reached.  Two audits of equal cost are never prefixes of each other (one
would hold more inserts), so the least of each state is the least of the whole.

Rows are range partitioned by (conversation, turn) and sorted, so each
conversation is read as a stream.  What lies within one partition and within
``PIECE_ROWS`` is repaired there.  Longer conversations and those cut by a
partition border leave as *pieces* of bounded size: a piece is a 4 x 4 table of
(cost, audit) between its entry and exit states, the tables of one conversation
are folded in order, and each piece then writes its repaired text.  So a
conversation with a third of all rows is worked on by many tasks; only its audit,
one letter a row, and its running digest pass one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import groupby

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilspark.llm.common import by_row, small_batches
from vigilspark.storage import materialize

START, SYSTEM, USER, ASSISTANT = range(4)
RETAG, DELETE, INSERT, CUT = 3, 4, 3, 3
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
SPACE = " \t\n\x0b\x0c\r"
FAR = (1 << 60, "")

#: A conversation beyond so many rows or characters is worked on in pieces.
PIECE_ROWS, PIECE_CHARS = 2_000, 2_000_000

Layer = list[tuple[int, str]]


def plus(state: tuple[int, str], cost: int, letters: str) -> tuple[int, str]:
    return FAR if state[0] >= FAR[0] else (state[0] + cost, state[1] + letters)


def closed(layer: Layer) -> Layer:
    """The layer with up to two inserted turns after it."""
    start, system, user, assistant = layer
    user = min(user, plus(start, INSERT, "I"), plus(system, INSERT, "I"), plus(assistant, INSERT, "I"))
    return [start, system, user, min(assistant, plus(user, INSERT, "I"))]


def step(layer: Layer, initial: str, fault: str | None) -> Layer:
    """The closed layer after one more row."""
    start, system, user, assistant = layer
    out = [plus(s, DELETE, "D") for s in layer]
    if fault in (None, "truncated"):
        extra = CUT if fault else 0
        if initial == "s":
            out[SYSTEM] = min(out[SYSTEM], plus(start, extra, "K"))
        before = min(plus(s, 0, "") for s in (start, system, assistant))
        keep, retag = (extra, "K"), (extra + RETAG, "R")
        out[USER] = min(out[USER], plus(before, *(keep if initial == "u" else retag)))
        out[ASSISTANT] = min(out[ASSISTANT], plus(user, *(keep if initial == "a" else retag)))
    return closed(out)


def entered(state: int) -> Layer:
    return [(0, "") if s == state else FAR for s in range(4)]


def run(layer: Layer, faults: list[tuple[str, str | None]]) -> Layer:
    for initial, fault in faults:
        layer = step(layer, initial, fault)
    return layer


def best(layer: Layer) -> tuple[int, str]:
    return min(layer[START], layer[ASSISTANT])


def replay(audit: str, rows: list[tuple[str, str]], state: int) -> Iterator[tuple[str, str]]:
    """The repaired (role, text) rows that an audit makes from ``state`` on."""
    source = iter(rows)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(source)
        if letter == "D":
            continue
        state = SYSTEM if letter == "K" and role[:1] == "s" else ASSISTANT if state == USER else USER
        yield (role if letter == "K" else ROLE_OF[state]), text


def own_fault(text: str) -> str | None:
    """The fault that a row shows by itself."""
    last = text.rstrip(SPACE)[-1:]
    return "blank" if not last else None if last in ".!?" else "truncated"


def digest(role: str, text: str) -> bytes:
    return xxhash.xxh3_128_digest(f"{len(role)}:{role}{text}".encode())


def tally(turns: list[int | None], initials: list[str], faults: list[str | None]) -> tuple:
    """What pieces of a conversation add up: rows, faults by kind, illegal neighbours, ends and turns."""
    kinds = [sum(f == k for f in faults) for k in ("blank", "duplicate", "truncated")]
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
    known = [t for t in turns if t is not None]
    ends = (initials[0], initials[-1]) if initials else (None, None)
    return len(initials), *kinds, illegal, *ends, min(known, default=None), max(known, default=None), len(set(known))


def added(a: tuple | None, b: tuple) -> tuple:
    """The tally of two consecutive pieces."""
    if not a or not a[0]:
        return b
    if not b[0]:
        return a
    sums = [x + y for x, y in zip(a[:5], b[:5], strict=True)]
    sums[4] += a[6] + b[5] not in LEGAL
    known = [x for x in (a, b) if x[7] is not None]
    low, high = min((x[7] for x in known), default=None), max((x[8] for x in known), default=None)
    return *sums, a[5], b[6], low, high, a[9] + b[9] - (a[8] is not None and a[8] == b[7])


def summary(t: tuple) -> tuple:
    """(gaps, blank, duplicate, truncated, illegal) of a tally."""
    return (0 if t[7] is None else t[8] - t[7] + 1 - t[9]), *t[1:5]


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_SUMMARY = [(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string())]
_EMPTY = hashlib.sha256().hexdigest()


def _pieces_or_results(source: Iterator[tuple], piece_rows: int, piece_chars: int) -> Iterator[tuple]:
    """Sorted rows (conv, turn, role, text, live) to results of whole conversations and rows of open pieces."""
    part = TaskContext.get().partitionId() << 32
    piece = 0

    def rows_of(conv, rows):
        nonlocal piece
        for pos, (turn, role, text, live) in enumerate(rows):
            mark = digest(role, text) if live and own_fault(text) != "blank" else None
            yield len(text or "") + 40, conv, *[None] * 8, part + piece, pos, turn, role, text, live, mark
        piece += 1

    def result(conv, rows):
        there = [(t, r, x) for t, r, x, live in rows if live]
        faults, seen = [], set()
        for _, role, text in there:
            fault = own_fault(text)
            if fault != "blank":
                mark = digest(role, text)
                fault = "duplicate" if mark in seen else fault
                seen.add(mark)
            faults.append(fault)
        initials = [r[:1] for _, r, _ in there]
        cost, audit = best(run(closed(entered(START)), list(zip(initials, faults, strict=True))))
        text = "\n".join(f"{r}:{x}" for r, x in replay(audit, [(r, x) for _, r, x in there], START))
        sums = summary(tally([t for t, *_ in there], initials, faults))
        yield len(audit) + 100, conv, *sums, cost, audit, hashlib.sha256(text.encode()).hexdigest(), *[None] * 7

    first, buffered = True, None
    for conv, rows in groupby(source, key=lambda r: r[0]):
        if buffered:  # another conversation follows, so this one ends here
            yield from result(*buffered)
        buffered, size, cut = (conv, []), 0, first
        for _, *row in rows:
            buffered[1].append(row)
            size += len(row[2] or "")
            if len(buffered[1]) >= piece_rows or size >= piece_chars:
                yield from rows_of(*buffered)
                buffered, size, cut = (conv, []), 0, True
        if cut:
            yield from rows_of(*buffered)
            buffered = None
        first = False
    if buffered:  # the next partition may go on with it
        yield from rows_of(*buffered)


_TALLY = [("rows", pa.int64())] + [(n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal")]
_TALLY += [("first", pa.string()), ("last", pa.string())] + [(n, pa.int64()) for n in ("low", "high", "turns")]
_KEY = [("nil", pa.bool_()), ("conv", pa.int64())]


def _tables(source: Iterator[tuple]) -> Iterator[tuple]:
    """Sorted rows of pieces to one 4 x 4 table of (cost, audit) and one tally for each piece."""
    for key, rows in groupby(source, key=lambda r: r[:3]):
        there = [(turn, role, own_fault(text), again) for *_, turn, role, text, live, again in rows if live]
        faults = ["duplicate" if again and fault != "blank" else fault for _, _, fault, again in there]
        initials = [role[:1] for _, role, *_ in there]
        table = [cell for s in range(4) for cell in run(entered(s), list(zip(initials, faults, strict=True)))]
        yield 20 * len(faults) + 100, *key, *tally([t for t, *_ in there], initials, faults), [c for c, _ in table], [a for _, a in table]


def _folded(source: Iterator[tuple]) -> Iterator[tuple]:
    """The tables of each conversation in order to its result and to the way through each piece."""
    for (nil, conv), pieces in groupby(source, key=lambda r: r[:2]):
        layer, total, ways = closed(entered(START)), None, []
        for _, _, piece, *counts, costs, audits in pieces:
            total = added(total, tuple(counts))
            found, came = [], []
            for exit in range(4):
                reach = [(layer[s][0] + costs[4 * s + exit], s) for s in range(4)]
                least = min(cost for cost, _ in reach)
                if least >= FAR[0]:
                    found.append(FAR)
                    came.append((START, ""))
                    continue
                tied = [(layer[s][1] + audits[4 * s + exit], s) for cost, s in reach if cost == least]
                audit, s = min(tied)
                found.append((least, audit))
                # what was inserted before the first row goes with the first piece
                came.append((s, audits[4 * s + exit]) if ways else (START, audit))
            layer = found
            ways.append((piece, came))
        cost, audit = best(layer)
        yield len(audit) + 100, nil, conv, *summary(total), cost, audit, None, None
        state = START if (cost, audit) == layer[START] else ASSISTANT
        for piece, came in reversed(ways):
            state, letters = came[state]
            yield len(letters) + 40, nil, conv, *[None] * 6, letters, piece, state


def _texts(source: Iterator[tuple]) -> Iterator[tuple]:
    """Sorted rows of pieces with their way to the repaired lines of each piece, every line with its newline."""
    for key, rows in groupby(source, key=lambda r: r[:3]):
        rows = list(rows)
        *_, letters, state = rows[0]
        there = [(role, text) for *_, role, text, live, _, _ in rows if live]
        lines = "".join(f"{r}:{x}\n" for r, x in replay(letters, there, state)).encode()
        yield len(lines) + 40, *key, lines


def _digests(source: Iterator[tuple]) -> Iterator[tuple]:
    """The repaired pieces of each conversation in order to one digest, as a stream."""
    for (nil, conv), pieces in groupby(source, key=lambda r: r[:2]):
        running, held = hashlib.sha256(), b""
        for *_, lines in pieces:
            if lines:
                running.update(held)
                held = lines
        running.update(held[:-1])  # no newline after the last line
        yield 100, nil, conv, running.hexdigest()


def _by_key(df: DataFrame, *order: str) -> DataFrame:
    """Rows of one (nil, conv[, piece]) in one task, in order."""
    keys = [c for c in ("nil", "conv", "piece") if c not in order]
    return df.repartition(*keys).sortWithinPartitions(*keys, *order)


def repair_conversations(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    live: Column | None = None, piece_rows: int = PIECE_ROWS, piece_chars: int = PIECE_CHARS,
) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)``, a row for each conversation.

    Rows are ordered by turn, null turns first, and rows of one turn by role and
    text.  ``live`` tells the rows that take part; a conversation without any has
    zeros, an empty audit and the digest of the empty string, as one whose rows
    are all deleted.  Null roles and texts are one space, a null conversation id is
    a conversation of its own.  A role without a first letter of the grammar, also
    an empty one, can only be renamed or deleted.  Repeated rows are duplicates.
    Other columns are not read; an empty table gives an empty result.

    Faults, the first counts: blank (nothing but ``[\\x20\\x09-\\x0D]``), duplicate
    (role and text seen earlier, by 128-bit hash), truncated (the last other
    character is none of ``.!?``).  ``audit`` holds K, R, D and I, the least string
    of the least cost; ``repaired_sha256`` is of ``role:text`` lines.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    plain = small_batches(rows).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        space(role_col).alias("role"), space(text_col).alias("text"), (F.lit(True) if live is None else live).alias("live"),
    )
    # prefixes only choose the partition: they agree with the order of whole roles and texts
    short = F.substring("role", 1, 64)
    start = F.when(F.length("role") < 64, F.substring("text", 1, 64)).otherwise("")
    ordered = plain.repartitionByRange("conv", "turn", short, start).sortWithinPartitions("conv", "turn", "role", "text")
    sides = f"conv long, {SUMMARY}, repaired_sha256 string, piece long, pos int, turn long, role string, text string, live boolean, mark binary"
    schema = pa.schema(
        [("conv", pa.int64()), *_SUMMARY, ("repaired_sha256", pa.string()), ("piece", pa.int64()), ("pos", pa.int32()), ("turn", pa.int64())]
        + [("role", pa.string()), ("text", pa.string()), ("live", pa.bool_()), ("mark", pa.binary())]
    )
    first = materialize(ordered.mapInArrow(by_row(schema, partial(_pieces_or_results, piece_rows=piece_rows, piece_chars=piece_chars)), sides), "conversations")
    names = [n for n, _ in _SUMMARY]
    whole = first.where("piece is null").select("conv", *names, "repaired_sha256")

    cut = first.where("piece is not null").select(
        F.col("conv").isNull().alias("nil"), F.coalesce("conv", F.lit(0)).alias("conv"), "piece", "pos", "turn", "role", "text", "live", "mark"
    )
    at = F.struct("piece", "pos")
    earliest = cut.where("mark is not null").groupBy("nil", "conv", "mark").agg(F.min(at).alias("at"), F.count("*").alias("n")).where("n > 1")
    again = F.coalesce(at > F.col("at"), F.lit(False)).alias("again")
    marked = materialize(
        cut.join(earliest, ["nil", "conv", "mark"], "left").select("nil", "conv", "piece", "pos", "turn", "role", "text", "live", again), "pieces"
    )
    tables = _by_key(marked, "pos").select("nil", "conv", "piece", "turn", "role", "text", "live", "again").mapInArrow(
        by_row(pa.schema([*_KEY, ("piece", pa.int64()), *_TALLY, ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))]), _tables),
        "nil boolean, conv long, piece long, rows long, blank long, duplicate long, truncated long, illegal long, first string, last string, "
        "low long, high long, turns long, costs array<long>, audits array<string>",
    )
    folded = materialize(
        _by_key(tables, "piece").mapInArrow(
            by_row(pa.schema([*_KEY, *_SUMMARY, ("piece", pa.int64()), ("state", pa.int32())]), _folded),
            f"nil boolean, conv long, {SUMMARY}, piece long, state int",
        ),
        "folded",
    )
    ways = folded.where("piece is not null").select("nil", "conv", "piece", F.col("audit").alias("letters"), "state")
    placed = _by_key(marked.join(ways, ["nil", "conv", "piece"]), "pos").select("nil", "conv", "piece", "role", "text", "live", "letters", "state")
    lines = placed.mapInArrow(by_row(pa.schema([*_KEY, ("piece", pa.int64()), ("lines", pa.binary())]), _texts), "nil boolean, conv long, piece long, lines binary")
    digests = _by_key(lines, "piece").mapInArrow(by_row(pa.schema([*_KEY, ("repaired_sha256", pa.string())]), _digests), "nil boolean, conv long, repaired_sha256 string")
    mended = folded.where("piece is null").join(digests, ["nil", "conv"], "left").select(
        F.when(~F.col("nil"), F.col("conv")).alias("conv"), *names, F.coalesce("repaired_sha256", F.lit(_EMPTY)).alias("repaired_sha256")
    )
    return whole.unionByName(mended).withColumnRenamed("conv", "conv_id")


def damaged(conversations: DataFrame) -> tuple[DataFrame, Column]:
    """Conversations with reproducible damage, and the column that tells which rows are left.

    By the remainder of crc32 of ``conv_id:turn`` (null: one space) and 20: 0 drops
    a row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 sets its role to user.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(
        "conv_id", "turn", part("role").alias("role"), part("text").alias("text"), (F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20).alias("kind")
    )
    kind = F.col("kind")
    hurt = rows.select(
        "conv_id", "turn", "kind", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    return hurt, kind != 0
