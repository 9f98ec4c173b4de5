"""Periodic runs of words, found by power-of-two naming.

Karp, Miller and Rosenberg: the name of a stretch of 2^k words is the pair of the
names of its halves, numbered in order.  Levels are built until no name repeats,
so the longest common extension of two positions is read off the names from the
highest level down, each level at most once.

A run of period p and at least ``least`` words matches itself p words later over
at least ``least`` - p positions in a row, so a grid of that step hits each run;
grid points whose word equals the word p later are extended to both sides.  The
grids of all periods have n log n points.  No hashes and no suffix order.

Texts of an Arrow batch are joined in blocks, a separate word between each two, so
short texts share the array work; a longer text is a block of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilspark.llm.common import by_row, doc_text

#: Words of a block of joined texts, and grid points extended at once.
BLOCK_WORDS, BLOCK_POINTS = 100_000, 1_000_000


def names_by_level(words: np.ndarray) -> list[np.ndarray]:
    """Names of all stretches of 1, 2, 4, ... words, up to the last level on which a name repeats."""
    levels = [words]
    while True:
        names, width = levels[-1], 1 << (len(levels) - 1)
        if len(names) <= width:
            return levels
        pairs = names[:-width].astype(np.int64) * (int(names.max()) + 1) + names[width:]
        known, named = np.unique(pairs, return_inverse=True)
        if len(known) == len(pairs):
            return levels
        levels.append(named.astype(np.int32))


def extend(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words from ``i`` on equal those from ``j`` on (i < j)."""
    i, j = i.copy(), j.copy()
    begun = i.copy()
    for k in range(len(levels) - 1, -1, -1):
        names = levels[k]
        inside = j < len(names)
        same = inside & (names[np.where(inside, i, 0)] == names[np.where(inside, j, 0)])
        i += same * (1 << k)
        j += same * (1 << k)
    return i - begun


def extend_back(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words before ``i`` equal those before ``j`` (i < j)."""
    i, j = i.copy(), j.copy()
    begun = i.copy()
    for k in range(len(levels) - 1, -1, -1):
        names, width = levels[k], 1 << k
        inside = i >= width
        same = inside & (names[np.where(inside, i - width, 0)] == names[np.where(inside, j - width, 0)])
        i -= same * (1 << k)
        j -= same * (1 << k)
    return begun - i


def periodic_runs(words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, floor: int = 6, times: int = 4) -> tuple[np.ndarray, ...]:
    """(start, length, period) of the runs of the texts at ``starts`` in ``words``, by start and period.

    A run has at least max(floor, times * period) words, ``times`` 2 or more; the words that
    part two texts equal no other word.
    """
    none = np.empty(0, np.int64)
    most = np.where(lengths >= floor, lengths // times, 0)
    if not most.sum():
        return none, none, none
    levels = names_by_level(words)
    begin, end = np.repeat(starts, most), np.repeat(starts + lengths, most)
    period = np.arange(most.sum()) - np.repeat(np.cumsum(most) - most, most) + 1
    grid = np.maximum(floor, times * period) - period
    # grid points grid - 1, 2 grid - 1, ... after the begin; the last has its partner inside the text
    points = np.maximum(end - begin - period, 0) // grid
    edges = np.searchsorted(np.cumsum(points), np.arange(0, points.sum() + BLOCK_POINTS, BLOCK_POINTS), side="left")
    found = []
    for a, b in zip(edges, [*edges[1:], len(points)], strict=True):
        n = points[a:b]
        if not n.sum():
            continue
        number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1
        p, step = np.repeat(period[a:b], n), np.repeat(grid[a:b], n)
        at = np.repeat(begin[a:b], n) + number * step - 1
        hit = words[at] == words[at + p]
        at, p, step = at[hit], p[hit], step[hit]
        back = extend_back(levels, at, at + p)
        forth = extend(levels, at, at + p)
        long = back + forth >= step
        found.append(np.stack([(at - back)[long], (back + forth + p)[long], p[long]]))
    if not found:
        return none, none, none
    start, length, p = np.concatenate(found, axis=1)
    # a run with a smaller period is found for multiples of it too, with the same extent
    order = np.lexsort((p, length, start))
    start, length, p = start[order], length[order], p[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, p = start[first], length[first], p[first]
    order = np.lexsort((p, start))
    return start[order], length[order], p[order]


def damage_cycle(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p) for every tenth id: each word i >= a is replaced by word a + (i - a) % p; a null id is never damaged."""
    if doc_id is None or n == 0:
        return None
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return None
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def no_damage(doc_id: int | None, n: int) -> None:
    return None


def _described(doc_id, tokens: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple:
    runs = list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    kept = tokens
    if runs:
        change = np.zeros(len(tokens) + 1, np.int64)
        np.add.at(change, start + period, 1)
        np.add.at(change, start + length, -1)
        kept = [tokens[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()]
        s, n, p = min(runs, key=lambda r: (-r[1], r[0], r[2]))
        longest = (s, n, p, 1000 * n // p)
    else:
        longest = (None, None, None, None)
    text = b" ".join(kept).decode()
    return len(text) + len(listed), doc_id, len(runs), *longest, listed, text


def runs_of_texts(source: Iterator[tuple[int | None, str | None]], cycle: Callable, floor: int, times: int) -> Iterator[tuple]:
    """(weight, id, number of runs, the longest run, the list of runs, the text without repeats) of each text."""

    def solve(held: list[tuple[int | None, list[bytes]]]) -> Iterator[tuple]:
        number: dict[bytes, int] = {}
        lengths = np.array([len(t) for _, t in held], np.int64)
        starts = np.cumsum(lengths + 1) - lengths - 1
        words = np.empty(int(lengths.sum()) + len(held), np.int64)
        for (_, tokens), s, n in zip(held, starts.tolist(), lengths.tolist(), strict=True):
            words[s : s + n] = [number.setdefault(t, len(number)) for t in tokens]
        words[starts + lengths] = len(number) + np.arange(len(held))
        start, length, period = periodic_runs(words.astype(np.int32), starts, lengths, floor, times)
        cuts = np.searchsorted(start, [*starts, len(words)])
        for k, (doc_id, tokens) in enumerate(held):
            part = slice(cuts[k], cuts[k + 1])
            yield _described(doc_id, tokens, start[part] - starts[k], length[part], period[part])

    held, size = [], 0
    for doc_id, text in source:
        tokens = (text or "").encode().split()  # bytes split at exactly [\x20\x09-\x0D]
        changed = cycle(doc_id, len(tokens))
        if changed:
            a, p = changed
            tokens = tokens[:a] + [tokens[a + k % p] for k in range(len(tokens) - a)]
        if held and size + len(tokens) > BLOCK_WORDS:
            yield from solve(held)
            held, size = [], 0
        held.append((doc_id, tokens))
        size += len(tokens)
    if held:
        yield from solve(held)


def word_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", floor: int = 6, times: int = 4, cycle: Callable = no_damage
) -> DataFrame:
    """``(doc_id, n_runs, start, length, period, exponent_milli, runs, text)``, a row for each row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0.  A run is a stretch with
    smallest period q of at least max(``floor``, ``times`` * q) words that no
    neighbouring word extends with that period.  The longest run is described
    (ties: the smallest start, then period; no run: nulls); ``runs`` lists all as
    ``start,length,period`` lines by start, then period; ``text`` joins by one space
    the words that no run holds after its first q words.  ``cycle`` may say where a
    text is made periodic first.

    A null or empty text has no words; null and repeated ids are rows like others;
    other columns are not read; an empty table gives an empty result.  A text is
    held by one task, with about 4 bytes a word and level.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_runs", "start", "length", "period", "exponent_milli")), ("runs", pa.string()), ("text", pa.string())]
    )
    plain = doc_text(docs, id_col, text_col)
    return plain.mapInArrow(
        by_row(schema, lambda source: runs_of_texts(source, cycle, floor, times)),
        "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs string, text string",
    )


def run_digests(found: DataFrame) -> DataFrame:
    """The columns of :func:`word_runs` with digests in place of the list of runs and the text."""
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return found.select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", sha("runs").alias("runs_sha256"), sha("text").alias("collapsed_sha256")
    )

