"""Benchmark decontamination by greedy string tiling.

Every run of ``min_match`` words is a seed with a Karp-Rabin rolling hash.  Tiles
that cover an item to the threshold hold a least number of its seeds.  A bitmap
sized by the number of seeds lets the scan pass over documents with too few of
them for any item; seeds of the remaining documents are joined with the
benchmark's seeds, and only pairs with the least number for the item are
candidates, whose texts are fetched.  Each candidate pair is tiled:
the longest common run of unmarked words is marked, again and again, until none
of ``min_match`` words is left.  An item whose tokens are covered to the
threshold is contained in the document, in whatever order its parts stand.
"""

from __future__ import annotations

import heapq
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilspark.llm.bpe import Memo
from vigilspark.llm.common import by_row, doc_text, held
from vigilspark.storage import materialize

WORDS = re.compile(r"\w+")
BASE = np.uint64(0x9E3779B97F4A7C15)


def _hashes() -> Memo:
    return held("decontam words", lambda: Memo(lambda word: xxhash.xxh64_intdigest(word.encode())))


def word_hashes(text: str) -> np.ndarray:
    words = WORDS.findall(text.lower())
    return np.fromiter(map(_hashes().__getitem__, words), np.uint64, len(words))


def rolling(words: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hash of every run of ``width`` words, modulo 2^64, salted by the width."""
    n = words.size - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, width, np.uint64)
    for j in range(width):
        h = h * BASE + words[j : j + n]
    return h ^ (h >> np.uint64(32))


def _common_runs(hp: np.ndarray, ht: np.ndarray, most_pairs: int = 4_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of equal hashes on the diagonals: pattern starts, text starts, lengths.

    Matching positions are found by sorting; where repetition makes more than
    ``most_pairs`` of them, diagonals are compared one at a time instead, in
    memory of the pattern's size.
    """
    order = np.argsort(ht, kind="stable")
    ranked = ht[order]
    lo, hi = np.searchsorted(ranked, hp, "left"), np.searchsorted(ranked, hp, "right")
    n = hi - lo
    total = int(n.sum())
    if total <= most_pairs:
        i = np.repeat(np.arange(hp.size), n)
        j = order[np.repeat(lo, n) + np.arange(total) - np.repeat(np.cumsum(n) - n, n)]
        by_diagonal = np.lexsort((i, j - i))
        i, j = i[by_diagonal], j[by_diagonal]
        starts = np.flatnonzero(np.concatenate(([True], (np.diff(j - i) != 0) | (np.diff(i) != 1))))[: total or 0]
        return i[starts], j[starts], np.diff(np.concatenate((starts, [total])))
    found = [[], [], []]
    for d in range(1 - hp.size, ht.size):
        first, last = max(0, -d), min(hp.size, ht.size - d)
        same = np.concatenate(([0], (hp[first:last] == ht[first + d : last + d]).astype(np.int8), [0]))
        edge = np.diff(same)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        found[0].append(begin + first)
        found[1].append(begin + first + d)
        found[2].append(end - begin)
    return tuple(np.concatenate(f) for f in found)


def tiles(pattern: np.ndarray, text: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: non-overlapping ``(pattern start, text start, length)``, longest first.

    Ties go to the earliest pattern position, then the earliest text position.
    """
    hp, ht = rolling(pattern, min_match), rolling(text, min_match)
    if not hp.size or not ht.size:
        return []
    starts_p, starts_t, lengths = _common_runs(hp, ht)
    runs = [(1 - min_match - n, a, b) for n, a, b in zip(lengths.tolist(), starts_p.tolist(), starts_t.tolist(), strict=True)]
    heapq.heapify(runs)
    used_p, used_t = np.zeros(pattern.size, bool), np.zeros(text.size, bool)
    found = []
    while runs and not used_p.all():
        length, a, b = heapq.heappop(runs)
        length = -length
        used = used_p[a : a + length] | used_t[b : b + length]
        if not used.any():
            if np.array_equal(pattern[a : a + length], text[b : b + length]):
                used_p[a : a + length] = used_t[b : b + length] = True
                found.append((a, b, length))
            continue
        edge = np.diff(np.concatenate(([1], used.astype(np.int8), [1])))
        for s, e in zip(np.flatnonzero(edge == -1), np.flatnonzero(edge == 1), strict=True):
            if e - s >= min_match:
                heapq.heappush(runs, (-int(e - s), a + int(s), b + int(s)))
    return found


def least_seeds(words: int, width: int, threshold: float) -> int:
    """Positions of an item at which seeds must match if tiles of at least ``width`` words cover it to ``threshold``.

    Tiles of c words in all hold c - tiles * (width - 1) seeds, fewest when every
    tile has ``width`` words: c / width.
    """
    return max(1, -(-math.ceil(threshold * words - 1e-9) // width))


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_match: int = 5,
    threshold: float = 0.8,
    filter_bits: int | None = None,
) -> DataFrame:
    """``(doc_id, item_id, n_tiles, covered, item_tokens, coverage)`` of contained items.

    A row for each pair of a row of ``docs`` and a benchmark item whose tokens
    (``\\w+`` in lower case) are covered by tiles of at least ``min_match`` words
    to ``threshold`` or more; an item of fewer words needs one whole run.  Null
    or empty texts and items match nothing; null ids are kept; repeated rows give
    repeated pairs; no other columns are read; empty tables give an empty result.
    Where an item and a text repeat a few words over and over, tiling takes time
    in proportion to the product of their lengths and memory to their sum.
    ``filter_bits``: size of the bitmap as a power of two, by default 16 bits a
    seed within 2^20 and 2^28 (32 MB); a fuller bitmap only passes more documents
    on to the join.
    """
    spark = docs.sparkSession
    items = doc_text(benchmark, item_col, item_text_col).where("text is not null")
    seed_schema = pa.schema(
        [("item", pa.int64()), ("seed", pa.int64()), ("times", pa.int32()), ("width", pa.int32()), ("need", pa.int32()), ("least", pa.int32())]
    )

    def item_seeds(source):
        for item, text in source:
            words = word_hashes(text)
            width = min(min_match, words.size)
            if width:
                h, times = np.unique(rolling(words, width), return_counts=True)
                need = least_seeds(words.size, width, threshold) if words.size >= min_match else 1
                # distinct seeds that reach the need at least: the most frequent ones
                least = int(np.searchsorted(np.cumsum(np.sort(times)[::-1]), need)) + 1
                for seed, n in zip(h.view(np.int64).tolist(), times.tolist(), strict=True):
                    yield 1, item, seed, n, width, need, least

    seeds = materialize(
        items.mapInArrow(by_row(seed_schema, item_seeds), "item long, seed long, times int, width int, need int, least int"), "seeds"
    )
    # the least number of distinct seeds by width: at most min_match rows
    least_of = {r["width"]: r["least"] for r in seeds.groupBy("width").agg(F.min("least").alias("least")).collect()}
    bits = filter_bits or min(28, max(20, (16 * seeds.count()).bit_length()))
    shift = np.uint64(64 - bits)
    bit = F.shiftrightunsigned("seed", 64 - bits)
    # at most 2^bits bits, however large the benchmark; beyond saturation the join below does all the work
    pages = seeds.select(bit.alias("bit")).groupBy(F.shiftright("bit", 15).alias("page")).agg(F.expr("bitmap_construct_agg(bit & 32767)").alias("bits")).collect()
    bitmap = np.zeros((max(1, 1 << (bits - 15)), 4096), np.uint8)
    for page in pages:
        bitmap[page["page"]] = np.frombuffer(bytes(page["bits"]), np.uint8)
    shipped = spark.sparkContext.broadcast(bitmap.tobytes())
    hit_schema = pa.schema([("id", pa.int64()), ("text", pa.string()), ("seeds", pa.list_(pa.int64()))])

    def hits(source):
        known = np.frombuffer(shipped.value, np.uint8)
        for i, text in source:
            if not text or not least_of:
                continue
            words = word_hashes(text)
            found = []
            for width, least in least_of.items():
                h = rolling(words, width)
                at = h >> shift
                hit = np.unique(h[(known[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1])
                if hit.size >= least:
                    found.append(hit)
            if found:
                found = np.concatenate(found)
                yield len(text) + found.size, i, text, found.view(np.int64).tolist()

    near = doc_text(docs, id_col, text_col).mapInArrow(by_row(hit_schema, hits), "id long, text string, seeds array<long>")
    near = materialize(near.withColumn("row", F.monotonically_increasing_id()), "near")
    pairs = near.select("row", F.explode("seeds").alias("seed")).join(seeds.select("seed", "item", "times", "need"), "seed")
    pairs = pairs.groupBy("row", "item").agg(F.sum("times").alias("shared"), F.first("need").alias("need")).where("shared >= need").select("row", "item")
    both = pairs.join(items.select(F.col("id").alias("item"), F.col("text").alias("item_text")), "item")
    both = both.join(near.select("row", "id", "text"), "row").select("id", "text", "item", "item_text")
    out = pa.schema(
        [("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_tiles", pa.int64()), ("covered", pa.int64()), ("item_tokens", pa.int64()), ("coverage", pa.float64())]
    )

    def verify(source):
        for i, text, item, item_text in source:
            pattern = word_hashes(item_text)
            marked = tiles(pattern, word_hashes(text), min(min_match, pattern.size))
            covered = sum(length for _, _, length in marked)
            if covered and covered >= threshold * pattern.size:
                yield 1, i, item, len(marked), covered, int(pattern.size), covered / pattern.size

    return both.mapInArrow(
        by_row(out, verify),
        "doc_id long, item_id long, n_tiles long, covered long, item_tokens long, coverage double",
    )
