"""Removal of repeated byte strings by enhanced suffix arrays and their interval trees.

A string of ``width`` bytes belongs to its *anchor*: the first of its grams (16
bytes at width 50) with the least hash.  Equal strings have equal anchors, so the
suffixes that can share ``width`` bytes meet by an equi key.  Neighbouring strings
with one anchor are one *context*, about 67 bytes that start at 18 positions.

1. Anchors are counted with map-side pre-aggregation; only those found in two
   documents go on.
2. Their contexts are grouped into classes by a 128-bit hash, so that copies are
   one class however many they are, each with its smallest id.
3. Contexts of anchors with several classes are sorted into an enhanced suffix
   array (suffixes and common prefixes).  A stack scan walks its interval tree; an
   interval whose suffixes follow different bytes is a maximal repeat, and all its
   occurrences, not only neighbours in the order, get the smallest id among them.
   A class alone with its anchor is such a group by itself.
4. What a class has covered goes back to its occurrences; each document merges its
   spans and drops the bytes.

No step gathers an anchor: counts are pre-aggregated, joins have a unique side, and
an anchor with more than ``most_classes`` different contexts is split into single
strings, which are grouped by their bytes with pre-aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilspark.llm.common import by_row, small_batches
from vigilspark.storage import drop_path, materialize, materialize_at, new_path

#: A null id stands after all others.
_LAST = (1 << 63) - 1
#: Bytes of joined texts hashed at once, and suffixes of one array.
_PLACE = 17
BLOCK_BYTES, BLOCK_SUFFIXES = 120_000, 50_000
#: An anchor with more classes is split into its single strings.
MOST_CLASSES = 20_000

#: Odd multipliers of the hashes.
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_ODD32, _MIX32 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)
#: Hash of each byte.
_BYTES = (np.arange(1, 257, dtype=np.uint32) * _ODD32) ^ (np.arange(1, 257, dtype=np.uint32) * _MIX32 >> np.uint32(15))


def gram_of(width: int) -> int:
    """Bytes of the grams that anchor strings of ``width`` bytes: the power of two below a third of it."""
    if width < 24:
        raise ValueError("strings of at least 24 bytes are needed")
    return 1 << ((width // 3).bit_length() - 1)


def gram_ranks(data: np.ndarray, size: int) -> np.ndarray:
    """32-bit hashes of all grams of ``size`` (a power of two) bytes, from those of their halves; they only rank grams."""
    h, half = _BYTES[data], 1
    while half < size and len(h) > half:
        left = h[:-half] * _ODD32
        left += h[half:]
        left ^= left >> np.uint32(15)
        h, half = left, half * 2
    return h * _MIX32 if half == size else h[:0]


def first_minima(ranks: np.ndarray, span: int) -> np.ndarray:
    """The position of the first least rank (upper bits) in each window of ``span`` grams; at most 2^_PLACE ranks."""
    value, have = ranks >> np.uint32(_PLACE) << np.uint32(_PLACE), 1
    value |= np.arange(len(value), dtype=np.uint32)
    while have < span:
        step = min(have, span - have)
        value = np.minimum(value[:-step], value[step:])
        have += step
    return value & np.uint32((1 << _PLACE) - 1)


def string_hashes(data: np.ndarray, begin: np.ndarray, size: np.ndarray | int, most: int) -> np.ndarray:
    """64-bit hashes of the strings at ``begin`` of ``size`` bytes, 8 to ``most``: overlapping words of 8 bytes, each mixed in."""
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    h = np.zeros(len(begin), np.uint64) + np.asarray(size).astype(np.uint64)
    for at in range(0, most, 8):
        h *= _ODD
        h += words[begin + np.minimum(at, size - 8)].view(np.uint64).ravel()
        h ^= h >> np.uint64(32)
        h *= _MIX
        h ^= h >> np.uint64(29)
    return h


def contexts(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int, whole: bool = True) -> dict[str, np.ndarray]:
    """The contexts of joined texts: text number, start in the text, strings, anchor hash, hash of all bytes.

    Contexts of a single string that follow each other with equal bytes (runs of
    one letter) are one row, with minus their number as ``n``.  Without ``whole`` only
    text numbers and anchors are given.
    """
    enough = lengths >= width
    if not enough.any():
        return {n: np.empty(0, np.int64) for n in ("text", "start", "n", "anchor", "context")}
    gram = gram_of(width)
    place = first_minima(gram_ranks(data, gram), width - gram + 1)
    opens, ends = starts[enough], starts[enough] + lengths[enough] - width + 1
    new = np.empty(len(place), bool)
    new[1:] = place[1:] != place[:-1]
    change = np.zeros(len(place) + 1, np.int8)
    change[opens] = 1
    np.subtract.at(change, ends, 1)
    new &= np.cumsum(change[:-1], dtype=np.int8).view(bool)
    new[opens] = True
    begin = np.flatnonzero(new)
    inside = np.searchsorted(opens, begin, side="right") - 1
    text = np.flatnonzero(enough)[inside]
    n = np.minimum(np.append(begin[1:], len(place)), ends[inside]) - begin
    found = {"text": text, "anchor": string_hashes(data, place[begin].astype(np.int64), gram, gram).view(np.int64)}
    if not whole:
        return found
    hashed = string_hashes(data, begin, n + width - 1, 2 * width - gram)
    found |= {"start": begin - starts[text], "n": n, "context": hashed.view(np.int64)}
    again = np.zeros(len(begin), bool)
    again[1:] = (n[1:] == 1) & (n[:-1] == 1) & (np.diff(begin) == 1) & (hashed[1:] == hashed[:-1]) & (found["anchor"][1:] == found["anchor"][:-1])
    kept = np.flatnonzero(~again)
    found = {name: column[kept] for name, column in found.items()}
    times = np.diff(np.append(kept, len(begin)))
    found["n"] = np.where(times > 1, -times, found["n"])
    return found


def _blocks(batch: pa.RecordBatch, column: int, width: int) -> Iterator[tuple[int, int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """(first row, first byte, (joined bytes, starts, lengths)) of blocks of rows; a longer text comes in overlapping blocks."""
    array = batch.column(column)
    texts = array.buffers()[2]
    offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(texts, np.uint8) if texts is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(array):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, side="right")) - 1)
        a, b = offsets[row], offsets[stop]
        if stop == row + 1:
            for shift in range(0, max(1, b - a - width + 1), BLOCK_BYTES):
                piece = data[a + shift : min(b, a + shift + BLOCK_BYTES + width - 1)]
                yield row, shift, (piece, np.zeros(1, np.int64), np.array([len(piece)]))
        else:
            yield row, 0, (data[a:b], offsets[row:stop] - a, np.diff(offsets[row : stop + 1]))
        row = stop


def _anchors(width: int):
    """``mapInArrow`` from (k, text) to (anchor, k), an anchor once for each block and id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for row, _, block in _blocks(batch, 1, width):
                found = contexts(*block, width, whole=False)
                k = ids[row + found["text"]]
                order = np.lexsort((k, found["anchor"]))
                h, k = found["anchor"][order], k[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (k[1:] != k[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(h[new]), pa.array(k[new])], ["anchor", "k"])

    return run


def _occurrences(width: int):
    """``mapInArrow`` from (k, r, text) to all contexts with their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for row, shift, block in _blocks(batch, 2, width):
                found = contexts(*block, width)
                at = row + found["text"]
                columns = [found["anchor"], found["context"], ids[at], marks[at], (shift + found["start"]).astype(np.int32), found["n"].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "context", "k", "r", "start", "n"])

    return run


def suffix_array(texts: list[bytes], strings: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(order, common, text, offset, before) of the suffixes of at least ``width`` bytes.

    ``texts[t]`` has ``strings[t]`` such suffixes.  ``common`` holds the length of the
    prefix that each suffix shares with the one before it in the order, 0 for the
    first; ``before`` the byte before each suffix, -1 at the begin of its text.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    joined = np.frombuffer(b"".join(texts) + bytes(int(lengths.max())), np.uint8)
    begin = np.cumsum(lengths) - lengths
    text = np.repeat(np.arange(len(texts)), strings)
    offset = np.arange(len(text)) - np.repeat(np.cumsum(strings) - strings, strings)
    at, rest = begin[text] + offset, lengths[text] - offset
    most = int(rest.max())
    # after the bytes the length, so that a suffix stands before those that it begins
    cells = np.empty((len(at), most + 4), np.uint8)
    cells[:, :most] = np.lib.stride_tricks.sliding_window_view(joined, most)[at]
    cells[:, :most][np.arange(most) >= rest[:, None]] = 0
    cells[:, most:] = rest.astype(">u4").view(np.uint8).reshape(-1, 4)
    order = np.argsort(cells.view(f"S{most + 4}").ravel(), kind="stable")
    cells = cells[:, :most]
    ordered, left = cells[order], rest[order]
    differ = ordered[1:] != ordered[:-1]
    common = np.zeros(len(order), np.int64)
    common[1:] = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), most), np.minimum(left[1:], left[:-1]))
    before = np.where(offset > 0, joined[at - 1].astype(np.int64), -1)
    return order, common, text, offset, before


def maximal_repeats(order: np.ndarray, common: np.ndarray, before: np.ndarray, ids: np.ndarray, width: int) -> Iterator[tuple[int, int, int, int]]:
    """(length, first, last, smallest id) of each maximal repeat of at least ``width`` bytes.

    Its occurrences are the suffixes ``order[first:last + 1]``: an interval of the
    array whose suffixes share ``length`` bytes, no more, and follow different bytes
    or begin their text.  Intervals close when the common prefix gets shorter; a
    stack holds the open ones, each with the byte before its suffixes, or None.
    """
    near = common >= width
    edges = np.flatnonzero(np.diff(np.concatenate(([0], near.astype(np.int8), [0]))))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        rows = order[a - 1 : b]
        prefixes = common[a:b].tolist()
        marks = [None if x < 0 else x for x in before[rows].tolist()]
        least = ids[rows].tolist()
        open_: list[list] = []  # length, first row, byte before, smallest id, whether one byte precedes all
        for k, share in enumerate([*prefixes, 0]):
            # the row before this border, then each interval that ends here, joins the next wider one
            first, mark, low, one = k, marks[k], least[k], marks[k] is not None
            while open_ and open_[-1][0] > share:
                length, begun, other, lowest, all_one = open_.pop()
                first, one, low, mark = begun, one and all_one and mark == other, min(low, lowest), other
                if not one:
                    yield length, a - 1 + first, a - 1 + k, low
            if open_ and open_[-1][0] == share:
                top = open_[-1]
                top[3], top[4] = min(top[3], low), top[4] and one and top[2] == mark
            elif share:
                open_.append([share, first, mark, low, one])


def covered_by(texts: list[bytes], strings: np.ndarray, ids: np.ndarray, width: int) -> np.ndarray:
    """For each string of the texts, text by text, the smallest id that any text with this string has."""
    order, common, text, _, before = suffix_array(texts, strings, width)
    low = ids[text]
    found = list(maximal_repeats(order, common, before, low, width))
    low = low.copy()
    if found:
        length, first, last, least = (np.array(c, np.int64) for c in zip(*found, strict=True))
        size = last - first + 1
        group = np.repeat(np.arange(len(size)), size)
        where = order[first[group] + np.arange(len(group)) - np.repeat(np.cumsum(size) - size, size)]
        wide = length[group] - width + 1  # strings of the repeat at this occurrence
        many = np.repeat(np.arange(len(wide)), wide)
        within = np.arange(len(many)) - np.repeat(np.cumsum(wide) - wide, wide)
        np.minimum.at(low, where[many] + within, least[group][many])
    return low


def _solved(width: int):
    """Sorted rows (anchor, context, k, top, n, bytes) to (anchor, context, offset, length, low): whom each class repeats."""

    def solve(held: list[tuple]) -> Iterator[tuple]:
        strings = np.array([row[4] for row in held], np.int64)
        low = covered_by([row[5] for row in held], strings, np.array([row[2] for row in held], np.int64), width)
        begin = np.cumsum(strings) - strings
        new = np.ones(len(low), bool)
        new[1:] = low[1:] != low[:-1]
        new[begin] = True
        first = np.flatnonzero(new)
        owner = np.searchsorted(begin, first, side="right") - 1
        spans = zip(owner.tolist(), (first - begin[owner]).tolist(), np.diff(np.append(first, len(low))).tolist(), low[first].tolist(), strict=True)
        for t, offset, n, least in spans:
            anchor, context, _, top, *_ = held[t]
            if least < top:  # else no occurrence has a larger id
                yield 1, anchor, context, offset, n + width - 1, least

    def run(source: Iterator[tuple]) -> Iterator[tuple]:
        held, size = [], 0
        for _, rows in groupby(source, key=lambda r: r[0]):
            for row in rows:
                held.append(row)
                size += row[4]
            if size >= BLOCK_SUFFIXES:
                yield from solve(held)
                held, size = [], 0
        if held:
            yield from solve(held)

    return run


def _cut_out(width: int):
    """``mapInArrow`` from (k, text, places of the contexts) to (anchor, context, k, top, n, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, texts, wanted = batch.column(0), batch.column(1).to_pylist(), batch.column(2)
            rows = pa.compute.list_parent_indices(wanted)
            place = wanted.flatten()
            anchor, context, top, n, start = (place.field(x) for x in ("anchor", "context", "top", "n", "start"))
            where = zip(rows.to_pylist(), start.to_pylist(), n.to_pylist(), strict=True)
            cut = pa.array([texts[row][at : at + m + width - 1] for row, at, m in where], pa.binary())
            for a in range(0, len(cut), 50_000):
                columns = [anchor, context, k.take(rows), top, n, cut]
                yield pa.RecordBatch.from_arrays([c.slice(a, 50_000) for c in columns], ["anchor", "context", "k", "top", "n", "bytes"])

    return run


def _emptied(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, begins, sizes) to (id, bytes, removed, spans, kept)."""
    for batch in source:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        begins, sizes = batch.column(2), batch.column(3)
        n, removed, spans, kept = [], [], [], []
        for row, text in enumerate(texts):
            n.append(len(text))
            if not begins[row].is_valid:
                removed.append(0), spans.append(0), kept.append(text)
                continue
            begin, size = begins[row].values.to_numpy(), sizes[row].values.to_numpy()
            change = np.zeros(len(text) + 1, np.int64)
            np.add.at(change, begin, 1)
            np.subtract.at(change, begin + size, 1)
            gone = np.cumsum(change)[:-1] > 0
            removed.append(int(gone.sum()))
            spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
            kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
        columns = [ids, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def repeated_spans(plain: DataFrame, width: int, most_classes: int = MOST_CLASSES) -> DataFrame:
    """``(k, r, begins, sizes)`` of the rows of (k, r, text) that hold strings of a smaller ``k``."""
    seen = plain.select("k", "text").mapInArrow(_anchors(width), "anchor long, k long")
    shared = seen.groupBy("anchor").agg(F.min("k").alias("low"), F.max("k").alias("top")).where("low < top")
    spark, paths = plain.sparkSession, {name: new_path(plain.sparkSession, name) for name in ("anchors", "occurrences", "classes", "sizes", "alone", "several", "contexts", "hot", "covered")}
    keep = lambda df, name: materialize_at(df, paths[name], "zstd")
    shared = keep(shared.select("anchor"), "anchors")
    all_of_them = plain.select("k", "r", "text").mapInArrow(
        _occurrences(width), "anchor long, context long, k long, r long, start int, n int"
    )
    # the anchors are unique and the smaller side; a hot one is split on the other side
    occurrences = keep(all_of_them.join(shared.hint("shuffle_hash"), "anchor", "left_semi"), "occurrences")
    drop_path(spark, paths["anchors"])

    place = F.struct("k", "r", "start")
    classes = keep(
        occurrences.groupBy("anchor", "context").agg(F.min(place).alias("at"), F.max("k").alias("top"), F.greatest(F.first("n"), F.lit(1)).alias("n")), "classes"
    )
    sizes = keep(classes.groupBy("anchor").agg(F.count("*").alias("classes")).where("classes > 1"), "sizes")
    sized = classes.join(sizes.hint("shuffle_hash"), "anchor", "left")
    alone = keep(
        sized.where("classes is null and at.k < top").select(
            "anchor", "context", F.lit(0).cast("long").alias("offset"), (F.col("n") + (width - 1)).cast("long").alias("length"), F.col("at.k").alias("low")
        ),
        "alone",
    )
    several = keep(sized.where("classes > 1").select("anchor", "context", "at.*", "top", "n"), "several")
    drop_path(spark, paths["classes"])
    wanted = several.groupBy("k", "r").agg(
        F.collect_list(F.struct("anchor", "context", "top", "n", "start")).alias("wanted")
    )
    cut = keep(
        plain.join(wanted, ["k", "r"]).select("k", "text", "wanted").mapInArrow(
            _cut_out(width), "anchor long, context long, k long, top long, n int, bytes binary"
        ),
        "contexts",
    )
    drop_path(spark, paths["several"])
    hot = keep(sizes.where(F.col("classes") > most_classes).select("anchor"), "hot")
    cold = cut.join(hot, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor")
    spans_ddl = "anchor long, context long, offset long, length long, low long"
    spans_schema = pa.schema([(n, pa.int64()) for n in ("anchor", "context", "offset", "length", "low")])
    solved = cold.select("anchor", "context", "k", "top", "n", "bytes").mapInArrow(by_row(spans_schema, _solved(width)), spans_ddl)

    # strings of hot anchors, one by one: the smallest id of each is pre-aggregated
    single = cut.join(hot, "anchor", "left_semi").select("anchor", "context", "k", "top", "bytes", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("offset"))
    single = single.select("anchor", "context", "k", "top", "offset", F.substring("bytes", F.col("offset") + 1, F.lit(width)).alias("string"))
    lowest = single.groupBy("string").agg(F.min("k").alias("low"))
    split = single.join(lowest.hint("shuffle_hash"), "string").where("low < top").select(
        "anchor", "context", F.col("offset").cast("long"), F.lit(width).cast("long").alias("length"), "low"
    )
    found = keep(alone.unionByName(solved).unionByName(split), "covered")
    for name in ("alone", "sizes", "contexts", "hot"):
        drop_path(spark, paths[name])
    hits = occurrences.join(found.hint("shuffle_hash"), ["anchor", "context"]).where("k > low").select(
        "k", "r", F.struct((F.col("start") + F.col("offset")).cast("int").alias("begin"), (F.col("length") + F.greatest(-F.col("n"), F.lit(1)) - 1).cast("int").alias("size")).alias("span")
    )
    merged = hits.groupBy("k", "r").agg(F.collect_list("span").alias("spans"))
    spans = materialize(merged.select("k", "r", F.col("spans.begin").alias("begins"), F.col("spans.size").alias("sizes")), "spans")
    for name in ("occurrences", "covered"):
        drop_path(spark, paths[name])
    return spans


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, most_classes: int = MOST_CLASSES) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept)``, a row for each row of ``docs``.

    A text is its UTF-8 bytes.  Every byte covered by a string of ``width`` bytes that
    also starts in a row with a smaller id goes; overlaps count, strings are judged
    on the input, and matches never cross rows.  ``n_spans`` counts maximal runs of
    removed bytes; ``kept`` joins the rest.

    Null and empty texts have no bytes.  A null id stands after all others, and rows
    of one id, or without id, never remove each other's bytes.  Other columns are
    not read; an empty table gives an empty result.  Contexts are matched by 128-bit
    hash, then by their bytes.
    """
    plain = small_batches(docs).select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("k"), F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
    ).withColumn("r", F.xxhash64("text"))
    spans = repeated_spans(plain, width, most_classes)
    joined = plain.join(spans.hint("shuffle_hash"), ["k", "r"], "left").select("id", "text", "begins", "sizes")
    return joined.mapInArrow(_emptied, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
