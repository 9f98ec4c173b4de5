"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most ``r`` bits differ in at most
``r`` of their 8 bytes, so they share at least T = 8 - r positional bytes: the
guaranteed minimum.  A posting list for a single (position, byte) holds 1/256 of
all fingerprints and its pairs grow with the square of the corpus, so a list is
keyed by T - 1 positional bytes at once.  Not every choice of positions is
needed: the chosen ones cover, that is every T positions contain one of them (20
triples for r = 4), so a pair that reaches the minimum meets in a list.  Inside a
list the shared positional bytes of each pair are tallied; pairs below T, such as
those that share the list's own bytes alone, are dropped and the rest verified by
Hamming distance.

Equal fingerprints are one class before the index is built.  Within a list a
spanning set of verified links is emitted, not all pairs: fingerprints already
reached leave the list, so a list full of near copies costs about its length.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilspark.llm.common import LOWER_AZ, by_row, doc_text
from vigilspark.operators.components import connected_components
from vigilspark.storage import materialize

SEED = 42
#: Rows of packed postings that one merge bucket should hold.
BUCKET_ROWS = 1_000_000
#: Fingerprints whose postings are packed at a time.
POST_ROWS = 10_000


def fingerprint(text: str, width: int = 4) -> int:
    """Unsigned 64-bit SimHash of the word shingles, repeats included; 0 without words."""
    words = text.encode().translate(LOWER_AZ).split()
    n = len(words)
    if n == 0:
        return 0
    whole = b" ".join(words)
    if n <= width:
        return xxhash.xxh64_intdigest(whole, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[: n - width] + 1))
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(whole[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)])
    m = n - width + 1
    ones = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(m, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > m).tobytes(), "big")


def covering_positions(shared: int) -> list[tuple[int, ...]]:
    """Choices of ``shared`` - 1 (at least one) byte positions, such that any ``shared`` positions contain a whole choice.

    Greedy cover: the choice inside most of the sets that are not covered yet, first in order among equals.
    """
    left = {frozenset(c) for c in combinations(range(8), shared)}
    choices = list(combinations(range(8), max(1, shared - 1)))
    found = []
    while left:
        best = max(choices, key=lambda c: sum(s.issuperset(c) for s in left))
        found.append(best)
        left = {s for s in left if not s.issuperset(best)}
    return found


def _masks(shared: int) -> np.ndarray:
    """The covering choices of byte positions, as 64-bit masks."""
    return np.array([sum(0xFF << (8 * p) for p in c) for c in covering_positions(shared)], np.uint64)


def tally(differ: np.ndarray) -> np.ndarray:
    """Shared positional bytes of each pair, from the exclusive or of its fingerprints."""
    return (np.ascontiguousarray(differ).view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that masked fingerprints spread evenly over buckets."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _spanning_links(prints: np.ndarray, bits: int, shared: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect all fingerprints of a posting list which verified pairs connect."""
    links = []
    rest = prints
    while rest.size > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and rest.size:
            x = frontier.pop()
            differ = rest ^ x
            near = tally(differ) >= shared
            near[near] = np.bitwise_count(differ[near]) <= bits
            if near.any():
                found = rest[near]
                links.append((np.full(found.size, x, np.uint64), found))
                frontier.extend(found)
                rest = rest[~near]
    return links


def similar_fingerprints(prints: DataFrame, bits: int = 4) -> DataFrame:
    """``(a, b)``: verified links between distinct fingerprints (column ``fp``).

    Every two fingerprints within ``bits`` are connected through the links.
    Postings travel as packed blocks: for each input partition and merge bucket
    one row with the mask numbers and fingerprints that fall into the bucket.
    """
    spark = prints.sparkSession
    shared = 8 - bits
    if not 1 <= shared <= 8:
        raise ValueError("bits must be between 0 and 7")
    masks = _masks(shared)
    n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), prints.count() * len(masks) // BUCKET_ROWS + 1)
    block = pa.schema([("bucket", pa.int32()), ("masks", pa.binary()), ("prints", pa.binary())])

    def gathered(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            n += held[-1].size
            if n >= POST_ROWS:
                yield np.concatenate(held)
                held, n = [], 0
        if n:
            yield np.concatenate(held)

    def post(batches):
        for fps in gathered(batches):
            which = np.repeat(np.arange(len(masks), dtype=np.uint8), fps.size)
            every = np.tile(fps, len(masks))
            key = _mix((every & masks[which]) ^ (which.astype(np.uint64) << np.uint64(57)) * np.uint64(3))
            bucket = (key % np.uint64(n_buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket, which, every = bucket[order], which[order], every[order]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [bucket.size]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket[starts], pa.int32()),
                    pa.array([which[s:e].tobytes() for s, e in zip(starts, ends, strict=True)], pa.binary()),
                    pa.array([every[s:e].tobytes() for s, e in zip(starts, ends, strict=True)], pa.binary()),
                ],
                schema=block,
            )

    def link(batches):
        held: dict[int, list[tuple[bytes, bytes]]] = {}
        for batch in batches:
            for b, m, f in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(b, []).append((m, f))
        for parts in held.values():
            which = np.frombuffer(b"".join(m for m, _ in parts), np.uint8)
            fps = np.frombuffer(b"".join(f for _, f in parts), np.uint64)
            key = fps & masks[which]
            order = np.lexsort((fps, key, which))
            which, key, fps = which[order], key[order], fps[order]
            new = np.concatenate(([True], (which[1:] != which[:-1]) | (key[1:] != key[:-1])))
            starts = np.flatnonzero(new)
            ends = np.concatenate((starts[1:], [fps.size]))
            a, b = [], []
            two = ends - starts == 2
            p, q = fps[starts[two]], fps[starts[two] + 1]
            near = (tally(p ^ q) >= shared) & (np.bitwise_count(p ^ q) <= bits)
            a.append(p[near])
            b.append(q[near])
            for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2], strict=True):
                for x, y in _spanning_links(fps[s:e], bits, shared):
                    a.append(x)
                    b.append(y)
            a, b = np.concatenate(a), np.concatenate(b)
            pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0)
            if len(pairs):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pairs[:, 0].copy().view(np.int64)), pa.array(pairs[:, 1].copy().view(np.int64))], ["a", "b"]
                )

    blocks = prints.select("fp").mapInArrow(post, "bucket int, masks binary, prints binary")
    return blocks.repartition(n_buckets, "bucket").mapInArrow(link, "a long, b long").distinct()


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, bits: int = 4
) -> DataFrame:
    """``(doc_id, fp long, component_id)``, a row for each row of ``docs``.

    Words are runs without ``[\\x20\\x09-\\x0D]``, A-Z in lower case; a text of
    fewer than ``width`` words is one shingle; without words (null, empty or
    blank text) the fingerprint is 0 and links like any other.  A bit is set if
    more than half of the shingle hashes set it.  ``component_id`` is the
    smallest id reachable by links; null ids are never the smallest unless a
    component has no other.  Repeated rows are kept.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def prints(source):
        for i, text in source:
            fp = fingerprint(text or "", width)
            yield 1, i, fp - (1 << 64) if fp >> 63 else fp

    marked = materialize(doc_text(docs, id_col, text_col).mapInArrow(by_row(schema, prints), "doc_id long, fp long"), "prints")
    classes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    found = connected_components(similar_fingerprints(classes, bits), "a", "b")
    labelled = classes.join(found, classes.fp == found.node, "left").select(
        "fp", "rep", F.coalesce("component", "fp").alias("component")
    )
    low = labelled.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_print = labelled.join(low, "component").select("fp", "component_id")
    return marked.join(by_print, "fp", "left").select("doc_id", "fp", "component_id")
