"""N-gram language-model scores by deleted interpolation.

Maximum-likelihood estimates of the orders 0 (uniform) to ``order`` are mixed
with weights that depend on how often the context was seen; the weights are
learned by expectation-maximisation on deleted counts: for each block of training
documents the estimates are those of all training documents without the block.

Counts are exact and cover every training document.  Documents are dealt into
blocks by hash and tokenised once; each block asks for the counts of its distinct
n-grams, once, as packed sorted hashes cut by key range.  A node merges what a
group of blocks asks for in one range and asks the next level for the merged
keys, in finer ranges; the last level has the totals, and answers return the same
way, each in the order of its asker.  A level has a fixed fan-out, so that a block
never writes more than ``2 ** fan_bits`` packets an order, and packets grow in
proportion to the corpus (times the number of levels: one up to 4,096 blocks, two
up to 16 million).  A frequent word or n-gram is one entry for each block and
never a hot row.

N-grams are identified by 64-bit hashes.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilspark.llm.common import LOWER_AZ, small_batches
from vigilspark.storage import materialize

#: UTF-8 bytes of text that one block should hold.
BLOCK_BYTES = 16_000_000
LEAST_BLOCKS = 8
#: A block asks in at most 2 ** FAN_BITS packets an order, a node merges at most so many askers.
FAN_BITS = 12
#: Shuffles have at most so many partitions; beyond, a task works on several blocks or nodes in turn.
MOST_PARTITIONS = 20_000
EM_ROUNDS = 100
#: Context frequencies are grouped by powers of two, up to this many groups.
FREQUENCY_BUCKETS = 24
#: For EM, events whose estimates agree to so many steps a decade share one cell, which has the geometric means of
#: their estimates; the distances from the step are added as integers, in units of 1 / _FINE steps.
STEPS = 6
_DECADES = 10
_FINE = 1 << 20
#: Tokens whose estimates are computed at a time.
_SLICE = 500_000

_END = np.uint64(xxhash.xxh64_intdigest(b"", 1))
_BEGIN = np.uint64(xxhash.xxh64_intdigest(b"", 2))


class Numbers(dict):
    """Word -> its number, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def pack(numbers: np.ndarray) -> bytes:
    """Counts as bytes of the least width that holds them, bytes of equal weight together, compressed."""
    top = int(numbers.max()) if numbers.size else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w - 1))
    planes = np.ascontiguousarray(numbers.astype(f"<i{width}").view(np.uint8).reshape(-1, width).T)
    return bytes([width]) + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpack(data: bytes, n: int) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(pa.decompress(data[1:], width * n, "zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(f"<i{width}").reshape(-1)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted hashes as differences, bytes of equal weight together, compressed."""
    d = np.empty_like(keys)
    d[:1] = keys[:1]
    d[1:] = keys[1:] - keys[:-1]
    return pa.compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes(), "zstd", asbytes=True)


def unpack_keys(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).reshape(-1), dtype=np.uint64)


class Block:
    """The documents of one block, repeats held once, as word hashes end to end."""

    def __init__(self) -> None:
        self.docs: dict[tuple, int] = {}
        self.ids: list[int | None] = []
        self.train: list[bool] = []
        self.times: list[int] = []
        self.arrays: list[np.ndarray] = []
        self.words = Numbers()

    def add(self, i: int | None, text: str, train: bool, times: int = 1) -> None:
        key = (i, train, xxhash.xxh3_128_digest(text.encode()))
        k = self.docs.setdefault(key, len(self.ids))
        if k == len(self.ids):
            self.ids.append(i)
            self.train.append(train)
            self.times.append(0)
            self.arrays.append(self.numbers(text))
        self.times[k] += times

    def numbers(self, text: str) -> np.ndarray:
        """Numbers of the words (A-Z in lower case, split at ``[\\x20\\x09-\\x0D]``), and -1 for the end."""
        words = text.encode().translate(LOWER_AZ).split()
        out = np.empty(len(words) + 1, np.int32)
        out[:-1] = np.fromiter(map(self.words.__getitem__, words), np.int32, len(words))
        out[-1] = -1
        return out

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.lengths)[:-1]))

    @property
    def weight(self) -> np.ndarray:
        """How often each token occurs in training."""
        return np.repeat(np.array(self.times, np.int32) * np.array(self.train, np.int32), self.lengths)

    def dumps(self) -> bytes:
        lengths = np.array([a.size for a in self.arrays], np.int64)
        hashes = np.array([*map(xxhash.xxh64_intdigest, self.words), _END], np.uint64)
        words, place = np.unique(hashes, return_inverse=True)
        at = place.astype(np.int32)[np.concatenate(self.arrays)]
        return pickle.dumps((self.ids, self.train, self.times, lengths, words.size, pack_keys(words), at.size, pack(at)))

    @classmethod
    def loads(cls, data: bytes) -> Block:
        block = cls()
        block.ids, block.train, block.times, block.lengths, n_words, words, n, at = pickle.loads(data)
        block.tokens = unpack_keys(words, n_words)[unpack(at, n)]
        return block

    def grams(self, order: int) -> Iterator[np.ndarray]:
        """The hash of each token with none, one, ... of the tokens before it in its document."""
        gram, starts = self.tokens, self.starts
        for k in range(order):
            if k:
                history = np.empty_like(gram)
                history[1:] = gram[:-1]
                history[starts] = _BEGIN
                history ^= history >> np.uint64(32)
                history *= np.uint64(0x9E3779B97F4A7C15)
                history += self.tokens * np.uint64(2 * k + 1)
                history ^= history >> np.uint64(29)
                history *= np.uint64(0xBF58476D1CE4E5B9)
                history ^= history >> np.uint64(32)
                gram = history
            yield gram


def distinct(gram: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, their added weights, the sorting order, and the place of each sorted entry in the keys."""
    order = np.argsort(gram)
    gram = gram[order]
    new = np.empty(gram.size, bool)
    new[:1] = True
    np.not_equal(gram[1:], gram[:-1], out=new[1:])
    first = np.flatnonzero(new)
    added = np.add.reduceat(weight[order], first, dtype=np.int64) if first.size else np.empty(0, np.int64)
    return gram[first], added, order, np.cumsum(new, dtype=np.int32) - 1


def estimates(counts: list[np.ndarray], starts: np.ndarray, documents: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """ML estimates [order, tokens] from each token's n-gram counts, and the frequency bucket of its longest context.

    ``starts``: places where a document begins; its context was seen ``documents`` times.
    """
    out = np.zeros((len(counts), counts[0].size))
    out[0] = counts[0] / max(total, 1)
    context = np.full(counts[0].size, float(total))
    for k in range(1, len(counts)):
        context[1:] = counts[k - 1][:-1]
        context[starts] = documents
        np.divide(counts[k], context, out=out[k], where=context > 0)
    bucket = np.minimum(np.ceil(np.log2(np.maximum(context, 0) + 1)).astype(np.int64), FREQUENCY_BUCKETS - 1)
    return out, bucket


def slices(lengths: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first, last, starts within) of runs of whole documents with about ``_SLICE`` tokens."""
    ends = np.cumsum(lengths)
    a = 0
    while a < lengths.size:
        begin = int(ends[a] - lengths[a])
        b = max(a + 1, int(np.searchsorted(ends, begin + _SLICE, "right")))
        yield begin, int(ends[b - 1]), (ends[a:b] - lengths[a:b]) - begin
        a = b


def read_cells(code: np.ndarray, events: np.ndarray, *apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, events, estimates [cells, orders]) of cells, by their number; integers until here, so sums are exact."""
    by = np.argsort(code)
    code, events, estimate = code[by], events[by], []
    for x in reversed(apart):
        code, step = np.divmod(code, STEPS * _DECADES + 2)
        mean = step - 1 + x[by] / (np.maximum(events, 1) * _FINE)
        estimate.append(np.where(step > 0, 10.0 ** (-mean / STEPS), 0.0))
    return code, events, np.stack(estimate[::-1], axis=1)


def learn_weights(bucket: np.ndarray, events: np.ndarray, estimate: np.ndarray, vocabulary: int) -> np.ndarray:
    """Mixture weights [bucket, uniform + orders] by EM from cells of events with estimates [cells, orders].

    Buckets without events take the weights of all events together; without any
    event the weights are equal.
    """
    parts = estimate.shape[1] + 1
    weights = np.full((FREQUENCY_BUCKETS, parts), 1.0 / parts)
    if not len(bucket):
        return weights
    n = events.astype(np.float64)
    p = np.concatenate((np.full((len(bucket), 1), 1.0 / (vocabulary + 1)), estimate), axis=1)

    def em(rows: np.ndarray) -> np.ndarray:
        w, p_of, n_of = np.full(parts, 1.0 / parts), p[rows], n[rows]
        for _ in range(EM_ROUNDS):
            w = w * (p_of.T @ (n_of / (p_of @ w))) / n_of.sum()
        return w

    weights[:] = em(np.arange(len(bucket)))
    for b in np.unique(bucket):
        weights[b] = em(np.flatnonzero(bucket == b))
    # the uniform estimate keeps a share, so that no token has probability zero
    weights = np.maximum(weights, 1e-9)
    return weights / weights.sum(axis=1, keepdims=True)


REQUEST = "k int, r long, m long, n int, keys binary, counts binary"
REPLY = "k int, r long, m long, n long, counts binary, total long"
_NO_COUNTS = b""


def _rows(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 64) -> Iterator[pa.RecordBatch]:
    held_rows = []
    for row in rows:
        held_rows.append(row)
        if len(held_rows) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held_rows, strict=True), schema, strict=True)], schema=schema)
            held_rows = []
    if held_rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held_rows, strict=True), schema, strict=True)], schema=schema)


_REQUEST = pa.schema([("k", pa.int32()), ("r", pa.int64()), ("m", pa.int64()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_REPLY = pa.schema([("k", pa.int32()), ("r", pa.int64()), ("m", pa.int64()), ("n", pa.int64()), ("counts", pa.binary()), ("total", pa.int64())])


def _cut(k: int, member: int, keys: np.ndarray, counts: np.ndarray, bits: int, base: int, depth: int) -> Iterator[tuple]:
    """Requests of sorted keys below the range ``base`` of ``depth`` bits, one for each of its 2 ** bits parts that holds a key."""
    first = base << bits
    shift = 64 - depth - bits
    edges = np.array([(first + f) << shift for f in range(1, 1 << bits)], np.uint64)
    at = [0, *np.searchsorted(keys, edges).tolist(), keys.size]
    for f, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        if b > a:
            yield k, first + f, member, b - a, pack_keys(keys[a:b]), pack(counts[a:b])


def _merged(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of requests ``(m, n, keys, counts)``, their added counts, and each entry's place in them."""
    keys = np.concatenate([unpack_keys(k, n) for _, n, k, _ in parts])
    counts = np.concatenate([unpack(c, n).astype(np.int64) for _, n, _, c in parts])
    keys, totals, order, run = distinct(keys, counts)
    place = np.empty(order.size, np.int32)
    place[order] = run
    return keys, totals, place


def _by_node(df: DataFrame, bits: int, depth: int, members: int, order: int, kind: bool = False) -> DataFrame:
    """The rows of a node (order, range, group of members) together, replies before requests."""
    groups = -(-members // (1 << bits))
    node = (F.col("k").cast("long") * F.lit(1 << depth) + F.col("r")) * F.lit(groups) + F.shiftright("m", bits)
    parts = min(MOST_PARTITIONS, order * groups << depth)
    keys = ["k", "r", F.shiftright("m", bits), *(["kind"] if kind else [])]
    return df.repartitionById(parts, F.pmod(node, F.lit(parts)).cast("int")).sortWithinPartitions(*keys)


def exchange(asked: DataFrame, members: int, order: int, bits: int, depth: int = 0) -> tuple[DataFrame, DataFrame]:
    """Replies ``(k, r, m, counts)`` to requests cut into ranges of ``depth + bits`` bits, and the rows that hold the totals.

    The last level is where one group has all members; it is written, so that
    what is known of the whole corpus is read from it.
    """
    depth += bits
    node_of = lambda row: (row[0], row[1], row[2] >> bits)

    def answer(batches):
        def rows():
            for (k, r, _), group in groupby(_rows(batches), key=node_of):
                parts = [row[2:] for row in group]
                _, totals, place = _merged(parts)
                yield k, r, -1, int((totals > 0).sum()), _NO_COUNTS, int(totals.sum())
                at = 0
                for m, n, _, _ in parts:
                    yield k, r, m, n, pack(totals[place[at : at + n]]), 0
                    at += n

        yield from _batches(rows(), _REPLY)

    if members <= 1 << bits:
        replies = materialize(_by_node(asked, bits, depth, members, order).mapInArrow(answer, REPLY), "answers")
        return replies.where("m >= 0"), replies.where("m = -1")

    asked = materialize(asked, "asked")

    def ask_on(batches):
        def rows():
            for (k, r, g), group in groupby(_rows(batches), key=node_of):
                keys, totals, _ = _merged([row[2:] for row in group])
                yield from _cut(k, g, keys, totals, bits, r, depth)

        yield from _batches(rows(), _REQUEST)

    above = _by_node(asked, bits, depth, members, order).mapInArrow(ask_on, REQUEST)
    replies, facts = exchange(above, -(-members // (1 << bits)), order, bits, depth)

    def pass_on(batches):
        def rows():
            for (k, r, _), group in groupby(_rows(batches), key=node_of):
                totals, parts = {}, []
                for _, _, m, n, keys, counts, kind, part in group:
                    if kind:
                        parts.append((m, n, keys, counts))
                    else:
                        totals[part] = unpack(counts, n)
                total = np.concatenate([totals[f] for f in sorted(totals)])
                _, _, place = _merged(parts)
                at = 0
                for m, n, _, _ in parts:
                    yield k, r, m, n, pack(total[place[at : at + n]]), 0
                    at += n

        yield from _batches(rows(), _REPLY)

    down = asked.select("*", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("part")).unionByName(
        replies.select(
            "k", F.shiftright("r", bits).alias("r"), F.shiftleft("m", bits).alias("m"), F.col("n").cast("int").alias("n"),
            F.lit(None).cast("binary").alias("keys"), "counts", F.lit(0).alias("kind"), F.col("r").bitwiseAND(F.lit((1 << bits) - 1)).alias("part"),
        )
    )
    return _by_node(down, bits, depth, members, order, kind=True).mapInArrow(pass_on, REPLY), facts


def interpolated_scores(
    docs: DataFrame,
    train: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = 3,
    block_bytes: int = BLOCK_BYTES,
    fan_bits: int = FAN_BITS,
    weights: np.ndarray | None = None,
) -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)``, a row for each row of ``docs``.

    ``train``: boolean column of ``docs``, the rows to learn from (null: learn).
    ``weights``: mixture weights [frequency bucket, uniform + orders] to use
    instead of learning them.
    ``base_score`` adds log10((c + 1) / (N + V + 1)) over the tokens, ``score``
    log10 of the interpolated model's probabilities.  Null and empty texts are
    one end token.  Repeated rows count as often as they stand and are scored as
    often.  Rows without id are counted by text before they are dealt, since many may
    be equal, so no score depends on how rows are partitioned; other columns are not
    read.  The text is dealt to one block for each ``block_bytes``, at least 8, and weights
    are learned on those blocks, so they move a little with the size of the table.  Without training rows every estimate but
    the uniform one is zero.  One document is held whole by a task.
    """
    plain = small_batches(docs).select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.coalesce(train, F.lit(True)).alias("train"),
    )
    size, documents = plain.agg(F.sum(F.octet_length("text")), F.count_if("train")).first()
    blocks = max(LEAST_BLOCKS, -(-(size or 0) // block_bytes))
    bits = min(fan_bits, (blocks - 1).bit_length())
    parts = min(blocks, MOST_PARTITIONS)
    nameless = plain.where("id is null").groupBy("id", "text", "train").agg(F.count("*").alias("times"))
    rows = plain.where("id is not null").withColumn("times", F.lit(1).cast("long")).unionByName(nameless)
    dealt = rows.select(F.pmod(F.xxhash64("id", "text", F.lit(0).cast("long")), F.lit(blocks)).alias("block"), "id", "text", "train", "times")

    def by_block(df: DataFrame, *order_by: str) -> DataFrame:
        return df.repartitionById(parts, F.pmod("block", F.lit(parts)).cast("int")).sortWithinPartitions("block", *order_by)

    def tokenise(batches):
        for number, group in groupby(_rows(batches), key=lambda row: row[0]):
            block = Block()
            for row in group:
                block.add(*row[1:])
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([block.dumps()], pa.binary())], ["block", "data"])

    tokenised = materialize(by_block(dealt).mapInArrow(tokenise, "block long, data binary"), "tokenised")

    def ask(batches):
        def rows():
            for number, data in _rows(batches):
                block = Block.loads(data)
                weight = block.weight
                for k, gram in enumerate(block.grams(order)):
                    keys, own, *_ = distinct(gram, weight)
                    yield from _cut(k, number, keys, own, bits, 0, 0)

        yield from _batches(rows(), _REQUEST)

    replies, facts = exchange(tokenised.mapInArrow(ask, REQUEST), blocks, order, bits)
    vocabulary, total = (int(x or 0) for x in facts.where("k = 0").agg(F.sum("n"), F.sum("total")).first())

    numbers = [f"e{k}" for k in range(order)]

    def count(batches):
        """Two kinds of rows: events of equal deleted estimates (a cell), and a block with the counts of its n-grams."""
        for _, group in groupby(_rows(batches), key=lambda row: row[0]):
            answers, data = {}, None
            for _, data, k, r, n, counts in group:
                if data is None:
                    answers[k, r] = unpack(counts, n)
            block = Block.loads(data)
            weight = block.weight
            counts, own, size = [], [], 0
            for k, gram in enumerate(block.grams(order)):
                total_of = np.concatenate([answers.pop(key) for key in sorted(key for key in answers if key[0] == k)])
                _, own_of, by, run = distinct(gram, weight)
                if own_of.size != total_of.size:
                    raise RuntimeError("a block's documents changed between counting and scoring")
                for out, values in ((counts, total_of), (own, own_of.astype(total_of.dtype))):
                    out.append(np.empty(gram.size, values.dtype))
                    out[-1][by] = values[run]
            own_total = int(weight.sum(dtype=np.int64))
            own_documents = int(np.dot(block.times, block.train))
            code, events, added = [], [], []
            for a, b, starts in slices(block.lengths) if weights is None else ():
                left = [c[a:b].astype(np.int64) - o[a:b] for c, o in zip(counts, own, strict=True)]
                estimate, cell = estimates(left, starts, documents - own_documents, total - own_total)
                apart = []
                for e in estimate:
                    x = np.zeros(e.size)
                    np.log10(e, out=x, where=e > 0)
                    x *= -STEPS
                    step = np.minimum(np.rint(x), STEPS * _DECADES)
                    apart.append(np.rint((x - step) * _FINE))
                    cell = cell * (STEPS * _DECADES + 2) + np.where(e > 0, step + 1, 0).astype(np.int64)
                cell, at = np.unique(cell, return_inverse=True)
                w = weight[a:b].astype(np.float64)
                code.append(cell)
                events.append(np.bincount(at, weights=w, minlength=cell.size))
                added.append([np.bincount(at, weights=w * x, minlength=cell.size) for x in apart])
            if code:
                cell, at = np.unique(np.concatenate(code), return_inverse=True)
                sums = [np.concatenate(events), *(np.concatenate(x) for x in zip(*added, strict=True))]
                sums = [np.bincount(at, weights=x, minlength=cell.size).astype(np.int64) for x in sums]
                some = sums[0] > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(int(some.sum()), pa.binary()), pa.array(cell[some]), *(pa.array(x[some]) for x in sums)],
                    ["data", "code", "events", *numbers],
                )
            head = (block.ids, block.times, block.lengths, [pack(c) for c in counts])
            yield pa.RecordBatch.from_arrays(
                [pa.array([pickle.dumps(head)], pa.binary()), *(pa.nulls(1, pa.int64()) for _ in range(order + 2))],
                ["data", "code", "events", *numbers],
            )

    answered = tokenised.select(
        "block", "data", F.lit(None).cast("int").alias("k"), F.lit(None).cast("long").alias("r"), F.lit(None).cast("long").alias("n"),
        F.lit(None).cast("binary").alias("counts"),
    ).unionByName(replies.select(F.col("m").alias("block"), F.lit(None).cast("binary").alias("data"), "k", "r", "n", "counts"))
    answered = answered.withColumn("last", F.col("data").isNotNull())
    # every block's own counts are deleted in turn, so each training document informs the weights
    counted = by_block(answered, "last").drop("last").mapInArrow(count, "data binary, code long, events long, " + ", ".join(f"{x} long" for x in numbers))
    counted = materialize(counted, "counted")
    if weights is None:
        # at most FREQUENCY_BUCKETS * (STEPS * _DECADES + 2) ** order rows, whatever the corpus
        cells = counted.where("code is not null").groupBy("code").agg(*(F.sum(c).alias(c) for c in ("events", *numbers))).toArrow()
        weights = learn_weights(*read_cells(*(c.to_numpy() for c in cells.columns)), vocabulary)

    def score(batches):
        for (data,) in _rows(batches):
            ids, times, lengths, packed = pickle.loads(data)
            counts = [unpack(c, int(lengths.sum())) for c in packed]
            out = []
            for a, b, starts in slices(lengths):
                part = [c[a:b].astype(np.int64) for c in counts]
                estimate, bucket = estimates(part, starts, documents, total)
                w = weights[bucket]
                p = w[:, 0] / (vocabulary + 1)
                for k in range(order):
                    p += w[:, k + 1] * estimate[k]
                logs = np.add.reduceat(np.log10(p), starts)
                base = np.add.reduceat(np.log10((part[0] + 1) / (total + vocabulary + 1)), starts)
                out.append((np.add.reduceat((part[0] > 0).astype(np.int64), starts), base, logs))
            known, base, logs = (np.repeat(np.concatenate(c), times) for c in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, n in zip(ids, times, strict=True) for _ in range(n)], pa.int64()),
                    pa.array(np.repeat(lengths, times), pa.int64()),
                    pa.array(known, pa.int64()),
                    pa.array(np.full(known.size, total), pa.int64()),
                    pa.array(base, pa.float64()),
                    pa.array(logs, pa.float64()),
                ],
                ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return counted.where("data is not null").select("data").mapInArrow(
        score, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
