"""Language identification by word-first backoff.

A known word scores by its log frequency in each language; an unseen word falls
back to the longest character n-grams of it that are known, then to shorter
ones.  Each word's scores are normalised over the languages, so a text's score
is the posterior of independent words under equal priors.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilspark.llm.common import by_row, doc_text, held, small_batches
from vigilspark.storage import materialize

LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
#: Words and n-grams that a task counts before it passes the counts on.
HELD_COUNTS = 100_000
SMOOTHING = 0.1


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of the word between boundary marks; for n = 1 its letters."""
    if n == 1:
        return list(word)
    marked = f"_{word}_"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def hashes(strings: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(s.encode()) for s in strings], np.uint64)


class Model:
    """Sorted hashes of the known words (n = 0) and n-grams, each with log posteriors, one for each language."""

    def __init__(self, langs: list[str], keys: list[np.ndarray], scores: list[np.ndarray]) -> None:
        self.langs, self.keys, self.scores = langs, keys, scores

    def found(self, n: int, strings: list[str]) -> np.ndarray:
        """The row of each string among those of order ``n``, -1 for unknown ones."""
        keys, wanted = self.keys[n], hashes(strings)
        if not keys.size:
            return np.full(wanted.size, -1)
        at = np.minimum(np.searchsorted(keys, wanted), keys.size - 1)
        return np.where(keys[at] == wanted, at, -1)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """[words, languages]: the word's own row, else the mean row of its longest known n-grams, else zeros."""
        out = np.zeros((len(words), len(self.langs)))
        rows = self.found(0, words)
        out[rows >= 0] = self.scores[0][rows[rows >= 0]]
        left = np.flatnonzero(rows < 0)
        for n in range(len(self.keys) - 1, 0, -1):
            if not left.size:
                break
            pieces = [grams(words[k], n) for k in left]
            which = np.repeat(np.arange(left.size), [len(p) for p in pieces])
            rows = self.found(n, [g for p in pieces for g in p])
            which, rows = which[rows >= 0], rows[rows >= 0]
            count = np.bincount(which, minlength=left.size)
            for j in range(len(self.langs)):
                total = np.bincount(which, weights=self.scores[n][rows, j], minlength=left.size)
                out[left, j] = total / np.maximum(count, 1)
            left = left[count == 0]
        return out


class Scorer(dict):
    """Run of non-blank characters -> its row in a table of added word scores and numbers of words.

    New runs are scored together after a batch of texts has been cut; the memo
    starts anew when it holds ``LIMIT`` runs.
    """

    LIMIT = 300_000

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model
        self.new: list[str] = []
        self.table = np.zeros((0, len(model.langs) + 1))

    def __missing__(self, run: str) -> int:
        k = self[run] = len(self)
        self.new.append(run)
        return k

    def learn(self) -> None:
        found = [LETTERS.findall(run.lower()) for run in self.new]
        which = np.repeat(np.arange(len(found)), [len(f) for f in found])
        scores = self.model.word_scores([w for f in found for w in f])
        columns = [np.bincount(which, weights=scores[:, j], minlength=len(found)) for j in range(len(self.model.langs))]
        columns.append(np.bincount(which, minlength=len(found)))
        first = len(self) - len(self.new)
        if len(self) > len(self.table):
            self.table = np.concatenate((self.table[:first], np.zeros((max(len(self.new), first, 1024), self.table.shape[1]))))
        self.table[first : len(self)] = np.stack(columns, axis=1)
        self.new = []

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Equal best languages give the first in alphabetical order."""
        if len(self) > self.LIMIT:
            self.clear()
        cut = [text.split() if text else [] for text in texts]
        picked = [np.fromiter(map(self.__getitem__, runs), np.int64, len(runs)) for runs in cut]
        if self.new:
            self.learn()
        out = []
        for rows in picked:
            total = self.table[rows].sum(axis=0)
            if not total[-1] or not self.model.langs:
                out.append((UNKNOWN, 0.0))
                continue
            total = total[:-1]
            best = int(total.argmax())
            out.append((self.model.langs[best], float(1.0 / np.exp(total - total[best]).sum())))
        return out


def fit(
    labelled: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    sample_docs: int = 4_000,
    longest: int = 5,
) -> Model:
    """Learn from at most about ``sample_docs`` labelled rows, whole texts, chosen by the hash of text and language.

    Rows of one text and language are chosen together and teach once, so that
    neither null or repeated ids nor copies can flood the sample.

    That bound is the only one: all words of the sample and all n-grams of its
    words are known.  Words are counted by occurrence; an n-gram counts the words
    of a language that hold it, so the counts do not depend on how rows are
    partitioned.  Rows with null text or language teach nothing; ids are not read.
    """
    rows = small_batches(labelled).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where("text is not null and lang is not null")
    total = rows.count()
    part = 1_000_000 if total <= sample_docs else max(1, 1_000_000 * sample_docs // total)
    sample = rows.where(F.pmod(F.xxhash64("text", "lang"), F.lit(1_000_000)) < part).select("lang", "text").distinct()

    def count(source):
        held_words: Counter = Counter()
        for lang, text in source:
            held_words.update((lang, word) for word in LETTERS.findall(text.lower()))
            if len(held_words) > HELD_COUNTS:
                yield from ((1, lang, word, c) for (lang, word), c in held_words.items())
                held_words.clear()
        yield from ((1, lang, word, c) for (lang, word), c in held_words.items())

    word_rows = pa.schema([("lang", pa.string()), ("word", pa.string()), ("c", pa.int64())])
    words = sample.mapInArrow(by_row(word_rows, count), "lang string, word string, c long")
    words = materialize(words.groupBy("lang", "word").agg(F.sum("c").alias("c")), "words")

    def spell(source):
        held_grams: Counter = Counter()

        def flush():
            for (lang, n, gram), c in held_grams.items():
                yield 1, lang, n, _signed(gram), c
            held_grams.clear()

        for lang, word, c in source:
            yield 1, lang, 0, _signed(word), c
            for n in range(1, longest + 1):
                held_grams.update((lang, n, g) for g in set(grams(word, n)))
            if len(held_grams) > HELD_COUNTS:
                yield from flush()
        yield from flush()

    gram_rows = pa.schema([("lang", pa.string()), ("n", pa.int32()), ("key", pa.int64()), ("c", pa.int64())])
    counted = words.mapInArrow(by_row(gram_rows, spell), "lang string, n int, key long, c long")
    langs = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    by_lang = [F.sum(F.when(F.col("lang") == lang, F.col("c")).otherwise(0)).alias(f"c{j}") for j, lang in enumerate(langs)]
    found = counted.groupBy("n", "key").agg(*by_lang, F.count("*").alias("rows")).drop("rows").toArrow()
    order, keys = found.column("n").to_numpy(), found.column("key").to_numpy().view(np.uint64)
    counts = np.stack([found.column(f"c{j}").to_numpy() for j in range(len(langs))], axis=1) if langs else np.zeros((0, 0))
    sorted_keys, scores = [], []
    for n in range(longest + 1):
        at = np.flatnonzero(order == n)
        at = at[np.argsort(keys[at])]
        c = counts[at]
        p = np.log((c + SMOOTHING) / (c.sum(axis=0) + SMOOTHING * max(1, at.size)))
        if at.size:
            p -= p.max(axis=1, keepdims=True)
            p -= np.log(np.exp(p).sum(axis=1, keepdims=True))
        sorted_keys.append(keys[at])
        scores.append(p.astype(np.float32))
    return Model(langs, sorted_keys, scores)


def _signed(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode())
    return h - (1 << 64) if h >> 63 else h


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)``, a row for each row of ``docs``; the id is only carried along.

    ``und`` with score 0 for null text or text without a letter; of equally
    likely languages the first in alphabetical order.  Null ids and repeated rows
    are kept; other columns are not read.  The model has a bounded
    size (see :func:`fit`) and is broadcast.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def rows(batches):
        scorer = _scorer(shipped)
        for batch in batches:
            langs, scores = zip(*scorer.predict(batch.column(1).to_pylist()), strict=True) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema=schema)

    return doc_text(docs, id_col, text_col).mapInArrow(rows, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", min_score: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all their columns, whose language is identified with at least ``min_score``.

    Rows with null text or text without a letter go.  A filter over the scan,
    without a shuffle or join; no column but the text is looked at.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    place = docs.columns.index(text_col)

    def keep(batches):
        scorer = _scorer(shipped)
        for batch in batches:
            found = scorer.predict(batch.column(place).to_pylist())
            yield batch.filter(pa.array([lang != UNKNOWN and score >= min_score for lang, score in found], pa.bool_()))

    return small_batches(docs).mapInArrow(keep, docs.schema)


def _scorer(shipped) -> Scorer:
    data = shipped.value
    return held(("language", hashlib.sha256(data).digest()), lambda: Scorer(pickle.loads(data)))
