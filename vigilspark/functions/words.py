"""Many fixed words in one pass over a text: an Aho-Corasick automaton behind an Arrow function (JN-17, JN-18, DM-17)."""

from __future__ import annotations

from collections.abc import Callable

import ahocorasick
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def automaton(words: list[str]) -> ahocorasick.Automaton:
    """Finds ``(last position, number of the word)`` of every occurrence; the empty word is left out."""
    found = ahocorasick.Automaton()
    numbers: dict[str, list[int]] = {}
    for k, word in enumerate(words):
        if word:
            numbers.setdefault(word, []).append(k)
    for word, ks in numbers.items():
        found.add_word(word, ks)
    if numbers:
        found.make_automaton()
    return found


def word_numbers(words: list[str]) -> Callable[[Column], Column]:
    """A function from a text column to the sorted distinct numbers of the words that occur in it as plain substrings.

    The list is fixed and small (it travels with the function).  Null text gives an
    empty array; the empty word occurs in every other text; a word that stands
    twice in the list has both numbers.
    """
    empty = [k for k, word in enumerate(words) if not word]

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def numbers(texts: pd.Series) -> pd.Series:
        search = automaton(words)
        if not len(search):
            return texts.map(lambda t: [] if t is None else empty)
        return texts.map(lambda t: [] if t is None else sorted({k for _, ks in search.iter(t) for k in ks}.union(empty)))

    return numbers


def weighted_classes(hits: Column, classes: list[int], weights: list[float], n: int) -> Column:
    """Sums of the weights of the words in ``hits`` (numbers of words) by their class 0..n-1, as an array."""
    kind = F.array(*[F.lit(c) for c in classes])
    weight = F.array(*[F.lit(float(w)) for w in weights])
    total = lambda c: F.aggregate(hits, F.lit(0.0), lambda s, h: s + F.when(F.get(kind, h) == c, F.get(weight, h)).otherwise(0.0))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), total)
