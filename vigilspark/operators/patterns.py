"""Search of many fixed strings at once (JN-4, JN-5, JN-17, JN-18, DM-17).

A list of bounded size is an Aho-Corasick automaton: one pass over a text finds
all strings of the list, however many they are.  A longer list meets the texts by
an equi join: each string is keyed by the one of its grams that fewest strings
of the list share, the texts by all their grams, and candidates are checked.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vigilspark.functions.words import automaton

#: An automaton is built of lists of at most so many characters (some 200 MB in a worker); longer ones are joined.
AUTOMATON_CHARS = 2_000_000
#: Grams that key the strings of a longer list.
GRAM = 4


def contained(texts: DataFrame, patterns: DataFrame, most_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """``(id, pattern)``: the distinct patterns that occur in each text as plain substrings.

    ``texts``: (id, text), a row for each row and pattern; ``patterns``: (pattern), nulls
    and repeats are left out.  Null texts contain nothing, the empty pattern is in
    every other text.  The list is measured first: up to ``most_chars`` characters
    it is broadcast as an automaton, beyond that :func:`contained_by_grams` joins.
    """
    listed = patterns.select("pattern").where("pattern is not null").distinct()
    size = listed.agg(F.coalesce(F.sum(F.length("pattern") + 1), F.lit(0))).first()[0]
    if size > most_chars:
        return contained_by_grams(texts, listed)
    words = sorted(r["pattern"] for r in listed.collect())
    shipped = texts.sparkSession.sparkContext.broadcast(words)
    out = T.StructType([texts.schema["id"], T.StructField("pattern", T.StringType())])
    arrow = to_arrow_schema(out)

    def search(batches):
        words = shipped.value
        found, always = automaton(words), [w for w in words if not w]
        for batch in batches:
            rows, hits = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                if text is None:
                    continue
                here = {words[k] for _, ks in found.iter(text) for k in ks} if len(found) else set()
                rows += [row] * (len(here) + len(always))
                hits += [*here, *always]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(hits, pa.string())], schema=arrow)

    return texts.select("id", "text").mapInArrow(search, out)


def _grams(text: Column, size: Column | int) -> Column:
    """Distinct grams of ``size`` characters, empty for shorter texts."""
    n = F.length(text) - size + 1
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, F.lit(size) if isinstance(size, int) else size))
    return F.when(n > 0, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def contained_by_grams(texts: DataFrame, patterns: DataFrame, gram: int = GRAM) -> DataFrame:
    """:func:`contained` for lists of any size: an equi join on grams.

    A pattern shorter than ``gram`` is keyed by itself.  Of its grams a pattern takes
    the one that fewest patterns share, so a frequent gram of the texts meets few
    patterns; candidates are checked where the text is.
    """
    t, p = F.col("text"), F.col("pattern")
    size = F.least(F.length(p), F.lit(gram))
    grams = patterns.where(p != "").select("pattern", F.explode(_grams(p, size)).alias("gram"))
    shared = grams.groupBy("gram").agg(F.count("*").alias("n"))
    keyed = grams.join(shared, "gram").groupBy("pattern").agg(F.min(F.struct("n", "gram")).alias("rarest"))
    keyed = keyed.select("pattern", F.col("rarest.gram").alias("gram"))
    numbered = texts.where(t.isNotNull()).select("id", "text")
    # a text row is told by its id and text; equal rows are found once and meet all their copies again
    mark = F.xxhash64("id", "text")
    seen = numbered.select(mark.alias("mark"), F.explode(F.array_distinct(F.concat(*[_grams(t, k) for k in range(1, gram + 1)]))).alias("gram"))
    near = seen.join(keyed, "gram").select("mark", "pattern").distinct()
    hits = numbered.withColumn("mark", mark).join(near, "mark").where(t.contains(p)).select("id", "pattern")
    always = patterns.where(p == "").select("pattern")
    everywhere = numbered.join(F.broadcast(always.limit(1)), F.lit(True)).select("id", "pattern")
    return hits.unionByName(everywhere)
