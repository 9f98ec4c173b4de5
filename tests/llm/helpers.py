"""Small tables with the awkward rows every operator must take."""

from __future__ import annotations

DOC = "doc_id long, text string, lang string, source string, n_chars long"

#: A table that also has columns named like what operators return.
CLASH = (
    "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, fingerprint int, id string, fp string, "
    "component string, row long, block string, k string, score string, carried string, node int, drops string"
)

LONG_WORD = "x" * 60_000
LONG_TEXT = " ".join(f"word{i % 977} und{i % 13}" for i in range(15_000))

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog.\nSecond line here, long enough.\nshort", "en", "a"),
    (2, "the quick brown fox jumps over the lazy dog.\n\nAnother line of some length", "en", "a"),
    (3, None, None, None),
    (4, "", "en", "b"),
    (5, " \t\n  ", None, "b"),
    (None, "The quick brown fox jumps over the lazy dog.\na line of a row without id", "en", None),
    (7, LONG_WORD, "de", "c"),
    (8, LONG_TEXT, "de", "c"),
    (9, "Ünïcödé ÀÉ straße 中文 \U0001f600 <|endoftext|> tail  \n end", "de", "a"),
    (9, "Ünïcödé ÀÉ straße 中文 \U0001f600 <|endoftext|> tail  \n end", "de", "a"),
    (10, "12345 !!! 67 ... ???", None, "a"),
    (11, "one two", "en", "a"),
    (12, "one two", "en", "a"),
]


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], DOC)


def clashing(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, lang, s, 0, "z", 1, "z", "z", "z", 1, "z", "z", "z", "z", 1, "z") for i, t, lang, s in rows], CLASH)


def rows_of(df, *columns):
    order = lambda r: tuple((v is None, str(v)) for v in r)
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=order)
