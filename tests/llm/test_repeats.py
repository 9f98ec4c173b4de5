"""Repeated byte strings against a plain table of all strings."""

import random

import numpy as np

from tests.llm.helpers import ROWS, clashing, docs, rows_of
from vigilspark.llm import repeats as R

COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept")
LAST = 1 << 70


def brute(rows, width=50):
    low = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for s in range(len(b) - width + 1):
            string = b[s : s + width]
            low[string] = min(low.get(string, LAST), LAST if i is None else i)
    out = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - width + 1):
            if low[b[s : s + width]] < (LAST if i is None else i):
                gone[s : s + width] = b"\1" * width
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def got(df):
    rows = [tuple(bytes(r[c]) if c == "kept" else r[c] for c in COLUMNS) for r in df.collect()]
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


def passages(seed, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé \n") for _ in range(rng.randrange(2, 6)))
    shared = [" ".join(word() for _ in range(rng.randrange(8, 60))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rng.randrange(30))) for _ in range(3)]
        for _ in range(rng.randrange(4)):
            text = rng.choice(shared)
            cut = rng.randrange(len(text) // 2 + 1)
            parts.insert(rng.randrange(len(parts) + 1), text[cut : cut + rng.randrange(20, 200)])
        rows.append((i if i % 17 else None, "".join(parts), None, None))
    return rows + [(300, "z" * 500, None, None), (301, "y" + "z" * 130, None, None), (302, "ab" * 200, None, None), (299, "ab" * 40, None, None), (303, "\0" * 200 + "q", None, None), (304, "\0" * 120, None, None), (305, None, None, None)]


def test_repeats_equal_table_of_strings(spark):
    rows = passages(1)
    want = brute(rows)
    assert got(R.without_repeats(docs(spark, rows))) == want
    assert got(R.without_repeats(docs(spark, rows).repartition(9), most_classes=2)) == want  # nearly all anchors are split
    assert sum(r[2] > 0 for r in want) > 50 and sum(r[3] > 1 for r in want) > 10


def test_other_widths(spark):
    rows = passages(2, 60)
    for width in (24, 100):
        assert got(R.without_repeats(docs(spark, rows), width=width)) == brute(rows, width)


def test_awkward_rows(spark):
    want = brute(ROWS)
    assert got(R.without_repeats(docs(spark))) == want
    assert got(R.without_repeats(clashing(spark))) == want
    assert R.without_repeats(docs(spark, [])).count() == 0


def test_hot_passage_and_copies(spark):
    rng = random.Random(3)
    shared = "A passage of well over fifty bytes that every one of the documents holds. "
    rows = [(i, f"{rng.random()} {shared}{rng.random()}", None, None) for i in range(300)] + [(i, "copy " * 40, None, None) for i in range(400, 500)]
    assert got(R.without_repeats(docs(spark, rows))) == brute(rows)


def test_blocks_of_long_texts_overlap(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(R, "BLOCK_BYTES", 200)
    rng = random.Random(4)
    texts = [bytes(rng.choice(b"abcd ") for _ in range(n)) for n in (0, 49, 50, 1000, 30, 199, 250, 600)]
    batch = pa.record_batch([pa.array(texts, pa.binary())], ["text"])
    strings = []
    for row, shift, block in R._blocks(batch, 0, 50):
        found = R.contexts(*block, 50)
        for t, start, n in zip(found["text"], found["start"], found["n"]):
            strings += [(row + t, shift + start + k) for k in range(abs(n))]
    assert sorted(strings) == [(t, s) for t, x in enumerate(texts) for s in range(len(x) - 49)]


def test_interval_tree_gives_maximal_repeats():
    rng = random.Random(5)
    for _ in range(60):
        width = 3
        texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(3, 14))) for _ in range(rng.randrange(1, 6))]
        strings = np.array([len(t) - width + 1 for t in texts])
        ids = np.arange(len(texts))
        order, common, text, offset, before = R.suffix_array(texts, strings, width)
        found = {}
        for length, first, last, low in R.maximal_repeats(order, common, before, ids[text], width):
            rows = order[first : last + 1]
            places = {(int(text[x]), int(offset[x])) for x in rows}
            (string,) = {texts[t][o : o + length] for t, o in places}
            assert string not in found and low == min(t for t, _ in places)
            found[string] = places
        want = {}
        for t, x in enumerate(texts):
            for a in range(len(x)):
                for b in range(a + width, len(x) + 1):
                    want.setdefault(x[a:b], set()).add((t, a))
        maximal = {}
        for string, places in want.items():
            left = {texts[t][o - 1] if o else None for t, o in places}
            right = {texts[t][o + len(string) : o + len(string) + 1] or None for t, o in places}
            if len(places) > 1 and (len(left) > 1 or None in left) and (len(right) > 1 or None in right):
                maximal[string] = places
        assert found == maximal
