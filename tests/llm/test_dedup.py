import random
from itertools import combinations

import numpy as np
import xxhash

from tests.llm.helpers import ROWS, clashing, docs, rows_of
from vigilspark.llm.line_dedup import line_dedup
from vigilspark.llm.simhash import _spanning_links, covering_positions, fingerprint, similar_fingerprints, simhash_components, tally
from vigilspark.operators.components import connected_components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = " \t\n\x0b\x0c\r"


def brute_lines(rows, min_docs=2):
    last = 1 << 70
    held = {}
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            key = line.strip(SPACE).translate(LOW)
            if len(key) >= 10:
                held.setdefault(key, set()).add(last if i is None else i)
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        keys = [x.strip(SPACE).translate(LOW) for x in lines]
        me = last if i is None else i
        kept = [x for x, k in zip(lines, keys) if len(k) < 10 or len(held[k]) < min_docs or min(held[k]) == me]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_lines_equal_brute_force(spark):
    columns = ("doc_id", "text", "n_lines", "n_dropped")
    for min_docs in (2, 3):
        assert rows_of(line_dedup(docs(spark), min_docs=min_docs), *columns) == brute_lines(ROWS, min_docs)
    assert rows_of(line_dedup(clashing(spark)), *columns) == brute_lines(ROWS)
    assert line_dedup(docs(spark, [])).count() == 0


def test_lines_of_a_hot_line(spark):
    rng = random.Random(1)
    rows = [(i, "\n".join(["A line that everybody has ", *(f"line number {rng.randrange(30)} of some" for _ in range(5))]), None, None) for i in range(300)]
    assert rows_of(line_dedup(docs(spark, rows)), "doc_id", "text", "n_lines", "n_dropped") == brute_lines(rows)


def test_lines_carry_columns(spark):
    out = line_dedup(docs(spark), carry=("lang", "source"))
    got = rows_of(out.select("doc_id", "carried.lang", "carried.source"), "doc_id", "lang", "source")
    assert got == sorted(((i, lang, s) for i, _, lang, s in ROWS), key=lambda r: tuple((v is None, str(v)) for v in r))


def brute_print(text, width=4):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").translate(LOW)) if w]
    if not words:
        return 0
    grams = [" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, bits=4):
    parent = list(range(len(ids)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                parent[root(a)] = root(b)
    low = {}
    for k, i in enumerate(ids):
        if i is not None:
            low[root(k)] = min(low.get(root(k), i), i)
    return [low.get(root(k)) for k in range(len(ids))]


def test_fingerprint_equals_definition():
    for _, text, _, _ in ROWS:
        assert fingerprint(text or "") == brute_print(text)


def test_simhash_equals_brute_force(spark):
    rng = random.Random(5)
    rows = list(ROWS)
    for i in range(20, 60):
        words = [f"w{rng.randrange(400)}" for _ in range(120)]
        rows.append((i, " ".join(words), "en", "s"))
        for j in range(rng.randrange(3)):
            changed = list(words)
            changed[rng.randrange(120)] = "changed"
            rows.append((1000 * (j + 1) + i, " ".join(changed), "en", "s"))
    prints = [brute_print(t) for _, t, _, _ in rows]
    want = [(i, p - (1 << 64) if p >> 63 else p, c) for (i, *_), p, c in zip(rows, prints, brute_components([r[0] for r in rows], prints))]
    want.sort(key=lambda r: tuple((v is None, str(v)) for v in r))
    assert rows_of(simhash_components(docs(spark, rows)), "doc_id", "fp", "component_id") == want
    assert len({c for *_, c in want}) < len({i for i, *_ in want}) - 15
    assert simhash_components(docs(spark, [])).count() == 0
    assert simhash_components(clashing(spark)).count() == len(ROWS)


def test_index_finds_every_close_pair(spark):
    """Chains of fingerprints up to four bits apart, and a dense ball around one of them."""
    rng = random.Random(9)
    prints = set()
    for _ in range(60):
        p = rng.getrandbits(64)
        for _ in range(4):
            prints.add(p)
            for b in rng.sample(range(64), rng.choice((1, 4, 5))):
                p ^= 1 << b
    ball = rng.getrandbits(64)
    for _ in range(300):
        p = ball
        for b in rng.sample(range(64), 3):
            p ^= 1 << b
        prints.add(p)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = similar_fingerprints(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 4 for a, b in links)
    found = connected_components(spark.createDataFrame(links or [], "a long, b long"), "a", "b")
    component = dict(found.collect())
    want = brute_components(signed, prints)
    got = {}
    for p, w in zip(signed, want):
        assert got.setdefault(w, component.get(p, p)) == component.get(p, p)
    assert len(set(want)) == len({component.get(p, p) for p in signed})


def test_component_rounds(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 100), (200, 150), (150, 175), (5, 5), (3, None)]
    got = dict(connected_components(spark.createDataFrame(edges, "src long, dst long")).collect())
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 150: 150, 175: 150, 200: 150}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_chosen_positions_cover_every_minimum():
    for shared in range(1, 9):
        chosen = [set(c) for c in covering_positions(shared)]
        assert all(any(c <= set(positions) for c in chosen) for positions in combinations(range(8), shared))
    assert len(covering_positions(4)) <= 24


def test_tally_drops_pairs_below_the_minimum():
    """Of a list whose members share three bytes, only pairs with a fourth shared byte are verified."""
    base = 0x0102030405060708
    three = base ^ 0x0101010101  # five bytes differ by a bit each: below the minimum, and five bits apart
    four = base ^ 0x01010101  # four bytes differ
    far = base ^ 0xFF000000  # shares seven bytes, but eight bits differ
    prints = np.array([base, three, four, far], np.uint64)
    assert tally(prints ^ np.uint64(base)).tolist() == [8, 3, 4, 7]
    links = {(int(a), int(b)) for x, y in _spanning_links(prints[[0, 1]], 8, 4) for a, b in zip(x, y)}
    assert not links  # eight bits would do, the tally would not
    assert len(_spanning_links(prints[[0, 2]], 4, 4)) == 1 and not _spanning_links(prints[[0, 3]], 4, 4)


def test_lines_of_many_rows_without_id(spark):
    """Rows without an id are one document after all others, yet each meets only its own lines."""
    rows = [(1, "a line that all of them hold", None, None)]
    rows += [(None, f"a line that all of them hold\nonly row {k} has this line\nshared by rows {k % 3}", None, None) for k in range(200)]
    rows += [(None, "a line that all of them hold\nrepeated row without id", None, None)] * 100
    assert rows_of(line_dedup(docs(spark, rows)), "doc_id", "text", "n_lines", "n_dropped") == brute_lines(rows)
