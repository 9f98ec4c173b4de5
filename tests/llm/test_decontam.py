import random

from tests.llm.helpers import clashing, docs, rows_of
from vigilspark.llm.decontam import _common_runs, contamination, least_seeds, tiles, word_hashes


def naive_tiles(p, t, least):
    """Greedy string tiling as first published: scan for the longest unmarked match again and again."""
    mp, mt, out = [False] * len(p), [False] * len(t), []
    while True:
        best = None
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and not mp[i + n] and not mt[j + n]:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (i, j, n)
        if best is None:
            return out
        i, j, n = best
        for k in range(n):
            mp[i + k] = mt[j + k] = True
        out.append(best)


def test_tiles_equal_naive_tiling():
    rng = random.Random(3)
    for _ in range(120):
        p = [rng.randrange(4) for _ in range(rng.randrange(30))]
        t = [rng.randrange(4) for _ in range(rng.randrange(50))]
        a, b = (word_hashes(" ".join(map(str, x))) for x in (p, t))
        assert tiles(a, b, 3) == naive_tiles(p, t, 3)


def test_runs_by_diagonal_equal_runs_by_sorting():
    rng = random.Random(8)
    for _ in range(60):
        a, b = (word_hashes(" ".join(str(rng.randrange(3)) for _ in range(rng.randrange(1, 40)))) for _ in range(2))
        one, two = (sorted(zip(*(x.tolist() for x in _common_runs(a, b, most)))) for most in (10**6, 0))
        assert one == two
    again = word_hashes("same " * 3000)
    assert tiles(again, word_hashes("same " * 9000), 5)[0][2] == 3000


WORDS = [f"w{k}" for k in range(40)]
ITEMS = [(1, " ".join(WORDS)), (2, "just four short words"), (3, None), (4, ""), (5, " ".join(f"v{k}" for k in range(30)))]


def bench(spark, items=ITEMS):
    return spark.createDataFrame(items, "item_id long, text string")


def test_contained_items_are_found(spark):
    pad = " ".join(f"pad{k}" for k in range(50))
    whole = f"{pad} {' '.join(WORDS).upper()}! {pad}"
    moved = f"{' '.join(WORDS[20:])} {pad} {' '.join(WORDS[:20])}"
    half = f"{' '.join(WORDS[:20])} {pad}"
    scattered = " x ".join(" ".join(WORDS[k : k + 4]) for k in range(0, 40, 4))
    rows = [(1, whole, None, None), (2, moved, None, None), (3, half, None, None), (4, scattered, None, None), (5, "so just four short words here", None, None), (6, None, None, None), (7, "", None, None), (None, whole, None, None), (1, whole, None, None)]
    got = rows_of(contamination(docs(spark, rows), bench(spark)), "doc_id", "item_id", "n_tiles", "covered")
    assert got == [(1, 1, 1, 40), (1, 1, 1, 40), (2, 1, 2, 40), (5, 2, 1, 4), (None, 1, 1, 40)]
    assert contamination(docs(spark, []), bench(spark)).count() == 0
    assert contamination(docs(spark, rows), bench(spark, [])).count() == 0
    assert contamination(clashing(spark), bench(spark)).count() == 0


def test_threshold_and_saturated_bitmap(spark):
    """With a bitmap of 2^15 bits that is nearly full the join alone must give the same result."""
    items = ITEMS + [(100 + k, " ".join(f"f{k}x{j}" for j in range(60))) for k in range(900)]
    text = " ".join(WORDS[:33])
    rows = [(1, text, None, None), (2, " ".join(WORDS[:31]), None, None), (3, " ".join(f"f7x{j}" for j in range(5, 60)), None, None)]
    for bits in (15, 22):
        got = rows_of(contamination(docs(spark, rows), bench(spark, items), filter_bits=bits), "doc_id", "item_id", "covered")
        assert got == [(1, 1, 33), (3, 107, 55)]


def test_least_seeds_never_exceeds_what_tiles_share():
    """Any tiling that reaches the threshold holds at least the required number of seeds."""
    rng = random.Random(6)
    for _ in range(300):
        m = rng.randrange(5, 60)
        lengths, total = [], 0
        while total < 0.8 * m:
            n = rng.randrange(5, 12)
            lengths.append(n)
            total += n
        assert sum(n - 4 for n in lengths) >= least_seeds(m, 5, 0.8)
    assert least_seeds(5, 5, 0.8) == 1 and least_seeds(40, 5, 0.8) == 7


def test_equals_tiling_every_pair(spark):
    """Documents of reordered and diluted items, long ones too, against tiling of all pairs."""
    rng = random.Random(11)
    items = [(k, " ".join(f"t{rng.randrange(30)}" for _ in range(rng.randrange(3, 45)))) for k in range(25)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            words = rng.choice(items)[1].split()
            cut = rng.randrange(len(words))
            parts += rng.choice([words, words[cut:] + words[:cut], words[: len(words) * 9 // 10], words[::2]])
            parts += [f"pad{rng.randrange(50)}" for _ in range(rng.choice([0, 3, 2000]))]
        rows.append((i, " ".join(parts), None, None))
    want = []
    for i, text, *_ in rows:
        for item, pattern in items:
            p = word_hashes(pattern)
            covered = sum(n for _, _, n in tiles(p, word_hashes(text), min(5, p.size)))
            if covered and covered >= 0.8 * p.size:
                want.append((i, item, covered))
    assert len(want) > 20
    order = lambda r: tuple((v is None, str(v)) for v in r)
    assert rows_of(contamination(docs(spark, rows), bench(spark, items)), "doc_id", "item_id", "covered") == sorted(want, key=order)
