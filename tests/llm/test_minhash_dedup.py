import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import graph, minhash_dedup as M


def sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    own = [(i, sets(t)) for i, t in rows]
    root = list(range(len(own)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(own)):
        for b in range(a):
            n = len(own[a][1] & own[b][1])
            if n and 100 * n >= 85 * (len(own[a][1]) + len(own[b][1]) - n):
                root[find(a)] = find(b)
    key = lambda i: (i is None, i or 0)
    least = {}
    for a, (i, _) in enumerate(own):
        r = find(a)
        least[r] = min(least.get(r, i), i, key=key)
    return sorted(((i, len(s), least[find(a)], i == least[find(a)]) for a, (i, s) in enumerate(own)), key=lambda r: (key(r[0]), str(r)))


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, key string").repartition(5)
    got = [tuple(r) for r in M.near_duplicates(df, **options).collect()]
    return sorted(got, key=lambda r: ((r[0] is None, r[0] or 0), str(r)))


def varied(rng, base, edits):
    words = list(base)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return words


def documents(seed, groups, size, length=120):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"g{g}x{rng.randrange(50)}" for _ in range(length)]
        for _ in range(size):
            rows.append(" ".join(varied(rng, base, rng.choice([0, 0, 1, 1, 2, 3, 5, 9]))))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_components_equal_brute_force(spark):
    rows = documents(1, 12, 25)
    passage = " ".join(f"common{i}" for i in range(60))
    rows += [(1000 + i, f"{t[:200]} {passage} tail{i}") for i, t in rows[:60]]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("leaf, depth", [(20, 12), (20, 1), (8, 2)])
def test_large_nodes_equal_brute_force(spark, leaf, depth):
    rows = documents(2, 2, 120)
    tight = [f"t{i}" for i in range(400)]
    rows += [(5000 + i, " ".join([*tight, f"only{i}"])) for i in range(60)]
    assert run(spark, rows, leaf=leaf, depth=depth) == brute(rows)


def test_recall_of_links_in_large_nodes(spark):
    """Pairs just above the threshold whose only path is their own link, all in one node of common words."""
    rng, rows = random.Random(11), []
    common = [f"c{i}" for i in range(30)]
    for g in range(150):
        own = [f"g{g}x{i}" for i in range(34)]
        at = rng.randrange(6, 28)  # 65 shingles each, 5 of which differ: 60 of 70 are shared, 0.857
        copy = [*own[:at], "edit", *own[at + 1 :], *(f"g{g}y{i}" for i in range(5))]
        rows += [" ".join(common + own + [f"g{g}y{i}" for i in range(5)]), " ".join(common + copy)]
    rows = list(enumerate(rows))
    want = brute(rows)
    assert sum(not r[3] for r in want) == 150
    for leaf in (4000, 30, 12):
        assert run(spark, rows, leaf=leaf) == want


def test_odd_rows(spark):
    long = " ".join(f"l{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  B"), (6, "a"), (7, "a b c d e"), (8, "a b c d e"), (8, "a b c d e"), (None, "a b c d e"), (None, "q"), (None, "q"), (9, long), (10, long + " more"), (11, "b a"), (12, "É b"), (13, "é b")]
    assert run(spark, rows) == brute(rows)
    assert M.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_sets_by_hand():
    value, offsets = M.shingle_sets([b"", b"a b c", b"a b c d e f", b"A b c d E f a b c d e"])
    assert np.diff(offsets).tolist() == [0, 1, 2, 6]
    assert set(value[offsets[2] : offsets[3]]) <= set(value[offsets[3] :])


def test_graph(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(300)] + [(5, 5), (None, 3), (2000, 2001), (2001, 2000)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = dict(graph.components(df).select("node", "root").collect())
    assert got == {**{i: 0 for i in range(201)}, **{i: 1000 for i in range(1000, 1300)}, 2000: 2000, 2001: 2000}
    assert graph.components(df.where(F.lit(False))).collect() == []


def test_shares_follow_the_threshold():
    assert (M.agreement(85), M.agreement(80)) == (92, 84)
    assert (M.trees(85), M.trees(80)) == (12, 15)
    assert M.branching(85) * 85 + 85 == pytest.approx(100) and M.branching(80) * 80 + 80 == pytest.approx(100)


@pytest.mark.parametrize("leaf", [4000, 20])
def test_pairs_at_80(spark, leaf):
    rng, rows = random.Random(9), []
    for g in range(100):
        base = [f"g{g}x{i}" for i in range(49)]  # one word changed: 40 of 50 shingles shared, 0.80
        rows += [" ".join(base), " ".join([*base[:20], "edit", *base[21:]])]
    rows = list(enumerate(rows))
    got = run(spark, rows, threshold=80, leaf=leaf)
    assert [r[2] for r in got] == [i - i % 2 for i, _ in rows]
    assert all(r[3] for r in run(spark, rows, leaf=leaf))
