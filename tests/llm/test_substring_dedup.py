import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import queries, substring_dedup as S


def brute(rows, window):
    own = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    seen = Counter(tuple(w[p : p + window]) for _, w in own for p in range(len(w) - window + 1))
    out = []
    for i, w in own:
        gone = set()
        for p in range(len(w) - window + 1):
            if seen[tuple(w[p : p + window])] > 1:
                gone.update(range(p, p + window))
        out.append((i, len(w), len(gone), " ".join(x for n, x in enumerate(w) if n not in gone)))
    return sorted(out, key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, key string").repartition(4)
    return sorted((tuple(r) for r in S.without_repeats(df, **options).collect()), key=str)


def test_least_seed():
    rng = np.random.default_rng(0)
    for span in (1, 2, 5, 16, 27, 31):
        x = rng.integers(0, 9, 60).astype(np.uint64)
        assert S.least_seed(x, span).tolist() == [i + int(np.argmin(x[i : i + span])) for i in range(60 - span + 1)]


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda n: f"w{rng.randrange(n)}"
    passages = [[word(30) for _ in range(rng.randint(30, 150))] for _ in range(6)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(passages)
            cut = rng.randint(0, 20)
            words += rng.choice([[word(30) for _ in range(rng.randint(1, 60))], p, p[cut:], p[: len(p) - cut], p * 2, ["same"] * rng.randint(1, 90)])
        if rng.random() < 0.3:
            words[rng.randrange(len(words))] = "edited"
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(words)))
    rows += rows[:5] + [(None, rows[7][1]), (500, rows[8][1])]
    for options in ({}, {"window": 12, "seed": 4}, {"window": 10, "seed": 10}, {"window": 16, "seed": 2}, {"window": 13, "seed": 9}):
        assert run(spark, rows, **options) == brute(rows, options.get("window", 35))


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, "a " * 34), (4, "a " * 34), (5, "b " * 35), (6, "b " * 36), (None, "q"), (7, long), (8, "start " + long[: len(long) // 2]), (9, "É é " * 40), (9, "É é " * 40), (10, " \x1c\x85 " * 40)]
    assert run(spark, rows) == brute(rows, 35)
    assert S.without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_lengths_double():
    assert S.lengths(35, 9) == [18] and S.lengths(70, 9) == [18, 36] and S.lengths(10, 10) == [] and S.lengths(20, 9) == [] and S.lengths(16, 2) == [4, 8]


def test_only_what_is_repeated_is_extended(spark):
    """A seed whose words are repeated on neither side survives the least length and not the next."""
    line = lambda i: [f"l{i % 20}x{k}" for k in range(9)]
    rows = [(i, " ".join([*(f"a{i}x{k}" for k in range(40)), *line(i), *(f"b{i}x{k}" for k in range(40))])) for i in range(200)]
    rows += [(200 + i, " ".join([f"c{i}", *(f"same{k}" for k in range(60)), f"d{i}"])) for i in range(5)]
    docs = S._keyed(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    again = S._repeated(docs, 35, 9)
    spans = again.groupBy("h", "e").agg(S.F.sum(S.F.size("pos")).alias("n"), S.F.min("key").alias("first"), S.F.first("a").alias("a"), S.F.max("hot").alias("hot"))
    left = S._extended(spans, 35, 9)
    seeds = lambda df: {r.h for r in df.select("h").distinct().collect()}
    assert seeds(left) < seeds(spans) and left.agg(S.F.max("n")).first()[0] <= 5
    assert run(spark, rows) == brute(rows, 35)


def test_hot_seeds_are_salted(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT", 12)
    line = " ".join(f"l{i}" for i in range(40))
    rows = [(i, f"a{i} b{i} {line} c{i} d{i} " + " ".join(f"r{i % 9}x{k}" for k in range(45))) for i in range(90)]
    assert run(spark, rows) == brute(rows, 35)
    again = S._repeated(S._keyed(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text"), 35, 9)
    assert 0 < again.where("hot").count() < again.count()


def test_query_equals_brute_force(spark, tmp_path):
    rows = [(i, f"a{i} " + " ".join(f"s{k}" for k in range(36 + i % 3)) + f" z{i}") for i in range(20)] + [(20, None), (21, "x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op8_substring_dedup(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(((i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in brute(rows, 35)), key=str)
