import random
import zlib

import numpy as np

from tidemark.llm import quality


def _text(rng, good, n):
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 9))) for _ in range(n)]
    if good:
        return " ".join(words)
    return rng.choice([lambda: " ".join(w.upper() + "!!" for w in words), lambda: " ".join(w + rng.choice(["###", "$$$"]) for w in words), lambda: " | ".join(words), lambda: " ".join(w for w in words[: n // 4 + 1] for _ in range(6))])()


def test_held_out_accuracy(spark):
    rng = random.Random(5)
    y = [int(rng.random() < 0.8) for _ in range(1500)]
    docs = [(i, _text(rng, y[i], rng.randint(4, 300))) for i in range(1500)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y[i]) for i in range(1500) if i % 2] + [(7, None), (None, 1)], "doc_id long, quality int")
    got = quality.classified(df, labels).collect()
    assert len(got) == 1500 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in got)
    out = [r for r in got if r.held_out]
    assert np.mean([r.predicted == y[r.id] for r in out]) > 0.98
    kept = quality.accepted(df, labels)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {r.id for r in got if r.predicted}


def test_held_out_labels_teach_nothing(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * (i + 1)) for i in range(60)], "doc_id long, text string")
    out = {i for i in range(60) if zlib.crc32(str(i).encode()) % 3 == 1}
    one = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    two = spark.createDataFrame([(i, 1 - i % 2 if i in out else i % 2) for i in range(60)], "doc_id long, quality int")
    score = lambda y: sorted((r.id, r.score) for r in quality.classified(docs, y).collect())
    assert np.allclose(score(one), score(two))


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a b", "x"), (3, " \n ", "x"), (4, "w" * 100_000, "x"), (5, "very long " * 100_000, "x"), (5, "very long " * 100_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.classified(df, none).collect()
    assert len(got) == 7 and {r.score for r in got} == {0.5}
    single = spark.createDataFrame([(5, 1), (2, 1), (3, 1), (4, 1)], "doc_id long, quality int")
    assert all(r.predicted == 1 for r in quality.classified(df, single).collect())
    assert quality.classified(df.limit(0), single).collect() == []


def test_statistics_by_hand():
    x = quality.statistics([b"", b"AB cd cd !!"])
    assert np.isfinite(x).all() and x.shape == (2, len(quality.FEATURES))
    at = quality.FEATURES.index
    assert np.isclose(x[1, at("upper")], np.arcsin(np.sqrt(2 / 46))) and np.isclose(x[1, at("repeats")], np.arcsin(np.sqrt(1 / 12)))
    assert np.isclose(x[1, at("bangs")], np.arcsin(np.sqrt(1 / 12))) and np.isclose(x[1, at("distinct")], np.log(4 / 3))
