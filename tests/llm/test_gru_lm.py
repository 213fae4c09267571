import math
import os
import random
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import gru_lm as G, queries


def brute(rows):
    tokens = lambda t: [*(t or "").encode().lower().split(), G.END]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(x for i, t in rows if not held(i) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    return sorted(((i, held(i), len(x := tokens(t)), sum(c[w] > 0 for w in x), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x)) for i, t in rows), key=str)


def corpus(seed, n):
    rng, rows = random.Random(seed), []
    for i in range(n):
        letters = "abcde" if i % 2 else "vwxyz"
        rows.append((i, " ".join("".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 2, 3, 6]))) for _ in range(rng.randint(0, 120)))))
    return rows


def check(got, want):
    got = sorted((tuple(r) for r in got), key=str)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5]
        assert math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9)


def test_counts_equal_brute_force_and_score_is_better(spark):
    rows = corpus(1, 600)
    rows += [(None, rows[3][1]), (700, rows[5][1]), (5, rows[5][1]), (701, "Never-seen ÄÖ ÄÖ " * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for options in ({}, {"known": 50, "head": 20}):
        got = G.language_scores(df, **options).collect()
        check(got, brute(rows))
        out = [r for r in got if r.held_out]
        assert sum(r.score for r in out) > sum(r.base_score for r in out) + 0.02 * sum(r.n_tokens for r in out)


def test_words_beyond_the_most_frequent_thousand_are_learnt_from_their_context():
    """Words of 20 topics, each rarer than 1,030 words that are in all texts alike; the query's own layers."""
    rng = random.Random(1)
    texts = [[*(b"c%dq" % rng.randrange(1030) if rng.random() < 0.7 else b"t%d" % (i % 20 * 40 + rng.randrange(40)) for _ in range(60)), G.END] for i in range(3200)]
    count = Counter(w for t in texts[200:] for w in t)
    n, v = sum(count.values()), len(count)

    def vocabulary(tail):
        tokens, words = np.zeros(G.TAIL), np.zeros(G.TAIL)
        for w in tail:
            tokens[G.tail_class(w)] += count[w]
            words[G.tail_class(w)] += 1
        return G.Vocabulary(list(count.items()), tokens, words, n, v)

    first = vocabulary(count)
    voc = vocabulary([w for w in count if first.number[w] >= first.size])
    net = G.Gru(voc.classes, (voc.head_mass, voc.tail_mass))
    net.learn([voc.read(t)[1] for t in texts[200:]], voc.end)
    out = [voc.read(t) for t in texts[:200]]
    score = net.score([token for _, token in out], voc.end).sum() / math.log(10) + sum(voc.within[number].sum() for number, _ in out)
    base = sum(math.log10((count[w] + 1) / (n + v + 1)) for t in texts[:200] for w in t)
    assert score > base + 0.03 * sum(map(len, texts[:200]))


def model(seed=0):
    rng = np.random.default_rng(seed)
    voc = G.Vocabulary([(b"w%d" % i, 100 - i) for i in range(70)] + [(G.END, 9)], np.full(G.TAIL, 50.0), np.full(G.TAIL, 9.0), 5000, 400, head=40)
    g = G.Gru(voc.classes, (voc.head_mass, voc.tail_mass), hidden=5)
    for k in ("wc", "ww", "u", "x"):
        g.p[k] = rng.normal(0, 0.4, g.p[k].shape)
    g.p = {k: v.astype(np.float64) for k, v in g.p.items()}
    return voc, g


def test_probabilities_sum_to_one():
    voc, g = model()
    state = np.random.default_rng(1).normal(size=(3, 5))
    every = [t for t in range(voc.size)] + [voc.classes * G.CLASS + k for k in range(G.TAIL)]
    for s in state:
        got, _ = g.output(np.repeat(s[None], len(every), 0), np.array(every))
        assert math.isclose(np.exp(got).sum(), 1, abs_tol=1e-5)


def test_scores_do_not_depend_on_batches_or_windows():
    voc, g = model()
    rng = np.random.default_rng(2)
    texts = [np.append(rng.integers(0, voc.size, n), voc.end) for n in (0, 1, 5, 40, 131, 40)]
    whole = g.score(texts, voc.end)
    assert np.allclose(whole, [g.score([t], voc.end, window=w)[0] for t, w in zip(texts, (1, 7, 3, 32, 50, 200))])


def test_long_texts_of_several_batches_are_scored_side_by_side(monkeypatch):
    """Five batches with one long text each take the steps of one, and the scores of each text alone."""
    rng = np.random.default_rng(5)
    texts = [[b" ".join(b"w%d" % k for k in rng.integers(0, 90, n)) for n in (400 - b, 3, 0, 20)] for b in range(5)]
    voc, g = model()
    read = [[voc.read([*G.words_of(t), G.END]) for t in own] for own in texts]
    within = [[voc.within[number[number >= 0]].sum() for number, _ in own] for own in read]
    batches = []
    for b, own in enumerate(read):
        columns = [range(4 * b, 4 * b + 4), [b"k"] * 4, [False] * 4, [len(x) for _, x in own], [0] * 4, [0.0] * 4, within[b], [0] * 4, [x.astype(voc.kind).tobytes() for _, x in own]]
        batches.append(pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [*G._SCORED, "tokens"]))
    steps, step = [], g.step
    monkeypatch.setattr(g, "step", lambda *a: steps.append(1) or step(*a))

    class Docs:
        """What a Spark table would hand to one worker."""

        schema = [SimpleNamespace(name=c, dataType=SimpleNamespace(simpleString=lambda: "long")) for c in G._SCORED]
        sparkSession = property(lambda self: self)
        sparkContext, broadcast = sparkSession, lambda self, value: SimpleNamespace(value=value)
        select, mapInArrow = lambda self, *names: self, lambda self, run, schema: list(run(iter(batches)))

    got = [r for b in G._scored(Docs(), voc, g) for r in b.to_pylist()]
    assert [r["id"] for r in got] == list(range(20)) and len(steps) < 600
    for r, (_, token), known in zip(got, sum(read, []), sum(within, []), strict=True):
        assert r["n_tokens"] == len(token)
        assert math.isclose(r["score"], known + g.score([token], voc.end)[0] / math.log(10), rel_tol=1e-6)


def test_gradients(monkeypatch):
    voc, g = model()
    rng = np.random.default_rng(3)
    texts = [np.append(rng.integers(0, voc.size, n), voc.end) for n in (6, 4)]
    tokens = sum(map(len, texts))
    for name, at in (("u", (1, 3)), ("u", (2, 12)), ("x", (int(texts[0][2]), 7)), ("wc", (3, 1)), ("ww", (0, 4, 2)), ("bw", (0, 5)), ("bc", (1,))):
        up, down = (model()[1] for _ in range(2))
        up.p[name][at] += 1e-5
        down.p[name][at] -= 1e-5
        want = (up.score(texts, voc.end).sum() - down.score(texts, voc.end).sum()) / 2e-5
        own = model()[1]
        own.squares = {k: np.zeros(v.shape) for k, v in own.p.items()}
        before = own.squares[name]
        own.learn(texts, voc.end, lanes=2, window=16, rate=0)
        assert math.isclose(math.sqrt(before[at]) * math.sqrt(tokens), abs(want), rel_tol=1e-3, abs_tol=1e-6), name


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a"), (3, "x" * 100_000 + " y"), (4, "long " * 30_000), (4, "long " * 30_000), (5, "É é q")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")
    check(G.language_scores(df).collect(), brute(rows))
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    none = spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")
    got = G.language_scores(none).collect()
    assert all(r.held_out and r.train_tokens == 0 and r.base_score == 0 and np.isfinite(r.score) for r in got) and len(got) == 3
    assert G.language_scores(df.limit(0)).collect() == []


def test_every_training_text_is_learnt_from_in_rounds(spark, monkeypatch):
    """Each text changes the weights, whatever replica and round it is dealt to."""
    rows = corpus(4, 40)
    docs = G._docs(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 7, 2)
    voc = G.vocabulary(G.token_counts(docs.where("not held_out")))
    monkeypatch.setattr(G, "REPLICA", voc.tokens // 3)
    seen = []
    learn = G._combined
    monkeypatch.setattr(G, "_combined", lambda parts, by, n: (seen.append(parts) if by == "replica" else None) or learn(parts, by, n))
    start = G.Gru(voc.classes, (voc.head_mass, voc.tail_mass)).flat()
    assert not np.allclose(G.fitted(docs, voc).flat(), start)
    parts = [p.select("replica", "tokens").distinct().collect() for p in seen]
    assert len(parts) == G.ROUNDS and sum(r.tokens for p in parts for r in p) == voc.tokens
    assert all(len({r.replica for r in p}) == len(p) for p in parts) and {r.replica for p in parts for r in p} == {0, 1, 2}


def test_averaged_replicas_are_better_than_counts(spark, monkeypatch):
    monkeypatch.setattr(G, "REPLICA", 6000)
    df = spark.createDataFrame(corpus(6, 1200), "doc_id long, text string")
    out = [r for r in G.language_scores(df).collect() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) + 0.02 * sum(r.n_tokens for r in out)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_query_is_better_than_counts(spark, sf):
    at = f"/root/testdata/{sf}"
    if not os.path.isdir(at):
        pytest.skip("no test data")
    got = queries.op7_gru_lm(spark, at)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    sums = got.where("held_out").agg(G.F.sum("score"), G.F.sum("base_score"), G.F.sum("n_tokens")).first()
    assert sums[0] > sums[1] + 0.2 * sums[2]
