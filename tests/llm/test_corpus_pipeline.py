import random

import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline  # noqa: E402
from test_exact_dedup import brute as exact  # noqa: E402
from test_minhash_dedup import brute as near  # noqa: E402
from test_mixing import targets  # noqa: E402


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("etaoinsr") for _ in range(rng.randint(2, 8)))
    rows, labels = [], []
    for i in range(400):
        words, good = [word() for _ in range(rng.randint(30, 120))], i % 5 > 0
        if i > 50 and i % 10 == 1:
            words = rows[i - 31][1].split()
            good = labels[i - 31][1]
            if i % 20 == 1:
                words[rng.randrange(len(words))] = "edit"
        text = " ".join(words) if good else " ".join(w.upper().rstrip("!") + "!!" for w in words)
        rows.append((i, text, "en", f"s{i % 4}" if i % 3 else "s0", len(text)))
        labels.append((i, int(good)))
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([x for x in labels if x[0] % 2], "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
    return at, rows, {i for i, good in labels if good}


def test_stages_equal_brute_force(spark, tables):
    at, rows, good = tables
    docs = spark.read.parquet(f"{at}/documents.parquet")
    frames = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, at).collect(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        frames.append([(r.doc_id, r.text) for r in docs.collect()])
    assert {i for i, _ in frames[0]} == good and len(frames[0]) == len(good)
    assert {i for i, _ in frames[1]} == {r[0] for r in exact(frames[0]) if r[3]} and len(frames[1]) == len(set(frames[1]))
    assert sorted(i for i, _ in frames[2]) == [r[0] for r in near(frames[1]) if r[3]]
    source = {r[0]: r[3] for r in rows}
    size = lambda s, f: sum(len(t.split()) for i, t in f if source[i] == s)
    names = sorted({source[i] for i, _ in frames[2]})
    for s, target in targets({s: size(s, frames[2]) for s in names}).items():
        assert 0 <= target - size(s, frames[3]) < 1 + 1e-6
    last = corpus_pipeline.STAGES[-1][1](spark, docs, at).collect()
    assert sorted(r.doc_id for r in last) == sorted(i for i, _ in frames[3]) and all(r.n_tokens == len(r.ids) > 0 for r in last)


def test_run_is_the_stages(spark, tables):
    at, _, good = tables
    got = corpus_pipeline.run(spark, at)
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
    assert {r.doc_id for r in got.collect()} <= good


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "a b c d e f", "en", None, 11), (3, "same text here now five six", "en", "a", 27), (3, "same text here now five six", "en", "a", 27), (4, "Same  text here now five six", "en", "b", 28), (5, "long words " * 60_000, "en", "b", 1), (6, " \n ", None, "a", 3)]
    at = str(tmp_path)
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string, size double")
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(3, 1), (None, 0), (5, None)], "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, at).collect(), docs.schema)
        assert docs.columns == columns
    assert {r.doc_id for r in docs.collect()} <= {None, 3, 4, 5}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, at).count() == docs.count()


def test_near_stage_drops_copies_between_80_and_85(spark, tmp_path):
    rng, rows = random.Random(5), []
    for g in range(150):
        words = [f"g{g}x{i}" for i in range(104 + g % 20)]  # n shingles of 100 to 119, of which 10 or 11 are not the copy's
        copy = [*words]
        for at in rng.sample(range(10, 90, 10), 2):
            copy[at] = "edit"
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(copy))]
    sets = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    both = [(sets(a), sets(b)) for (_, a), (_, b) in zip(rows[::2], rows[1::2])]
    assert all(0.80 <= len(a & b) / len(a | b) < 0.85 for a, b in both)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in corpus_pipeline.near_stage(spark, docs, str(tmp_path)).collect()}
    assert got == {i for i, _ in rows[::2]}


def test_near_stage_drops_rows_not_ids(spark, tmp_path):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (3, a + " more"), (3, b), (4, b + " more"), (None, b + " else"), (None, None), (7, ""), (8, a.replace("a30", "x") + " y"), (8, "c d")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "clash") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, digest string")
    got = corpus_pipeline.near_stage(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, a), (3, b), (None, None), (7, ""), (8, "c d")], key=str)
    same = spark.createDataFrame([(1, a, "en", "s", 1), (1, a + " more", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.near_stage(spark, same, str(tmp_path)).count() == 1
