import random

import pytest

sentencepiece = pytest.importorskip("sentencepiece")
public_tokenizers = pytest.importorskip("public_tokenizers")

from tidemark.llm.sentencepiece_bpe import decode, encode, encode_decode, load  # noqa: E402

MODEL = public_tokenizers.path("piece_bpe_32k.model")
CASES = ["", " ", "  ", "   a", "  a  b ", "a\tb\nc\n\n d", "ＡＢ é é \x00x", "▁a", "▁", "a▁▁b", "hello \U0001f600\U0001f600 z​", "a ", "<s> </s> <unk> <0x0A>",
         "中文 Жз \U00010348\U0001f469‍\U0001f680", "1234567 -- ###", "x" * 500, "ab" * 700, " " * 300 + "x", " " * 1000, "\n" * 50, " \n  \n", "naïve cafés “quoted”"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.mark.parametrize("text", CASES)
def test_equals_the_library(library, text):
    bpe = load(MODEL)
    ids = bpe.encode(text)
    assert ids == library.encode(text)
    assert bpe.decode(ids) == library.decode(ids)


def test_random_texts_equal_the_library(library):
    bpe, rng = load(MODEL), random.Random(3)
    parts = bpe.pieces[259:] + [" ", "  ", "\n", "é", "\U0001f600", "▁", "zz", "THE", "0"]
    for _ in range(3000):
        text = "".join(rng.choice(parts).replace("▁", rng.choice([" ", "▁", ""])) for _ in range(rng.randint(1, 12)))
        ids = bpe.encode(text)
        assert ids == library.encode(text), text
        assert bpe.decode(ids) == library.decode(ids)


def test_any_ids_decode_as_the_library_does(library):
    bpe, rng = load(MODEL), random.Random(4)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(3, 32000)]) for _ in range(rng.randint(1, 9))]
        assert bpe.decode(ids) == library.decode(ids), ids


def test_rows(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(CASES)] + [(None, None, "x"), (0, "again", "x"), (0, "again", "x"), (99, "long word " * 20_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = decode(encode(df, MODEL), MODEL).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted([(r.id, r.text) for r in got], key=key) == sorted([(r[0], library.decode(library.encode(r[1] or ""))) for r in rows], key=key)
    assert {(r.id, tuple(r.ids)) for r in got if r.id} == {(r[0], tuple(library.encode(r[1]))) for r in rows if r[0]}
    both = encode_decode(df, MODEL).collect()
    assert sorted([(r.id, tuple(r.ids), r.text) for r in both], key=str) == sorted([(r.id, tuple(r.ids), r.text) for r in got], key=str)
    assert encode(df.limit(0), MODEL).collect() == [] == encode_decode(df.limit(0), MODEL).collect()
