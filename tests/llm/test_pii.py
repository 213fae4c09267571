import random
import re

import pytest

from tidemark.llm import pii

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def _luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def _passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": lambda: True, "ip": lambda: all(len(x.lstrip("0")) < 4 and int(x[-4:]) <= 255 for x in value.split(".")), "card": lambda: 14 <= len(digits) <= 19 and _luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}[kind]()


def base(text):
    out = [(m.start(), i, m.end(), k) for i, (k, r) in enumerate(PLAIN.items()) for m in r.finditer(text or "") if _passes(k, m.group())]
    return sorted(out)


def run(spark, texts):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, found string")
    return {r.doc_id: r.found for r in pii.found(df).collect()}


CASES = [
    None, "", "a@b.c", "a@b.c@d.e", "x a@b.com_x@y.z q", "a.b+c%d-e_f@g-h.i.j.", "@a.b", "a@b", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.255 000001.0.0.0255 0000.00.0.0", "1..2.3.4",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111112", "card 4111  1111 1111 1111", "37828224631000 5 378282246310005", "6304 0000 0000 0000 000", "+1 (171) 555-2028", "+1 555", "+49 30 (1234) 5678 90 12 34", "++12345678901+",
    "é\U0001f600 mail jo@x.de, 10.0.0.1 ü +4930123456789", "9" * 3000, "1" * 20_000 + ".2.3.4", "a" * 20_000, "a." * 9000 + "@x" + ".b" * 9000, "+" * 5000, "1 " * 8000, "12.3" * 3000, "a@b.c " * 2000,
]


def test_base_spans_equal_brute_force(spark):
    got = run(spark, CASES)
    for i, t in enumerate(CASES):
        assert [(x.start, x.rank, x.end, x.kind) for x in got[i] if x.kind in pii.BASE] == base(t), (t or "")[:50]
        assert all(x.value == t[x.start : x.end] for x in got[i])


def test_random_texts_equal_brute_force(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choice(["1", "25", "0", ".", "-", " ", "@", "a", "b.c", "+", "(", ")", "4111111111111111", "é", "\n", "_", "%"]) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    got = run(spark, texts)
    for i, t in enumerate(texts):
        assert [(x.start, x.rank, x.end, x.kind) for x in got[i] if x.kind in pii.BASE] == base(t), t


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("IBAN DE89 3704 0044 0532 0130 00 please", ["iban"]),
        ("IBAN DE89 3704 0044 0532 0130 01 please", []),
        ("GB82WEST12345698765432", ["iban"]),
        ("her social security number is 078-05-1120.", ["national_id"]),
        ("part 078-05-1120", []),
        ("call me: (212) 555-0187", ["local_phone"]),
        ("serial 212 555 0187", []),
        ("tel +1 (212) 555-0187", ["phone"]),
    ],
)
def test_added_kinds(spark, text, kinds):
    assert [x.kind for x in run(spark, [text])[0]] == kinds


def test_context_moves_scores(spark):
    got = run(spark, ["visa card 4111111111111111", "order 4111111111111111", "zz 4111111111111111"])
    assert got[0][0].score > got[2][0].score > got[1][0].score


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a@b.c"), (1, None), (1, "a@b.c"), (1, "a@b.c")], "doc_id long, text string")
    assert sorted(len(r.found) for r in pii.found(df).collect()) == [0, 1, 1, 1]
    assert pii.found(df.limit(0)).collect() == []
