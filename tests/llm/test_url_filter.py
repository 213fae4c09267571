import math
import random
import re
import time
from itertools import combinations

from tidemark.llm import queries, url_filter


def brute(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c.group().lower(), m[1]), m[2]) if m else ("", "")
    fit = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[1:] if fit else (None, None)))


URLS = [
    None, "", "no scheme.com/x", "http://A.Example.COM/en/1?x=/es/", "https://www.example.com/en/2#t", "http://x.www.example.com/en/", "http://example.com/EN/", "http://com/", "http://com",
    "http://com?x=1", "http://a.net/es/q", "http://a.net/esx", "http://net/fr/", "http://b.org/en/1", "http://xcom/a", "a://b://c.com/d", "http:///es/", "http://ÄB.Net/fr/ü", "http://h.net#/es/", "://x.com/", "http://notexample.com/en/",
]


def test_listed_rules(spark):
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(URLS)], "page_id long, url string, verdict string")
    rules = spark.createDataFrame([], "tokens array<string>, verdict string, confidence double, support double")
    got = {r.page_id: r for r in url_filter.judged(df, rules).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path, rule, verdict = brute(u)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict or "allow"), u
    assert url_filter.judged(df.limit(0), rules).collect() == []


def brute_rules(baskets, need, confidence=0.6, longest=3, sure=1.645):
    """Combinations of named items and a label with the support, the confidence and the bound, from every combination."""
    n = len(baskets)
    where = {}
    for i, (b, _) in enumerate(baskets):
        for t in b:
            where.setdefault(t, []).append(i)
    same = {}
    for t, rows in where.items():
        if len(rows) >= need:
            same.setdefault(tuple(rows), []).append(t)
    items = {min(ts) for ts in same.values()}
    own = {y: sum(z == y for _, z in baskets) for _, y in baskets}
    found = {}
    for size in range(1, longest + 1):
        for c in {c for b, _ in baskets for c in combinations(sorted(set(b) & items), size)}:
            labels = [y for b, y in baskets if set(b).issuperset(c)]
            for y in own:
                k, m = labels.count(y), len(labels)
                here, other = k / own[y], (m - k) / max(1, n - own[y])
                if k < need or here / (here + other) < confidence:
                    continue
                p = k / m
                low = (p + sure**2 / (2 * m) - sure * math.sqrt(p * (1 - p) / m + sure**2 / (4 * m * m))) / (1 + sure**2 / m)
                if low > own[y] / n:
                    found[c, y] = (round(here / (here + other), 9), k / n)
    return {(c, y): v for (c, y), v in found.items() if not any(set(d) < set(c) and z == y and w[0] >= v[0] for (d, z), w in found.items())}


def mined_and_brute(spark, rows, need):
    df = spark.createDataFrame(rows, "url string, label string")
    listed = [(r["url"], r["t"], r["label"]) for r in url_filter.with_parts(df).select("url", "label", url_filter.tokens().alias("t")).collect()]
    rules = url_filter.mined(df, support=0.0, least=need)
    got = {(tuple(r.tokens), r.verdict): (r.confidence, r.support) for r in rules.collect()}
    return df, rules, listed, got, brute_rules([(t, y) for _, t, y in listed if y is not None], need)


def test_mined_rules_equal_brute_force(spark):
    rows = [(f"http://{h}.org/{lang}/{i}?{k}=1", "block" if (h == "spam" or lang == "zz" and k == "ad") else "allow") for i in range(12) for h in ("spam", "good", "fine") for lang in ("en", "zz") for k in ("ad", "id")]
    rows += [(f"http://m{i % 5}.rare{i % 7}.net/{'abc'[i % 3]}/{'xy'[i % 2]}", "block" if i % 3 == 0 and i % 2 else "allow") for i in range(200)]
    rows += [(None, "allow"), ("http://q.org/en/1", None)]
    df, rules, listed, got, want = mined_and_brute(spark, rows, 8)
    assert {y for _, y in want} == {"allow", "block"} and len(want) > 6
    assert got.keys() == want.keys() and all(abs(a - b) < 1e-8 for k in got for a, b in zip(got[k], want[k]))
    hits = {r.url: (r.association, r.verdict) for r in url_filter.matched(df, rules).collect()}
    for url, t, _ in listed:
        if url is not None:
            fit = [(-c, -s, " ".join(tokens), y) for (tokens, y), (c, s) in got.items() if set(tokens) <= set(t)]
            assert hits.get(url) == (min(fit)[2:] if fit else None)


def test_a_rare_class_has_rules(spark):
    """Nine in ten are allowed: with one confidence for all, nothing would block."""
    rows = [(f"http://{'bad' if i % 5 == 0 else f'h{i % 40}'}.org/{i}", "block" if i % 10 == 0 else "allow") for i in range(1000)]
    _, _, _, got, want = mined_and_brute(spark, rows, 10)
    assert got.keys() == want.keys() and {y for _, y in got} == {"allow", "block"}


def test_long_and_repeated_urls_are_mined_in_bounded_steps(spark):
    long = ["http://a.org/" + "/".join(f"s{i}" for i in range(60))] * 12 + ["http://b.org/" + "/".join(f"s{i}" for i in range(60) if i != skip) for skip in range(14)]
    rows = [(u, "block") for u in long] + [(f"http://c{i % 9}.org/{i}", "allow") for i in range(60)]
    df = spark.createDataFrame(rows, "url string, label string")
    start = time.monotonic()
    rules = url_filter.mined(df).collect()
    assert time.monotonic() - start < 60
    assert rules and all(len(r.tokens) <= 3 for r in rules) and any(r.verdict == "block" for r in rules)


def test_no_combination_of_a_long_url_is_lost(spark):
    """URLs of 45 items and more, whose rules are of their rarest ones; part of one rule's support is in short URLs."""
    rng = random.Random(3)
    two = lambda name, i: [f"{name}{k}" for k in range(3) if k != i % 3]
    rows = []
    for i in range(45):
        own = [f"d{k}" for k in range(46) if rng.random() < 0.93]
        own += ["t0", "t1", "t2"] if i % 3 == 0 else two("t", i // 3)
        rows.append((f"http://a{i % 3}.org/" + "/".join(own + ["u0", "u1", "u2"] * (i % 6 == 0)), "block" if i % 3 == 0 else "allow"))
    rows += [(f"http://c{i % 9}.com/" + "/".join(["u0", "u1", "u2"] if i % 4 == 0 else two("u", i)), "block" if i % 4 == 0 else "allow") for i in range(32)]
    _, _, listed, got, want = mined_and_brute(spark, rows, 13)
    assert sum(len(t) > url_filter.ITEMS for _, t, _ in listed) == 45
    assert {(("path:t0", "path:t1", "path:t2"), "block"), (("path:u0", "path:u1", "path:u2"), "block")} <= want.keys()
    assert got.keys() == want.keys() and all(abs(a - b) < 1e-8 for k in got for a, b in zip(got[k], want[k]))


def test_query_decides_by_mined_rules(spark, tmp_path):
    pages = [(i, f"http://{'farm' if i % 4 == 0 else f'h{i % 30}'}.org/{'fr' if i % 3 else 'en'}/{i}") for i in range(400)]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 400, 2)], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.page_id: r for r in queries.op1_url_filter(spark, str(tmp_path)).collect()}
    assert len(got) == 400 and {"page_id", "host", "path", "rule", "verdict"} <= set(got[0].asDict())
    assert all((r.verdict == "block") == (i % 4 == 0) for i, r in got.items())


def test_odd_rows(spark):
    none = spark.createDataFrame([], "url string, label string")
    rules = url_filter.mined(none)
    assert rules.collect() == []
    pages = spark.createDataFrame([(1, "http://x.org/" + "a/" * 50_000), (1, "http://x.org/"), (1, "http://x.org/"), (None, None)], "page_id long, url string")
    got = url_filter.judged(pages, rules).collect()
    assert len(got) == 4 and {r.verdict for r in got} == {"allow"}
