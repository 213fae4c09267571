import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup as E, queries


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in rows:
        own = groups[norm(t)]
        best = min(own)
        out.append((i, best[3], len(own), i == best[3] and len(t or "") == -best[0], hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, kept string, extra int").repartition(4)
    got = E.exact_dedup(df, **options)
    assert got.columns == ["doc_id", "text", "extra", "keep_id", "group_size", "kept_rows", "kept", "text_sha256"]
    return sorted((tuple(r) for r in got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


@pytest.mark.parametrize("table_bytes", [E.TABLE_BYTES, 3000])
def test_equals_brute_force(spark, table_bytes):
    rng = random.Random(7)
    base = ["".join(rng.choice("ab \t\n\x0b\x0c\ré ") for _ in range(rng.randint(0, 6))) for _ in range(300)]
    rows = [(i, rng.choice(base)) for i in range(900)] + [(None, "a b"), (None, None), (2000, None), (2001, ""), (2002, " \n"), (3, "dup"), (3, "dup"), (3, "d up"), (2005, "x" * 300_000), (2006, "x " * 300_000)]
    assert run(spark, rows, table_bytes=table_bytes) == brute(rows)


def test_one_row_of_each_group(spark):
    rows = [(1, "a"), (2, "a "), (2, "a "), (3, "b"), (None, "c"), (None, "c"), (4, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = E.kept_only(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, (r.text or "")) for r in kept.where("doc_id is not null").collect()) == [(2, "a "), (3, "b"), (4, "")]
    null = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, " ", "z"), (4, None, "w")], "doc_id int, text string, none string")
    assert [tuple(r) for r in E.kept_only(null).collect()] == [(3, " ", "z")]
    assert [tuple(r) for r in E.kept_only(null.where("text is null")).collect()] == [(1, None, "x")]
    assert [tuple(r) for r in E.kept_only(null.select("doc_id", "text").where("doc_id < 3")).collect()] == [(1, None)]
    assert kept.where("doc_id is null").count() == 1
    assert E.kept_only(df.limit(0)).collect() == []


def test_other_ids(spark):
    df = spark.createDataFrame([("b", "x y"), ("a", "xy"), ("c", "x y")], "doc_id string, text string")
    assert {r.keep_id for r in E.exact_dedup(df).collect()} == {"b"}


@pytest.mark.parametrize("kind", ["int", "short", "long", "decimal(20,0)", "double"])
def test_ids_are_compared_as_numbers(spark, kind):
    df = spark.createDataFrame([(10, "x y"), (9, "x\ty"), (9, "q"), (100, "q")], "doc_id long, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    got = E.exact_dedup(df)
    assert got.schema["keep_id"].dataType == df.schema["doc_id"].dataType
    assert {int(r.keep_id) for r in got.collect()} == {9} and {int(r.doc_id) for r in E.kept_only(df).collect()} == {9}


def test_query_equals_brute_force(spark, tmp_path):
    rows = [(i, f"t {i % 7}" + " " * (i % 3)) for i in range(60)] + [(60, None), (61, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op6_exact_dedup(spark, str(tmp_path))
    assert "text" not in got.columns
    assert sorted((tuple(r) for r in got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str) == brute(rows)


def test_grace_partitions_until_buckets_fit():
    entries = [(hashlib.sha256(str(i % 700).encode()).digest(), str(i % 700) * 20, i % 5, i, 1, 1, None) for i in range(4000)]
    schema = E.pa.schema([("digest", E.pa.binary()), ("content", E.pa.string()), ("points", E.pa.int64()), ("keep", E.pa.int64()), ("copies", E.pa.int64()), ("times", E.pa.int64()), ("row", E.pa.null())])
    whole = sorted(tuple(x)[:6] for x in E.grace(iter(entries), 1 << 30, schema))
    assert len(whole) == 700 and whole == sorted(tuple(x)[:6] for x in E.grace(iter(entries), 2000, schema))
