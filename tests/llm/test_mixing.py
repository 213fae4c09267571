import itertools

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing, queries

#: Sizes, sources' sizes and targets, by rounds of a recursion.
TARGETS = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size FROM documents),
s AS (SELECT source, sum(size) AS own, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
u AS (SELECT 0 AS n, 0.0::DOUBLE AS unit UNION ALL
      SELECT n + 1, (SELECT ((SELECT sum(own) FROM s) - 3 * coalesce(sum(own) FILTER (3 * own < unit * w), 0))::DOUBLE / sum(w) FILTER (3 * own >= unit * w) FROM s) FROM u WHERE n < 40)
SELECT doc_id, size, own::BIGINT AS source_size, least(3.0 * own, w * (SELECT max(unit) FROM u)) AS target FROM d JOIN s ON s.source IS NOT DISTINCT FROM d.source"""


def targets(sizes, cap=3):
    """Water rises in all sources, as fast as each weighs, until it is as much as they are; none above its cap."""
    order = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    low, high = 0.0, cap * (sum(sizes.values()) + 1.0)
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(cap * sizes[s], level * weight[s]) for s in order) < sum(sizes.values()) else (low, level)
    return {s: min(cap * sizes[s], high * weight[s]) for s in order}


@pytest.mark.parametrize("sizes", [{"b": 100, "a": 10, None: 50, "c": 40}, {"a": 1, "b": 999}, {"a": 0, "b": 9}, {"a": 0}, {}, {f"s{i}": (i * 37) % 91 for i in range(60)}])
def test_targets(spark, sizes):
    totals = spark.createDataFrame([("" if s is None else "=" + s, n) for s, n in sizes.items()], "key string, source_size long")
    got = {r.key[1:] if r.key else None: r.target for r in mixing.source_targets(totals).collect()}
    assert got == pytest.approx(targets(sizes), rel=1e-9, abs=1e-6)


def test_quotas_are_split_whole():
    quotas = np.array([100, 0, 1, 57])
    room = mixing.even(158, 7)
    shard, who, count = mixing.split_quotas(quotas, room, np.random.default_rng(0))
    assert (count > 0).all() and np.bincount(who, count, 4).tolist() == quotas.tolist() and np.bincount(shard, count, 7).tolist() == room.tolist()
    assert mixing.even(0, 3).tolist() == [0, 0, 0] and len(mixing.split_quotas(np.zeros(0, np.int64), mixing.even(0, 3), np.random.default_rng(0))[0]) == 0


def test_splits_are_hypergeometric():
    """Of 60 and 40 blocks half go to the first shard: mean 30, variance 50 * .6 * .4 * 50 / 99."""
    got = []
    for seed in range(4000):
        shard, who, count = mixing.split_quotas(np.array([60, 40]), mixing.even(100, 2), np.random.default_rng(seed))
        got.append(count[(shard == 0) & (who == 0)].sum())
    assert np.mean(got) == pytest.approx(30, abs=0.15) and np.var(got) == pytest.approx(50 * 0.24 * 50 / 99, rel=0.1)


def test_large_populations_are_drawn_whole():
    quotas = np.array([5 * 10**9, 3, 2 * 10**10, 0], np.int64)
    part = mixing.draw(quotas, 10**10, np.random.default_rng(1))
    assert part.sum() == 10**10 and (part >= 0).all() and (part <= quotas).all() and part[0] == pytest.approx(2 * 10**9, rel=1e-3)


def test_nearest_equals_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(200):
        sizes = rng.integers(1, 30, rng.integers(1, 9)).tolist()
        goal = int(rng.integers(0, 80))
        best = max(s for n in range(len(sizes) + 1) for c in itertools.combinations(sizes, n) if (s := sum(c)) <= goal)
        assert sum(itertools.compress(sizes, mixing.nearest(sizes, goal))) == best


def test_plan_meets_targets(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + id % 40 as int))").alias("text"), F.expr("case when id % 3 = 0 then 'hot' when id % 97 = 0 then null else concat('s', id % 5) end").alias("source"), F.lit(1).alias("size"), F.lit("x").alias("taken"))
    rows = mixing.plan(docs).collect()
    assert len(rows) == 3000
    want = targets({s: sum(r.size for r in rows if r.source == s) for s in {r.source for r in rows}})
    for s, target in want.items():
        own = [r for r in rows if r.source == s]
        assert all(r.target == pytest.approx(target) for r in own) and {r.source_size for r in own} == {sum(r.size for r in own)}
        assert 0 <= target - sum(r.taken for r in own) < 1 + 1e-6
    assert all(r.taken <= 3 * r.size for r in rows)
    assert sorted((r.id, r.taken, r.shards) for r in rows) == sorted((r.id, r.taken, r.shards) for r in mixing.plan(docs.repartition(5)).collect())


def test_beyond_the_zone_whole_blocks_are_taken(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ZONE", 300)
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + id % 7 as int))").alias("text"), F.expr("if(id % 2 = 0, 'a', 'b')").alias("source"))
    rows = mixing.plan(docs).collect()
    for s, target in targets({s: sum(r.size for r in rows if r.source == s) for s in "ab"}).items():
        assert 0 <= target - sum(r.taken for r in rows if r.source == s) < 1 + 1e-6


def test_without_broadcasts_rows_are_the_same(spark, monkeypatch):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + id % 7 as int))").alias("text"), F.expr("if(id % 3 = 0, null, concat('s', id % 20))").alias("source"))
    one = sorted((r.id, r.taken, r.shards) for r in mixing.plan(docs).collect())
    monkeypatch.setattr(mixing, "BROADCAST", -1)
    assert sorted((r.id, r.taken, r.shards) for r in mixing.plan(docs).collect()) == one


def test_query_columns_equal_sql(spark, tmp_path):
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.expr("case when id % 50 = 0 then null else repeat('w\t', cast(id % 40 as int)) end").alias("text"), F.expr("case when id % 2 = 0 then 'hot' when id % 97 = 0 then null else concat('s', id % 23) end").alias("source"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op5_mixing(spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.execute(TARGETS).fetchall()
    assert len(want) == len(got) == 900
    for i, size, own, target in want:
        assert (got[i]["size"], got[i].source_size) == (size, own) and got[i].target == pytest.approx(target, rel=1e-9)


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (None, "x y", None), (None, None, None), (5, "one two three", "b"), (5, "one two three", "b"), (6, "word " * 50_000, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.plan(df).collect()
    assert sorted((r.id or 0, r.size) for r in got) == [(0, 0), (0, 2), (1, 0), (2, 0), (5, 3), (5, 3), (6, 50_000)]
    assert all(r.taken == 0 for r in got if r.source == "a")
    assert len({(r.copies, tuple(r.shards)) for r in got if r.id == 5}) == 1
    assert mixing.plan(df.limit(0)).collect() == [] and mixing.mix(df.limit(0)).collect() == []
    named = df.select("*", *(F.lit("mine").alias(c) for c in ("key", "row", "shard", "place", "size", "blocks", "copies")))
    mixed = mixing.mix(named)
    assert mixed.columns == named.columns and mixed.count() == sum(r.copies for r in got) and {r.key for r in mixed.collect()} == {"mine"}


def test_shards_hold_their_quotas_of_an_upsampled_source(spark):
    hot = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("w w w w").alias("text"), F.lit("hot").alias("source"))
    docs = hot.unionByName(spark.range(4000, 4600).select(F.col("id").alias("doc_id"), F.lit("w").alias("text"), F.lit("small").alias("source")))
    blocks, shards, seed = 64, 8, 17
    rows = mixing.plan(docs, blocks=blocks, shards=shards).withColumn("block", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(blocks).cast("long"))).collect()
    assert {r.copies for r in rows if r.source == "small"} == {3}
    assert all(len(r.shards) == r.copies and r.shards[:1] == [r.shard][: r.copies] for r in rows)
    held = {(r.source, r.block, n, s) for r in rows for n, s in enumerate(r.shards)}
    names = ["hot", "small"]
    quotas = np.array([len({(b, n) for o, b, n, _ in held if o == s}) for s in names])
    groups = [r.g for r in spark.createDataFrame([("=" + s,) for s in names], "key string").select(F.pmod(F.xxhash64("key"), F.lit(mixing.GROUPS)).alias("g")).collect()]
    assert groups[0] != groups[1]  # each source is a group: the first tree says all
    totals = np.zeros(mixing.GROUPS, np.int64)
    totals[groups] = quotas
    shard, who, count = mixing.split_quotas(totals, mixing.even(int(quotas.sum()), shards), np.random.default_rng(seed))
    for s, g in zip(names, groups):
        assert [sum(o == s and k == n for o, _, _, k in held) for n in range(shards)] == np.bincount(shard[who == g], count[who == g], shards).tolist()
    assert quotas[1] == 3 * blocks and min(sum(o == "small" and k == n for o, _, _, k in held) for n in range(shards)) > 0


def test_a_partition_is_a_shard_in_the_order_of_place(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + id % 9 as int))").alias("text"), F.expr("concat('s', id % 3)").alias("source"))
    rows = mixing.plan(docs, shards=4).collect()
    mixed = mixing.mix(docs, shards=4, placed=True)
    got = mixed.withColumn("part", F.spark_partition_id()).collect()
    assert mixed.columns == [*docs.columns, "shard", "place"] and all(r.part == r.shard for r in got)
    assert sorted((r.doc_id, r.shard) for r in got) == sorted((r.id, s) for r in rows for s in r.shards)
    for s in range(4):
        places = [r.place for r in got if r.shard == s]
        assert places == sorted(places) and len(places) > 50
