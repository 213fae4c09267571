import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.sources import market, runs


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    for suffix in ("parquet", "csv"):
        path = f"{tmp_path}/t.{suffix}"
        market.save(df, path)
        assert sorted(tuple(r) for r in market.load(spark, path, "x int, y string").collect()) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError):
        market.load(spark, "x.json")
    calls = []
    fetch = lambda: calls.append(1) or df
    for _ in range(2):
        assert market.cached(spark, f"{tmp_path}/c.parquet", fetch).count() == 2
    assert calls == [1]
    whole, failed = market.read_many(["A", "B"], lambda s: df if s == "A" else 1 / 0)
    assert whole.count() == 2 and list(failed) == ["B"]


def test_ticks_to_bars(spark, tmp_path):
    for day, prices in (("2025-01-01", [100, 105, 95, 102]), ("2025-01-02", [101])):
        rows = "\n".join(f"{day} 00:{10 * i:02d}:00,{p},1" for i, p in enumerate(prices))
        (tmp_path / f"TEST-trades-{day}.csv").write_text(f"datetime,price,qty\n{rows}\n")
    got = market.load_ohlc_range(spark, "TEST", "1 hour", "2025-01-01", "2025-01-03", str(tmp_path)).orderBy("datetime").collect()
    assert len(got) == 2 and tuple(got[0])[1:6] == (100, 105, 95, 102, 4)
    with pytest.raises(FileNotFoundError):
        market.load_ohlc_range(spark, "NONE", "1 hour", "2025-01-01", "2025-01-01", str(tmp_path))
    with pytest.raises(ValueError):
        market.date_range("2025-01-02", "2025-01-01")


def test_canonical_bars(spark):
    rows = [("A", "2026-01-02", 12, 13, 11, 12, 5, 2), ("A", "2026-01-01", 10, 12, 9, 11, 5, 0), ("A", "2026-01-01", 10, 12, 9, 11.5, 5, 1)]
    df = spark.createDataFrame([tuple(map(lambda v: float(v) if isinstance(v, (int, float)) else v, r)) for r in rows], "Ticker string, Date string, Open double, High double, Low double, Close double, Volume double, seq double")
    got = market.canonicalize_ohlcv(df, seq="seq").orderBy("datetime").collect()
    assert [r.close for r in got] == [11.5, 12.0] and got[0].datetime == datetime.datetime(2026, 1, 1)
    with pytest.raises(ValueError, match="high_below_body"):
        market.validate_ohlcv(df.toDF(*market.canonical_names(df.columns)).withColumn("high", F.lit(1.0)).withColumn("low", F.lit(0.0)))
    with pytest.raises(ValueError, match="no column"):
        market.validate_ohlcv(df)


def test_duplicates(spark):
    df = spark.createDataFrame([("A", 1, 0), ("A", 1, 1), ("B", 1, 2)], "symbol string, datetime int, _seq int")
    seqs = lambda keep: sorted(r._seq for r in market.deduplicate(df, keep=keep).collect())
    assert seqs("last") == [1, 2] and seqs("first") == [0, 2] and seqs(False) == [2]


def test_zones(spark):
    df = lambda *t: spark.createDataFrame([(datetime.datetime.fromisoformat(x),) for x in t], "datetime timestamp_ntz")
    got = market.normalize_timestamps(df("2026-01-05T09:30:00", "2026-07-06T09:30:00"), timezone="America/New_York").collect()
    assert [r.datetime.hour for r in got] == [14, 13]
    for t, what in (("2026-03-08T02:30:00", "nonexistent"), ("2026-11-01T01:30:00", "ambiguous")):
        with pytest.raises(Exception, match="zone"):
            market.normalize_timestamps(df(t), timezone="America/New_York").collect()
        assert market.normalize_timestamps(df(t), timezone="America/New_York", **{what: "null"}).first().datetime is None


def test_tracker(spark, tmp_path):
    tracker = runs.LocalTracker(spark, str(tmp_path / "runs"))
    with tracker.run("one", {"a": 1}) as run:
        run.params(n=3)
        run.metrics(step=1, loss=0.5)
        path = run.artifact("rows", spark.range(3))
    with pytest.raises(ZeroDivisionError), tracker.run("two"):
        1 / 0
    assert {r.name: r.status for r in tracker.runs().collect()} == {"one": "finished", "two": "failed"}
    assert {(r.kind, r.key, r.value) for r in tracker.values(run.id).collect()} == {("param", "n", "3"), ("metric", "loss", "0.5")}
    assert spark.read.parquet(path).count() == 3 and tracker.artifacts().count() == 1


def test_resumable_map(spark):
    df = spark.createDataFrame([("a", "good"), ("b", "bad")], "id string, text string")

    def work(t):
        if t == "bad":
            raise ValueError("no")
        return t.upper()

    good, bad = runs.extract(df, work)
    assert [tuple(r) for r in good.collect()] == [("a", "GOOD")] and [r.id for r in bad.collect()] == ["b"]
    good, bad = runs.extract(df, str.upper, done=good)
    assert sorted(tuple(r) for r in good.collect()) == [("a", "GOOD"), ("b", "BAD")] and bad.count() == 0
    with pytest.raises(ValueError, match="repeat"):
        runs.extract(df.union(df), work)
    got = runs.render("Say {text}!", df, ["text"]).orderBy("id").first()
    assert got.prompt == "Say good!" and len(got.prompt_hash) == 64
    with pytest.raises(ValueError):
        runs.render("{other}", df, ["text"])


def test_landed_trades(spark, tmp_path):
    ms = 1735689600000
    (tmp_path / "X-trades-2025-01-01.csv").write_text(f"id,price,qty,quote_qty,time,is_buyer_maker\n1,10,1,10,{ms},true\n2,12,2,24,{ms},false\n3,11,1,11,{ms + 3_600_000},true\n")
    got, failed = market.read_bars(spark, ["X", "Y"], "2025-01-01", "2025-01-02", "1 hour", str(tmp_path))
    assert [(r.open, r.close, r.volume) for r in got.orderBy("datetime").collect()] == [(10, 12, 3), (11, 11, 1)] and list(failed) == ["Y"]


def test_json_and_tools(spark):
    df = spark.createDataFrame([(1, '{"a": 1}'), (2, "no"), (3, '{"a": "x"}')], "id int, text string")
    good, bad = runs.parsed(df, "a int")
    assert [(r.id, r.value.a) for r in good.collect()] == [(1, 1)] and sorted(r.id for r in bad.collect()) == [2, 3]
    tools = runs.ToolRegistry(spark)
    tools.add("shout", lambda t: t.upper())
    assert tools.call(df, "shout", "text").where("id = 2").first().result == "NO"
    with pytest.raises(KeyError):
        tools.call(df, "other", "text")
    assert [r.id for r in runs.latest(df.withColumn("k", F.lit(1)), ["k"], "id").collect()] == [3]
    assert runs.truncated(spark.createDataFrame([([1, 2, 3],)], "ids array<int>"), most=2).first().ids == [1, 2]
    assert runs.active_run() is None
