import datetime

from pyspark.sql import functions as F

from tidemark.operators.labels import cusum_filter
from tidemark.sources.market import bars
from tidemark.streaming.bars import streaming_bars, streaming_counts, streaming_cusum

T0 = datetime.datetime(2026, 1, 1)


def _ticks(spark, path, n=400):
    rows = [("AB"[i % 2], T0 + datetime.timedelta(minutes=i), 100.0 + (i * 37 % 23), 1.0, i) for i in range(n)]
    spark.createDataFrame(rows, "symbol string, ts timestamp, price double, qty double, n int").coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def _run(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return df.sparkSession.table(name)


def test_bars_equal_batch(spark, tmp_path):
    path = str(tmp_path / "ticks")
    ticks = _ticks(spark, path)
    stream = spark.readStream.schema(ticks.schema).parquet(path)
    got = {tuple(r) for r in _run(streaming_bars(stream, tie="n", by=("symbol",)), "bars_t").collect()}
    want = {tuple(r) for r in bars(ticks, "1 hour", time="ts", tie="n", by=("symbol",)).collect()}
    assert got and got <= want and len(want) - len(got) <= 2  # the last hour is open


def test_cusum_equals_batch(spark, tmp_path):
    path = str(tmp_path / "ticks")
    ticks = _ticks(spark, path, 120)
    stream = spark.readStream.schema(ticks.schema).parquet(path)
    got = {(r.symbol, r.ts, r.direction) for r in _run(streaming_cusum(stream, 0.05), "cusum_t").collect()}
    want = {(r.symbol, r.ts, r.cusum_event) for r in cusum_filter(ticks, "price", 0.05).where("cusum_event != 0").collect()}
    assert got == want and got


def test_counts(spark, tmp_path):
    path = str(tmp_path / "ticks")
    ticks = _ticks(spark, path, 200)
    stream = spark.readStream.schema(ticks.schema).parquet(path)
    got = _run(streaming_counts(stream, "1 hour", "30 minutes", by=("symbol",)), "counts_t", "complete").agg(F.sum("n")).first()[0]
    assert got == 400
