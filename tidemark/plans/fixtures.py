"""Panels derived from the tables at hand, for queries and their checks; each with the same derivation in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(x, places: int = 4):
    """x to so many places, downwards from a little above: no value that sums of prices take is on an edge."""
    return F.floor(x * 10**places + 0.2137) / 10**places


def cut_sql(x: str, places: int = 4) -> str:
    return f"floor({x} * {10**places} + 0.2137::DOUBLE) / {10**places}"


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, sectorid, ts, open, high, low, close, volume): one bar for each market segment and order date. Segments are few, so
    the sums leave a few thousand rows whatever the orders."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("ts"), (F.col("o_totalprice") / 1000).alias("p"))
    both = orders.join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("symbol")), F.col("o_custkey") == F.col("c_custkey"))
    bars = both.groupBy("symbol", "ts").agg(
        cut(F.min_by("p", "o_orderkey")).alias("open"), cut(F.max("p")).alias("high"), cut(F.min("p")).alias("low"), cut(F.avg("p")).alias("close"), F.count(F.lit(1)).cast("double").alias("volume")
    )
    return bars.select("symbol", F.when(F.col("symbol") < "F", "G1").otherwise("G2").alias("sectorid"), "ts", "open", "high", "low", "close", "volume")


DAILY = f"""SELECT symbol, CASE WHEN symbol < 'F' THEN 'G1' ELSE 'G2' END AS sectorid, ts, open, high, low, close, volume FROM (
 SELECT c_mktsegment AS symbol, CAST(o_orderdate AS DATE) AS ts, {cut_sql('min_by(o_totalprice / 1000, o_orderkey)')} AS open, {cut_sql('max(o_totalprice / 1000)')} AS high,
  {cut_sql('min(o_totalprice / 1000)')} AS low, {cut_sql('avg(o_totalprice / 1000)')} AS close, CAST(count(*) AS DOUBLE) AS volume
 FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) AS daily"""


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, ts, ret, bench): a tenth of the daily moves of the bars, cut to half a move, and their mean over symbols."""
    w = Window.partitionBy("symbol").orderBy("ts")
    move = F.least(F.greatest(F.col("close") / F.lag("close", 1).over(w) - 1, F.lit(-0.5)), F.lit(0.5)) / 10
    rows = daily(spark, sf_dir).select("symbol", "ts", move.alias("ret")).where("ret is not null")
    return rows.withColumn("bench", cut(F.avg("ret").over(Window.partitionBy("ts")), 8))


STREAM = f"""SELECT symbol, ts, ret, {cut_sql('avg(ret) OVER (PARTITION BY ts)', 8)} AS bench FROM (
 SELECT symbol, ts, least(greatest(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts) - 1, -0.5), 0.5) / 10 AS ret FROM ({DAILY}) AS d) AS s WHERE ret IS NOT NULL"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, start_ts, end_ts): from each bar to the fifth after it."""
    w = Window.partitionBy("symbol").orderBy("ts")
    return daily(spark, sf_dir).select("symbol", F.col("ts").alias("start_ts"), F.lead("ts", 5).over(w).alias("end_ts")).where("end_ts is not null")


SPANS = f"SELECT * FROM (SELECT symbol, ts AS start_ts, lead(ts, 5) OVER (PARTITION BY symbol ORDER BY ts) AS end_ts FROM ({DAILY}) AS d) AS s WHERE end_ts IS NOT NULL"

_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trade for each different order line: from the earlier of its dates to the later."""
    cols = _LINE.split(", ")
    lines = table(spark, sf_dir, "lineitem").select(*cols)
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*cols[2:])
    lines = lines.withColumn("n", F.row_number().over(w)).where("n = 1")
    both = lines.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    a, b = F.col("o_orderdate").cast("date"), F.col("l_shipdate").cast("date")
    entry = F.round(F.col("l_extendedprice") / F.col("l_quantity"), 6)
    rows = both.select(
        F.col("l_suppkey").cast("string").alias("symbol"), F.least(a, b).alias("entry_time"), F.greatest(a, b).alias("exit_time"), F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("direction"),
        F.col("l_linestatus").alias("entry_reason"), F.col("l_returnflag").alias("exit_reason"), entry.alias("entry_price"), F.round(entry * (1 + F.col("l_discount") - F.col("l_tax")), 6).alias("exit_price"),
        F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"),
    )
    return rows.withColumn("return", F.round(F.col("direction") * (F.col("exit_price") / F.col("entry_price") - 1), 8))


TRADES = f"""SELECT *, round(direction * (exit_price / entry_price - 1), 8) AS "return" FROM (
 SELECT CAST(l_suppkey AS VARCHAR) AS symbol, least(a, b) AS entry_time, greatest(a, b) AS exit_time, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS direction, l_linestatus AS entry_reason,
  l_returnflag AS exit_reason, entry AS entry_price, round(entry * (1 + l_discount - l_tax), 6) AS exit_price, l_orderkey AS order_key, l_linenumber AS line FROM (
  SELECT *, CAST(o_orderdate AS DATE) AS a, CAST(l_shipdate AS DATE) AS b, round(l_extendedprice / l_quantity, 6) AS entry FROM (
   SELECT {_LINE}, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(_LINE.split(', ')[2:])}) AS n FROM lineitem) AS l JOIN orders ON o_orderkey = l_orderkey WHERE n = 1) AS m) AS t"""


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, ts, price, qty, event_id): events as ticks of their type."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("symbol"), "ts", F.col("value").cast("double").alias("price"), F.lit(1.0).alias("qty"), "event_id", "user_id")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.market import bars

    return bars(ticks(spark, sf_dir), "1 hour", time="ts", tie="event_id", by=("symbol",)).withColumnRenamed("datetime", "ts")


HOURLY = """SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, min_by(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, max_by(value, row(ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume
 FROM events GROUP BY 1, 2"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(y, good, bad): quality labels with a score from the documents' lengths."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(F.col("quality").cast("string").alias("y"), (F.col("n_chars") / (F.col("n_chars") + 1000.0)).alias("good"), (1000.0 / (F.col("n_chars") + 1000.0)).alias("bad"))


SCORED = "SELECT CAST(quality AS VARCHAR) AS y, n_chars / (n_chars + 1000.0::DOUBLE) AS good, 1000.0::DOUBLE / (n_chars + 1000.0::DOUBLE) AS bad FROM labels JOIN documents USING (doc_id)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vector, published_at): embeddings, published day by day."""
    e = table(spark, sf_dir, "embeddings")
    vec = next(c for c, t in e.dtypes if t.startswith("array"))
    return e.select(F.col("vec_id").alias("id"), F.col(vec).alias("vector"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("vec_id") % 365).cast("int")).cast("string").alias("published_at"), F.to_json(F.struct("label")).alias("metadata_json"))
