"""Logs of round-trip trades: (symbol, entry_time, exit_time, direction, entry_price, exit_price, return, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.frames import BY, ORDER, ratio, running


def trades_to_returns(trades: DataFrame, prices: DataFrame | None = None, price: str = "close", by=BY, order=ORDER) -> DataFrame:
    """(by, order, ret). Without prices each trade's whole return falls on its exit; with prices each bar of a trade gets the move
    since the bar before, from the entry price and to the exit price, and trades open together multiply. Bars
    without a trade return 0; trades that no bar covers are left at their exit."""
    t = order[0]
    if prices is None:
        return trades.groupBy(*by, F.col("exit_time").alias(t)).agg((F.product(1 + F.col("return")) - 1).alias("ret"))
    spans = trades.withColumn("__id", F.xxhash64(*trades.columns))
    bars = spans.join(prices.select(*by, t, F.col(price).alias("__p")), list(by)).where(F.col(t).between(F.col("entry_time"), F.col("exit_time")))
    key = [*by, "entry_time", "exit_time", "__id"]
    w = Window.partitionBy(*key).orderBy(t)
    mark = F.when(F.lead(t, 1).over(w).isNull(), F.col("exit_price")).otherwise(F.col("__p"))
    bars = bars.withColumn("__m", mark)
    bars = bars.withColumn("__r", ratio("__m", F.coalesce(F.lag("__m", 1).over(w), F.col("entry_price"))) - 1)
    moved = bars.groupBy(*by, t).agg(F.product(1 + F.col("direction") * F.col("__r")).alias("__g"))
    alone = spans.join(bars.select(*key).distinct(), key, "left_anti").groupBy(*by, F.col("exit_time").cast(prices.schema[t].dataType).alias(t)).agg(F.product(1 + F.col("direction") * F.col("return")).alias("__h"))
    every = prices.select(*by, t).union(alone.select(*by, t)).distinct()
    out = every.join(moved, [*by, t], "left").join(alone, [*by, t], "left")
    return out.select(*by, t, (F.coalesce("__g", F.lit(1.0)) * F.coalesce("__h", F.lit(1.0)) - 1).alias("ret"))


def trades_to_positions(trades: DataFrame, bars: DataFrame, by=BY, order=ORDER) -> DataFrame:
    """`bars` with position: the sum of directions of the trades open then, both ends included, by a sweep."""
    t = order[0]
    marks = bars.select(*by, F.col(t).alias("__t"), F.lit(0).cast("long").alias("__d"), F.lit(1).alias("__k"))
    for end, sign, k in (("entry_time", 1, 0), ("exit_time", -1, 2)):
        marks = marks.unionByName(trades.select(*by, F.col(end).alias("__t"), (sign * F.col("direction")).cast("long").alias("__d"), F.lit(k).alias("__k")))
    held = marks.withColumn("position", F.sum("__d").over(running(by, ("__t", "__k")))).where("__k = 1")
    return bars.join(held.select(*by, F.col("__t").alias(t), "position").distinct(), [*by, t])


def _open_days(trades: DataFrame, by: list[str]) -> DataFrame:
    """(by, __open): days that the union of the trades' spans covers. Each entry adds what no earlier one covers: latest exits
    are carried within a day of entries, and from day to day; only days are put in order in one task."""
    t = trades.select(*by, *(F.unix_micros(F.col(c).cast("timestamp")).alias(c) for c in ("entry_time", "exit_time")))
    t = t.groupBy(*by, "entry_time").agg(F.max("exit_time").alias("exit_time")).withColumn("__day", F.floor(F.col("entry_time") / 86_400_000_000))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    days = t.groupBy(*by, "__day").agg(F.max("exit_time").alias("__end"))
    days = days.select(*by, "__day", F.max("__end").over(before(*by).orderBy("__day")).alias("__carried"))
    rows = t.withColumn("__end", F.max("exit_time").over(before(*by, "__day").orderBy("entry_time"))).join(days, [*by, "__day"])
    fresh = F.col("exit_time") - F.greatest("entry_time", "__end", "__carried")
    return rows.groupBy(*by).agg((F.sum(F.greatest(fresh, F.lit(0))) / 86_400_000_000).alias("__open"))


def _days(end, start):
    return (F.unix_micros(F.col(end).cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))) / 86_400_000_000


def trade_stats(trades: DataFrame, by: str | None = None) -> DataFrame:
    """(group, fifteen measures): one row for all trades, 'All', and one for each value of `by`. Exposure is the
    share of days between first entry and last exit with a trade open."""
    rows = trades.withColumn("group", F.lit("All"))
    if by:
        rows = rows.unionByName(trades.where(F.col(by).isNotNull()).withColumn("group", F.col(by).cast("string")))
    r = F.col("return")
    win, loss = F.when(r > 0, r), F.when(r < 0, r)
    has = lambda c: F.avg(c) if c in trades.columns else F.lit(None).cast("double")
    days = _days("exit_time", "entry_time")
    sums = rows.groupBy("group").agg(
        F.count(F.lit(1)).cast("double").alias("trades"),
        F.avg(F.when(r > 0, 1.0).when(r < 0, 0.0)).alias("win_rate"),
        (F.product(1 + r) - 1).alias("total_return"),
        F.avg(r).alias("avg_return"),
        F.avg(win).alias("avg_win"),
        F.avg(loss).alias("avg_loss"),
        ratio(F.avg(win), F.abs(F.avg(loss))).alias("payoff_ratio"),
        ratio(F.coalesce(F.sum(win), F.lit(0.0)), F.abs(F.sum(loss))).alias("profit_factor"),
        F.max(r).alias("best"),
        F.min(r).alias("worst"),
        has("mae").alias("avg_mae"),
        has("mfe").alias("avg_mfe"),
        F.avg(days).alias("avg_days"),
        F.median(days).alias("median_days"),
        F.max("exit_time").alias("__last"),
        F.min("entry_time").alias("__first"),
    )
    open_days = _open_days(rows, ["group"])
    return sums.join(open_days, "group").withColumn("exposure", ratio("__open", _days("__last", "__first"))).drop("__open", "__last", "__first")
