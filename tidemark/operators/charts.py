"""The frames behind charts; drawing them is left to others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.frames import BY, ORDER, ratio, running, whole
from . import returns as ret_ops


def cumulative_returns(df: DataFrame, ret: str = "ret", bench: str | None = "bench", volatility_matched: bool = False, log: bool = False, by=BY, order=ORDER) -> DataFrame:
    """`df` with strategy and benchmark, compounded; the benchmark's returns may be scaled to the strategy's deviation."""
    rows = df.where(F.col(ret).isNotNull())
    made = {"strategy": F.product(1 + F.col(ret)).over(running(by, order)) - 1}
    if bench:
        scale = ratio(F.stddev_samp(ret).over(whole(by)), F.stddev_samp(bench).over(whole(by))) if volatility_matched else F.lit(1.0)
        rows = rows.withColumn("__b", F.col(bench) * scale)
        made["benchmark"] = F.product(1 + F.col("__b")).over(running(by, order)) - 1
    out = rows.withColumns(made)
    if log:
        out = out.withColumns({c: F.log1p(c) for c in made})
    return out.drop("__b")


def eoy_returns(df: DataFrame, ret: str = "ret", by=BY, order=ORDER) -> DataFrame:
    """(by, year, ret)."""
    return df.where(F.col(ret).isNotNull()).groupBy(*by, F.year(order[0]).alias("year")).agg((F.product(1 + F.col(ret)) - 1).alias("ret"))


def histogram(df: DataFrame, x: str, width: float, by: tuple[str, ...] = BY) -> DataFrame:
    """(by, bin, n): values from bin on, below bin + width."""
    return df.where(F.col(x).isNotNull()).groupBy(*by, (F.floor(F.col(x) / width) * width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def monthly_distribution(df: DataFrame, ret: str = "ret", width: float = 0.01, by=BY, order=ORDER) -> DataFrame:
    return histogram(ret_ops.aggregate_returns(df, "M", ret, by, order), "ret", width, by)


def active_returns(df: DataFrame, ret: str = "ret", bench: str = "bench") -> DataFrame:
    return df.withColumn("active", F.col(ret) - F.col(bench))


def rolling_betas(df: DataFrame, windows: tuple[int, int] = (126, 252), **options) -> DataFrame:
    out = df
    for n in windows:
        out = ret_ops.rolling_beta(out, window=n, out=f"beta_{n}", **options)
    return out


def worst_drawdowns(df: DataFrame, top: int = 5, ret: str = "ret", by=BY, order=ORDER) -> DataFrame:
    """The deepest episodes of each series, numbered."""
    w = Window.partitionBy(*by).orderBy("max_drawdown", "start")
    return ret_ops.drawdown_details(df, ret, by, order).withColumn("no", F.row_number().over(w)).where(F.col("no") <= top)


def cumulative_contributions(df: DataFrame, factors: list[str], by=BY, order=ORDER, **options) -> DataFrame:
    parts = ret_ops.factor_contributions(df, factors, by=by, order=order, **options)
    return parts.withColumns({f"{f}_total": F.sum(f"{f}_part").over(running(by, order)) for f in factors})


def trade_markers(trades: DataFrame) -> DataFrame:
    """(symbol, ts, price, kind): each trade's entry and exit."""
    each = F.explode(F.array(F.struct(F.col("entry_time").alias("ts"), F.col("entry_price").alias("price"), F.lit("entry").alias("kind")), F.struct(F.col("exit_time").alias("ts"), F.col("exit_price").alias("price"), F.lit("exit").alias("kind"))))
    return trades.select("symbol", each.alias("x")).select("symbol", "x.*")


def label_markers(prices: DataFrame, labels: DataFrame, label: str = "label", by=BY, order=ORDER) -> DataFrame:
    """Prices at labelled rows."""
    return prices.join(labels.select(*by, *order, label), [*by, *order])


def excursions(trades: DataFrame) -> DataFrame:
    """(symbol, mae, mfe, return, won) of trades that have them."""
    return trades.where("mae is not null and mfe is not null").select("symbol", "mae", "mfe", "return", (F.col("return") > 0).alias("won"))


def trade_distribution(trades: DataFrame, by: str) -> DataFrame:
    """(by, n, five quantiles) of returns."""
    return trades.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *(F.percentile("return", q).alias(f"p{int(100 * q)}") for q in (0, 0.25, 0.5, 0.75, 1)))
