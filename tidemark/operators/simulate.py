"""Simulated paths of return streams, and replay of an account that trades them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.frames import BY, ORDER, ordered, ratio, running


def _paths(df: DataFrame, make, sims: int, by, ret: str, order) -> DataFrame:
    """(by, sim, step, path): make(values, rng, sim) gives the returns of one path. A series' returns go to each of its
    simulations' tasks; a path is one group, so paths run side by side."""
    kinds = [df.schema[c].dataType.simpleString() for c in by]
    pool = df.where(F.col(ret).isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(ret).alias("r")))).alias("__v"))
    rows = pool.select(*by, F.transform("__v", lambda x: x["r"]).alias("__v"), F.explode(F.sequence(F.lit(0), F.lit(sims - 1))).alias("sim"))

    def run(frames):
        for frame in frames:
            for row in frame.itertuples(index=False):
                values = np.asarray(row[len(by)], float)
                path = np.cumprod(1 + make(values, row[-1])) - 1
                made = {c: row[i] for i, c in enumerate(by)}
                yield pd.DataFrame({**made, "sim": row[-1], "step": np.arange(len(path)), "path": path})

    ddl = ", ".join(f"`{c}` {k}" for c, k in zip(by, kinds))
    return rows.repartition(*by, "sim").mapInPandas(run, f"{ddl}, sim int, step int, path double")


def montecarlo(df: DataFrame, sims: int = 1000, ret: str = "ret", seed: int = 0, block_size: float | None = None, periods: int | None = None, by=BY, order=ORDER) -> DataFrame:
    """Paths of returns drawn with replacement, one by one or in blocks of a mean length; sim 0 is what happened."""

    def make(values, sim):
        n = len(values)
        h = periods or n
        if sim == 0:
            return values[-h:]
        rng = np.random.default_rng([seed, sim])
        if block_size is None:
            return rng.choice(values, h)
        at, fresh = np.empty(h, int), rng.random(h) < 1 / block_size
        jumps = rng.integers(0, n, h)
        for i in range(h):
            at[i] = jumps[i] if i == 0 or fresh[i] else (at[i - 1] + 1) % n
        return values[at]

    return _paths(df, make, sims, by, ret, order)


def noise_test(df: DataFrame, sims: int = 1000, noise: float = 0.1, ret: str = "ret", seed: int = 0, by=BY, order=ORDER) -> DataFrame:
    """Paths of the same returns, each times 1 plus normal noise; sim 0 has none."""
    return _paths(df, lambda v, sim: v if sim == 0 or noise == 0 else v * (1 + np.random.default_rng([seed, sim]).normal(0, noise, len(v))), sims, by, ret, order)


def variance_test(df: DataFrame, periods: int, sims: int = 1000, win_rate_variance: float = 0.1, ret: str = "ret", seed: int = 0, by=BY, order=ORDER) -> DataFrame:
    """Paths of so many trades whose win rate is off by up to the variance, wins and losses drawn from those seen."""

    def make(values, sim):
        rng = np.random.default_rng([seed, sim])
        wins, losses = values[values > 0], values[values <= 0]
        rate = np.clip(len(wins) / len(values) + rng.uniform(-win_rate_variance, win_rate_variance), 0, 1)
        return np.where(rng.random(periods) < rate, rng.choice(wins, periods), rng.choice(losses, periods))

    return _paths(df, make, sims, by, ret, order)


def outcomes(paths: DataFrame, bust: float | None = None, goal: float | None = None, by=BY) -> DataFrame:
    """(by, mean, deviation and quantiles of terminal returns and worst drawdowns, bust_probability, goal_probability)."""
    w = Window.partitionBy(*by, "sim").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    low = paths.withColumn("__dd", (1 + F.col("path")) / (1 + F.max("path").over(w)) - 1)
    ends = low.groupBy(*by, "sim").agg(F.max_by("path", "step").alias("terminal"), F.min("__dd").alias("drawdown"))
    made = []
    for c in ("terminal", "drawdown"):
        made += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
        made += [F.percentile(c, q).alias(f"{c}_p{int(q * 100)}") for q in (0.05, 0.25, 0.5, 0.75, 0.95)]
    if bust is not None:
        made.append(F.avg((F.col("drawdown") <= bust).cast("double")).alias("bust_probability"))
    if goal is not None:
        made.append(F.avg((F.col("terminal") >= goal).cast("double")).alias("goal_probability"))
    return ends.groupBy(*by).agg(*made)


def confidence_band(paths: DataFrame, confidence: float = 0.95, by=BY) -> DataFrame:
    """(by, step, lower, upper)."""
    q = (1 - confidence) / 2
    return paths.groupBy(*by, "step").agg(F.percentile("path", q).alias("lower"), F.percentile("path", 1 - q).alias("upper"))


def replay(df: DataFrame, position: str = "position", ret: str = "ret", cost: float = 0.0, initial: float = 1.0, max_drawdown: float | None = None, by=BY, order=ORDER) -> DataFrame:
    """`df` with turnover, trade_cost, reward, equity, peak, drawdown, total_cost and steps of an account that holds the
    position over each row: reward is position times return less cost times the change of position. Rows after a drawdown
    beyond the limit are dropped."""
    w, r = ordered(by, order), running(by, order)
    out = df.withColumn("turnover", F.abs(F.col(position) - F.coalesce(F.lag(position, 1).over(w), F.lit(0.0))))
    out = out.withColumn("trade_cost", F.col("turnover") * cost).withColumn("reward", F.col(position) * F.col(ret) - F.col("trade_cost"))
    out = out.withColumn("equity", initial * F.product(1 + F.col("reward")).over(r))
    out = out.withColumn("peak", F.greatest(F.lit(initial), F.max("equity").over(r))).withColumn("drawdown", ratio("equity", "peak") - 1)
    out = out.withColumn("total_cost", F.sum("trade_cost").over(r)).withColumn("steps", F.row_number().over(w))
    if max_drawdown is not None:
        gone = F.coalesce(F.sum((F.col("drawdown") <= -abs(max_drawdown)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        out = out.withColumn("__gone", gone).where("__gone = 0").drop("__gone")
    return out
