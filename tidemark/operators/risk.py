"""Tail risk of return streams; all results are losses, not below zero."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.frames import BY, ratio, whole


def historical_value_at_risk(df: DataFrame, ret: str = "ret", confidence: float = 0.95, by=BY) -> DataFrame:
    """(by, value_at_risk): the quantile of losses, between observations in proportion."""
    return df.groupBy(*by).agg(F.greatest(F.lit(0.0), F.percentile(-F.col(ret), confidence)).alias("value_at_risk"))


def expected_shortfall(df: DataFrame, ret: str = "ret", confidence: float = 0.95, by=BY) -> DataFrame:
    """(by, expected_shortfall): the mean of the worst (1 - confidence) n losses, the last of them in part."""
    rows = df.where(F.col(ret).isNotNull()).select(*by, (-F.col(ret)).alias("__l"))
    rows = rows.withColumn("__n", F.count(F.lit(1)).over(whole(by))).withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("__l"))))
    tail = F.col("__n") * (1 - confidence)
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), tail - (F.col("__k") - 1)))
    sums = rows.where(F.col("__k") < tail + 1).groupBy(*by).agg(F.sum(part * F.col("__l")).alias("s"), F.sum(part).alias("w"))
    return sums.select(*by, F.greatest(F.lit(0.0), ratio("s", "w")).alias("expected_shortfall"))


def gaussian_value_at_risk(df: DataFrame, ret: str = "ret", confidence: float = 0.95, by=BY) -> DataFrame:
    z = NormalDist().inv_cdf(confidence)
    return df.groupBy(*by).agg(F.greatest(F.lit(0.0), -F.avg(ret) + F.coalesce(F.stddev_samp(ret), F.lit(0.0)) * z).alias("value_at_risk"))


def gaussian_expected_shortfall(df: DataFrame, ret: str = "ret", confidence: float = 0.95, by=BY) -> DataFrame:
    n = NormalDist()
    scale = n.pdf(n.inv_cdf(confidence)) / (1 - confidence)
    return df.groupBy(*by).agg(F.greatest(F.lit(0.0), -F.avg(ret) + F.coalesce(F.stddev_samp(ret), F.lit(0.0)) * scale).alias("expected_shortfall"))


def tail_conditional_expectation(df: DataFrame, ret: str = "ret", confidence: float = 0.95, by=BY) -> DataFrame:
    """(by, tail_expectation): the mean loss from the historical value at risk on."""
    rows = df.where(F.col(ret).isNotNull()).withColumn("__v", F.greatest(F.lit(0.0), F.percentile(-F.col(ret), confidence).over(whole(by))))
    return rows.groupBy(*by).agg(F.greatest(F.lit(0.0), F.coalesce(F.avg(F.when(-F.col(ret) >= F.col("__v") - 1e-15, -F.col(ret))), F.lit(0.0))).alias("tail_expectation"))


def entropic_value_at_risk(df: DataFrame, ret: str = "ret", confidence: float = 0.95, by=BY) -> DataFrame:
    """(by, entropic_value_at_risk): the least of (log E exp(zL) - log(1 - confidence)) / z, by golden section on log z."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        loss = -frame[ret].dropna().to_numpy(float)
        scale = max(loss.std(), np.abs(loss).max(), 1e-12)
        if np.ptp(loss) <= 1e-15 * scale:
            found = loss[0]
        else:
            top = loss.max()

            def bound(x: float) -> float:
                z = math.exp(x)
                return (z * top + math.log(np.exp(z * (loss - top)).mean()) - math.log1p(-confidence)) / z

            a, b = math.log(1e-8 / scale), math.log(1e4 / scale)
            g = (math.sqrt(5) - 1) / 2
            for _ in range(200):
                c, d = b - g * (b - a), a + g * (b - a)
                a, b = (a, d) if bound(c) < bound(d) else (c, b)
            found = bound((a + b) / 2)
        return pd.DataFrame([[*key, max(0.0, found)]], columns=[*by, "v"])

    return df.select(*by, ret).groupBy(*by).applyInPandas(run, f"{kinds}, v double").withColumnRenamed("v", "entropic_value_at_risk")


def maximum_observed_dollar_loss(df: DataFrame, notional: float, ret: str = "ret", by=BY) -> DataFrame:
    return df.groupBy(*by).agg((notional * F.greatest(F.lit(0.0), F.max(-F.col(ret)))).alias("dollar_loss"))


def lower_partial_moment(df: DataFrame, ret: str = "ret", threshold: float = 0.0, order: float = 1.0, by=BY) -> DataFrame:
    """(by, lower_partial_moment): mean shortfall below the threshold to a power; to the power 0 how often it happens."""
    short = F.lit(threshold) - F.col(ret)
    value = (short > 0).cast("double") if order == 0 else F.pow(F.greatest(short, F.lit(0.0)), F.lit(order))
    return df.groupBy(*by).agg(F.avg(value).alias("lower_partial_moment"))
