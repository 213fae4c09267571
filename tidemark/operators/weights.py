"""Concurrency, uniqueness and weights of labels whose lifetimes overlap. Lifetimes take in both ends."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.frames import BY, ORDER, ordered, ratio, running, whole


def concurrency(observations: DataFrame, events: DataFrame, start: str = "start_ts", end: str = "end_ts", by=BY, order=ORDER, out: str = "concurrency") -> DataFrame:
    """Events alive at each observation, by a sweep: one more from a start on, one less after an end."""
    t = order[0]
    marks = observations.select(*by, F.col(t).alias("__t"), F.lit(0).alias("__d"), F.lit(1).alias("__k"))
    marks = marks.unionByName(events.select(*by, F.col(start).alias("__t"), F.lit(1).alias("__d"), F.lit(0).alias("__k")))
    marks = marks.unionByName(events.select(*by, F.col(end).alias("__t"), F.lit(-1).alias("__d"), F.lit(2).alias("__k")))
    alive = marks.withColumn(out, F.sum("__d").over(running(by, ("__t", "__k"))))
    return observations.join(alive.where("__k = 1").select(*by, F.col("__t").alias(t), out), [*by, t])


def positions(observations: DataFrame, by=BY, order=ORDER) -> DataFrame:
    return observations.select(*by, F.col(order[0]).alias("__t"), (F.row_number().over(ordered(by, order)) - 1).alias("__n"))


def _placed(observations: DataFrame, events: DataFrame, start: str, end: str, by, order) -> DataFrame:
    at = positions(observations, by, order)
    out = events.join(at.withColumnsRenamed({"__t": start, "__n": "start_position"}), [*by, start])
    return out.join(at.withColumnsRenamed({"__t": end, "__n": "end_position"}), [*by, end])


def indicator_matrix(observations: DataFrame, events: DataFrame, start: str = "start_ts", end: str = "end_ts", by=BY, order=ORDER) -> DataFrame:
    """(by, obs_position, start_position, member): the ones of the observation by event matrix."""
    placed = _placed(observations, events, start, end, by, order)
    return placed.select(*by, F.explode(F.sequence("start_position", "end_position")).alias("obs_position"), "start_position", F.lit(1).alias("member"))


def _over_lifetimes(observations: DataFrame, events: DataFrame, value, start: str, end: str, by, order) -> DataFrame:
    """`events` with __sum and __len of value over their observations, by differences of a running sum."""
    t = order[0]
    sums = observations.withColumn("__v", value).select(*by, F.col(t).alias("__t"), F.sum("__v").over(running(by, order)).alias("__c"), "__v", F.row_number().over(ordered(by, order)).alias("__n"))
    first = sums.select(*by, F.col("__t").alias(start), (F.col("__c") - F.coalesce("__v", F.lit(0.0))).alias("__c0"), F.col("__n").alias("__n0"))
    last = sums.select(*by, F.col("__t").alias(end), F.col("__c").alias("__c1"), F.col("__n").alias("__n1"))
    both = events.join(first, [*by, start]).join(last, [*by, end])
    return both.withColumn("__sum", F.col("__c1") - F.coalesce("__c0", F.lit(0.0))).withColumn("__len", F.col("__n1") - F.col("__n0") + 1).drop("__c0", "__c1", "__n0", "__n1")


def average_uniqueness(observations: DataFrame, events: DataFrame, start: str = "start_ts", end: str = "end_ts", by=BY, order=ORDER, out: str = "uniqueness") -> DataFrame:
    """Mean of 1 / concurrency over each event's lifetime."""
    alive = concurrency(observations, events, start, end, by, order)
    share = F.when(F.col("concurrency") > 0, 1 / F.col("concurrency"))
    return _over_lifetimes(alive, events, share, start, end, by, order).withColumn(out, ratio("__sum", "__len")).drop("__sum", "__len")


def sample_weights(observations: DataFrame, events: DataFrame, price: str = "close", start: str = "start_ts", end: str = "end_ts", normalize: bool = True, by=BY, order=ORDER, out: str = "weight") -> DataFrame:
    """Absolute sum of log returns over concurrency in each lifetime, of mean one."""
    alive = concurrency(observations, events, start, end, by, order)
    alive = alive.withColumn("__r", F.ln(price) - F.ln(F.lag(price, 1).over(ordered(by, order))))
    value = F.when(F.col("concurrency") > 0, F.col("__r") / F.col("concurrency"))
    made = _over_lifetimes(alive, events, value, start, end, by, order).withColumn(out, F.abs("__sum")).drop("__sum", "__len")
    return normalized(made, out, by) if normalize else made


def normalized(df: DataFrame, x: str, by=BY) -> DataFrame:
    return df.withColumn(x, ratio(x, F.avg(x).over(whole(by))))


def time_decay(df: DataFrame, weight: str = "weight", minimum_weight: float = 0.0, by=BY, order=("start_ts",), out: str = "decay") -> DataFrame:
    """From near the minimum for the oldest to one for the last, linear in the running share of weight."""
    share = ratio(F.sum(weight).over(running(by, order)), F.sum(weight).over(whole(by)))
    return df.withColumn(out, minimum_weight + (1 - minimum_weight) * share)


def class_balance_weights(df: DataFrame, label: str = "label", by=BY, out: str = "class_weight") -> DataFrame:
    """n / (classes * n of the class)."""
    classes = F.size(F.collect_set(label).over(whole(by)))
    return df.withColumn(out, ratio(F.count(label).over(whole(by)), classes * F.count(F.lit(1)).over(whole((*by, label)))))


def combine_weights(df: DataFrame, weights: list[str], normalize: bool = True, by=BY, out: str = "combined") -> DataFrame:
    product = F.lit(1.0)
    for w in weights:
        product = product * F.col(w)
    made = df.withColumn(out, product)
    return normalized(made, out, by) if normalize else made


def purging_metadata(observations: DataFrame, events: DataFrame, embargo: int = 0, start: str = "start_ts", end: str = "end_ts", by=BY, order=ORDER) -> DataFrame:
    """start_position, end_position, max_end_position, overlaps_previous, next_safe_position and next_safe_time of
    each event: the running last end, whether a start lies at or before those before it, and the first observation beyond it and the embargo."""
    placed = _placed(observations, events, start, end, by, order)
    at = running(by, ("start_position",))
    placed = placed.withColumn("max_end_position", F.max("end_position").over(at))
    before = F.lag("max_end_position", 1).over(ordered(by, ("start_position",)))
    placed = placed.withColumn("overlaps_previous", F.coalesce(F.col("start_position") <= before, F.lit(False)))
    placed = placed.withColumn("__safe", F.col("max_end_position") + 1 + embargo)
    there = positions(observations, by, order).withColumnsRenamed({"__t": "next_safe_time", "__n": "__safe"})
    out = placed.join(there, [*by, "__safe"], "left")
    return out.withColumn("next_safe_position", F.when(F.col("next_safe_time").isNotNull(), F.col("__safe"))).drop("__safe")


def sequential_bootstrap(observations: DataFrame, events: DataFrame, size: int | None = None, seed: int = 0, start: str = "start_ts", end: str = "end_ts", by=BY, order=ORDER) -> DataFrame:
    """(by, draw, start_position): events drawn one after another in proportion to the uniqueness that each would have
    then. Each series draws in one task, with its own generator."""
    placed = _placed(observations, events, start, end, by, order).select(*by, "start_position", "end_position")
    ddl = ", ".join(f"`{c}` {placed.schema[c].dataType.simpleString()}" for c in by) + ", draw int, start_position int"

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["start_position", "end_position"])
        s, e = frame["start_position"].to_numpy(), frame["end_position"].to_numpy()
        alive = np.zeros(int(e.max()) + 2)
        rng, picks = np.random.default_rng([seed, len(s)]), []
        for _ in range(size or len(s)):
            run_sum = np.concatenate(([0.0], np.cumsum(1 / (alive + 1))))
            unique = (run_sum[e + 1] - run_sum[s]) / (e - s + 1)
            k = int(rng.choice(len(s), p=unique / unique.sum()))
            picks.append(int(s[k]))
            alive[s[k] : e[k] + 1] += 1
        return pd.DataFrame({**dict(zip(by, key)), "draw": np.arange(len(picks)), "start_position": picks})

    return placed.groupBy(*by).applyInPandas(run, ddl)
