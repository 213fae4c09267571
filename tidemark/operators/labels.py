"""Event labels of one instrument's prices, over long panels. Events default to every row."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.frames import BY, ORDER, ordered, ratio, with_states


def cusum_filter(df: DataFrame, price: str = "close", threshold: float | str = 0.02, drift: float = 0.0, log_returns: bool = True, by=BY, order=ORDER) -> DataFrame:
    """`df` with cusum_event: -1 or 1 where the symmetric cumulative sum of changes first passes the threshold. The negative
    side is tried first and only the side that triggers is reset; a null change or threshold resets both. threshold is a
    number or a column."""
    moved = F.ln(price) - F.ln(F.lag(price, 1).over(ordered(by, order))) if log_returns else F.col(price) - F.lag(price, 1).over(ordered(by, order))
    level = F.col(threshold) if isinstance(threshold, str) else F.lit(float(threshold))
    rows = df.withColumn("__d", moved).withColumn("__t", level)

    def work(frame):
        up = down = 0.0
        out = []
        for d, t in zip(frame["__d"].to_numpy(float), frame["__t"].to_numpy(float)):
            hit = 0
            if math.isnan(d) or math.isnan(t):
                up = down = 0.0
            else:
                up, down = max(0.0, up + d - drift), min(0.0, down + d + drift)
                if down < -t:
                    hit, down = -1, 0.0
                elif up > t:
                    hit, up = 1, 0.0
            out.append(hit)
        return {"cusum_event": out}

    return with_states(rows, work, {"cusum_event": "int"}, by, order).drop("__d", "__t")


def after(x: str | Column, horizon: int | str, by=BY, order=ORDER) -> Column:
    """x at the horizon: so many rows on, or, for an interval as text ('5 days'), at the first row at or beyond it."""
    if isinstance(horizon, int):
        return F.lead(x, horizon).over(ordered(by, order))
    c = F.col(x) if isinstance(x, str) else x
    at = F.unix_micros(F.col(order[0]).cast("timestamp"))
    n, unit = horizon.split()
    micros = int(float(n) * {"day": 86_400, "hour": 3_600, "minute": 60, "second": 1}[unit.rstrip("s")] * 1_000_000)
    return F.first(c).over(Window.partitionBy(*by).orderBy(at).rangeBetween(micros, Window.unboundedFollowing))


def vertical_barriers(df: DataFrame, horizon: int | str, by=BY, order=ORDER, out: str = "vertical_barrier") -> DataFrame:
    """Each row's time at the horizon; null without one."""
    return df.withColumn(out, after(order[0], horizon, by, order))


def fixed_horizon(df: DataFrame, price: str = "close", horizon: int | str = 5, threshold: float = 0.0, drop_censored: bool = True, event: str | None = None, by=BY, order=ORDER) -> DataFrame:
    """end_time, fwd_return and label of the return to the horizon: 1 above the threshold, -1 below its negative, else 0."""
    out = vertical_barriers(df, horizon, by, order, "end_time").withColumn("fwd_return", ratio(after(price, horizon, by, order), price) - 1)
    r = F.col("fwd_return")
    out = out.withColumn("label", F.when(r > threshold, 1).when(r < -threshold, -1).when(r.isNotNull(), 0))
    out = out.where(event) if event else out
    return out.where("end_time is not null") if drop_censored else out


def triple_barrier(df: DataFrame, price: str = "close", target: str | float = 0.02, horizon: int = 5, upper: float | None = 1.0, lower: float | None = 1.0, side: str | None = None, min_target: float = 0.0, drop_censored: bool = True, event: str | None = None, by=BY, order=ORDER) -> DataFrame:
    """vertical_barrier, touch_time, barrier (upper, lower, vertical, censored), target, ret and label: which of
    the barriers target * upper, -target * lower the side's return touches first within `horizon` rows, else the vertical one. The label is
    the sign of the return or, with a side, whether it is positive. Frames of `horizon` rows are folded in place: no row meets more than that."""
    w = ordered(by, order)
    ahead = w.rowsBetween(1, horizon)
    rows = df.withColumn("target", F.col(target).cast("double") if isinstance(target, str) else F.lit(float(target)))
    rows = rows.withColumn("__side", F.col(side).cast("double") if side else F.lit(1.0))
    path = F.collect_list(F.struct(F.col(order[0]).alias("t"), F.col(price).alias("p"))).over(ahead)
    rows = rows.withColumn("vertical_barrier", F.lead(order[0], horizon).over(w)).withColumn("__path", path)
    rows = rows.where(event) if event else rows
    rows = rows.where(F.col("target") > min_target)
    if drop_censored:
        rows = rows.where("vertical_barrier is not null")
    moved = lambda x: (x["p"] / F.col(price) - 1) * F.col("__side")
    up = (lambda x: moved(x) >= upper * F.col("target")) if upper is not None else (lambda x: F.lit(False))
    down = (lambda x: moved(x) <= -lower * F.col("target")) if lower is not None else (lambda x: F.lit(False))
    hit = F.get(F.filter("__path", lambda x: up(x) | down(x)), F.lit(0))
    end = F.when(F.col("vertical_barrier").isNotNull(), F.element_at("__path", -1))
    rows = rows.withColumn("__hit", hit).withColumn("__touch", F.coalesce(F.col("__hit"), end))
    barrier = F.when(F.col("__hit").isNull(), F.when(F.col("vertical_barrier").isNotNull(), "vertical").otherwise("censored")).when(up(F.col("__hit")), "upper").otherwise("lower")
    rows = rows.withColumn("barrier", barrier).withColumn("touch_time", F.col("__touch.t")).withColumn("ret", F.col("__touch.p") / F.col(price) - 1)
    adjusted = F.col("ret") * F.col("__side")
    label = (adjusted > 0).cast("int") if side else F.signum(adjusted).cast("int")
    if side:
        rows = rows.withColumn("adjusted_ret", adjusted)
    return rows.withColumn("label", label).drop("__side", "__path", "__hit", "__touch")


def meta_label(df: DataFrame, ret: str = "ret", side: str = "side", threshold: float = 0.0, out: str = "meta_label") -> DataFrame:
    """1 where the side's return is above the threshold, else 0; null where either is."""
    return df.withColumn(out, F.when(F.col(ret).isNotNull() & F.col(side).isNotNull(), (F.col(ret) * F.col(side) > threshold).cast("int")))


def prune_labels(df: DataFrame, label: str = "label", min_fraction: float = 0.05, min_classes: int = 2, order=ORDER) -> tuple[DataFrame, DataFrame]:
    """(rows of the classes that stay, report): drops the rarest class below the fraction until none is or `min_classes` are
    left; ties go to the class seen first. Only the counts of classes reach the driver."""
    seen = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("first")).orderBy("first").collect()
    counts = {r[label]: r.n for r in seen}
    left, dropped = dict(counts), {}
    while len(left) > min_classes:
        total = sum(left.values())
        rare = [k for k in left if left[k] / total < min_fraction]
        if not rare:
            break
        worst = min(rare, key=lambda k: left[k])
        dropped[worst] = len(dropped) + 1
        del left[worst]
    total, rest = sum(counts.values()), sum(left.values())
    kind = df.schema[label].dataType.simpleString()
    report = [(k, n, n / total, left.get(k, 0), left.get(k, 0) / rest if rest else 0.0, k in dropped, dropped.get(k)) for k, n in counts.items()]
    schema = f"label {kind}, initial_count long, initial_fraction double, final_count long, final_fraction double, dropped boolean, drop_step int"
    return df.where(~F.col(label).isin(list(dropped))) if dropped else df, df.sparkSession.createDataFrame(report, schema)


def trend_scanning(df: DataFrame, price: str = "close", horizons: tuple[int, ...] = tuple(range(5, 21)), min_t_value: float = 0.0, log_prices: bool = True, drop_censored: bool = True, event: str | None = None, by=BY, order=ORDER) -> DataFrame:
    """end_time, horizon, slope, t_value, ret and label: of the forward least squares lines over each horizon, the one of
    the largest absolute t value, the shorter of equals; a perfect line's is infinite."""
    w = ordered(by, order)
    y = F.ln(price) if log_prices else F.col(price).cast("double")
    ahead = F.collect_list(F.struct(y.alias("y"), F.col(order[0]).alias("t"), F.col(price).cast("double").alias("p"))).over(w.rowsBetween(0, max(horizons)))
    rows = df.withColumn("__path", ahead)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    made = {}
    for h in horizons:
        n = h + 1
        sxx = n * (n * n - 1) / 12
        part = F.transform(F.slice("__path", 1, n), lambda x: x["y"])
        first = F.struct(part.alias("v"), (total(part) / n).alias("m"))
        line = lambda f: F.struct(f["v"].alias("v"), f["m"].alias("m"), (total(F.transform(f["v"], lambda x, i: (i - h / 2) * (x - f["m"]))) / sxx).alias("b"))
        left = lambda f: total(F.transform(f["v"], lambda x, i: F.pow(x - f["m"] - f["b"] * (i - h / 2), F.lit(2))))
        fit = lambda f: F.struct(f["b"].alias("b"), F.sqrt(left(f) / (n - 2) / sxx).alias("e"), F.greatest(F.lit(1.0), F.array_max(F.transform(f["v"], F.abs))).alias("scale"))
        # each step is a list of one, so that what it found is not worked out again wherever it is used
        one = F.transform(F.transform(F.transform(F.array(first), line), fit), lambda f: F.struct(f["b"].alias("b"), F.when(f["e"] <= f["scale"] * 2.220446049250313e-16, F.when(f["b"] == 0, 0.0).otherwise(F.signum(f["b"]) * F.lit(float("inf")))).otherwise(f["b"] / f["e"]).alias("t")))[0]
        end = F.get("__path", F.lit(h))
        choice = F.struct(F.abs(one["t"]).alias("size"), F.lit(-h).alias("short"), F.lit(h).alias("horizon"), one["b"].alias("slope"), one["t"].alias("t_value"), end["t"].alias("end_time"), (end["p"] / F.col(price) - 1).alias("ret"))
        made[f"__h{h}"] = F.when(F.size("__path") > h, choice)
    rows = rows.withColumns(made)
    best = F.array_max(F.array_compact(F.array(*made)))
    rows = rows.withColumn("__b", best).drop(*made, "__path")
    rows = rows.where(event) if event else rows
    rows = rows.where("__b is not null") if drop_censored else rows
    label = F.when(F.col("t_value").isNull(), None).when(F.abs("t_value") > min_t_value, F.signum("t_value").cast("int")).otherwise(0)
    return rows.select("*", "__b.end_time", "__b.horizon", "__b.slope", "__b.t_value", "__b.ret").drop("__b").withColumn("label", label)
