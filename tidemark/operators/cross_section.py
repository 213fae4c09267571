"""Transforms across the symbols of each date, and returns of groups of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType

from ..functions.frames import col, full, ordered, ratio, rolling, whole


def rank(df: DataFrame, x: str, by=("ts",), method: str = "average", ascending: bool = True, na_option: str = "keep", tie: str = "symbol", out: str = "rank") -> DataFrame:
    """Rank among the group: average, min, max, first (by `tie`) or dense. Nulls keep null, or come at the top or bottom."""
    value = F.col(x)
    key = value.asc_nulls_last() if ascending else value.desc_nulls_last()
    if na_option == "top":
        key = value.asc_nulls_first() if ascending else value.desc_nulls_first()
    w = Window.partitionBy(*by).orderBy(key)
    peers = F.count(F.lit(1)).over(Window.partitionBy(*by, x))
    low = F.rank().over(w)
    made = {
        "average": lambda: low + (peers - 1) / 2,
        "min": lambda: low.cast("double"),
        "max": lambda: (low + peers - 1).cast("double"),
        "dense": lambda: F.dense_rank().over(w).cast("double"),
        "first": lambda: F.row_number().over(Window.partitionBy(*by).orderBy(key, tie)).cast("double"),
    }[method]()
    return df.withColumn(out, F.when(value.isNotNull(), made) if na_option == "keep" else made)


def percentile_rank(df: DataFrame, x: str, by=("ts",), method: str = "average", ascending: bool = True, out: str = "pct_rank") -> DataFrame:
    """Rank over the number of values that are not null."""
    ranked = rank(df, x, by, method, ascending, out="__rank")
    return ranked.withColumn(out, ratio("__rank", F.count(x).over(whole(by)))).drop("__rank")


def zscore(df: DataFrame, x: str, by=("ts",), ddof: int = 0, out: str = "zscore") -> DataFrame:
    w = whole(by)
    spread = (F.stddev_pop if ddof == 0 else F.stddev_samp)(x).over(w)
    return df.withColumn(out, ratio(F.col(x) - F.avg(x).over(w), spread))


def demean(df: DataFrame, x: str, group: str, by=("ts",), weights: str | None = None, out: str = "residual") -> DataFrame:
    """Residual from the (weighted) mean of each group of each date: neutralising one categorical exposure, as windows."""
    w = whole((*by, group))
    ok = F.col(x).isNotNull() & F.col(group).isNotNull()
    weight = F.col(weights) if weights else F.lit(1.0)
    use = F.when(ok & weight.isNotNull(), weight)
    mean = ratio(F.sum(use * F.col(x)).over(w), F.sum(use).over(w))
    return df.withColumn(out, F.when(use.isNotNull(), F.col(x) - mean))


def neutralize(df: DataFrame, x: str, exposures: list[str], by=("ts",), weights: str | None = None, add_intercept: bool = True, out: str = "residual") -> DataFrame:
    """Weighted least squares residuals from numeric exposures and one-hot categories (strings), date by date. Rows with a null
    or NaN stay null. Dates with too few rows are null throughout, and rows of a category without weight. An exposure that the ones
    before explain has no part.

    Means are taken off (by category), then each exposure off those after it and off `x`: sums over one partitioning by
    date. Only two or more categories, whose columns depend on the data, are solved in Python."""
    categories = [e for e in exposures if isinstance(df.schema[e].dataType, StringType)]
    if len(categories) > 1:
        return _neutralize_categories(df, x, exposures, by, weights, add_intercept, out)
    numbers = [e for e in exposures if e not in categories]
    w, known = whole(by), F.lit(True)
    for c in (x, *numbers, *([weights] if weights else [])):
        known = known & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    for c in categories:
        known = known & F.col(c).isNotNull()
    weight = F.col(weights).cast("double") if weights else F.lit(1.0)
    every = df.drop(out).columns
    # the row's own values first, x last
    parts = {f"__e{i}": F.col(e).cast("double") for i, e in enumerate(numbers)} | {"__x": F.col(x).cast("double")}
    rows = df.drop(out).withColumns({**{k: F.when(known, v) for k, v in parts.items()}, "__w": F.when(known, weight)})
    terms = F.lit(len(numbers) + (1 if add_intercept else 0))
    for c in categories:
        terms = terms + F.size(F.collect_set(c).over(w)) - (1 if add_intercept else 0)
    total = lambda c, over: F.sum(F.col("__w") * c).over(over)
    rows = rows.withColumns({"__enough": F.count("__w").over(w) > terms, **{f"__s{i}": total(F.col(f"__e{i}") ** 2, w) for i in range(len(numbers))}})
    if categories or add_intercept:
        own = whole((*by, *categories))
        rows = rows.withColumns({c: F.col(c) - ratio(total(F.col(c), own), F.sum("__w").over(own)) for c in parts})
    for i, e in enumerate(list(parts)[:-1]):
        norm = total(F.col(e) ** 2, w)
        share = lambda c: F.coalesce(F.when(norm > 1e-20 * F.col(f"__s{i}"), total(F.col(c) * F.col(e), w) / norm), F.lit(0.0))  # noqa: B023, E731
        rows = rows.withColumns({c: F.col(c) - share(c) * F.col(e) for c in list(parts)[i + 1 :]})
    return rows.select(*every, F.when(F.col("__enough"), F.col("__x")).alias(out))


def _neutralize_categories(df: DataFrame, x: str, exposures: list[str], by, weights: str | None, add_intercept: bool, out: str) -> DataFrame:
    fields = df.drop(out).schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{out}` double"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        design = pd.get_dummies(frame[exposures], drop_first=add_intercept, dtype=float)
        ok = frame[[x, *exposures, *([weights] if weights else [])]].notna().all(axis=1).to_numpy()
        a = design.to_numpy(float)[ok]
        if add_intercept:
            a = np.column_stack((np.ones(len(a)), a))
        y = frame[x].to_numpy(float)[ok]
        left = np.full(len(frame), np.nan)
        if len(y) > a.shape[1]:
            s = np.sqrt(frame[weights].to_numpy(float)[ok]) if weights else np.ones(len(y))
            left[ok] = y - a @ np.linalg.lstsq(a * s[:, None], y * s, rcond=None)[0]
        return frame.assign(**{out: pd.Series(left, index=frame.index).astype(object).where(~np.isnan(left), None)})

    return df.drop(out).groupBy(*by).applyInPandas(run, ddl)


def relative_strength(df: DataFrame, price: str = "close", lookback: int = 21, method: str = "average", by=("symbol",), order=("ts",), out: str = "strength") -> DataFrame:
    """Percentile rank across symbols of the trailing return."""
    moved = df.withColumn("__ret", ratio(price, F.lag(price, lookback).over(ordered(by, order))) - 1)
    return percentile_rank(moved, "__ret", order, method, out=out).drop("__ret")


def asset_return(df: DataFrame, field: str = "close", field_type: str = "price", by=("symbol",), order=("ts",)) -> Column:
    return {
        "price": lambda: ratio(field, F.lag(field, 1).over(ordered(by, order))) - 1,
        "simple_return": lambda: F.col(field).cast("double"),
        "log_return": lambda: F.expm1(field),
    }[field_type]()


def group_weighted_return(df: DataFrame, group: str = "sectorid", order: str = "ts", symbol: str = "symbol", field: str = "close", field_type: str = "price", weighting: str = "equal", weight_field: str | None = None, weight_lag: int = 1, volatility_window: int = 20, min_assets: int = 1) -> DataFrame:
    """(order, group, weighted_return, asset_count, weight_sum): returns of each group's symbols by weight. Weights other than equal
    are `weight_lag` rows old within their symbol; rows without a return or a positive weight count in neither sum."""
    by, at = (symbol,), (order,)
    rows = df.withColumn(group, F.coalesce(F.col(group).cast("string"), F.lit("UnknownSector")))
    rows = rows.withColumn("__ret", asset_return(df, field, field_type, by, at))
    if weighting == "equal":
        weight = F.lit(1.0)
    else:
        if weighting == "inverse_volatility":
            w = rolling(volatility_window, by, at)
            weight = ratio(F.lit(1.0), full(F.stddev_samp("__ret").over(w), "__ret", w, volatility_window))
        else:
            name = weight_field or {"market_cap": "market_cap", "volume": "volume"}.get(weighting)
            if name is None:
                raise ValueError("custom weighting needs weight_field")
            weight = F.col(name).cast("double")
        rows = rows.withColumn("__raw", weight)
        weight = F.lag("__raw", weight_lag).over(ordered(by, at)) if weight_lag else F.col("__raw")
    rows = rows.withColumn("__w", weight)
    ok = F.col("__ret").isNotNull() & (F.col("__w") > 0)
    sums = rows.groupBy(order, group).agg(
        F.sum(F.when(ok, 1).otherwise(0)).alias("asset_count"), F.coalesce(F.sum(F.when(ok, F.col("__w"))), F.lit(0.0)).alias("weight_sum"), F.sum(F.when(ok, F.col("__w") * F.col("__ret"))).alias("__sum")
    )
    return sums.select(order, group, F.when((F.col("asset_count") >= min_assets) & (F.col("weight_sum") > 0), ratio("__sum", "weight_sum")).alias("weighted_return"), "asset_count", "weight_sum")


def elo(df: DataFrame, daily_vol_window: int = 20, matches: int = 1, initial: float = 1500.0, epsilon: float = 0.001, risk_free: DataFrame | None = None, low: float = 0.2, high: float = 0.8, order: str = "ts", symbol: str = "symbol", sector: str = "sectorid", price: str = "close") -> DataFrame:
    """(order, symbol, sector, match_return, elo, elo_change, matches_played): ratings of the symbols of each sector.

    Each date, every symbol with a log return (less the rate of `risk_free`: order, rate) and a rolling volatility meets
    the `matches` symbols of its sector that were nearest in rating: a return higher by `epsilon` or more wins, less is a draw. Its
    rating follows opponent by opponent, theirs as it was. K is 40 in a symbol's first 60 days, else 10 above `high`, 30
    below `low`, 20 between. Prices are carried over three missing rows at most, ratings over all. Sectors run side by side; dates
    within one follow each other in one task."""
    w, v = ordered((symbol,), (order,)), rolling(daily_vol_window, (symbol,), (order,))
    rows = df.withColumn("__p", F.last(price, True).over(w.rowsBetween(-3, 0)))
    rows = rows.withColumn("__ret", F.ln("__p") - F.ln(F.lag("__p", 1).over(w)))
    if risk_free is not None:
        rows = rows.join(risk_free.select(order, F.col("rate").alias("__rate")), order, "left").withColumn("__ret", F.col("__ret") - F.coalesce("__rate", F.lit(0.0)))
    rows = rows.withColumn("__vol", full(F.stddev_samp("__ret").over(v), "__ret", v, daily_vol_window))
    first = F.coalesce(F.first(sector, True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).cast("string"), F.lit("UnknownSector"))
    age = F.datediff(F.col(order), F.min(order).over(Window.partitionBy(symbol)))
    rows = rows.select(F.col(order).alias("ts"), F.col(symbol).cast("string").alias("symbol"), first.alias("sectorid"), F.col("__ret").alias("match_return"), F.when(F.col("__vol").isNotNull(), F.col("__ret")).alias("form"), age.alias("age"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rating: dict = {}
        made = []
        for _, day in frame.sort_values(["ts", "symbol"], kind="stable").groupby("ts", sort=True):
            before, change, played = dict(rating), {}, {}
            live = [(s, f, a) for s, f, a in zip(day["symbol"], day["form"], day["age"]) if f is not None and f == f]
            for s, form, days in live:
                own = now = before.get(s, initial)
                near = sorted((x for x in live if x[0] != s), key=lambda x: abs(before.get(x[0], initial) - own))[:matches]
                k = 40 if days < 60 else 10 if own > high else 30 if own < low else 20
                for o, other, _ in near:
                    gap = form - other
                    won = 0.5 if abs(gap) < epsilon else float(gap > 0)
                    now += k * (won - 1 / (1 + 10 ** ((before.get(o, initial) - now) / 400)))
                rating[s], change[s], played[s] = now, now - own, len(near)
            names = day["symbol"].tolist()
            made.append(day.assign(elo=[rating.get(s, initial) for s in names], elo_change=[change.get(s, 0.0) for s in names], played=[played.get(s, 0) for s in names]))
        out = pd.concat(made)
        return out.assign(matches_played=out.groupby("symbol")["played"].cumsum())[["ts", "symbol", "sectorid", "match_return", "elo", "elo_change", "matches_played"]]

    kind = rows.schema["ts"].dataType.simpleString()
    out = rows.groupBy("sectorid").applyInPandas(run, f"ts {kind}, symbol string, sectorid string, match_return double, elo double, elo_change double, matches_played long")
    return out.select(F.col("ts").alias(order), F.col("symbol").alias(symbol), F.col("sectorid").alias(sector), "match_return", "elo", "elo_change", "matches_played")


def correlation(df: DataFrame, columns: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, a, b, corr): Pearson correlation of each pair of columns."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    sums = df.groupBy(*by).agg(*(F.corr(a, b).alias(f"{a}\1{b}") for a, b in pairs))
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}\1{b}").alias("corr")) for a, b in pairs)))
    return sums.select(*by, each.alias("x")).select(*by, "x.*")


def winsorized(x: str, low: float, high: float, by=("ts",)) -> Column:
    w = whole(by)
    return F.greatest(F.least(col(x), F.percentile(x, high).over(w)), F.percentile(x, low).over(w))
