"""Statistics of return streams, each series a symbol of a long panel (symbol, ts, ret)."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.frames import BY, ORDER, full, ordered, ratio, rolling, running, whole, with_states
from ..plans.portable import doubles, to_duck


def simple(ret: str, return_type: str = "simple") -> Column:
    return F.expm1(ret) if return_type == "log" else F.col(ret).cast("double")


def clean(df: DataFrame, ret: str = "ret", return_type: str = "simple") -> DataFrame:
    """Rows with a return; log returns become simple ones; below -1 or infinite is an error."""
    out = df.withColumn(ret, simple(ret, return_type)).where(F.col(ret).isNotNull() & ~F.isnan(ret))
    return out.withColumn(ret, F.when((F.col(ret) >= -1) & (F.abs(ret) < float("inf")), F.col(ret)).otherwise(F.raise_error(F.lit("a return is below -1 or infinite")).cast("double")))


def infer_periods_per_year(df: DataFrame, by=BY, order=ORDER) -> DataFrame:
    """(by, periods): 252, 52, 12, 4 or 1 by the median days between rows."""
    days = df.withColumn("__d", F.datediff(order[0], F.lag(order[0], 1).over(ordered(by, order)))).groupBy(*by).agg(F.median("__d").alias("d"))
    d = F.col("d")
    return days.select(*by, F.when(d.isNull() | (d <= 2), 252).when(d <= 8, 52).when(d <= 32, 12).when(d <= 100, 4).otherwise(1).alias("periods"))


def excess(df: DataFrame, ret: str = "ret", rf: float = 0.0, periods: int = 252, out: str = "excess") -> DataFrame:
    return df.withColumn(out, F.col(ret) - ((1 + rf) ** (1 / periods) - 1))


def to_prices(df: DataFrame, ret: str = "ret", base: float = 1.0, out: str = "equity", by=BY, order=ORDER) -> DataFrame:
    return df.withColumn(out, base * F.product(1 + F.col(ret)).over(running(by, order)))


def rebase(df: DataFrame, price: str = "close", base: float = 100.0, out: str = "rebased", by=BY, order=ORDER) -> DataFrame:
    return df.withColumn(out, ratio(price, F.first(price, True).over(ordered(by, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))) * base)


def make_portfolio(df: DataFrame, ret: str = "ret", start_balance: float = 100_000.0, mode: str = "compound", out: str = "balance", by=BY, order=ORDER) -> DataFrame:
    if mode == "compound":
        return to_prices(df, ret, start_balance, out, by, order)
    return df.withColumn(out, start_balance * (1 + F.sum(ret).over(running(by, order))))


def to_log_returns(df: DataFrame, ret: str = "ret", out: str = "log_ret") -> DataFrame:
    return df.withColumn(out, F.log1p(ret))


def to_drawdown_series(df: DataFrame, ret: str = "ret", out: str = "drawdown", by=BY, order=ORDER) -> DataFrame:
    """Equity over its running high, which starts at 1, less one."""
    eq = to_prices(df, ret, out="__eq", by=by, order=order)
    return eq.withColumn(out, F.col("__eq") / F.greatest(F.lit(1.0), F.max("__eq").over(running(by, order))) - 1).drop("__eq")


def drawdown_details(df: DataFrame, ret: str = "ret", by=BY, order=ORDER) -> DataFrame:
    """(by, start, valley, end, days, max_drawdown) of each stretch under water: from the row before it to its last."""
    t = order[0]
    dd = to_drawdown_series(df, ret, "__dd", by, order)
    under = (F.col("__dd") < 0).cast("int")
    dd = dd.withColumn("__u", under).withColumn("__before", F.coalesce(F.lag(t, 1).over(ordered(by, order)), F.col(t)))
    dd = dd.withColumn("__run", F.sum(1 - F.col("__u")).over(running(by, order))).where("__u = 1")
    out = dd.groupBy(*by, "__run").agg(F.min_by("__before", t).alias("start"), F.min_by(t, F.struct("__dd", t)).alias("valley"), F.max(t).alias("end"), F.min("__dd").alias("max_drawdown"))
    return out.select(*by, "start", "valley", "end", F.datediff("end", "start").alias("days"), "max_drawdown")


#: Each is an aggregate, as text that Spark and DuckDB read, over the columns of enriched(): ret, ex (excess), eq and exeq
#: (their equity), dd, prev (ret one row before), bench where given, ts. {P} is the periods in a year.
_DOWN = "sqrt(avg(pow(least(ex, 0.0), 2)))"
_SHARPE = "avg(ex) / nullif(stddev_samp(ex), 0) * sqrt({P})"
_SORTINO = f"avg(ex) / nullif({_DOWN}, 0) * sqrt({{P}})"
_CAGR = "CASE WHEN max_by(exeq, ts) > 0 THEN pow(max_by(exeq, ts), {P} / count(ret)) - 1 ELSE -1.0 END"
_WIN = "avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret < 0 THEN 0.0 END)"
_AVG_WIN, _AVG_LOSS = "avg(CASE WHEN ret > 0 THEN ret END)", "avg(CASE WHEN ret < 0 THEN ret END)"
_GAIN, _LOSS = "sum(greatest(ret, 0.0))", "sum(greatest(-ret, 0.0))"
_PAYOFF = f"{_AVG_WIN} / nullif(abs({_AVG_LOSS}), 0)"
_PF = f"CASE WHEN {_LOSS} > 0 THEN {_GAIN} / {_LOSS} ELSE CAST('Infinity' AS DOUBLE) END"
_TAIL = "abs(percentile(ret, 0.95) / nullif(percentile(ret, 0.05), 0))"
_ULCER = "sqrt(avg(dd * dd))"
_SKEW = "sqrt(count(ret) * (count(ret) - 1.0)) / nullif(count(ret) - 2, 0) * (avg(pow(dev, 3)) / nullif(pow(avg(pow(dev, 2)), 1.5), 0))"
_KURT = "(count(ret) - 1.0) / nullif((count(ret) - 2.0) * (count(ret) - 3.0), 0) * ((count(ret) + 1.0) * (avg(pow(dev, 4)) / nullif(pow(avg(pow(dev, 2)), 2), 0) - 3) + 6)"
_BETA = "covar_samp(ret, bench) / nullif(var_samp(bench), 0)"
_VAR95 = "greatest(0.0, percentile(-ret, 0.95))"
_RHO = "abs(corr(CASE WHEN prev IS NOT NULL THEN ret END, prev))"
#: 1 + 2 * sum over k of (n - k) / n * rho^k, in closed form
_PENALTY = f"sqrt(1 + 2 * ({_RHO} / nullif(1 - {_RHO}, 0) - {_RHO} * (1 - pow({_RHO}, count(ret))) / nullif(count(ret) * pow(1 - {_RHO}, 2), 0)))"
STATISTICS = {
    "total_return": "max_by(eq, ts) - 1",
    "cagr": _CAGR,
    "volatility": "stddev_samp(ret) * sqrt({P})",
    "sharpe": _SHARPE,
    "smart_sharpe": f"{_SHARPE} / nullif({_PENALTY}, 0)",
    "sortino": _SORTINO,
    "smart_sortino": f"{_SORTINO} / nullif({_PENALTY}, 0)",
    "adjusted_sortino": f"{_SORTINO} / sqrt(2.0)",
    "autocorr_penalty": _PENALTY,
    "max_drawdown": "min(dd)",
    "calmar": f"({_CAGR}) / nullif(abs(min(dd)), 0)",
    "win_rate": _WIN,
    "periods": "count(ret)",
    "geometric_mean": "pow(max_by(eq, ts), 1.0 / count(ret)) - 1",
    "exposure": "avg(CASE WHEN ret <> 0 THEN 1.0 ELSE 0.0 END)",
    "rar": f"({_CAGR}) / nullif(avg(CASE WHEN ret <> 0 THEN 1.0 ELSE 0.0 END), 0)",
    "omega": "sum(greatest(ex, 0.0)) / nullif(sum(greatest(-ex, 0.0)), 0)",
    "gain_to_pain_ratio": "sum(ex) / nullif(sum(greatest(-ex, 0.0)), 0)",
    "skew": _SKEW,
    "kurtosis": _KURT,
    "ulcer_index": _ULCER,
    "ulcer_performance_index": f"({_CAGR}) / nullif({_ULCER}, 0)",
    "risk_of_ruin": f"pow((1 - {_WIN}) / (1 + {_WIN}), count(ret))",
    "tail_ratio": _TAIL,
    "avg_return": "avg(CASE WHEN ret <> 0 THEN ret END)",
    "avg_win": _AVG_WIN,
    "avg_loss": _AVG_LOSS,
    "payoff_ratio": _PAYOFF,
    "profit_ratio": "CASE WHEN count(CASE WHEN ret > 0 THEN 1 END) = 0 THEN 0.0 ELSE CAST(count(CASE WHEN ret > 0 THEN 1 END) AS DOUBLE) / nullif(count(CASE WHEN ret < 0 THEN 1 END), 0) END",
    "profit_factor": _PF,
    "cpc_index": f"({_PF}) * {_WIN} * ({_PAYOFF})",
    "common_sense_ratio": f"({_PF}) * ({_TAIL})",
    "outlier_win_ratio": f"percentile(ret, 0.99) / nullif({_AVG_WIN}, 0)",
    "outlier_loss_ratio": f"percentile(ret, 0.01) / nullif({_AVG_LOSS}, 0)",
    "recovery_factor": "abs(max_by(eq, ts) - 1 - {RF}) / nullif(abs(min(dd)), 0)",
    "risk_return_ratio": "avg(ret) / nullif(stddev_samp(ret), 0)",
    "kelly_criterion": f"({_PAYOFF} * {_WIN} - (1 - {_WIN})) / nullif({_PAYOFF}, 0)",
    "best": "max(ret)",
    "worst": "min(ret)",
    "consecutive_wins": "max(CASE WHEN ret > 0 THEN streak ELSE 0 END)",
    "consecutive_losses": "max(CASE WHEN ret < 0 THEN streak ELSE 0 END)",
    "historical_value_at_risk": _VAR95,
    "gaussian_value_at_risk": f"greatest(0.0, -avg(ret) + stddev_samp(ret) * {NormalDist().inv_cdf(0.95)!r})",
    "gaussian_expected_shortfall": f"greatest(0.0, -avg(ret) + stddev_samp(ret) * {NormalDist().pdf(NormalDist().inv_cdf(0.95)) / 0.05!r})",
    "lower_partial_moment": "avg(greatest(-ret, 0.0))",
    "maximum_observed_loss": "greatest(0.0, max(-ret))",
}
#: Those that need a benchmark, over the rows that have both.
RELATIVE = {
    "beta": _BETA,
    "alpha": f"(avg(ret) - {_BETA} * avg(bench)) * {{P}}",
    "correlation": "corr(ret, bench)",
    "r_squared": "pow(corr(ret, bench), 2)",
    "information_ratio": "avg(ret - bench) / nullif(stddev_samp(ret - bench), 0) * sqrt({P})",
    "tracking_error": "stddev_samp(ret - bench) * sqrt({P})",
    "active_return": "(max_by(eq, ts) - 1) - (max_by(beq, ts) - 1)",
    "benchmark_return": "max_by(beq, ts) - 1",
    "treynor_ratio": f"avg(ex) * {{P}} / nullif({_BETA}, 0)",
}


def enriched(df: DataFrame, ret: str = "ret", rf: float = 0.0, periods: int = 252, bench: str | None = None, by=BY, order=ORDER) -> DataFrame:
    """The columns that STATISTICS and RELATIVE are written over; one sort of each series serves them all."""
    keep = [*by, F.col(order[0]).alias("ts"), F.col(ret).alias("ret"), *([F.col(bench).alias("bench")] if bench else [])]
    out = df.where(F.col(ret).isNotNull() & (F.col(bench).isNotNull() if bench else F.lit(True))).select(*keep)
    w, r = ordered(by, ("ts",)), running(by, ("ts",))
    out = out.withColumn("ex", F.col("ret") - ((1 + rf) ** (1 / periods) - 1))
    made = {"eq": F.product(1 + F.col("ret")).over(r), "exeq": F.product(1 + F.col("ex")).over(r), "prev": F.lag("ret", 1).over(w), "dev": F.col("ret") - F.avg("ret").over(whole(by)), "__turn": (F.signum("ret") != F.coalesce(F.lag(F.signum("ret"), 1).over(w), F.lit(9.0))).cast("int")}
    if bench:
        made["beq"] = F.product(1 + F.col("bench")).over(r)
    out = out.withColumns(made)
    out = out.withColumns({"dd": F.col("eq") / F.greatest(F.lit(1.0), F.max("eq").over(r)) - 1, "__run": F.sum("__turn").over(r)})
    return out.withColumn("streak", F.row_number().over(ordered((*by, "__run"), ("ts",)))).drop("__turn", "__run")


def statistics(df: DataFrame, names: list[str], ret: str = "ret", rf: float = 0.0, periods: int = 252, bench: str | None = None, by=BY, order=ORDER) -> DataFrame:
    """(by, one column for each name) of STATISTICS and, with a benchmark, RELATIVE: one aggregation whatever the
    number of names."""
    table = STATISTICS | (RELATIVE if bench else {})
    text = lambda n: doubles(table[n].replace("{P}", f"{float(periods)!r}").replace("{RF}", repr(float(rf))))
    return enriched(df, ret, rf, periods, bench, by, order).groupBy(*by).agg(*(F.expr(text(n)).alias(n) for n in names))


def statistics_sql(source: str, names: list[str], rf: float = 0.0, periods: int = 252, bench: bool = False) -> str:
    """The same in DuckDB over a SELECT of symbol, ts, ret and bench."""
    table = STATISTICS | (RELATIVE if bench else {})
    text = lambda n: doubles(to_duck(table[n]).replace("{P}", f"{float(periods)!r}").replace("{RF}", repr(float(rf))))
    run = "OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)"
    beq = f", product(1 + bench) {run} AS beq" if bench else ""
    return f"""WITH a AS (SELECT *, ret - {(1 + rf) ** (1 / periods) - 1!r} AS ex FROM ({source}) AS s WHERE ret IS NOT NULL{' AND bench IS NOT NULL' if bench else ''}),
b AS (SELECT *, product(1 + ret) {run} AS eq, product(1 + ex) {run} AS exeq, lag(ret) OVER (PARTITION BY symbol ORDER BY ts) AS prev,
  ret - avg(ret) OVER (PARTITION BY symbol) AS dev, CASE WHEN sign(ret) <> coalesce(lag(sign(ret)) OVER (PARTITION BY symbol ORDER BY ts), 9) THEN 1 ELSE 0 END AS turn{beq} FROM a),
c AS (SELECT *, eq / greatest(1.0, max(eq) {run}) - 1 AS dd, sum(turn) {run} AS grp FROM b),
d AS (SELECT *, row_number() OVER (PARTITION BY symbol, grp ORDER BY ts) AS streak FROM c)
SELECT symbol, {', '.join(f'{text(n)} AS {n}' for n in names)} FROM d GROUP BY symbol"""


PERFORMANCE = ["total_return", "cagr", "volatility", "sharpe", "sortino", "calmar", "max_drawdown", "win_rate", "periods"]
BASIC = ["exposure", "total_return", "cagr", "sharpe", "sortino", "max_drawdown", "volatility", "win_rate"]


def performance(df: DataFrame, **options) -> DataFrame:
    return statistics(df, PERFORMANCE, **options)


def metrics(df: DataFrame, mode: str = "full", by=BY, **options) -> DataFrame:
    """(by, metric, value): the statistics as rows."""
    bench = options.get("bench")
    names = BASIC if mode == "basic" else [*STATISTICS, *(RELATIVE if bench else ())]
    wide = statistics(df, names, by=by, **options)
    return wide.select(*by, F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names))).alias("x")).select(*by, "x.*")


def benchmark_stats(df: DataFrame, **options) -> DataFrame:
    return statistics(df, ["total_return", "benchmark_return", "active_return", "beta", "alpha", "correlation", "tracking_error", "information_ratio", "periods"], bench=options.pop("bench", "bench"), **options)


def probabilistic_ratio(df: DataFrame, base: str = "sharpe", periods: int = 252, by=BY, **options) -> DataFrame:
    """(by, probability) that the true ratio is above zero. The normal distribution is a rational approximation with an error
    below 1e-7."""
    s = statistics(df, [base, "skew", "kurtosis", "periods"], periods=periods, by=by, **options)
    r = F.col(base) / math.sqrt(periods)
    variance = 1 - F.col("skew") * r + (F.col("kurtosis") + 2) / 4 * r * r
    return s.select(*by, F.when(variance > 0, normal_cdf(r * F.sqrt(F.col("periods") - 1) / F.sqrt(variance))).alias("probability"))


def normal_cdf(z: Column) -> Column:
    # The polynomial of Abramowitz and Stegun 26.2.17.
    t = 1 / (1 + 0.2316419 * F.abs(z))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def rolling_volatility(df: DataFrame, ret: str = "ret", window: int = 63, periods: int = 252, out: str = "rolling_volatility", by=BY, order=ORDER) -> DataFrame:
    w = rolling(window, by, order)
    return df.withColumn(out, full(F.stddev_samp(ret).over(w), ret, w, window) * math.sqrt(periods))


def rolling_sharpe(df: DataFrame, ret: str = "ret", window: int = 63, periods: int = 252, rf: float = 0.0, out: str = "rolling_sharpe", by=BY, order=ORDER) -> DataFrame:
    w, ex = rolling(window, by, order), F.col(ret) - ((1 + rf) ** (1 / periods) - 1)
    return df.withColumn(out, full(ratio(F.avg(ex).over(w), F.stddev_samp(ex).over(w)), ret, w, window) * math.sqrt(periods))


def rolling_sortino(df: DataFrame, ret: str = "ret", window: int = 63, periods: int = 252, rf: float = 0.0, out: str = "rolling_sortino", by=BY, order=ORDER) -> DataFrame:
    w, ex = rolling(window, by, order), F.col(ret) - ((1 + rf) ** (1 / periods) - 1)
    down = F.sqrt(F.avg(F.pow(F.least(ex, F.lit(0.0)), F.lit(2))).over(w))
    return df.withColumn(out, full(ratio(F.avg(ex).over(w), down), ret, w, window) * math.sqrt(periods))


def rolling_beta(df: DataFrame, ret: str = "ret", bench: str = "bench", window: int = 63, out: str = "rolling_beta", by=BY, order=ORDER) -> DataFrame:
    w = rolling(window, by, order)
    return df.withColumn(out, full(ratio(F.covar_samp(ret, bench).over(w), F.var_samp(bench).over(w)), ret, w, window))


def rolling_alpha(df: DataFrame, ret: str = "ret", bench: str = "bench", window: int = 63, periods: int = 252, out: str = "rolling_alpha", by=BY, order=ORDER) -> DataFrame:
    """Rolling mean of the return less that row's rolling beta times the benchmark, a year's."""
    w = rolling(window, by, order)
    rows = rolling_beta(df, ret, bench, window, "__b", by, order).withColumn("__a", F.col(ret) - F.col("__b") * F.col(bench))
    return rows.withColumn(out, full(F.avg("__a").over(w), "__a", w, window) * periods).drop("__a", "__b")


def exponential_volatility(df: DataFrame, ret: str = "ret", span: int = 30, periods: int = 252, annualize: bool = True, out: str = "exp_volatility", by=BY, order=ORDER) -> DataFrame:
    scale = math.sqrt(periods) if annualize else 1.0
    return with_states(df, lambda f: {out: f[ret].ewm(span=span, min_periods=span).std() * scale}, {out: "double"}, by, order)


def period_end(t: Column, period: str) -> Column:
    """The last day of the week (Monday), month, quarter or year."""
    d = t.cast("date")
    return {
        "D": lambda: d,
        "W": lambda: F.next_day(F.date_sub(d, 1), "Mon"),
        "M": lambda: F.last_day(d),
        "Q": lambda: F.last_day(F.add_months(F.trunc(d, "quarter"), 2)),
        "Y": lambda: F.last_day(F.add_months(F.trunc(d, "year"), 11)),
    }[period]()


def aggregate_returns(df: DataFrame, period: str, ret: str = "ret", by=BY, order=ORDER) -> DataFrame:
    """(by, order, ret): compounded to period ends; periods without rows between the first and the last return 0."""
    t = order[0]
    sums = df.where(F.col(ret).isNotNull()).groupBy(*by, period_end(F.col(t), period).alias(t)).agg((F.product(1 + F.col(ret)) - 1).alias("ret"))
    if period == "D":
        return sums
    step = {"W": "interval 7 days", "M": "interval 1 month", "Q": "interval 3 months", "Y": "interval 12 months"}[period]
    ends = sums.groupBy(*by).agg(F.min(t).alias("a"), F.max(t).alias("b"))
    unit = {"M": "month", "Q": "quarter", "Y": "year"}.get(period)
    days = f"sequence(a, b, {step})" if period == "W" else f"sequence(trunc(a, '{unit}'), trunc(b, '{unit}'), {step})"
    spine = ends.select(*by, F.explode(F.expr(days)).alias("__s")).select(*by, period_end(F.col("__s"), period).alias(t))
    return spine.join(sums, [*by, t], "left").select(*by, t, F.coalesce("ret", F.lit(0.0)).alias("ret"))


def monthly_returns(df: DataFrame, ret: str = "ret", by=BY, order=ORDER) -> DataFrame:
    """(by, year, m1 to m12, eoy): compounded returns, the months side by side."""
    t = order[0]
    cell = lambda m: (F.product(F.when(F.month(t) == m, 1 + F.col(ret))) - 1).alias(f"m{m}")
    return df.where(F.col(ret).isNotNull()).groupBy(*by, F.year(t).alias("year")).agg(*(cell(m) for m in range(1, 13)), (F.product(1 + F.col(ret)) - 1).alias("eoy"))


def period_returns(df: DataFrame, ret: str = "ret", periods: int = 252, by=BY, order=ORDER) -> DataFrame:
    """(by, mtd, m3, m6, ytd, y1, y3, y5, y10, all_time): compounded to each series' last date, the last four a year's."""
    t = order[0]
    rows = df.where(F.col(ret).isNotNull()).withColumn("__d", F.col(t).cast("date")).withColumn("__e", F.max(F.col(t).cast("date")).over(whole(by)))
    since = {"mtd": F.trunc("__e", "month"), "m3": F.add_months("__e", -3), "m6": F.add_months("__e", -6), "ytd": F.trunc("__e", "year"), "y1": F.add_months("__e", -12)}
    long = {"y3": F.add_months("__e", -36), "y5": F.add_months("__e", -60), "y10": F.add_months("__e", -120), "all_time": F.to_date(F.lit("0001-01-01"))}
    growth = lambda a: F.product(F.when(F.col("__d") >= a, 1 + F.col(ret)))
    count = lambda a: F.sum((F.col("__d") >= a).cast("int"))
    made = [(growth(a) - 1).alias(k) for k, a in since.items()]
    made += [F.when(growth(a) > 0, F.pow(growth(a), F.lit(float(periods)) / count(a)) - 1).otherwise(-1.0).alias(k) for k, a in long.items()]
    return rows.groupBy(*by).agg(*made)


def compare(df: DataFrame, ret: str = "ret", bench: str = "bench") -> DataFrame:
    """strategy, benchmark, multiplier and won of each row that has both."""
    both = df.where(F.col(ret).isNotNull() & F.col(bench).isNotNull())
    return both.withColumns({"strategy": F.col(ret), "benchmark": F.col(bench), "multiplier": ratio(ret, bench), "won": F.col(ret) >= F.col(bench)})


def outliers(df: DataFrame, ret: str = "ret", quantile: float = 0.95, keep: bool = False, by=BY) -> DataFrame:
    """Rows above the quantile of their series, or those below it."""
    limit = df.groupBy(*by).agg(F.percentile(ret, quantile).alias("__q"))
    rows = df.join(limit, list(by))
    return rows.where(F.col(ret) < F.col("__q") if keep else F.col(ret) > F.col("__q")).drop("__q")


def remove_outliers(df: DataFrame, ret: str = "ret", quantile: float = 0.95, by=BY) -> DataFrame:
    return outliers(df, ret, quantile, True, by)


def distribution(df: DataFrame, ret: str = "ret", by=BY, order=ORDER) -> DataFrame:
    """(by, period, ts, ret, outlier): returns by day, week, month, quarter and year, those beyond 1.5 interquartile ranges marked."""
    t, out = order[0], None
    for period in "DWMQY":
        part = aggregate_returns(df, period, ret, by, order).select(*by, F.lit(period).alias("period"), F.col(t).cast("date").alias("ts"), "ret")
        out = part if out is None else out.unionByName(part)
    w = whole((*by, "period"))
    low, high = F.percentile("ret", 0.25).over(w), F.percentile("ret", 0.75).over(w)
    return out.withColumn("outlier", (F.col("ret") < low - 1.5 * (high - low)) | (F.col("ret") > high + 1.5 * (high - low)))


def serenity_index(df: DataFrame, ret: str = "ret", rf: float = 0.0, confidence: float = 0.95, by=BY, order=ORDER) -> DataFrame:
    """(by, serenity_index): sum of returns less rf over ulcer index times the drawdowns' shortfall in deviations."""
    from .risk import expected_shortfall

    dd = to_drawdown_series(df.where(F.col(ret).isNotNull()), ret, "__dd", by, order)
    es = expected_shortfall(dd, "__dd", confidence, by).withColumnRenamed("expected_shortfall", "__es")
    sums = dd.groupBy(*by).agg(F.sum(ret).alias("s"), F.stddev_samp(ret).alias("sd"), F.sqrt(F.avg(F.col("__dd") ** 2)).alias("u"))
    return sums.join(es, list(by)).select(*by, ratio(F.col("s") - rf, F.col("u") * ratio("__es", "sd")).alias("serenity_index"))


def netto_number(df: DataFrame, profit: str, unit_of_risk: str, max_adverse_excursion: str, out: str = "netto") -> DataFrame:
    return df.withColumn(out, ratio(profit, (F.col(unit_of_risk) + F.col(max_adverse_excursion)) / 2))


def factor_regression(df: DataFrame, factors: list[str], ret: str = "ret", rf: str | None = None, covariance: str = "nonrobust", confidence: float = 0.95, by=BY) -> DataFrame:
    """(by, term, coef, std_err, t_stat, lower, upper, r_squared, adj_r_squared, residual_vol, n): least squares of returns
    on factors and a constant, plain or HC3 errors, over rows without nulls. Central moments are aggregated in Spark, for HC3 a second
    time with the residuals; only matrices of the factors' number are solved in Python, one row a series. Among factors that
    explain each other the coefficients are the shortest by their centred values. Bounds are normal ones."""
    x = [f"__f{i}" for i in range(len(factors))]
    names, k, z = ["Alpha", *factors], len(factors), NormalDist().inv_cdf(0.5 + confidence / 2)
    y = F.col(ret) - (F.col(rf) if rf else 0.0)
    rows = df.select(*by, *(F.col(f).cast("double").alias(c) for f, c in zip(factors, x)), y.cast("double").alias("__y")).dropna()
    every, n = [*x, "__y"], F.count(F.lit(1))
    sums = rows.groupBy(*by).agg(n.alias("__n"), F.array(*(F.avg(c) for c in every)).alias("__m"), F.array(*(F.covar_pop(c, d) * n for c in every for d in every)).alias("__s"))
    keys = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)

    def solved(frames):
        import numpy as np

        for frame in frames:
            moments = [np.array(v, float).reshape(k + 1, k + 1) for v in frame["__s"]]
            inverse = [np.linalg.pinv(m[:k, :k], hermitian=True) for m in moments]
            yield frame.assign(__c=[c.ravel().tolist() for c in inverse], __b=[(c @ m[:k, k]).tolist() for c, m in zip(inverse, moments)])

    made = sums.mapInPandas(solved, f"{keys}, __n long, __m array<double>, __s array<double>, __c array<double>, __b array<double>")
    if covariance == "HC3":
        own = rows.join(made, list(by))
        off = [F.col(c) - F.col("__m")[i] for i, c in enumerate(x)]
        left, lever = F.col("__y") - F.col("__m")[k], 1 / F.col("__n")
        for i in range(k):
            left = left - F.col("__b")[i] * off[i]
            for j in range(k):
                lever = lever + F.col("__c")[i * k + j] * off[i] * off[j]
        design = [F.lit(1.0), *off]
        squared = (left / F.greatest(1 - lever, F.lit(1e-12))) ** 2
        own = own.select(*by, squared.alias("__e"), *(c.alias(f"__d{i}") for i, c in enumerate(design)))
        spread = own.groupBy(*by).agg(F.array(*(F.sum(F.col("__e") * F.col(f"__d{i}") * F.col(f"__d{j}")) for i in range(k + 1) for j in range(k + 1))).alias("__v"))
        made = made.join(spread, list(by))
    else:
        made = made.withColumn("__v", F.lit(None).cast("array<double>"))

    def shown(frames):
        import numpy as np

        for frame in frames:
            for row in frame.to_dict("records"):
                n, mean, beta = row["__n"], np.array(row["__m"], float), np.array(row["__b"], float)
                moments = np.array(row["__s"], float).reshape(k + 1, k + 1)
                inverse = np.zeros((k + 1, k + 1))  # of centred factors and a constant
                inverse[0, 0], inverse[1:, 1:] = 1 / n, np.array(row["__c"], float).reshape(k, k)
                total = moments[k, k]
                left = max(0.0, total - beta @ moments[:k, k])
                cov = inverse * (left / max(n - k - 1, 1)) if row["__v"] is None else inverse @ np.array(row["__v"], float).reshape(k + 1, k + 1) @ inverse
                back = np.eye(k + 1)
                back[0, 1:] = -mean[:k]
                se = np.sqrt(np.diag(back @ cov @ back.T))
                b = np.concatenate(([mean[k] - beta @ mean[:k]], beta))
                r2 = 1 - left / total if total else float("nan")
                out = pd.DataFrame({"term": names, "coef": b, "std_err": se, "t_stat": b / np.where(se > 0, se, np.nan), "lower": b - z * se, "upper": b + z * se})
                out = out.assign(r_squared=r2, adj_r_squared=1 - (1 - r2) * (n - 1) / max(n - k - 1, 1), residual_vol=(left / (n - 1)) ** 0.5 if n > 1 else None, n=n)
                for c in reversed(list(by)):
                    out.insert(0, c, row[c])
                yield out

    return made.mapInPandas(shown, f"{keys}, term string, coef double, std_err double, t_stat double, lower double, upper double, r_squared double, adj_r_squared double, residual_vol double, n long")


def rolling_factor_regression(df: DataFrame, factors: list[str], ret: str = "ret", window: int = 63, by=BY, order=ORDER) -> DataFrame:
    """`df` with alpha, a beta for each factor, r_squared and n_obs of the regression over the window."""
    outputs = {"alpha": "double", **{f"beta_{f}": "double" for f in factors}, "r_squared": "double", "n_obs": "int"}

    def work(frame: pd.DataFrame) -> dict:
        import numpy as np

        x = np.column_stack((np.ones(len(frame)), frame[factors].to_numpy(float)))
        y = frame[ret].to_numpy(float)
        made = np.full((len(frame), len(factors) + 3), np.nan)
        for i in range(window - 1, len(frame)):
            a, v = x[i - window + 1 : i + 1], y[i - window + 1 : i + 1]
            ok = np.isfinite(v) & np.isfinite(a).all(axis=1)
            if ok.sum() < window:
                continue
            b = np.linalg.lstsq(a, v, rcond=None)[0]
            left, total = ((v - a @ b) ** 2).sum(), ((v - v.mean()) ** 2).sum()
            made[i] = [*b, 1 - left / total if total else np.nan, window]
        return {k: pd.Series(made[:, j]).astype(object).where(~np.isnan(made[:, j]), None) for j, k in enumerate(outputs)}

    return with_states(df, work, outputs, by, order)


def factor_contributions(df: DataFrame, factors: list[str], ret: str = "ret", by=BY, order=ORDER) -> DataFrame:
    """(by, order, ret, alpha, each factor's loading times it, residual)."""
    coefs = factor_regression(df, factors, ret, by=by).groupBy(*by).pivot("term", ["Alpha", *factors]).agg(F.first("coef"))
    coefs = coefs.select(*by, F.col("Alpha").alias("alpha"), *(F.col(f).alias(f"__{f}") for f in factors))
    rows = df.join(coefs, list(by)).withColumns({f"{f}_part": F.col(f) * F.col(f"__{f}") for f in factors})
    known = F.col("alpha")
    for f in factors:
        known = known + F.col(f"{f}_part")
    return rows.select(*by, *order, ret, "alpha", *(f"{f}_part" for f in factors), (F.col(ret) - known).alias("residual"))


class Returns:
    """A panel of return streams bound to its settings."""

    def __init__(self, df: DataFrame, ret: str = "ret", bench: str | None = None, periods: int = 252, rf: float = 0.0, by=BY, order=ORDER):
        self.df, self.options = df, {"ret": ret, "bench": bench, "periods": periods, "rf": rf, "by": by, "order": order}

    def statistics(self, *names: str) -> DataFrame:
        return statistics(self.df, list(names), **self.options)

    def performance(self) -> DataFrame:
        return performance(self.df, **self.options)

    def metrics(self, mode: str = "full") -> DataFrame:
        return metrics(self.df, mode, **self.options)

    def benchmark_stats(self) -> DataFrame:
        return benchmark_stats(self.df, **self.options)

    def monthly_returns(self) -> DataFrame:
        return monthly_returns(self.df, self.options["ret"], self.options["by"], self.options["order"])

    def rolling(self, what: str, window: int = 63) -> DataFrame:
        work = {"volatility": rolling_volatility, "sharpe": rolling_sharpe, "sortino": rolling_sortino, "beta": rolling_beta, "alpha": rolling_alpha}[what]
        return work(self.df, window=window, by=self.options["by"], order=self.options["order"])

