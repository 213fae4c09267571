"""Queries over the fixtures, one for each operator, and SQL that must give the same rows.

A spec lists a query's columns: x* is a number rounded to six places, x# a whole number, x as it is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import indicators as ind
from ..operators import charts
from ..operators import classification as cls
from ..operators import cross_section as xs
from ..operators import labels as lab
from ..operators import returns as ret
from ..operators import risk
from ..operators import simulate as sim
from ..operators import splits as spl
from ..operators import trades as trd
from ..operators import vector as vec
from ..operators import weights as wts
from ..sources import market
from . import fixtures as fx
from . import smoothing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def shaped(df: DataFrame, spec: str) -> DataFrame:
    out = []
    for c in spec.split():
        name = c.rstrip("*#")
        x = F.col(name)
        out.append((F.round(x.cast("double"), 6) + F.lit(0.0)).alias(name) if c[-1] == "*" else x.cast("long").alias(name) if c[-1] == "#" else x)
    return df.select(*out)


def shaped_sql(sql: str, spec: str) -> str:
    out = []
    for c in spec.split():
        name = c.rstrip("*#")
        out.append(f"round(CAST({name} AS DOUBLE), 6) + 0.0::DOUBLE AS {name}" if c[-1] == "*" else f"CAST({name} AS BIGINT) AS {name}" if c[-1] == "#" else name)
    return f"SELECT {', '.join(out)} FROM ({sql}) AS shaped"


def case(name: str, spec: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: shaped(run(spark, sf_dir), spec)
    if sql:
        ORACLES[name] = shaped_sql(sql, spec)


def _w(n: int, more: str = "") -> str:
    return f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW{more})"


P = "PARTITION BY symbol ORDER BY ts"
D, S = f"({fx.DAILY}) AS d", f"({fx.STREAM}) AS s"


def _full(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) {_w(n)} >= {n} THEN {agg} {_w(n)} END"


# scans and ingest
case("ohlcv_bars_hourly", "symbol ts open* high* low* close* volume*", lambda s, d: fx.hourly(s, d).withColumn("ts", F.col("ts").cast("timestamp_ntz")), fx.HOURLY)
case(
    "deduplicate_last", "symbol day event_id#",
    lambda s, d: market.deduplicate(fx.ticks(s, d).withColumn("day", F.to_date("ts")), ("symbol", "day"), "last", "event_id"),
    "SELECT event_type AS symbol, CAST(ts AS DATE) AS day, max(event_id) AS event_id FROM events GROUP BY 1, 2",
)
case(
    "deduplicate_first", "symbol day event_id#",
    lambda s, d: market.deduplicate(fx.ticks(s, d).withColumn("day", F.to_date("ts")), ("symbol", "day"), "first", "event_id"),
    "SELECT event_type AS symbol, CAST(ts AS DATE) AS day, min(event_id) AS event_id FROM events GROUP BY 1, 2",
)
case(
    "deduplicate_none", "symbol user_id# event_id#",
    lambda s, d: market.deduplicate(fx.ticks(s, d), ("symbol", "user_id"), False, "event_id"),
    "SELECT event_type AS symbol, user_id, min(event_id) AS event_id FROM events GROUP BY 1, 2 HAVING count(*) = 1",
)
case(
    "detect_gaps", "symbol gap_start gap_end missing_count#",
    lambda s, d: market.detect_gaps(fx.hourly(s, d).withColumn("ts", F.col("ts").cast("timestamp_ntz")), 3600, "ts"),
    f"SELECT symbol, ts AS gap_start, nxt AS gap_end, date_diff('hour', ts, nxt) - 1 AS missing_count FROM (SELECT *, lead(ts) OVER ({P}) AS nxt FROM ({fx.HOURLY}) AS h) AS g WHERE date_diff('hour', ts, nxt) > 1",
)
case(
    "canonicalize_ohlcv", "symbol datetime open* high* low* close* volume*",
    lambda s, d: market.canonicalize_ohlcv(fx.daily(s, d).drop("sectorid").toDF("Ticker", "Date", "Open", "High", "Low", "Close", "Volume").withColumn("seq", F.lit(1)), seq="seq").withColumn("datetime", F.to_date("datetime")),
    f"SELECT symbol, ts AS datetime, open, high, low, close, volume FROM {D}",
)
case(
    "validate_ohlcv", "missing# infinite# high_below_body# low_above_body# high_below_low# negative_volume# repeated# unordered#",
    lambda s, d: market.violations(fx.daily(s, d), "ts"),
    f"SELECT 0 AS missing, 0 AS infinite, count_if(high < greatest(open, close)) AS high_below_body, count_if(low > least(open, close)) AS low_above_body, count_if(high < low) AS high_below_low, count_if(volume < 0) AS negative_volume, 0 AS repeated, 0 AS unordered FROM {D}",
)
case("read_range", "symbol ts close*", lambda s, d: market.read_range(fx.daily(s, d), ["BUILDING"], "1995-01-01", "1996-12-31", "ts"), f"SELECT symbol, ts, close FROM {D} WHERE symbol = 'BUILDING' AND ts BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'")
case(
    "non_trading_days_after", "symbol ts non_trading_days#",
    lambda s, d: market.non_trading_days_after(fx.daily(s, d), fx.daily(s, d).select(F.col("ts").alias("session")).distinct(), "ts"),
    f"SELECT symbol, d.ts, n AS non_trading_days FROM {D} JOIN (SELECT ts, date_diff('day', ts, lead(ts) OVER (ORDER BY ts)) - 1 AS n FROM (SELECT DISTINCT ts FROM {D}) AS u) AS c ON c.ts = d.ts",
)

# indicators of one instrument
case("sma", "symbol ts sma*", lambda s, d: ind.sma(fx.daily(s, d), "close", 20), f"SELECT symbol, ts, {_full('avg(close)', 'close', 20)} AS sma FROM {D}")
_EMA = """WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM {src}),
e AS (SELECT symbol, ts, k, {x} AS ema FROM n WHERE k = 1 UNION ALL SELECT n.symbol, n.ts, n.k, {a} * {x} + (1 - {a}) * e.ema FROM e JOIN n ON n.symbol = e.symbol AND n.k = e.k + 1) SELECT symbol, ts, ema FROM e"""
case("ema", "symbol ts ema*", lambda s, d: ind.ema(fx.daily(s, d), "close", 20), _EMA.format(src=D, x="close", a="(2.0::DOUBLE / 21)"))
case("returns", "symbol ts ret*", lambda s, d: ind.returns(fx.daily(s, d)), f"SELECT symbol, ts, close / lag(close) OVER ({P}) - 1 AS ret FROM {D}")
case("momentum", "symbol ts momentum*", lambda s, d: ind.momentum(fx.daily(s, d)), f"SELECT symbol, ts, close / lag(close, 20) OVER ({P}) - 1 AS momentum FROM {D}")
case("rolling_volatility_indicator", "symbol ts volatility*", lambda s, d: ind.rolling_volatility(fx.stream(s, d)), f"SELECT symbol, ts, {_full('stddev_samp(ret)', 'ret', 20)} AS volatility FROM {S}")
case("volume_ratio_median", "symbol ts volume_ratio*", lambda s, d: ind.volume_ratio(fx.daily(s, d)), f"SELECT symbol, ts, volume / nullif({_full('quantile_cont(volume, 0.5)', 'volume', 20)}, 0) AS volume_ratio FROM {D}")
case("volume_ratio_mean", "symbol ts volume_ratio*", lambda s, d: ind.volume_ratio(fx.daily(s, d), statistic="mean"), f"SELECT symbol, ts, volume / nullif({_full('avg(volume)', 'volume', 20)}, 0) AS volume_ratio FROM {D}")
case("madev", "symbol ts madev*", lambda s, d: ind.madev(fx.daily(s, d), window=19), f"SELECT symbol, ts, {_full('avg(away)', 'away', 19)} AS madev FROM (SELECT *, abs(close - {_full('avg(close)', 'close', 19)}) AS away FROM {D}) AS m")
case("log_returns", "symbol ts log_ret*", lambda s, d: ind.log_returns(fx.daily(s, d)), f"SELECT symbol, ts, ln(close) - ln(lag(close) OVER ({P})) AS log_ret FROM {D}")
_RV = f"""SELECT user_id, session, count(*) AS prices, sum(r * r) AS realized_variance, count(r) / 3.0 * sum(pow(r, 4)) AS realized_quarticity,
 pi() / 2 * count(r) / nullif(count(r) - 1, 0) * sum(abs(r) * abs(r1)) AS bipower_variation,
 {ind.MED3!r} * count(r) / nullif(count(r) - 2, 0) * sum(CASE WHEN r2 IS NOT NULL THEN pow(abs(r) + abs(r1) + abs(r2) - greatest(abs(r), abs(r1), abs(r2)) - least(abs(r), abs(r1), abs(r2)), 2) END) AS med_rv,
 {ind.MIN2!r} * count(r) / nullif(count(r) - 1, 0) * sum(CASE WHEN r1 IS NOT NULL THEN pow(least(abs(r), abs(r1)), 2) END) AS min_rv
 FROM (SELECT *, lag(r) OVER w AS r1, lag(r, 2) OVER w AS r2 FROM (SELECT user_id, CAST(ts AS DATE) AS session, ts, ln(value) - ln(lag(value) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts)) AS r FROM events) AS a WINDOW w AS (PARTITION BY user_id, session ORDER BY ts)) AS b
 GROUP BY 1, 2 HAVING count(*) >= 4"""
case(
    "realized_volatility", "user_id# session prices# realized_variance* realized_quarticity* bipower_variation* med_rv* min_rv*",
    lambda s, d: ind.realized_volatility(fx.ticks(s, d).withColumn("session", F.to_date("ts")), "ts", "price", ("user_id", "session")), _RV,
)


def _strength(s: SparkSession, d: str) -> DataFrame:
    daily = fx.daily(s, d)
    return ind.relative_strength(daily, daily.groupBy("ts").agg(fx.cut(F.avg("close")).alias("bench")))


_BENCHED = f"SELECT d.*, {fx.cut_sql('avg(close) OVER (PARTITION BY ts)')} AS bench FROM {D}"
_STRENGTH = f"SELECT *, close / lag(close, 21) OVER ({P}) - bench / lag(bench, 21) OVER ({P}) AS relative_strength FROM ({_BENCHED}) AS b"
case("relative_strength", "symbol ts relative_strength*", _strength, _STRENGTH)
case(
    "rs_days", "symbol ts rs_days*", lambda s, d: ind.rs_days(_strength(s, d)),
    f"SELECT symbol, ts, {_full('sum(flag)', 'flag', 60)} AS rs_days FROM (SELECT *, CASE WHEN coalesce(relative_strength > 0 AND bench < 0.95 * {_full('max(bench)', 'bench', 60)}, false) THEN 1 ELSE 0 END AS flag FROM ({_STRENGTH}) AS r) AS f",
)
case("rsma_simple", "symbol ts rsma*", lambda s, d: ind.rsma(_strength(s, d), method="simple"), f"SELECT symbol, ts, {_full('avg(relative_strength)', 'relative_strength', 21)} AS rsma FROM ({_STRENGTH}) AS r")
case("rsma_exponential", "symbol ts rsma*", lambda s, d: ind.rsma(_strength(s, d).where("relative_strength is not null")), _EMA.format(src=f"(SELECT * FROM ({_STRENGTH}) AS q WHERE relative_strength IS NOT NULL) AS r", x="relative_strength", a="(2.0::DOUBLE / 22)").replace("SELECT symbol, ts, ema FROM e", "SELECT symbol, ts, ema AS rsma FROM e"))
case(
    "rs_phase", "symbol ts above phase_days#", lambda s, d: ind.rs_phase(ind.rsma(_strength(s, d), method="simple")),
    f"""SELECT symbol, ts, above, sum(CAST(above AS INT)) OVER (PARTITION BY symbol, grp ORDER BY ts ROWS UNBOUNDED PRECEDING) AS phase_days FROM (
 SELECT *, sum(CASE WHEN above THEN 0 ELSE 1 END) OVER ({P} ROWS UNBOUNDED PRECEDING) AS grp FROM (SELECT *, coalesce(relative_strength > {_full('avg(relative_strength)', 'relative_strength', 21)}, false) AS above FROM ({_STRENGTH}) AS r) AS a) AS g""",
)
case(
    "rsnhbp", "symbol ts rsnhbp", lambda s, d: ind.rsnhbp(_strength(s, d)),
    f"SELECT symbol, ts, coalesce(relative_strength > max(relative_strength) OVER ({P} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), false) AND NOT coalesce(close > max(close) OVER ({P} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), false) AS rsnhbp FROM ({_STRENGTH}) AS r",
)
case(
    "volume_spike_ratio", "symbol ts vsr* vsr_spike_type# vsr_trending#", lambda s, d: ind.volume_spike_ratio(fx.daily(s, d), spike_threshold=1.1, reversal_threshold=1.4),
    f"""SELECT symbol, ts, vsr, vsr_trending, CASE WHEN vsr > 1.1 AND vsr < 1.4 AND (CASE vsr_trending WHEN 1 THEN sign(move) WHEN 2 THEN -sign(move) END) > 0 THEN 1 WHEN vsr >= 1.4 AND (CASE vsr_trending WHEN 1 THEN sign(move) WHEN 2 THEN -sign(move) END) < 0 THEN 2 ELSE 0 END AS vsr_spike_type FROM (
 SELECT *, CASE WHEN coalesce(sum(CASE WHEN slope > 0.1 THEN 1 ELSE 0 END) {_w(3)} = 3, false) AND coalesce(close > mean, false) THEN 1 WHEN coalesce(sum(CASE WHEN slope < -0.1 THEN 1 ELSE 0 END) {_w(3)} = 3, false) AND coalesce(close < mean, false) THEN 2 ELSE 0 END AS vsr_trending FROM (
 SELECT *, (mean / nullif(lag(mean) OVER ({P}), 0) - 1) * 100 AS slope FROM (
 SELECT *, coalesce(volume / nullif({_full('avg(volume)', 'volume', 20)}, 0), 0) AS vsr, {_full('avg(close)', 'close', 20)} AS mean, close - lag(close) OVER ({P}) AS move FROM {D}) AS a) AS b) AS c""",
)
case(
    "price_spikes", "symbol ts relative_volume* price_spike_event#", lambda s, d: ind.price_spikes(fx.daily(s, d), atr_multiplier=0.2, volume_threshold=1.1),
    f"""SELECT symbol, ts, rv AS relative_volume, CASE WHEN spike AND coalesce(rv > 1.1, false) THEN 1 WHEN spike THEN 2 ELSE 0 END AS price_spike_event FROM (
 SELECT *, coalesce(abs(move) > 0.2 * {_full('avg(tr)', 'tr', 20)}, false) AS spike, volume / nullif({_full('avg(volume)', 'volume', 20)}, 0) AS rv FROM (
 SELECT *, close - lag(close) OVER ({P}) AS move, greatest(high - low, abs(high - lag(close) OVER ({P})), abs(low - lag(close) OVER ({P}))) AS tr FROM {D}) AS a) AS b""",
)

# cross-section
_RET = f"SELECT *, close / lag(close) OVER ({P}) - 1 AS r FROM {D}"
for _m, _e in {"average": "rank() OVER q + (count(*) OVER (PARTITION BY ts, volume) - 1) / 2.0", "min": "rank() OVER q", "max": "rank() OVER q + count(*) OVER (PARTITION BY ts, volume) - 1", "dense": "dense_rank() OVER q", "first": "row_number() OVER (PARTITION BY ts ORDER BY volume, symbol)"}.items():
    case(f"xs_rank_{_m}", "symbol ts rank*", lambda s, d, m=_m: xs.rank(fx.daily(s, d), "volume", method=m), f"SELECT symbol, ts, {_e} AS rank FROM {D} WINDOW q AS (PARTITION BY ts ORDER BY volume)")
case("xs_rank_column_desc", "symbol ts rank*", lambda s, d: xs.rank(fx.daily(s, d), "close", by=("symbol",), ascending=False, tie="ts"), f"SELECT symbol, ts, rank() OVER (PARTITION BY symbol ORDER BY close DESC) + (count(*) OVER (PARTITION BY symbol, close) - 1) / 2.0 AS rank FROM {D}")
case("xs_percentile_rank", "symbol ts pct_rank*", lambda s, d: xs.percentile_rank(fx.daily(s, d), "volume"), f"SELECT symbol, ts, (rank() OVER (PARTITION BY ts ORDER BY volume) + (count(*) OVER (PARTITION BY ts, volume) - 1) / 2.0) / count(volume) OVER (PARTITION BY ts) AS pct_rank FROM {D}")
case("xs_zscore", "symbol ts zscore*", lambda s, d: xs.zscore(fx.daily(s, d), "close"), f"SELECT symbol, ts, (close - avg(close) OVER (PARTITION BY ts)) / nullif(stddev_pop(close) OVER (PARTITION BY ts), 0) AS zscore FROM {D}")
case(
    "xs_relative_strength", "symbol ts strength*", lambda s, d: xs.relative_strength(fx.daily(s, d)),
    f"SELECT symbol, ts, CASE WHEN m IS NOT NULL THEN (rank() OVER (PARTITION BY ts ORDER BY m NULLS LAST) + (count(*) OVER (PARTITION BY ts, m) - 1) / 2.0) / nullif(count(m) OVER (PARTITION BY ts), 0) END AS strength FROM (SELECT *, close / lag(close, 21) OVER ({P}) - 1 AS m FROM {D}) AS a",
)
case(
    "neutralize_sector", "symbol ts residual*", lambda s, d: xs.demean(fx.daily(s, d), "close", "sectorid", weights="volume"),
    f"SELECT symbol, ts, close - sum(volume * close) OVER (PARTITION BY ts, sectorid) / nullif(sum(volume) OVER (PARTITION BY ts, sectorid), 0) AS residual FROM {D}",
)
case(
    "neutralize", "symbol ts residual*", lambda s, d: xs.neutralize(fx.daily(s, d), "close", ["volume"]).where("residual is not null"),
    f"SELECT symbol, ts, close - CASE WHEN var_pop(volume) OVER w > 0 THEN regr_intercept(close, volume) OVER w + volume * regr_slope(close, volume) OVER w ELSE avg(close) OVER w END AS residual FROM {D} WINDOW w AS (PARTITION BY ts) QUALIFY count(*) OVER w > 2",
)
case(
    "neutralize_weighted", "symbol ts residual*", lambda s, d: xs.neutralize(fx.daily(s, d), "close", ["symbol", "volume"], by=("sectorid",), weights="volume"),
    f"""SELECT symbol, ts, y - e * coalesce(sum(volume * e * y) OVER (PARTITION BY sectorid) / nullif(sum(volume * e * e) OVER (PARTITION BY sectorid), 0), 0) AS residual FROM (
    SELECT symbol, sectorid, ts, volume, close - sum(volume * close) OVER g / sum(volume) OVER g AS y, volume - sum(volume * volume) OVER g / sum(volume) OVER g AS e FROM {D} WINDOW g AS (PARTITION BY sectorid, symbol)) AS c""",
)

def _gwr(weighting: str, **options):
    return lambda s, d: xs.group_weighted_return(fx.daily(s, d), weighting=weighting, **options)


def _gwr_sql(weight: str, least: int = 1) -> str:
    return f"""SELECT ts, sectorid, CASE WHEN asset_count >= {least} AND weight_sum > 0 THEN s / nullif(weight_sum, 0) END AS weighted_return, asset_count, weight_sum FROM (
 SELECT ts, sectorid, count_if(ok) AS asset_count, coalesce(sum(w) FILTER (ok), 0) AS weight_sum, sum(w * r) FILTER (ok) AS s FROM (
 SELECT *, r IS NOT NULL AND coalesce(w > 0, false) AS ok FROM (SELECT *, {weight} AS w FROM ({_RET}) AS a) AS b) AS c GROUP BY ts, sectorid) AS g"""


case("group_weighted_return", "ts sectorid weighted_return* asset_count# weight_sum*", _gwr("volume"), _gwr_sql(f"lag(volume) OVER ({P})"))
case("group_weighted_return_equal", "ts sectorid weighted_return* asset_count# weight_sum*", _gwr("equal", min_assets=2), _gwr_sql("1.0", 2))
case("group_weighted_return_custom", "ts sectorid weighted_return* asset_count# weight_sum*", _gwr("custom", weight_field="close", weight_lag=2), _gwr_sql(f"lag(close, 2) OVER ({P})"))
case(
    "group_weighted_return_inverse_volatility", "ts sectorid weighted_return* asset_count#", _gwr("inverse_volatility"),
    _gwr_sql(f"lag(iv) OVER ({P})").replace(f"({_RET}) AS a", f"(SELECT *, 1 / nullif({_full('stddev_samp(r)', 'r', 20)}, 0) AS iv FROM ({_RET}) AS v) AS a"),
)
case("compute_elo", "symbol ts sectorid elo* elo_change* matches_played#", lambda s, d: xs.elo(fx.daily(s, d)))
case("correlation", "a b corr*", lambda s, d: xs.correlation(fx.daily(s, d), ["open", "close", "volume"]), " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM {D}" for a, b in (("open", "close"), ("open", "volume"), ("close", "volume"))))

# return streams
for _n in ret.STATISTICS:
    case(f"stat_{_n}", f"symbol {_n}*", lambda s, d, n=_n: ret.statistics(fx.stream(s, d), [n], rf=0.02), ret.statistics_sql(fx.STREAM, [_n], rf=0.02))
for _n in ret.RELATIVE:
    case(f"stat_{_n}", f"symbol {_n}*", lambda s, d, n=_n: ret.statistics(fx.stream(s, d), [n], rf=0.02, bench="bench"), ret.statistics_sql(fx.STREAM, [_n], rf=0.02, bench=True))
case("performance", "symbol " + " ".join(f"{n}*" for n in ret.PERFORMANCE), lambda s, d: ret.performance(fx.stream(s, d)), ret.statistics_sql(fx.STREAM, ret.PERFORMANCE))
_ALL = [*ret.STATISTICS, *ret.RELATIVE]
case("metrics", "symbol metric value*", lambda s, d: ret.metrics(fx.stream(s, d), bench="bench"), f"SELECT symbol, unnest([{', '.join(repr(n) for n in _ALL)}]) AS metric, unnest([{', '.join(f'CAST({n} AS DOUBLE)' for n in _ALL)}]) AS value FROM ({ret.statistics_sql(fx.STREAM, _ALL, bench=True)}) AS m")
_BS = ["total_return", "benchmark_return", "active_return", "beta", "alpha", "correlation", "tracking_error", "information_ratio", "periods"]
case("benchmark_stats", "symbol " + " ".join(f"{n}*" for n in _BS), lambda s, d: ret.benchmark_stats(fx.stream(s, d)), ret.statistics_sql(fx.STREAM, _BS, bench=True))
case("infer_periods_per_year", "symbol periods#", lambda s, d: ret.infer_periods_per_year(fx.stream(s, d)), f"SELECT symbol, CASE WHEN m IS NULL OR m <= 2 THEN 252 WHEN m <= 8 THEN 52 WHEN m <= 32 THEN 12 WHEN m <= 100 THEN 4 ELSE 1 END AS periods FROM (SELECT symbol, median(g) AS m FROM (SELECT symbol, date_diff('day', lag(ts) OVER ({P}), ts) AS g FROM {S}) AS a GROUP BY symbol) AS b")
_RUN = f"OVER ({P} ROWS UNBOUNDED PRECEDING)"
_EQ = f"SELECT *, product(1 + ret) {_RUN} AS equity FROM {S}"
_DD = f"SELECT *, equity / greatest(1.0, max(equity) {_RUN}) - 1 AS drawdown FROM ({_EQ}) AS e"
case("to_prices", "symbol ts equity*", lambda s, d: ret.to_prices(fx.stream(s, d)), _EQ)
case("rebase", "symbol ts rebased*", lambda s, d: ret.rebase(fx.daily(s, d)), f"SELECT symbol, ts, close / first_value(close) OVER ({P}) * 100 AS rebased FROM {D}")
case("make_portfolio_compound", "symbol ts balance*", lambda s, d: ret.make_portfolio(fx.stream(s, d), start_balance=1000.0), f"SELECT symbol, ts, 1000 * equity AS balance FROM ({_EQ}) AS e")
case("make_portfolio_linear", "symbol ts balance*", lambda s, d: ret.make_portfolio(fx.stream(s, d), start_balance=1000.0, mode="linear"), f"SELECT symbol, ts, 1000 * (1 + sum(ret) {_RUN}) AS balance FROM {S}")
case("to_log_returns", "symbol ts log_ret*", lambda s, d: ret.to_log_returns(fx.stream(s, d)), f"SELECT symbol, ts, ln(1 + ret) AS log_ret FROM {S}")
case("excess_returns", "symbol ts excess*", lambda s, d: ret.excess(fx.stream(s, d), rf=0.05), f"SELECT symbol, ts, ret - (pow(1.05, 1.0 / 252) - 1) AS excess FROM {S}")
case("drawdown_series", "symbol ts drawdown*", lambda s, d: ret.to_drawdown_series(fx.stream(s, d)), _DD)
case(
    "drawdown_details", "symbol start valley end days# max_drawdown*", lambda s, d: ret.drawdown_details(fx.stream(s, d)),
    f"""SELECT symbol, min_by(before, ts) AS start, min_by(ts, row(drawdown, ts)) AS valley, max(ts) AS "end", date_diff('day', min_by(before, ts), max(ts)) AS days, min(drawdown) AS max_drawdown FROM (
 SELECT *, coalesce(lag(ts) OVER ({P}), ts) AS before, sum(CASE WHEN drawdown < 0 THEN 0 ELSE 1 END) {_RUN} AS grp FROM ({_DD}) AS x) AS y WHERE drawdown < 0 GROUP BY symbol, grp""",
)
ORACLES["drawdown_details"] = ORACLES["drawdown_details"].replace("valley, end,", 'valley, "end",')
for _n, _x, _run in (
    ("rolling_volatility", "stddev_samp(ret) {w} * sqrt(252)", ret.rolling_volatility), ("rolling_sharpe", "avg(ret) {w} / nullif(stddev_samp(ret) {w}, 0) * sqrt(252)", ret.rolling_sharpe),
    ("rolling_sortino", "avg(ret) {w} / nullif(sqrt(avg(pow(least(ret, 0.0), 2)) {w}), 0) * sqrt(252)", ret.rolling_sortino), ("rolling_beta", "covar_samp(ret, bench) {w} / nullif(var_samp(bench) {w}, 0)", ret.rolling_beta),
):
    case(_n, f"symbol ts {_n}*", lambda s, d, f=_run: f(fx.stream(s, d)), f"SELECT symbol, ts, CASE WHEN count(ret) {_w(63)} >= 63 THEN {_x.format(w=_w(63))} END AS {_n} FROM {S}")
_RB = f"SELECT *, CASE WHEN count(ret) {_w(63)} >= 63 THEN covar_samp(ret, bench) {_w(63)} / nullif(var_samp(bench) {_w(63)}, 0) END AS b FROM {S}"
case("rolling_alpha", "symbol ts rolling_alpha*", lambda s, d: ret.rolling_alpha(fx.stream(s, d)), f"SELECT symbol, ts, {_full('avg(a)', 'a', 63)} * 252 AS rolling_alpha FROM (SELECT *, ret - b * bench AS a FROM ({_RB}) AS x) AS y")
case("exponential_volatility", "symbol ts exp_volatility*", lambda s, d: ret.exponential_volatility(fx.stream(s, d)))
case(
    "monthly_returns", "symbol year# " + " ".join(f"m{m}*" for m in range(1, 13)) + " eoy*", lambda s, d: ret.monthly_returns(fx.stream(s, d)),
    f"SELECT symbol, year(ts) AS year, {', '.join(f'product(1 + ret) FILTER (month(ts) = {m}) - 1 AS m{m}' for m in range(1, 13))}, product(1 + ret) - 1 AS eoy FROM {S} GROUP BY 1, 2",
)
for _p, _bucket, _a, _step in (("W", "CAST(ts - INTERVAL 1 DAY AS DATE) + CAST((8 - isodow(ts - INTERVAL 1 DAY)) AS INT)", None, "INTERVAL 7 DAY"), ("M", "last_day(ts)", "month", "INTERVAL 1 MONTH"), ("Q", "last_day(CAST(date_trunc('quarter', ts) + INTERVAL 2 MONTH AS DATE))", "quarter", "INTERVAL 3 MONTH"), ("Y", "last_day(CAST(date_trunc('year', ts) + INTERVAL 11 MONTH AS DATE))", "year", "INTERVAL 12 MONTH")):
    _spine = f"range(a, b + INTERVAL 1 DAY, {_step})" if _p == "W" else f"range(date_trunc('{_a}', a), b + INTERVAL 1 DAY, {_step})"
    _end = {"W": "CAST(t AS DATE)", "M": "last_day(CAST(t AS DATE))", "Q": "last_day(CAST(t + INTERVAL 2 MONTH AS DATE))", "Y": "last_day(CAST(t + INTERVAL 11 MONTH AS DATE))"}[_p]
    case(
        f"aggregate_returns_{_p}", "symbol ts ret*", lambda s, d, p=_p: ret.aggregate_returns(fx.stream(s, d), p),
        f"""WITH g AS (SELECT symbol, {_bucket} AS ts, product(1 + ret) - 1 AS ret FROM {S} GROUP BY 1, 2), e AS (SELECT symbol, CAST(min(ts) AS TIMESTAMP) AS a, CAST(max(ts) AS TIMESTAMP) AS b FROM g GROUP BY symbol),
 p AS (SELECT symbol, {_end} AS ts FROM (SELECT symbol, unnest({_spine}) AS t FROM e) AS u) SELECT p.symbol, p.ts, coalesce(g.ret, 0) AS ret FROM p LEFT JOIN g ON g.symbol = p.symbol AND g.ts = p.ts""",
    )
case(
    "period_returns", "symbol mtd* m3* m6* ytd* y1* y3* y5* y10* all_time*", lambda s, d: ret.period_returns(fx.stream(s, d)),
    "SELECT symbol, " + ", ".join(f"product(1 + ret) FILTER (ts >= {a}) - 1 AS {k}" for k, a in (("mtd", "date_trunc('month', e)"), ("m3", "e - INTERVAL 3 MONTH"), ("m6", "e - INTERVAL 6 MONTH"), ("ytd", "date_trunc('year', e)"), ("y1", "e - INTERVAL 12 MONTH")))
    + ", " + ", ".join(f"CASE WHEN product(1 + ret) FILTER (ts >= {a}) > 0 THEN pow(product(1 + ret) FILTER (ts >= {a}), 252.0 / count(*) FILTER (ts >= {a})) - 1 ELSE -1 END AS {k}" for k, a in (("y3", "e - INTERVAL 36 MONTH"), ("y5", "e - INTERVAL 60 MONTH"), ("y10", "e - INTERVAL 120 MONTH"), ("all_time", "DATE '0001-01-01'")))
    + f" FROM (SELECT *, max(ts) OVER (PARTITION BY symbol) AS e FROM {S}) AS x GROUP BY symbol",
)
case("compare", "symbol ts strategy* benchmark* multiplier* won", lambda s, d: ret.compare(fx.stream(s, d)), f"SELECT symbol, ts, ret AS strategy, bench AS benchmark, ret / nullif(bench, 0) AS multiplier, ret >= bench AS won FROM {S}")
_Q = f"SELECT s.*, quantile_cont(ret, 0.95) OVER (PARTITION BY symbol) AS q FROM {S}"
case("outliers", "symbol ts ret*", lambda s, d: ret.outliers(fx.stream(s, d)), f"SELECT * FROM ({_Q}) AS x WHERE ret > q")
case("remove_outliers", "symbol ts ret*", lambda s, d: ret.remove_outliers(fx.stream(s, d)), f"SELECT * FROM ({_Q}) AS x WHERE ret < q")
case("distribution", "symbol period ts ret* outlier", lambda s, d: ret.distribution(fx.stream(s, d)))
case("probabilistic_ratio", "symbol probability*", lambda s, d: ret.probabilistic_ratio(fx.stream(s, d)))
case("factor_regression", "symbol term coef* std_err* t_stat* r_squared* n#", lambda s, d: ret.factor_regression(fx.stream(s, d), ["bench"]),
     f"""SELECT symbol, unnest(['Alpha', 'bench']) AS term, unnest([ic, b]) AS coef, unnest([sqrt(v * (1.0 / n + mx * mx / sxx)), sqrt(v / sxx)]) AS std_err, unnest([ic / sqrt(v * (1.0 / n + mx * mx / sxx)), b / sqrt(v / sxx)]) AS t_stat, r2 AS r_squared, n FROM (
 SELECT *, (syy - b * b * sxx) / (n - 2) AS v FROM (SELECT symbol, count(*) AS n, regr_slope(ret, bench) AS b, regr_intercept(ret, bench) AS ic, regr_sxx(ret, bench) AS sxx, regr_syy(ret, bench) AS syy, avg(bench) AS mx, regr_r2(ret, bench) AS r2 FROM {S} GROUP BY symbol) AS a) AS q""")  # fmt: skip
case(
    "factor_regression_hc3", "symbol term coef* std_err*", lambda s, d: ret.factor_regression(fx.stream(s, d), ["bench"], covariance="HC3"),
    f"""WITH m AS (SELECT symbol, count(*) AS n, avg(bench) AS mean, var_pop(bench) * count(*) AS sxx, regr_slope(ret, bench) AS b, regr_intercept(ret, bench) AS a FROM {S} GROUP BY symbol),
    e AS (SELECT symbol, n, mean, sxx, a, b, bench - mean AS d, pow((ret - a - b * bench) / greatest(1 - 1.0::DOUBLE / n - pow(bench - mean, 2) / sxx, 1e-12), 2) AS q FROM {S} JOIN m USING (symbol)),
    v AS (SELECT symbol, n, mean, sxx, a, b, sum(q) AS q0, sum(q * d) AS q1, sum(q * d * d) AS q2 FROM e GROUP BY ALL)
    SELECT symbol, 'Alpha' AS term, a AS coef, sqrt(q0 / n / n - 2 * mean * q1 / n / sxx + mean * mean * q2 / sxx / sxx) AS std_err FROM v UNION ALL SELECT symbol, 'bench', b, sqrt(q2) / sxx FROM v""",
)
case("rolling_factor_regression", "symbol ts alpha* beta_bench* r_squared* n_obs#", lambda s, d: ret.rolling_factor_regression(fx.stream(s, d), ["bench"]),
     f"SELECT symbol, ts, {_full('regr_intercept(ret, bench)', 'ret', 63)} AS alpha, {_full('regr_slope(ret, bench)', 'ret', 63)} AS beta_bench, {_full('regr_r2(ret, bench)', 'ret', 63)} AS r_squared, CASE WHEN count(ret) {_w(63)} >= 63 THEN 63 END AS n_obs FROM {S}")
case("factor_contributions", "symbol ts alpha* bench_part* residual*", lambda s, d: ret.factor_contributions(fx.stream(s, d), ["bench"]),
     f"SELECT symbol, ts, regr_intercept(ret, bench) OVER w AS alpha, regr_slope(ret, bench) OVER w * bench AS bench_part, ret - regr_intercept(ret, bench) OVER w - regr_slope(ret, bench) OVER w * bench AS residual FROM {S} WINDOW w AS (PARTITION BY symbol)")
case("serenity_index", "symbol serenity_index*", lambda s, d: ret.serenity_index(fx.stream(s, d)))

# risk
case("expected_shortfall", "symbol expected_shortfall*", lambda s, d: risk.expected_shortfall(fx.stream(s, d)),
     f"SELECT symbol, greatest(0, sum(part * l) / nullif(sum(part), 0)) AS expected_shortfall FROM (SELECT symbol, l, greatest(0.0, least(1.0, n * (1 - 0.95::DOUBLE) - (k - 1))) AS part FROM (SELECT symbol, -ret AS l, count(*) OVER (PARTITION BY symbol) AS n, row_number() OVER (PARTITION BY symbol ORDER BY -ret DESC) AS k FROM {S}) AS a) AS b GROUP BY symbol")
case("tail_conditional_expectation", "symbol tail_expectation*", lambda s, d: risk.tail_conditional_expectation(fx.stream(s, d)),
     f"SELECT symbol, greatest(0, avg(-ret) FILTER (-ret >= v - 1e-15)) AS tail_expectation FROM (SELECT *, greatest(0.0, quantile_cont(-ret, 0.95) OVER (PARTITION BY symbol)) AS v FROM {S}) AS a GROUP BY symbol")
case("entropic_value_at_risk", "symbol entropic_value_at_risk*", lambda s, d: risk.entropic_value_at_risk(fx.stream(s, d)))
case("maximum_observed_dollar_loss", "symbol dollar_loss*", lambda s, d: risk.maximum_observed_dollar_loss(fx.stream(s, d), 1000.0), f"SELECT symbol, 1000 * greatest(0.0, max(-ret)) AS dollar_loss FROM {S} GROUP BY symbol")
case("lower_partial_moment_2", "symbol lower_partial_moment*", lambda s, d: risk.lower_partial_moment(fx.stream(s, d), threshold=0.01, order=2.0), f"SELECT symbol, avg(pow(greatest(0.01 - ret, 0.0), 2)) AS lower_partial_moment FROM {S} GROUP BY symbol")
case("historical_value_at_risk", "symbol value_at_risk*", lambda s, d: risk.historical_value_at_risk(fx.stream(s, d), confidence=0.9), f"SELECT symbol, greatest(0.0, quantile_cont(-ret, 0.9)) AS value_at_risk FROM {S} GROUP BY symbol")

# labels and weights
case("vertical_barriers", "symbol ts vertical_barrier", lambda s, d: lab.vertical_barriers(fx.daily(s, d), 5), f"SELECT symbol, ts, lead(ts, 5) OVER ({P}) AS vertical_barrier FROM {D}")
case("vertical_barriers_wall_clock", "symbol ts vertical_barrier", lambda s, d: lab.vertical_barriers(fx.daily(s, d), "3 days"), f"SELECT symbol, ts, (SELECT min(e.ts) FROM ({fx.DAILY}) AS e WHERE e.symbol = d.symbol AND e.ts >= d.ts + INTERVAL 3 DAY) AS vertical_barrier FROM {D}")
_FH = f"SELECT symbol, ts, lead(ts, 5) OVER ({P}) AS end_time, lead(close, 5) OVER ({P}) / close - 1 AS fwd_return FROM {D}"
case("fixed_horizon", "symbol ts end_time fwd_return* label#", lambda s, d: lab.fixed_horizon(fx.daily(s, d), horizon=5, threshold=0.05), f"SELECT *, CASE WHEN fwd_return > 0.05 THEN 1 WHEN fwd_return < -0.05 THEN -1 ELSE 0 END AS label FROM ({_FH}) AS f WHERE end_time IS NOT NULL")
_NUM = f"SELECT *, row_number() OVER ({P}) AS n FROM {D}"


def _triple(side: bool) -> str:
    sd = "CASE WHEN e.n % 2 = 0 THEN 1 ELSE -1 END" if side else "1"
    return f"""WITH n AS ({_NUM}), e AS (SELECT e.symbol, e.ts, e.n, e.close, {sd} AS side, v.ts AS vertical_barrier FROM n AS e JOIN n AS v ON v.symbol = e.symbol AND v.n = e.n + 5),
 h AS (SELECT e.symbol, e.n, min_by(row(p.ts, p.close, (p.close / e.close - 1) * side), p.n) AS hit FROM e JOIN n AS p ON p.symbol = e.symbol AND p.n > e.n AND p.n <= e.n + 5 WHERE abs((p.close / e.close - 1) * side) >= 0.05 GROUP BY 1, 2),
 j AS (SELECT e.*, h.hit, coalesce(struct_extract_at(h.hit, 1), e.vertical_barrier) AS touch_time FROM e LEFT JOIN h ON h.symbol = e.symbol AND h.n = e.n),
 k AS (SELECT j.*, t.close / j.close - 1 AS ret FROM j JOIN n AS t ON t.symbol = j.symbol AND t.ts = j.touch_time)
 SELECT symbol, ts, vertical_barrier, touch_time, CASE WHEN hit IS NULL THEN 'vertical' WHEN struct_extract_at(hit, 3) >= 0.05 THEN 'upper' ELSE 'lower' END AS barrier, ret, {'CASE WHEN ret * side > 0 THEN 1 ELSE 0 END' if side else 'sign(ret)'} AS label FROM k"""


case("triple_barrier", "symbol ts vertical_barrier touch_time barrier ret* label#", lambda s, d: lab.triple_barrier(fx.daily(s, d), target=0.05), _triple(False))


def _sided(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    return fx.daily(s, d).withColumn("side", F.when(F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) % 2 == 0, 1).otherwise(-1))


case("triple_barrier_side", "symbol ts vertical_barrier touch_time barrier ret* label#", lambda s, d: lab.triple_barrier(_sided(s, d), target=0.05, side="side"), _triple(True))
case("meta_label", "symbol ts meta_label#", lambda s, d: lab.meta_label(fx.stream(s, d).withColumn("side", F.signum("bench"))), f"SELECT symbol, ts, CASE WHEN ret * sign(bench) > 0 THEN 1 ELSE 0 END AS meta_label FROM {S}")
case("cusum_filter", "symbol ts cusum_event#", lambda s, d: lab.cusum_filter(fx.daily(s, d), threshold=0.1))
case("trend_scanning", "symbol ts end_time horizon# slope* t_value* ret* label#", lambda s, d: lab.trend_scanning(fx.daily(s, d), horizons=(3, 5, 8)))
case("prune_labels", "label initial_count# initial_fraction* final_count# final_fraction* dropped drop_step#", lambda s, d: lab.prune_labels(lab.fixed_horizon(fx.daily(s, d), horizon=5, threshold=0.15), min_fraction=0.2, order=("ts", "symbol"))[1])


def _on(work):
    return lambda s, d: work(fx.daily(s, d).select("symbol", "ts", "close"), fx.spans(s, d))


SP = f"({fx.SPANS}) AS e"
_CC = f"SELECT d.symbol, d.ts, d.close, count(e.start_ts) AS concurrency FROM {D} LEFT JOIN {SP} ON e.symbol = d.symbol AND d.ts BETWEEN e.start_ts AND e.end_ts GROUP BY 1, 2, 3"
case("concurrency", "symbol ts concurrency#", _on(wts.concurrency), _CC)
case("indicator_matrix", "symbol obs_position# start_position# member#", _on(wts.indicator_matrix), f"WITH n AS (SELECT symbol, ts, row_number() OVER ({P}) - 1 AS k FROM {D}) SELECT o.symbol, o.k AS obs_position, a.k AS start_position, 1 AS member FROM {SP} JOIN n AS a ON a.symbol = e.symbol AND a.ts = e.start_ts JOIN n AS o ON o.symbol = e.symbol AND o.ts BETWEEN e.start_ts AND e.end_ts")
case("average_uniqueness", "symbol start_ts end_ts uniqueness*", _on(wts.average_uniqueness), f"SELECT e.symbol, start_ts, end_ts, avg(1.0 / concurrency) AS uniqueness FROM {SP} JOIN ({_CC}) AS c ON c.symbol = e.symbol AND c.ts BETWEEN start_ts AND end_ts GROUP BY 1, 2, 3")
_SW = f"SELECT symbol, start_ts, end_ts, w / avg(w) OVER (PARTITION BY symbol) AS weight FROM (SELECT e.symbol, start_ts, end_ts, abs(sum(r / concurrency)) AS w FROM {SP} JOIN (SELECT *, ln(close) - ln(lag(close) OVER ({P})) AS r FROM ({_CC}) AS c0) AS c ON c.symbol = e.symbol AND c.ts BETWEEN start_ts AND end_ts GROUP BY 1, 2, 3) AS x"
case("sample_weights", "symbol start_ts end_ts weight*", _on(wts.sample_weights), _SW)
case("time_decay", "symbol start_ts decay*", lambda s, d: wts.time_decay(_on(wts.average_uniqueness)(s, d), "uniqueness", 0.2), f"SELECT symbol, start_ts, 0.2 + 0.8 * sum(uniqueness) OVER (PARTITION BY symbol ORDER BY start_ts) / sum(uniqueness) OVER (PARTITION BY symbol) AS decay FROM ({ORACLES['average_uniqueness'].replace('round(CAST(uniqueness AS DOUBLE), 6) + 0.0::DOUBLE', 'uniqueness')}) AS u")
case("class_balance_weights", "symbol ts class_weight*", lambda s, d: wts.class_balance_weights(lab.fixed_horizon(fx.daily(s, d), horizon=5, threshold=0.05)), f"SELECT symbol, ts, count(*) OVER (PARTITION BY symbol) * 1.0 / (k * count(*) OVER (PARTITION BY symbol, label)) AS class_weight FROM (SELECT x.*, count(DISTINCT label) OVER (PARTITION BY symbol) AS k FROM (SELECT *, CASE WHEN fwd_return > 0.05 THEN 1 WHEN fwd_return < -0.05 THEN -1 ELSE 0 END AS label FROM ({_FH}) AS f WHERE end_time IS NOT NULL) AS x) AS y")
case("combine_weights", "symbol start_ts combined*", lambda s, d: wts.combine_weights(wts.time_decay(_on(wts.average_uniqueness)(s, d), "uniqueness"), ["uniqueness", "decay"]), f"SELECT symbol, start_ts, p / avg(p) OVER (PARTITION BY symbol) AS combined FROM (SELECT *, uniqueness * sum(uniqueness) OVER (PARTITION BY symbol ORDER BY start_ts) / sum(uniqueness) OVER (PARTITION BY symbol) AS p FROM (SELECT e.symbol, start_ts, end_ts, avg(1.0 / concurrency) AS uniqueness FROM {SP} JOIN ({_CC}) AS c ON c.symbol = e.symbol AND c.ts BETWEEN start_ts AND end_ts GROUP BY 1, 2, 3) AS u) AS v")
case("purging_metadata", "symbol start_ts start_position# end_position# max_end_position# overlaps_previous next_safe_position# next_safe_time", lambda s, d: wts.purging_metadata(fx.daily(s, d), fx.spans(s, d), 2),
     f"""WITH n AS (SELECT symbol, ts, row_number() OVER ({P}) - 1 AS k FROM {D}), p AS (SELECT e.symbol, start_ts, a.k AS start_position, b.k AS end_position FROM {SP} JOIN n AS a ON a.symbol = e.symbol AND a.ts = start_ts JOIN n AS b ON b.symbol = e.symbol AND b.ts = end_ts),
 m AS (SELECT *, max(end_position) OVER (PARTITION BY symbol ORDER BY start_position) AS max_end_position, max(end_position) OVER (PARTITION BY symbol ORDER BY start_position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM p)
 SELECT m.symbol, start_ts, start_position, end_position, max_end_position, coalesce(start_position <= prev, false) AS overlaps_previous, n.k AS next_safe_position, n.ts AS next_safe_time FROM m LEFT JOIN n ON n.symbol = m.symbol AND n.k = max_end_position + 3""")  # fmt: skip
case("sequential_bootstrap", "symbol draw# start_position#", _on(wts.sequential_bootstrap))

# splits
_TIMES = f"SELECT d.symbol, d.ts, n, total FROM {D} JOIN (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS n, count(*) OVER () AS total FROM (SELECT DISTINCT ts FROM {D}) AS u) AS q ON q.ts = d.ts"
case("temporal_split", "symbol ts partition", lambda s, d: spl.temporal_split(fx.daily(s, d), sizes={"train": 0.6, "validation": 0.2, "test": 0.2}), f"SELECT symbol, ts, CASE WHEN n < floor(0.6::DOUBLE * total) THEN 'train' WHEN n < floor((0.6::DOUBLE + 0.2::DOUBLE) * total) THEN 'validation' ELSE 'test' END AS partition FROM ({_TIMES}) AS t")
case("temporal_split_dates", "symbol ts partition", lambda s, d: spl.temporal_split(fx.daily(s, d), "1995-12-31", "1996-12-31", "1997-12-31"), f"SELECT symbol, ts, CASE WHEN ts <= DATE '1995-12-31' THEN 'train' WHEN ts <= DATE '1996-12-31' THEN 'validation' WHEN ts <= DATE '1997-12-31' THEN 'test' ELSE 'excluded' END AS partition FROM {D}")
_WF = f"SELECT symbol, ts, fold, CASE WHEN n >= b AND n < b + z THEN 'test' WHEN n < b - 2 THEN 'train' ELSE 'excluded' END AS partition FROM (SELECT *, floor(total / 4) AS z, total - (3 - fold) * floor(total / 4) AS b FROM ({_TIMES}) AS t, (SELECT unnest([0, 1, 2]) AS fold) AS f) AS x"
case("walk_forward", "symbol ts fold# partition", lambda s, d: spl.walk_forward(fx.daily(s, d), 3, gap=2), _WF)


def _labelled(s: SparkSession, d: str) -> DataFrame:
    return fx.spans(s, d).select("symbol", F.col("start_ts").alias("ts"), F.col("end_ts").alias("label_end"))


_LT = f"SELECT e.symbol, e.start_ts AS ts, e.end_ts AS label_end, n, total FROM {SP} JOIN (SELECT start_ts, row_number() OVER (ORDER BY start_ts) - 1 AS n, count(*) OVER () AS total FROM (SELECT DISTINCT start_ts FROM {SP}) AS u) AS q ON q.start_ts = e.start_ts"
_PW = f"""WITH x AS (SELECT *, floor(total / 4) AS z, total - (3 - fold) * floor(total / 4) AS b FROM ({_LT}) AS t, (SELECT unnest([0, 1, 2]) AS fold) AS f),
 y AS (SELECT *, CASE WHEN n >= b AND n < b + z THEN 'test' WHEN n < b THEN 'train' ELSE 'excluded' END AS p FROM x), z AS (SELECT *, min(CASE WHEN p = 'test' THEN ts END) OVER (PARTITION BY fold) AS t0 FROM y)
 SELECT symbol, ts, label_end, fold, CASE WHEN p = 'train' AND (label_end >= t0 OR ts > t0 - INTERVAL 10 DAY) THEN 'excluded' ELSE p END AS partition FROM z"""
case("purged_walk_forward", "symbol ts fold# partition", lambda s, d: spl.purged_walk_forward(_labelled(s, d), n_splits=3, embargo="10 days"), _PW)
case("split_diagnostics", "fold# partition role rows# proportion* start end", lambda s, d: spl.split_diagnostics(spl.walk_forward(fx.daily(s, d), 3, gap=2)), f"SELECT fold, partition, CASE partition WHEN 'train' THEN 'fit' WHEN 'test' THEN 'holdout' ELSE 'excluded' END AS role, count(*) AS rows, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY fold) AS proportion, min(ts) AS start, max(ts) AS \"end\" FROM ({_WF}) AS w GROUP BY fold, partition")
ORACLES["split_diagnostics"] = ORACLES["split_diagnostics"].replace("SELECT CAST(fold AS BIGINT) AS fold, partition, role, CAST(rows AS BIGINT) AS rows, round(CAST(proportion AS DOUBLE), 6) + 0.0::DOUBLE AS proportion, start, end FROM", 'SELECT CAST(fold AS BIGINT) AS fold, partition, role, CAST(rows AS BIGINT) AS rows, round(CAST(proportion AS DOUBLE), 6) + 0.0::DOUBLE AS proportion, start, "end" FROM')
case("audit_splits", "fold# fit_rows# evaluation_rows# temporally_ordered label_horizons_clear passed", lambda s, d: spl.audit_splits(spl.purged_walk_forward(_labelled(s, d), n_splits=3, embargo="10 days")), f"SELECT fold, count_if(partition = 'train') AS fit_rows, count_if(partition = 'test') AS evaluation_rows, max(CASE WHEN partition = 'train' THEN ts END) < min(CASE WHEN partition = 'test' THEN ts END) AS temporally_ordered, max(CASE WHEN partition = 'train' THEN label_end END) < min(CASE WHEN partition = 'test' THEN ts END) AS label_horizons_clear, max(CASE WHEN partition = 'train' THEN ts END) < min(CASE WHEN partition = 'test' THEN ts END) AND max(CASE WHEN partition = 'train' THEN label_end END) < min(CASE WHEN partition = 'test' THEN ts END) AS passed FROM ({_PW}) AS w GROUP BY fold")
case("standardized", "symbol ts close*", lambda s, d: spl.standardized(spl.temporal_split(fx.daily(s, d), "1996-12-31"), ["close"]), f"SELECT symbol, ts, (close - avg(close) FILTER (ts <= DATE '1996-12-31') OVER ()) / stddev_pop(close) FILTER (ts <= DATE '1996-12-31') OVER () AS close FROM {D}")

# trades
T_ = f"({fx.TRADES}) AS t"


def _stats_sql(by: str | None) -> str:
    rows = f"SELECT *, 'All' AS grp FROM {T_}" + (f" UNION ALL SELECT *, CAST({by} AS VARCHAR) AS grp FROM {T_}" if by else "")
    return f"""WITH r AS ({rows}), m AS (SELECT *, max(exit_time) OVER (PARTITION BY grp ORDER BY entry_time, exit_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM r),
 g AS (SELECT *, sum(CASE WHEN prev IS NULL OR entry_time > prev THEN 1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY entry_time, exit_time ROWS UNBOUNDED PRECEDING) AS run FROM m),
 o AS (SELECT grp, sum(days) AS open_days FROM (SELECT grp, run, date_diff('day', min(entry_time), max(exit_time)) AS days FROM g GROUP BY 1, 2) AS q GROUP BY grp)
 SELECT grp AS "group", count(*) AS trades, avg(CASE WHEN "return" > 0 THEN 1.0 WHEN "return" < 0 THEN 0.0 END) AS win_rate, product(1 + "return") - 1 AS total_return, avg("return") AS avg_return,
 avg(CASE WHEN "return" > 0 THEN "return" END) AS avg_win, avg(CASE WHEN "return" < 0 THEN "return" END) AS avg_loss, avg(CASE WHEN "return" > 0 THEN "return" END) / abs(avg(CASE WHEN "return" < 0 THEN "return" END)) AS payoff_ratio,
 sum(CASE WHEN "return" > 0 THEN "return" END) / abs(sum(CASE WHEN "return" < 0 THEN "return" END)) AS profit_factor, max("return") AS best, min("return") AS worst, avg(date_diff('day', entry_time, exit_time)) AS avg_days,
 median(date_diff('day', entry_time, exit_time)) AS median_days, any_value(open_days) * 1.0 / date_diff('day', min(entry_time), max(exit_time)) AS exposure FROM r JOIN o USING (grp) GROUP BY grp"""


_TS = "group trades* win_rate* avg_return* avg_win* avg_loss* payoff_ratio* profit_factor* best* worst* avg_days* median_days* exposure*"
case("trade_stats", _TS, lambda s, d: trd.trade_stats(fx.trades(s, d)), _stats_sql(None))
case("trade_stats_by", _TS, lambda s, d: trd.trade_stats(fx.trades(s, d), "exit_reason"), _stats_sql("exit_reason"))
for _n in ("trade_stats", "trade_stats_by"):
    ORACLES[_n] = ORACLES[_n].replace("SELECT group, ", 'SELECT "group", ', 1)
case("trades_to_returns", "symbol ts ret*", lambda s, d: trd.trades_to_returns(fx.trades(s, d)), f'SELECT symbol, exit_time AS ts, product(1 + "return") - 1 AS ret FROM {T_} GROUP BY 1, 2')
_BARS = f"SELECT DISTINCT symbol, exit_time AS ts FROM {T_}"
case("trades_to_positions", "symbol ts position#", lambda s, d: trd.trades_to_positions(fx.trades(s, d), fx.trades(s, d).select("symbol", F.col("exit_time").alias("ts")).distinct()), f"SELECT b.symbol, b.ts, sum(t.direction) AS position FROM ({_BARS}) AS b JOIN {T_} ON t.symbol = b.symbol AND b.ts BETWEEN t.entry_time AND t.exit_time GROUP BY 1, 2")

# classification, vectors, text
_CURVE = f"""WITH x AS (SELECT 'class' AS curve, c AS class, CASE WHEN y = c THEN 1 ELSE 0 END AS y, s FROM (SELECT y, unnest(['1', '0']) AS c, unnest([good, bad]) AS s FROM ({fx.SCORED}) AS q) AS e), z AS (SELECT * FROM x UNION ALL SELECT 'micro', NULL, y, s FROM x),
 g AS (SELECT curve, class, s AS threshold, sum(y) AS p, sum(1 - y) AS q FROM z GROUP BY 1, 2, 3),
 k AS (SELECT curve, class, threshold, sum(p) OVER (PARTITION BY curve, class ORDER BY threshold DESC) AS tp, sum(q) OVER (PARTITION BY curve, class ORDER BY threshold DESC) AS fp, sum(p) OVER (PARTITION BY curve, class) AS pos, sum(q) OVER (PARTITION BY curve, class) AS neg FROM g)"""
_SCORES = {"1": "good", "0": "bad"}
_ROC = f"""{_CURVE}, c AS (SELECT curve, class, fp / neg AS fpr, tp / pos AS tpr, threshold FROM k UNION ALL SELECT DISTINCT curve, class, 0, 0, CAST('Infinity' AS DOUBLE) FROM k)
 SELECT *, sum(a) OVER (PARTITION BY curve, class) AS auc FROM (SELECT *, (fpr - lag(fpr) OVER w) * (tpr + lag(tpr) OVER w) / 2 AS a FROM c WINDOW w AS (PARTITION BY curve, class ORDER BY threshold DESC)) AS v"""
case("roc_curve", "curve class fpr* tpr* auc*", lambda s, d: cls.roc_curve(fx.scored(s, d), "y", _SCORES), _ROC)
case("pr_curve", "curve class recall* precision* average_precision*", lambda s, d: cls.precision_recall_curve(fx.scored(s, d), "y", _SCORES),
     f"""{_CURVE}, c AS (SELECT curve, class, tp / pos AS recall, tp / (tp + fp) AS precision, threshold FROM k UNION ALL SELECT DISTINCT curve, class, 0, 1, CAST('Infinity' AS DOUBLE) FROM k)
 SELECT *, sum(a) OVER (PARTITION BY curve, class) AS average_precision FROM (SELECT *, (recall - lag(recall) OVER (PARTITION BY curve, class ORDER BY threshold DESC)) * precision AS a FROM c) AS v""")  # fmt: skip
case("macro_roc", "fpr* tpr*", lambda s, d: cls.macro_roc(cls.roc_curve(fx.scored(s, d), "y", _SCORES)))
_V = "SELECT vec_id AS id, embedding AS vector, CAST(DATE '2024-01-01' + CAST(vec_id % 365 AS INT) AS VARCHAR) AS published_at FROM embeddings"


def _nearest(s: SparkSession, d: str, metric: str) -> DataFrame:
    v = fx.vectors(s, d)
    return vec.search(v, v.where("id = 0").first().vector, as_of="2024-06-30", limit=10, metric=metric)


case("vector_topk_asof", "id# published_at distance*", lambda s, d: _nearest(s, d, "cosine"), f"SELECT id, published_at, 1 - list_cosine_similarity(CAST(vector AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS distance FROM ({_V}) AS v WHERE published_at <= '2024-06-30' ORDER BY distance, id LIMIT 10")
case("vector_topk_l2", "id# distance*", lambda s, d: _nearest(s, d, "l2"), f"SELECT id, pow(list_distance(CAST(vector AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 2) AS distance FROM ({_V}) AS v WHERE published_at <= '2024-06-30' ORDER BY distance, id LIMIT 10")
case("document_chunks", "source_id# id position# chunk", lambda s, d: vec.chunked(fx.table(s, d, "documents").select(F.col("doc_id").alias("source_id"), "text"), size=64, overlap=8),
     r"""SELECT source_id, concat(source_id, ':', left(sha256(chunk), 16), ':', position) AS id, position, chunk FROM (SELECT source_id, k AS position, array_to_string(w[k * 56 + 1:k * 56 + 64], ' ') AS chunk FROM (
 SELECT source_id, w, unnest(range(0, CAST(greatest(0, len(w) - 9) // 56 AS BIGINT) + 1)) AS k FROM (SELECT doc_id AS source_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents) AS a WHERE len(w) > 0) AS b) AS c""")  # fmt: skip

# simulations and replay
case("montecarlo", "symbol sim# step# path*", lambda s, d: sim.montecarlo(fx.stream(s, d), 5, seed=1))
case("montecarlo_outcomes", "symbol terminal_mean* terminal_std* terminal_p50* drawdown_mean* bust_probability* goal_probability*", lambda s, d: sim.outcomes(sim.montecarlo(fx.stream(s, d), 20, seed=1, block_size=10, periods=252), -0.2, 0.1))
case("noise_test", "symbol sim# step# path*", lambda s, d: sim.noise_test(fx.stream(s, d), 5))
case("variance_test", "symbol sim# step# path*", lambda s, d: sim.variance_test(fx.stream(s, d), 100, 5))
case("confidence_band", "symbol step# lower* upper*", lambda s, d: sim.confidence_band(sim.noise_test(fx.stream(s, d), 20)))
case("account_replay", "symbol ts reward* log_equity* log_peak* drawdown* total_cost* steps#", lambda s, d: sim.replay(fx.stream(s, d).withColumn("position", F.signum("bench")), cost=1 / 730).withColumns({"log_equity": F.ln("equity"), "log_peak": F.ln("peak")}),
     f"""SELECT symbol, ts, reward, ln(equity) AS log_equity, ln(peak) AS log_peak, equity / peak - 1 AS drawdown, sum(cost) {_RUN} AS total_cost, row_number() OVER ({P}) AS steps FROM (SELECT *, greatest(1.0, max(equity) {_RUN}) AS peak FROM (SELECT *, product(1 + reward) {_RUN} AS equity FROM (
 SELECT *, p * ret - cost AS reward FROM (SELECT *, (1.0::DOUBLE / 730) * abs(p - coalesce(lag(p) OVER ({P}), 0)) AS cost FROM (SELECT *, sign(bench) AS p FROM {S}) AS a) AS b) AS c) AS e) AS f""")  # fmt: skip

# catalogs of indicators
from ..functions import catalog  # noqa: E402

_UNIT = {"ACOS", "ASIN", "ATAN", "COS", "COSH", "EXP", "SIN", "SINH", "TAN", "TANH"}
_WHOLE = {"MAXINDEX", "MININDEX", "MINMAXINDEX"}


def _catalog(prefix: str, name: str, make) -> None:
    layers = make()
    outs = list(layers[-1])
    unit = name in _UNIT
    spec = "symbol ts " + " ".join(c + ("#" if name in _WHOLE else "*") for c in outs)
    panel = (lambda s, d: fx.daily(s, d).withColumn("close", F.col("close") / 1000)) if unit else fx.daily
    source = f"SELECT * REPLACE (close / 1000 AS close) FROM {D}" if unit else f"SELECT * FROM {D}"
    case(f"{prefix}_{name}", spec, lambda s, d: catalog.add(panel(s, d).drop("sectorid"), layers), catalog.duck(source, layers).replace("SELECT *, ", "SELECT *, ", 1))


for _n, _make in catalog.TA.items():
    _catalog("ta", _n, _make)
for _n, _make in catalog.PTA.items():
    _catalog("pta", _n, _make)

from ..functions import candles, recursive  # noqa: E402

for _n, _make in candles.PATTERNS.items():
    _WHOLE.add(_n)
    _catalog("candle", _n, _make)
case("pta_cdl_pattern", "symbol ts integer#", lambda s, d: catalog.add(fx.daily(s, d).drop("sectorid"), candles.PATTERNS["CDLDOJI"]()), catalog.duck(f"SELECT * FROM {D}", candles.PATTERNS["CDLDOJI"]()))

# indicators that carry a state; the plain ones among them in SQL by recursion
_SEEDED = """WITH RECURSIVE n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k, {x} AS x FROM ({src}) AS q), m AS (SELECT * REPLACE (k - {skip} AS k) FROM n WHERE k > {skip}),
e AS (SELECT symbol, k, avg(x) OVER (PARTITION BY symbol ORDER BY k ROWS UNBOUNDED PRECEDING) AS v FROM m QUALIFY k = {n} UNION ALL SELECT m.symbol, m.k, e.v + {a} * (m.x - e.v) FROM e JOIN m ON m.symbol = e.symbol AND m.k = e.k + 1)"""
_TRUE = f"SELECT *, greatest(high - low, abs(high - lag(close) OVER ({P})), abs(low - lag(close) OVER ({P}))) AS tr, close - lag(close) OVER ({P}) AS dv FROM {D}"


def _ewm(x: str, n: int, a: str, skip: int = 0, src: str = _TRUE) -> str:
    return _SEEDED.format(x=x, n=n, a=a, skip=skip, src=src)


_SIMPLE = {
    "EMA": _ewm("close", 30, "2.0::DOUBLE / 31") + " SELECT n.symbol, n.ts, e.v AS real FROM n LEFT JOIN e ON e.symbol = n.symbol AND e.k = n.k",
    "ATR": _ewm("tr", 14, "1.0::DOUBLE / 14", 1).replace("greatest(high", "greatest(high") + " SELECT n.symbol, n.ts, e.v AS real FROM n LEFT JOIN e ON e.symbol = n.symbol AND e.k = n.k - 1",
}
_SIMPLE["pta_ema"] = _SIMPLE["EMA"].replace("k = 30", "k = 10").replace("/ 31", "/ 11")
_SIMPLE["pta_atr"] = _SIMPLE["ATR"]
_SIMPLE["pta_rma"] = _ewm("close", 10, "1.0::DOUBLE / 10") + " SELECT n.symbol, n.ts, e.v AS real FROM n LEFT JOIN e ON e.symbol = n.symbol AND e.k = n.k"
_SIMPLE["RSI"] = (
    _ewm("greatest(dv, 0)", 14, "1.0::DOUBLE / 14", 1).replace("e AS (", "ea AS (").replace("FROM e JOIN m ON m.symbol = e.symbol AND m.k = e.k + 1", "FROM ea AS e JOIN m ON m.symbol = e.symbol AND m.k = e.k + 1")
    + ", n2 AS (SELECT * REPLACE (greatest(-dv, 0) AS x) FROM m), eb AS (SELECT symbol, k, avg(x) OVER (PARTITION BY symbol ORDER BY k ROWS UNBOUNDED PRECEDING) AS v FROM n2 QUALIFY k = 14 UNION ALL SELECT m.symbol, m.k, e.v + 1.0::DOUBLE / 14 * (m.x - e.v) FROM eb AS e JOIN n2 AS m ON m.symbol = e.symbol AND m.k = e.k + 1)"
    + " SELECT n.symbol, n.ts, 100 * ea.v / nullif(ea.v + eb.v, 0) AS real FROM n LEFT JOIN ea ON ea.symbol = n.symbol AND ea.k = n.k - 1 LEFT JOIN eb ON eb.symbol = n.symbol AND eb.k = n.k - 1"
)
_SIMPLE["pta_rsi"] = _SIMPLE["RSI"]
_SIMPLE |= smoothing.catalog(fx.DAILY)
_SIMPLE["CMO"] = _SIMPLE["RSI"].replace("100 * ea.v / nullif(ea.v + eb.v, 0) AS real", "200 * ea.v / nullif(ea.v + eb.v, 0) - 100 AS real")
_SIMPLE["pta_cmo"] = _SIMPLE["CMO"]
for _n, (_work, _outs) in recursive.CATALOG.items():
    case(f"rec_{_n}", "symbol ts " + " ".join(f"{c}*" for c in _outs), lambda s, d, n=_n: recursive.add(fx.daily(s, d).drop("sectorid"), n), _SIMPLE.get(_n))

# SQL for what takes recursion or several steps there
def _oracle(name: str, spec: str, sql: str) -> None:
    ORACLES[name] = shaped_sql(sql, spec)


_oracle(
    "cusum_filter", "symbol ts cusum_event#",
    f"""WITH RECURSIVE n AS (SELECT symbol, ts, ln(close) - ln(lag(close) OVER ({P})) AS d, row_number() OVER ({P}) AS k FROM {D}),
 e AS (SELECT symbol, ts, k, 0.0::DOUBLE AS up, 0.0::DOUBLE AS dn, 0 AS cusum_event FROM n WHERE k = 1 UNION ALL
 SELECT n.symbol, n.ts, n.k, CASE WHEN least(0, e.dn + d) >= -0.1 AND greatest(0, e.up + d) > 0.1 THEN 0 ELSE greatest(0, e.up + d) END, CASE WHEN least(0, e.dn + d) < -0.1 THEN 0 ELSE least(0, e.dn + d) END,
 CASE WHEN least(0, e.dn + d) < -0.1 THEN -1 WHEN greatest(0, e.up + d) > 0.1 THEN 1 ELSE 0 END FROM e JOIN n ON n.symbol = e.symbol AND n.k = e.k + 1) SELECT * FROM e""",
)
_oracle(
    "exponential_volatility", "symbol ts exp_volatility*",
    f"""WITH RECURSIVE n AS (SELECT symbol, ts, ret, row_number() OVER ({P}) AS k FROM {S}),
 e AS (SELECT symbol, ts, k, 1.0::DOUBLE AS w, 1.0::DOUBLE AS w2, ret AS m, 0.0::DOUBLE AS s FROM n WHERE k = 1 UNION ALL
 SELECT n.symbol, n.ts, n.k, e.w * (29.0::DOUBLE / 31) + 1, e.w2 * pow(29.0::DOUBLE / 31, 2) + 1, e.m + (n.ret - e.m) / (e.w * (29.0::DOUBLE / 31) + 1), e.s * (29.0::DOUBLE / 31) + (n.ret - e.m) * (n.ret - (e.m + (n.ret - e.m) / (e.w * (29.0::DOUBLE / 31) + 1)))
 FROM e JOIN n ON n.symbol = e.symbol AND n.k = e.k + 1)
 SELECT symbol, ts, CASE WHEN k >= 30 THEN sqrt(s / w * (w * w / (w * w - w2))) * sqrt(252) END AS exp_volatility FROM e""",
)
_oracle(
    "trend_scanning", "symbol ts end_time horizon# slope* t_value* ret* label#",
    f"""WITH n AS (SELECT *, ln(close) AS y, row_number() OVER ({P}) AS k FROM {D}),
 f AS (SELECT a.symbol, a.k, h, regr_slope(b.y, b.k - a.k) AS slope, regr_syy(b.y, b.k - a.k) AS syy, regr_sxx(b.y, b.k - a.k) AS sxx FROM n AS a, (SELECT unnest([3, 5, 8]) AS h) AS hs JOIN n AS b ON b.symbol = a.symbol AND b.k BETWEEN a.k AND a.k + h GROUP BY a.symbol, a.k, h HAVING count(*) = h + 1),
 t AS (SELECT *, slope / sqrt(greatest(syy - slope * slope * sxx, 0) / (h - 1) / sxx) AS t_value FROM f),
 p AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY symbol, k ORDER BY abs(t_value) DESC, h) = 1)
 SELECT p.symbol, a.ts, b.ts AS end_time, h AS horizon, slope, t_value, b.close / a.close - 1 AS ret, CASE WHEN abs(t_value) > 0 THEN sign(t_value) ELSE 0 END AS label FROM p JOIN n AS a ON a.symbol = p.symbol AND a.k = p.k JOIN n AS b ON b.symbol = p.symbol AND b.k = p.k + h""",
)
_oracle(
    "serenity_index", "symbol serenity_index*",
    f"""WITH d AS ({_DD}), r AS (SELECT symbol, -drawdown AS l, count(*) OVER (PARTITION BY symbol) AS n, row_number() OVER (PARTITION BY symbol ORDER BY -drawdown DESC) AS k FROM d),
 e AS (SELECT symbol, greatest(0, sum(part * l) / nullif(sum(part), 0)) AS es FROM (SELECT symbol, l, greatest(0.0, least(1.0, n * (1 - 0.95::DOUBLE) - (k - 1))) AS part FROM r) AS q GROUP BY symbol)
 SELECT d.symbol, sum(ret) / nullif(sqrt(avg(drawdown * drawdown)) * any_value(es) / stddev_samp(ret), 0) AS serenity_index FROM d JOIN e ON e.symbol = d.symbol GROUP BY d.symbol""",
)
_PERIODS = " UNION ALL ".join([f"SELECT symbol, 'D' AS period, ts, ret FROM {S}"] + [f"SELECT symbol, '{p}' AS period, ts, ret FROM (" + ORACLES[f"aggregate_returns_{p}"].split("FROM (", 1)[1].rsplit(") AS shaped", 1)[0] + f") AS q{p}" for p in "WMQY"])
_oracle(
    "distribution", "symbol period ts ret* outlier",
    f"SELECT *, ret < lo - 1.5 * (hi - lo) OR ret > hi + 1.5 * (hi - lo) AS outlier FROM (SELECT *, quantile_cont(ret, 0.25) OVER (PARTITION BY symbol, period) AS lo, quantile_cont(ret, 0.75) OVER (PARTITION BY symbol, period) AS hi FROM ({_PERIODS}) AS u) AS v",
)
_oracle(
    "macro_roc", "fpr* tpr*",
    f"""WITH c AS (SELECT class, fpr, max(tpr) AS tpr, min(tpr) AS low FROM ({_ROC}) AS r WHERE curve = 'class' GROUP BY 1, 2), s AS (SELECT *, lead(fpr) OVER (PARTITION BY class ORDER BY fpr) AS nf, lead(low) OVER (PARTITION BY class ORDER BY fpr) AS nl FROM c)
 SELECT x AS fpr, avg(CASE WHEN x = fpr THEN tpr ELSE tpr + (nl - tpr) * (x - fpr) / (nf - fpr) END) AS tpr FROM (SELECT DISTINCT fpr AS x FROM c) AS g JOIN s ON x >= fpr AND x < coalesce(nf, 'Infinity'::DOUBLE) GROUP BY x""",
)
_oracle(
    "prune_labels", "label initial_count# initial_fraction* final_count# final_fraction* dropped drop_step#",
    f"""WITH l AS (SELECT CASE WHEN fwd_return > 0.15 THEN 1 WHEN fwd_return < -0.15 THEN -1 ELSE 0 END AS label, ts, symbol FROM ({_FH}) AS f WHERE end_time IS NOT NULL),
 c AS (SELECT label, count(*) AS n, min(row(ts, symbol)) AS seen FROM l GROUP BY label), t AS (SELECT *, sum(n) OVER () AS total, count(*) OVER () > 2 AND row_number() OVER (ORDER BY n, seen) = 1 AND n * 1.0 / sum(n) OVER () < 0.2 AS dropped FROM c)
 SELECT label, n AS initial_count, n * 1.0 / total AS initial_fraction, CASE WHEN dropped THEN 0 ELSE n END AS final_count, CASE WHEN dropped THEN 0 ELSE n * 1.0 / sum(CASE WHEN dropped THEN 0 ELSE n END) OVER () END AS final_fraction, dropped, CASE WHEN dropped THEN 1 END AS drop_step FROM t""",
)


# frames behind charts
case(
    "chart_cumulative_returns", "symbol ts strategy* benchmark*", lambda s, d: charts.cumulative_returns(fx.stream(s, d), volatility_matched=True, log=True),
    f"SELECT symbol, ts, ln(product(1 + ret) {_RUN}) AS strategy, ln(product(1 + b) {_RUN}) AS benchmark FROM (SELECT *, bench * (stddev_samp(ret) OVER (PARTITION BY symbol) / nullif(stddev_samp(bench) OVER (PARTITION BY symbol), 0)) AS b FROM {S}) AS x",
)
case("chart_eoy_returns", "symbol year# ret*", lambda s, d: charts.eoy_returns(fx.stream(s, d)), f"SELECT symbol, year(ts) AS year, product(1 + ret) - 1 AS ret FROM {S} GROUP BY 1, 2")
_M = ORACLES["aggregate_returns_M"].split("FROM (", 1)[1].rsplit(") AS shaped", 1)[0]
case("chart_monthly_distribution", "symbol bin* n#", lambda s, d: charts.monthly_distribution(fx.stream(s, d), width=0.013), f"SELECT symbol, floor(ret / 0.013::DOUBLE) * 0.013::DOUBLE AS bin, count(*) AS n FROM ({_M}) AS m GROUP BY 1, 2")
case("chart_active_returns", "symbol ts active*", lambda s, d: charts.active_returns(fx.stream(s, d)), f"SELECT symbol, ts, ret - bench AS active FROM {S}")
case(
    "chart_rolling_betas", "symbol ts beta_126* beta_252*", lambda s, d: charts.rolling_betas(fx.stream(s, d)),
    "SELECT symbol, ts, " + ", ".join(f"CASE WHEN count(ret) {_w(n)} >= {n} THEN covar_samp(ret, bench) {_w(n)} / nullif(var_samp(bench) {_w(n)}, 0) END AS beta_{n}" for n in (126, 252)) + f" FROM {S}",
)
_DETAILS = ORACLES["drawdown_details"].split("FROM (", 1)[1].rsplit(") AS shaped", 1)[0]
case("chart_worst_drawdowns", "symbol no# start valley days# max_drawdown*", lambda s, d: charts.worst_drawdowns(fx.stream(s, d)), f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY max_drawdown, start) AS no FROM ({_DETAILS}) AS q) AS z WHERE no <= 5")
case(
    "chart_factor_contributions", "symbol ts bench_total*", lambda s, d: charts.cumulative_contributions(fx.stream(s, d), ["bench"]),
    f"SELECT symbol, ts, sum(b * bench) {_RUN} AS bench_total FROM (SELECT *, regr_slope(ret, bench) OVER (PARTITION BY symbol) AS b FROM {S}) AS x",
)
case("chart_trade_markers", "symbol ts price* kind", lambda s, d: charts.trade_markers(fx.trades(s, d)), f"SELECT symbol, entry_time AS ts, entry_price AS price, 'entry' AS kind FROM {T_} UNION ALL SELECT symbol, exit_time, exit_price, 'exit' FROM {T_}")
case(
    "chart_label_markers", "symbol ts close* label#", lambda s, d: charts.label_markers(fx.daily(s, d), lab.fixed_horizon(fx.daily(s, d).select("symbol", "ts", "close"), horizon=5, threshold=0.05)),
    f"SELECT symbol, ts, close, CASE WHEN r > 0.05 THEN 1 WHEN r < -0.05 THEN -1 ELSE 0 END AS label FROM (SELECT *, lead(close, 5) OVER ({P}) / close - 1 AS r FROM {D}) AS x WHERE r IS NOT NULL",
)
case("chart_trade_distribution", "exit_reason n# p0* p25* p50* p75* p100*", lambda s, d: charts.trade_distribution(fx.trades(s, d), "exit_reason"), "SELECT exit_reason, count(*) AS n, " + ", ".join(f'quantile_cont("return", {q / 100!r}) AS p{q}' for q in (0, 25, 50, 75, 100)) + f" FROM {T_} GROUP BY 1")
