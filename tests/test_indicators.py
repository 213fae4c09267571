import datetime
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import candles, catalog, recursive
from tidemark.functions import indicators as ind
from tidemark.plans import registry

START = datetime.date(2026, 1, 1)


def panel(spark, **columns):
    n = len(next(iter(columns.values())))
    rows = [("A", START + datetime.timedelta(i), *(float(v[i]) if v[i] is not None else None for v in columns.values())) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, ts date, " + ", ".join(f"{c} double" for c in columns))


def column(df, name):
    return [r[name] for r in df.orderBy("ts").collect()]


def close(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert (x is None) == (y is None or (isinstance(y, float) and math.isnan(y))), (a, b)
        if x is not None:
            assert math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12), (a, b)


CLOSE, VOLUME = [10, 11, 12, 10, 13, 15], [100, 120, 80, 140, 160, 180]


def test_returns_and_momentum(spark):
    df = panel(spark, close=CLOSE, volume=VOLUME)
    close(column(ind.returns(df), "ret"), [None, 0.1, 1 / 11, -1 / 6, 0.3, 2 / 13])
    close(column(ind.momentum(df, window=2), "momentum"), [None, None, 0.2, -1 / 11, 1 / 12, 0.5])
    close(column(ind.sma(df, "close", 3), "sma"), [None, None, 11, 11, 35 / 3, 38 / 3])
    close(column(ind.ema(df, "close", 3), "ema"), list(pd.Series(CLOSE, dtype=float).ewm(span=3, adjust=False).mean()))
    s = pd.Series(VOLUME, dtype=float)
    close(column(ind.volume_ratio(df, window=3), "volume_ratio"), list(s / s.rolling(3).median()))
    close(column(ind.volume_ratio(df, window=3, statistic="mean", min_periods=2), "volume_ratio"), list(s / s.rolling(3, min_periods=2).mean()))
    r = pd.Series(CLOSE, dtype=float).pct_change()
    for ddof in (0, 1, 2):
        close(column(ind.rolling_volatility(ind.returns(df), window=4, ddof=ddof), "volatility"), list(r.rolling(4).std(ddof=ddof)))


def test_madev_starts_after_two_windows(spark):
    df = panel(spark, close=[10, 11, 13, 12, 15, 14, 16, 18, 17, 20, 19, 21])
    s = pd.Series([10, 11, 13, 12, 15, 14, 16, 18, 17, 20, 19, 21], dtype=float)
    got = column(ind.madev(df, window=4), "madev")
    assert got[5] is None and got[6] is not None
    close(got, list((s - s.rolling(4).mean()).abs().rolling(4).mean()))


def test_realized_variance_of_a_session(spark):
    rows = [("A", "s", 3, 103.0), ("A", "s", 1, 101.0), ("A", "s", 0, 100.0), ("A", "s", 2, 102.0), ("A", "short", 0, 1.0)]
    got = ind.realized_volatility(spark.createDataFrame(rows, "symbol string, session string, time int, price double")).collect()
    r = np.diff(np.log([100, 101, 102, 103]))
    assert len(got) == 1 and math.isclose(got[0].realized_variance, (r**2).sum()) and got[0].prices == 4
    assert math.isclose(got[0].bipower_variation, math.pi / 2 * 3 / 2 * (abs(r[1:]) * abs(r[:-1])).sum())
    assert math.isclose(got[0].med_rv, ind.MED3 * 3 * np.median(abs(r)) ** 2)
    assert math.isclose(got[0].min_rv, ind.MIN2 * 3 / 2 * (np.minimum(abs(r[1:]), abs(r[:-1])) ** 2).sum())


def test_realized_volatility_of_odd_prices_equals_its_sql(spark, tmp_path):
    """Zero, negative and null prices, first, last and side by side."""
    duckdb = pytest.importorskip("duckdb")
    days = [[100, 0, 102, 103], [0, 101, 102, 103, 99], [5, 6, 7, 8, 9, 0], [3, 0, 0, 2, 4], [0, 0, 0, 0], [4, -1, 5, 6, 7], [4, None, 5, 6, 7], [None, 4, 5, 6], [1, 2, 4, 0, 4, 2, 1], [7, 7, 7, 7]]
    start = datetime.datetime(2024, 1, 1)
    rows = [(100 * u + i, start + datetime.timedelta(minutes=i), u, "view", None if v is None else float(v), "") for u, day in enumerate(days) for i, v in enumerate(day)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(registry.QUERIES["realized_volatility"](spark, str(tmp_path)).collect())
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = sorted(duck.sql(registry.ORACLES["realized_volatility"]).fetchall())
    assert len(want) == len(days) and any(math.isinf(w[3]) for w in want)
    assert [repr(tuple(g)) for g in got] == [repr(w) for w in want]


def test_phase_counts_rows_above(spark):
    df = panel(spark, relative_strength=[1, 3, 3, 0, 2, None], rsma=[2, 2, 2, 2, 1, 1])
    got = ind.rs_phase(df).orderBy("ts").collect()
    assert [r.above for r in got] == [False, True, True, False, True, False]
    assert [r.phase_days for r in got] == [0, 1, 2, 0, 1, 0]


def test_spikes(spark):
    c = [10, 11, 12, 13, 14, 15, 13, 12, 11, 13]
    df = panel(spark, high=[x + 1 for x in c], low=[x - 1 for x in c], close=c, volume=[100] * 6 + [300, 100, 100, 100])
    got = ind.price_spikes(df, atr_window=3, volume_window=3, atr_multiplier=0.8, volume_threshold=1.5).orderBy("ts").collect()
    assert [r.price_spike_event for r in got] == [0, 0, 0, 0, 0, 0, 1, 0, 0, 2]
    up = panel(spark, close=[10, 11, 12, 13, 14, 15, 16], volume=[100, 100, 100, 100, 100, 100, 250])
    got = ind.volume_spike_ratio(up, vol_window=3, price_window=2, consecutive_days=2).orderBy("ts").collect()
    assert got[-1].vsr_trending == 1 and got[-1].vsr_spike_type == 1 and got[0].vsr == 0


def test_rsi_of_a_rise_is_100(spark):
    df = panel(spark, close=range(1, 61), high=range(2, 62), low=range(0, 60), open=range(1, 61), volume=[100] * 60)
    assert column(recursive.add(df, "RSI"), "real")[-1] == pytest.approx(100)
    assert column(recursive.add(df, "ADX"), "real")[-1] == pytest.approx(100)
    assert column(recursive.add(df, "ATR"), "real")[-1] == pytest.approx(2)
    assert column(recursive.add(df, "SAR"), "real")[-1] < 60


def test_seeded_means():
    x = np.array([1.0, 2, 3, 4, 5, 9])
    assert np.allclose(recursive.ema(x, 3)[2:], [2, 3, 4, 6.5])
    assert np.allclose(recursive.rma(x, 3)[2:], [2, 8 / 3, 31 / 9, 143 / 27])
    assert np.isnan(recursive.ema(np.array([1.0]), 3)).all()
    assert np.allclose(recursive.fitted(np.arange(10.0), 4)[3:], np.arange(3, 10))


@pytest.mark.parametrize("name", sorted(recursive.CATALOG))
def test_states_cope_with_short_series(name):
    work, outputs = recursive.CATALOG[name]
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 300):
        c = 100 + np.cumsum(rng.normal(size=n))
        bars = {"open": c + rng.normal(size=n) / 9, "high": c + 1, "low": c - 1, "close": c, "volume": rng.integers(1, 99, n).astype(float)}
        with np.errstate(all="ignore"):
            got = work(bars)
        assert set(got) == set(outputs) and all(len(v) == n for v in got.values())
    assert any(np.isfinite(v).any() for v in got.values())


def test_catalog_by_hand(spark):
    rng = np.random.default_rng(1)
    c = pd.Series(100 + np.cumsum(rng.normal(size=60)))
    h, low, v = c + rng.random(60), c - rng.random(60), pd.Series(rng.integers(1, 99, 60).astype(float))
    df = panel(spark, open=list((h + low) / 2), high=list(h), low=list(low), close=list(c), volume=list(v))
    get = lambda layers, out="real": column(catalog.add(df, layers), out)
    close(get(catalog.TA["BBANDS"](5), "upperband"), list(c.rolling(5).mean() + 2 * c.rolling(5).std(ddof=0)))
    close(get(catalog.TA["STOCHF"](5, 3), "fastk"), list(100 * (c - low.rolling(5).min()) / (h.rolling(5).max() - low.rolling(5).min())))
    close(get(catalog.TA["WMA"](4)), list(c.rolling(4).apply(lambda x: x @ np.array([1, 2, 3, 4]) / 10, raw=True)))
    close(get(catalog.TA["LINEARREG_SLOPE"](7)), list(c.rolling(7).apply(lambda x: np.polyfit(range(7), x, 1)[0], raw=True)))
    close(get(catalog.PTA["skew"](12)), list(c.rolling(12).skew()))
    close(get(catalog.PTA["kurtosis"](12)), list(c.rolling(12).kurt()))
    close(get(catalog.PTA["hma"](9)), list((2 * c.rolling(4).apply(lambda x: x @ np.arange(1, 5) / 10, raw=True) - c.rolling(9).apply(lambda x: x @ np.arange(1, 10) / 45, raw=True)).rolling(3).apply(lambda x: x @ np.arange(1, 4) / 6, raw=True)))
    close(get(catalog.TA["AROON"](6), "aroonup"), list(h.rolling(7).apply(lambda x: 100 * (6 - (6 - (6 - np.argmax(x[::-1])))) / 6, raw=True)))
    assert [x for x in df.columns] == [x for x in catalog.add(df, catalog.TA["SMA"](3)).columns if x != "real"]


def test_other_columns_can_stand_for_bars(spark):
    df = panel(spark, price=[1, 2, 3, 4], close=[9, 9, 9, 9])
    got = catalog.add(df, catalog.TA["SMA"](2), columns={"close": "price"})
    close(column(got, "real"), [None, 1.5, 2.5, 3.5])
    assert column(got, "close") == [9.0] * 4


def test_candles(spark):
    o, c = [10.0] * 11 + [12.0, 9.5], [10.5] * 11 + [10.0, 12.6]
    df = panel(spark, open=o, close=c, high=[max(a, b) + 0.1 for a, b in zip(o, c)], low=[min(a, b) - 0.1 for a, b in zip(o, c)], volume=[1] * 13)
    assert column(catalog.add(df, candles.PATTERNS["CDLENGULFING"]()), "integer")[-1] == 100
    assert column(catalog.add(df, candles.PATTERNS["CDLMARUBOZU"]()), "integer")[-1] == 0
    assert len(candles.PATTERNS) == 61
    flat = df.withColumn("close", F.col("open") + 0.001)
    assert column(catalog.add(flat, candles.PATTERNS["CDLDOJI"]()), "integer")[-1] == 100
