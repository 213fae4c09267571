"""Indicators whose every value needs the one before: smoothed means, directional movement, stops that trail, cycles.

Each works on one symbol's rows in order, as arrays; add() runs it for every symbol of a panel, side by side."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .frames import BY, ORDER, with_states

Bars = dict[str, np.ndarray]
CATALOG: dict[str, tuple[Callable[..., dict[str, np.ndarray]], tuple[str, ...]]] = {}


def indicator(name: str, *outputs: str):
    def put(work):
        CATALOG[name] = work, outputs or ("real",)
        return work

    return put


def add(df: DataFrame, name: str, by=BY, order=ORDER, columns: dict[str, str] | None = None, **options) -> DataFrame:
    """`df` with the outputs of the indicator; columns: which columns stand for open, high, low, close and volume."""
    work, outputs = CATALOG[name]
    names = {c: (columns or {}).get(c, c) for c in ("open", "high", "low", "close", "volume")}

    def run(frame: pd.DataFrame) -> dict[str, np.ndarray]:
        bars = {c: frame[n].to_numpy(float) for c, n in names.items() if n in frame}
        return {k: np.where(np.isfinite(v), v, np.nan) for k, v in work(bars, **options).items()}

    return with_states(df, run, dict.fromkeys(outputs, "double"), by, order)


def ema(x: np.ndarray, n: int, alpha: float | None = None) -> np.ndarray:
    """Exponential mean that starts as the mean of the first n values that are there."""
    a = alpha if alpha is not None else 2 / (n + 1)
    out = np.full(len(x), np.nan)
    there = np.flatnonzero(np.isfinite(x))
    if len(there) < n:
        return out
    start = there[0] + n - 1
    seeded = np.concatenate(([x[there[0] : start + 1].mean()], x[start + 1 :]))
    out[start:] = pd.Series(seeded).ewm(alpha=a, adjust=False).mean().to_numpy()
    return out


def rma(x: np.ndarray, n: int) -> np.ndarray:
    """Wilder's mean."""
    return ema(x, n, 1 / n)


def sma(x: np.ndarray, n: int) -> np.ndarray:
    return pd.Series(x).rolling(n).mean().to_numpy()


def high_of(x: np.ndarray, n: int) -> np.ndarray:
    return pd.Series(x).rolling(n).max().to_numpy()


def low_of(x: np.ndarray, n: int) -> np.ndarray:
    return pd.Series(x).rolling(n).min().to_numpy()


def lag(x: np.ndarray, k: int = 1) -> np.ndarray:
    return np.concatenate((np.full(min(k, len(x)), np.nan), x[: max(0, len(x) - k)]))


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(b != 0, a / b, np.nan)


def true_range(b: Bars) -> np.ndarray:
    before = lag(b["close"])
    return np.maximum(b["high"] - b["low"], np.maximum(abs(b["high"] - before), abs(b["low"] - before)))


def moves(b: Bars) -> tuple[np.ndarray, np.ndarray]:
    """Directional movement, up and down."""
    up, down = b["high"] - lag(b["high"]), lag(b["low"]) - b["low"]
    plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
    for x in (plus, minus):
        x[:1] = np.nan
    return plus, minus


# means
for _name, _n in (("EMA", 30), ("pta_ema", 10)):
    indicator(_name)(lambda b, n=_n: {"real": ema(b["close"], n)})
indicator("pta_rma")(lambda b, n=10: {"real": rma(b["close"], n)})


def mean_of(kind: str, x: np.ndarray, n: int) -> np.ndarray:
    """A moving mean by name."""
    weights = np.arange(1, n + 1, dtype=float)
    return {
        "ema": lambda: ema(x, n), "rma": lambda: rma(x, n), "sma": lambda: sma(x, n), "dema": lambda: (lambda e: 2 * e[0] - e[1])(_many(x, n, 2)), "tema": lambda: (lambda e: 3 * e[0] - 3 * e[1] + e[2])(_many(x, n, 3)),
        "kama": lambda: kama(x, n), "t3": lambda: t3(x, n, 0.7), "wma": lambda: pd.Series(x).rolling(n).apply(lambda v: v @ weights / weights.sum(), raw=True).to_numpy(),
    }[kind]()


indicator("pta_ma")(lambda b, kind="ema", n=10: {"real": mean_of(kind, b["close"], n)})


def _many(x: np.ndarray, n: int, times: int) -> list[np.ndarray]:
    out = []
    for _ in range(times):
        x = ema(x, n)
        out.append(x)
    return out


for _name, _n in (("DEMA", 30), ("pta_dema", 10)):
    indicator(_name)(lambda b, n=_n: {"real": (lambda e: 2 * e[0] - e[1])(_many(b["close"], n, 2))})
for _name, _n in (("TEMA", 30), ("pta_tema", 10)):
    indicator(_name)(lambda b, n=_n: {"real": (lambda e: 3 * e[0] - 3 * e[1] + e[2])(_many(b["close"], n, 3))})


def t3(x: np.ndarray, n: int, v: float) -> np.ndarray:
    e = _many(x, n, 6)
    return -(v**3) * e[5] + (3 * v**2 + 3 * v**3) * e[4] + (-6 * v**2 - 3 * v - 3 * v**3) * e[3] + (1 + 3 * v + v**3 + 3 * v**2) * e[2]


for _name, _n in (("T3", 5), ("pta_t3", 10)):
    indicator(_name)(lambda b, n=_n, v=0.7: {"real": t3(b["close"], n, v)})


def trix(x: np.ndarray, n: int) -> np.ndarray:
    e = _many(x, n, 3)[2]
    return 100 * (ratio(e, lag(e)) - 1)


indicator("TRIX")(lambda b, n=30: {"real": trix(b["close"], n)})
indicator("pta_trix", "trix", "trixs")(lambda b, n=18, s=9: {"trix": (t := trix(b["close"], n)), "trixs": sma(t, s)})
indicator("pta_trixh", "trix", "trixs", "trixh")(lambda b, n=18, s=9: {"trix": (t := trix(b["close"], n)), "trixs": (m := sma(t, s)), "trixh": t - m})


def kama(x: np.ndarray, n: int, fast: int = 2, slow: int = 30) -> np.ndarray:
    way = pd.Series(abs(x - lag(x))).rolling(n).sum().to_numpy()
    c = (np.nan_to_num(ratio(abs(x - lag(x, n)), way)) * (2 / (fast + 1) - 2 / (slow + 1)) + 2 / (slow + 1)) ** 2
    out = np.full(len(x), np.nan)
    if len(x) > n:
        out[n - 1] = x[n - 1]
        for i in range(n, len(x)):
            out[i] = out[i - 1] + c[i] * (x[i] - out[i - 1])
        out[n - 1] = np.nan
    return out


for _name, _n in (("KAMA", 30), ("pta_kama", 10)):
    indicator(_name)(lambda b, n=_n: {"real": kama(b["close"], n)})


def macd(x: np.ndarray, fast: int, slow: int, signal: int) -> tuple[np.ndarray, np.ndarray]:
    m = ema(x, fast) - ema(x, slow)
    return m, ema(m, signal)


for _name in ("MACD", "MACDFIX", "pta_macd", "pta_macdfix", "pta_macdext"):

    @indicator(_name, "macd", "macdsignal", "macdhist")
    def _macd(b: Bars, fast: int = 12, slow: int = 26, signal: int = 9) -> dict:
        m, s = macd(b["close"], fast, slow, signal)
        return {"macd": m, "macdsignal": s, "macdhist": m - s}


for _name, _of in (("pta_ppo", "close"), ("pta_pvo", "volume")):

    @indicator(_name, "ppo", "ppos", "ppoh")
    def _ppo(b: Bars, of: str = _of, fast: int = 12, slow: int = 26, signal: int = 9) -> dict:
        p = 100 * (ratio(ema(b[of], fast), ema(b[of], slow)) - 1)
        s = ema(p, signal)
        return {"ppo": p, "ppos": s, "ppoh": p - s}


indicator("ADOSC")(lambda b, fast=3, slow=10: {"real": (lambda a: pd.Series(a).ewm(span=fast, adjust=False).mean().to_numpy() - pd.Series(a).ewm(span=slow, adjust=False).mean().to_numpy())(accumulated(b))})
indicator("pta_adosc")(lambda b, fast=3, slow=10: CATALOG["ADOSC"][0](b, fast, slow))


def accumulated(b: Bars) -> np.ndarray:
    share = np.nan_to_num(ratio((b["close"] - b["low"]) - (b["high"] - b["close"]), b["high"] - b["low"]))
    return np.cumsum(share * b["volume"])


def on_balance(b: Bars) -> np.ndarray:
    return np.cumsum(np.where(np.isnan(lag(b["close"])), 1.0, np.sign(b["close"] - lag(b["close"]))) * b["volume"])


indicator("pta_aobv", "obv", "obv_fast", "obv_slow")(lambda b, fast=4, slow=12: {"obv": (v := on_balance(b)), "obv_fast": ema(v, fast), "obv_slow": ema(v, slow)})


# oscillators
def rsi(x: np.ndarray, n: int) -> np.ndarray:
    d = x - lag(x)
    up, down = rma(np.where(np.isnan(d), np.nan, np.maximum(d, 0)), n), rma(np.where(np.isnan(d), np.nan, np.maximum(-d, 0)), n)
    return 100 * np.where(up + down == 0, 0.0, ratio(up, up + down))


for _name in ("RSI", "pta_rsi"):
    indicator(_name)(lambda b, n=14: {"real": rsi(b["close"], n)})
for _name in ("CMO", "pta_cmo"):
    indicator(_name)(lambda b, n=14: {"real": 2 * rsi(b["close"], n) - 100})
indicator("STOCHRSI", "fastk", "fastd")(lambda b, n=14, k=5, d=3: {"fastk": (f := 100 * ratio((r := rsi(b["close"], n)) - low_of(r, k), high_of(r, k) - low_of(r, k))), "fastd": sma(f, d)})
indicator("pta_stochrsi", "stochrsik", "stochrsid")(lambda b, n=14, m=14, k=3, d=3: {"stochrsik": (f := sma(100 * ratio((r := rsi(b["close"], m)) - low_of(r, n), high_of(r, n) - low_of(r, n)), k)), "stochrsid": sma(f, d)})


@indicator("pta_tsi", "tsi", "tsis")
def tsi(b: Bars, fast: int = 13, slow: int = 25, signal: int = 13) -> dict:
    d = b["close"] - lag(b["close"])
    t = 100 * ratio(ema(ema(d, slow), fast), ema(ema(abs(d), slow), fast))
    return {"tsi": t, "tsis": ema(t, signal)}


@indicator("pta_smi", "smi", "smis", "smio")
def smi(b: Bars, fast: int = 5, slow: int = 20, signal: int = 5) -> dict:
    t = tsi(b, fast, slow, signal)
    return {"smi": t["tsi"], "smis": t["tsis"], "smio": t["tsi"] - t["tsis"]}


@indicator("pta_lrsi")
def laguerre_rsi(b: Bars, gamma: float = 0.5) -> dict:
    l0 = l1 = l2 = l3 = 0.0
    out = np.zeros(len(b["close"]))
    for i, x in enumerate(b["close"]):
        p0, p1, p2 = l0, l1, l2
        l0 = (1 - gamma) * x + gamma * l0
        l1 = -gamma * l0 + p0 + gamma * l1
        l2 = -gamma * l1 + p1 + gamma * l2
        l3 = -gamma * l2 + p2 + gamma * l3
        up = max(l0 - l1, 0) + max(l1 - l2, 0) + max(l2 - l3, 0)
        down = max(l1 - l0, 0) + max(l2 - l1, 0) + max(l3 - l2, 0)
        out[i] = 100 * up / (up + down) if up + down else 0.0
    return {"real": out}


@indicator("pta_fisher", "fisher", "fishers")
def fisher(b: Bars, n: int = 9, signal: int = 1) -> dict:
    m = (b["high"] + b["low"]) / 2
    p = np.nan_to_num(ratio(m - low_of(m, n), np.maximum(high_of(m, n) - low_of(m, n), 0.001))) - 0.5
    out, v = np.full(len(m), np.nan), 0.0
    for i in range(n - 1, len(m)):
        v = min(max(0.66 * p[i] + 0.67 * v, -0.999), 0.999)
        out[i] = 0.5 * math.log((1 + v) / (1 - v)) + 0.5 * (out[i - 1] if i > n - 1 else 0.0)
    return {"fisher": out, "fishers": lag(out, signal)}


@indicator("pta_kdj", "k", "d", "j")
def kdj(b: Bars, n: int = 9, signal: int = 3) -> dict:
    f = 100 * ratio(b["close"] - low_of(b["low"], n), high_of(b["high"], n) - low_of(b["low"], n))
    k = rma(f, signal)
    d = rma(k, signal)
    return {"k": k, "d": d, "j": 3 * k - 2 * d}


@indicator("pta_stc", "stc", "macd")
def schaff(b: Bars, n: int = 10, fast: int = 12, slow: int = 26, factor: float = 0.5) -> dict:
    m = ema(b["close"], fast) - ema(b["close"], slow)

    def step(x: np.ndarray) -> np.ndarray:
        f = 100 * ratio(x - low_of(x, n), high_of(x, n) - low_of(x, n))
        out, v = np.full(len(x), np.nan), math.nan
        for i, y in enumerate(f):
            if not math.isnan(y):
                v = y if math.isnan(v) else v + factor * (y - v)
                out[i] = v
        return out

    return {"stc": step(step(m)), "macd": m}


# ranges and directions
for _name in ("ATR", "pta_atr"):
    indicator(_name)(lambda b, n=14: {"real": rma(true_range(b), n)})
for _name in ("NATR", "pta_natr"):
    indicator(_name)(lambda b, n=14: {"real": 100 * ratio(rma(true_range(b), n), b["close"])})


def summed(x: np.ndarray, n: int) -> np.ndarray:
    """Wilder's running sum: the first n - 1 values, then each less an n-th of the sum."""
    out, there = np.full(len(x), np.nan), np.flatnonzero(np.isfinite(x))
    if len(there) < n - 1:
        return out
    i = there[0] + n - 2
    total = x[there[0] : i + 1].sum()
    for j in range(i + 1, len(x)):
        total += x[j] - total / n
        out[j] = total
    return out


def directions(b: Bars, n: int) -> tuple[np.ndarray, np.ndarray]:
    plus, minus = moves(b)
    tr = summed(true_range(b), n)
    return 100 * ratio(summed(plus, n), tr), 100 * ratio(summed(minus, n), tr)


def dx(b: Bars, n: int) -> np.ndarray:
    p, m = directions(b, n)
    return 100 * ratio(abs(p - m), p + m)


for _pre in ("", "pta_"):
    _lower = str.lower if _pre else str
    indicator(_pre + _lower("PLUS_DM"))(lambda b, n=14: {"real": summed(moves(b)[0], n)})
    indicator(_pre + _lower("MINUS_DM"))(lambda b, n=14: {"real": summed(moves(b)[1], n)})
    indicator(_pre + _lower("DX"))(lambda b, n=14: {"real": dx(b, n)})
    indicator(_pre + _lower("ADXR"))(lambda b, n=14: {"real": (lambda a: (a + lag(a, n - 1)) / 2)(rma(dx(b, n), n))})
indicator("PLUS_DI")(lambda b, n=14: {"real": directions(b, n)[0]})
indicator("MINUS_DI")(lambda b, n=14: {"real": directions(b, n)[1]})
indicator("ADX")(lambda b, n=14: {"real": rma(dx(b, n), n)})
indicator("pta_adx", "adx", "dmp", "dmn")(lambda b, n=14: {"adx": rma(dx(b, n), n), "dmp": directions(b, n)[0], "dmn": directions(b, n)[1]})
indicator("pta_dm", "dmp", "dmn")(lambda b, n=14: {"dmp": rma(moves(b)[0], n), "dmn": rma(moves(b)[1], n)})
indicator("pta_aberration", "zg", "sg", "xg", "atr")(lambda b, n=5, m=15: {"zg": (z := sma((b["high"] + b["low"] + b["close"]) / 3, n)), "sg": z + (a := rma(true_range(b), m)), "xg": z - a, "atr": a})
indicator("pta_kc", "kcl", "kcb", "kcu")(lambda b, n=20, k=2.0: {"kcl": (m := ema(b["close"], n)) - k * (r := ema(true_range(b), n)), "kcb": m, "kcu": m + k * r})
indicator("pta_ce", "long_stop", "short_stop")(lambda b, n=22, k=3.0: {"long_stop": high_of(b["high"], n) - k * (a := rma(true_range(b), n)), "short_stop": low_of(b["low"], n) + k * a})
indicator("pta_cksp", "long_stop", "short_stop")(lambda b, p=10, x=1.0, q=9: {"long_stop": high_of(high_of(b["high"], p) - x * (a := rma(true_range(b), p)), q), "short_stop": low_of(low_of(b["low"], p) + x * a, q)})
indicator("pta_pgo")(lambda b, n=14: {"real": ratio(b["close"] - sma(b["close"], n), ema(true_range(b), n))})
indicator("pta_cvi")(lambda b, n=10: {"real": 100 * (ratio((e := ema(b["high"] - b["low"], n)), lag(e, n)) - 1)})
indicator("pta_massi")(lambda b, fast=9, slow=25: {"real": pd.Series(ratio((e := ema(b["high"] - b["low"], fast)), ema(e, fast))).rolling(slow).sum().to_numpy()})
indicator("pta_efi")(lambda b, n=13: {"real": ema((b["close"] - lag(b["close"])) * b["volume"], n)})
indicator("pta_eri", "bull", "bear")(lambda b, n=13: {"bull": b["high"] - (e := ema(b["close"], n)), "bear": b["low"] - e})
indicator("pta_dsp")(lambda b, n=14: {"real": ema((m := (b["high"] + b["low"]) / 2), max(1, n // 4)) - ema(m, max(2, n // 2))})
indicator("pta_thermo", "thermo", "mean")(lambda b, n=20: {"thermo": (t := np.maximum(abs(b["high"] - lag(b["high"])), abs(lag(b["low"]) - b["low"]))), "mean": ema(t, n)})
indicator("pta_zlma")(lambda b, n=10: {"real": ema(2 * b["close"] - lag(b["close"], (n - 1) // 2), n)})
indicator("pta_edecay")(lambda b, n=5: {"real": _decayed(b["close"], math.exp(-1 / n))})
indicator("pta_mmar", *(f"mmar_{k}" for k in range(10, 40, 5)))(lambda b: {f"mmar_{k}": ema(b["close"], k) for k in range(10, 40, 5)})
indicator("pta_amat", "long_run", "short_run")(lambda b, fast=8, slow=21, n=2: {"long_run": (((f := ema(b["close"], fast)) > lag(f, n)) & ((s := ema(b["close"], slow)) > lag(s, n)) | (f > lag(f, n)) & (s < lag(s, n))).astype(float), "short_run": ((f < lag(f, n)) & (s < lag(s, n)) | (f < lag(f, n)) & (s > lag(s, n))).astype(float)})


def _decayed(x: np.ndarray, rate: float) -> np.ndarray:
    out, v = np.empty(len(x)), 0.0
    for i, y in enumerate(x):
        v = max(y, v * rate, 0.0)
        out[i] = v
    return out


@indicator("pta_kvo", "kvo", "kvos")
def klinger(b: Bars, fast: int = 34, slow: int = 55, signal: int = 13) -> dict:
    t = (b["high"] + b["low"] + b["close"]) / 3
    v = np.where(np.isnan(lag(t)), np.nan, np.sign(t - lag(t))) * b["volume"]
    k = ema(v, fast) - ema(v, slow)
    return {"kvo": k, "kvos": ema(k, signal)}


@indicator("pta_vfi")
def volume_flow(b: Bars, n: int = 130, coef: float = 0.2, vcoef: float = 2.5) -> dict:
    t = (b["high"] + b["low"] + b["close"]) / 3
    d = np.log(t) - np.log(lag(t))
    cut = coef * pd.Series(d).rolling(30).std().to_numpy() * b["close"]
    mean = lag(sma(b["volume"], n))
    v = np.minimum(b["volume"], mean * vcoef)
    move = t - lag(t)
    flow = np.where(move > cut, v, np.where(move < -cut, -v, 0.0))
    return {"real": ema(ratio(pd.Series(flow).rolling(n).sum().to_numpy(), mean), 3)}


# stops that trail
def parabolic(b: Bars, start: float = 0.02, step: float = 0.02, most: float = 0.2) -> np.ndarray:
    h, low, n = b["high"], b["low"], len(b["high"])
    out = np.full(n, np.nan)
    if n < 2:
        return out
    up = not (low[0] - low[1] > 0 and low[0] - low[1] > h[1] - h[0])
    stop, best, a = (low[0], h[1], start) if up else (h[0], low[1], start)
    for i in range(1, n):
        if up and low[i] < stop or not up and h[i] > stop:
            up = not up
            out[i] = best = max(best, h[i], h[i - 1]) if not up else min(best, low[i], low[i - 1])
            stop, best, a = best, low[i] if not up else h[i], start
            out[i] = stop
        else:
            out[i] = stop
            if up and h[i] > best or not up and low[i] < best:
                best, a = h[i] if up else low[i], min(a + step, most)
        stop = stop + a * (best - stop)
        stop = min(stop, low[i], low[i - 1]) if up else max(stop, h[i], h[i - 1])
    return out


for _name in ("SAR", "SAREXT", "pta_psar", "pta_sarext"):
    indicator(_name)(lambda b, start=0.02, most=0.2: {"real": parabolic(b, start, start, most)})


def _trailing(close: np.ndarray, mid: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(stop, direction): bands about mid that only move with the trend, which turns where the close passes one."""
    up, low = mid + band, mid - band
    stop, way = np.full(len(close), np.nan), np.full(len(close), np.nan)
    d = 1
    for i in range(len(close)):
        if not np.isfinite(up[i]):
            continue
        if i and np.isfinite(up[i - 1]):
            if close[i] > up[i - 1]:
                d = 1
            elif close[i] < low[i - 1]:
                d = -1
            elif d > 0:
                low[i] = max(low[i], low[i - 1])
            else:
                up[i] = min(up[i], up[i - 1])
        stop[i], way[i] = low[i] if d > 0 else up[i], d
    return stop, way


indicator("pta_supertrend", "trend", "direction")(lambda b, n=7, k=3.0: dict(zip(("trend", "direction"), _trailing(b["close"], (b["high"] + b["low"]) / 2, k * rma(true_range(b), n)))))
indicator("pta_pmax", "trend", "direction")(lambda b, n=10, k=3.0: dict(zip(("trend", "direction"), _trailing(b["close"], ema((b["high"] + b["low"]) / 2, n), k * rma(true_range(b), n)))))


@indicator("pta_hilo", "hilo")
def hilo(b: Bars, up: int = 13, down: int = 21) -> dict:
    h, low, c = sma(b["high"], up), sma(b["low"], down), b["close"]
    out = np.full(len(c), np.nan)
    for i in range(1, len(c)):
        out[i] = low[i] if c[i] > h[i - 1] else h[i] if c[i] < low[i - 1] else out[i - 1]
    return {"hilo": out}


@indicator("pta_ha", "ha_open", "ha_high", "ha_low", "ha_close")
def heikin_ashi(b: Bars) -> dict:
    close = (b["open"] + b["high"] + b["low"] + b["close"]) / 4
    start = np.empty(len(close))
    for i in range(len(close)):
        start[i] = (start[i - 1] + close[i - 1]) / 2 if i else (b["open"][0] + b["close"][0]) / 2
    return {"ha_open": start, "ha_high": np.maximum(b["high"], np.maximum(start, close)), "ha_low": np.minimum(b["low"], np.minimum(start, close)), "ha_close": close}


@indicator("pta_qqe", "qqe", "rsi_mean", "qqe_long", "qqe_short")
def qqe(b: Bars, n: int = 14, smooth: int = 5, factor: float = 4.236) -> dict:
    m = ema(rsi(b["close"], n), smooth)
    band = factor * ema(ema(abs(m - lag(m)), 2 * n - 1), 2 * n - 1)
    stop, way = _trailing(m, m, band)
    return {"qqe": stop, "rsi_mean": m, "qqe_long": np.where(way > 0, stop, np.nan), "qqe_short": np.where(way < 0, stop, np.nan)}


# means that adapt
@indicator("pta_vidya")
def vidya(b: Bars, n: int = 10) -> dict:
    x = b["close"]
    d = x - lag(x)
    total = pd.Series(abs(d)).rolling(n).sum().to_numpy()
    c = abs(ratio(pd.Series(d).rolling(n).sum().to_numpy(), total)) * 2 / (n + 1)
    out = np.full(len(x), np.nan)
    for i in range(n, len(x)):
        before = out[i - 1] if i > n else x[i - 1]
        out[i] = before + np.nan_to_num(c[i]) * (x[i] - before)
    return {"real": out}


@indicator("pta_mcgd")
def mcginley(b: Bars, n: int = 10, c: float = 1.0) -> dict:
    out = b["close"].copy()
    for i in range(1, len(out)):
        out[i] = out[i - 1] + (b["close"][i] - out[i - 1]) / (c * n * (b["close"][i] / out[i - 1]) ** 4)
    return {"real": out}


@indicator("pta_jma")
def jurik(b: Bars, n: int = 7, phase: float = 0.0) -> dict:
    x = b["close"]
    length, pr = 0.5 * (n - 1), 0.5 if phase < -100 else 2.5 if phase > 100 else 1.5 + phase * 0.01
    l1 = max(math.log(math.sqrt(length)) / math.log(2) + 2, 0)
    pow1 = max(l1 - 2, 0.5)
    l2 = math.sqrt(length) * l1
    bet, beta = l2 / (l2 + 1), 0.45 * (n - 1) / (0.45 * (n - 1) + 2)
    out, volty, vsum = np.full(len(x), np.nan), np.zeros(len(x)), np.zeros(len(x))
    up = down = ma1 = d0 = d1 = 0.0
    if len(x):
        up = down = ma1 = x[0]
        jma = x[0]
    for i in range(1, len(x)):
        a, c = x[i] - up, x[i] - down
        volty[i] = max(abs(a), abs(c)) if abs(a) != abs(c) else 0.0
        vsum[i] = vsum[i - 1] + 0.1 * (volty[i] - volty[max(i - 10, 0)])
        mean = vsum[max(i - 65, 0) : i + 1].mean()
        r = volty[i] / mean if mean else 0.0
        r = max(1.0, min(l1 ** (1 / pow1), r))
        kv = bet ** math.sqrt(r**pow1)
        up, down = (x[i] if a > 0 else x[i] - kv * a), (x[i] if c < 0 else x[i] - kv * c)
        alpha = beta ** (r**pow1)
        ma1 = (1 - alpha) * x[i] + alpha * ma1
        d0 = (x[i] - ma1) * (1 - beta) + beta * d0
        d1 = (ma1 + pr * d0 - jma) * (1 - alpha) ** 2 + alpha**2 * d1
        jma += d1
        if i >= n - 1:
            out[i] = jma
    return {"real": out}


@indicator("pta_hwma")
def holt_winter(b: Bars, na: float = 0.2, nb: float = 0.1, nc: float = 0.1) -> dict:
    x, out = b["close"], np.empty(len(b["close"]))
    f, v, a = (x[0] if len(x) else 0.0), 0.0, 0.0
    for i, y in enumerate(x):
        nf = (1 - na) * (f + v + 0.5 * a) + na * y
        nv = (1 - nb) * (v + a) + nb * (nf - f)
        a = (1 - nc) * a + nc * (nv - v)
        f, v = nf, nv
        out[i] = f + v + 0.5 * a
    return {"real": out}


@indicator("pta_hwc", "hwm", "hwu", "hwl")
def holt_winter_channel(b: Bars, nd: float = 0.1, k: float = 1.0) -> dict:
    m = holt_winter(b)["real"]
    out, var = np.zeros(len(m)), 0.0
    for i in range(1, len(m)):
        var = (1 - nd) * var + nd * (b["close"][i - 1] - m[i - 1]) ** 2
        out[i] = math.sqrt(var)
    return {"hwm": m, "hwu": m + k * out, "hwl": m - k * out}


@indicator("pta_ssf")
def super_smoother(b: Bars, n: int = 10) -> dict:
    x, out = b["close"], b["close"].copy()
    a = math.exp(-math.pi * math.sqrt(2) / n)
    c2, c3 = 2 * a * math.cos(math.pi * math.sqrt(2) / n), -a * a
    for i in range(2, len(x)):
        out[i] = (1 - c2 - c3) * x[i] + c2 * out[i - 1] + c3 * out[i - 2]
    return {"real": out}


@indicator("pta_ebsw")
def even_better_sine(b: Bars, n: int = 40, bars: int = 10) -> dict:
    x, out = b["close"], np.full(len(b["close"]), np.nan)
    a1 = (1 - math.sin(2 * math.pi / n)) / math.cos(2 * math.pi / n)
    e = math.exp(-math.sqrt(2) * math.pi / bars)
    c2, c3 = 2 * e * math.cos(math.sqrt(2) * math.pi / bars), -e * e
    hp, f = 0.0, [0.0, 0.0]
    held: list[float] = []
    for i in range(1, len(x)):
        new = 0.5 * (1 + a1) * (x[i] - x[i - 1]) + a1 * hp
        f.append((1 - c2 - c3) * (new + hp) / 2 + c2 * f[-1] + c3 * f[-2])
        hp = new
        if i >= n:
            held = f[-3:]
            power = sum(v * v for v in held) / 3
            out[i] = sum(held) / 3 / math.sqrt(power) if power else 0.0
    return {"real": out}


@indicator("pta_rsx")
def rsx(b: Bars, n: int = 14) -> dict:
    x = b["close"]
    f = 3.0 / (n + 2)

    def smooth(y: np.ndarray) -> np.ndarray:
        for _ in range(3):
            one = pd.Series(y).ewm(alpha=f, adjust=False).mean().to_numpy()
            two = pd.Series(one).ewm(alpha=f, adjust=False).mean().to_numpy()
            y = 1.5 * one - 0.5 * two
        return y

    d = np.concatenate(([0.0], np.diff(x))) if len(x) else x
    v = np.clip(50 * (np.nan_to_num(ratio(smooth(d), smooth(abs(d)))) + 1), 0, 100)
    v[: n - 1] = np.nan
    return {"real": v}


@indicator("pta_rvi")
def relative_volatility(b: Bars, n: int = 14) -> dict:
    sd, d = pd.Series(b["close"]).rolling(n).std().to_numpy(), b["close"] - lag(b["close"])
    up, down = ema(np.where(np.isnan(sd), np.nan, np.where(d > 0, sd, 0.0)), n), ema(np.where(np.isnan(sd), np.nan, np.where(d < 0, sd, 0.0)), n)
    return {"real": 100 * ratio(up, up + down)}


@indicator("pta_inertia")
def inertia(b: Bars, n: int = 20, m: int = 14) -> dict:
    return {"real": fitted(relative_volatility(b, m)["real"], n)}


def fitted(y: np.ndarray, n: int) -> np.ndarray:
    """The end of the least squares line through the last n values."""
    k = np.arange(n) - (n - 1) / 2
    w = 1 / n + k * k[-1] / (k @ k)
    out = np.full(len(y), np.nan)
    if len(y) >= n:
        out[n - 1 :] = np.lib.stride_tricks.sliding_window_view(y, n) @ w
    return out


@indicator("pta_squeeze", "sqz", "squeeze_on", "squeeze_off")
def squeeze(b: Bars, n: int = 20, k: float = 2.0, kc: float = 1.5, mom: int = 12) -> dict:
    m, sd = sma(b["close"], n), pd.Series(b["close"]).rolling(n).std(ddof=0).to_numpy()
    r = sma(true_range(b), n)
    inside = (m - k * sd > m - kc * r) & (m + k * sd < m + kc * r)
    outside = (m - k * sd < m - kc * r) & (m + k * sd > m + kc * r)
    return {"sqz": sma(b["close"] - lag(b["close"], mom), 6), "squeeze_on": inside.astype(float), "squeeze_off": outside.astype(float)}


@indicator("pta_squeeze_pro", "sqz", "wide", "normal", "narrow")
def squeeze_pro(b: Bars, n: int = 20, k: float = 2.0) -> dict:
    s = {w: squeeze(b, n, k, w) for w in (2.0, 1.5, 1.0)}
    return {"sqz": s[1.5]["sqz"], "wide": s[2.0]["squeeze_on"], "normal": s[1.5]["squeeze_on"], "narrow": s[1.0]["squeeze_on"]}


@indicator("pta_vp", "price_low", "price_high", "volume_in")
def volume_profile(b: Bars, width: int = 10) -> dict:
    """The price range of the row's bin among `width` of equal rows in price order, and the bin's volume."""
    order = np.argsort(b["close"], kind="stable")
    low, high, vol = (np.full(len(order), np.nan) for _ in range(3))
    for part in np.array_split(order, width):
        if len(part):
            low[part], high[part], vol[part] = b["close"][part].min(), b["close"][part].max(), b["volume"][part].sum()
    return {"price_low": low, "price_high": high, "volume_in": vol}


# cycles, after the Hilbert transform
def _weighted4(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for i in range(3, len(x)):
        out[i] = (4 * x[i] + 3 * x[i - 1] + 2 * x[i - 2] + x[i - 3]) / 10
    return out


class Cycle:
    """In-phase and quadrature parts of a detrended, smoothed price, and the period of its dominant cycle."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        self.smooth = _weighted4(x)
        self.i1, self.q1, self.period, self.smooth_period = (np.zeros(n) for _ in range(4))
        detrend, ji, jq, i2, q2, re, im = (np.zeros(n) for _ in range(7))

        def hilbert(y: np.ndarray, k: int, adjust: float) -> float:
            return (0.0962 * y[k] + 0.5769 * y[k - 2] - 0.5769 * y[k - 4] - 0.0962 * y[k - 6]) * adjust

        for k in range(12, n):
            adjust = 0.075 * self.period[k - 1] + 0.54
            detrend[k] = hilbert(self.smooth, k, adjust)
            self.q1[k], self.i1[k] = hilbert(detrend, k, adjust), detrend[k - 3]
            ji[k], jq[k] = hilbert(self.i1, k, adjust), hilbert(self.q1, k, adjust)
            i2[k] = 0.2 * (self.i1[k] - jq[k]) + 0.8 * i2[k - 1]
            q2[k] = 0.2 * (self.q1[k] + ji[k]) + 0.8 * q2[k - 1]
            re[k] = 0.2 * (i2[k] * i2[k - 1] + q2[k] * q2[k - 1]) + 0.8 * re[k - 1]
            im[k] = 0.2 * (i2[k] * q2[k - 1] - q2[k] * i2[k - 1]) + 0.8 * im[k - 1]
            before = self.period[k - 1]
            p = 2 * math.pi / math.atan(im[k] / re[k]) if im[k] and re[k] else before
            p = min(max(p, 0.67 * before), 1.5 * before) if before else p
            self.period[k] = 0.2 * min(max(p, 6), 50) + 0.8 * before
            self.smooth_period[k] = 0.33 * self.period[k] + 0.67 * self.smooth_period[k - 1]

    def phase(self) -> np.ndarray:
        out = np.full(len(self.smooth), np.nan)
        for k in range(63, len(out)):
            n = max(1, int(self.smooth_period[k] + 0.5))
            j = np.arange(n)
            y = self.smooth[k - n + 1 : k + 1][::-1]
            a, c = (np.sin(2 * math.pi * j / n) * y).sum(), (np.cos(2 * math.pi * j / n) * y).sum()
            p = math.degrees(math.atan(a / c)) if abs(c) > 0.01 else 90.0 * np.sign(a)
            p += 90 + (360 / self.smooth_period[k] if self.smooth_period[k] else 0) + (180 if c < 0 else 0)
            out[k] = p - 360 if p > 315 else p
        return out

    def trendline(self, x: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0.0], np.cumsum(x)))
        mean = np.zeros(len(x))
        for k in range(len(x)):
            n = min(k + 1, max(1, int(self.smooth_period[k] + 0.5)))
            mean[k] = (sums[k + 1] - sums[k + 1 - n]) / n
        out = _weighted4(mean)
        out[:63] = np.nan
        return out


def _late(x: np.ndarray, n: int) -> np.ndarray:
    x = x.astype(float).copy()
    x[:n] = np.nan
    return x


def _sine(b: Bars) -> dict:
    p = np.radians(Cycle(b["close"]).phase())
    return {"sine": np.sin(p), "leadsine": np.sin(p + math.pi / 4)}


def _mode(b: Bars) -> dict:
    c = Cycle(b["close"])
    p, line = c.phase(), c.trendline(b["close"])
    s = _sine(b)
    out, days = np.full(len(p), np.nan), 0
    for k in range(64, len(p)):
        trend = 1
        if (s["sine"][k] - s["leadsine"][k]) * (s["sine"][k - 1] - s["leadsine"][k - 1]) < 0:
            days, trend = 0, 0
        days += 1
        if days < 0.5 * c.smooth_period[k]:
            trend = 0
        turn, usual = p[k] - p[k - 1], 360 / c.smooth_period[k] if c.smooth_period[k] else 0
        if usual and 0.67 * usual < turn < 1.5 * usual:
            trend = 0
        if line[k] and abs((c.smooth[k] - line[k]) / line[k]) >= 0.015:
            trend = 1
        out[k] = trend
    return {"integer": out}


for _pre in ("", "pta_"):
    _case = str.lower if _pre else str
    indicator(_pre + _case("HT_DCPERIOD"))(lambda b: {"real": _late(Cycle(b["close"]).smooth_period, 32)})
    indicator(_pre + _case("HT_DCPHASE"))(lambda b: {"real": Cycle(b["close"]).phase()})
    indicator(_pre + _case("HT_PHASOR"), "inphase", "quadrature")(lambda b: {"inphase": _late((c := Cycle(b["close"])).i1, 32), "quadrature": _late(c.q1, 32)})
    indicator(_pre + _case("HT_SINE"), "sine", "leadsine")(_sine)
    indicator(_pre + _case("HT_TRENDLINE"))(lambda b: {"real": Cycle(b["close"]).trendline(b["close"])})
    indicator(_pre + _case("HT_TRENDMODE"), "integer")(_mode)

    @indicator(_pre + _case("MAMA"), "mama", "fama")
    def mesa(b: Bars, fast: float = 0.5, slow: float = 0.05) -> dict:
        x = b["close"]
        c = Cycle(x)
        out, follow = np.full(len(x), np.nan), np.full(len(x), np.nan)
        m = f = x[0] if len(x) else 0.0
        before = 0.0
        for k in range(12, len(x)):
            p = math.degrees(math.atan(c.q1[k] / c.i1[k])) if c.i1[k] else 0.0
            a = max(slow, fast / max(before - p, 1.0))
            before = p
            m = a * x[k] + (1 - a) * m
            f = 0.5 * a * m + (1 - 0.5 * a) * f
            if k >= 32:
                out[k], follow[k] = m, f
        return {"mama": out, "fama": follow}
