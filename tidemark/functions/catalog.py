"""Technical indicators as window expressions, in two families of names: ta, after the classic library's functions, and pta.

An indicator is a function of its parameters that gives layers of expressions over open, high, low, close and volume; the
last layer holds its outputs. add() puts them on a panel; the text of a layer is SQL that DuckDB reads too."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..plans.portable import Over, doubles, to_duck

Layers = list[dict[str, str]]
TA: dict[str, Callable[..., Layers]] = {}
PTA: dict[str, Callable[..., Layers]] = {}
o = Over(("{by}",), ("{order}",))
PI = repr(math.pi)
RN = {"rn": f"row_number() {o.at}"}
PC = {"pc": o.lag("close")}
TR = "greatest(high - low, abs(high - pc), abs(low - pc))"
TP = "(high + low + close) / 3"


def div(a: str, b: str) -> str:
    return f"({a}) / nullif({b}, 0)"


def sma(x: str, n: int) -> str:
    return o.mean(x, n)


def wma(x: str, n: int) -> str:
    return o.weighted(x, [2 * (n - k) / (n * (n + 1)) for k in range(n)])


def weighted(x: str, w: list[float]) -> str:
    """Oldest weight first."""
    total = sum(w)
    return o.weighted(x, [v / total for v in reversed(w)])


def highest(x: str, n: int) -> str:
    return o.max(x, n)


def lowest(x: str, n: int) -> str:
    return o.min(x, n)


def slope(x: str, n: int) -> str:
    return o.full(f"regr_slope({x}, rn)", x, n)


def add(df: DataFrame, layers: Layers, by: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ("ts",), columns: dict[str, str] | None = None) -> DataFrame:
    """`df` with the outputs of the layers. columns: which of its columns stand for open, high, low, close and volume."""
    names = {c: (columns or {}).get(c, c) for c in ("open", "high", "low", "close", "volume")}
    there = {c: n for c, n in names.items() if n in df.columns and n != c}
    out = df.withColumns({f"__was_{c}": F.col(c) for c in there if c in df.columns}).withColumns({c: F.col(n) for c, n in there.items()}) if there else df
    made = []
    for layer in layers:
        out = out.withColumns({k: F.expr(doubles(placed(v, by, order))) for k, v in layer.items()})
        made += list(layer)
    for c in there:
        out = out.withColumn(c, F.col(f"__was_{c}")).drop(f"__was_{c}") if c in df.columns else out.drop(c)
    return out.drop(*(c for c in made if c not in layers[-1]))


def placed(text: str, by: tuple[str, ...], order: tuple[str, ...]) -> str:
    return text.replace("{by}", ", ".join(by)).replace("{order}", ", ".join(order))


def duck(source: str, layers: Layers) -> str:
    sql = source
    for layer in layers:
        made = ", ".join(f"{to_duck(doubles(placed(v, ('symbol',), ('ts',)))).replace('struct(', 'row(')} AS {k}" for k, v in layer.items())
        sql = f"SELECT *, {made} FROM ({sql}) AS t"
    return sql


def _ta(name: str, make: Callable[..., Layers]) -> None:
    TA[name] = make


def _pta(name: str, make: Callable[..., Layers]) -> None:
    PTA[name] = make


def real(x: str) -> Layers:
    return [{"real": x}]


# row by row
for _f in ("acos", "asin", "atan", "ceil", "cos", "cosh", "exp", "floor", "ln", "log10", "sin", "sinh", "sqrt", "tan", "tanh"):
    _ta(_f.upper(), lambda f=_f: real(f"{f}(close)"))
for _n, _op in (("ADD", "+"), ("SUB", "-"), ("MULT", "*")):
    _ta(_n, lambda op=_op: real(f"high {op} low"))
_ta("DIV", lambda: real(div("high", "low")))
_ta("AVGPRICE", lambda: real("(open + high + low + close) / 4"))
_ta("MEDPRICE", lambda: real("(high + low) / 2"))
_ta("TYPPRICE", lambda: real(TP))
_ta("WCLPRICE", lambda: real("(high + low + 2 * close) / 4"))
_ta("BOP", lambda: real(f"coalesce({div('close - open', 'high - low')}, 0)"))

# means, bands, extremes
_ta("SMA", lambda n=30: real(sma("close", n)))
_ta("MA", lambda n=30: real(sma("close", n)))
_ta("SUM", lambda n=30: real(o.sum("close", n)))
_ta("MAX", lambda n=30: real(highest("close", n)))
_ta("MIN", lambda n=30: real(lowest("close", n)))
_ta("MINMAX", lambda n=30: [{"min": lowest("close", n), "max": highest("close", n)}])
_AT = lambda f, x, n: o.full(f"{f}_by(rn, struct({x}, {'rn' if f == 'max' else '-rn'}))", x, n)
_ta("MAXINDEX", lambda n=30: [RN, {"integer": f"{_AT('max', 'close', n)} - 1"}])
_ta("MININDEX", lambda n=30: [RN, {"integer": f"{_AT('min', 'close', n)} - 1"}])
_ta("MINMAXINDEX", lambda n=30: [RN, {"minidx": f"{_AT('min', 'close', n)} - 1", "maxidx": f"{_AT('max', 'close', n)} - 1"}])
_ta("MIDPOINT", lambda n=14: real(f"({highest('close', n)} + {lowest('close', n)}) / 2"))
_ta("MIDPRICE", lambda n=14: real(f"({highest('high', n)} + {lowest('low', n)}) / 2"))
_ta("STDDEV", lambda n=5, k=1.0: real(f"{k!r} * {o.std('close', n, 0)}"))
_ta("VAR", lambda n=5: real(o.full("var_pop(close)", "close", n)))
_ta("WMA", lambda n=30: real(wma("close", n)))


def _trima(x: str, n: int) -> Layers:
    a, b = ((n + 1) // 2,) * 2 if n % 2 else (n // 2, n // 2 + 1)
    return [{"__t": sma(x, a)}, {"real": sma("__t", b)}]


_ta("TRIMA", lambda n=30: _trima("close", n))
_ta("BBANDS", lambda n=5, up=2.0, dn=2.0: [{"__m": sma("close", n), "__s": o.std("close", n, 0)}, {"upperband": f"__m + {up!r} * __s", "middleband": "__m", "lowerband": f"__m - {dn!r} * __s"}])
_ACC = lambda n, c: [{"__u": f"high * (1 + {c} * coalesce({div('high - low', 'high + low')}, 0))", "__l": f"low * (1 - {c} * coalesce({div('high - low', 'high + low')}, 0))"}]
_ta("ACCBANDS", lambda n=20: _ACC(n, 4) + [{"upperband": sma("__u", n), "middleband": sma("close", n), "lowerband": sma("__l", n)}])
_ta("APO", lambda fast=12, slow=26: real(f"{sma('close', fast)} - {sma('close', slow)}"))
_ta("PPO", lambda fast=12, slow=26: real(f"100 * ({div(sma('close', fast), sma('close', slow))} - 1)"))
_ta("MACDEXT", lambda fast=12, slow=26, signal=9: [{"macd": f"{sma('close', fast)} - {sma('close', slow)}"}, {"macdsignal": sma("macd", signal)}, {"macd": "macd", "macdsignal": "macdsignal", "macdhist": "macd - macdsignal"}])
_ta("MAVP", lambda low=2, high=30: [{"__p": f"least(greatest(cast(volume as int), {low}), {high})"}, {"real": "CASE __p " + " ".join(f"WHEN {n} THEN {sma('close', n)}" for n in range(low, high + 1)) + " END"}])

# momentum
_ta("MOM", lambda n=10: real(f"close - {o.lag('close', n)}"))
_ta("ROC", lambda n=10: real(f"100 * ({div('close', o.lag('close', n))} - 1)"))
_ta("ROCP", lambda n=10: real(f"{div('close', o.lag('close', n))} - 1"))
_ta("ROCR", lambda n=10: real(div("close", o.lag("close", n))))
_ta("ROCR100", lambda n=10: real(f"100 * {div('close', o.lag('close', n))}"))
_UP = lambda n: f"100 * (_n - (rn - {_AT('max', 'high', n + 1)})) / _n".replace("_n", f"{n}.0")
_DOWN = lambda n: f"100 * (_n - (rn - {o.full('max_by(rn, struct(-low, rn))', 'low', n + 1)})) / _n".replace("_n", f"{n}.0")
_ta("AROON", lambda n=14: [RN, {"aroondown": _DOWN(n), "aroonup": _UP(n)}])
_ta("AROONOSC", lambda n=14: [RN, {"real": f"{_UP(n)} - {_DOWN(n)}"}])
_ta("WILLR", lambda n=14: real(f"-100 * {div(highest('high', n) + ' - close', highest('high', n) + ' - ' + lowest('low', n))}"))
_FASTK = lambda n: f"100 * {div('close - ' + lowest('low', n), highest('high', n) + ' - ' + lowest('low', n))}"
_ta("STOCHF", lambda n=5, d=3: [{"__k": _FASTK(n)}, {"fastk": "__k", "fastd": sma("__k", d)}])
_ta("STOCH", lambda n=5, k=3, d=3: [{"__k": _FASTK(n)}, {"__s": sma("__k", k)}, {"slowk": "__s", "slowd": sma("__s", d)}])
_ta("IMI", lambda n=14: [{"__u": "greatest(close - open, 0.0)", "__d": "greatest(open - close, 0.0)"}, {"real": f"100 * {div(o.sum('__u', n), o.sum('__u', n) + ' + ' + o.sum('__d', n))}"}])
_MF = [{"__t": TP}, {"__b": o.lag("__t")}, {"__p": "CASE WHEN __t > __b THEN __t * volume WHEN __b IS NOT NULL THEN 0.0 END", "__q": "CASE WHEN __t < __b THEN __t * volume WHEN __b IS NOT NULL THEN 0.0 END"}]
_ta("MFI", lambda n=14: _MF + [{"real": f"100 * {div(o.sum('__p', n), o.sum('__p', n) + ' + ' + o.sum('__q', n))}"}])
_BP = [PC, {"__bp": "CASE WHEN pc IS NOT NULL THEN close - least(low, pc) END", "__tr": "CASE WHEN pc IS NOT NULL THEN greatest(high, pc) - least(low, pc) END"}]
_ULT = lambda a, b, c: f"100 * (4 * {div(o.sum('__bp', a), o.sum('__tr', a))} + 2 * {div(o.sum('__bp', b), o.sum('__tr', b))} + {div(o.sum('__bp', c), o.sum('__tr', c))}) / 7"
_ta("ULTOSC", lambda a=7, b=14, c=28: _BP + [{"real": _ULT(a, b, c)}])


def mean_deviation(x: str, n: int, m: str) -> str:
    """Mean distance of the last n values from m, the current row's."""
    return "(" + " + ".join(f"abs({o.lag(x, k) if k else x} - {m})" for k in range(n)) + f") / {n}"


_CCI = lambda n: [{"__t": TP}, {"__m": sma("__t", n)}, {"__d": mean_deviation("__t", n, "__m")}]
_ta("CCI", lambda n=14: _CCI(n) + [{"real": div("__t - __m", "0.015 * __d")}])
_ta("AVGDEV", lambda n=14: [{"__m": sma("close", n)}, {"real": mean_deviation("close", n, "__m")}])

# regression
_LR = lambda n, at: [RN, {"real": f"{sma('close', n)} + {slope('close', n)} * {at!r}"}]
_ta("LINEARREG", lambda n=14: _LR(n, (n - 1) / 2))
_ta("LINEARREG_INTERCEPT", lambda n=14: _LR(n, -(n - 1) / 2))
_ta("TSF", lambda n=14: _LR(n, (n + 1) / 2))
_ta("LINEARREG_SLOPE", lambda n=14: [RN, {"real": slope("close", n)}])
_ta("LINEARREG_ANGLE", lambda n=14: [RN, {"real": f"atan({slope('close', n)}) * 180 / {PI}"}])
_ta("CORREL", lambda n=30: real(o.full("corr(high, low)", "close", n)))
_ta("BETA", lambda n=5: [{"__x": f"{div('high', o.lag('high'))} - 1", "__y": f"{div('low', o.lag('low'))} - 1"}, {"real": o.full("covar_pop(__x, __y)", "__x", n)[:-4] + f" / nullif(var_pop(__x) {o.w(n)}, 0) END"}])

# volume and ranges
_CLV = f"coalesce({div('(close - low) - (high - close)', 'high - low')}, 0) * volume"
_ta("AD", lambda: [{"__v": _CLV}, {"real": f"sum(__v) {o.run}"}])
_OBV = [PC, {"__v": "CASE WHEN pc IS NULL THEN volume WHEN close > pc THEN volume WHEN close < pc THEN -volume ELSE 0.0 END"}]
_ta("OBV", lambda: _OBV + [{"real": f"sum(__v) {o.run}"}])
_ta("TRANGE", lambda: [PC, {"real": f"CASE WHEN pc IS NOT NULL THEN {TR} END"}])


# the second family: the same under its names, with its defaults
for _n, _t, _d in (
    ("avgprice", "AVGPRICE", ()), ("ohlc4", "AVGPRICE", ()), ("hl2", "MEDPRICE", ()), ("medprice", "MEDPRICE", ()), ("hlc3", "TYPPRICE", ()), ("typprice", "TYPPRICE", ()), ("wcp", "WCLPRICE", ()), ("bop", "BOP", ()),
    ("ad", "AD", ()), ("obv", "OBV", ()), ("sma", "SMA", (10,)), ("wma", "WMA", (10,)), ("trima", "TRIMA", (10,)), ("mom", "MOM", (1,)), ("roc", "ROC", (1,)), ("rocp", "ROCP", (1,)), ("rocr", "ROCR", (1,)), ("rocr100", "ROCR100", (1,)),
    ("midpoint", "MIDPOINT", (2,)), ("midprice", "MIDPRICE", (2,)), ("willr", "WILLR", (14,)), ("cci", "CCI", (14,)), ("mfi", "MFI", (14,)), ("apo", "APO", (12, 26)), ("linreg", "LINEARREG", (14,)), ("linregslope", "LINEARREG_SLOPE", (14,)),
    ("linregangle", "LINEARREG_ANGLE", (14,)), ("linregintercept", "LINEARREG_INTERCEPT", (14,)), ("tsf", "TSF", (14,)), ("true_range", "TRANGE", ()), ("correl", "CORREL", (30,)), ("mavp", "MAVP", ()), ("uo", "ULTOSC", ()), ("md", "AVGDEV", (14,)), ("mad", "AVGDEV", (30,)),
):
    _pta(_n, lambda t=_t, d=_d, *a: TA[t](*(a or d)))
_pta("stdev", lambda n=30: real(o.std("close", n)))
_pta("variance", lambda n=30: real(o.full("var_samp(close)", "close", n)))
_pta("median", lambda n=30: real(o.full("percentile(close, 0.5)", "close", n)))
_pta("quantile", lambda n=30, q=0.5: real(o.full(f"percentile(close, {q!r})", "close", n)))
_pta("zscore", lambda n=30: real(div(f"close - {sma('close', n)}", o.std("close", n))))
_MOMENT = lambda k, n: "(" + " + ".join(f"pow({o.lag('close', j) if j else 'close'} - __m, {k})" for j in range(n)) + ")"
_pta("skew", lambda n=30: [{"__m": sma("close", n)}, {"__2": _MOMENT(2, n) + f" / {n}", "__3": _MOMENT(3, n) + f" / {n}"}, {"real": f"{math.sqrt(n * (n - 1)) / (n - 2)!r} * {div('__3', 'pow(__2, 1.5)')}"}])
_pta("kurtosis", lambda n=30: [{"__m": sma("close", n)}, {"__2": _MOMENT(2, n) + f" / {n}", "__4": _MOMENT(4, n) + f" / {n}"}, {"real": f"{(n - 1) / ((n - 2) * (n - 3))!r} * ({n + 1} * ({div('__4', '__2 * __2')} - 3) + 6)"}])
_pta("log_return", lambda n=1: real(f"ln(close) - ln({o.lag('close', n)})"))
_pta("percent_return", lambda n=1: real(f"{div('close', o.lag('close', n))} - 1"))
_pta("drawdown", lambda: [{"__h": f"max(close) {o.run}"}, {"dd": "__h - close", "dd_pct": f"1 - {div('close', '__h')}", "dd_log": "ln(__h) - ln(close)"}])
_pta("bbands", lambda n=5, k=2.0: [{"__m": sma("close", n), "__s": o.std("close", n, 0)}, {"bbl": f"__m - {k!r} * __s", "bbm": "__m", "bbu": f"__m + {k!r} * __s"}, {"bbl": "bbl", "bbm": "bbm", "bbu": "bbu", "bbb": f"100 * {div('bbu - bbl', 'bbm')}", "bbp": div("close - bbl", "bbu - bbl")}])
_pta("accbands", lambda n=20, c=4: _ACC(n, c) + [{"accbl": sma("__l", n), "accbm": sma("close", n), "accbu": sma("__u", n)}])
_pta("donchian", lambda low=20, up=20: [{"dcl": lowest("low", low), "dcu": highest("high", up)}, {"dcl": "dcl", "dcm": "(dcl + dcu) / 2", "dcu": "dcu"}])
_pta("ao", lambda fast=5, slow=34: [{"__h": "(high + low) / 2"}, {"real": f"{sma('__h', fast)} - {sma('__h', slow)}"}])
_pta("aroon", lambda n=14: TA["AROON"](n)[:-1] + [{**TA["AROON"](n)[-1], "aroonosc": f"{_UP(n)} - {_DOWN(n)}"}])
_pta("beta", lambda n=30: [{"__x": f"{div('close', o.lag('close'))} - 1", "__y": f"{div('open', o.lag('open'))} - 1"}, {"real": f"CASE WHEN count(__x) {o.w(n)} >= {n} THEN covar_samp(__x, __y) {o.w(n)} / nullif(var_samp(__y) {o.w(n)}, 0) END"}])
_pta("bias", lambda n=26: real(f"{div('close', sma('close', n))} - 1"))
_pta("brar", lambda n=26: [PC, {"__ho": "high - open", "__ol": "open - low", "__hc": "CASE WHEN pc IS NOT NULL THEN greatest(high - pc, 0.0) END", "__cl": "CASE WHEN pc IS NOT NULL THEN greatest(pc - low, 0.0) END"}, {"ar": f"100 * {div(o.sum('__ho', n), o.sum('__ol', n))}", "br": f"100 * {div(o.sum('__hc', n), o.sum('__cl', n))}"}])
_pta("cdl_z", lambda n=30: [{f"{c}_z": div(f"{c} - {sma(c, n)}", o.std(c, n)) for c in ("open", "high", "low", "close")}])
_pta("cdl_doji", lambda n=10, f=10.0: [{"__b": "abs(close - open)", "__r": "high - low"}, {"__a": sma("__r", n)}, {"real": f"CASE WHEN __b < {f / 100!r} * __a THEN 100 ELSE 0 END"}])
_pta("cdl_inside", lambda: real(f"CASE WHEN high < {o.lag('high')} AND low > {o.lag('low')} THEN CASE WHEN close >= open THEN 1 ELSE -1 END ELSE 0 END"))
_pta("cfo", lambda n=9: [RN, {"__f": f"{sma('close', n)} + {slope('close', n)} * {(n - 1) / 2!r}"}, {"real": f"100 * {div('close - __f', 'close')}"}])
_pta("fosc", lambda n=14: [RN, {"__f": f"{sma('close', n)} + {slope('close', n)} * {(n + 1) / 2!r}"}, {"__g": o.lag("__f")}, {"real": f"100 * {div('close - __g', 'close')}"}])
_pta("cg", lambda n=10: real(f"-({' + '.join(f'{k + 1} * ' + (o.lag('close', k) if k else 'close') for k in range(n))}) / nullif({o.sum('close', n)}, 0)"))
_pta("chop", lambda n=14: [PC, {"__tr": f"CASE WHEN pc IS NOT NULL THEN {TR} END"}, {"real": f"100 * ln(nullif({div(o.sum('__tr', n), highest('high', n) + ' - ' + lowest('low', n))}, 0)) / {math.log(n)!r}"}])
_pta("cmf", lambda n=20: [{"__v": _CLV}, {"real": div(o.sum("__v", n), o.sum("volume", n))}])
_pta("coppock", lambda n=10, fast=11, slow=14: [{"__r": f"100 * ({div('close', o.lag('close', fast))} - 1) + 100 * ({div('close', o.lag('close', slow))} - 1)"}, {"real": wma("__r", n)}])
_pta("cti", lambda n=12: [RN, {"real": o.full("corr(close, rn)", "close", n)}])
_pta("decay", lambda n=5: real(f"greatest(close, {', '.join(o.lag('close', k) + f' - {k / n!r}' for k in range(1, n + 1))}, 0.0)"))
_pta("increasing", lambda n=1: real(f"CASE WHEN close > {o.lag('close', n)} THEN 1 ELSE 0 END"))
_pta("decreasing", lambda n=1: real(f"CASE WHEN close < {o.lag('close', n)} THEN 1 ELSE 0 END"))
_pta("dpo", lambda n=20: [{"__m": sma("close", n)}, {"real": f"close - {o.lag('__m', n // 2 + 1)}"}])
_pta("emv", lambda: [{"__h": "(high + low) / 2"}, {"real": div(f"(__h - {o.lag('__h')}) * (high - low)", "volume / 10000")}])
_pta("eom", lambda n=14, k=100000000: [{"__h": "(high + low) / 2"}, {"__e": div(f"(__h - {o.lag('__h')}) * (high - low)", f"volume / {k}")}, {"real": sma("__e", n)}])
_pta("entropy", lambda n=10: [{"__s": o.sum("close", n)}, {"__p": div("close", "__s")}, {"__e": "-__p * ln(nullif(__p, 0)) / ln(2.0)"}, {"real": o.sum("__e", n)}])
_pta("er", lambda n=10: [{"__d": f"abs(close - {o.lag('close')})"}, {"real": div(f"abs(close - {o.lag('close', n)})", o.sum("__d", n))}])


def _fib(n: int) -> list[float]:
    out = [1.0, 1.0]
    while len(out) < n:
        out.append(out[-1] + out[-2])
    return out[:n]


_pta("fwma", lambda n=10: real(weighted("close", _fib(n + 1)[1:])))
_pta("pwma", lambda n=10: real(weighted("close", [float(math.comb(n - 1, k)) for k in range(n)])))
_pta("sinwma", lambda n=14: real(weighted("close", [math.sin((k + 1) * math.pi / (n + 1)) for k in range(n)])))
_pta("swma", lambda n=10: real(weighted("close", [float(min(k + 1, n - k)) for k in range(n)])))
_pta("alma", lambda n=10, sigma=6.0, offset=0.85: real(weighted("close", [math.exp(-((k - math.floor(offset * (n - 1))) ** 2) / (2 * (n / sigma) ** 2)) for k in range(n)])))
_pta("hma", lambda n=10: [{"__d": f"2 * {wma('close', n // 2)} - {wma('close', n)}"}, {"real": wma("__d", int(math.sqrt(n)))}])
_pta("vwma", lambda n=10: [{"__v": "close * volume"}, {"real": div(o.sum("__v", n), o.sum("volume", n))}])
_pta("vwmacd", lambda fast=12, slow=26, signal=9: [{"__v": "close * volume"}, {"__m": f"{div(o.sum('__v', fast), o.sum('volume', fast))} - {div(o.sum('__v', slow), o.sum('volume', slow))}"}, {"__s": sma("__m", signal)}, {"macd": "__m", "signal": "__s", "hist": "__m - __s"}])
_LR1 = {"__l": f"ln({div('close', o.lag('close'))})"}
_pta("hvol", lambda n=20, year=252: [_LR1, {"real": f"100 * {o.std('__l', n)} * {math.sqrt(year)!r}"}])
_pta("avolume", lambda n=20, year=252: [_LR1, {"real": f"{o.std('__l', n)} * {math.sqrt(year)!r}"}])
_MID = lambda n: f"({highest('high', n)} + {lowest('low', n)}) / 2"
_pta("ichimoku", lambda a=9, b=26, c=52: [{"__t": _MID(a), "__k": _MID(b), "__s": _MID(c)}, {"isa": o.lag("(__t + __k) / 2", b - 1), "isb": o.lag("__s", b - 1), "its": "__t", "iks": "__k", "ics": o.lag("close", -(b - 1))}])
_KST = lambda r, n: sma(f"__r{r}", n)
_pta("kst", lambda: [{f"__r{r}": f"100 * ({div('close', o.lag('close', r))} - 1)" for r in (10, 15, 20, 30)}, {"__k": f"{_KST(10, 10)} + 2 * {_KST(15, 10)} + 3 * {_KST(20, 10)} + 4 * {_KST(30, 15)}"}, {"kst": "__k", "ksts": sma("__k", 9)}])
_TREND = lambda up, n, f, s: [{"__f": sma("close", f), "__s": sma("close", s)}, {"real": f"CASE WHEN (__f {up} {o.lag('__f', n)} AND __s {'<' if up == '>' else '>'} {o.lag('__s', n)}) OR (__f {up} {o.lag('__f', n)} AND __s {up} {o.lag('__s', n)}) THEN 1 ELSE 0 END"}]
_pta("long_run", lambda n=2, fast=8, slow=21: _TREND(">", n, fast, slow))
_pta("short_run", lambda n=2, fast=8, slow=21: _TREND("<", n, fast, slow))
_pta("marketfi", lambda: real(div("high - low", "volume")))
_pta("nvi", lambda: [PC, {"__v": o.lag("volume")}, {"__r": f"CASE WHEN volume < __v THEN 100 * ({div('close', 'pc')} - 1) ELSE 0.0 END"}, {"real": f"1000 + sum(__r) {o.run}"}])
_pta("pvi", lambda: [PC, {"__v": o.lag("volume")}, {"__r": f"CASE WHEN volume > __v THEN 100 * ({div('close', 'pc')} - 1) ELSE 0.0 END"}, {"real": f"1000 + sum(__r) {o.run}"}])
_pta("pdist", lambda: [PC, {"real": "2 * (high - low) - abs(close - open) + abs(open - pc)"}])
_pta("po", lambda n=14: [RN, {"__u": f"{sma('high', n)} + {slope('high', n)} * {(n - 1) / 2!r}", "__l": f"{sma('low', n)} + {slope('low', n)} * {(n - 1) / 2!r}"}, {"real": f"100 * {div('close - __l', '__u - __l')}"}])
_pta("psl", lambda n=12: [{"__u": f"CASE WHEN close > {o.lag('close')} THEN 1.0 ELSE 0.0 END"}, {"real": f"100 * {o.sum('__u', n)} / {n}"}])
_pta("pvol", lambda: real("close * volume"))
_pta("pvr", lambda: [PC, {"__v": o.lag("volume")}, {"real": "CASE WHEN close >= pc AND volume >= __v THEN 1 WHEN close >= pc AND volume < __v THEN 2 WHEN close < pc AND volume >= __v THEN 3 WHEN close < pc AND volume < __v THEN 4 END"}])
_pta("pvt", lambda: [PC, {"__r": f"coalesce(100 * ({div('close', 'pc')} - 1) * volume, 0.0)"}, {"real": f"sum(__r) {o.run}"}])
_pta("qstick", lambda n=10: [{"__d": "close - open"}, {"real": sma("__d", n)}])
_pta("rainbow", lambda n=2, k=10: [{"__r1": sma("close", n)}] + [{f"__r{i}": sma(f"__r{i - 1}", n)} for i in range(2, k + 1)] + [{f"rainbow_{i}": f"__r{i}" for i in range(1, k + 1)}])
_SW = lambda x: f"({x} + 2 * {o.lag(x)} + 2 * {o.lag(x, 2)} + {o.lag(x, 3)}) / 6"
_pta("rvgi", lambda n=14: [{"__a": "close - open", "__b": "high - low"}, {"__c": _SW("__a"), "__d": _SW("__b")}, {"__r": div(o.sum("__c", n), o.sum("__d", n))}, {"rvgi": "__r", "rvgis": _SW("__r")}])
_pta("slope", lambda n=1: real(f"(close - {o.lag('close', n)}) / {n}"))
_pta("smc_sweep", lambda n=15, k=1.5: [{"__h": f"max(high) {o.between(-n, -1)}", "__l": f"min(low) {o.between(-n, -1)}", "__b": "abs(close - open)"}, {"real": f"CASE WHEN high > __h AND close < __h AND high - greatest(open, close) > {k!r} * __b THEN -1 WHEN low < __l AND close > __l AND least(open, close) - low > {k!r} * __b THEN 1 ELSE 0 END"}])
_pta("stderr", lambda n=30: real(f"{o.std('close', n)} / {math.sqrt(n)!r}"))
_pta("stochf", lambda n=14, d=3: TA["STOCHF"](n, d))
_pta("stoch", lambda n=14, k=3, d=3: TA["STOCH"](n, k, d))
_SGN = {"__u": f"CASE WHEN close > {o.lag('close', 4)} THEN 1 ELSE 0 END", "__d": f"CASE WHEN close < {o.lag('close', 4)} THEN 1 ELSE 0 END"}
_pta("td_seq", lambda: [_SGN, {"__gu": f"sum(1 - __u) {o.run}", "__gd": f"sum(1 - __d) {o.run}"}, {"td_up": "sum(__u) OVER (PARTITION BY {by}, __gu ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "td_down": "sum(__d) OVER (PARTITION BY {by}, __gd ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"}])
_pta("ttm_trend", lambda n=6: [{"__h": "(high + low) / 2"}, {"real": f"CASE WHEN close > {sma('__h', n)} THEN 1 ELSE -1 END"}])
_pta("ui", lambda n=14: [{"__h": highest("close", n)}, {"__d": f"pow(100 * {div('close - __h', '__h')}, 2)"}, {"real": f"sqrt({o.sum('__d', n)} / {n})"}])
_pta("vhf", lambda n=28: [{"__d": f"abs(close - {o.lag('close')})"}, {"real": div(f"abs({highest('close', n)} - {lowest('close', n)})", o.sum("__d", n))}])
_pta("vortex", lambda n=14: [PC, {"__tr": f"CASE WHEN pc IS NOT NULL THEN {TR} END", "__p": f"abs(high - {o.lag('low')})", "__m": f"abs(low - {o.lag('high')})"}, {"vip": div(o.sum("__p", n), o.sum("__tr", n)), "vim": div(o.sum("__m", n), o.sum("__tr", n))}])
_pta("vosc", lambda fast=5, slow=10: real(f"100 * {div(sma('volume', fast) + ' - ' + sma('volume', slow), sma('volume', slow))}"))
_pta("vwap", lambda: [{"__v": f"({TP}) * volume"}, {"real": "sum(__v) OVER (PARTITION BY {by}, date_trunc('month', {order}) ORDER BY {order}) / nullif(sum(volume) OVER (PARTITION BY {by}, date_trunc('month', {order}) ORDER BY {order}), 0)"}])
_pta("wad", lambda: [PC, {"__w": "CASE WHEN close > pc THEN close - least(low, pc) WHEN close < pc THEN close - greatest(high, pc) ELSE 0.0 END"}, {"real": f"sum(__w) {o.run}"}])
_pta("msw", lambda n=5: [{"__r": " + ".join(f"{math.cos(2 * math.pi * k / n)!r} * {o.lag('close', k) if k else 'close'}" for k in range(n)), "__i": " + ".join(f"{math.sin(2 * math.pi * k / n)!r} * {o.lag('close', k) if k else 'close'}" for k in range(n))}, {"__p": f"CASE WHEN abs(__r) > 0.001 THEN atan(__i / __r) ELSE {math.pi / 2!r} * sign(__i) END"}, {"__q": f"CASE WHEN __r < 0 THEN __p + {PI} ELSE __p END + {math.pi / 2!r}"}, {"sine": "sin(__q)", "lead": f"sin(__q + {math.pi / 4!r})"}])
_pta("cpr", lambda: [{"__p": o.lag(TP), "__b": o.lag("(high + low) / 2"), "__h": o.lag("high"), "__l": o.lag("low")}, {"pp": "__p", "tc": "greatest(2 * __p - __b, __b)", "bc": "least(2 * __p - __b, __b)", "r1": "2 * __p - __l", "s1": "2 * __p - __h", "r2": "__p + __h - __l", "s2": "__p - __h + __l"}])
_pta("tos_stdevall", lambda k=2: [RN, {"__b": f"regr_slope(close, rn) {o.all}", "__a": f"regr_intercept(close, rn) {o.all}"}, {"__m": "__a + __b * rn"}, {"__s": f"stddev_samp(close - __m) {o.all}"}, {"line": "__m", "lower": f"__m - {k} * __s", "upper": f"__m + {k} * __s"}])
_pta("tsignals", lambda n=20: [{"__t": f"CASE WHEN close > {sma('close', n)} THEN 1 ELSE 0 END"}, {"__x": f"__t - coalesce({o.lag('__t')}, 0)"}, {"trend": "__t", "trade": "__x", "entry": "CASE WHEN __x > 0 THEN 1 ELSE 0 END", "exit_": "CASE WHEN __x < 0 THEN 1 ELSE 0 END"}])
_pta("xsignals", lambda n=20: [{"__z": div(f"close - {sma('close', n)}", o.std("close", n))}, {"__b": o.lag("__z")}, {"above": "CASE WHEN __z > 1 AND __b <= 1 THEN 1 ELSE 0 END", "below": "CASE WHEN __z < -1 AND __b >= -1 THEN 1 ELSE 0 END"}])
