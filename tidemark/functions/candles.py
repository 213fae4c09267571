"""Candle patterns as window expressions: 100 for a bullish one, -100 for a bearish one, else 0.

Bodies, shadows and ranges are judged against their means over the rows before each candle."""

from __future__ import annotations

from collections.abc import Callable

from .catalog import Layers, o

PATTERNS: dict[str, Callable[..., Layers]] = {}


def _before(x: str, n: int) -> str:
    return f"CASE WHEN count({x}) {o.between(-n, -1)} >= {n} THEN avg({x}) {o.between(-n, -1)} END"


#: Colour, body, shadows and range of each candle, then what they are against the means of ten or five rows before.
BASE: Layers = [
    {"k_c": "CASE WHEN close >= open THEN 1 ELSE -1 END", "k_b": "abs(close - open)", "k_t": "greatest(open, close)", "k_f": "least(open, close)", "k_r": "high - low", "k_u": "high - greatest(open, close)", "k_l": "least(open, close) - low"},
    {"k_s": "k_u + k_l"},
    {"k_mb": _before("k_b", 10), "k_mr": _before("k_r", 10), "k_mr5": _before("k_r", 5), "k_ms": _before("k_s", 10)},
    {
        "k_long": "coalesce(k_b > k_mb, false)", "k_vlong": "coalesce(k_b > 3 * k_mb, false)", "k_short": "coalesce(k_b < k_mb, false)", "k_doji": "coalesce(k_b <= 0.1 * k_mr, false)",
        "k_uvs": "coalesce(k_u < 0.1 * k_mr, false)", "k_lvs": "coalesce(k_l < 0.1 * k_mr, false)", "k_ush": "coalesce(k_u < k_ms / 2, false)", "k_lsh": "coalesce(k_l < k_ms / 2, false)",
        "k_ulg": "coalesce(k_u > k_b, false)", "k_llg": "coalesce(k_l > k_b, false)", "k_uvl": "coalesce(k_u > 2 * k_b, false)", "k_lvl": "coalesce(k_l > 2 * k_b, false)",
        "k_near": "0.2 * k_mr5", "k_far": "0.6 * k_mr5", "k_eq": "0.05 * k_mr5",
    },
]
_SHORT = {"C": "close", "O": "open", "H": "high", "L": "low", "c": "k_c", "b": "k_b", "t": "k_t", "f": "k_f", "u": "k_u", "l": "k_l"}


def at(text: str) -> str:
    """Fills in {C1} for the close one candle before, {long2} for whether the body was long two before, and so on."""
    import re

    def one(m: re.Match) -> str:
        name, k = m[1], int(m[2])
        column = _SHORT.get(name, f"k_{name}")
        return f"({o.lag(column, k)})" if k else column

    return re.sub(r"\{([A-Za-z]+5?[a-z]*?)(\d)\}", one, text)


def _pattern(name: str, *, up: str | None = None, down: str | None = None, both: str | None = None, sign: str = "{c0}") -> None:
    """up and down: conditions of the two; both: one whose direction is `sign`."""
    if both is not None:
        text = f"CASE WHEN coalesce({at(both)}, false) THEN 100 * ({at(sign)}) ELSE 0 END"
    else:
        text = "CASE" + (f" WHEN coalesce({at(up)}, false) THEN 100" if up else "") + (f" WHEN coalesce({at(down)}, false) THEN -100" if down else "") + " ELSE 0 END"
    PATTERNS[name] = lambda: [*BASE, {"integer": text}]


_GAP_UP = lambda a, b: f"{{f{a}}} > {{t{b}}}"  # noqa: E731  the body of a lies above that of b
_GAP_DOWN = lambda a, b: f"{{t{a}}} < {{f{b}}}"
_INSIDE = lambda a, b: f"{{t{a}}} < {{t{b}}} AND {{f{a}}} > {{f{b}}}"
_EQUAL = lambda x, y, k: f"abs({x} - {y}) <= {{eq{k}}}"
_NEAR = lambda x, y, k: f"abs({x} - {y}) <= {{near{k}}}"

# one candle
_pattern("CDLDOJI", both="{doji0}", sign="1")
_pattern("CDLDRAGONFLYDOJI", both="{doji0} AND {uvs0} AND NOT {lvs0}", sign="1")
_pattern("CDLGRAVESTONEDOJI", both="{doji0} AND {lvs0} AND NOT {uvs0}", sign="1")
_pattern("CDLLONGLEGGEDDOJI", both="{doji0} AND ({ulg0} OR {llg0})", sign="1")
_pattern("CDLRICKSHAWMAN", both="{doji0} AND {ulg0} AND {llg0} AND {f0} <= {L0} + ({H0} - {L0}) / 2 + {near0} AND {t0} >= {L0} + ({H0} - {L0}) / 2 - {near0}", sign="1")
_pattern("CDLTAKURI", both="{doji0} AND {uvs0} AND {lvl0}", sign="1")
_pattern("CDLMARUBOZU", both="{long0} AND {uvs0} AND {lvs0}")
_pattern("CDLCLOSINGMARUBOZU", both="{long0} AND (({c0} = 1 AND {uvs0}) OR ({c0} = -1 AND {lvs0}))")
_pattern("CDLBELTHOLD", both="{long0} AND (({c0} = 1 AND {lvs0}) OR ({c0} = -1 AND {uvs0}))")
_pattern("CDLLONGLINE", both="{long0} AND {ush0} AND {lsh0}")
_pattern("CDLSHORTLINE", both="{short0} AND {ush0} AND {lsh0}")
_pattern("CDLSPINNINGTOP", both="{short0} AND {u0} > {b0} AND {l0} > {b0}")
_pattern("CDLHIGHWAVE", both="{short0} AND {uvl0} AND {lvl0}")
_pattern("CDLHAMMER", both="{short0} AND {llg0} AND {uvs0} AND {f0} <= {L1} + {near1}", sign="1")
_pattern("CDLHANGINGMAN", both="{short0} AND {llg0} AND {uvs0} AND {f0} >= {H1} - {near1}", sign="-1")
_pattern("CDLINVERTEDHAMMER", both="{short0} AND {ulg0} AND {lvs0} AND " + _GAP_DOWN(0, 1), sign="1")
_pattern("CDLSHOOTINGSTAR", both="{short0} AND {ulg0} AND {lvs0} AND " + _GAP_UP(0, 1), sign="-1")
# two candles
_pattern("CDLENGULFING", up="{c0} = 1 AND {c1} = -1 AND {C0} >= {O1} AND {O0} <= {C1} AND {b0} > {b1}", down="{c0} = -1 AND {c1} = 1 AND {O0} >= {C1} AND {C0} <= {O1} AND {b0} > {b1}")
_pattern("CDLHARAMI", both="{long1} AND {short0} AND " + _INSIDE(0, 1), sign="-{c1}")
_pattern("CDLHARAMICROSS", both="{long1} AND {doji0} AND " + _INSIDE(0, 1), sign="-{c1}")
_pattern("CDLDOJISTAR", both=f"{{long1}} AND {{doji0}} AND (({{c1}} = 1 AND {_GAP_UP(0, 1)}) OR ({{c1}} = -1 AND {_GAP_DOWN(0, 1)}))", sign="-{c1}")
_pattern("CDLPIERCING", up="{c1} = -1 AND {long1} AND {c0} = 1 AND {long0} AND {O0} < {L1} AND {C0} < {O1} AND {C0} > {C1} + {b1} * 0.5")
PATTERNS["CDLDARKCLOUDCOVER"] = lambda penetration=0.5: [*BASE, {"integer": "CASE WHEN coalesce(" + at(f"{{c1}} = 1 AND {{long1}} AND {{c0}} = -1 AND {{O0}} > {{H1}} AND {{C0}} > {{O1}} AND {{C0}} < {{C1}} - {{b1}} * {penetration!r}") + ", false) THEN -100 ELSE 0 END"}]
_pattern("CDLCOUNTERATTACK", both="{c1} = -({c0}) AND {long1} AND {long0} AND " + _EQUAL("{C0}", "{C1}", 1))
_pattern("CDLSEPARATINGLINES", both="{c1} = -({c0}) AND " + _EQUAL("{O0}", "{O1}", 1) + " AND {long0} AND (({c0} = 1 AND {lvs0}) OR ({c0} = -1 AND {uvs0}))")
_pattern("CDLINNECK", down="{c1} = -1 AND {long1} AND {c0} = 1 AND {O0} < {L1} AND {C0} <= {C1} + {eq1} AND {C0} >= {C1}")
_pattern("CDLONNECK", down="{c1} = -1 AND {long1} AND {c0} = 1 AND {O0} < {L1} AND " + _EQUAL("{C0}", "{L1}", 1))
_pattern("CDLTHRUSTING", down="{c1} = -1 AND {long1} AND {c0} = 1 AND {O0} < {L1} AND {C0} > {C1} + {eq1} AND {C0} <= {C1} + {b1} * 0.5")
_pattern("CDLMATCHINGLOW", up="{c1} = -1 AND {c0} = -1 AND " + _EQUAL("{C0}", "{C1}", 1))
_pattern("CDLHOMINGPIGEON", up="{c1} = -1 AND {c0} = -1 AND {long1} AND {short0} AND {O0} < {O1} AND {C0} > {C1}")
_MARU = "{long%d} AND {uvs%d} AND {lvs%d}"
_KICK = f"{{c1}} = -({{c0}}) AND {_MARU.replace('%d', '1')} AND {_MARU.replace('%d', '0')} AND (({{c1}} = -1 AND {{L0}} > {{H1}}) OR ({{c1}} = 1 AND {{H0}} < {{L1}}))"
_pattern("CDLKICKING", both=_KICK)
_pattern("CDLKICKINGBYLENGTH", both=_KICK, sign="CASE WHEN {b0} > {b1} THEN {c0} ELSE {c1} END")
# three candles
_pattern("CDL2CROWS", down="{c2} = 1 AND {long2} AND {c1} = -1 AND " + _GAP_UP(1, 2) + " AND {c0} = -1 AND {O0} < {O1} AND {O0} > {C1} AND {C0} > {O2} AND {C0} < {C2}")
_pattern("CDLUPSIDEGAP2CROWS", down="{c2} = 1 AND {long2} AND {c1} = -1 AND {short1} AND " + _GAP_UP(1, 2) + " AND {c0} = -1 AND {O0} > {O1} AND {C0} < {C1} AND {C0} > {C2}")
_pattern("CDL3BLACKCROWS", down="{c3} = 1 AND {c2} = -1 AND {lvs2} AND {c1} = -1 AND {lvs1} AND {c0} = -1 AND {lvs0} AND {O1} < {O2} AND {O1} > {C2} AND {O0} < {O1} AND {O0} > {C1} AND {H3} > {C2} AND {C2} > {C1} AND {C1} > {C0}")
_pattern("CDLIDENTICAL3CROWS", down="{c2} = -1 AND {lvs2} AND {c1} = -1 AND {lvs1} AND {c0} = -1 AND {lvs0} AND {C2} > {C1} AND {C1} > {C0} AND " + _EQUAL("{O1}", "{C2}", 2) + " AND " + _EQUAL("{O0}", "{C1}", 1))
_pattern("CDL3WHITESOLDIERS", up="{c2} = 1 AND {uvs2} AND {c1} = 1 AND {uvs1} AND {c0} = 1 AND {uvs0} AND {C0} > {C1} AND {C1} > {C2} AND {O1} > {O2} AND {O1} <= {C2} + {near2} AND {O0} > {O1} AND {O0} <= {C1} + {near1} AND {b1} > {b2} - {far2} AND {b0} > {b1} - {far1} AND NOT {short0}")
_pattern("CDLADVANCEBLOCK", down="{c2} = 1 AND {c1} = 1 AND {c0} = 1 AND {C0} > {C1} AND {C1} > {C2} AND {O1} > {O2} AND {O1} <= {C2} + {near2} AND {O0} > {O1} AND {O0} <= {C1} + {near1} AND {long2} AND {ush2} AND (({b1} < {b2} - {far2} AND {b0} < {b1} + {near1}) OR {b0} < {b1} - {far1} OR ({b0} < {b1} AND {b1} < {b2} AND (NOT {ush0} OR NOT {ush1})) OR ({b0} < {b1} AND {ulg0}))")
_pattern("CDLSTALLEDPATTERN", down="{c2} = 1 AND {c1} = 1 AND {c0} = 1 AND {C0} > {C1} AND {C1} > {C2} AND {long2} AND {long1} AND {uvs1} AND {O1} > {O2} AND {O1} <= {C2} + {near2} AND {short0} AND {O0} >= {C1} - {b0} - {near1}")
_pattern("CDL3INSIDE", up="{long2} AND {short1} AND {c2} = -1 AND " + _INSIDE(1, 2) + " AND {c0} = 1 AND {C0} > {O2}", down="{long2} AND {short1} AND {c2} = 1 AND " + _INSIDE(1, 2) + " AND {c0} = -1 AND {C0} < {O2}")
_pattern("CDL3OUTSIDE", up="{c1} = 1 AND {c2} = -1 AND {C1} > {O2} AND {O1} < {C2} AND {C0} > {C1}", down="{c1} = -1 AND {c2} = 1 AND {O1} > {C2} AND {C1} < {O2} AND {C0} < {C1}")
_pattern("CDL3STARSINSOUTH", up="{c2} = -1 AND {c1} = -1 AND {c0} = -1 AND {long2} AND {llg2} AND {b1} < {b2} AND {O1} > {C2} AND {O1} <= {H2} AND {L1} < {C2} AND {L1} >= {L2} AND NOT {lvs1} AND {short0} AND {lvs0} AND {uvs0} AND {L0} > {L1} AND {H0} < {H1}")
_pattern("CDLUNIQUE3RIVER", up="{c2} = -1 AND {long2} AND {c1} = -1 AND {C1} > {C2} AND {O1} <= {O2} AND {L1} < {L2} AND {short0} AND {c0} = 1 AND {O0} > {L1}")
_pattern("CDLTRISTAR", up="{doji2} AND {doji1} AND {doji0} AND " + _GAP_DOWN(1, 2) + " AND {f0} > {f1}", down="{doji2} AND {doji1} AND {doji0} AND " + _GAP_UP(1, 2) + " AND {t0} < {t1}")
_pattern("CDLSTICKSANDWICH", up="{c2} = -1 AND {c1} = 1 AND {c0} = -1 AND {L1} > {C2} AND " + _EQUAL("{C0}", "{C2}", 2))
_pattern("CDLGAPSIDESIDEWHITE", both=f"(({_GAP_UP(1, 2)} AND {_GAP_UP(0, 2)}) OR ({_GAP_DOWN(1, 2)} AND {_GAP_DOWN(0, 2)})) AND {{c1}} = 1 AND {{c0}} = 1 AND {_NEAR('{b0}', '{b1}', 1)} AND {_EQUAL('{O0}', '{O1}', 1)}", sign="CASE WHEN " + _GAP_UP(1, 2) + " THEN 1 ELSE -1 END")
_pattern("CDLTASUKIGAP", up=_GAP_UP(1, 2) + " AND {c1} = 1 AND {c0} = -1 AND {O0} < {C1} AND {O0} > {O1} AND {C0} < {O1} AND {C0} > {t2} AND " + _NEAR("{b1}", "{b0}", 1), down=_GAP_DOWN(1, 2) + " AND {c1} = -1 AND {c0} = 1 AND {O0} < {O1} AND {O0} > {C1} AND {C0} > {O1} AND {C0} < {f2} AND " + _NEAR("{b1}", "{b0}", 1))
_pattern("CDLXSIDEGAP3METHODS", up="{c2} = 1 AND {c1} = 1 AND {c0} = -1 AND " + _GAP_UP(1, 2) + " AND {O0} < {C1} AND {O0} > {O1} AND {C0} > {O2} AND {C0} < {C2}", down="{c2} = -1 AND {c1} = -1 AND {c0} = 1 AND " + _GAP_DOWN(1, 2) + " AND {O0} > {C1} AND {O0} < {O1} AND {C0} < {O2} AND {C0} > {C2}")


def _star(name: str, middle: str, up: bool) -> None:
    way, gap = ("-1", _GAP_DOWN(1, 2)) if up else ("1", _GAP_UP(1, 2))

    def make(penetration: float = 0.3) -> Layers:
        last = f"{{c0}} = 1 AND {{C0}} > {{C2}} + {{b2}} * {penetration!r}" if up else f"{{c0}} = -1 AND {{C0}} < {{C2}} - {{b2}} * {penetration!r}"
        text = at(f"{{long2}} AND {{c2}} = {way} AND {middle} AND {gap} AND NOT {{short0}} AND {last}")
        return [*BASE, {"integer": f"CASE WHEN coalesce({text}, false) THEN {100 if up else -100} ELSE 0 END"}]

    PATTERNS[name] = make


_star("CDLMORNINGSTAR", "{short1}", True)
_star("CDLMORNINGDOJISTAR", "{doji1}", True)
_star("CDLEVENINGSTAR", "{short1}", False)
_star("CDLEVENINGDOJISTAR", "{doji1}", False)


def _abandoned(penetration: float = 0.3) -> Layers:
    text = "{long2} AND {doji1} AND NOT {short0} AND "
    up = at(text + f"{{c2}} = -1 AND {{c0}} = 1 AND {{C0}} > {{C2}} + {{b2}} * {penetration!r} AND {{H1}} < {{L2}} AND {{L0}} > {{H1}}")
    down = at(text + f"{{c2}} = 1 AND {{c0}} = -1 AND {{C0}} < {{C2}} - {{b2}} * {penetration!r} AND {{L1}} > {{H2}} AND {{H0}} < {{L1}}")
    return [*BASE, {"integer": f"CASE WHEN coalesce({up}, false) THEN 100 WHEN coalesce({down}, false) THEN -100 ELSE 0 END"}]


PATTERNS["CDLABANDONEDBABY"] = _abandoned
# four and five candles
_pattern("CDL3LINESTRIKE", up="{c3} = 1 AND {c2} = 1 AND {c1} = 1 AND {c0} = -1 AND {C1} > {C2} AND {C2} > {C3} AND {O0} > {C1} AND {C0} < {O3} AND {O2} >= {f3} - {near3} AND {O2} <= {t3} + {near3} AND {O1} >= {f2} - {near2} AND {O1} <= {t2} + {near2}", down="{c3} = -1 AND {c2} = -1 AND {c1} = -1 AND {c0} = 1 AND {C1} < {C2} AND {C2} < {C3} AND {O0} < {C1} AND {C0} > {O3} AND {O2} >= {f3} - {near3} AND {O2} <= {t3} + {near3} AND {O1} >= {f2} - {near2} AND {O1} <= {t2} + {near2}")
_pattern("CDLCONCEALBABYSWALL", up="{c3} = -1 AND {c2} = -1 AND {c1} = -1 AND {c0} = -1 AND {lvs3} AND {uvs3} AND {lvs2} AND {uvs2} AND " + _GAP_DOWN(1, 2) + " AND NOT {uvs1} AND {H1} > {C2} AND {H0} > {H1} AND {L0} < {L1}")
_pattern("CDLLADDERBOTTOM", up="{c4} = -1 AND {c3} = -1 AND {c2} = -1 AND {O4} > {O3} AND {O3} > {O2} AND {C4} > {C3} AND {C3} > {C2} AND {c1} = -1 AND NOT {uvs1} AND {c0} = 1 AND {O0} > {O1} AND {C0} > {H1}")
_pattern("CDLBREAKAWAY", up="{long4} AND {c4} = -1 AND {c3} = -1 AND " + _GAP_DOWN(3, 4) + " AND {H2} < {H3} AND {L2} < {L3} AND {H1} < {H2} AND {L1} < {L2} AND {c1} = -1 AND {c0} = 1 AND {C0} > {O3} AND {C0} < {C4}", down="{long4} AND {c4} = 1 AND {c3} = 1 AND " + _GAP_UP(3, 4) + " AND {H2} > {H3} AND {L2} > {L3} AND {H1} > {H2} AND {L1} > {L2} AND {c1} = 1 AND {c0} = -1 AND {C0} < {O3} AND {C0} > {C4}")
_IN = lambda a, b: f"{{H{a}}} < {{H{b}}} AND {{L{a}}} > {{L{b}}}"
_pattern("CDLHIKKAKE", up=_IN(1, 2) + " AND {H0} < {H1} AND {L0} < {L1}", down=_IN(1, 2) + " AND {H0} > {H1} AND {L0} > {L1}")
_pattern("CDLHIKKAKEMOD", up=_IN(2, 3) + " AND " + _IN(1, 2) + " AND {H0} < {H1} AND {L0} < {L1} AND {C2} <= {L2} + {near2}", down=_IN(2, 3) + " AND " + _IN(1, 2) + " AND {H0} > {H1} AND {L0} > {L1} AND {C2} >= {H2} - {near2}")
_INNER = " AND ".join(f"{{short{k}}} AND {{f{k}}} < {{H4}} AND {{t{k}}} > {{L4}}" for k in (1, 2, 3))
_pattern("CDLRISEFALL3METHODS", up="{long4} AND {long0} AND {c4} = 1 AND {c3} = -1 AND {c2} = -1 AND {c1} = -1 AND {c0} = 1 AND " + _INNER + " AND {C2} < {C3} AND {C1} < {C2} AND {O0} > {C1} AND {C0} > {C4}", down="{long4} AND {long0} AND {c4} = -1 AND {c3} = 1 AND {c2} = 1 AND {c1} = 1 AND {c0} = -1 AND " + _INNER + " AND {C2} > {C3} AND {C1} > {C2} AND {O0} < {C1} AND {C0} < {C4}")


def _mat_hold(penetration: float = 0.5) -> Layers:
    low = f"{{C4}} - {{b4}} * {penetration!r}"
    text = at("{long4} AND {short3} AND {short2} AND {short1} AND {c4} = 1 AND {c3} = -1 AND {c0} = 1 AND " + _GAP_UP(3, 4) + f" AND {{f2}} < {{C4}} AND {{f1}} < {{C4}} AND {{f2}} > {low} AND {{f1}} > {low} AND {{t2}} < {{O3}} AND {{t1}} < {{t2}} AND {{O0}} > {{C1}} AND {{C0}} > greatest({{H3}}, {{H2}}, {{H1}})")
    return [*BASE, {"integer": f"CASE WHEN coalesce({text}, false) THEN 100 ELSE 0 END"}]


PATTERNS["CDLMATHOLD"] = _mat_hold
