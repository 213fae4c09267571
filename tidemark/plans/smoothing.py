"""SQL for indicators made of smoothed means, as a graph of relations (symbol, k, x) that DuckDB evaluates by recursion."""

from __future__ import annotations


class Graph:
    """Collects common table expressions; each method names one and returns the name."""

    def __init__(self, source: str):
        self.parts, self.n = [f"n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM ({source}) AS q)"], 0

    def _put(self, sql: str) -> str:
        self.n += 1
        self.parts.append(f"t{self.n} AS ({sql})")
        return f"t{self.n}"

    def base(self, x: str) -> str:
        """An expression over a bar; pc is the close before it."""
        return self._put(f"SELECT symbol, k, {x} AS x FROM (SELECT *, lag(close) OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl FROM n WINDOW w AS (PARTITION BY symbol ORDER BY k)) AS b")

    def ewm(self, of: str, n: int, alpha: str | None = None) -> str:
        """Exponential mean that starts as the mean of the first n values."""
        a = alpha or f"(2.0::DOUBLE / {n + 1})"
        m = self._put(f"SELECT symbol, k, x, row_number() OVER (PARTITION BY symbol ORDER BY k) AS j FROM {of} WHERE x IS NOT NULL")
        self.n += 1
        e = f"t{self.n}"
        self.parts.append(f"{e} AS (SELECT symbol, j, avg(x) OVER (PARTITION BY symbol ORDER BY j ROWS UNBOUNDED PRECEDING) AS v FROM {m} QUALIFY j = {n} UNION ALL SELECT m.symbol, m.j, e.v + {a} * (m.x - e.v) FROM {e} AS e JOIN {m} AS m ON m.symbol = e.symbol AND m.j = e.j + 1)")
        return self._put(f"SELECT o.symbol, o.k, e.v AS x FROM {of} AS o LEFT JOIN {m} AS m ON m.symbol = o.symbol AND m.k = o.k LEFT JOIN {e} AS e ON e.symbol = m.symbol AND e.j = m.j")

    def rma(self, of: str, n: int) -> str:
        return self.ewm(of, n, f"(1.0::DOUBLE / {n})")

    def summed(self, of: str, n: int) -> str:
        """Wilder's running sum: the first n - 1 values, then each less an n-th of the sum."""
        m = self._put(f"SELECT symbol, k, x, row_number() OVER (PARTITION BY symbol ORDER BY k) AS j FROM {of} WHERE x IS NOT NULL")
        self.n += 1
        e = f"t{self.n}"
        self.parts.append(f"{e} AS (SELECT symbol, j, sum(x) OVER (PARTITION BY symbol ORDER BY j ROWS UNBOUNDED PRECEDING) AS v FROM {m} QUALIFY j = {n - 1} UNION ALL SELECT m.symbol, m.j, e.v - e.v / {n} + m.x FROM {e} AS e JOIN {m} AS m ON m.symbol = e.symbol AND m.j = e.j + 1)")
        return self._put(f"SELECT o.symbol, o.k, e.v AS x FROM {of} AS o LEFT JOIN {m} AS m ON m.symbol = o.symbol AND m.k = o.k LEFT JOIN {e} AS e ON e.symbol = m.symbol AND e.j = m.j AND e.j >= {n}")

    def total(self, of: str) -> str:
        return self._put(f"SELECT symbol, k, sum(x) OVER (PARTITION BY symbol ORDER BY k ROWS UNBOUNDED PRECEDING) AS x FROM {of}")

    def mix(self, x: str, **of: str) -> str:
        """An expression over a.x, b.x, ... of relations at the same row."""
        names = list(of)
        joins = " ".join(f"JOIN {of[b]} AS {b} ON {b}.symbol = {names[0]}.symbol AND {b}.k = {names[0]}.k" for b in names[1:])
        return self._put(f"SELECT {names[0]}.symbol, {names[0]}.k, {x} AS x FROM {of[names[0]]} AS {names[0]} {joins}")

    def win(self, of: str, agg: str, n: int) -> str:
        w = f"OVER (PARTITION BY symbol ORDER BY k ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        return self._put(f"SELECT symbol, k, CASE WHEN count(x) {w} >= {n} THEN {agg} {w} END AS x FROM {of}")

    def lag(self, of: str, k: int = 1) -> str:
        return self._put(f"SELECT symbol, k, lag(x, {k}) OVER (PARTITION BY symbol ORDER BY k) AS x FROM {of}")

    def sql(self, **outputs: str) -> str:
        joins = " ".join(f"LEFT JOIN {t} AS o_{c} ON o_{c}.symbol = n.symbol AND o_{c}.k = n.k" for c, t in outputs.items())
        return f"WITH RECURSIVE {', '.join(self.parts)} SELECT n.symbol, n.ts, {', '.join(f'o_{c}.x AS {c}' for c in outputs)} FROM n {joins}"


TR = "CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END"


def div(a: str, b: str) -> str:
    return f"({a}) / nullif({b}, 0)"


def catalog(source: str) -> dict[str, str]:
    """SQL by the indicator's name."""
    out: dict[str, str] = {}

    def graph() -> Graph:
        return Graph(source)

    def chain(g: Graph, x: str, n: int, times: int) -> list[str]:
        made = [g.base(x)]
        for _ in range(times):
            made.append(g.ewm(made[-1], n))
        return made[1:]

    for name, n in (("DEMA", 30), ("pta_dema", 10)):
        g = graph()
        a, b = chain(g, "close", n, 2)
        out[name] = g.sql(real=g.mix("2 * a.x - b.x", a=a, b=b))
    for name, n in (("TEMA", 30), ("pta_tema", 10)):
        g = graph()
        a, b, c = chain(g, "close", n, 3)
        out[name] = g.sql(real=g.mix("3 * a.x - 3 * b.x + c.x", a=a, b=b, c=c))
    for name, n in (("T3", 5), ("pta_t3", 10)):
        g = graph()
        e = chain(g, "close", n, 6)
        v = 0.7
        out[name] = g.sql(real=g.mix(f"{-(v**3)!r} * f.x + {3 * v**2 + 3 * v**3!r} * e.x + {-6 * v**2 - 3 * v - 3 * v**3!r} * d.x + {1 + 3 * v + v**3 + 3 * v**2!r} * c.x", c=e[2], d=e[3], e=e[4], f=e[5]))

    def trix(g: Graph, n: int) -> str:
        e = chain(g, "close", n, 3)[2]
        return g.mix(f"100 * ({div('a.x', 'b.x')} - 1)", a=e, b=g.lag(e))

    g = graph()
    out["TRIX"] = g.sql(real=trix(g, 30))
    for name in ("pta_trix", "pta_trixh"):
        g = graph()
        t = trix(g, 18)
        s = g.win(t, "avg(x)", 9)
        out[name] = g.sql(trix=t, trixs=s, **({"trixh": g.mix("a.x - b.x", a=t, b=s)} if name[-1] == "h" else {}))
    g = graph()
    c = g.base("close")
    m = g.mix("a.x - b.x", a=g.ewm(c, 12), b=g.ewm(c, 26))
    s = g.ewm(m, 9)
    macd = g.sql(macd=m, macdsignal=s, macdhist=g.mix("a.x - b.x", a=m, b=s))
    for name in ("MACD", "MACDFIX", "pta_macd", "pta_macdfix", "pta_macdext"):
        out[name] = macd
    for name, x in (("pta_ppo", "close"), ("pta_pvo", "volume")):
        g = graph()
        c = g.base(x)
        m = g.mix(f"100 * ({div('a.x', 'b.x')} - 1)", a=g.ewm(c, 12), b=g.ewm(c, 26))
        s = g.ewm(m, 9)
        out[name] = g.sql(ppo=m, ppos=s, ppoh=g.mix("a.x - b.x", a=m, b=s))
    for name in ("NATR", "pta_natr"):
        g = graph()
        out[name] = g.sql(real=g.mix(f"100 * {div('a.x', 'b.x')}", a=g.rma(g.base(TR), 14), b=g.base("close")))
    g = graph()
    out["pta_efi"] = g.sql(real=g.ewm(g.base("(close - pc) * volume"), 13))
    g = graph()
    e = g.ewm(g.base("close"), 13)
    out["pta_eri"] = g.sql(bull=g.mix("h.x - e.x", h=g.base("high"), e=e), bear=g.mix("l.x - e.x", l=g.base("low"), e=e))
    g = graph()
    m, r = g.ewm(g.base("close"), 20), g.ewm(g.base(TR), 20)
    out["pta_kc"] = g.sql(kcl=g.mix("m.x - 2 * r.x", m=m, r=r), kcb=m, kcu=g.mix("m.x + 2 * r.x", m=m, r=r))
    g = graph()
    c = g.base("close")
    out["pta_zlma"] = g.sql(real=g.ewm(g.mix("2 * a.x - b.x", a=c, b=g.lag(c, 4)), 10))
    g = graph()
    c = g.base("close")
    out["pta_mmar"] = g.sql(**{f"mmar_{k}": g.ewm(c, k) for k in range(10, 40, 5)})
    for name, fast, slow, signal in (("pta_tsi", 13, 25, 13), ("pta_smi", 5, 20, 5)):
        g = graph()
        up, size = (g.ewm(g.ewm(g.base(x), slow), fast) for x in ("close - pc", "abs(close - pc)"))
        t = g.mix(f"100 * {div('a.x', 'b.x')}", a=up, b=size)
        s = g.ewm(t, signal)
        out[name] = g.sql(tsi=t, tsis=s) if name == "pta_tsi" else g.sql(smi=t, smis=s, smio=g.mix("a.x - b.x", a=t, b=s))
    g = graph()
    t = g.base("greatest(abs(high - ph), abs(pl - low))")
    t = g.mix("a.x", a=g._put(f"SELECT symbol, k, CASE WHEN k > 1 THEN x END AS x FROM {t}"))
    out["pta_thermo"] = g.sql(thermo=t, mean=g.ewm(t, 20))
    g = graph()
    c = g.base("close")
    out["pta_pgo"] = g.sql(real=g.mix(div("a.x - b.x", "r.x"), a=c, b=g.win(c, "avg(x)", 14), r=g.ewm(g.base(TR), 14)))
    g = graph()
    e = g.ewm(g.base("high - low"), 9)
    out["pta_massi"] = g.sql(real=g.win(g.mix(div("a.x", "b.x"), a=e, b=g.ewm(e, 9)), "sum(x)", 25))
    g = graph()
    e = g.ewm(g.base("high - low"), 10)
    out["pta_cvi"] = g.sql(real=g.mix(f"100 * ({div('a.x', 'b.x')} - 1)", a=e, b=g.lag(e, 10)))
    g = graph()
    z, a = g.win(g.base("(high + low + close) / 3"), "avg(x)", 5), g.rma(g.base(TR), 15)
    out["pta_aberration"] = g.sql(zg=z, sg=g.mix("z.x + a.x", z=z, a=a), xg=g.mix("z.x - a.x", z=z, a=a), atr=a)
    g = graph()
    plus, minus = "CASE WHEN ph IS NOT NULL THEN CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END END", "CASE WHEN ph IS NOT NULL THEN CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END END"
    out["pta_dm"] = g.sql(dmp=g.rma(g.base(plus), 14), dmn=g.rma(g.base(minus), 14))
    g = graph()
    h, low, a = g.win(g.base("high"), "max(x)", 22), g.win(g.base("low"), "min(x)", 22), g.rma(g.base(TR), 22)
    out["pta_ce"] = g.sql(long_stop=g.mix("h.x - 3 * a.x", h=h, a=a), short_stop=g.mix("l.x + 3 * a.x", l=low, a=a))
    g = graph()
    a = g.rma(g.base(TR), 10)
    up = g.win(g.mix("h.x - a.x", h=g.win(g.base("high"), "max(x)", 10), a=a), "max(x)", 9)
    down = g.win(g.mix("l.x + a.x", l=g.win(g.base("low"), "min(x)", 10), a=a), "min(x)", 9)
    out["pta_cksp"] = g.sql(long_stop=up, short_stop=down)
    g = graph()
    f = g.mix(f"100 * {div('c.x - l.x', 'h.x - l.x')}", c=g.base("close"), l=g.win(g.base("low"), "min(x)", 9), h=g.win(g.base("high"), "max(x)", 9))
    k = g.rma(f, 3)
    d = g.rma(k, 3)
    out["pta_kdj"] = g.sql(k_=k, d=d, j=g.mix("3 * k.x - 2 * d.x", k=k, d=d)).replace("AS k_,", "AS k,")
    g = graph()
    m = g.base("(high + low) / 2")
    out["pta_dsp"] = g.sql(real=g.mix("a.x - b.x", a=g.ewm(m, 3), b=g.ewm(m, 7)))
    g = graph()
    t = g.base("(high + low + close) / 3")
    v = g.mix("sign(a.x - b.x) * v.x", a=t, b=g.lag(t), v=g.base("volume"))
    q = g.mix("a.x - b.x", a=g.ewm(v, 34), b=g.ewm(v, 55))
    out["pta_kvo"] = g.sql(kvo=q, kvos=g.ewm(q, 13))
    for name, n, k, d in (("STOCHRSI", 14, 5, 3),):
        g = graph()
        up, down = (g.rma(g.base(f"CASE WHEN pc IS NOT NULL THEN greatest({x}, 0) END"), n) for x in ("close - pc", "pc - close"))
        r = g.mix(f"100 * {div('u.x', 'u.x + d.x')}", u=up, d=down)
        f = g.mix(f"100 * {div('r.x - l.x', 'h.x - l.x')}", r=r, l=g.win(r, "min(x)", k), h=g.win(r, "max(x)", k))
        out[name] = g.sql(fastk=f, fastd=g.win(f, "avg(x)", d))
    for name in ("PLUS_DM", "MINUS_DM", "pta_plus_dm", "pta_minus_dm"):
        g = graph()
        out[name] = g.sql(real=g.summed(g.base(plus if "plus" in name.lower() else minus), 14))

    def directions(g: Graph) -> tuple[str, str, str]:
        tr = g.summed(g.base(TR), 14)
        p, m = (g.mix(f"100 * {div('a.x', 'b.x')}", a=g.summed(g.base(x), 14), b=tr) for x in (plus, minus))
        return p, m, g.mix(f"100 * {div('abs(a.x - b.x)', 'a.x + b.x')}", a=p, b=m)

    for name in ("PLUS_DI", "MINUS_DI", "DX", "ADX", "ADXR", "pta_dx", "pta_adxr", "pta_adx"):
        g = graph()
        p, m, d = directions(g)
        if name == "pta_adx":
            out[name] = g.sql(adx=g.rma(d, 14), dmp=p, dmn=m)
            continue
        a = {"PLUS_DI": lambda: p, "MINUS_DI": lambda: m, "DX": lambda: d, "PTA_DX": lambda: d}.get(name.upper(), lambda: g.rma(d, 14))()
        out[name] = g.sql(real=g.mix("(a.x + b.x) / 2", a=a, b=g.lag(a, 13)) if name.upper().endswith("ADXR") else a)
    for name in ("ADOSC", "pta_adosc"):
        g = graph()
        t = g.total(g.base("coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0) * volume"))
        out[name] = g.sql(real=g.mix("a.x - b.x", a=g.ewm(t, 1, "0.5::DOUBLE"), b=g.ewm(t, 1, "(2.0::DOUBLE / 11)")))
    g = graph()
    t = g.total(g.base("CASE WHEN pc IS NULL THEN volume ELSE sign(close - pc) * volume END"))
    out["pta_aobv"] = g.sql(obv=t, obv_fast=g.ewm(t, 4), obv_slow=g.ewm(t, 12))
    for name, widths in (("pta_squeeze", (1.5,)), ("pta_squeeze_pro", (2.0, 1.5, 1.0))):
        g = graph()
        c = g.base("close")
        mean, sd, r = g.win(c, "avg(x)", 20), g.win(c, "stddev_pop(x)", 20), g.win(g.base(TR), "avg(x)", 20)
        z = g.win(g.mix("a.x - b.x", a=c, b=g.lag(c, 12)), "avg(x)", 6)
        test = lambda op, w: g.mix(f"CASE WHEN 2 * s.x {op} {w!r} * r.x THEN 1.0 ELSE 0.0 END", s=sd, r=r)
        if name == "pta_squeeze":
            out[name] = g.sql(sqz=z, squeeze_on=test("<", 1.5), squeeze_off=test(">", 1.5))
        else:
            out[name] = g.sql(sqz=z, wide=test("<", 2.0), normal=test("<", 1.5), narrow=test("<", 1.0))
    g = graph()
    c = g.base("close")
    sd, d = g.win(c, "stddev_samp(x)", 14), g.base("close - pc")
    up, down = (g.ewm(g.mix(f"CASE WHEN s.x IS NOT NULL THEN CASE WHEN d.x {op} 0 THEN s.x ELSE 0 END END", s=sd, d=d), 14) for op in (">", "<"))
    out["pta_rvi"] = g.sql(real=g.mix(f"100 * {div('a.x', 'a.x + b.x')}", a=up, b=down))
    return out
