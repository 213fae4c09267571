"""Expressions as SQL text that Spark and DuckDB both read, in layers; Spark runs them as columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

Layers = Sequence[dict[str, str]]


def to_duck(sql: str) -> str:
    """The same expression in DuckDB's words."""
    sql = re.sub(r"\bpercentile\(", "quantile_cont(", sql)
    return re.sub(r"\bdatediff\(([^,()]+), ([^,()]+)\)", r"date_diff('day', \2, \1)", sql)


def doubles(sql: str) -> str:
    """Decimal literals as doubles, which both engines take 1e0 for."""
    return re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", sql)


def layered(df: DataFrame, layers: Layers) -> DataFrame:
    """Each layer's columns may use those of the layers before."""
    for layer in layers:
        df = df.withColumns({k: F.expr(v) for k, v in layer.items()})
    return df


def duck_layers(source: str, layers: Layers) -> str:
    """`source` (a SELECT) under the same layers."""
    sql = source
    for layer in layers:
        made = ", ".join(f"{to_duck(v)} AS {k}" for k, v in layer.items())
        sql = f"SELECT *, {made} FROM ({sql}) AS t"
    return sql


class Over:
    """Window clauses and guarded aggregates, as text."""

    def __init__(self, by: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts",)):
        self.by, self.order = ", ".join(by), ", ".join(order)

    def w(self, n: int) -> str:
        return f"OVER (PARTITION BY {self.by} ORDER BY {self.order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"

    def between(self, a: int, b: int) -> str:
        side = lambda k: "CURRENT ROW" if k == 0 else f"{abs(k)} {'PRECEDING' if k < 0 else 'FOLLOWING'}"
        return f"OVER (PARTITION BY {self.by} ORDER BY {self.order} ROWS BETWEEN {side(a)} AND {side(b)})"

    @property
    def at(self) -> str:
        return f"OVER (PARTITION BY {self.by} ORDER BY {self.order})"

    @property
    def run(self) -> str:
        return f"OVER (PARTITION BY {self.by} ORDER BY {self.order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

    @property
    def all(self) -> str:
        return f"OVER (PARTITION BY {self.by})"

    def lag(self, x: str, k: int = 1) -> str:
        return f"lag({x}, {k}) {self.at}" if k >= 0 else f"lead({x}, {-k}) {self.at}"

    def full(self, agg: str, x: str, n: int, least: int | None = None) -> str:
        return f"CASE WHEN count({x}) {self.w(n)} >= {least or n} THEN {agg} {self.w(n)} END"

    def mean(self, x: str, n: int) -> str:
        return self.full(f"avg({x})", x, n)

    def sum(self, x: str, n: int) -> str:
        return self.full(f"sum({x})", x, n)

    def max(self, x: str, n: int) -> str:
        return self.full(f"max({x})", x, n)

    def min(self, x: str, n: int) -> str:
        return self.full(f"min({x})", x, n)

    def std(self, x: str, n: int, ddof: int = 1) -> str:
        return self.full(f"{'stddev_samp' if ddof else 'stddev_pop'}({x})", x, n)

    def weighted(self, x: str, weights: Sequence[float]) -> str:
        """Sum of weights[k] * x k rows ago."""
        return "(" + " + ".join(f"{w!r} * {self.lag(x, k) if k else x}" for k, w in enumerate(weights)) + ")"
