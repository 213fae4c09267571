"""Window frames and guarded aggregates over ordered groups."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

BY, ORDER = ("symbol",), ("ts",)


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ordered(by: Sequence[str] = BY, order: Sequence[str] = ORDER):
    return Window.partitionBy(*by).orderBy(*order)


def rolling(n: int, by: Sequence[str] = BY, order: Sequence[str] = ORDER):
    """The current row and the n - 1 before it."""
    return ordered(by, order).rowsBetween(1 - n, 0)


def running(by: Sequence[str] = BY, order: Sequence[str] = ORDER):
    return ordered(by, order).rowsBetween(Window.unboundedPreceding, 0)


def whole(by: Sequence[str] = BY):
    return Window.partitionBy(*by)


def full(value: Column, x: str | Column, w, n: int) -> Column:
    """`value` where the frame holds n values of x that are not null."""
    return F.when(F.count(col(x)).over(w) >= n, value)


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def spread(x: str | Column, w, ddof: int = 1) -> Column:
    """Standard deviation with any ddof."""
    if ddof == 1:
        return F.stddev_samp(col(x)).over(w)
    n = F.count(col(x)).over(w)
    return F.when(n > ddof, F.sqrt(F.var_pop(col(x)).over(w) * n / (n - ddof)))


def by_group(df: DataFrame, work: Callable, schema: str, by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> DataFrame:
    """work(pandas frame in order) for each group: for definitions that carry a state from row to row. A group is in one
    task, so groups are to be series of one instrument."""

    def run(frame):
        return work(frame.sort_values(list(order), kind="stable").reset_index(drop=True))

    return df.groupBy(*by).applyInPandas(run, schema)


def with_states(df: DataFrame, work: Callable, outputs: dict[str, str], by: Sequence[str] = BY, order: Sequence[str] = ORDER) -> DataFrame:
    """`df` with the columns of `outputs` (name: type); work(frame in order) gives a mapping of arrays."""
    keep = [c for c in df.columns if c not in outputs]
    fields = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [f"`{c}` {t}" for c, t in outputs.items()]

    def run(frame):
        made = {k: pd.Series(v, index=frame.index) for k, v in work(frame).items()}
        return frame.assign(**{k: v.astype(object).where(v.notna(), None) for k, v in made.items()})

    return by_group(df.select(*keep), run, ", ".join(fields), by, order)
