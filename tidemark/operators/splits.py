"""Splits of ordered rows for models, without looking ahead; rows carry a scheme, a fold and a partition."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.frames import ORDER, ratio

#: Roles of partitions.
ROLES = {"train": "fit", "validation": "evaluate", "test": "holdout", "excluded": "excluded"}


def numbered(df: DataFrame, order=ORDER) -> DataFrame:
    """`df` with __n (from 0) and __total in time order. Times are numbered, not rows: rows of one time stay together. Only the
    different times are sorted in one place."""
    times = df.select(*order).distinct()
    n = times.withColumn("__n", F.row_number().over(Window.orderBy(*order)) - 1)
    total = times.agg(F.count(F.lit(1)).alias("__total"))
    return df.join(n, list(order)).crossJoin(F.broadcast(total))


def temporal_split(df: DataFrame, train_end=None, validation_end=None, test_end=None, sizes: dict[str, float | int] | None = None, scheme: str = "default", order=ORDER) -> DataFrame:
    """`df` with scheme, fold 0 and partition: by inclusive bounds, or by sizes in order (counts, or shares whose running
    sums are rounded down; the last takes the rest)."""
    t = F.col(order[0])
    if sizes is None:
        part = F.when(t <= F.lit(train_end), "train")
        if validation_end is not None:
            part = part.when(t <= F.lit(validation_end), "validation")
        part = part.when(t <= F.lit(test_end), "test") if test_end is not None else part.otherwise("test")
        return df.withColumns({"scheme": F.lit(scheme), "fold": F.lit(0), "partition": F.coalesce(part, F.lit("excluded"))})
    rows, names, edge, part = numbered(df, order), list(sizes), 0.0, None
    for name in names[:-1]:
        edge += sizes[name]
        limit = F.lit(int(edge)) if isinstance(sizes[name], int) else F.floor(F.lit(edge) * F.col("__total"))
        part = F.when(F.col("__n") < limit, name) if part is None else part.when(F.col("__n") < limit, name)
    return rows.withColumns({"scheme": F.lit(scheme), "fold": F.lit(0), "partition": part.otherwise(names[-1])}).drop("__n", "__total")


def walk_forward(df: DataFrame, n_splits: int = 5, max_train_size: int | None = None, test_size: int | None = None, gap: int = 0, scheme: str = "walk_forward", order=ORDER) -> DataFrame:
    """`df` once for each fold: the last n_splits blocks of test_size times are tested in turn, all times before less the gap (or the
    last max_train_size of them) train, the others are excluded."""
    rows = numbered(df, order).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    size = F.lit(test_size) if test_size else F.floor(F.col("__total") / (n_splits + 1))
    start = F.col("__total") - (n_splits - F.col("fold")) * size
    stop = start - gap
    begin = F.greatest(F.lit(0), stop - max_train_size) if max_train_size else F.lit(0)
    n = F.col("__n")
    part = F.when((n >= start) & (n < start + size), "test").when((n >= begin) & (n < stop), "train").otherwise("excluded")
    return rows.withColumns({"scheme": F.lit(scheme), "partition": part}).drop("__n", "__total")


def purged_walk_forward(df: DataFrame, label_end: str = "label_end", n_splits: int = 5, embargo: int | str = 0, scheme: str = "purged_walk_forward", order=ORDER, **options) -> DataFrame:
    """walk_forward() whose training rows end before the test: labels that reach it are excluded, then the last `embargo` times
    that are left, or those within an interval ('3 days') of it."""
    t = order[0]
    rows = walk_forward(df, n_splits, scheme=scheme, order=order, **options)
    bounds = rows.where("partition = 'test'").groupBy("fold").agg(F.min(t).alias("__start"))
    rows = rows.join(F.broadcast(bounds), "fold", "left")
    train = (F.col("partition") == "train") & ~(F.col(label_end) >= F.col("__start"))
    rows = rows.withColumn("partition", F.when((F.col("partition") == "train") & ~train, "excluded").otherwise(F.col("partition")))
    if isinstance(embargo, str):
        late = F.col(t) > F.col("__start") - F.expr(f"interval {embargo}")
        rows = rows.withColumn("partition", F.when((F.col("partition") == "train") & late, "excluded").otherwise(F.col("partition")))
    elif embargo:
        left = rows.where("partition = 'train'").select("fold", t).distinct()
        last = left.withColumn("__k", F.row_number().over(Window.partitionBy("fold").orderBy(F.desc(t)))).where(F.col("__k") <= embargo).select("fold", t, F.lit(True).alias("__late"))
        rows = rows.join(last, ["fold", t], "left").withColumn("partition", F.when((F.col("partition") == "train") & F.col("__late"), "excluded").otherwise(F.col("partition"))).drop("__late")
    return rows.drop("__start")


def split_diagnostics(df: DataFrame, order=ORDER) -> DataFrame:
    """(scheme, fold, partition, role, rows, proportion, start, end)."""
    role = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))
    sums = df.groupBy("scheme", "fold", "partition").agg(F.count(F.lit(1)).alias("rows"), F.min(order[0]).alias("start"), F.max(order[0]).alias("end"))
    total = F.sum("rows").over(Window.partitionBy("scheme", "fold"))
    return sums.select("scheme", "fold", "partition", role[F.col("partition")].alias("role"), "rows", ratio("rows", total).alias("proportion"), "start", "end")


def audit_splits(df: DataFrame, label_end: str | None = "label_end", order=ORDER) -> DataFrame:
    """(scheme, fold, fit_rows, evaluation_rows, temporally_ordered, label_horizons_clear, passed)."""
    fit, ev = F.col("partition") == "train", F.col("partition").isin("validation", "test")
    t = order[0]
    sums = df.groupBy("scheme", "fold").agg(
        F.sum(fit.cast("long")).alias("fit_rows"), F.sum(ev.cast("long")).alias("evaluation_rows"), F.max(F.when(fit, F.col(t))).alias("a"), F.min(F.when(ev, F.col(t))).alias("b"),
        *([F.max(F.when(fit, F.col(label_end))).alias("c")] if label_end else []),
    )
    first = F.coalesce(F.col("a") < F.col("b"), F.lit(False))
    clear = F.coalesce(F.col("c") < F.col("b"), F.lit(True)) if label_end else F.lit(True)
    return sums.select("scheme", "fold", "fit_rows", "evaluation_rows", first.alias("temporally_ordered"), clear.alias("label_horizons_clear"), (first & clear).alias("passed"))


def timeseries_bounds(n: int, n_splits: int = 5, max_train_size: int | None = None, test_size: int | None = None, gap: int = 0) -> list[tuple[range, range]]:
    """(training, test) positions of each fold."""
    size = test_size or n // (n_splits + 1)
    if n - size * n_splits - gap <= 0:
        raise ValueError("too few rows for the folds")
    out = []
    for k in range(n_splits):
        start = n - (n_splits - k) * size
        stop = start - gap
        out.append((range(max(0, stop - max_train_size) if max_train_size else 0, stop), range(start, start + size)))
    return out


@dataclass
class Dataset:
    """Features, target, weight and metadata of the same keys, as one wide frame with a role for each column."""

    frame: DataFrame
    key: tuple[str, ...]
    roles: dict[str, list[str]]
    splits: dict[str, DataFrame] = field(default_factory=dict)

    @classmethod
    def of(cls, key: tuple[str, ...], **parts: DataFrame) -> "Dataset":
        """Joins parts (x=, y=, sample_weight=, metadata=) whose keys are unique and the same; otherwise an error."""
        frame, roles = None, {}
        for role, part in parts.items():
            if part.count() != part.select(*key).distinct().count():
                raise ValueError(f"keys of {role} repeat")
            roles[role] = [c for c in part.columns if c not in key]
            if frame is None:
                frame = part
                continue
            if not part.join(frame, list(key), "left_anti").isEmpty() or not frame.join(part, list(key), "left_anti").isEmpty():
                raise ValueError(f"keys of {role} differ")
            frame = frame.join(part, list(key))
        return cls(frame, tuple(key), roles)

    def with_split(self, scheme: str, assigned: DataFrame) -> "Dataset":
        return Dataset(self.frame, self.key, self.roles, self.splits | {scheme: assigned.select(*self.key, "fold", "partition")})

    def partition(self, name: str, scheme: str = "default", fold: int = 0) -> DataFrame:
        at = self.splits[scheme].where((F.col("fold") == fold) & (F.col("partition") == name)).select(*self.key)
        return self.frame.join(at, list(self.key), "left_semi")

    def fold(self, scheme: str, fold: int = 0) -> dict[str, DataFrame]:
        return {p: self.partition(p, scheme, fold) for p in ("train", "validation", "test")}

    def select(self, *components: str, start=None, end=None) -> DataFrame:
        rows = self.frame.select(*self.key, *(c for r in components or self.roles for c in self.roles[r]))
        if start is not None:
            rows = rows.where(F.col(self.key[-1]) >= F.lit(start))
        return rows.where(F.col(self.key[-1]) <= F.lit(end)) if end is not None else rows

    def save(self, path: str) -> None:
        spark = self.frame.sparkSession
        self.frame.write.mode("overwrite").parquet(f"{path}/frame")
        for k, s in self.splits.items():
            s.write.mode("overwrite").parquet(f"{path}/splits/{k}")
        rows = [("key", None, c) for c in self.key] + [("role", r, c) for r, cs in self.roles.items() for c in cs] + [("split", None, k) for k in self.splits]
        spark.createDataFrame(rows, "kind string, role string, name string").coalesce(1).write.mode("overwrite").json(f"{path}/about")

    @classmethod
    def load(cls, spark, path: str) -> "Dataset":
        about = spark.read.schema("kind string, role string, name string").json(f"{path}/about").collect()
        roles: dict[str, list[str]] = {}
        for r in about:
            if r.kind == "role":
                roles.setdefault(r.role, []).append(r.name)
        splits = {r.name: spark.read.parquet(f"{path}/splits/{r.name}") for r in about if r.kind == "split"}
        return cls(spark.read.parquet(f"{path}/frame"), tuple(r.name for r in about if r.kind == "key"), roles, splits)


def fit_transform(df: DataFrame, stages: list, partition: str = "partition"):
    """(transformed, model): a pipeline of pyspark.ml stages fitted on training rows alone and applied to all."""
    from pyspark.ml import Pipeline

    model = Pipeline(stages=stages).fit(df.where(F.col(partition) == "train"))
    return model.transform(df), model


def standardized(df: DataFrame, columns: list[str], partition: str = "partition", by: tuple[str, ...] = ("scheme", "fold")) -> DataFrame:
    """Columns less their training mean, over their training deviation (0 becomes 1)."""
    train = F.col(partition) == "train"
    w = Window.partitionBy(*by)
    out = {}
    for c in columns:
        v = F.when(train, F.col(c))
        sd = F.stddev_pop(v).over(w)
        out[c] = (F.col(c) - F.avg(v).over(w)) / F.when(sd > 0, sd).otherwise(1.0)
    return df.withColumns(out)


def sizes_of(total: int, shares: dict[str, float]) -> dict[str, int]:
    """Counts of shares: running sums rounded down, the last takes the rest."""
    out, edge, used = {}, 0.0, 0
    for i, (k, s) in enumerate(shares.items()):
        edge += s
        out[k] = total - used if i == len(shares) - 1 else math.floor(edge * total) - used
        used += out[k]
    return out
