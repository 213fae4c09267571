"""Tables of runs: experiments and what they logged, and resumable maps over keyed rows."""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .market import exists

RUNS = "run_id string, name string, status string, started_at timestamp, ended_at timestamp, tags string"
VALUES = "run_id string, kind string, key string, value string, step long, logged_at timestamp"
ARTIFACTS = "run_id string, name string, path string, logged_at timestamp"


class LocalTracker:
    """Append-only parquet tables of runs, values and artifacts under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _append(self, table: str, rows: list[tuple], schema: str) -> None:
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.path}/{table}")

    def _read(self, table: str, schema: str) -> DataFrame:
        path = f"{self.path}/{table}"
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def runs(self) -> DataFrame:
        """The latest state of each run."""
        rows = self._read("runs", RUNS)
        w = Window.partitionBy("run_id").orderBy(F.col("ended_at").desc_nulls_last())
        return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")

    def values(self, run_id: str | None = None) -> DataFrame:
        rows = self._read("values", VALUES)
        return rows.where(F.col("run_id") == run_id) if run_id else rows

    def artifacts(self) -> DataFrame:
        return self._read("artifacts", ARTIFACTS)

    def run(self, name: str, tags: dict | None = None) -> "Run":
        return Run(self, name, tags or {})


class Run:
    """One run, as a context: it starts on entry and ends as finished or failed."""

    def __init__(self, tracker: LocalTracker, name: str, tags: dict):
        self.tracker, self.name, self.tags, self.id, self.held = tracker, name, tags, uuid.uuid4().hex, []

    def __enter__(self) -> "Run":
        self.started = datetime.datetime.now()
        self._state("running", None)
        _ACTIVE.append(self)
        return self

    def _state(self, status: str, ended) -> None:
        self.tracker._append("runs", [(self.id, self.name, status, self.started, ended, json.dumps(self.tags, sort_keys=True))], RUNS)

    def _log(self, kind: str, values: dict, step: int | None) -> None:
        now = datetime.datetime.now()
        self.held += [(self.id, kind, k, json.dumps(v, sort_keys=True), step, now) for k, v in values.items()]

    def params(self, **values) -> None:
        self._log("param", values, None)

    def metrics(self, step: int | None = None, **values: float) -> None:
        self._log("metric", values, step)

    def artifact(self, name: str, df: DataFrame) -> str:
        path = f"{self.tracker.path}/files/{self.id}/{name}"
        df.write.parquet(path)
        self.tracker._append("artifacts", [(self.id, name, path, datetime.datetime.now())], ARTIFACTS)
        return path

    def __exit__(self, kind, *_) -> None:
        _ACTIVE.remove(self)
        if self.held:
            self.tracker._append("values", self.held, VALUES)
        self._state("failed" if kind else "finished", datetime.datetime.now())


def extract(df: DataFrame, work: Callable[[str], str], key: str = "id", text: str = "text", done: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(key, output) and (key, error) of work(text) for the rows whose key is not among those done; done ones pass through.
    Repeated keys are an error. Persist both before using them: each reads the same pass."""
    if df.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError("keys repeat")
    todo = df.join(done.select(key), key, "left_anti") if done is not None else df
    kind = df.schema[key].dataType.simpleString()

    def run(frames):
        for f in frames:
            made = []
            for k, t in zip(f[key], f[text]):
                try:
                    made.append((k, work(t), None))
                except Exception as e:  # a row's failure is its result
                    made.append((k, None, f"{type(e).__name__}: {e}"))
            yield type(f)(made, columns=[key, "output", "error"])

    rows = todo.select(key, text).mapInPandas(run, f"`{key}` {kind}, output string, error string")
    good = rows.where("error is null").select(key, "output")
    return (good.unionByName(done.select(key, "output")) if done is not None else good), rows.where("error is not null").select(key, "error")


def render(template: str, df: DataFrame, variables: list[str]) -> DataFrame:
    """`df` with prompt, the template with {variables} filled in, and its prompt_hash; a variable that the template lacks,
    or has beyond these, is an error."""
    import string

    used = [f for _, f, _, _ in string.Formatter().parse(template) if f is not None]
    if set(used) != set(variables):
        raise ValueError(f"the template has {sorted(set(used))}")
    parts = []
    for literal, name, _, _ in string.Formatter().parse(template):
        parts.append(F.lit(literal))
        if name is not None:
            parts.append(F.col(name).cast("string"))
    prompt = F.concat(*parts)
    return df.withColumn("prompt", prompt).withColumn("prompt_hash", F.sha2(prompt, 256))


_ACTIVE: list[Run] = []


def active_run() -> Run | None:
    """The innermost run that has begun and not ended."""
    return _ACTIVE[-1] if _ACTIVE else None


def run(spark: SparkSession, name: str, path: str, tags: dict | None = None) -> Run:
    return LocalTracker(spark, path).run(name, tags)


def parsed(df: DataFrame, schema: str, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows whose text is JSON of the schema, with its fields as `value`; the others)."""
    bad = "__corrupt"
    made = F.from_json(text, f"{schema}, {bad} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad})
    rows = df.withColumn("value", made)
    wrong = F.col("value").isNull() | F.col(f"value.{bad}").isNotNull()
    return rows.where(~wrong).withColumn("value", F.col("value").dropFields(bad)), rows.where(wrong).drop("value")


def latest(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key: an append-only table read as one that is updated."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(F.col(order).desc()))).where("__n = 1").drop("__n")


class ToolRegistry:
    """Functions that may be called from SQL, and no others."""

    def __init__(self, spark: SparkSession):
        self.spark, self.names = spark, []

    def add(self, name: str, work: Callable, returns: str = "string") -> None:
        if name in self.names:
            raise ValueError(f"there is a tool {name}")
        self.spark.udf.register(name, work, returns)
        self.names.append(name)

    def call(self, df: DataFrame, name: str, *columns: str, out: str = "result") -> DataFrame:
        if name not in self.names:
            raise KeyError(name)
        return df.withColumn(out, F.call_udf(name, *(F.col(c) for c in columns)))


def truncated(df: DataFrame, ids: str = "ids", most: int = 512) -> DataFrame:
    return df.withColumn(ids, F.slice(ids, 1, most))
