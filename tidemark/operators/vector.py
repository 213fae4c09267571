"""Vectors with a time of publication: nearest neighbours as of a date, and the text around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2))), F.lit(0.0), lambda s, x: s + x)


def search(index: DataFrame, query: list[float], as_of: str | None = None, where: dict[str, str] | None = None, limit: int = 10, vector: str = "vector", key: str = "id", published: str = "published_at", metadata: str = "metadata_json", metric: str = "l2") -> DataFrame:
    """The `limit` records nearest to the query that were published by `as_of`, with their distance; `where` is
    looked up in their metadata afterwards, so that fewer may be left."""
    q = F.array(*(F.lit(float(x)) for x in query))
    near = index.where(F.col(published).cast("string") <= as_of) if as_of else index
    distance = (squared_distance if metric == "l2" else cosine_distance)(F.col(vector), q)
    top = near.withColumn("distance", distance).orderBy("distance", key).limit(limit)
    for k, v in (where or {}).items():
        top = top.where(F.get_json_object(metadata, f"$.{k}") == v)
    return top


def records(df: DataFrame, key: str = "id", text: str = "text", vector: str = "vector", metadata: tuple[str, ...] = ()) -> DataFrame:
    """Rows for an index: key, text, vector, published_at, ingested_at and the rest as JSON."""
    made = F.to_json(F.struct(*metadata)) if metadata else F.lit("{}")
    return df.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text"), F.col(vector).cast("array<float>").alias("vector"), F.col("published_at").cast("string"), F.col("ingested_at").cast("string"), made.alias("metadata_json"))


def add(index: DataFrame | None, rows: DataFrame, mode: str = "append") -> DataFrame:
    return rows if index is None or mode == "overwrite" else index.unionByName(rows)


def delete(index: DataFrame, keys: list[str], key: str = "id") -> DataFrame:
    return index.where(~F.col(key).isin(keys))


def chunked(df: DataFrame, source: str = "source_id", text: str = "text", size: int = 512, overlap: int = 64) -> DataFrame:
    """(source, id, position, chunk): pieces of `size` words, each sharing `overlap` with the one before; ids are stable: source, start
    of the piece's hash, position."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    rows = df.select(source, words.alias("__w")).where(F.size("__w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("__w") - overlap - 1), F.lit(size - overlap))
    rows = rows.select(source, "__w", F.posexplode(starts).alias("position", "__s"))
    rows = rows.select(source, "position", F.array_join(F.slice("__w", F.col("__s") + 1, F.lit(size)), " ").alias("chunk"))
    return rows.select(source, F.concat_ws(":", F.col(source).cast("string"), F.left(F.sha2("chunk", 256), F.lit(16)), F.col("position").cast("string")).alias("id"), "position", "chunk")


def exact_match(actual: str, expected: str) -> Column:
    return F.col(actual).eqNullSafe(F.col(expected)).cast("double")


def evaluate(subjects: DataFrame, cases: DataFrame, scorers: dict[str, Column], on: str = "case_id") -> DataFrame:
    """(scorer, score): the mean of each scorer over the cases."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("scorer"), c.cast("double").alias("score")) for k, c in scorers.items())))
    return cases.join(subjects, on).select(each.alias("x")).select("x.*").groupBy("scorer").agg(F.avg("score").alias("score"))
