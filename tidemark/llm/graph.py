"""Connected components of edges, in rounds of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import staged


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to its least one."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (u, v): root is the least node of its component.

    A round costs a few shuffles of the edges; a hub is only ever the key of a sum or of a join that Spark may split. Rounds are
    written to the shared folder; their number grows with the logarithm of the longest path. Loops and repeated
    edges do no harm; null ends are ignored."""
    edges = staged(edges.select("u", "v").where("u is not null and v is not null and u != v").distinct(), "edges")
    before = _print(edges)
    while before[0]:
        edges = staged(_small(_large(edges)), "edges", 2 * before[0])
        now = _print(edges)
        if now == before:
            break
        before = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
