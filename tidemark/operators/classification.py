"""Curves of classifiers' scores: one class against the rest, all pairs together, and means."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.frames import ratio


def _pairs(df: DataFrame, label: str, scores: dict[str, str]) -> DataFrame:
    """(curve, class, y, s): each row once for each class, and all of them again as 'micro'."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("class"), (F.col(label).cast("string") == c).cast("int").alias("y"), F.col(s).cast("double").alias("s")) for c, s in scores.items())))
    rows = df.select(each.alias("x")).select(F.lit("class").alias("curve"), "x.*")
    return rows.unionByName(rows.select(F.lit("micro").alias("curve"), F.lit(None).cast("string").alias("class"), "y", "s"))


def _steps(rows: DataFrame) -> DataFrame:
    """(curve, class, threshold, tp, fp, pos, neg): counts at each different score, from the highest; ties are one step."""
    key = ["curve", "class"]
    at = rows.groupBy(*key, F.col("s").alias("threshold")).agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    w = Window.partitionBy(*key)
    down = w.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    return at.select(*key, "threshold", F.sum("p").over(down).alias("tp"), F.sum("q").over(down).alias("fp"), F.sum("p").over(w).alias("pos"), F.sum("q").over(w).alias("neg"))


def roc_curve(df: DataFrame, label: str, scores: dict[str, str]) -> DataFrame:
    """(curve, class, fpr, tpr, threshold, auc): scores maps each class, as text, to its column. The curve starts at (0, 0)
    with an infinite threshold; areas are trapezoids'."""
    steps = _steps(_pairs(df, label, scores)).select("curve", "class", ratio("fp", "neg").alias("fpr"), ratio("tp", "pos").alias("tpr"), "threshold")
    start = steps.select("curve", "class").distinct().select("curve", "class", F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(float("inf")).alias("threshold"))
    both = steps.unionByName(start)
    w = Window.partitionBy("curve", "class")
    before = w.orderBy(F.desc("threshold"))
    both = both.withColumn("__a", (F.col("fpr") - F.lag("fpr", 1).over(before)) * (F.col("tpr") + F.lag("tpr", 1).over(before)) / 2)
    return both.withColumn("auc", F.sum("__a").over(w)).drop("__a")


def precision_recall_curve(df: DataFrame, label: str, scores: dict[str, str]) -> DataFrame:
    """(curve, class, recall, precision, threshold, average_precision): areas are steps'."""
    steps = _steps(_pairs(df, label, scores)).select("curve", "class", ratio("tp", "pos").alias("recall"), ratio("tp", F.col("tp") + F.col("fp")).alias("precision"), "threshold")
    start = steps.select("curve", "class").distinct().select("curve", "class", F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"), F.lit(float("inf")).alias("threshold"))
    both = steps.unionByName(start)
    w = Window.partitionBy("curve", "class")
    both = both.withColumn("__a", (F.col("recall") - F.lag("recall", 1).over(w.orderBy(F.desc("threshold")))) * F.col("precision"))
    return both.withColumn("average_precision", F.sum("__a").over(w)).drop("__a")


def macro_roc(roc: DataFrame) -> DataFrame:
    """(fpr, tpr, auc): the mean of the classes' curves at every false positive rate of any, between points in
    proportion. The curves are joined by the segment that holds the rate."""
    curves = roc.where("curve = 'class'")
    # at one rate a curve rises straight up: its highest point there counts from there on
    points = curves.groupBy("class", "fpr").agg(F.max("tpr").alias("tpr"), F.min("tpr").alias("low"))
    w = Window.partitionBy("class").orderBy("fpr")
    segments = points.withColumns({"next_fpr": F.lead("fpr", 1).over(w), "next_low": F.lead("low", 1).over(w)})
    grid = curves.select(F.col("fpr").alias("x")).distinct()
    inside = (F.col("x") >= F.col("fpr")) & (F.col("x") < F.coalesce("next_fpr", F.lit(float("inf"))))
    at = F.when(F.col("x") == F.col("fpr"), F.col("tpr")).otherwise(F.col("tpr") + (F.col("next_low") - F.col("tpr")) * (F.col("x") - F.col("fpr")) / (F.col("next_fpr") - F.col("fpr")))
    mean = grid.join(segments, inside).groupBy(F.col("x").alias("fpr")).agg(F.avg(at).alias("tpr"))
    return mean
