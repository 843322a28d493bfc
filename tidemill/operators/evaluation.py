"""Evaluation of predictions: confusion, class metrics, ranking areas, curves, rankings of models.

Everything starts from counts per (truth, prediction) or per (class, score), so that rows are reduced before a window or a
join sees them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.text import per


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(truth, predicted).agg(F.count("*").alias("n"))


def normalized(counts: DataFrame, truth: str) -> DataFrame:
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(truth)), 6))


def class_metrics(counts: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 of each class (0 where undefined), with their macro and weighted means and the accuracy."""
    n = F.col("n")
    t = counts.groupBy(F.col(truth).alias("label")).agg(F.sum(n).alias("support"), F.sum(F.when(F.col(truth) == F.col(predicted), n).otherwise(0)).alias("hits"))
    p = counts.groupBy(F.col(predicted).alias("label")).agg(F.sum(n).alias("predicted"))
    c = t.join(p, "label", "full").select("label", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("support", "hits", "predicted")])
    c = c.withColumns({"precision": per(F.col("hits"), F.col("predicted")), "recall": per(F.col("hits"), F.col("support"))})
    c = c.withColumn("f1", per(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    names = ["precision", "recall", "f1"]
    total = F.sum("support")
    macro = c.agg(F.lit("macro").alias("label"), total.alias("support"), *[F.avg(x).alias(x) for x in names])
    weighted = c.agg(F.lit("weighted").alias("label"), total.alias("support"), *[(F.sum(F.col(x) * F.col("support")) / total).alias(x) for x in names])
    accuracy = c.agg(F.lit("accuracy").alias("label"), total.alias("support"), *[(F.sum("hits") / total).alias(x) for x in names])
    rows = c.select("label", "support", *names).unionByName(macro).unionByName(weighted).unionByName(accuracy)
    return rows.select("label", "support", *[F.round(x, 6).alias(x) for x in names])


def scores(df: DataFrame, truth: str, by_class: dict[str, Column]) -> DataFrame:
    """Counts of positives and negatives per class and distinct score."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("label"), s.cast("double").alias("score"), (F.col(truth) == c).alias("positive")) for c, s in by_class.items()])).alias("x")).select("x.*")
    return long.groupBy("label", "score").agg(F.count_if("positive").alias("pos"), F.count_if(~F.col("positive")).alias("neg"))


def auc(counts: DataFrame) -> DataFrame:
    """Rank-sum area per class, ties at half, and their mean."""
    w = Window.partitionBy("label").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = counts.withColumn("below", F.coalesce(F.sum("neg").over(w), F.lit(0)))
    c = below.groupBy("label").agg((F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("auc"))
    return c.unionByName(c.agg(F.lit("macro").alias("label"), F.avg("auc").alias("auc"))).withColumn("auc", F.round("auc", 6))


def roc(counts: DataFrame) -> DataFrame:
    """Points (false positive rate, true positive rate) at each distinct score, from the highest down."""
    w = Window.partitionBy("label").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("label")
    return counts.select("label", "score", F.round(F.sum("neg").over(w) / F.sum("neg").over(every), 6).alias("fpr"), F.round(F.sum("pos").over(w) / F.sum("pos").over(every), 6).alias("tpr"))


def minmax(x: Column, lower_is_better: bool = False) -> Column:
    """Scaled to 0..1 over all rows (a short table of models): 1 where all are equal."""
    w = Window.partitionBy()
    low, high = F.min(x).over(w), F.max(x).over(w)
    scaled = F.when(high > low, (x - low) / (high - low)).otherwise(1.0)
    return F.when(high > low, 1 - scaled).otherwise(1.0) if lower_is_better else scaled


def composite(df: DataFrame, weights: dict[str, float], lower: tuple[str, ...] = (), fill: dict[str, float] | None = None) -> DataFrame:
    df = df.na.fill(fill or {})
    score = sum((minmax(F.col(c), c in lower) * w for c, w in weights.items()), F.lit(0.0))
    return df.withColumn("score", F.round(score, 6))
