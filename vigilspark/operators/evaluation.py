"""Model evaluation without gathering predictions in one place (AG-42..49, RM-7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _quad(actual: Column, predicted: Column) -> dict[str, Column]:
    return {
        "tp": F.count_if(actual & predicted), "fp": F.count_if(~actual & predicted), "tn": F.count_if(~actual & ~predicted), "fn": F.count_if(actual & ~predicted),
    }


def _rates(tp: Column, fp: Column, tn: Column, fn: Column, places: int = 6) -> list[Column]:
    p, r = tp / F.greatest(tp + fp, F.lit(1)), tp / F.greatest(tp + fn, F.lit(1))
    return [
        F.round(p, places).alias("precision"), F.round(r, places).alias("recall"), F.round(2 * p * r / F.greatest(p + r, F.lit(1e-8)), places).alias("f1"),
        F.round(fp / F.greatest(fp + tn, F.lit(1)), places).alias("fpr"),
    ]


def binary_metrics(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Confusion counts and rates of (actual boolean, score) at one threshold (AG-42)."""
    q = df.agg(*[c.alias(n) for n, c in _quad(F.col("actual"), F.col("score") >= threshold).items()])
    return q.select("tp", "fp", "tn", "fn", *_rates(*[F.col(n) for n in ("tp", "fp", "tn", "fn")]))


def threshold_sweep(df: DataFrame, low: int = 10, high: int = 99) -> DataFrame:
    """Rates at thresholds low..high hundredths (AG-45): one histogram of 101 bins, then sums over bins."""
    hist = df.groupBy(F.floor(F.col("score") * 100 + 1e-9).cast("int").alias("bin")).agg(F.count_if("actual").alias("pos"), F.count_if(~F.col("actual")).alias("neg"))
    # at most 101 bins, each with every threshold
    summed = hist.withColumn("t", F.explode(F.sequence(F.lit(low), F.lit(high)))).groupBy("t").agg(
        F.sum(F.when(F.col("bin") >= F.col("t"), F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("bin") >= F.col("t"), F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("bin") < F.col("t"), F.col("neg")).otherwise(0)).alias("tn"), F.sum(F.when(F.col("bin") < F.col("t"), F.col("pos")).otherwise(0)).alias("fn"),
    )
    return summed.select("t", "tp", "fp", "tn", "fn", *_rates(*[F.col(n) for n in ("tp", "fp", "tn", "fn")]))


def roc_auc(df: DataFrame, bins: int = 1000) -> DataFrame:
    """Area under the ROC curve by rank sums with average ranks (AG-46), exact.

    Scores in 0..1 are grouped by value; ranks come from sums over ``bins``
    coarse bins and windows inside each bin, never one ordered pass over all rows.
    """
    values = df.groupBy(F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int").alias("bin"), "score").agg(
        F.count_if("actual").alias("pos"), F.count("*").alias("n")
    )
    coarse = values.groupBy("bin").agg(F.sum("n").alias("n")).select("bin", (F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("bin")) - F.col("n")).alias("before"))
    inside = F.sum("n").over(W.partitionBy("bin").orderBy("score")) - F.col("n")
    ranked = values.withColumn("inside", inside).join(F.broadcast(coarse), "bin")  # at most ``bins`` rows
    rank = F.col("before") + F.col("inside") + (F.col("n") + 1) / 2
    sums = ranked.agg(F.sum(rank * F.col("pos")).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    neg = F.col("n") - F.col("p")
    auc = (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * neg)
    return sums.select(F.col("p").alias("positives"), neg.alias("negatives"), F.round(auc, 6).alias("auc"))


def confusion(df: DataFrame) -> DataFrame:
    """Counts by (actual, predicted) with row and column shares (AG-43, AG-44)."""
    n = df.groupBy("actual", "predicted").agg(F.count("*").alias("n"))
    row, column = W.partitionBy("actual"), W.partitionBy("predicted")
    return n.select("actual", "predicted", "n", F.round(F.col("n") / F.sum("n").over(row), 6).alias("of_actual"), F.round(F.col("n") / F.sum("n").over(column), 6).alias("of_predicted"))


def per_class(df: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class (AG-48)."""
    n = df.groupBy("actual", "predicted").agg(F.count("*").alias("n"))
    actual = n.groupBy(F.col("actual").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    predicted = n.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("predicted"))
    j = actual.join(predicted, "label", "full").select("label", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("support", "tp", "predicted")])
    p, r = F.col("tp") / F.greatest("predicted", F.lit(1)), F.col("tp") / F.greatest("support", F.lit(1))
    return j.select("label", "support", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(2 * p * r / F.greatest(p + r, F.lit(1e-8)), 6).alias("f1"))


def calibration(df: DataFrame, bins: int = 10) -> DataFrame:
    """Accuracy and mean confidence in bins of the largest probability (AG-47)."""
    b = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("correct").cast("int")), 6).alias("accuracy"), F.round(F.avg("confidence"), 6).alias("confidence"))


def critical_errors(df: DataFrame) -> DataFrame:
    """Legitimate channels that would be blocked or escalated (AG-49)."""
    return df.where((F.col("actual") == "IGNORE") & F.col("predicted").isin("BLOCK", "ESCALATE"))
