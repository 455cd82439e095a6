"""Classification metrics over a label and a prediction column, both as class codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.contract import LABELS


def _classes(rows: DataFrame, name: str) -> DataFrame:
    return rows.sparkSession.range(len(LABELS)).select(F.col("id").cast("int").alias(name))


def class_support(rows: DataFrame, label: str = "label") -> DataFrame:
    """(label, support) of every class, zero ones too."""
    counted = rows.groupBy(F.col(label).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("support"))
    return _classes(rows, "label").join(F.broadcast(counted.where(F.col("label").between(0, len(LABELS) - 1))), "label", "left").select("label", F.coalesce("support", F.lit(0)).alias("support"))


def confusion(rows: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """(label, predicted, n) of all pairs of classes: truth in rows, prediction in columns."""
    counted = rows.groupBy(F.col(label).cast("int").alias("label"), F.col(predicted).cast("int").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    grid = _classes(rows, "label").join(_classes(rows, "predicted"))  # nine rows
    return grid.join(F.broadcast(counted.where(F.col("label").between(0, 2) & F.col("predicted").between(0, 2))), ["label", "predicted"], "left").select("label", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def class_metrics(matrix: DataFrame) -> DataFrame:
    """Support, correct, missed, false_called, precision, recall and F1 of each class of a confusion matrix; null over zero."""
    hit = F.col("label") == F.col("predicted")
    truth = matrix.groupBy("label").agg(F.sum("n").alias("support"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("correct"))
    called = matrix.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("called"))
    c, s, k = F.col("correct"), F.col("support"), F.col("called")
    return truth.join(called, "label").select(
        "label", "support", "correct", (s - c).alias("missed"), (k - c).alias("false_called"),
        F.try_divide(c, k).alias("precision"), F.try_divide(c, s).alias("recall"), F.try_divide(2 * c, s + k).alias("f1"),
    )


def macro(matrix: DataFrame) -> DataFrame:
    """One row: rows, errors, and macro-F1, null unless every class has support."""
    return class_metrics(matrix).agg(F.sum("support").alias("rows"), F.sum("missed").alias("errors"), F.when(F.min("support") > 0, F.avg("f1")).alias("macro_f1"))
