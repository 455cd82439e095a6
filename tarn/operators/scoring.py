"""Linear scores, class probabilities, ensembles and their class."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tarn.contract import LABELS


def softmax(scores: Column) -> Column:
    """Probabilities of an array of scores, stable against large ones."""
    top = F.array_max(scores)
    powers = F.transform(scores, lambda s: F.exp(s - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, p: a + p)
    return F.transform(powers, lambda p: p / total)


def log_softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    total = F.log(F.aggregate(scores, F.lit(0.0), lambda a, s: a + F.exp(s - top)))
    return F.transform(scores, lambda s: s - top - total)


def sigmoid(score: Column) -> Column:
    """1 / (1 + exp(-x)) without overflow."""
    small = F.exp(-F.abs(score))
    return F.when(score >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


def argmax(values: Column) -> Column:
    """Position of the first largest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def mean_of(arrays: Sequence[Column], size: int = len(LABELS)) -> Column:
    """Element-wise mean of arrays of ``size`` elements (members of an ensemble, or folds).

    Without a lambda: the arrays may come from workers, whose results can't be an argument of one.
    """
    return F.array(*[sum((a[k] for a in arrays[1:]), arrays[0][k]) / len(arrays) for k in range(size)])


def dense_scores(vector: Column, weights: Sequence[Sequence[float]], intercept: Sequence[float]) -> Column:
    """vector . weights + intercept for a dense array column; weights has a row for each feature, a column for each class."""
    out = []
    for c, b in enumerate(intercept):
        w = F.array(*[F.lit(float(row[c])) for row in weights])
        out.append(F.aggregate(F.zip_with(vector, w, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, p: a + p) + F.lit(float(b)))
    return F.array(*out)


def softmax_rows(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Router:
    """The linear model over sparse feature vectors: fitted one against the rest, scored with softmax."""

    weights: np.ndarray  # features x classes
    intercept: np.ndarray

    def entry_scores(self, row: np.ndarray, index: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
        """Scores of so many rows by their entries, which are added up as they stand."""
        return np.stack([np.bincount(row, value * self.weights[index, c], rows) for c in range(len(self.intercept))], axis=1) + self.intercept

    def flat_scores(self, first: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Scores of rows whose entries are index[first[k]:first[k + 1]] with these values, all at once."""
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        return self.entry_scores(row, index[first[0] : first[-1]], value[first[0] : first[-1]], len(first) - 1)

    def flat_probabilities(self, first: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        return softmax_rows(self.flat_scores(first, index, value))

    def probabilities(self, spark: SparkSession):
        """A function of a sparse vector column to an array of class probabilities (the softmax of the scores)."""
        return self._udf(spark, True)

    def scores(self, spark: SparkSession):
        """A function of a sparse vector column to an array of scores."""
        return self._udf(spark, False)

    def _udf(self, spark: SparkSession, probabilities: bool):
        # The weights are of fixed size (66,287 x 3) and sent to executors once.
        shared = spark.sparkContext.broadcast(self)

        @F.arrow_udf(ArrayType(DoubleType()))
        def run(vectors: pa.Array) -> pa.Array:
            scored = shared.value.flat_probabilities if probabilities else shared.value.flat_scores
            return pa.array(list(scored(*flat_vectors(vectors))), pa.list_(pa.float64()))

        return run


def flat_vectors(vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, index, value) of a column of sparse vectors; a null one has no entries."""
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    flat = vectors.flatten()
    return np.concatenate(([0], np.cumsum(sizes))).astype(np.int64), flat.field("i").to_numpy(zero_copy_only=False), flat.field("v").to_numpy(zero_copy_only=False).astype(np.float64)


def routed(asa: Column, linear: Column) -> Column:
    """The sequence model's probabilities where it has any, else the linear model's."""
    return F.coalesce(asa, linear)


def decide(rows: DataFrame, probabilities: str = "probabilities") -> DataFrame:
    """``rows`` with the class code and its label; probabilities that aren't finite raise."""
    p = F.col(probabilities)
    bad = F.lit(False)  # without a lambda: see ``mean_of``
    for k in range(len(LABELS)):
        bad = bad | p[k].isNull() | F.isnan(p[k]) | (F.abs(p[k]) == float("inf"))
    code = F.when(bad, F.raise_error(F.lit("probabilities aren't finite")).cast("int")).otherwise(argmax(p))
    return rows.withColumn("pred_class", code).withColumn("pred_label", F.element_at(F.array(*map(F.lit, LABELS)), F.col("pred_class") + 1))
