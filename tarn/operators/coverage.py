"""Set coverage: does a result hold exactly the input's ids, once each, with valid labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.contract import LABELS
from tarn.sources.raw import blank_id


def missing_ids(expected: DataFrame, emitted: DataFrame) -> DataFrame:
    """Ids of the input that the result lacks, each once. Null and blank ids aren't ids."""
    return expected.select("event_id").where(~blank_id(F.col("event_id"))).distinct().join(emitted.select("event_id"), "event_id", "left_anti")


def extra_ids(expected: DataFrame, emitted: DataFrame) -> DataFrame:
    """Ids of the result that the input lacks, each once."""
    return missing_ids(emitted, expected)


def duplicate_ids(rows: DataFrame, key: str = "event_id") -> DataFrame:
    """(key, n) of keys that occur more than once."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def distinct_check(rows: DataFrame, key: str) -> DataFrame:
    """One row: rows, unique keys, and duplicates (rows with a key beyond its first)."""
    return rows.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("unique"), (F.count(key) - F.count_distinct(key)).alias("duplicates"))


def shared_rows(train: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows of ``other`` whose key also occurs in ``train``, with their multiplicity."""
    return other.join(train.select(key).distinct(), key, "left_semi")


def shared_ids(train: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Keys that occur in both, each once."""
    return train.select(key).intersect(other.select(key))


def coverage_report(expected: DataFrame, emitted: DataFrame, malformed_rows: int = 0) -> DataFrame:
    """One row of counters, and ``passed``: none of the failures occurred and there is a result.

    ``emitted`` has columns event_id and pred_label. One aggregate over each side and two anti-joins.
    """
    sides = []
    for rows, name in ((expected, "input"), (emitted, "output")):
        blank = blank_id(F.col("event_id"))
        columns = [F.count(F.lit(1)).alias(f"{name}_rows"), F.count(F.when(blank, 1)).alias(f"invalid_{name}_ids"), (F.count(F.when(~blank, 1)) - F.count_distinct(F.when(~blank, F.col("event_id")))).alias(f"duplicate_{name}_ids"), F.count_distinct(F.when(~blank, F.col("event_id"))).alias(f"unique_{name}_ids")]
        if name == "output":
            columns.append(F.count(F.when(~F.coalesce(F.col("pred_label").isin(*LABELS), F.lit(False)), 1)).alias("invalid_labels"))
        sides.append(rows.agg(*columns))
    sides.append(missing_ids(expected, emitted).agg(F.count(F.lit(1)).alias("missing_ids")))
    sides.append(extra_ids(expected, emitted).agg(F.count(F.lit(1)).alias("extra_ids")))
    report = sides[0]
    for side in sides[1:]:
        report = report.join(side)  # one row each
    report = report.withColumn("malformed_rows", F.lit(malformed_rows).cast("long"))
    failures = [c for c in report.columns if not c.startswith("unique_") and c not in ("input_rows", "output_rows")]
    passed = (F.col("input_rows") > 0) & (F.col("output_rows") > 0)
    for c in failures:
        passed = passed & (F.col(c) == 0)
    return report.withColumn("passed", passed)
