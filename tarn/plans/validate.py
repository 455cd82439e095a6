"""Validation of a result file: exact header, exact coverage of the input's ids, valid labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tarn.operators.coverage import coverage_report
from tarn.sources.raw import ContractError, header_of, read_ids

HEADER = ["event_id", "pred_label"]


def read_submission(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """(event_id, pred_label) rows of a CSV result, and the number of malformed rows (too long or too short)."""
    if header_of(spark, path) != HEADER:
        raise ContractError(f"the header isn't {','.join(HEADER)}")
    schema = StructType([StructField(n, StringType()) for n in (*HEADER, "__bad")])
    rows = spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("columnNameOfCorruptRecord", "__bad").csv(path)
    bad = rows.agg(F.count("__bad").alias("bad"), F.count("event_id").alias("ids")).first()["bad"]
    return rows.where("__bad is null").select(*[F.coalesce(c, F.lit("")).alias(c) for c in HEADER]), bad


def validate_submission(spark: SparkSession, source: str, submission: str) -> dict:
    """The coverage report of a result against its input, and counts of the predicted labels."""
    emitted, bad = read_submission(spark, submission)
    report = coverage_report(read_ids(spark, source), emitted, bad).first().asDict()
    labels = {r["pred_label"]: r["count"] for r in emitted.groupBy("pred_label").count().collect()}
    return report | {"predicted_label_counts": labels}
