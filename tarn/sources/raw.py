"""Sources of raw records under a strict contract, and of ids alone."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tarn.contract import LABELS


class ContractError(ValueError):
    """Input that breaks the contract."""


def _suffix(path: str) -> str:
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if kind not in (".parquet", ".csv"):
        raise ContractError(f"neither .parquet nor .csv: {path}")
    return kind


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Names in the first record of a CSV source, which may go over several lines; none for an empty source."""
    plain = spark.read.option("header", False).option("multiLine", True).option("quote", '"').option("escape", '"').option("inferSchema", False)
    first = plain.csv(path).first()
    return [(v or "").removeprefix("\ufeff" if k == 0 else "") for k, v in enumerate(first)] if first else []


def _csv(spark: SparkSession, path: str, order: bool = False) -> DataFrame:
    """UTF-8 CSV with a header: every column a string, an empty cell the empty string, no row too long or too short."""
    names = header_of(spark, path)
    if not names:
        raise ContractError("CSV has no header")
    if len(set(names)) != len(names):
        raise ContractError("CSV repeats a column name")
    schema = StructType([StructField(n, StringType()) for n in names])
    rows = spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "FAILFAST").option("enforceSchema", True).csv(path)
    place = [_place(".csv").alias(ORDER)] if order else []
    return rows.select(*[F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in names], *place)


def label_code(label: Column) -> Column:
    """0, 1, 2 for the labels of the contract; null for any other."""
    return reduce(lambda c, kv: c.when(label == kv[1], kv[0]), enumerate(LABELS), F.when(F.lit(False), F.lit(0))).cast("int")


#: Column with the place of a record in its source: file and row.
ORDER = "source_order"


def _place(kind: str) -> Column:
    """Where a row stands. A CSV file with multi-line cells is read by one task, so ids increase inside it."""
    row = F.col("_metadata.row_index") if kind == ".parquet" else F.monotonically_increasing_id()
    return F.struct(F.col("_metadata.file_path").alias("file"), row.alias("row"))


def read_raw(spark: SparkSession, path: str, labels: bool = False, strict: bool = True, order: bool = False) -> DataFrame:
    """(event_id, message_sanitized, src_port [, label] [, source_order]) of a Parquet or CSV source, by name.

    event_id is a string and never coerced; a missing src_port column is all null; other columns aren't read, the label
    column only with ``labels`` (then as its code). With ``strict`` rows with a blank id or an unknown label raise when they
    are read; without, they pass.
    """
    rows = spark.read.parquet(path) if _suffix(path) == ".parquet" else _csv(spark, path, order)
    types = dict(rows.dtypes)
    needed = ["event_id", "message_sanitized", *(["label_binary"] if labels else [])]
    if missing := [c for c in needed if c not in types]:
        raise ContractError(f"no column {', '.join(missing)}")
    if wrong := [c for c in needed if types[c] not in ("string", "void")]:
        raise ContractError(f"not a string column: {', '.join(wrong)}")
    event_id = F.col("event_id")
    columns = [event_id, F.col("message_sanitized"), (F.col("src_port").cast("string") if "src_port" in types else F.lit(None).cast("string")).alias("src_port")]
    if labels:
        columns.append(label_code(F.col("label_binary")).alias("label"))
    if order:
        columns.append(_place(".parquet").alias(ORDER) if _suffix(path) == ".parquet" else F.col(ORDER))
    out = rows.select(*columns)
    if strict:
        out = out.withColumn("event_id", F.when(blank_id(F.col("event_id")), F.raise_error(F.lit("event_id is blank"))).otherwise(F.col("event_id")))
        if labels:
            out = out.withColumn("label", F.coalesce("label", F.raise_error(F.lit("label_binary is none of the labels")).cast("int")))
    return out


def blank_id(event_id: Column) -> Column:
    return event_id.isNull() | event_id.rlike(r"(?U)\A\s*\z")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The event_id column alone; no other column is read from Parquet."""
    rows = spark.read.parquet(path) if _suffix(path) == ".parquet" else _csv(spark, path)
    if rows.columns.count("event_id") != 1 or dict(rows.dtypes)["event_id"] != "string":
        raise ContractError("not exactly one string column event_id")
    return rows.select("event_id")


def read_labelled(spark: SparkSession, path: str, limit_rows: int | None = None) -> DataFrame:
    """Labelled records; ``limit_rows`` takes the first rows in the order of the source (by file name, then by row)."""
    if limit_rows is None:
        return read_raw(spark, path, labels=True)
    return read_raw(spark, path, labels=True, order=True).orderBy(ORDER).limit(limit_rows).drop(ORDER)
