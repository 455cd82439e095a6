"""Summaries of decoded records: facts outside their vocabulary, and scales of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.contract import ENUMS


def unknown_facts(rows: DataFrame, facts: str = "facts") -> DataFrame:
    """(fact, value, n) of enumerated facts whose value has no column."""
    pairs = []
    for name, names in ENUMS.items():
        value = F.lower(F.col(facts)[name])
        known = value.isin(*names) if name != "transport_protocol" else value.isin(*names[:4]) | value.rlike(r"\Aipproto_(?:[0-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9]|25[0-5])\z")
        pairs.append(F.struct(F.lit(name).alias("fact"), value.alias("value"), (~known).alias("unknown")))
    pairs = F.array(*pairs)
    found = rows.select(F.explode(F.filter(pairs, lambda p: p["unknown"])).alias("p"))
    return found.groupBy("p.fact", "p.value").agg(F.count(F.lit(1)).alias("n"))


def max_abs_scale(vectors: DataFrame, vector: str) -> DataFrame:
    """(i, scale) of a sparse vector column's entries: the largest absolute value, 1 at least."""
    return vectors.select(F.explode(vector).alias("e")).groupBy(F.col("e.i").alias("i")).agg(F.greatest(F.lit(1.0), F.max(F.abs(F.col("e.v").cast("double")))).alias("scale"))
