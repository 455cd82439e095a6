"""Parallel work on inputs that are too small for Spark to split."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of input for each core below which rows are dealt over all cores.
SMALL = 8 << 20


def spread(rows: DataFrame) -> DataFrame:
    """The same rows, dealt over all cores if they are few and in few files: a file of one row group is read by one task, however many cores are idle.

    Only for work that costs far more than moving its rows. Inputs of ``SMALL`` bytes a core or more (by Catalyst's estimate), inputs of
    unknown size or of as many files as cores, and streams stay where they are, so nothing is shuffled at scale.
    """
    if rows.isStreaming:
        return rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())  # py4j gives a large number as an int
    return rows.repartition(cores) if cores > 1 and size < SMALL * cores and len(rows.inputFiles()) < cores else rows
