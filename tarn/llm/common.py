"""Small helpers that several operators share."""

from __future__ import annotations

import gc
import inspect
import math
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.sources.scratch import new_path, written


def new_table(spark: SparkSession, name: str) -> str:
    return new_path(spark, name)


def text_bytes(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and UTF-8 bytes of a table: one row is brought to the driver."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text).cast("long")), F.lit(0)).alias("b")).first()
    return row["n"], row["b"]


def parts_for(total: int, each: int, least: int = 1) -> int:
    return max(least, math.ceil(total / max(1, each)))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once as a table in the shared folder; it is deleted when the session's JVM ends."""
    spark, out = df.sparkSession, written(df, name)
    gc.collect()  # so that Spark drops the shuffle files behind the table now, not some time later
    spark.sparkContext._jvm.System.gc()
    return out


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Arrow batches of at most so many rows in what is run inside; the session's own setting is back afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release_memory() -> None:
    """Give memory that a worker has freed back to the system; idle workers stay alive between tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def tidy(run):
    """A worker function (of batches, or of a group's tables) that gives its memory back when it ends."""

    def batches(made):
        try:
            yield from made
        finally:
            release_memory()

    def wrapped(*tables):
        out = run(*tables)
        if hasattr(out, "__next__"):
            return batches(out)
        release_memory()
        return out

    # applyInArrow tells the forms of a group function apart by its parameters
    if sum(p.default is p.empty for p in inspect.signature(run).parameters.values()) == 2:
        return lambda left, right: wrapped(left, right)
    return lambda rows: wrapped(rows)


def slices(batch, limit: int = 1 << 20, text: str = "text"):
    """An Arrow batch in slices of about ``limit`` text bytes (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)


#: Keys that are looked up by broadcast, at most (some MB): those that hold more than 1 / HOT_KEYS of all rows.
HOT_KEYS = 100_000


def lookup(rows: DataFrame, found: DataFrame, keys: list[str], own: Column, total: int) -> DataFrame:
    """``rows`` left-joined with ``found``: one row for each key, with a column ``rows`` that says how many of ``rows`` have it.

    Keys that hold more than 1 / HOT_KEYS of ``total`` rows (fewer than HOT_KEYS keys, whatever the input) are looked up by
    broadcast; the others by key, where rows that have been found lie by ``own`` (a hash that tells rows apart, of the type of the
    first key). So no task gets more than 1 / HOT_KEYS of the rows for one key, if ``found`` has all keys that many rows hold.
    """
    if total <= HOT_KEYS:  # so there are no more keys than that
        return rows.join(F.broadcast(found.drop("rows")), keys, "left").select(*rows.columns, *[c for c in found.columns if c not in (*keys, "rows")])
    many = total // HOT_KEYS
    values = [c for c in found.columns if c not in (*keys, "rows")]
    hot = found.where(F.col("rows") > many).select(*keys, F.struct(*values).alias("__hot"))
    cold = found.where(F.col("rows") <= many).select(*[F.col(k).alias(f"__{k}") for k in keys], F.struct(*values).alias("__cold"))
    looked = rows.join(F.broadcast(hot), keys, "left")
    first, *others = keys
    looked = looked.withColumns({f"__{first}": F.when(F.col("__hot").isNull(), F.col(first)).otherwise(own), **{f"__{k}": F.col(k) for k in others}})
    looked = looked.join(cold, [f"__{k}" for k in keys], "left").withColumn("__got", F.coalesce("__hot", "__cold"))
    return looked.select(*rows.columns, *[F.col("__got")[v].alias(v) for v in values])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for edges (u, v) of long ids: component is the smallest id reachable.

    Alternating large-star and small-star rounds on the cluster; each round's edges are written in the shared folder.
    A node's neighbours are never gathered: minima are aggregated before the shuffle and looked up, those of hot nodes by broadcast.
    """

    def state(df: DataFrame):
        row = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        return row["n"], row["x"]

    own = F.xxhash64("u", "v")
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    last = state(now)
    while last[0]:
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("rows"))
        large = lookup(both, least, ["u"], own, 2 * last[0]).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("rows"))
        kept = lookup(large, least, ["u"], own, last[0])
        small = kept.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(kept.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = written(small, "edges")
        new = state(now)
        if new == last:
            break
        last = new
    return now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
