"""Histogram sort into shards of near equal bytes, with DataFrame functions only.

The key of a row is (hash of its text, hash of its id), so equal texts are neighbours. Splitters are found by
rounds: each round counts the exact bytes and rows below candidate boundaries inside the intervals where splitters
still are (a 12-bit digit of the key a round: at most 4,096 probes an interval and ``shards - 1`` intervals, a result
of bounded size), until each splitter's bytes are within ``tolerance`` of its target or its interval is one row. A
boundary between two texts is taken if it is within tolerance; only a group of equal texts too large for that
is split, by the ids' hash. Then rows are exchanged once, to (shard, bin), and numbered inside bins whose offsets
are known from their counts, so no task holds a shard.

Rows that are equal in text and id have equal keys. Where such a group is too large for a boundary, or for a bin, the rows are
written once with a number of their own as the third part of the key, and searched again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import materialize

#: Bits of a part of the key that each round refines.
DIGITS = (12, 12, 12, 12, 12, 4)
#: Rows that are sorted and numbered together, about; and rows of equal keys from which on they get numbers of their own.
ROWS_PER_BIN, ROWS_OF_ONE_KEY = 1 << 11, 1 << 16
_MIN = -(1 << 63)
_PARTS = ("__h", "__d", "__r")


@dataclass
class _Search:
    """One splitter: its target, the bytes below its interval, the interval's prefix, and the best boundary so far."""

    target: int
    best: tuple[int, ...]
    prefix: tuple[int, ...]
    base: int = 0
    miss: int = 1 << 62
    done: bool = False
    stuck: bool = False


def _bits(level: int, parts: int) -> list[int]:
    """Bits of each part of the key that are fixed at a level."""
    n = len(DIGITS)
    return [sum(DIGITS[: min(max(0, level - k * n), n)]) for k in range(parts)]


def _prefix(column: str, bits: int) -> Column:
    return F.lit(0).cast("long") if bits == 0 else F.shiftright(column, 64 - bits)


def _round(keys: DataFrame, parts: int, level: int, active: list[_Search]) -> dict[tuple[int, ...], list[tuple]]:
    """For each interval: its bins (prefix, bytes, rows) in order of the key."""
    before, after = _bits(level, parts), _bits(level + 1, parts)
    rows = keys
    if level:
        inside = F.lit(False)
        for prefix in {s.prefix for s in active}:
            one = F.lit(True)
            for name, bits, value in zip(_PARTS, before, prefix, strict=False):
                if bits:
                    one = one & (_prefix(name, bits) == value)
            inside = inside | one
        rows = keys.where(inside)
    names = _PARTS[:parts]
    old = [_prefix(n, b).alias(f"{n}0") for n, b in zip(names, before, strict=True)]
    new = [_prefix(n, b).alias(f"{n}1") for n, b in zip(names, after, strict=True)]
    out: dict[tuple[int, ...], list] = {}
    for r in rows.groupBy(*old, *new).agg(F.sum("__size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect():
        out.setdefault(tuple(r[:parts]), []).append((tuple(r[parts : 2 * parts]), r["bytes"], r["n"]))
    return {k: sorted(v) for k, v in out.items()}


def find_splitters(keys: DataFrame, shards: int, tolerance: float, parts: int = 2) -> tuple[list[tuple[int, ...]], int, bool]:
    """Boundaries (first keys of shards 1 on), the number of rows, and whether one should lie inside a group of equal keys.

    ``keys`` has the key's first ``parts`` columns of (__h, __d, __r) and __size.
    """
    total = keys.agg(F.coalesce(F.sum("__size"), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    bytes_, rows = total["b"], total["n"]
    searches = [_Search(bytes_ * i // shards, (_MIN,) * parts, (0,) * parts) for i in range(1, shards)] if rows else []
    within = max(1, int(tolerance * bytes_ / shards))
    levels = parts * len(DIGITS)
    for level in range(levels):
        active = [s for s in searches if not s.done]
        if not active:
            break
        bins = _round(keys, parts, level, active)
        bits = _bits(level + 1, parts)
        for s in active:
            below, at = s.base, None
            for prefix, size, n in bins[s.prefix]:
                if abs(below - s.target) < s.miss:
                    s.miss, s.best = abs(below - s.target), tuple(v << 64 - b if b else _MIN for v, b in zip(prefix, bits, strict=True))
                if below < s.target < below + size:
                    at = (prefix, below, n)
                below += size
            if s.miss <= within or at is None or at[2] == 1:
                s.done = True
            else:
                s.prefix, s.base, s.stuck = at[0], at[1], level == levels - 1
    return sorted(s.best for s in searches), rows, any(s.stuck for s in searches)


def _placed(splitters: list[tuple[int, ...]]) -> Column:
    """The shard of a row: how many boundaries aren't above its key."""
    at = F.lit(0)
    for splitter in splitters:
        reached = F.lit(True)
        for name, value in reversed(list(zip(_PARTS, splitter, strict=False))):
            reached = (F.col(name) > value) | ((F.col(name) == value) & reached)
        at = at + F.when(reached, 1).otherwise(0)
    return at.cast("int")


def shard(docs: DataFrame, shards: int = 24, tolerance: float = 0.01, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` with columns ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    Weights are the text's UTF-8 bytes plus 8. A null text weighs 8 and is grouped with no other. Equal texts stay
    together where that is within ``tolerance`` of a shard's mean bytes. Rows equal in text and id (null ids too) are split like
    others where they have to be, in any order. Input columns named shard or slot are replaced. An empty
    table gives no rows; with fewer rows than shards some shards are empty.
    """
    plain = docs.drop("shard", "slot")
    key = {"__h": F.xxhash64(text), "__d": F.xxhash64(doc_id), "__size": (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")}
    keys, source, parts = materialize(plain.select(*[c.alias(n) for n, c in key.items()]), "keys"), plain.withColumns(key), 2
    splitters, rows, stuck = find_splitters(keys, shards, tolerance)
    bins = max(1, rows // (shards * ROWS_PER_BIN))

    def counted() -> DataFrame:
        return keys.groupBy(_placed(splitters).alias("shard"), F.pmod(F.xxhash64(*_PARTS[:parts]), F.lit(bins)).alias("__bin")).agg(F.count(F.lit(1)).alias("__n"))

    if stuck or (counted().agg(F.max("__n")).first()[0] or 0) > ROWS_OF_ONE_KEY:
        # written, so that a row has the same number in every read
        source, parts = materialize(source.withColumn("__r", F.xxhash64(F.monotonically_increasing_id())), "rows"), 3
        keys = source.select(*_PARTS, "__size")
        splitters, rows, _ = find_splitters(keys, shards, tolerance, parts)
    before = Window.partitionBy("shard").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted().select("shard", "__bin", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    dealt = source.withColumns({"shard": _placed(splitters), "__bin": F.pmod(F.xxhash64(*_PARTS[:parts]), F.lit(bins))})
    order = Window.partitionBy("shard", "__bin").orderBy(*_PARTS[:parts])
    numbered = dealt.join(offsets, ["shard", "__bin"]).withColumn("slot", F.col("__before") + F.row_number().over(order) - 1)
    return numbered.select(*plain.columns, "shard", F.col("slot").cast("long").alias("slot"))
