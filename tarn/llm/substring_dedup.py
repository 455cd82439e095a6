"""Exact substring dedup with fixed-block anchors.

A repeat is a window of ``window`` consecutive words of one document whose word sequence also
starts anywhere else, in the same document or another. Every such window holds exactly one
of its document's non-overlapping blocks of ``(window + 1) // 2`` words whole. So:

1. *Index and probe.* The blocks of every document are indexed; every rolling window of block
   length probes them. A block that no other position holds can't lie in a repeat.
2. *Extend.* Around each block that was hit, all windows that cover it are compared by their
   whole word sequence. Overlapping repeated windows together are the maximal exact repeats.

Documents are dealt by the hash of their id and text into chunks of bounded size (``packed.chunks_for``). A chunk
sends each range of hash values (bucket) its *distinct sorted* hashes, packed as differences:
a passage that a third of all documents hold costs one entry a chunk, so no bucket is hot, and
no pairs are made. The bucket answers with one bit an entry. The chunk that recomputes its
sorted hashes can read the answer by rank, whatever order its rows come in after a lost task.

Block hashes have 48 bits (a false hit only costs a comparison). Windows are compared by 96 bits of two independent
hashes that mix words one into the other, not by their bytes, which lie in other chunks: among 10^13 windows (some 100 TB) one pair
of different ones would be taken for equal with a probability of about 1 in 1,000, and no pattern of words makes it likelier.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarn.llm import packed
from tarn.llm.common import text_bytes, tidy
from tarn.llm.words import Words

#: The contract's window.
WINDOW = 35
_BITS = 48
_LOW = np.uint64((1 << _BITS) - 1)
_RESULT = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,stop:long>>, kept_text string"


class _Chunk:
    """What every step needs to know about a chunk's documents; depends on the set of rows only."""

    def __init__(self, docs: pa.Table, window: int):
        self.window, self.block = window, (window + 1) // 2
        self.words = Words(docs.column("text"))
        self.h = self.words.hashes()

    def probes(self):
        """Sorted distinct block-length windows, which occur often, which are blocks; the rank of each document block."""
        w, size = self.words, self.block
        rolling, ok = w.windows(self.h, size) & _LOW, w.whole(size)
        values = np.sort(rolling[ok])
        fresh = np.ones(len(values), dtype=bool)
        np.not_equal(values[1:], values[:-1], out=fresh[1:])
        distinct = values[fresh]
        times = np.diff(np.append(np.flatnonzero(fresh), len(values)))
        n_blocks = w.counts // size
        self.block_first = np.concatenate(([0], np.cumsum(n_blocks)))
        at = np.repeat(w.first[:-1], n_blocks) + size * (np.arange(self.block_first[-1]) - np.repeat(self.block_first[:-1], n_blocks))
        rank = np.searchsorted(distinct, rolling[at]) if len(at) else np.zeros(0, dtype=np.int64)
        is_block = np.zeros(len(distinct), dtype=bool)
        is_block[rank] = True
        return distinct, times > 1, is_block, rank

    def candidates(self, hit: np.ndarray):
        """Windows that cover a hit block: their word positions, their order by hash, and both hashes in that order."""
        w, size = self.words, self.block
        ok = w.whole(self.window)
        at = np.flatnonzero(ok)
        doc = w.doc_of(at)
        block = self.block_first[doc] + -(-(at - w.first[doc]) // size)
        at = at[hit[block]] if len(at) else at
        first, second = w.windows(self.h, self.window, seed=1)[at], w.windows(self.h, self.window, seed=2)[at]
        second = (second >> np.uint64(32)).astype("<u4")
        order = np.argsort(first)
        a, b = first[order], second[order]
        if np.any((a[1:] == a[:-1]) & (b[1:] != b[:-1])):
            order = np.lexsort((second, first))
            a, b = first[order], second[order]
        fresh = np.ones(len(a), dtype=bool)
        fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return at, order, a, b, fresh


def _hit_blocks(chunk: _Chunk, answers: pa.Table) -> np.ndarray:
    distinct, _, is_block, rank = chunk.probes()
    flags = np.zeros(len(distinct), dtype=bool)
    flags[is_block] = packed.answers(answers, 1)
    return flags[rank]


def _probe(window: int, buckets: int):
    def run(docs: pa.Table) -> pa.Table:
        distinct, often, is_block, _ = _Chunk(docs, window).probes()
        return packed.messages(1, docs.column("chunk")[0].as_py(), distinct, _BITS, often, is_block, None, buckets)

    return run


def _extend(window: int, buckets: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return packed.table({k: [] for k in ("step", "chunk", "bucket", "n", "wide", "gaps", "check", "often", "asked")}, packed.MESSAGE)
        chunk = _Chunk(docs, window)
        _, _, a, b, fresh = chunk.candidates(_hit_blocks(chunk, answers))
        times = np.diff(np.append(np.flatnonzero(fresh), len(a)))
        return packed.messages(2, docs.column("chunk")[0].as_py(), a[fresh], 64, times > 1, None, b[fresh], buckets)

    return run


def _remove(window: int, original: bool):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = _Chunk(docs, window)
        w = chunk.words
        at, order, a, _, fresh = chunk.candidates(_hit_blocks(chunk, answers))
        covered = np.zeros(len(w), dtype=bool)
        if len(a):
            repeated = np.empty(len(at), dtype=bool)
            repeated[order] = packed.answers(answers, 2)[np.cumsum(fresh) - 1]
            begin = at[repeated]
            edge = np.zeros(len(w) + 1, dtype=np.int32)
            edge[begin] += 1
            edge[begin + window] -= 1
            covered = np.cumsum(edge)[:-1] > 0
        before = np.concatenate(([0], np.cumsum(covered)))
        removed = before[w.first[1:]] - before[w.first[:-1]]
        spans = []
        for lo, hi, k in zip(w.first[:-1].tolist(), w.first[1:].tolist(), removed.tolist(), strict=True):
            if not k:
                spans.append([])
                continue
            steps = np.diff(covered[lo:hi].astype(np.int8), prepend=0, append=0)
            spans.append([{"start": s, "stop": e} for s, e in zip(np.flatnonzero(steps == 1).tolist(), np.flatnonzero(steps == -1).tolist(), strict=True)])
        kept = pa.array(w.joined(~covered), pa.binary()).cast(pa.string())
        if original:
            kept = pc.if_else(pa.array(removed == 0), docs.column("text").combine_chunks().cast(pa.string()), kept)
        out = {"doc_id": docs.column("doc_id").cast(pa.int64()), "n_words": pa.array(w.counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, packed.TYPES["array<struct<start:long,stop:long>>"]), "kept_text": kept}
        if "rest" in docs.column_names:
            out["rest"] = docs.column("rest")
        return pa.table(out)

    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW, chunk_bytes: int | None = None, rest: Sequence[str] = (), original: bool = False) -> DataFrame:
    """Remove each word that a repeated window covers; one row a document row.

    Reads columns ``doc_id`` and ``text``. Returns doc_id, n_words, n_removed, spans (word ranges removed: the
    maximal exact repeats) and kept_text: kept words joined by one space, or with ``original`` the text as it was
    where nothing is removed. Columns named in ``rest`` are passed on in a struct ``rest``.

    Null and empty texts have no words and an empty kept_text (with ``original`` they stay). Texts shorter than ``window``
    words keep all. Rows that repeat (same doc_id or same text) count as occurrences of their own, so both lose
    the repeat. A null doc_id is a document like others; rows of one doc_id, or of none, are spread by their texts (and the
    columns of ``rest``). An empty table gives no rows. ``chunk_bytes`` fixes the size of chunks.
    """
    _, total = text_bytes(docs)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = packed.chunks_for(total, tasks, chunk_bytes)
    width = max(chunks, tasks)
    spread = ["doc_id", "text", *rest]
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.pmod(F.xxhash64(*[F.col(c) for c in spread]), F.lit(chunks)).cast("int").alias("chunk"), *([F.struct(*rest).alias("rest")] if rest else [])).repartition(width, "chunk")
    result = StructType.fromDDL(_RESULT) if not rest else StructType([*StructType.fromDDL(_RESULT), dealt.schema["rest"]])
    hit = dealt.groupBy("chunk").applyInArrow(tidy(_probe(window, chunks)), packed.MESSAGE).repartition(width, "bucket").groupBy("bucket").applyInArrow(tidy(packed.count), packed.ANSWER)
    repeated = dealt.groupBy("chunk").cogroup(hit.repartition(width, "chunk").groupBy("chunk")).applyInArrow(tidy(_extend(window, chunks)), packed.MESSAGE).repartition(width, "bucket").groupBy("bucket").applyInArrow(tidy(packed.count), packed.ANSWER)
    answers = hit.unionByName(repeated).repartition(width, "chunk")
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(tidy(_remove(window, original)), result)
