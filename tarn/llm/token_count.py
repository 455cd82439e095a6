"""Token counts of a byte-level BPE tokenizer file by heap-and-linked-list merging.

The count of a pre-token is its initial symbols minus its merges: the lowest-rank adjacent pair (leftmost of equal
ranks) is popped from a heap again and again, entries of pairs that changed are skipped, and no ids are made.
"""

from __future__ import annotations

import heapq
import json

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import slices, tidy
from tarn.sources.spread import spread

#: Counted pre-tokens that a worker keeps.
CACHE = 400_000


def _byte_symbols() -> list[str]:
    """Byte-level symbols: printable Latin-1 stands for itself, the other bytes for U+0100 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Counter(dict):
    """Token counts of pre-tokens; as a dict, the ones that were met lately, in two generations."""

    def __init__(self, tokenizer_file: str, pattern: str):
        super().__init__()
        self.older: dict[str, int] = {}
        with open(tokenizer_file, encoding="utf-8") as f:
            own = json.load(f)
        vocabulary = own["model"]["vocab"]
        self.symbols = [vocabulary[s] for s in _byte_symbols()]
        self.merges = {}
        for rank, merge in enumerate(own["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.merges[vocabulary[a] << 32 | vocabulary[b]] = (rank, vocabulary[a + b])
        self.split = regex.compile(pattern).findall
        special = sorted((t["content"] for t in own["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def __missing__(self, piece: str) -> int:
        n = self.older.pop(piece, None)
        if n is None:
            n = self.count_piece(piece.encode("utf-8"))
        if len(piece) <= 64:
            if len(self) >= CACHE:
                self.older = self.copy()
                self.clear()
            self[piece] = n
        return n

    def count_piece(self, raw: bytes) -> int:
        n, get = len(raw), self.merges.get
        symbol = [self.symbols[b] for b in raw]
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = []
        for p in range(n - 1):
            if (m := get(symbol[p] << 32 | symbol[p + 1])) is not None:
                heap.append((m[0], p, m[1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            rank, p, made = heapq.heappop(heap)
            q = after[p]
            if symbol[p] < 0 or q >= n:
                continue
            m = get(symbol[p] << 32 | symbol[q])
            if m is None or m[0] != rank:
                continue
            merges += 1
            symbol[p], symbol[q] = made, -1
            end = after[p] = after[q]
            if end < n:
                before[end] = p
                if (m := get(made << 32 | symbol[end])) is not None:
                    heapq.heappush(heap, (m[0], p, m[1]))
            if p:
                o = before[p]
                if (m := get(symbol[o] << 32 | made)) is not None:
                    heapq.heappush(heap, (m[0], o, m[1]))
        return n - merges

    def count(self, text: str) -> int:
        if self.special is None:
            return sum(map(self.__getitem__, self.split(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.split(part))) for part in parts)


_counters: dict[tuple[str, str], Counter] = {}


def counter(tokenizer_file: str, pattern: str) -> Counter:
    key = (tokenizer_file, pattern)
    if key not in _counters:
        _counters[key] = Counter(*key)
    return _counters[key]


def token_counts(docs: DataFrame, tokenizer_file: str, pattern: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of each row's whole text, read from columns doc_id and text alone.

    Null and empty texts have no bytes and no tokens. The tokenizer's special strings inside a text count as one
    token each, which is its library's default. Repeated rows each give a row; an empty table gives none.
    """

    def run(batches):
        own = counter(tokenizer_file, pattern)
        for batch in batches:
            for part in slices(batch, 2 << 20):
                n = [own.count(t) if t else 0 for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])
        own.older = {}  # the worker may be idle for long

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.col("text").cast("string").alias("text"))
    return spread(rows).mapInArrow(tidy(run), "doc_id long, n_bytes long, n_tokens long")
