"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each match of the pattern is encoded on its own, as rank files are meant to be read: a match that is a
token is that token; else adjacent parts merge, lowest rank first and leftmost of equal ranks first.
The queue of candidate pairs is a bucket of linked-list positions for each merge rank, over a bitmap of the
ranks that have entries, in two levels (words of 256 ranks, and a word of the words that aren't zero):
find-first-set on each level gives the next rank in constant time. An entry whose pair has changed meanwhile is stale and skipped. A pre-token of n bytes
takes O(n) queue operations, so very long ones are no problem.
"""

from __future__ import annotations

import base64
import heapq
import re
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import slices, tidy
from tarn.sources.spread import spread

#: Encoded pre-tokens that a worker keeps.
CACHE = 250_000


class Codec(dict):
    """Token ids of pre-tokens; as a dict, the encoded pre-tokens (packed 32-bit ids) that were met lately, in two generations."""

    def __init__(self, rank_file: str, pattern: str):
        super().__init__()
        self.older: dict[str, bytes] = {}
        with open(rank_file, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.split = self.split_ascii = regex.compile(pattern).findall
        plain = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\sA-Za-z0-9]").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")
        if "\\p" not in plain:  # the same matches in ASCII texts, by a faster engine
            self.split_ascii = re.compile(plain, re.ASCII).findall
        self.longest = max(map(len, self.ranks))
        self.one = [0] * (max(self.ranks.values()) + 1)
        self.many: dict[int, list[int]] = {}
        self.words = [0] * (len(self.one) // 256 + 1)
        self.marks = [1 << k for k in range(max(256, len(self.words)))]
        self.vocabulary = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.vocabulary[rank] = token
        self.lengths = np.array([len(t) for t in self.vocabulary], dtype=np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.vocabulary), dtype=np.uint8)

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.pop(piece, None)
        if ids is None:
            raw = piece.encode("utf-8")
            whole = self.ranks.get(raw)
            ids = array("i", (whole,) if whole is not None else self.merge(raw)).tobytes()
        if len(piece) <= 64:
            if len(self) >= CACHE:
                self.older = self.copy()
                self.clear()
            self[piece] = ids
        return ids

    def merge(self, raw: bytes) -> list[int]:
        n, get, ranks, longest = len(raw), self.ranks.get, self.ranks, self.longest
        # The rank queue is empty between calls: one position (+ 1) of each rank, or -1 and a heap of them; the ranks of
        # each 256 that have positions; and which of these words aren't 0.
        one, many, words, marks = self.one, self.many, self.words, self.marks
        top = 0
        after = list(range(1, n + 1))  # of each part's first byte: where it ends and the next part begins
        before = list(range(-1, n - 1))
        pair = [get(raw[p : p + 2]) for p in range(n)]  # rank of the pair that begins here; None: none, or no part begins here
        pair[-1] = None
        for p, r in enumerate(pair):
            if r is not None:
                if not (held := one[r]):
                    one[r] = p + 1
                    words[r >> 8] |= marks[r & 255]
                    top |= marks[r >> 8]
                elif held > 0:
                    one[r], many[r] = -1, [held - 1, p]
                else:
                    many[r].append(p)
        while top:
            i = (top & -top).bit_length() - 1
            word = words[i]
            bit = word & -word
            rank = i << 8 | bit.bit_length() - 1
            p = one[rank] - 1
            if p >= 0 or len(many[rank]) == 1:
                if p < 0:
                    p = many.pop(rank)[0]
                one[rank] = 0
                words[i] = word = word ^ bit
                if not word:
                    top ^= marks[i]
            else:
                p = heapq.heappop(many[rank])
            if pair[p] != rank:
                continue  # stale
            q = after[p]
            pair[q] = None
            end = after[p] = after[q]
            r = None
            if end < n:
                before[end] = p
                if (stop := after[end]) - p <= longest:
                    r = get(raw[p:stop])
            pair[p] = r
            if r is not None:
                if not (held := one[r]):
                    one[r] = p + 1
                    words[r >> 8] |= marks[r & 255]
                    top |= marks[r >> 8]
                elif held > 0:
                    one[r], many[r] = -1, sorted((held - 1, p))
                else:
                    heapq.heappush(many[r], p)
            if p:
                o = before[p]
                r = get(raw[o:end]) if end - o <= longest else None
                pair[o] = r
                if r is not None:
                    if not (held := one[r]):
                        one[r] = o + 1
                        words[r >> 8] |= marks[r & 255]
                        top |= marks[r >> 8]
                    elif held > 0:
                        one[r], many[r] = -1, sorted((held - 1, o))
                    else:
                        heapq.heappush(many[r], o)
        ids, p = [], 0
        while p < n:
            q = after[p]
            ids.append(ranks[raw[p:q]])
            p = q
        return ids

    def encode(self, text: str) -> np.ndarray:
        split = self.split_ascii if text.isascii() else self.split
        return np.frombuffer(b"".join(map(self.__getitem__, split(text))), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begins[ids] - ends + lengths, lengths)].tobytes()


_codecs: dict[tuple[str, str], Codec] = {}


def codec(rank_file: str, pattern: str) -> Codec:
    """One codec for each vocabulary and worker."""
    key = (rank_file, pattern)
    if key not in _codecs:
        _codecs[key] = Codec(*key)
    return _codecs[key]


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    at = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(ids)))


def encode(docs: DataFrame, rank_file: str, pattern: str, decoded: bool = False) -> DataFrame:
    """(doc_id, ids array<int>) of each row's whole text, read from columns doc_id and text alone.

    With ``decoded``, also what the ids decode to (binary), by the same worker. Null and empty texts have no ids. Repeated rows
    each give a row. An empty table gives no rows.
    """

    def run(batches):
        own = codec(rank_file, pattern)
        for batch in batches:
            for part in slices(batch, 2 << 20):
                ids = [own.encode(t or "") for t in part.column("text").to_pylist()]
                columns = [part.column("doc_id"), _lists(ids)]
                if decoded:
                    columns.append(pa.array([own.decode(x) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])
        own.older = {}  # the worker may be idle for long

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return spread(rows).mapInArrow(tidy(run), "doc_id long, ids array<int>" + ", decoded binary" * decoded)


def decode(tokens: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded binary): the bytes that the ids stand for. Null ids are decoded as none."""

    def run(batches):
        own = codec(rank_file, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids = part.column("ids")
                at, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
                out = [own.decode(flat[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, pa.array(out, pa.binary())], names=["doc_id", "ids", "decoded"])

    return tokens.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(tidy(run), "doc_id long, ids array<int>, decoded binary")
