"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

A document is contaminated by an item if it holds at least ``num / den`` of the item's distinct ``width``-word shingles.

1. *Partition.* Items are partitioned by the size of their shingle sets (powers of two), since a short item and a long
   document have a Jaccard similarity near 0, whatever the containment.
2. *Sign.* An item's signature is its bottom-j MinHash sketch: the j shingles with the smallest hashes, where j is what the item
   may lack plus ``1 + SPARE``. A document's signature for a partition is all of its hashes below the partition's bound,
   the largest hash in the sketches of its items. So it grows with the document, and containment can be read from the two.
3. *Search.* An item that may lack m shingles is a candidate where at least j - m of its sketch are in the document's
   signature; a contained item can't have fewer, so nothing is missed. A partition is searched only in documents large enough.
4. *Verify.* The shingles of a candidate are counted exactly, their bytes compared with the document's.

Documents are read where they lie and never shuffled. The benchmark is searched in blocks of about ``BLOCK_BYTES`` of text, so
what is sent to executors is bounded whatever its size; each further block is one more pass over the documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import parts_for, slices, text_bytes, tidy
from tarn.llm.words import Words, short_shingle
from tarn.sources.spread import spread

#: Benchmark text that is searched for at once.
BLOCK_BYTES = 32 << 20
#: Shingles of a sketch beyond the one that has to be found; more of them make fewer false candidates.
SPARE = 2


def _item_shingles(texts: pa.Array, width: int) -> list[dict[bytes, int]]:
    """The distinct shingles of each text, as bytes (words joined by one space), with their hashes."""
    words = Words(texts, lower=True)
    h = words.hashes()
    rolling = words.windows(h, width)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        own = [words.bytes[s:e].tobytes() for s, e in zip(words.starts[a:b].tolist(), words.ends[a:b].tolist(), strict=True)]
        if b - a >= width:
            out.append({b" ".join(own[k : k + width]): int(rolling[a + k]) for k in range(b - a - width + 1)})
        else:
            out.append({b" ".join(own): int(short_shingle(h[a:b])[0])} if own else {})
    return out


class Searcher:
    """The signatures of one block of items, by size partition."""

    def __init__(self, items: list[tuple[int, dict[bytes, int]]], width: int, num: int, den: int):
        self.width, self.num, self.den = width, num, den
        items = sorted(((i, s) for i, s in items if s), key=lambda x: len(x[1]))
        self.ids = [i for i, _ in items]
        self.shingles = [list(s) for _, s in items]
        self.sets = [np.array(list(s.values()), dtype=np.uint64) for _, s in items]
        self.sizes = np.array([len(s) for s in self.sets], dtype=np.int64)
        self.needed = -(-num * self.sizes // den)
        sketch = np.minimum(self.sizes, self.sizes - self.needed + 1 + SPARE)
        #: shingles of the sketch that a document must hold
        self.least = sketch - (self.sizes - self.needed)
        self.partitions = []
        classes = np.log2(np.maximum(self.sizes, 1)).astype(int)
        for c in np.unique(classes):
            members = np.flatnonzero(classes == c)
            lowest = [np.sort(self.sets[m])[: sketch[m]] for m in members]
            hashes, owners = np.concatenate(lowest), np.repeat(members, sketch[members])
            order = np.argsort(hashes, kind="stable")
            first = np.zeros(1 << 16, dtype=bool)
            first[(hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
            self.partitions.append((int(self.needed[members].min()), hashes.max(), hashes[order], owners[order], first))

    def search(self, texts: pa.Array) -> tuple[list[int], list[int], list[int]]:
        """Index of the text, index of the item, and shared shingles, for each containment."""
        words = Words(texts, lower=True)
        rolling, at, begins, lengths = self._shingles(words)
        docs, found, shared, candidates = [], [], [], []
        size_of = np.bincount(at, minlength=words.docs)  # windows; at least the distinct shingles
        for least, bound, hashes, owners, first in self.partitions:
            signed = np.flatnonzero(first[(rolling & np.uint64(0xFFFF)).astype(np.int64)] & (rolling <= bound))
            signed = signed[size_of[at[signed]] >= least]
            left = np.searchsorted(hashes, rolling[signed], side="left")
            n = np.searchsorted(hashes, rolling[signed], side="right") - left
            hit, owner = np.repeat(signed, n), owners[np.repeat(left - np.cumsum(n) + n, n) + np.arange(n.sum())]
            triples = np.unique(np.stack((at[hit].astype(np.uint64), owner.astype(np.uint64), rolling[hit]), axis=1), axis=0)
            pairs, times = np.unique(triples[:, :2].astype(np.int64), axis=0, return_counts=True)
            candidates.append(pairs[times >= self.least[pairs[:, 1]]])
        pairs = np.concatenate(candidates) if candidates else np.zeros((0, 2), np.int64)
        edges = np.searchsorted(at, np.arange(words.docs + 1))
        last, own, place = -1, None, None
        for d, m in pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))].tolist():
            if d != last:
                order = np.argsort(rolling[edges[d] : edges[d + 1]], kind="stable")
                last, place = d, order + edges[d]
                own = rolling[place]
            low, high = np.searchsorted(own, self.sets[m], side="left"), np.searchsorted(own, self.sets[m], side="right")
            n = sum(any(self._words(words, begins[p], lengths[p]) == self.shingles[m][k] for p in place[low[k] : high[k]]) for k in np.flatnonzero(high > low))
            if n >= self.needed[m]:
                docs.append(d)
                found.append(m)
                shared.append(n)
        return docs, found, shared

    @staticmethod
    def _words(words: Words, begin: int, length: int) -> bytes:
        return b" ".join(words.bytes[words.starts[k] : words.ends[k]].tobytes() for k in range(begin, begin + length))

    def _shingles(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all shingles, in order of the texts: the hash, the text, the first word and the number of words."""
        h = words.hashes()
        begins = np.flatnonzero(words.whole(self.width))
        rolling, at = words.windows(h, self.width)[begins], words.doc_of(begins)
        lengths = np.full(len(begins), self.width)
        short = np.flatnonzero((words.counts > 0) & (words.counts < self.width))
        if len(short):
            ones = [short_shingle(h[words.first[d] : words.first[d + 1]]) for d in short.tolist()]
            rolling, at = np.concatenate((rolling, *ones)), np.concatenate((at, short))
            begins, lengths = np.concatenate((begins, words.first[short])), np.concatenate((lengths, words.counts[short]))
            order = np.argsort(at, kind="stable")
            rolling, at, begins, lengths = rolling[order], at[order], begins[order], lengths[order]
        return rolling, at, begins, lengths


def _blocks(benchmark: DataFrame, width: int, num: int, den: int):
    """Searchers over all items, a bounded number of bytes at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    _, total = text_bytes(items)
    parts = parts_for(total, BLOCK_BYTES)
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        texts = pa.array([r["text"] for r in rows], pa.string())
        yield Searcher(list(zip([r["item_id"] for r in rows], _item_shingles(texts, width), strict=True)), width, num, den)


def contaminations(docs: DataFrame, benchmark: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared): every document row with every item row that it contains.

    Reads doc_id, item_id and text alone. A-Z is lower-cased; a word is ``[^\\x20\\x09-\\x0D]+``; a text with fewer words than
    ``width`` has one shingle, its whole sequence, so such an item is found only in documents that are this sequence. Null and wordless texts contain nothing and aren't contained. Repeated
    rows on either side give repeated rows. Null ids are passed on. Empty tables give no rows.
    """
    rows = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    out = None
    for block in _blocks(benchmark, width, num, den):

        def run(batches, own=docs.sparkSession.sparkContext.broadcast(block)):
            searcher = own.value
            for batch in batches:
                for part in slices(batch):
                    d, m, n = searcher.search(part.column("text"))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(d, pa.int64())), pa.array([searcher.ids[k] for k in m], pa.int64()), pa.array([int(searcher.sizes[k]) for k in m], pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "item_id", "n_shingles", "n_shared"])

        found = rows.mapInArrow(tidy(run), "doc_id long, item_id long, n_shingles long, n_shared long")
        out = found if out is None else out.unionAll(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` that contain no item, all columns kept; see ``contaminations`` for the rules."""
    docs = spread(docs)
    for block in _blocks(benchmark, width, num, den):

        def run(batches, own=docs.sparkSession.sparkContext.broadcast(block)):
            for batch in batches:
                for part in slices(batch):
                    keep = np.ones(part.num_rows, dtype=bool)
                    keep[own.value.search(part.column("text"))[0]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs
