"""Vectorised word splitting and hashing of whole Arrow batches of UTF-8 texts.

A word is a match of ``[^\\x20\\x09-\\x0D]+``. All separators are ASCII, so words are cut
on the UTF-8 bytes. Nothing here looks at one document or one word at a time in Python.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words that are hashed at once; their scratch memory stays in the processor's cache.
_BLOCK = 1 << 15
#: Odd constants of the three independent families of hashes.
_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
#: Words of more bytes are hashed one by one.
_LONG = 64
#: For 0 to 8 bytes, the lanes' bits that belong to a word.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def pair(a: np.ndarray, b: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of two hashes in their order; not linear in either, so no pattern of words cancels out."""
    h = a * np.uint64(_SEEDS[seed])
    h ^= h >> np.uint64(32)
    h += b
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def short_shingle(h: np.ndarray) -> np.ndarray:
    """The one shingle of a text with fewer words than a shingle has, from its words' hashes."""
    one = np.array([len(h)], dtype=np.uint64)
    for k in range(len(h)):
        one = mix(one * np.uint64(31) + h[k : k + 1])
    return one


class Words:
    """The words of a batch: byte ranges, and the range of words of each document."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray, lower: bool = False):
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.cast(pa.large_string()).chunks) if texts.num_chunks else pa.array([], pa.large_string())
        texts = texts.cast(pa.large_string())
        if texts.null_count:
            texts = texts.fill_null("")
        self.docs = len(texts)
        if self.docs:
            offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + self.docs + 1]
            data = texts.buffers()[2]
            raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
            raw = raw[offsets[0] : offsets[-1]]
            self.offsets = offsets - offsets[0]
        else:
            raw, self.offsets = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.raw = raw
        self.bytes = _LOWER[raw] if lower else raw
        n = len(raw)
        inside = np.zeros(n + 2, dtype=bool)
        np.logical_not(_SPACE[raw], out=inside[1 : n + 1])
        begins = inside[1 : n + 1] & ~inside[:n]
        ends = inside[1 : n + 1] & ~inside[2:]
        inner = self.offsets[1:-1]
        cut = inner[(inner > 0) & (inner < n)]
        begins[cut] = inside[cut + 1]
        ends[cut - 1] = inside[cut]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(ends) + 1
        #: words of document i are first[i] to first[i + 1]
        self.first = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, seed: int = 0, size: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word's bytes, or of its first ``size`` bytes.

        Eight bytes at a time are mixed in, not linearly; words of more than 64 bytes are hashed by BLAKE2b.
        """
        out = np.empty(len(self), dtype=np.uint64)
        padded = np.concatenate((self.bytes, np.zeros(8, np.uint8)))
        lanes = np.ndarray((len(self.bytes) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
        salt = _SEEDS[seed].to_bytes(8, "little")
        for at in range(0, len(self), _BLOCK):
            start = self.starts[at : at + _BLOCK]
            length = self.ends[at : at + _BLOCK] - start
            if size is not None:
                length = np.minimum(length, size)
            h = length.astype(np.uint64)
            h += np.uint64(_SEEDS[seed])
            live, begin = np.arange(len(start)), start
            for k in range(_LONG // 8):
                rest = length[live] - 8 * k if k else length
                lane = lanes[begin + 8 * k] & _KEEP[np.minimum(rest, 8)]
                if k:
                    h[live] = pair(h[live], lane, seed)
                else:
                    h = pair(h, lane, seed)
                live = live[rest > 8]
                if not len(live):
                    break
                begin = start[live]
            for k in np.flatnonzero(length > _LONG).tolist():
                word = self.bytes[start[k] : start[k] + length[k]]
                h[k] = int.from_bytes(hashlib.blake2b(word.tobytes(), digest_size=8, key=salt).digest(), "little")
            out[at : at + _BLOCK] = h
        return out

    def windows(self, hashes: np.ndarray, width: int, seed: int = 1) -> np.ndarray:
        """A 64-bit hash of the ``width`` words from each word on; see ``whole`` for the ones within a document.

        Two windows of half the length are mixed into one, not linearly, so windows of the same words in another order differ.
        """
        n = len(hashes) - width + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        if width <= 4:
            out = hashes[:n] + np.uint64(_SEEDS[seed])
            for k in range(1, width):
                out = pair(out, hashes[k : n + k], seed)
            return out if width > 1 else mix(out)
        out = np.empty(n, dtype=np.uint64)
        for at in range(0, n, _BLOCK):
            h, size = hashes[at : at + _BLOCK + width - 1] + np.uint64(_SEEDS[seed]), 1
            while size < width:
                step = min(size, width - size)  # the last two halves may overlap; together they are the window
                h = pair(h[:-step], h[step:], seed)
                size += step
            out[at : at + _BLOCK] = h
        return out

    def whole(self, width: int) -> np.ndarray:
        """Whether the window of ``width`` words from each word on (as many as ``windows`` returns) ends in its document."""
        n = len(self) - width + 1
        if n <= 0:
            return np.zeros(0, dtype=bool)
        ok = np.ones(len(self), dtype=bool)
        tail = np.minimum(self.counts, width - 1)
        stop = np.repeat(self.first[1:], tail)
        back = np.arange(len(stop)) - np.repeat(np.cumsum(tail) - tail, tail) + 1
        ok[stop - back] = False
        return ok[:n]

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first[1:], positions, side="right")

    def shingle_sets(self, width: int, hashes: np.ndarray | None = None) -> list[np.ndarray]:
        """Sorted distinct hashes of each document's ``width``-word shingles.

        Fewer words: the whole sequence is the one shingle. No words: an empty set.
        """
        h = self.hashes() if hashes is None else hashes
        w = self.windows(h, width)
        out = []
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True):
            if b - a >= width:
                out.append(np.unique(w[a : b - width + 1]))
            elif b > a:
                out.append(short_shingle(h[a:b]))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
        return out

    def joined(self, keep: np.ndarray) -> list[bytes]:
        """Per document, the words marked in ``keep`` joined by one space."""
        if not len(self):
            return [b""] * self.docs
        take = np.flatnonzero(keep)
        lengths = self.ends[take] - self.starts[take] + 1
        total = np.concatenate(([0], np.cumsum(lengths)))
        source = np.arange(total[-1]) - np.repeat(total[:-1] - self.starts[take], lengths)
        flat = np.append(self.raw, np.uint8(0x20))[source]
        flat[total[1:] - 1] = 0x20
        cuts = total[np.searchsorted(take, self.first)].tolist()
        data = flat.tobytes()
        return [data[a : max(a, b - 1)] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
