"""Packed messages between chunks of documents and ranges of hash values (buckets).

A chunk sends each bucket its distinct sorted hashes as differences. A bucket finds the entries that occur twice
or more over all chunks and answers one bit an entry. Buckets are equal ranges of hash values, so a chunk's answers in order of
their buckets are in the order of its sorted hashes: whoever recomputes these reads the answers by rank. A value
that very many documents hold is one entry a chunk, so no bucket is hot.
"""

from __future__ import annotations

import math
from itertools import pairwise

import numpy as np
import pyarrow as pa

from tarn.llm.common import parts_for

#: Bytes of text in a chunk, at least (unless more tasks than chunks are there to work), and in the smallest chunk.
CHUNK_BYTES, LEAST_BYTES = 8 << 20, 256 << 10
#: Bytes of input for each message, at least: chunks grow with the square root of the input, messages in proportion to it.
MESSAGE_BYTES = 640
MESSAGE = "step int, chunk int, bucket int, n long, wide boolean, gaps binary, check binary, often binary, asked binary"
ANSWER = "chunk int, step int, bucket int, n long, bits binary"


def chunks_for(total: int, tasks: int, chunk_bytes: int | None = None) -> int:
    """How many chunks, and as many buckets, suit ``total`` bytes of text.

    C chunks send C * C messages. With chunks of max(8 MB, sqrt(640 * total)) these are never more than total / 640: 8 MB up to
    100 GB, 253 MB for 100 TB. Small inputs are cut into one chunk a task, down to 256 KB.
    """
    if chunk_bytes is not None:
        return parts_for(total, chunk_bytes)
    return max(parts_for(total, max(CHUNK_BYTES, math.isqrt(MESSAGE_BYTES * total))), min(tasks, parts_for(total, LEAST_BYTES)))


def pack(bits: np.ndarray) -> bytes:
    return np.packbits(bits).tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n).astype(bool)


def gaps(sorted_values: np.ndarray) -> tuple[bool, bytes]:
    steps = np.diff(sorted_values, prepend=np.uint64(0))
    wide = bool(len(steps) > 1 and steps[1:].max() >> np.uint64(32))
    head = sorted_values[:1].astype("<u8").tobytes()
    return wide, head + steps[1:].astype("<u8" if wide else "<u4").tobytes()


def ungap(data: bytes, wide: bool) -> np.ndarray:
    if not data:
        return np.zeros(0, dtype=np.uint64)
    rest = np.frombuffer(data, dtype="<u8" if wide else "<u4", offset=8).astype(np.uint64)
    return np.cumsum(np.concatenate((np.frombuffer(data[:8], dtype="<u8"), rest)), dtype=np.uint64)


def messages(step: int, chunk: int, values: np.ndarray, top: int, often: np.ndarray, asked: np.ndarray | None, check: np.ndarray | None, buckets: int):
    """Split sorted values (below 2**top) by bucket; buckets are equal ranges of their upper bits. One pass over the buckets that are hit."""
    bucket = ((values >> np.uint64(top - 32)) * np.uint64(buckets)) >> np.uint64(32)
    edges = np.flatnonzero(np.diff(bucket, prepend=np.uint64(buckets)))
    out = {k: [] for k in ("step", "chunk", "bucket", "n", "wide", "gaps", "check", "often", "asked")}
    for lo, hi in pairwise([*edges.tolist(), len(values)]):
        wide, packed = gaps(values[lo:hi])
        for k, v in (("step", step), ("chunk", chunk), ("bucket", int(bucket[lo])), ("n", hi - lo), ("wide", wide), ("gaps", packed), ("check", None if check is None else check[lo:hi].tobytes()), ("often", pack(often[lo:hi])), ("asked", None if asked is None else pack(asked[lo:hi]))):
            out[k].append(v)
    return table(out, MESSAGE)


TYPES = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string(), "array<struct<start:long,stop:long>>": pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))}


def table(columns: dict, ddl: str) -> pa.Table:
    fields = [f.split(" ", 1) for f in ddl.split(", ")]
    return pa.table([pa.array(columns[k], type=TYPES[t]) for k, t in fields], names=[k for k, _ in fields])


def answers(rows: pa.Table, step: int) -> np.ndarray:
    picked = [r for r in rows.select(["step", "bucket", "n", "bits"]).to_pylist() if r["step"] == step]
    picked.sort(key=lambda r: r["bucket"])
    return np.concatenate([unpack(r["bits"], r["n"]) for r in picked]) if picked else np.zeros(0, dtype=bool)


def count(rows: pa.Table) -> pa.Table:
    """Of one bucket: which entries of each chunk occur twice or more over all chunks."""
    rows = rows.to_pylist()
    values = np.concatenate([ungap(r["gaps"], r["wide"]) for r in rows])
    often = np.concatenate([unpack(r["often"], r["n"]) for r in rows])
    if rows[0]["step"] == 1:
        order = np.argsort(values)
        s = values[order]
        same = s[1:] == s[:-1]
    else:
        checks = np.concatenate([np.frombuffer(r["check"], dtype="<u4") for r in rows])
        order = np.lexsort((checks, values))
        s, c = values[order], checks[order]
        same = (s[1:] == s[:-1]) & (c[1:] == c[:-1])
    twice = often[order]
    twice[1:] |= same
    twice[:-1] |= same
    found = np.empty(len(values), dtype=bool)
    found[order] = twice
    out, at = {k: [] for k in ("chunk", "step", "bucket", "n", "bits")}, 0
    for r in rows:
        bits = found[at : at + r["n"]]
        at += r["n"]
        if r["asked"] is not None:
            bits = bits[unpack(r["asked"], r["n"])]
        for k, v in (("chunk", r["chunk"]), ("step", r["step"]), ("bucket", r["bucket"]), ("n", len(bits)), ("bits", pack(bits))):
            out[k].append(v)
    return table(out, ANSWER)
