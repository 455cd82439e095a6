"""Sparse features: byte n-grams of a text, parsed facts, and the record's own port.

A feature vector is array<struct<i:int,v:float>> in order of i. Facts and ports are expressions. Byte n-grams of a text
are counted in Arrow batches: as expressions they would need a row for each byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StructField, StructType

from tarn.contract import BITS, BYTE_FEATURES, ENUMS, FACT_FEATURES, NUMERIC, PORT_FEATURES, SEMANTIC_ENUMS
from tarn.functions.values import let

VECTOR = "array<struct<i:int,v:float>>"
VECTOR_TYPE = ArrayType(StructType([StructField("i", IntegerType()), StructField("v", FloatType())]))
_DOUBLES = "array<struct<i:int,v:double>>"


#: Sparse entries of many rows at once: row, index and value of each. Inside a row they stand in order of their index.
Entries = tuple[np.ndarray, np.ndarray, np.ndarray]
#: Rows and bytes of texts that are counted at once: keys of row and code have to fit 32 bits.
_ROWS, _BYTES = 4096, 4 << 20


def _byte_block(texts: list[bytes]) -> Entries:
    """Codes of each text's bytes and byte pairs (256 + 256 a + b) and their weights 1 + ln(count), of length 1 together."""
    b = np.frombuffer(b"".join(texts), dtype=np.uint8)
    base = np.repeat(np.arange(len(texts), dtype=np.uint32) * np.uint32(BYTE_FEATURES), [len(t) for t in texts])
    pairs = (base[:-1] + np.uint32(256) + b[:-1].astype(np.uint32) * np.uint32(256) + b[1:])[base[:-1] == base[1:]]
    keys = np.concatenate((base + b, pairs))
    keys.sort()
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    row, code = np.divmod(keys[first], np.uint32(BYTE_FEATURES))
    w = 1 + np.log(np.diff(np.append(first, len(keys))))
    norm = np.sqrt(np.bincount(row, w * w, len(texts)))
    return row.astype(np.int64), code.astype(np.int32), (w / norm[row]).astype(np.float32)


def byte_entries(texts: list[str]) -> Entries:
    """``_byte_block`` of any number of texts."""
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(t) for t in encoded])
    found, at = [], 0
    while at < len(encoded):
        before = ends[at - 1] if at else 0
        stop = min(at + _ROWS, max(at + 1, int(np.searchsorted(ends, before + _BYTES, "right"))))
        row, code, w = _byte_block(encoded[at:stop])
        found.append((row + at, code, w))
        at = stop
    return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32))


def byte_vectors(texts: list[str | None]) -> pa.ListArray:
    """``byte_entries`` as sparse vectors; a null vector for None."""
    row, code, w = byte_entries([t or "" for t in texts])
    ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(texts))))).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(code), pa.array(w)], names=["i", "v"])
    return pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array([t is None for t in texts], pa.bool_()))


@F.arrow_udf(VECTOR_TYPE)
def _byte_vector(texts: pa.Array) -> pa.Array:
    return byte_vectors([t or "" for t in texts.to_pylist()])


def byte_vector(text: Column) -> Column:
    """Byte and byte-pair weights 1 + ln(count), of length 1 together; an empty text has none."""
    return _byte_vector(text).cast(VECTOR)


def _entry(index: Column, value: Column) -> Column:
    return F.struct(index.cast("int").alias("i"), value.cast("double").alias("v"))


def _one_hot(value: Column, names: list[str], base: int) -> Column:
    at = F.array_position(F.array(*map(F.lit, names)), F.lower(value))
    return F.when(at > 0, _entry(at - 1 + base, F.lit(1.0)))


def _transport(value: Column, base: int) -> Column:
    """As ``_one_hot``, without an array of all protocol numbers."""
    named = ENUMS["transport_protocol"][:4]
    digits = F.regexp_extract(F.lower(value), r"\Aipproto_([0-9]|[1-9][0-9]{1,2})\z", 1).try_cast("int")
    return F.coalesce(_one_hot(value, named, base), F.when(digits <= 255, _entry(digits + len(named) + base, F.lit(1.0))))


def _bits(value: Column, width: int, missing: int, base: int) -> Column:
    """Entries of the bits that are set; of a fact that wasn't observed those of its sentinel, which are constant."""
    sentinel = F.array(*[_entry(F.lit(base + k), F.lit(1.0)) for k in range(width) if missing >> k & 1])
    set_ = F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.call_function("getbit", value.cast("long"), k) == 1)
    return F.when(value.isNull(), sentinel).otherwise(F.transform(set_, lambda k: _entry(k + base, F.lit(1.0))))


def raw_fact_vector(facts: Column) -> Column:
    """Non-zero parsed-fact columns before normalisation, in order of their index. Facts that weren't observed set the bits of their sentinels."""
    base = 0
    before, bits, after = [], [], []
    for name, names in ENUMS.items():
        before.append(_transport(facts[name], base) if name == "transport_protocol" else _one_hot(facts[name], names, base))
        base += len(names)
    for name in NUMERIC:
        before.append(F.when(facts[name].isNotNull(), _entry(F.lit(base), 1 + F.log1p(facts[name]))))
        base += 1
    for name, (width, missing) in BITS.items():
        bits.append(_bits(facts[name], width, missing, base))
        base += width
    leave = facts["exit_category"]
    after.append(F.when(leave != 0, _entry(F.lit(base), F.signum(leave) * F.log1p(F.abs(leave)))))
    base += 2
    for name, names in SEMANTIC_ENUMS.items():
        after.append(_one_hot(facts[name], names, base))
        base += len(names)
    return F.concat(F.array_compact(F.array(*before)), *bits, F.array_compact(F.array(*after))).cast(_DOUBLES)


def fact_error(facts: Column) -> Column:
    """Why facts can't be encoded, or null."""

    out = F.when(F.lit(False), "")
    for name in NUMERIC:
        out = out.when((facts[name] < 0) | F.isnan(facts[name]) | (facts[name] == float("inf")), F.lit(f"fact_encoding_error:{name}"))
    for name, (_, missing) in BITS.items():
        out = out.when((facts[name] < 0) | (facts[name] > missing), F.lit(f"fact_encoding_error:{name}"))
    for name, names in SEMANTIC_ENUMS.items():  # a value of the decoders' own that has no column
        out = out.when(~F.lower(facts[name]).isin(*names), F.lit(f"fact_encoding_error:{name}"))
    return out


def normalised(vector: Column) -> Column:
    """A vector of length 1; one of zeros stays."""

    def scaled(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, e: s + e["v"] * e["v"]))
        return let(norm, lambda n: F.transform(v, lambda e: F.struct(e["i"].alias("i"), F.when(n > 0, e["v"] / n).otherwise(e["v"]).alias("v"))))

    return let(vector, scaled)


def fact_vector(facts: Column) -> Column:
    return let(facts, lambda f: normalised(raw_fact_vector(f))).cast(VECTOR)


def _hot(values: pa.Array, names: list[str], base: int) -> Entries:
    """``_one_hot`` of a column."""
    found, at = values.dictionary_encode(), {n: k + base for k, n in enumerate(names)}
    code = np.array([*(at.get(v.lower(), -1) for v in found.dictionary.to_pylist()), -1])[found.indices.fill_null(len(found.dictionary)).to_numpy(zero_copy_only=False)]
    row = np.flatnonzero(code >= 0)
    return row, code[row], np.ones(len(row))


def fact_entries(facts: pa.StructArray) -> Entries:
    """``fact_vector`` of a column of facts in Arrow: entries by field, so not in order of their rows. Null facts have none."""
    given, column = facts.is_valid().to_numpy(zero_copy_only=False), dict(zip((f.name for f in facts.type), facts.flatten(), strict=True))
    found, base = [], 0

    def some(name: str) -> tuple[np.ndarray, np.ndarray]:
        row = np.flatnonzero(column[name].is_valid().to_numpy(zero_copy_only=False))
        return row, column[name].drop_null().to_numpy(zero_copy_only=False)

    for name, names in ENUMS.items():
        found.append(_hot(column[name], names, base))
        base += len(names)
    for name in NUMERIC:
        row, value = some(name)
        found.append((row, np.full(len(row), base), 1 + np.log1p(value)))
        base += 1
    for name, (width, missing) in BITS.items():
        value = np.where(given, column[name].cast(pa.int64()).fill_null(missing).to_numpy(zero_copy_only=False), 0)
        row, bit = np.nonzero(value[:, None] >> np.arange(width) & 1)
        found.append((row, bit + base, np.ones(len(row))))
        base += width
    row, value = some("exit_category")
    row, value = row[value != 0], value[value != 0].astype(np.float64)
    found.append((row, np.full(len(row), base), np.sign(value) * np.log1p(np.abs(value))))
    base += 2
    for name, names in SEMANTIC_ENUMS.items():
        found.append(_hot(column[name], names, base))
        base += len(names)
    row, index, value = map(np.concatenate, zip(*found, strict=True))
    norm = np.sqrt(np.bincount(row, value * value, len(facts)))
    norm[norm == 0] = 1
    return row, index, (value / norm[row]).astype(np.float32)


def port_entries(port: pa.Array, message_port: pa.Array) -> Entries:
    """``port_vector`` of columns in Arrow: entries by kind, so not in order of their rows."""
    known, said = (p.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False) for p in (port, message_port))
    row, bit = np.nonzero(np.where(known >= 0, known, 0)[:, None] >> np.arange(16) & 1)
    seen, differ = np.flatnonzero(known >= 0), np.flatnonzero((known >= 0) & (said >= 0) & (known != said))
    rows = np.concatenate((row, seen, differ))
    return rows, np.concatenate((bit, np.full(len(seen), 16), np.full(len(differ), 17))), np.full(len(rows), 1 / np.sqrt(PORT_FEATURES), np.float32)


def record_port(value: Column) -> Column:
    """(port, state) of a record's port as it was given: digits alone count, without blanks or a decimal point."""
    return let(value.cast("string"), _record_port)


def _record_port(text: Column) -> Column:
    digits = text.rlike(r"\A[0-9]+\z")
    n = F.regexp_replace(text, r"\A0+(?=[0-9])", "")
    known = digits & (F.length(n) <= 5) & (n.try_cast("int") <= 65535)
    state = F.when(text.isNull(), "null").when(text.rlike(r"(?U)\A\s*\z"), "empty").when(~digits, "opaque_or_noncanonical").when(known, "observed").otherwise("outside_port_domain")
    return F.struct(F.when(known, n.try_cast("int")).alias("port"), state.alias("state"))


def port_conflict(port: Column, message_port: Column) -> Column:
    """Whether the record's port and the message's are both observed and differ."""
    return F.coalesce(port != message_port, F.lit(False))


def port_vector(port: Column, message_port: Column) -> Column:
    """Sixteen bits, observed, conflict; each is 1 / sqrt(18)."""
    one = F.lit(1.0) / F.sqrt(F.lit(float(PORT_FEATURES)))
    bits = F.transform(F.filter(F.sequence(F.lit(0), F.lit(15)), lambda k: F.call_function("getbit", port.cast("long"), k) == 1), lambda k: _entry(k, one))
    marks = F.filter(F.array(_entry(F.lit(16), one), F.when(port_conflict(port, message_port), _entry(F.lit(17), one))), lambda e: e.isNotNull())
    return F.when(port.isNotNull(), F.concat(bits, marks)).otherwise(F.array().cast(_DOUBLES)).cast(VECTOR)


def shifted(vector: Column, by: int) -> Column:
    return F.transform(vector, lambda e: F.struct((e["i"] + by).alias("i"), e["v"].alias("v")))


def full_vector(text: Column, facts: Column, port: Column) -> Column:
    """The whole vector: byte n-grams, facts and port, in this order; null for a null text."""
    return F.concat(text, shifted(facts, BYTE_FEATURES), shifted(port, BYTE_FEATURES + FACT_FEATURES)).cast(VECTOR)
