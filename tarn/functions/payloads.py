"""Views of nested payloads that reports and audits read: bounded payload values, and the fields of authentication objects."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tarn.functions import lexical

_VALUES = ArrayType(StructType([StructField("path", StringType()), StructField("value", StringType())]))
_FIELDS = ArrayType(StructType([StructField("name", StringType()), StructField("value", StringType()), StructField("state", StringType())]))


@F.pandas_udf(_VALUES)
def payloads(messages: pd.Series) -> pd.Series:
    """(path, value) of the strings that make a message a bounded payload, in their order; null for a null message."""
    return messages.map(lambda raw: None if raw is None else [{"path": ".".join(p), "value": v} for p, v in lexical.bounded_payloads(raw)])


@F.pandas_udf(_FIELDS)
def authentication_fields(messages: pd.Series) -> pd.Series:
    """(name, value, state) of the members of a message's one authentication object; null without one.

    state: kept for a readable scalar, removed for a redacted identity, unknown for a broken or nested value (without value).
    """

    def view(raw: str | None):
        found = None if raw is None else lexical.authentication_object(raw)
        if found is None:
            return None
        part, top = found
        out = []
        for m in top:
            value = lexical.scalar(part[m.value : m.end]) if part[m.value] not in "{[" else None
            if value is None:
                out.append({"name": m.path[0], "value": None, "state": "unknown"})
            elif lexical.MARKER.search(str(value)):
                out.append({"name": m.path[0], "value": None, "state": "removed"})
            else:
                out.append({"name": m.path[0], "value": str(value), "state": "kept"})
        return out

    return messages.map(view)
