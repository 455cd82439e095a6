"""The dispatcher: a route, whether it is supported, and typed facts for every message."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType, StructField, StructType

from tarn.contract import FACTS, facts, with_facts
from tarn.operators import decoders
from tarn.sources.spread import spread

_NESTED = StructType([StructField("nested_route", StringType()), *FACTS.fields])


@F.arrow_udf(_NESTED)
def _nested(messages: pa.Array) -> pa.Array:
    """Route and facts of nested payloads; null for a null message."""
    from tarn.functions.lexical import decode_nested

    kind = to_arrow_type(_NESTED)
    if messages.null_count == len(messages):
        return pa.nulls(len(messages), kind)
    found = [raw if raw is None else decode_nested(raw) for raw in messages.to_pylist()]
    return pa.array([None if f is None else {"nested_route": f[0], **f[1]} for f in found], kind)


#: So that a filter on the facts isn't pushed below it, into a lambda that can't hold a worker's function.
_nested = _nested.asNondeterministic()

# Message types of RFC 792 and reasons of RFC 1812 that have names.
_ICMP = {0: "echo_reply", 8: "echo_request", 3: "destination_unreachable", 11: "time_exceeded", 12: "parameter_problem"}
_UNREACHABLE = {0: "network", 1: "host", 2: "protocol", 3: "port", 4: "fragmentation_needed", 5: "source_route", 13: "administratively_prohibited"}


def _named(code: Column, names: dict[int, str]) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for k, v in names.items():
        out = out.when(code == k, v)
    return out


def semantics(route: Column, found: Column) -> Column:
    """Facts with the meaning of ICMP types and of native authentication outcomes."""
    icmp = found["transport_protocol"] == "icmp"
    native = route.isin("windows_message", "windows_rendered", "syslog_auth", "syslog_body") & found["outcome"].isin("success", "failure")
    return with_facts(
        found,
        icmp_message=F.when(icmp, _named(found["icmp_type"], _ICMP)),
        icmp_unreachable=F.when(icmp & (found["icmp_type"] == 3), _named(found["icmp_code"], _UNREACHABLE)),
        auth_result=F.when(native, found["outcome"]).otherwise(found["auth_result"]),
    )


def classify(rows: DataFrame, message: str = "message_sanitized", beside: Callable[[Column, Column], dict[str, Column]] | None = None) -> DataFrame:
    """``rows`` with route, supported and facts, replacing columns of these names.

    The first decoder that accepts a message names the route. A null message is an empty one. Facts of literal
    firewall lines are added to messages that no decoder takes, without changing their route. Messages that can't hold
    a nested payload reach the Arrow decoder as nulls. ``beside`` makes further columns from the message and from whether it is
    an access-list denial; worker functions among them run in the same pass as the decoder of nested payloads.
    """
    raw = F.coalesce(F.col(message).cast("string"), F.lit(""))
    rows = spread(rows).drop("route", "supported", "facts").withColumn("__raw", raw)
    raw = F.col("__raw")
    maybe = F.contains(raw, F.lit('"')) | F.contains(raw, F.lit("CEF:")) | raw.rlike(r"(?U)\A<[\w-]+\s+xmlns=")
    # Each step is a column of its own rather than a lambda: Spark compiles expressions, but not lambdas.
    rows = rows.withColumn("__cells", decoders.vpc_cells(raw)).withColumn("__numbers", decoders.vpc_numbers(F.col("__cells")))
    line = F.coalesce(decoders.asa_deny(raw), decoders.syslog_body(raw), decoders.vpc_flow(F.col("__cells"), F.col("__numbers")), decoders.flow_line(raw))
    rows = rows.withColumn("__line", line).drop("__cells", "__numbers")
    asa = F.coalesce(F.col("__line")["route"] == "asa", F.lit(False))
    rows = rows.withColumns({"__nested": _nested(F.when(maybe, raw))} | (beside(raw, asa) if beside else {}))
    nested, line = F.col("__nested"), F.col("__line")
    as_decoded = F.struct(nested["nested_route"].alias("route"), F.lit(True).alias("supported"), F.struct(*[nested[f.name].alias(f.name) for f in FACTS.fields]).alias("facts"))
    unknown = F.struct(F.lit("unsupported").alias("route"), F.lit(False).alias("supported"), F.coalesce(decoders.firewall_patch(raw), facts()).alias("facts"))
    found = (
        F.when(raw.rlike(r"(?U)\A\s*\z"), decoders.decoded("empty", False))
        .when(line["route"] == "asa", line)
        .when(nested["nested_route"] != "bounded_payload", as_decoded)
        .when(line.isNotNull(), line)
        .when(nested["nested_route"].isNotNull(), as_decoded)
        .otherwise(unknown)
    )
    meant = lambda v: F.struct(v["route"].alias("route"), v["supported"].alias("supported"), semantics(v["route"], v["facts"]).alias("facts"))
    rows = rows.withColumn("__first", found).withColumn("__found", meant(F.col("__first")))
    return rows.withColumns({name: F.col("__found")[name] for name in ("route", "supported", "facts")}).drop("__raw", "__line", "__nested", "__first", "__found")
