"""The fixed contract: labels, routes, fact fields, and the layout of the feature vector."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

# Label classes in the order of their codes.
LABELS = ("benign", "malicious", "suspicious")

# Routes in the order of their precedence; the first decoder that accepts a message names its route.
ROUTES = (
    "empty", "asa", "authentication", "cef_fields", "windows_message", "windows_rendered", "syslog_auth", "syslog_body", "audit_fields", "asa_acl", "asa_protocol", "format_payload", "vpc_v2", "native_flow", "native_firewall",
    "bounded_payload", "unsupported",
)

# Enumerated facts and their values, in the order of their one-hot columns.
ENUMS: dict[str, list[str]] = {
    "action": ["allow", "deny", "open", "close"],
    "outcome": ["success", "failure", "allowed", "blocked"],
    "credential_check": ["valid", "invalid"],
    "response": ["missing"],
    "src_role": ["inside", "outside", "dmz", "identity", "internet"],
    "dst_role": ["inside", "outside", "dmz", "identity", "internet"],
    "transport_protocol": ["tcp", "udp", "icmp", "icmp6", *(f"ipproto_{n}" for n in range(256))],
    "application_protocol": ["http", "https", "http1", "http1.0", "http1.1", "http2", "http3", "tls", "tlsv1", "tlsv1.0", "tlsv1.1", "tlsv1.2", "tlsv1.3", "tls1.0", "tls1.1", "tls1.2", "tls1.3"],
    "src_port_range": ["system", "user", "dynamic"],
    "dst_port_range": ["system", "user", "dynamic"],
    "operation_record": ["path", "syscall", "cwd", "proctitle", "execve"],
    "authentication_protocol": ["kerberos", "ntlm", "negotiate", "msv1_0", "digest"],
}

# Counted facts, encoded as 1 + log1p.
NUMERIC = ("attempt_count", "duration_seconds", "bytes", "bytes_in", "bytes_out", "packets", "keylength")

# Facts encoded as little-endian bits: width, and the value that stands for "not observed".
BITS: dict[str, tuple[int, int]] = {
    "icmp_type": (9, 256),
    "icmp_code": (9, 256),
    "http_status": (10, 1023),
    "logontype": (9, 256),
    "status": (33, 2**32),
    "substatus": (33, 2**32),
    "src_port_fixed": (17, 65536),
    "dst_port_fixed": (17, 65536),
}

# Facts that the semantic step adds, with their one-hot values.
SEMANTIC_ENUMS: dict[str, list[str]] = {
    "icmp_message": ["echo_request", "echo_reply", "destination_unreachable", "time_exceeded", "parameter_problem"],
    "icmp_unreachable": ["network", "host", "protocol", "port", "fragmentation_needed", "source_route", "administratively_prohibited"],
    "auth_result": ["success", "failure"],
    "policy_decision": ["allowed", "denied"],
    "authentication_interaction": ["no_response"],
}

#: Facts of a record; null means not observed. status and substatus are the codes' values; exit_category is the signed exit code.
FACTS = StructType(
    [StructField(k, StringType()) for k in ENUMS]
    + [StructField(k, DoubleType()) for k in NUMERIC]
    + [StructField(k, LongType() if k.endswith("status") and k != "http_status" else IntegerType()) for k in BITS]
    + [StructField("exit_category", LongType())]
    + [StructField(k, StringType()) for k in SEMANTIC_ENUMS]
)

BYTE_FEATURES = 256 + 65536
FACT_FEATURES = sum(map(len, ENUMS.values())) + len(NUMERIC) + sum(w for w, _ in BITS.values()) + 2 + sum(map(len, SEMANTIC_ENUMS.values()))
PORT_FEATURES = 18
WIDTH = BYTE_FEATURES + FACT_FEATURES + PORT_FEATURES
#: Longest body that the sequence model reads; longer ones fall back and are never cut.
MAX_BODY_BYTES = 176


def facts(**observed: Column) -> Column:
    """A struct of FACTS with the given fields; the others are null."""
    return F.struct(*[observed.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in FACTS.fields])


def with_facts(base: Column, **changed: Column) -> Column:
    """A struct of FACTS like ``base`` with some fields changed."""
    return F.struct(*[(changed[f.name] if f.name in changed else base.getField(f.name)).cast(f.dataType).alias(f.name) for f in FACTS.fields])


def fact_names() -> list[str]:
    """Names of the parsed-fact columns, in their order."""
    names = [f"{k}={v}" for k, values in ENUMS.items() for v in values]
    names += [f"numeric:{k}" for k in NUMERIC]
    names += [f"{k}:bit{i}" for k, (width, _) in BITS.items() for i in range(width)]
    names += ["exit_signed", "syscall_ordinal"]
    return names + [f"{k}={v}" for k, values in SEMANTIC_ENUMS.items() for v in values]
