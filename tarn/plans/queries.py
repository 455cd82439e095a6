"""Registered queries of the log engine: each decodes lines made from table columns, or runs an operator over a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import features, masking, text
from tarn.functions.payloads import authentication_fields, payloads
from tarn.operators import coverage, metrics, scoring, summaries
from tarn.operators.decode import classify
from tarn.plans import lines
from tarn.plans.lines import table
from tarn.sources.raw import read_ids, read_raw
from tarn.sources.scratch import new_path
from tarn.sources.spread import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _decoded(made: DataFrame, *fields: str) -> DataFrame:
    keys = [c for c in made.columns if c != "message_sanitized"]
    return classify(made).select(*keys, "route", *[F.col(f"facts.{f}").alias(f) for f in fields])


_RANGE = "CASE WHEN {0} <= 1023 THEN 'system' WHEN {0} <= 49151 THEN 'user' WHEN {0} IS NOT NULL THEN 'dynamic' END"

_VPC_SQL = f"""
SELECT l_orderkey, l_linenumber, 'vpc_v2' AS route, CASE l_returnflag WHEN 'A' THEN 'allow' WHEN 'R' THEN 'deny' END AS action,
       CASE l_returnflag WHEN 'A' THEN 'allowed' WHEN 'R' THEN 'blocked' END AS outcome,
       CASE l_suppkey % 256 WHEN 6 THEN 'tcp' WHEN 17 THEN 'udp' WHEN 1 THEN 'icmp' WHEN 58 THEN 'icmp6' ELSE 'ipproto_' || (l_suppkey % 256) END AS transport_protocol,
       CAST(l_orderkey * 7 % 65536 AS INT) AS src_port_fixed, CAST(l_partkey * 13 % 65536 AS INT) AS dst_port_fixed,
       {_RANGE.format("(l_orderkey * 7 % 65536)")} AS src_port_range, {_RANGE.format("(l_partkey * 13 % 65536)")} AS dst_port_range,
       CAST(CAST(floor(l_quantity) AS BIGINT) AS DOUBLE) AS packets, CAST(CAST(floor(l_extendedprice) AS BIGINT) AS DOUBLE) AS bytes
FROM lineitem
"""


@query(_VPC_SQL)
def vpc_roundtrip(spark, sf_dir):
    return _decoded(lines.vpc(table(spark, sf_dir, "lineitem")), "action", "outcome", "transport_protocol", "src_port_fixed", "dst_port_fixed", "src_port_range", "dst_port_range", "packets", "bytes")


@query(f"SELECT route, action, count(*) AS n FROM ({_VPC_SQL}) GROUP BY route, action")
def vpc_action_counts(spark, sf_dir):
    return vpc_roundtrip(spark, sf_dir).groupBy("route", "action").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT o_orderkey, 'asa' AS route, 'deny' AS action, 'blocked' AS outcome, CASE o_orderkey % 3 WHEN 0 THEN 'tcp' WHEN 1 THEN 'udp' ELSE 'icmp' END AS transport_protocol,
       CASE o_custkey % 4 WHEN 0 THEN 'inside' WHEN 1 THEN 'outside' WHEN 2 THEN 'dmz' END AS src_role, 'outside' AS dst_role,
       CAST(o_orderkey % 65536 AS INT) AS src_port_fixed, CAST(CASE WHEN o_custkey % 5 <> 0 AND o_custkey % 70000 <= 65535 THEN o_custkey % 70000 END AS INT) AS dst_port_fixed,
       CAST(CASE WHEN o_orderkey % 3 = 2 THEN o_orderkey % 20 END AS INT) AS icmp_type, CAST(CASE WHEN o_orderkey % 3 = 2 THEN o_custkey % 14 END AS INT) AS icmp_code
FROM orders
""")
def asa_deny_roundtrip(spark, sf_dir):
    return _decoded(lines.asa(table(spark, sf_dir, "orders")), "action", "outcome", "transport_protocol", "src_role", "dst_role", "src_port_fixed", "dst_port_fixed", "icmp_type", "icmp_code")


@query("""
SELECT event_id, 'cef_fields' AS route, CASE user_id % 4 WHEN 0 THEN 'deny' WHEN 1 THEN 'allow' WHEN 2 THEN 'deny' END AS action,
       CASE user_id % 4 WHEN 0 THEN 'blocked' WHEN 1 THEN 'allowed' WHEN 2 THEN 'blocked' END AS outcome,
       CASE WHEN event_id % 3 = 1 THEN 'tcp' END AS transport_protocol, CASE WHEN event_id % 3 = 0 THEN 'https' END AS application_protocol,
       CAST(CASE WHEN event_id % 70000 <= 65535 THEN event_id % 70000 END AS INT) AS src_port_fixed, CAST(443 AS INT) AS dst_port_fixed,
       CAST(user_id AS DOUBLE) AS bytes_in, CAST(event_id % 977 AS DOUBLE) AS bytes_out, CAST(CASE WHEN event_id % 700 BETWEEN 100 AND 599 THEN event_id % 700 END AS INT) AS http_status
FROM events
""")
def cef_roundtrip(spark, sf_dir):
    return _decoded(lines.cef(table(spark, sf_dir, "events")), "action", "outcome", "transport_protocol", "application_protocol", "src_port_fixed", "dst_port_fixed", "bytes_in", "bytes_out", "http_status")


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN 'syslog_auth' ELSE 'syslog_body' END AS route, CASE c_custkey % 4 WHEN 1 THEN 'open' WHEN 2 THEN 'close' END AS action,
       CASE WHEN c_custkey % 4 = 0 OR (c_custkey % 4 = 3 AND c_acctbal < 0) THEN 'failure' WHEN c_custkey % 4 = 3 THEN 'success' END AS outcome,
       CASE WHEN c_custkey % 4 = 0 OR (c_custkey % 4 = 3 AND c_acctbal < 0) THEN 'failure' WHEN c_custkey % 4 = 3 THEN 'success' END AS auth_result,
       CAST(CASE WHEN c_custkey % 4 = 3 THEN c_custkey END AS DOUBLE) AS attempt_count, CAST(CASE WHEN c_custkey % 4 = 3 THEN 3600 * (c_custkey % 30) + 429 END AS DOUBLE) AS duration_seconds
FROM customer
""")
def syslog_auth_roundtrip(spark, sf_dir):
    return _decoded(lines.pam(table(spark, sf_dir, "customer")), "action", "outcome", "auth_result", "attempt_count", "duration_seconds")


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'unsupported' ELSE 'audit_fields' END AS route,
       CASE WHEN p_partkey % 11 <> 0 THEN CASE p_partkey % 5 WHEN 0 THEN 'path' WHEN 1 THEN 'syscall' WHEN 2 THEN 'cwd' WHEN 3 THEN 'proctitle' ELSE 'execve' END END AS operation_record,
       CASE WHEN p_partkey % 11 <> 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'success' ELSE 'failure' END END AS outcome, CAST(CASE WHEN p_partkey % 11 <> 0 THEN p_size - 25 END AS BIGINT) AS exit_category
FROM part
""")
def audit_roundtrip(spark, sf_dir):
    return _decoded(lines.audit(table(spark, sf_dir, "part")), "operation_record", "outcome", "exit_category")


@query("""
SELECT s_suppkey, 'native_flow' AS route,
       CASE WHEN s_suppkey % 4 = 3 THEN e WHEN e IS NULL OR e = p THEN p END AS action,
       CASE CASE WHEN s_suppkey % 4 = 3 THEN e WHEN e IS NULL OR e = p THEN p END WHEN 'deny' THEN 'blocked' WHEN 'allow' THEN 'allowed' END AS outcome,
       'udp' AS transport_protocol, CAST(CASE WHEN s_suppkey <= 65535 THEN s_suppkey END AS INT) AS src_port_fixed, CAST(53 AS INT) AS dst_port_fixed
FROM (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'allow' WHEN 1 THEN 'deny' END AS e, CASE s_suppkey % 4 WHEN 0 THEN 'allow' WHEN 1 THEN 'deny' WHEN 2 THEN 'deny' END AS p FROM supplier)
""")
def flow_decision_conflict(spark, sf_dir):
    return _decoded(lines.flow(table(spark, sf_dir, "supplier")), "action", "outcome", "transport_protocol", "src_port_fixed", "dst_port_fixed")


@query("""
SELECT o_orderkey, 'unsupported' AS route, CASE WHEN ok THEN CASE o_orderkey % 4 WHEN 0 THEN 'allow' WHEN 3 THEN 'alert' ELSE 'deny' END END AS action,
       CASE WHEN ok THEN CASE o_orderkey % 4 WHEN 0 THEN 'allowed' WHEN 1 THEN 'blocked' WHEN 2 THEN 'blocked' END END AS outcome,
       CASE WHEN ok THEN CASE o_custkey % 3 WHEN 0 THEN 'tcp' WHEN 1 THEN 'udp' ELSE 'icmp' END END AS transport_protocol,
       CAST(CASE WHEN ok AND o_custkey % 3 < 2 THEN o_orderkey % 65536 END AS INT) AS src_port_fixed, CAST(CASE WHEN ok AND o_custkey % 3 < 2 THEN o_custkey % 65536 END AS INT) AS dst_port_fixed
FROM (SELECT *, o_orderkey % 7 <> 0 AS ok FROM orders)
""")
def panos_roundtrip(spark, sf_dir):
    return _decoded(lines.panos(table(spark, sf_dir, "orders")), "action", "outcome", "transport_protocol", "src_port_fixed", "dst_port_fixed")


@query(f"""
SELECT o_orderkey, 'unsupported' AS route, 'deny' AS action, 'blocked' AS outcome, CASE WHEN o_orderkey % 2 = 0 THEN 'tcp' ELSE 'udp' END AS transport_protocol,
       CAST(o_orderkey % 65536 AS INT) AS src_port_fixed, CAST(CASE WHEN o_custkey % 3 <> 0 THEN o_custkey % 65536 END AS INT) AS dst_port_fixed, {_RANGE.format("(o_orderkey % 65536)")} AS src_port_range
FROM orders
""")
def deny_sentence_roundtrip(spark, sf_dir):
    return _decoded(lines.sentence(table(spark, sf_dir, "orders")), "action", "outcome", "transport_protocol", "src_port_fixed", "dst_port_fixed", "src_port_range")


@query("""
SELECT event_id, CASE WHEN ok THEN 'authentication' ELSE 'unsupported' END AS route, CASE WHEN ok THEN CASE event_id % 5 WHEN 0 THEN 'success' WHEN 1 THEN 'failure' WHEN 3 THEN 'failure' END END AS outcome,
       CASE WHEN ok THEN CASE event_id % 5 WHEN 0 THEN 'success' WHEN 1 THEN 'failure' WHEN 3 THEN 'failure' END END AS auth_result,
       CASE WHEN ok THEN CASE user_id % 4 WHEN 0 THEN 'invalid' WHEN 1 THEN 'valid' END END AS credential_check, CASE WHEN ok AND user_id % 4 = 2 THEN 'missing' END AS response,
       CASE WHEN ok AND user_id % 4 = 2 THEN 'no_response' END AS authentication_interaction, CASE WHEN ok AND (user_id % 4 = 3 OR event_id % 5 = 2) THEN 'allowed' END AS policy_decision
FROM (SELECT *, event_id % 9 <> 0 AS ok FROM events)
""")
def auth_json_roundtrip(spark, sf_dir):
    return _decoded(lines.auth(table(spark, sf_dir, "events")), "outcome", "auth_result", "credential_check", "response", "authentication_interaction", "policy_decision")


@query("""
SELECT event_id, 'windows_message' AS route, CASE WHEN t IS NULL THEN c WHEN c IS NULL OR c = t THEN t END AS outcome, CASE WHEN t IS NULL THEN c WHEN c IS NULL OR c = t THEN t END AS auth_result,
       CASE WHEN t IS NOT NULL AND user_id % 2 = 0 THEN 'invalid' END AS credential_check, CASE WHEN t IS NOT NULL THEN 3221225581 END AS status,
       CASE WHEN t IS NOT NULL THEN CASE WHEN user_id % 2 = 0 THEN 3221225578 ELSE 0 END END AS substatus, CAST(CASE WHEN t IS NOT NULL THEN event_id % 12 END AS INT) AS logontype,
       CASE WHEN t IS NOT NULL THEN 'ntlm' END AS authentication_protocol
FROM (SELECT *, CASE event_id % 3 WHEN 0 THEN 'failure' WHEN 1 THEN 'success' END AS t, CASE event_id % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'failure' END AS c FROM events)
""")
def winlog_roundtrip(spark, sf_dir):
    return _decoded(lines.winlog(table(spark, sf_dir, "events")), "outcome", "auth_result", "credential_check", "status", "substatus", "logontype", "authentication_protocol")


@query("""
SELECT l_orderkey, l_linenumber, 'native_firewall' AS route, CASE WHEN l_linenumber = 1 THEN 'deny' ELSE 'allow' END AS action, CAST(l_orderkey % 14 AS INT) AS icmp_type, CAST(l_partkey % 15 AS INT) AS icmp_code,
       CASE l_orderkey % 14 WHEN 0 THEN 'echo_reply' WHEN 8 THEN 'echo_request' WHEN 3 THEN 'destination_unreachable' WHEN 11 THEN 'time_exceeded' WHEN 12 THEN 'parameter_problem' END AS icmp_message,
       CASE WHEN l_orderkey % 14 = 3 THEN CASE l_partkey % 15 WHEN 0 THEN 'network' WHEN 1 THEN 'host' WHEN 2 THEN 'protocol' WHEN 3 THEN 'port' WHEN 4 THEN 'fragmentation_needed' WHEN 5 THEN 'source_route' WHEN 13 THEN 'administratively_prohibited' END END AS icmp_unreachable
FROM lineitem
""")
def icmp_semantics(spark, sf_dir):
    return _decoded(lines.icmp(table(spark, sf_dir, "lineitem")), "action", "icmp_type", "icmp_code", "icmp_message", "icmp_unreachable")


@query(f"""
SELECT *, {_RANGE.format("src_port_fixed")} AS src_port_range FROM (
  SELECT o_orderkey, 'asa_acl' AS route, 'deny' AS action, 'blocked' AS outcome, CASE o_orderkey % 3 WHEN 0 THEN 'tcp' WHEN 1 THEN 'udp' ELSE 'icmp' END AS transport_protocol, CASE o_custkey % 3 WHEN 0 THEN 'outside' WHEN 1 THEN 'dmz' END AS dst_role,
         CAST(CASE WHEN o_custkey % 70000 <= 65535 THEN o_custkey % 70000 END AS INT) AS src_port_fixed, CAST(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 65536 END AS INT) AS dst_port_fixed FROM orders)
""")
def asa_acl_roundtrip(spark, sf_dir):
    return _decoded(lines.acl(table(spark, sf_dir, "orders")), "action", "outcome", "transport_protocol", "dst_role", "src_port_fixed", "dst_port_fixed", "src_port_range")


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN ok THEN 'asa_protocol' ELSE 'unsupported' END AS route, CASE WHEN ok THEN 'deny' END AS action, CASE WHEN ok THEN 'blocked' END AS outcome,
       CASE WHEN ok THEN 'ipproto_' || (l_partkey % 300) END AS transport_protocol, CASE WHEN ok THEN CASE l_suppkey % 3 WHEN 0 THEN 'inside' WHEN 1 THEN 'dmz' END END AS src_role, CASE WHEN ok THEN 'outside' END AS dst_role
FROM (SELECT *, l_partkey % 300 <= 255 AND l_orderkey % 11 <> 0 AS ok FROM lineitem)
""")
def asa_protocol_roundtrip(spark, sf_dir):
    return _decoded(lines.protocol(table(spark, sf_dir, "lineitem")), "action", "outcome", "transport_protocol", "src_role", "dst_role")


@query("SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN 'unsupported' ELSE 'format_payload' END AS route FROM part")
def format_payload_routes(spark, sf_dir):
    return _decoded(lines.category(table(spark, sf_dir, "part")))


@query("""
SELECT event_id, CASE WHEN ok THEN 'windows_rendered' ELSE 'unsupported' END AS route, CASE WHEN ok THEN CASE WHEN t IS NULL THEN c WHEN c IS NULL OR c = t THEN t END END AS outcome, CASE WHEN ok THEN CASE WHEN t IS NULL THEN c WHEN c IS NULL OR c = t THEN t END END AS auth_result
FROM (SELECT *, event_id % 7 <> 0 AS ok, CASE event_id % 3 WHEN 0 THEN 'failure' WHEN 1 THEN 'success' END AS t, CASE event_id % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'failure' END AS c FROM events)
""")
def windows_rendered_roundtrip(spark, sf_dir):
    return _decoded(lines.rendered(table(spark, sf_dir, "events")), "outcome", "auth_result")


@query("""
SELECT event_id, CASE WHEN event_id % 4 < 2 THEN 'bounded_payload' ELSE 'unsupported' END AS route, CASE event_id % 4 WHEN 0 THEN 'message' WHEN 1 THEN 'behaviors.[].cmdline' END AS path,
       CASE event_id % 4 WHEN 0 THEN 'user ' || user_id || ' did it' WHEN 1 THEN 'run ' || event_id END AS payload FROM events
""")
def bounded_payloads(spark, sf_dir):
    rows = lines.bounded(table(spark, sf_dir, "events"))
    found = classify(rows).select("event_id", "route", "message_sanitized").withColumn("p", payloads(F.when(F.col("route") == "bounded_payload", F.col("message_sanitized"))))
    return found.select("event_id", "route", F.get("p", F.lit(0))["path"].alias("path"), F.get("p", F.lit(0))["value"].alias("payload"))


@query("""
SELECT route, count(*) AS n FROM (
  SELECT 'vpc_v2' AS route FROM lineitem UNION ALL SELECT 'asa' FROM orders UNION ALL SELECT 'cef_fields' FROM events UNION ALL SELECT CASE WHEN event_id % 9 <> 0 THEN 'authentication' ELSE 'unsupported' END FROM events
  UNION ALL SELECT 'windows_message' FROM events UNION ALL SELECT CASE WHEN c_custkey % 4 = 3 THEN 'syslog_auth' ELSE 'syslog_body' END FROM customer
  UNION ALL SELECT CASE WHEN p_partkey % 11 = 0 THEN 'unsupported' ELSE 'audit_fields' END FROM part UNION ALL SELECT 'native_flow' FROM supplier UNION ALL SELECT 'unsupported' FROM orders UNION ALL SELECT 'empty' FROM region
  UNION ALL SELECT 'asa_acl' FROM orders UNION ALL SELECT CASE WHEN l_partkey % 300 <= 255 AND l_orderkey % 11 <> 0 THEN 'asa_protocol' ELSE 'unsupported' END FROM lineitem UNION ALL SELECT CASE WHEN p_partkey % 6 = 0 THEN 'unsupported' ELSE 'format_payload' END FROM part
  UNION ALL SELECT CASE WHEN event_id % 7 <> 0 THEN 'windows_rendered' ELSE 'unsupported' END FROM events UNION ALL SELECT CASE WHEN event_id % 4 < 2 THEN 'bounded_payload' ELSE 'unsupported' END FROM events UNION ALL SELECT 'native_firewall' FROM lineitem) GROUP BY route
""")
def route_precedence_counts(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    made = [lines.vpc(t("lineitem")), lines.asa(t("orders")), lines.cef(t("events")), lines.auth(t("events")), lines.winlog(t("events")), lines.pam(t("customer")), lines.audit(t("part")), lines.flow(t("supplier")), lines.sentence(t("orders"))]
    made += [lines.acl(t("orders")), lines.protocol(t("lineitem")), lines.category(t("part")), lines.rendered(t("events")), lines.bounded(t("events")), lines.icmp(t("lineitem"))]
    messages = t("region").select(F.lit(" ").alias("message_sanitized"))
    for m in made:
        messages = messages.unionAll(m.select("message_sanitized"))
    return classify(messages).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


def _port_texts(events: DataFrame) -> DataFrame:
    text = "case pmod(event_id, 7) when 0 then null when 1 then '' when 2 then '  ' when 3 then cast(event_id as string) when 4 then concat('00', pmod(user_id, 65536)) when 5 then ' 443' else '443.0' end"
    return events.select("event_id", "user_id", F.expr(text).alias("src_port"))


_PORTS_SQL = """(SELECT event_id, user_id, CASE event_id % 7 WHEN 0 THEN 'null' WHEN 1 THEN 'empty' WHEN 2 THEN 'empty' WHEN 3 THEN CASE WHEN event_id <= 65535 THEN 'observed' ELSE 'outside_port_domain' END WHEN 4 THEN 'observed' ELSE 'opaque_or_noncanonical' END AS state,
   CASE event_id % 7 WHEN 3 THEN CASE WHEN event_id <= 65535 THEN event_id END WHEN 4 THEN user_id % 65536 END AS port FROM events)"""


@query(f"SELECT state, count(*) AS n, CAST(sum(port) AS BIGINT) AS total FROM {_PORTS_SQL} GROUP BY state")
def port_states(spark, sf_dir):
    found = _port_texts(table(spark, sf_dir, "events")).select(features.record_port(F.col("src_port")).alias("p"))
    return found.groupBy(F.col("p.state").alias("state")).agg(F.count(F.lit(1)).alias("n"), F.sum("p.port").cast("long").alias("total"))


@query(f"""
SELECT event_id, CASE WHEN port IS NULL THEN 0 ELSE bit_count(port) + 1 + CASE WHEN port <> user_id % 65536 THEN 1 ELSE 0 END END AS entries, CAST(coalesce(port, 0) AS BIGINT) AS decoded,
       CASE WHEN port IS NOT NULL AND port <> user_id % 65536 THEN 1 ELSE 0 END AS conflict FROM {_PORTS_SQL}
""")
def port_bits(spark, sf_dir):
    rows = _port_texts(table(spark, sf_dir, "events")).withColumn("p", features.record_port(F.col("src_port"))["port"])
    v = features.port_vector(F.col("p"), F.pmod("user_id", F.lit(65536)).cast("int"))
    back = F.aggregate(F.filter(F.col("v"), lambda e: e["i"] < 16), F.lit(0).cast("long"), lambda a, e: a + F.pow(F.lit(2.0), e["i"]).cast("long"))
    return rows.withColumn("v", v).select("event_id", F.size("v").alias("entries"), back.alias("decoded"), F.exists("v", lambda e: e["i"] == 17).cast("int").alias("conflict"))


@query("""
SELECT l_orderkey, l_linenumber, CAST(bit_count(CAST(l_orderkey % 65536 AS BIGINT)) AS INT) AS src_bits, CAST(bit_count(CAST(l_partkey % 65536 AS BIGINT)) AS INT) AS dst_bits,
       round(1 + ln(1 + l_quantity), 6) AS packets, round(1 + ln(1 + l_extendedprice), 6) AS bytes, CAST(CASE l_linenumber % 4 WHEN 0 THEN 4 + l_suppkey % 256 ELSE l_linenumber % 4 - 1 END AS INT) AS transport_column
FROM lineitem
""")
def fact_columns(spark, sf_dir):
    from tarn.contract import fact_names, facts

    names = {n: i for i, n in enumerate(fact_names())}
    transport = F.when(F.pmod("l_linenumber", F.lit(4)) == 0, F.concat(F.lit("ipproto_"), F.pmod("l_suppkey", F.lit(256)))).when(F.pmod("l_linenumber", F.lit(4)) == 1, "tcp").when(F.pmod("l_linenumber", F.lit(4)) == 2, "udp").otherwise("icmp")
    made = facts(transport_protocol=transport, packets=F.col("l_quantity"), bytes=F.col("l_extendedprice"), src_port_fixed=F.pmod("l_orderkey", F.lit(65536)), dst_port_fixed=F.pmod("l_partkey", F.lit(65536)))
    rows = spread(table(spark, sf_dir, "lineitem")).select("l_orderkey", "l_linenumber", made.alias("facts")).withColumn("v", features.raw_fact_vector(F.col("facts")))

    first = {name: names[f"{name}:bit0"] for name in ("src_port_fixed", "dst_port_fixed")}
    transport = names["transport_protocol=tcp"]

    def add(seen: Column, e: Column) -> Column:
        i, v = e["i"], e["v"]
        bits = lambda name: seen[name] + F.when(i.between(first[name], first[name] + 16), 1).otherwise(0)
        value = lambda name: F.when(i == names[f"numeric:{name}"], v).otherwise(seen[name])
        column = F.when(i.between(transport, transport + 259), i - transport).otherwise(seen["column"])
        return F.struct(bits("src_port_fixed").alias("src_port_fixed"), bits("dst_port_fixed").alias("dst_port_fixed"), value("packets").alias("packets"), value("bytes").alias("bytes"), column.alias("column"))

    none = F.struct(F.lit(0).alias("src_port_fixed"), F.lit(0).alias("dst_port_fixed"), F.lit(None).cast("double").alias("packets"), F.lit(None).cast("double").alias("bytes"), F.lit(None).cast("int").alias("column"))
    found = rows.select("l_orderkey", "l_linenumber", F.aggregate("v", none, add).alias("f"))
    return found.select("l_orderkey", "l_linenumber", F.col("f.src_port_fixed").alias("src_bits"), F.col("f.dst_port_fixed").alias("dst_bits"), F.round("f.packets", 6).alias("packets"), F.round("f.bytes", 6).alias("bytes"), F.col("f.column").alias("transport_column"))


@query("""
WITH h AS (SELECT doc_id, hex(encode(text)) AS h FROM documents),
b AS (SELECT doc_id, unnest(range(0, len(h) // 2)) AS p, h FROM h),
v AS (SELECT doc_id, p, CAST(('0x' || substr(h, 2 * p + 1, 2)) AS INT) AS a, CASE WHEN 2 * p + 4 <= len(h) THEN CAST(('0x' || substr(h, 2 * p + 3, 2)) AS INT) END AS n FROM b),
c AS (SELECT doc_id, code, count(*) AS k FROM (SELECT doc_id, a AS code FROM v UNION ALL SELECT doc_id, 256 + 256 * a + n FROM v WHERE n IS NOT NULL) GROUP BY doc_id, code)
SELECT doc_id, coalesce(entries, 0) AS entries, coalesce(codes, 0) AS codes, coalesce(total, 0) AS total FROM documents LEFT JOIN
  (SELECT doc_id, count(*) AS entries, CAST(sum(code) AS BIGINT) AS codes, round(sum(1 + ln(k)) / sqrt(sum((1 + ln(k)) * (1 + ln(k)))), 2) AS total FROM c GROUP BY doc_id) USING (doc_id)
""")
def byte_ngram_weights(spark, sf_dir):
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", features.byte_vector(F.col("text")).alias("v"))
    return rows.select("doc_id", F.size("v").cast("long").alias("entries"), F.aggregate("v", F.lit(0).cast("long"), lambda a, e: a + e["i"]).alias("codes"), F.round(F.aggregate("v", F.lit(0.0), lambda a, e: a + e["v"]), 2).alias("total"))


@query()
def mask_documents(spark, sf_dir):
    """Masked text and span ledger of every document; tests hold it against brute force."""
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", masking.masked_with_ledger(F.col("text")).alias("m"))
    return rows.select("doc_id", F.sha2("m.text", 256).alias("masked_sha256"), F.size(F.filter("m.ledger", lambda s: s["kind"] == "identity")).alias("identities"), F.size("m.ledger").alias("spans"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.pmod("doc_id", F.lit(3)).cast("int").alias("label"), F.pmod(F.col("doc_id") + F.col("toxic") + F.col("quality"), F.lit(3)).cast("int").alias("predicted"))


_LABELLED = "(SELECT doc_id, CAST(doc_id % 3 AS INT) AS label, CAST((doc_id + toxic + quality) % 3 AS INT) AS predicted FROM labels)"
_GRID = f"(SELECT label, predicted, coalesce(n, 0) AS n FROM (SELECT * FROM (VALUES (0), (1), (2)) a(label), (VALUES (0), (1), (2)) b(predicted)) LEFT JOIN (SELECT label, predicted, count(*) AS n FROM {_LABELLED} GROUP BY ALL) USING (label, predicted))"
_F1 = f"""(SELECT t.label, support, correct, support - correct AS missed, called - correct AS false_called, correct / nullif(called, 0) AS precision, correct / nullif(support, 0) AS recall, 2 * correct / nullif(support + called, 0) AS f1
FROM (SELECT label, CAST(sum(n) AS BIGINT) AS support, CAST(sum(CASE WHEN label = predicted THEN n ELSE 0 END) AS BIGINT) AS correct FROM {_GRID} GROUP BY label) t
JOIN (SELECT predicted AS label, CAST(sum(n) AS BIGINT) AS called FROM {_GRID} GROUP BY predicted) c ON c.label = t.label)"""


@query(f"SELECT * FROM {_GRID}")
def confusion(spark, sf_dir):
    return metrics.confusion(_labelled(spark, sf_dir))


@query(f"SELECT label, support, correct, missed, false_called, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM {_F1}")
def class_f1(spark, sf_dir):
    found = metrics.class_metrics(metrics.confusion(_labelled(spark, sf_dir)))
    return found.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query(f"SELECT CAST(sum(support) AS BIGINT) AS rows, CAST(sum(missed) AS BIGINT) AS errors, round(CASE WHEN min(support) > 0 THEN avg(f1) END, 9) AS macro_f1 FROM {_F1}")
def macro_f1(spark, sf_dir):
    return metrics.macro(metrics.confusion(_labelled(spark, sf_dir))).withColumn("macro_f1", F.round("macro_f1", 9))


@query("SELECT count(*) AS rows, CAST(0 AS BIGINT) AS errors, CAST(NULL AS DOUBLE) AS macro_f1 FROM labels WHERE doc_id % 3 < 2")
def macro_null(spark, sf_dir):
    """A class without support: macro-F1 is null."""
    rows = _labelled(spark, sf_dir).where("label < 2").withColumn("predicted", F.col("label"))
    return metrics.macro(metrics.confusion(rows))


@query("SELECT label, coalesce(support, 0) AS support FROM (VALUES (0), (1), (2)) a(label) LEFT JOIN (SELECT CAST(toxic AS INT) AS label, count(*) AS support FROM labels GROUP BY 1) USING (label)")
def class_support(spark, sf_dir):
    return metrics.class_support(table(spark, sf_dir, "labels"), "toxic")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def label_counts(spark, sf_dir):
    """As a run report states them."""
    from tarn.plans.publish import counts

    return spark.createDataFrame(list(counts(table(spark, sf_dir, "events"), "event_type").items()), "event_type string, n long")


@query("SELECT count(*) AS rows, count(DISTINCT user_id) AS \"unique\", count(user_id) - count(DISTINCT user_id) AS duplicates FROM events")
def distinct_check(spark, sf_dir):
    return coverage.distinct_check(table(spark, sf_dir, "events"), "user_id")


def _ids(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Input ids, and a result that lacks some, has many more than once and some of its own."""
    expected = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("event_id"))
    key = F.col("l_orderkey")
    own = F.when(F.pmod(key, F.lit(5)) == 0, F.concat(F.lit("x"), key)).when((F.pmod(key, F.lit(50)) == 1) & (F.col("l_linenumber") == 1), " ").otherwise(key.cast("string"))
    emitted = table(spark, sf_dir, "lineitem").select(own.alias("event_id"), F.when(F.col("l_returnflag") == "A", "benign").when(F.col("l_returnflag") == "R", "malicious").otherwise("other").alias("pred_label"))
    return expected, emitted


_EXPECTED = "(SELECT CAST(o_orderkey AS VARCHAR) AS event_id FROM orders)"
_EMITTED = "(SELECT CASE WHEN l_orderkey % 5 = 0 THEN 'x' || l_orderkey WHEN l_orderkey % 50 = 1 AND l_linenumber = 1 THEN ' ' ELSE CAST(l_orderkey AS VARCHAR) END AS event_id, CASE l_returnflag WHEN 'A' THEN 'benign' WHEN 'R' THEN 'malicious' ELSE 'other' END AS pred_label FROM lineitem)"
_MISSING = f"(SELECT DISTINCT event_id FROM {_EXPECTED} WHERE event_id NOT IN (SELECT event_id FROM {_EMITTED}))"
_EXTRA = f"(SELECT DISTINCT event_id FROM {_EMITTED} WHERE event_id <> ' ' AND event_id NOT IN (SELECT event_id FROM {_EXPECTED}))"


@query(f"SELECT event_id FROM {_MISSING}")
def missing_ids(spark, sf_dir):
    return coverage.missing_ids(*_ids(spark, sf_dir))


@query(f"SELECT event_id FROM {_EXTRA}")
def extra_ids(spark, sf_dir):
    return coverage.extra_ids(*_ids(spark, sf_dir))


@query(f"SELECT event_id, count(*) AS n FROM {_EMITTED} GROUP BY event_id HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return coverage.duplicate_ids(_ids(spark, sf_dir)[1])


@query(f"""
SELECT *, FALSE AS passed FROM (SELECT count(*) AS input_rows, CAST(0 AS BIGINT) AS invalid_input_ids, count(*) - count(DISTINCT event_id) AS duplicate_input_ids, count(DISTINCT event_id) AS unique_input_ids FROM {_EXPECTED}),
(SELECT count(*) AS output_rows, count(CASE WHEN event_id = ' ' THEN 1 END) AS invalid_output_ids, count(nullif(event_id, ' ')) - count(DISTINCT nullif(event_id, ' ')) AS duplicate_output_ids, count(DISTINCT nullif(event_id, ' ')) AS unique_output_ids, count(CASE WHEN pred_label = 'other' THEN 1 END) AS invalid_labels FROM {_EMITTED}),
(SELECT count(*) AS missing_ids FROM {_MISSING}), (SELECT count(*) AS extra_ids FROM {_EXTRA}), (SELECT CAST(0 AS BIGINT) AS malformed_rows)
""")
def coverage_report(spark, sf_dir):
    return coverage.coverage_report(*_ids(spark, sf_dir))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT 7 * p_partkey FROM part)")
def shared_rows(spark, sf_dir):
    train = table(spark, sf_dir, "part").select((7 * F.col("p_partkey")).alias("l_partkey"))
    return coverage.shared_rows(train, table(spark, sf_dir, "lineitem"), "l_partkey").select("l_orderkey", "l_linenumber")


@query("SELECT item_id AS id FROM benchmark INTERSECT SELECT doc_id FROM documents")
def shared_ids(spark, sf_dir):
    return coverage.shared_ids(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id")), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), "id")


def _weights(size: int) -> tuple[list[list[float]], list[float]]:
    """Fixed weights of a small linear model: a row for each feature."""
    return [[((7 * k + 3 * c) % 11 - 5) / 4 for c in range(3)] for k in range(size)], [0.25, -0.5, 0.125]


def _score_sql() -> str:
    term = "list_sum(list_transform(range(1, len(embedding) + 1), lambda k: CAST(embedding[k] AS DOUBLE) * (((7 * (k - 1) + {c}) % 11) - 5) / 4.0)) + {b}"
    scores = ", ".join(f"{term.format(c=3 * c, b=b)} AS s{c}" for c, b in enumerate((0.25, -0.5, 0.125)))
    return f"(SELECT vec_id, s0, s1, s2, exp(s0 - m) AS e0, exp(s1 - m) AS e1, exp(s2 - m) AS e2 FROM (SELECT *, greatest(s0, s1, s2) AS m FROM (SELECT vec_id, {scores} FROM embeddings)))"


@query(f"SELECT vec_id, round(e0 / (e0 + e1 + e2), 6) AS p0, round(e1 / (e0 + e1 + e2), 6) AS p1, round(e2 / (e0 + e1 + e2), 6) AS p2, CAST(CASE WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS INT) AS pred_class FROM {_score_sql()}")
def linear_softmax_argmax(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    size = rows.select(F.size("embedding").alias("n")).first()["n"]
    scored = rows.select("vec_id", scoring.softmax(scoring.dense_scores(F.col("embedding"), *_weights(size))).alias("probabilities"))
    return scoring.decide(scored).select("vec_id", *[F.round(F.col("probabilities")[c], 6).alias(f"p{c}") for c in range(3)], "pred_class")


@query(f"SELECT vec_id, round((e0 / (e0 + e1 + e2) + 1 / 3) / 2, 6) AS p0, round((e1 / (e0 + e1 + e2) + 1 / 3) / 2, 6) AS p1, round((e2 / (e0 + e1 + e2) + 1 / 3) / 2, 6) AS p2 FROM {_score_sql()}")
def fold_mean(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    size = rows.select(F.size("embedding").alias("n")).first()["n"]
    one = scoring.softmax(scoring.dense_scores(F.col("embedding"), *_weights(size)))
    flat = scoring.softmax(F.array(*[F.lit(0.0)] * 3))
    return rows.select("vec_id", scoring.mean_of([one, flat]).alias("p")).select("vec_id", *[F.round(F.col("p")[c], 6).alias(f"p{c}") for c in range(3)])


_BODY = """' <IDENTITY> Deny tcp src outside: <IDENTITY> /' || (o_orderkey % 65536) || ' dst inside: <IDENTITY> /' || (o_custkey % 65536) || ' by access-group "' || CASE WHEN o_orderkey % 10 = 5 THEN repeat('a', 150) ELSE 'acl' END || '" [0x0, 0x0]'"""
_STATE = "CASE o_orderkey % 4 WHEN 2 THEN 'opaque_or_noncanonical' WHEN 3 THEN 'null' ELSE 'observed' END"
_CONFLICT = "o_orderkey % 4 = 1 AND o_orderkey % 10 <> 4 AND o_custkey % 65536 <> o_orderkey % 65536"


@query(f"""
SELECT CAST(o_orderkey AS VARCHAR) AS event_id, CAST(CASE WHEN o_orderkey % 10 NOT IN (3, 4, 5) THEN strlen({_BODY}) END AS INT) AS length,
       CASE o_orderkey % 10 WHEN 3 THEN 'asa_grammar_unsupported' WHEN 4 THEN 'asa_parser_unsupported' WHEN 5 THEN 'asa_body_too_long:' || strlen({_BODY}) || '>176' END AS error, CASE WHEN o_orderkey % 10 NOT IN (3, 4, 5) THEN {_BODY} END AS body FROM orders
""")
def body_length_guard(spark, sf_dir):
    """What the sequence model reads of denials, and why it can't read some."""
    from tarn.operators.prepare import prepare

    return prepare(lines.registered(table(spark, sf_dir, "orders"))).select("event_id", "length", "error", F.col("body").cast("string").alias("body"))


@query(f"""
SELECT 'unsupported record ' || event_id || ': ' || error AS message FROM (SELECT CAST(o_orderkey AS VARCHAR) AS event_id,
  CASE o_orderkey % 10 WHEN 3 THEN 'asa_grammar_unsupported' WHEN 4 THEN 'asa_parser_unsupported' WHEN 5 THEN 'asa_body_too_long:' || strlen({_BODY}) || '>176' END AS error FROM orders) WHERE error IS NOT NULL ORDER BY event_id LIMIT 1
""")
def strict_mode(spark, sf_dir):
    """What strict mode says of the first record that it refuses (here by id, as these records have no place in a source)."""
    from tarn.operators.prepare import UnsupportedRecord, prepare, refuse_errors

    try:
        refuse_errors(prepare(lines.registered(table(spark, sf_dir, "orders"))))
        said = []
    except UnsupportedRecord as error:
        said = [(str(error),)]
    return spark.createDataFrame(said, "message string")


@query("SELECT c_custkey, 'x <IDENTITY> z' || c_custkey || ' <IDENTITY> -7\u00e9 <IDENTITY> ' AS masked FROM customer")
def stable_masks(spark, sf_dir):
    """Identities at the edge of words and inside them, with remains of prefixes around them."""
    made = F.concat(F.lit("xCRED- USER-"), "c_custkey", F.lit("  z"), "c_custkey", F.lit(" HOST-CRED-USER-"), "c_custkey", F.lit("-7\u00e9ORG-CRED-1"))
    return table(spark, sf_dir, "customer").select("c_custkey", masking.collapse(masking.stable(masking.masked(made))).alias("masked"))


@query(f"""
SELECT CAST(o_orderkey AS VARCHAR) AS event_id, CASE WHEN o_orderkey % 10 = 4 THEN 'unsupported' ELSE 'asa' END AS route, TRUE AS is_asa_source, {_STATE} AS port_state, {_CONFLICT} AS port_conflict,
       ltrim(CASE WHEN o_orderkey % 10 = 3 THEN replace({_BODY}, ' <IDENTITY> Deny', '%ASA-4-106023: Deny') WHEN o_orderkey % 10 = 4 THEN replace({_BODY}, ' <IDENTITY> Deny tcp', '  <IDENTITY>  Deny gre') ELSE {_BODY} END) AS text FROM orders
""")
def prepared_records(spark, sf_dir):
    from tarn.operators.prepare import prepare

    made = prepare(lines.registered(table(spark, sf_dir, "orders")))
    return made.select("event_id", "route", "is_asa_source", "port_state", "port_conflict", F.ltrim(F.regexp_replace("text", "^ <ABSOLUTE_CLOCK>", "")).alias("text"))


@query(f"""
SELECT count(CASE WHEN s = 'observed' THEN 1 END) AS observed, count(CASE WHEN s = 'observed' AND o_orderkey % 10 = 4 THEN 1 END) AS message_unobserved_record_observed, count(CASE WHEN c THEN 1 END) AS conflicting_observations
FROM (SELECT *, {_STATE} AS s, {_CONFLICT} AS c FROM orders)
""")
def port_summary(spark, sf_dir):
    from tarn.operators import prepare

    return prepare.port_summary(prepare.prepare(lines.registered(table(spark, sf_dir, "orders"))))


@query("""
SELECT l_orderkey, l_linenumber, '2  <IDENTITY>   <IDENTITY>   <IDENTITY>   <IDENTITY>  ' || (l_orderkey * 7 % 65536) || ' ' || (l_partkey * 13 % 65536) || ' ' || (l_suppkey % 256) || ' ' || CAST(floor(l_quantity) AS INT) || ' ' || CAST(floor(l_extendedprice) AS BIGINT)
       || '  <ABSOLUTE_CLOCK>   <ABSOLUTE_CLOCK>  ' || CASE l_returnflag WHEN 'A' THEN 'ACCEPT' WHEN 'R' THEN 'REJECT' ELSE '-' END || ' OK' AS masked, CAST(13 AS INT) AS spans, CAST(4 AS INT) AS identities FROM lineitem
""")
def mask_flows(spark, sf_dir):
    made = masking.masked_with_ledger(F.col("message_sanitized"))
    rows = spread(lines.vpc(table(spark, sf_dir, "lineitem"))).select("l_orderkey", "l_linenumber", made.alias("m"))
    return rows.select("l_orderkey", "l_linenumber", F.col("m.text").alias("masked"), F.size("m.ledger").alias("spans"), F.size(F.filter("m.ledger", lambda s: s["kind"] == "identity")).alias("identities"))


_RECORDS = """(SELECT CAST(o_orderkey AS VARCHAR) AS event_id, o_orderpriority || ', "quoted"' || chr(10) || 'line ' || o_custkey AS message_sanitized, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_custkey AS VARCHAR) END AS src_port,
   CAST(o_orderkey % 3 AS INT) AS label FROM orders)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = "concat(o_orderpriority, ', \"quoted\"\\nline ', o_custkey)"
    label = F.element_at(F.array(F.lit("benign"), F.lit("malicious"), F.lit("suspicious")), (F.pmod("o_orderkey", F.lit(3)) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("event_id"), F.expr(made).alias("message_sanitized"), F.when(F.pmod("o_orderkey", F.lit(3)) > 0, F.col("o_custkey")).alias("src_port"), label.alias("label_binary"), F.lit("x").alias("other"))


@query(f"SELECT event_id, message_sanitized, coalesce(src_port, '') AS src_port, label FROM {_RECORDS}")
def read_raw_csv(spark, sf_dir):
    """Records written as CSV and read back under the contract; an empty cell is the empty string."""
    at = new_path(spark, "records.csv")
    _records(spark, sf_dir).write.option("header", True).option("quote", '"').option("escape", '"').csv(at)
    return read_raw(spark, at, labels=True)


@query(f"SELECT event_id, message_sanitized, src_port, label FROM {_RECORDS}")
def read_raw_parquet(spark, sf_dir):
    at = new_path(spark, "records.parquet")
    _records(spark, sf_dir).write.parquet(at)
    return read_raw(spark, at, labels=True)


@query(f"SELECT event_id FROM {_RECORDS}")
def read_id_scan(spark, sf_dir):
    at = new_path(spark, "records.parquet")
    _records(spark, sf_dir).write.parquet(at)
    return read_ids(spark, at)


def _flows(spark: SparkSession, sf_dir: str) -> str:
    """A source of flow records with ids of their own."""
    at = new_path(spark, "flows.parquet")
    made = lines.vpc(spread(table(spark, sf_dir, "lineitem")))
    made.select(F.concat_ws("-", "l_orderkey", "l_linenumber", F.monotonically_increasing_id()).alias("event_id"), "message_sanitized", F.lit(None).cast("string").alias("src_port")).write.parquet(at)
    return at


def action_model():
    """Two folds that read the action: allowed is benign, denied malicious, anything else suspicious."""
    import numpy as np

    from tarn.contract import BYTE_FEATURES, WIDTH, fact_names
    from tarn.plans.predict import Ensemble, Fold

    names, folds = fact_names(), []
    for strength in (200.0, 300.0):
        weights = np.zeros((WIDTH, 3))
        weights[BYTE_FEATURES + names.index("action=allow"), 0] = weights[BYTE_FEATURES + names.index("action=deny"), 1] = strength
        folds.append(Fold(scoring.Router(weights, np.array([0.0, 0.0, 1.0]))))
    return Ensemble(folds)


_FLOW_LABEL = "CASE l_returnflag WHEN 'A' THEN 'benign' WHEN 'R' THEN 'malicious' ELSE 'suspicious' END"


@query(f"SELECT {_FLOW_LABEL} AS pred_label, CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber FROM lineitem")
def predicted_labels(spark, sf_dir):
    """A source read, predicted and published as a folder, which is read again."""
    from tarn.plans.predict import predict_table
    from tarn.plans.validate import read_submission

    out = new_path(spark, "predicted.csv")
    predict_table(spark, _flows(spark, sf_dir), out, action_model())
    rows, _ = read_submission(spark, out)
    return rows.select("pred_label", F.split_part("event_id", F.lit("-"), F.lit(1)).alias("l_orderkey"), F.split_part("event_id", F.lit("-"), F.lit(2)).alias("l_linenumber"))


@query(f"""
SELECT count(*) AS input_rows, count(*) AS output_rows, CAST(0 AS BIGINT) AS missing_ids, CAST(0 AS BIGINT) AS extra_ids, CAST(0 AS BIGINT) AS duplicate_output_ids, CAST(0 AS BIGINT) AS invalid_labels, TRUE AS passed,
       count(CASE WHEN {_FLOW_LABEL} = 'malicious' THEN 1 END) AS malicious FROM lineitem
""")
def predict_and_validate(spark, sf_dir):
    """Read, predict, publish and validate: the whole file path."""
    from tarn.plans.predict import predict_table
    from tarn.plans.validate import validate_submission

    source, out = _flows(spark, sf_dir), new_path(spark, "predicted.csv")
    predict_table(spark, source, out, action_model())
    report = validate_submission(spark, source, out)
    names = ["input_rows", "output_rows", "missing_ids", "extra_ids", "duplicate_output_ids", "invalid_labels"]
    row = [*(report[n] for n in names), report["passed"], report["predicted_label_counts"].get("malicious", 0)]
    return spark.createDataFrame([row], ", ".join(f"{n} long" for n in names) + ", passed boolean, malicious long")


_SEGMENT = "(CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 ELSE 2 END)"


@query(f"""
SELECT a.label, b.predicted, CASE WHEN a.label = b.predicted THEN coalesce(n, 0) ELSE 0 END AS n FROM (VALUES (0), (1), (2)) a(label), (VALUES (0), (1), (2)) b(predicted)
LEFT JOIN (SELECT {_SEGMENT} AS label, count(*) AS n FROM customer GROUP BY 1) c ON c.label = a.label
""")
def train_and_evaluate(spark, sf_dir):
    """A router fitted on features that tell the classes, and evaluated on other ids: no row is missed."""
    from tarn.plans.predict import Ensemble, Fold
    from tarn.plans.train import evaluate, fit_router, validate_datasets

    names = ["BUILDING", "MACHINERY"]
    at = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, names)), F.col("c_mktsegment")), F.lit(0)), F.lit(3)).cast("int")
    one = lambda i, v: F.struct(i.cast("int").alias("i"), v.cast("float").alias("v"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("event_id"), (at - 1).alias("label"), F.array(one(at * 10, F.lit(1.0)), one(F.lit(100) + F.pmod("c_custkey", F.lit(50)), F.lit(0.5))).alias("full"))
    others = rows.withColumn("event_id", F.concat(F.lit("v"), "event_id"))
    validate_datasets(rows, others)
    result = evaluate(others, Ensemble([Fold(fit_router(rows))]))
    return spark.createDataFrame([(r["label"], r["predicted"], r["n"]) for r in result["confusion"]], "label int, predicted int, n long")


_ADDRESS_SQL = "CASE c_custkey % 8 WHEN 0 THEN TRUE WHEN 1 THEN TRUE WHEN 2 THEN FALSE WHEN 3 THEN FALSE WHEN 4 THEN TRUE WHEN 5 THEN c_custkey % 300 <= 255 WHEN 6 THEN FALSE ELSE TRUE END"


@query(f"SELECT c_custkey, {_ADDRESS_SQL} AS valid FROM customer")
def address_forms(spark, sf_dir):
    """IPv6 in full, cut short, cut twice, too long, with an IPv4 end; IPv4 with numbers that may be too large; words; the unspecified address."""
    from tarn.functions.values import is_address

    h = "hex(pmod(c_custkey, 65536))"
    text = f"case pmod(c_custkey, 8) when 0 then concat('2001:db8:0:1:2:3:4:', {h}) when 1 then concat('fe80::', {h}, ':1') when 2 then concat('fe80::', {h}, '::1') when 3 then concat('1:2:3:4:5:6:7:8:', {h}) when 4 then concat('::ffff:10.0.0.', pmod(c_custkey, 256)) when 5 then concat('10.0.0.', pmod(c_custkey, 300)) when 6 then concat('host', c_custkey) else '::' end"
    return table(spark, sf_dir, "customer").select("c_custkey", is_address(F.expr(text)).alias("valid"))


@query("""
SELECT event_id, CAST(5 AS INT) AS fields, CASE event_id % 5 WHEN 0 THEN 'SUCCESS' WHEN 1 THEN 'denied' WHEN 2 THEN 'allow' WHEN 3 THEN 'fail' END AS result, CASE WHEN event_id % 5 = 4 THEN 'removed' ELSE 'kept' END AS result_state, 'unknown' AS user_state
FROM events WHERE event_id % 9 <> 0 UNION ALL SELECT event_id, CAST(NULL AS INT), NULL, NULL, NULL FROM events WHERE event_id % 9 = 0
""")
def authentication_field_view(spark, sf_dir):
    rows = lines.auth(table(spark, sf_dir, "events")).select("event_id", authentication_fields("message_sanitized").alias("f"))
    field = lambda name: F.get(F.filter("f", lambda v: v["name"] == name), F.lit(0))
    return rows.select("event_id", F.size("f").alias("fields"), field("result")["value"].alias("result"), field("result")["state"].alias("result_state"), field("user")["state"].alias("user_state")).withColumn("fields", F.when(F.col("fields") > 0, F.col("fields")))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'authentication' WHEN 1 THEN 'authentication' WHEN 2 THEN 'unsupported' ELSE 'bounded_payload' END AS route FROM events")
def wrapped_objects(spark, sf_dir):
    """Objects behind an owner's name, behind a name that owns nothing, and behind an exporter's."""
    auth = "concat('{\"application\": \"app\", \"user\": {}, \"result\": \"x\", \"reason\": \"', event_type, '\", \"txid\": 1}')"
    made = f"case pmod(event_id, 4) when 0 then concat('ORG-app.', user_id, ' ::: log=', {auth}) when 1 then concat('x ::: USER-1={{ ::: log = ', {auth}) when 2 then concat('x::: USER-1 ', {auth}) else concat('USER-crowdstrike-', user_id, ' ::: ORG-2={{\"behaviors\": [{{\"cmdline\": \"run\"}}]}}') end"
    return _decoded(table(spark, sf_dir, "events").select("event_id", F.expr(made).alias("message_sanitized")))


@query("""
SELECT c_custkey, 'Logon ID: entity' || chr(10) || '  Account Name:  entity' || chr(10) || 'Process ID: ' || c_custkey || chr(10) || 'by entity end' AS windows, 'at   for ' || c_custkey || ' <EndBoundary>absolute_time</EndBoundary>' AS clocks,
       CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'a' || c_custkey || ' b' ELSE 'parent command run ' || c_custkey || ' file x' END AS shown FROM customer
""")
def payload_views(spark, sf_dir):
    made = table(spark, sf_dir, "customer").select("c_custkey", F.expr("concat('Logon ID: 0x', hex(c_custkey), '\\n  Account Name:  user ', c_custkey, '\\nProcess ID: ', c_custkey, '\\nby S-1-5-21-', c_custkey, ' end')").alias("w"), F.expr("concat('at 2024-01-02T03:04:05.', c_custkey, 'Z for ', c_custkey, ' <EndBoundary>', c_custkey, '</EndBoundary>')").alias("c"))
    route = F.when(F.pmod("c_custkey", F.lit(3)) == 0, "vpc_v2").when(F.pmod("c_custkey", F.lit(3)) == 1, "authentication").otherwise("bounded_payload")
    shown = F.when(F.pmod("c_custkey", F.lit(3)) == 1, F.concat(F.lit("reason a"), "c_custkey", F.lit(" result b"))).otherwise(F.concat(F.lit("message behaviors.[].parent_details.parent_cmdline run "), "c_custkey", F.lit(" behaviors.[].filename x")))
    return made.select("c_custkey", text.windows_text(F.col("w")).alias("windows"), text.without_clocks(F.col("c")).alias("clocks"), text.route_text(shown, route).alias("shown"))


def _sparse(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v, i: F.struct(i.cast("int").alias("i"), v.cast("float").alias("v"))).alias("full"))
    return rows, rows.select(F.size("full").alias("n")).first()["n"]


@query(f"SELECT vec_id, round(s0, 4) AS s0, round(s1, 4) AS s1, round(s2, 4) AS s2, round(e0 / (e0 + e1 + e2), 6) AS p0, round(e1 / (e0 + e1 + e2), 6) AS p1 FROM {_score_sql()}")
def sparse_router(spark, sf_dir):
    import numpy as np

    rows, size = _sparse(spark, sf_dir)
    router = scoring.Router(*map(np.array, _weights(size)))
    done = rows.withColumns({"s": router.scores(spark)(F.col("full")), "p": router.probabilities(spark)(F.col("full"))})
    return done.select("vec_id", *[F.round(F.col("s")[k], 4).alias(f"s{k}") for k in range(3)], *[F.round(F.col("p")[k], 6).alias(f"p{k}") for k in range(2)])


@query()
def router_fit(spark, sf_dir):
    """A router fitted on the embeddings' signs, and its hits by class."""
    from tarn.plans.train import RouterConfig, fit_router

    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.pmod("label", F.lit(3)).cast("int").alias("label"), F.transform("embedding", lambda v, i: F.struct(i.cast("int").alias("i"), v.cast("float").alias("v"))).alias("full"))
    size = rows.select(F.size("full").alias("n")).first()["n"]
    router = fit_router(rows, RouterConfig(), width=size)
    done = scoring.decide(rows.withColumn("probabilities", router.probabilities(spark)(F.col("full"))))
    return metrics.confusion(done, predicted="pred_class")


@query()
def neural_forward(spark, sf_dir):
    """A small fixed sequence model over the embeddings as features and the ids' digits as bodies."""
    import numpy as np

    from tarn.operators.neural import Base, EnsembleLayer, Residual, SequenceModel, score_sequences

    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v, i: F.struct(i.cast("int").alias("i"), v.cast("float").alias("v"))).alias("header"), F.encode(F.col("vec_id").cast("string"), "UTF-8").alias("body"))
    size = rows.select(F.size("header").alias("n")).first()["n"]
    g = np.random.default_rng(1)
    layer = lambda outputs, inputs: EnsembleLayer(g.normal(0, 0.1, (outputs, inputs)), g.normal(1, 0.1, (4, inputs)), g.normal(1, 0.1, (4, outputs)), g.normal(0, 0.1, (4, outputs)))
    model = SequenceModel(Base(layer(16, size), layer(16, 16), layer(3, 16), layer(3, size // 2), size - size // 2), Residual.initial(2))
    return score_sequences(rows, model, "p").select("vec_id", *[F.round(F.col("p")[c], 6).alias(f"p{c}") for c in range(3)])


def _layer_sql(rows: str, outputs: int) -> str:
    """A layer of the fixed ensemble over rows of (vec_id, m, i, x)."""
    return f"""(SELECT vec_id, m, o AS i, sum(x * (1 + ((m + i) % 3 - 1) / 4) * (((5 * o + 3 * i) % 7 - 3) / 8)) * (1 + ((m + 2 * o) % 3 - 1) / 8) + ((3 * m + o) % 5 - 2) / 16 AS x
    FROM {rows}, (SELECT unnest(range({outputs})) AS o) GROUP BY vec_id, m, o)"""


_MEMBERS = "(SELECT vec_id, m, i, x FROM (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), (SELECT unnest(range(2)) AS m))"
_RELU = "(SELECT vec_id, m, i, greatest(x, 0) AS x FROM {0})"
_HIDDEN = _RELU.format(_layer_sql(_RELU.format(_layer_sql(_MEMBERS, 4)), 4))
_TAIL = "(SELECT vec_id, m, i - 8 AS i, x FROM " + _MEMBERS + " WHERE i >= 8)"


@query(f"""
WITH z AS (SELECT a.vec_id, a.m, a.i, exp(a.x + b.x) AS e FROM {_layer_sql(_HIDDEN, 3)} a JOIN {_layer_sql(_TAIL, 3)} b ON a.vec_id = b.vec_id AND a.m = b.m AND a.i = b.i),
p AS (SELECT vec_id, i, avg(e / total) AS p FROM (SELECT *, sum(e) OVER (PARTITION BY vec_id, m) AS total FROM z) GROUP BY vec_id, i)
SELECT vec_id, round(max(CASE WHEN i = 0 THEN p END), 6) AS p0, round(max(CASE WHEN i = 1 THEN p END), 6) AS p1, round(max(CASE WHEN i = 2 THEN p END), 6) AS p2 FROM p GROUP BY vec_id
""")
def ensemble_forward(spark, sf_dir):
    """A fixed base ensemble of two members over the embeddings, with a direct path from their ninth number on."""
    import numpy as np

    from tarn.operators.neural import Base, EnsembleLayer, SequenceModel, score_sequences

    rows, size = _sparse(spark, sf_dir)

    def layer(outputs: int, inputs: int) -> EnsembleLayer:
        o, i, m = np.arange(outputs), np.arange(inputs), np.arange(2)[:, None]
        return EnsembleLayer(((5 * o[:, None] + 3 * i) % 7 - 3) / 8, 1 + ((m + i) % 3 - 1) / 4, 1 + ((m + 2 * o) % 3 - 1) / 8, ((3 * m + o) % 5 - 2) / 16)

    model = SequenceModel(Base(layer(4, size), layer(4, 4), layer(3, 4), layer(3, size - 8), 8))
    done = score_sequences(rows.withColumnRenamed("full", "header").withColumn("body", F.lit(b"x")), model, "p")
    return done.select("vec_id", *[F.round(F.col("p")[c], 6).alias(f"p{c}") for c in range(3)])


@query("""
SELECT event_type AS value, 'action' AS fact, count(*) AS n FROM events WHERE lower(event_type) NOT IN ('allow', 'deny', 'open', 'close') GROUP BY event_type
""")
def unknown_facts(spark, sf_dir):
    from tarn.contract import facts

    rows = table(spark, sf_dir, "events").select(facts(action=F.col("event_type"), transport_protocol=F.concat(F.lit("ipproto_"), F.pmod("event_id", F.lit(256)))).alias("facts"))
    return summaries.unknown_facts(rows).select("value", "fact", "n")


@query("SELECT CAST(i - 1 AS INT) AS i, round(greatest(1, max(abs(CAST(v AS DOUBLE)))), 6) AS scale FROM (SELECT unnest(embedding) AS v, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY i")
def max_abs_scale(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.transform("embedding", lambda v, i: F.struct(i.cast("int").alias("i"), v.cast("float").alias("v"))).alias("v"))
    return summaries.max_abs_scale(rows, "v").select("i", F.round("scale", 6).alias("scale"))


@query("SELECT l_orderkey, l_linenumber, concat_ws(' ', CASE l_returnflag WHEN 'A' THEN 'action allow' WHEN 'R' THEN 'action deny' END, CASE l_returnflag WHEN 'A' THEN 'outcome allowed' WHEN 'R' THEN 'outcome blocked' END, 'src_port_fixed ' || (l_orderkey * 7 % 65536)) AS facts_text FROM lineitem")
def facts_text(spark, sf_dir):
    made = classify(lines.vpc(table(spark, sf_dir, "lineitem")))
    return made.select("l_orderkey", "l_linenumber", text.facts_text(F.col("facts"), ["src_port_fixed", "outcome", "action"]).alias("facts_text"))


@query("""
SELECT o_orderkey, 'outside' AS interface, CAST(CASE WHEN o_custkey % 5 <> 0 AND o_custkey % 70000 <= 65535 THEN o_custkey % 70000 END AS INT) AS port,
       CASE WHEN o_custkey % 5 = 0 THEN 'redacted' WHEN o_custkey % 70000 <= 65535 THEN 'observed' ELSE 'invalid' END AS state FROM orders
""")
def endpoint_states(spark, sf_dir):
    made = F.concat(F.lit("Outside:10.9.8.7/"), F.when(F.pmod("o_custkey", F.lit(5)) == 0, "USER-0012").otherwise(F.pmod("o_custkey", F.lit(70000)).cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.endpoint(made).alias("e")).select("o_orderkey", "e.interface", "e.port", "e.state")


@query("SELECT c_custkey, 'id entity of entity at entity, hash entity end' AS payload FROM customer")
def payload_texts(spark, sf_dir):
    made = F.concat(F.lit("ID  12345678-1234-1234-1234-"), F.lpad(F.col("c_custkey").cast("string"), 12, "0"), F.lit("\n of xUSER-"), F.col("c_custkey"), F.lit(" at 10.0.0."), F.pmod("c_custkey", F.lit(256)), F.lit(", hash 0123456789ABCDEF0 END"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.payload_text(made).alias("payload"))
