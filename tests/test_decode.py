import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarn.contract import FACT_FEATURES, WIDTH, fact_names
from tarn.functions import lexical, masking
from tarn.operators.decode import classify

ASA = '<166>Jan 02 USER-0021 11:22:33: USER-0010-0324 Deny tcp src outside:1.2.3.4/443 dst dmz-1:10.0.0.1/55000 by access-group "acl_in" [0x0, 0x0]'
LINES = [
    (ASA, "asa", {"action": "deny", "outcome": "blocked", "transport_protocol": "tcp", "src_role": "outside", "dst_role": "dmz", "src_port_fixed": 443, "dst_port_fixed": 55000, "src_port_range": "system", "dst_port_range": "dynamic"}),
    ('host said: Deny icmp src inside:1.2.3.4 dst x:5.6.7.8 (type 3, code 1) by access-group "x" [0xab, 0x0]', "unsupported", {}),
    ('%ASA-4-106023: Deny icmp src inside:1.2.3.4 dst x:5.6.7.8 (type 3, code 1) by access-group "x" [0xab, 0x0]', "asa", {"action": "deny", "outcome": "blocked", "transport_protocol": "icmp", "src_role": "inside", "icmp_type": 3, "icmp_code": 1, "icmp_message": "destination_unreachable", "icmp_unreachable": "host"}),
    ("2 123456789012 eni-1 10.0.0.1 - 80 - 58 1 2 3 4 - NODATA", "vpc_v2", {"transport_protocol": "icmp6", "src_port_fixed": 80, "src_port_range": "system", "packets": 1.0, "bytes": 2.0}),
    ("2 123456789012 eni-1 10.0.0.256 - 80 - 58 1 2 3 4 - NODATA", "unsupported", {}),
    ("CEF:0|V|P|1|1|n|5|act=Drop act=allow", "unsupported", {}),
    ('CEF:0|V\\|W|P|1|1|n|5|act=permit app=TLSv1.2 msg="a=b c" in=5', "cef_fields", {"action": "allow", "outcome": "allowed", "application_protocol": "tlsv1.2", "bytes_in": 5.0}),
    ("<192>Jan  2 11:22:33 host CEF:0|V|P|1|1|n|5|act=drop", "unsupported", {}),
    ('{"application":"x","user":"u","result":"allow","reason":"no_response","txid":"1"}', "authentication", {"response": "missing", "policy_decision": "allowed", "authentication_interaction": "no_response"}),
    ("<86>1 2024-01-01T00:00:00Z h app 1 - - pam_unix(sshd:auth): authentication failure; x", "syslog_body", {"outcome": "failure", "auth_result": "failure"}),
    ('<86>Jan  2 11:22:33 h audispd: type=SYSCALL msg=audit(1:2): success=no exit=-13 exe="/x y"', "audit_fields", {"operation_record": "syscall", "outcome": "failure", "exit_category": -13}),
    ("<134>Original Address=1.1.1.1 1 1.1 dev flows allow src=1.2.3.4 dst=4.5.6.7 protocol=udp sport=1 dport=2 pattern: deny all", "native_flow", {"transport_protocol": "udp", "src_port_fixed": 1, "dst_port_fixed": 2, "src_port_range": "system", "dst_port_range": "system"}),
    ("<134>Original Address=1.1.1.1 1 1.1 dev l7_firewall src=1.2.3.4 dst=4.5.6.7 protocol=tcp", "unsupported", {}),
    ('{"behaviors": [{"cmdline": "x", "broken": "\\q"}]}', "bounded_payload", {}),
    # control characters, which the engine separates captures by, are text like any other
    ('<134>Jan  2 11:22:33 fw Deny protocol 47 src inside:1.2.3.4 dst outside:5.6.7.8 by access-group "x" [0x0, 0x0]\x01 not a denial any more', "unsupported", {}),
    ('<134>Jan  2 11:22:33 fw Deny protocol 47 src ins\x01ide:1.2.3.4 dst outside:5.6.7.8 by access-group "x" [0x0, 0x0]', "asa_protocol", {"action": "deny", "outcome": "blocked", "transport_protocol": "ipproto_47", "dst_role": "outside"}),
    ("<86>Jan  2 11:22:33 h sshd: pam_unix(sshd:auth): authentication failure; a\x01b", "syslog_body", {"outcome": "failure", "auth_result": "failure"}),
    ("<134>Jan  2 11:22:33 fw asa: TCP access denied by ACL from 1.2.3.4/0000000000080 to inside:5.6.7.8/99999", "asa_acl", {"action": "deny", "outcome": "blocked", "transport_protocol": "tcp", "dst_role": "inside", "src_port_fixed": 80, "src_port_range": "system"}),
    ("<134>Jan 02 2024 11:22:33: fw Deny inbound UDP from 10.0.0.1/00053 to 10.0.0.2/4 on interface x", "unsupported", {"action": "deny", "outcome": "blocked", "transport_protocol": "udp", "src_port_fixed": 53, "dst_port_fixed": 4, "src_port_range": "system", "dst_port_range": "system"}),
    ("  \n", "empty", {}),
    (None, "empty", {}),
]


def test_lines(spark):
    rows = spark.createDataFrame([(k, m) for k, (m, _, _) in enumerate(LINES)], "k int, message_sanitized string")
    for r in classify(rows).collect():
        message, route, facts = LINES[r["k"]]
        assert (r["route"], {k: v for k, v in r["facts"].asDict().items() if v is not None}) == (route, facts), message
        assert r["supported"] == (route not in ("empty", "unsupported"))


def test_clashing_columns_and_empty_table(spark):
    rows = spark.createDataFrame([("x", "2 - eni-1 - - 1 2 6 1 1 1 1 ACCEPT OK", 1)], "route string, message_sanitized string, facts int")
    assert classify(rows).first()["route"] == "vpc_v2"
    assert classify(rows.limit(0)).count() == 0


def test_contract_sizes():
    assert (FACT_FEATURES, WIDTH, len(set(fact_names()))) == (477, 66287, 477)


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(max_size=3), c, max_size=3), max_leaves=8))
def test_members_of_whole_json(value):
    import json

    raw = json.dumps({"top": value})
    want = []

    def walk(v, path):
        if isinstance(v, dict):
            for k, x in v.items():
                want.append((*path, k.casefold()))
                walk(x, want[-1])
        elif isinstance(v, list):
            for x in v:
                if isinstance(x, dict):
                    walk(x, (*path, "[]"))

    walk({"top": value}, ())
    assert sorted(m.path for m in lexical.members(raw)) == sorted(want)


def test_damaged_json():
    assert [m.path for m in lexical.members('{"a": "x\\q", "b": {"c": [1, {"d": 2}], "e": "cut')] == [("a",), ("c",), ("c", "[]", "d")]
    assert lexical.value_end('{"a": [1}', 0) is None
    assert lexical.scalar('"\\q\\n"') == "\\q\n"


def brute_spans(raw):
    """Every candidate by rank, start and length, accepted if it overlaps nothing accepted before."""
    found = [(-2, a, b, k) for a, b, k in masking._flow_spans(raw)]
    for rank, (kind, form) in enumerate(masking._COMPILED):
        for m in form.finditer(raw):
            if rank != masking._ADDRESS or all(int(n) <= 255 for n in m[0].split(".")):
                found.append((rank, *m.span(), kind))
    out = []
    for rank, a, b, kind in sorted(found, key=lambda c: (c[0], c[1], -c[2])):
        if all(b <= c or a >= d for c, d, _ in out):
            out.append((a, b, kind))
    return sorted(out)


PIECES = ["USER-1", "a@b.c", "10.1.2.3", "300.1.1.1", "2024-01-02T03:04:05Z", " ", "-", '"timestamp": ', '"x y"', "rt=", "domain-1.a.b", "é", "😀", "start=10.0.0.1", "12345678-1234-1234-1234-123456789abc"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=9).map("".join))
def test_spans_are_the_greedy_choice(raw):
    assert masking.spans(raw) == brute_spans(raw)


def test_masking_expressions(spark):
    texts = ["x USER-1-USER-12 y", "CRED- <IDENTITY>  z", None, "HOST-3é"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in rows.select(masking.collapse(masking.stable(masking.masked(F.coalesce("t", F.lit(""))))).alias("m")).collect()]
    assert got[1] == " <IDENTITY> z" and got[2] == "" and re.fullmatch(r" <IDENTITY> é", got[3])
    ledger = rows.select(masking.span_ledger(F.coalesce("t", F.lit(""))).alias("l")).collect()
    for t, r in zip(texts, ledger, strict=True):
        assert "".join((t or "")[s["start"] : s["stop"]] for s in r["l"]) == (t or "")


@pytest.mark.parametrize("value,state,port", [(None, "null", None), ("", "empty", None), (" ", "empty", None), ("0080", "observed", 80), (" 443", "opaque_or_noncanonical", None), ("443.0", "opaque_or_noncanonical", None), ("65536", "outside_port_domain", None), ("00065535", "observed", 65535), ("9" * 30, "outside_port_domain", None)])
def test_record_port(spark, value, state, port):
    from tarn.functions.features import record_port

    r = spark.createDataFrame([(value,)], "p string").select(record_port(F.col("p")).alias("r")).first()["r"]
    assert (r["state"], r["port"]) == (state, port)


def csv_cells(row):
    import csv

    return next(csv.reader([row])) or [""]  # an empty row is one empty cell here


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b c", "", '"x,y"', '"q""r"', '""', "tail"]), min_size=1, max_size=6), min_size=1, max_size=20))
def test_csv_cells(spark, rows):
    """Cells are those of the csv module, in time linear in the row."""
    from tarn.operators.decoders import _CELL

    made = [",".join(r) for r in rows]
    found = spark.createDataFrame([(m,) for m in made], "row string").select("row", F.regexp_extract_all(F.concat(F.lit(","), "row"), F.lit(_CELL), F.lit(1)).alias("cells")).collect()
    for r in found:
        assert [c[1:-1].replace('""', '"') if c.startswith('"') else c for c in r["cells"]] == csv_cells(r["row"])


def test_long_csv_row(spark):
    row = "<134>Jan 02 11:22:33 fw " + ",".join(['"a,b"', "c"] * 30_000) + ",TRAFFIC,"
    assert classify(spark.createDataFrame([(row,)], "message_sanitized string")).first()["route"] == "unsupported"


def test_payload_views(spark):
    from tarn.functions.payloads import authentication_fields, payloads

    raw = '{"application": "a", "user": {"name": "x"}, "result": "USER-0001", "reason": "\\q", "txid": 5}'
    rows = spark.createDataFrame([(raw,), (None,), ("x",), ('{"behaviors": [{"cmdline": "run", "filename": 3, "a": {"parent_filepath": "p"}}]}',)], "m string")
    got = rows.select(authentication_fields("m").alias("f"), payloads("m").alias("p")).collect()
    assert [(f["name"], f["value"], f["state"]) for f in got[0]["f"]] == [("application", "a", "kept"), ("user", None, "unknown"), ("result", None, "removed"), ("reason", "\\q", "kept"), ("txid", "5", "kept")]
    assert got[1]["f"] is got[1]["p"] is got[2]["f"] is None and got[2]["p"] == []
    assert [(p["path"], p["value"]) for p in got[3]["p"]] == [("behaviors.[].cmdline", "run"), ("behaviors.[].a.parent_filepath", "p")]


def test_fact_errors(spark):
    """Facts that have no column are errors, so are numbers out of their domain."""
    from tarn.contract import facts
    from tarn.functions.features import fact_error

    rows = spark.range(1).select(fact_error(facts(policy_decision=F.lit("perhaps"))).alias("a"), fact_error(facts(policy_decision=F.lit("Allowed"), packets=F.lit(1.0))).alias("b"), fact_error(facts(bytes=F.lit(-1.0))).alias("c"))
    assert tuple(rows.first()) == ("fact_encoding_error:policy_decision", None, "fact_encoding_error:bytes")
