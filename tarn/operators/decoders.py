"""Decoders of one-line log formats, as expressions: each gives a struct (route, supported, facts) or null.

Patterns follow the public formats (RFC 3164 and 5424 syslog, ASA access-list messages, Linux audit records, VPC flow
logs version 2, firewall flow and traffic lines). All tests run inside the JVM; Java's flags are set so that classes,
line ends and case folding are those of Unicode text: (?Ud) and (?i) with (?u).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarn.contract import facts
from tarn.functions.values import MARKER, MONTH, captures, endpoint_port, given, is_address, let, matches, number, port, port_digits, port_range, protocol_name, role

_I = "(?iuUd)"
_U = "(?Ud)"


def decoded(route: str, supported: bool = True, **observed: Column) -> Column:
    return F.struct(F.lit(route).alias("route"), F.lit(supported).alias("supported"), facts(**observed).alias("facts"))


def _endpoints(source: Column, target: Column) -> dict[str, Column]:
    return {"src_port_fixed": source, "dst_port_fixed": target, "src_port_range": port_range(source), "dst_port_range": port_range(target)}


def first_of(*candidates: Column) -> Column:
    return F.coalesce(*candidates)


# --- access-list denials ------------------------------------------------------------------------------------------

# The body of an access-list denial, and its message number.
_ASA = r'Deny\s+(tcp|udp|icmp6?|[0-9]+)\s+src\s+(\S+)\s+dst\s+(\S+)(?:\s+\(type\s+(\S+),\s*code\s+(\S+)\))?\s+by\s+[A-Za-z0-9_-]+[-_]group\s+"[^"\r\n]*"\s+\[0x[0-9a-f]+,\s*0x[0-9a-f]+\]\s*$'
_ASA_CODE = r"%(?:ASA|PIX)-[0-7]-[0-9]{6}:\s*$"
_ISO_TIME = r"\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[Zz]|[+-]\d{2}:?\d{2})?"
# The forms of a time in the prefix, in the order in which they are looked for.
_TIMES = (
    rf"(?:USER|ORG|CRED)-\d+(?:-\d+)*-\d{{2}}-\d{{2}}[Tt ]{_ISO_TIME}",
    rf"\b\d{{4}}-\d{{2}}-\d{{2}}(?:[Tt ]{_ISO_TIME})?\b",
    rf"\b{MONTH}\s+\d{{1,2}}(?:\s+\d{{4}})?(?:\s+\d{{2}}:\d{{2}}:\d{{2}})?\b",
    r"\b\d{1,2}:\d{2}:\d{2}(?:\.\d+)?\b",
)


def asa_deny(text: Column) -> Column:
    """Deny by access group, at the end of the message, after nothing or a checked collector's prefix."""
    # One pass over the message: what stands before the body, and the body's groups.
    parts = captures(text, rf"(?s){_I}(.*?){_ASA[:-1]}", 6)

    def found(c: Column) -> Column:
        proto = F.lower(c[1])
        icmp = lambda k: number(c[k], 255).cast("int")
        ends = let(F.array(endpoint_port(c[2]), endpoint_port(c[3])), lambda e: decoded("asa", action=F.lit("deny"), outcome=F.lit("blocked"), transport_protocol=F.when(proto.isin("tcp", "udp", "icmp", "icmp6"), proto), src_role=role(c[2]), dst_role=role(c[3]), icmp_type=icmp(4), icmp_code=icmp(5), **_endpoints(e[0], e[1])))
        return F.when(c.isNotNull() & _checked_prefix(F.regexp_replace(c[0], _I + _ASA_CODE, "")), ends)

    return F.when(F.contains(F.lower(text), F.lit("deny")), let(parts, found))


def _checked_prefix(prefix: Column) -> Column:
    """Nothing, or a prefix with a time and at most two names besides redacted identities."""
    timeless = reduce(lambda c, p: F.regexp_replace(c, _I + p, " TIME "), _TIMES, F.regexp_replace(prefix, _I + r"^\s*<\d{1,3}>\s*(?:1\s+)?", ""))
    tokens = F.split(F.trim(F.regexp_replace(F.regexp_replace(timeless, _U + MARKER, " ENTITY "), r"(?U)[:\s]+", " ")), " ")
    clean = let(tokens, lambda t: F.array_contains(t, "TIME") & let(F.filter(t, lambda x: ~x.isin("TIME", "ENTITY", "-", "")), lambda o: (F.size(o) <= 2) & F.forall(o, lambda x: matches(x, r"(?U)[A-Za-z][\w.-]*"))))
    return matches(prefix, r"(?U)\s*") | clean


# --- syslog wrapper and bodies ------------------------------------------------------------------------------------

_CLOCK = rf"(?:[0-2][0-9]:[0-5][0-9]:[0-5][0-9](?:\.[0-9]+)?|{MARKER}|-)"
# collectors' headers, in the order in which they are tried.
_WRAPPERS = (
    rf"{_U}(?s)<(\d{{1,3}})>1\s+\S+\s+\S+\s+\S+\s+\S+\s+\S+\s+-\s+(.+)",
    rf"{_I}(?s)(?:<([0-9]{{1,3}})>)?{MONTH}\s+[0-9]{{1,2}}\s+(?:(?:[0-9]{{4}}|{MARKER})\s+)?{_CLOCK}:?\s+\S+\s+(.+)",
    rf"{_U}(?s)<([0-9]{{1,3}})>\S+\s+\S+\s+(.+)",
)


#: How a message with a collector's header begins.
_WRAPPED = rf"(?i)\A(?:<|{MONTH})"


def syslog_payload(text: Column) -> Column:
    """The message behind a collector's header of priority 191 at most; null without one."""

    def tried(pattern: str) -> Column:
        return let(captures(text, pattern, 2), lambda c: F.when(F.coalesce(c[0].try_cast("int"), F.lit(0)) <= 191, c[1]))

    return F.when(text.rlike(_WRAPPED), first_of(*map(tried, _WRAPPERS)))


def syslog_body(text: Column) -> Column:
    """Audit records, literal denials, explicit payloads, aggregate and PAM authentication inside a collector's header."""

    def payload(whole: Column) -> Column:
        usable = whole.isNotNull() & ~F.contains(whole, F.lit("CEF:")) & ~whole.rlike(r"(?U)\A\s*[{\[]")
        return F.when(usable, let(F.regexp_replace(whole, _U + r"\A[\w.-]+(?:\[[^\]\s]+\])?:\s+", ""), lambda body: first_of(_audit(body), _acl_denial(body), _protocol_denial(body), _format_payload(body), _authentication(body))))

    return F.when(text.rlike(_WRAPPED), let(syslog_payload(text), payload))


# Fields of audit records that are read.
_AUDIT_FIELD = r'(?U)(?<!\S)(name|cwd|exe|comm|proctitle|arch|syscall|success|exit|argc|a[0-9]+)=("[^"\n]*"|\S+)'


def _audit(body: Column) -> Column:
    parts = captures(body, rf"{_U}(?s)(?:node=\S+\s+)?type=(PATH|SYSCALL|CWD|PROCTITLE|EXECVE|{MARKER})\s+msg=audit\([^\s)]+\):\s*(.*)", 2)

    def record(kind: Column, names: Column, values: Column) -> Column:
        value = lambda name: F.get(F.filter(values, lambda v, k: F.get(names, k) == name), F.lit(0))
        leave = F.regexp_replace(value("exit"), r'\A"|"\z', "")
        success = F.regexp_replace(value("success"), r'\A"|"\z', "")
        return F.when(
            F.size(F.array_distinct(names)) == F.size(names),
            decoded("audit_fields", operation_record=F.when(~kind.rlike(MARKER), F.lower(kind)), outcome=F.when(success == "yes", "success").when(success == "no", "failure"), exit_category=F.when(matches(leave, r"-?[0-9]{1,18}"), leave.try_cast("long"))),
        )

    def fields(c: Column) -> Column:
        found = let(F.regexp_extract_all(c[1], F.lit(_AUDIT_FIELD), F.lit(1)), lambda names: let(F.regexp_extract_all(c[1], F.lit(_AUDIT_FIELD), F.lit(2)), lambda values: record(c[0], names, values)))
        return F.when(c.isNotNull(), found)

    return F.when(F.contains(body, F.lit("msg=audit(")), let(parts, fields))


# The layouts of other denials, of aggregate and PAM authentication, and of literal denial sentences.
_ACL = r"(TCP|UDP|ICMP)\s+\S+\s+denied by ACL from (?:\S+)/(\S+) to ([^:\s]+):(?:\S+)/(\S+)\s*"
_PROTOCOL = r'Deny protocol ([0-9]{1,3}) src ([^:\s]+):\S+ dst ([^:\s]+):\S+ by \S+-group "[^"]+" \[[^\]]+\]\s*'
_AGGREGATE = r"\S+\s+Duration:\s*(\S+)\s+Count:\s*([^;]+);\s+[^:;]+:\s+Authentication (failure|success)\.\s*\x00?"
_PAM_FAILURE = r"\Apam_unix\([^:()]+:auth\):\s+authentication failure(?:;|\s|$)"
_PAM_SESSION = r"\Apam_unix\([^:()]+:session\):\s+session (opened|closed)\b"
_SENTENCE = r"Deny\s+(?:inbound|outbound)\s+(TCP|UDP)\s+from\s+([^\s/]+)/([^\s/]+)\s+to\s+([^\s/]+)/([^\s/]+)(?:\s+on\s+[^\r\n]+| due to DNS Response)"
_ROLE_SENTENCE = r'Deny (tcp|udp) src (inside|outside|dmz):([^/\s]+)/([^\s]+) dst (inside|outside|dmz):([^/\s]+)/([^\s]+) by \S+-group "[^"\r\n]+" \[[^\]\r\n]+\]'


def _acl_denial(body: Column) -> Column:
    parts = captures(body, _I + _ACL, 4)
    found = lambda c: F.when(c.isNotNull(), let(F.array(port(c[1]), port(c[3])), lambda p: decoded("asa_acl", action=F.lit("deny"), outcome=F.lit("blocked"), transport_protocol=F.lower(c[0]), dst_role=role(c[2]), **_endpoints(p[0], p[1]))))
    return F.when(F.contains(F.lower(body), F.lit(" denied by acl from ")), let(parts, found))


def _protocol_denial(body: Column) -> Column:
    parts = captures(body, _I + _PROTOCOL, 3)
    found = lambda c: F.when(c[0].try_cast("int") <= 255, decoded("asa_protocol", action=F.lit("deny"), outcome=F.lit("blocked"), transport_protocol=F.concat(F.lit("ipproto_"), c[0].try_cast("int").cast("string")), src_role=role(c[1]), dst_role=role(c[2])))
    return F.when(body.rlike("(?i)\\Adeny protocol "), let(parts, found))


def _format_payload(body: Column) -> Column:
    one = F.regexp_count(body, F.lit(rf"(?U)\[\s*(?:FORMAT_MESSAGE|FORMAT_{MARKER})\s*=\s*[^\]]*\]")) == 1
    return F.when(body.rlike(r"\A ?\[ Category =") & one, decoded("format_payload"))


def _authentication(body: Column) -> Column:
    other = body.rlike(_I + r"\A(?:Site:|\[|Category\s*=)")
    parts = captures(body, _I + _AGGREGATE, 3)
    seconds = lambda t: let(F.split(F.when(matches(t, r"\d+:[0-5]\d:[0-5]\d(?:\.\d+)?"), t), ":"), lambda k: k[0].cast("double") * 3600 + k[1].cast("double") * 60 + k[2].cast("double"))
    aggregate = let(parts, lambda c: F.when(c.isNotNull(), decoded("syslog_auth", outcome=F.lower(c[2]), attempt_count=number(c[1]), duration_seconds=seconds(c[0]))))
    failed = F.when(body.rlike(_I + _PAM_FAILURE), decoded("syslog_body", outcome=F.lit("failure")))
    turned = F.when(body.rlike(_I + _PAM_SESSION), decoded("syslog_body", action=F.when(F.contains(F.lower(body), F.lit("session opened")), "open").otherwise("close")))
    return F.when(~other, first_of(F.when(F.contains(F.lower(body), F.lit("authentication ")), first_of(aggregate, failed)), turned))


# --- flow logs ----------------------------------------------------------------------------------------------------


def vpc_cells(text: Column) -> Column:
    """The fields between white space of a message whose first field is 2; else null."""
    outside = F.substring(text, 1, 1).rlike(r"(?U)\s") | F.right(text, F.lit(1)).rlike(r"(?U)\s")
    trimmed = F.when(outside, F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")).otherwise(text)
    return F.when(text.rlike(r"(?U)\A\s*2\s"), F.split(trimmed, r"(?U)\s+", -1))


def vpc_numbers(cells: Column) -> Column:
    """Ports, protocol, packets and bytes of fourteen fields, each null if it isn't a number; else null."""
    return F.when(F.size(cells) == 14, F.array(*[number(F.get(cells, F.lit(k))) for k in range(5, 10)]))


def vpc_flow(cells: Column, numbers: Column) -> Column:
    """VPC flow log record, version 2: fourteen fields."""
    a, n = ([F.get(c, F.lit(k)) for k in range(size)] for c, size in ((cells, 14), (numbers, 5)))
    address = lambda c: (c == "-") | is_address(c) | c.rlike(MARKER)
    valid = (F.size(cells) == 14) & (a[0] == "2") & matches(a[1], r"(?i:\d{12}|-|unknown)") & (a[2].startswith("eni-") | matches(a[2], MARKER) | (a[2] == "-")) & a[12].isin("ACCEPT", "REJECT", "-") & address(a[3]) & address(a[4])
    ports = [F.when((n[k] <= 65535) & (n[k] == F.floor(n[k])), n[k].cast("int")) for k in (0, 1)]
    return F.when(
        valid,
        decoded(
            "vpc_v2",
            action=F.when(a[12] == "ACCEPT", "allow").when(a[12] == "REJECT", "deny"),
            outcome=F.when(a[12] == "ACCEPT", "allowed").when(a[12] == "REJECT", "blocked"),
            transport_protocol=protocol_name(F.when(n[2] <= 255, n[2])),
            packets=n[3],
            bytes=n[4],
            **_endpoints(*ports),
        ),
    )


# The layout of flow and firewall lines.
_FLOW = (
    r"<(\d{1,3})>Original Address=\S+\s+1\s+\S+\s+\S+\s+(flows|l7_firewall)\s+(?:(deny|allow)\s+)?src=\S+\s+dst=\S+(?:\s+mac=\S+)?\s+protocol=(tcp|udp|icmp|icmpv6|[0-9]{1,3})(?:\s+sport=(\S+)\s+dport=(\S+))?"
    r"(?:\s+type=(\S+)(?:\s+code=(\S+))?)?(?:\s+pattern:\s+(.+)|\s+decision=(blocked|allowed))?\s*"
)


def flow_line(text: Column) -> Column:
    """Flow and layer-7 firewall lines; where the explicit action, the decision and the pattern differ, the action is withheld."""

    def found(c: Column) -> Column:
        kind, action, decision, pattern = F.lower(c[1]), given(F.lower(c[2])), given(F.lower(c[9])), given(c[8])
        digits = F.when(matches(c[3], "[0-9]+"), c[3].try_cast("int"))
        valid = (c[0].try_cast("int") <= 191) & F.coalesce(digits <= 255, F.lit(True)) & F.when(kind == "l7_firewall", decision.isNotNull()).otherwise(pattern.isNotNull() | action.isNotNull())
        proto = F.when(matches(c[3], "[0-9]+"), let(digits, protocol_name)).when(F.lower(c[3]) == "icmpv6", "icmp6").otherwise(F.lower(c[3]))
        stated = let(captures(F.trim(pattern), _I + r"(0|1|allow|deny)\s+(?:all|dst\s+(\S+))", 2), lambda p: F.when((p[1] == "") | is_address(p[1]), F.when(F.lower(p[0]).isin("0", "allow"), "allow").otherwise("deny")))
        said = F.array_distinct(F.filter(F.array(action, F.when(decision == "blocked", "deny").when(decision == "allowed", "allow"), stated), lambda x: x.isNotNull()))

        def record(v: Column) -> Column:
            agreed, tcp_udp, icmp = v["agreed"], v["proto"].isin("tcp", "udp"), v["proto"].isin("icmp", "icmp6")
            observed = {
                "action": agreed,
                "outcome": F.when(agreed == "deny", "blocked").when(agreed == "allow", "allowed"),
                "transport_protocol": v["proto"],
                "icmp_type": F.when(icmp, number(c[6], 255).cast("int")),
                "icmp_code": F.when(icmp, number(c[7], 255).cast("int")),
            } | _endpoints(F.when(tcp_udp, v["src"]), F.when(tcp_udp, v["dst"]))
            return F.when(kind == "flows", decoded("native_flow", **observed)).otherwise(decoded("native_firewall", **observed))

        agreed = let(said, lambda s: F.when(F.size(s) == 1, s[0]))
        return F.when(valid, let(F.struct(agreed.alias("agreed"), proto.alias("proto"), port(c[4]).alias("src"), port(c[5]).alias("dst")), record))

    return F.when(F.contains(F.lower(text), F.lit(">original address=")), let(captures(F.regexp_replace(text, r"(?U)\A\s+|\s+\z", ""), _I + _FLOW, 10), found))


# --- firewall lines of no route: facts only -----------------------------------------------------------------------

_NAMED = r"(?:USER|HOST|CRED|ORG)-\d+(?:-\d+)*"
_LINE = rf"<\d{{1,3}}>{MONTH}\s+\d{{1,2}}\s+"
_DATE = r"(?:\d{4}|USER-\d+)/\d{2}/\d{2} \d{2}:\d{2}:\d{2}"
# Actions of traffic lines.
_ACTIONS = {"deny": "deny", "drop": "deny", "drop-all-packets": "deny", "block-url": "deny", "reset-client": "deny", "reset-server": "deny", "reset-both": "deny", "allow": "allow", "alert": "alert"}


def _token_port(token: Column, mixed: bool) -> Column:
    """(ok, port) of a port token: well formed, and its number (null for a redacted one)."""
    hidden = matches(token, rf"(?i:{_NAMED})") | (token == "-")
    if mixed:
        hidden = hidden | (matches(token, r"(?:[0-9]+|(?:CRED|USER|HOST|ORG)-[0-9]+(?:-[0-9]+)*)+") & token.rlike("(?:CRED|USER|HOST|ORG)-"))
    n = port_digits(token)
    return let(F.struct(hidden.alias("hidden"), n.alias("n")), lambda v: F.struct(F.coalesce(v["hidden"] | (v["n"] <= 65535), F.lit(False)).alias("ok"), F.when(~v["hidden"], v["n"]).alias("port")))


def _with_ports(source: Column, target: Column, made) -> Column:
    return let(F.array(source, target), lambda p: F.when(p[0]["ok"] & p[1]["ok"], made(p[0]["port"], p[1]["port"])))


def firewall_patch(text: Column) -> Column:
    """Facts of literal denial sentences and of CSV traffic lines, for messages that no decoder takes; else null."""
    trimmed = F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")
    body = let(captures(trimmed, _I + _LINE + r"(?:(?:\d{4}|USER-\d+)\s+)?\d{2}:\d{2}:\d{2}:?\s+\S+\s+(Deny\s+.*?)\s*", 1), lambda c: c[0])
    sentences = F.when(F.contains(F.lower(text), F.lit("deny")), let(body, lambda b: first_of(_sentence(b), _role_sentence(b))))
    traffic = F.when(F.contains(text, F.lit(",TRAFFIC,")) | F.contains(text, F.lit(",THREAT,")), let(captures(trimmed, _I + _LINE + r"\d{2}:\d{2}:\d{2}\s+\S+\s+(.*)", 1), lambda c: _traffic(c[0])))
    return F.when(text.startswith("<") | text.rlike(r"(?U)\A\s+<"), first_of(sentences, traffic))


def _sentence(body: Column) -> Column:
    parts = captures(body, _I + _SENTENCE, 5)
    address = lambda a: matches(a, rf"(?i:{_NAMED})") | is_address(a)
    made = lambda c: _with_ports(_token_port(c[2], False), _token_port(c[4], False), lambda a, b: facts(action=F.lit("deny"), outcome=F.lit("blocked"), transport_protocol=F.lower(c[0]), **_endpoints(a, b)))
    return let(parts, lambda c: F.when(c.isNotNull() & address(c[1]) & address(c[3]), made(c)))


def _role_sentence(body: Column) -> Column:
    parts = captures(body, _I + _ROLE_SENTENCE, 7)
    made = lambda c: _with_ports(_token_port(c[3], True), _token_port(c[6], True), lambda a, b: facts(action=F.lit("deny"), outcome=F.lit("blocked"), transport_protocol=F.lower(c[0]), src_role=F.lower(c[1]), dst_role=F.lower(c[4]), **_endpoints(a, b)))
    return let(parts, lambda c: F.when(c.isNotNull() & is_address(c[2]) & is_address(c[5]), made(c)))


#: A cell of a CSV row behind its comma: quoted up to its closing quote (or the row's end), or up to the next comma.
_CELL = r',("[^"]*+(?:""[^"]*+)*+(?:"[^,]*+|\z)|[^,]*+)'


def _traffic(row: Column) -> Column:
    unquoted = lambda v: F.when(v.startswith('"'), F.replace(F.regexp_replace(v, r'(?s)\A"([^"]*+(?:""[^"]*+)*+)"?(.*)\z', "$1$2"), F.lit('""'), F.lit('"'))).otherwise(v)
    cells = F.transform(F.regexp_extract_all(F.concat(F.lit(","), row), F.lit(_CELL), F.lit(1)), unquoted)

    def found(f: Column) -> Column:
        at = lambda k: F.get(f, F.lit(k))
        action = reduce(lambda c, kv: c.when(at(30) == kv[0], kv[1]), list(_ACTIONS.items())[1:], F.when(at(30) == "deny", "deny"))
        valid = (
            (F.size(f) >= 46) & (at(0) == "1") & at(3).isin("TRAFFIC", "THREAT") & at(29).isin("tcp", "udp", "icmp", "icmp6", "gre") & action.isNotNull() & at(15).startswith("vsys")
            & matches(at(28), "0x[0-9a-fA-F]+") & matches(at(1), _DATE) & matches(at(6), _DATE) & is_address(at(7)) & is_address(at(8))
        )
        ported = at(29).isin("tcp", "udp")
        made = lambda a, b: let(action, lambda done: facts(action=done, outcome=F.when(done == "deny", "blocked").when(done == "allow", "allowed"), transport_protocol=F.when(at(29) != "gre", at(29)), **_endpoints(F.when(ported, a), F.when(ported, b))))
        return F.when(valid, _with_ports(_token_port(at(24), True), _token_port(at(25), True), made))

    return let(cells, found)
