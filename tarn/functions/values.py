"""Scalar expressions that decoders share: captures, numbers, ports, roles, addresses."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separates captures. Where a text holds this control character itself, the next one stands for it: no pattern tells them apart.
_CUT, _INSTEAD = "\x01", "\x02"
# Redacted identities as they stand in sanitised messages.
MARKER = r"(?i:(?:USER|ORG|CRED)(?:-(?:USER|ORG|CRED))*-\d+(?:-\d+)*)"
MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"(?:{_OCTET}\.){{3}}{_OCTET}"
_H = "[0-9A-Fa-f]{1,4}"
IPV6 = "(?:" + "|".join([rf"(?:{_H}:){{7}}{_H}", rf"(?:{_H}:){{6}}{IPV4}", *(rf"(?:{_H}(?::{_H}){{0,{left - 1}}})?::(?:{_H}(?::{_H}){{0,{6 - left}}})?" if left else rf"::(?:{_H}(?::{_H}){{0,6}})?" for left in range(0, 7)), rf"(?:{_H}:){{7}}:", rf"(?:(?:{_H}:){{0,5}}{_H})?::(?:{_H}:){{0,4}}{IPV4}"]) + ")"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once a row, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def matches(text: Column, pattern: str) -> Column:
    """Whether the whole text matches."""
    return F.coalesce(text.rlike(rf"\A(?:{pattern})\z"), F.lit(False))


def captures(text: Column, pattern: str, groups: int) -> Column:
    """The groups of a pattern that matches the whole text, as an array ('' for a group that took no part); else null.

    One pass of the pattern: the replacement begins with a separator, so that it shows whether there was a match.
    """
    marked = F.regexp_replace(F.translate(text, _CUT, _INSTEAD), rf"\A(?:{pattern})\z", "".join(f"{_CUT}${k}" for k in range(1, groups + 1)))
    return let(F.split(marked, _CUT, -1), lambda parts: F.when(F.size(parts) > 1, F.slice(parts, 2, groups)))


def given(value: Column) -> Column:
    """Null for the empty string."""
    return F.when(value != "", value)


def number(value: Column, most: float | None = None) -> Column:
    """A non-negative decimal (double), or null: redacted, malformed or above ``most``."""
    found = F.when(matches(value, r"(?U)\s*[0-9]+(?:\.[0-9]+)?\s*"), F.trim(value).try_cast("double"))
    return found if most is None else let(found, lambda n: F.when(n <= most, n))


def port(value: Column) -> Column:
    """A port number, or null."""
    return let(number(value, 65535), lambda n: F.when(n == F.floor(n), n.cast("int")))


def port_range(value: Column) -> Column:
    return F.when(value <= 1023, "system").when(value <= 49151, "user").when(value.isNotNull(), "dynamic")


# Protocol numbers with names.
_PROTOCOLS = {6: "tcp", 17: "udp", 1: "icmp", 58: "icmp6"}


def protocol_name(n: Column) -> Column:
    """Name of an IP protocol number (double or int); null for none or a broken number."""
    named = reduce(lambda c, kv: c.when(n == kv[0], kv[1]), _PROTOCOLS.items(), F.when(n.isNull(), None))
    return named.when(n == F.floor(n), F.concat(F.lit("ipproto_"), n.cast("long").cast("string")))


def role(endpoint: Column) -> Column:
    """Role of an interface name: the part before the first colon; null where it says nothing."""
    name = F.lower(F.substring_index(endpoint, ":", 1))
    return F.when(name.isin("inside", "outside", "identity", "internet"), name).when(matches(name, r"dmz(?:[-_]\d+)?"), "dmz")


def is_address(value: Column) -> Column:
    return matches(value, f"{IPV4}|{IPV6}")


def port_digits(token: Column) -> Column:
    """The number of a token of digits, however many zeros lead it; null for other tokens and numbers of more than nine digits."""
    return F.when(matches(token, "[0-9]+"), F.regexp_extract(token, r"\A0*([0-9]{1,9})\z", 1).try_cast("int"))


def endpoint_port(endpoint: Column) -> Column:
    """The port of interface:address/port, or null: absent, redacted or invalid."""
    return let(port_digits(F.regexp_extract(endpoint, r"(?s)\A[^:]*:.*/([0-9]+)\z", 1)), lambda n: F.when(n <= 65535, n))
