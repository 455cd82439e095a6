"""Texts of decoded payloads: normalised, redacted, and made from facts. Features don't need them; reports and audits do.

Event descriptions are read as lines of ``label: value`` and payload texts as words, by lists of labels and field names.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarn.functions.values import IPV4, MARKER, let, matches, port_digits

# Identities that are replaced in payload texts, in this order.
_ENTITIES = (
    r"(?iU)[\w-]*(?:USER|ORG|CRED)-[0-9][\w-]*",
    rf"(?U)(?<![\w.]){IPV4}(?![\w.])",
    r"(?iU)\b[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\b",
    r"(?iU)\b(?:[0-9a-f]{2}[:-]){5}[0-9a-f]{2}\b",
    r"(?iU)\b[0-9a-f]{16,}\b",
)
#: Letters whose case folding isn't their lower case: single ones, and sharp s.
_FOLDED = {chr(c): chr(c).casefold() for c in range(128, 0x20000) if len(chr(c).casefold()) == 1 and chr(c).casefold() != chr(c).lower()}


def folded(text: Column) -> Column:
    """Case folding, but for rare letters that fold into several (of these only sharp s)."""
    return F.translate(F.replace(F.lower(text), F.lit("\u00df"), F.lit("ss")), "".join(_FOLDED), "".join(_FOLDED.values()))


def payload_text(text: Column) -> Column:
    """Redacted words, addresses, UUIDs, MACs and long hex become ``entity``; blanks are one; letters folded."""
    for pattern in _ENTITIES:
        text = F.regexp_replace(text, pattern, "entity")
    return folded(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


#: Labels of event descriptions whose values name somebody, and last words of labels whose values are numbers of a session.
_PRIVATE = ("account name", "account domain", "workstation name", "security id")
_NUMBERED = ("id", "handle")


def windows_text(text: Column) -> Column:
    """A Windows event description without account names, session numbers and security ids."""

    def line(whole: Column) -> Column:
        label = F.lower(F.btrim(F.substring_index(whole, ":", 1), F.lit(" \t")))
        value = F.btrim(F.substr(whole, F.instr(whole, ":") + 1), F.lit(" \t\r"))
        last = F.substring_index(label, " ", -1)
        number = F.regexp_extract(value, r"(?i)\A0x[0-9a-f]+\b", 0)
        hidden = F.when(label.isin(*_PRIVATE), value).when(last.isin(*_NUMBERED), number).otherwise("")
        return F.when((F.instr(whole, ":") > 0) & (hidden != ""), F.replace(whole, hidden, F.lit("entity"))).otherwise(whole)

    def word(one: Column) -> Column:
        parts = F.split(F.upper(one), "-")
        numbers = F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0)))
        is_sid = (F.size(parts) > 2) & (parts[0] == "S") & (parts[1] == "1") & F.forall(numbers, lambda n: matches(n, "[0-9]+"))
        return F.when(is_sid, "entity").otherwise(one)

    lines = F.array_join(F.transform(F.split(text, "\n"), line), "\n")
    return F.array_join(F.transform(F.split(lines, r"(?<=[\s,;()])|(?=[\s,;()])"), word), "")


#: Elements of a scheduled task that hold the times of its boundaries.
_BOUNDARIES = ("StartBoundary", "EndBoundary")
_DAY, _TIME, _ZONE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}", r"[0-9]{2}(?::[0-9]{2}){2}(?:\.[0-9]+)?", r"(?:Z|[+-][0-9]{2}:?[0-9]{2})"


def without_clocks(text: Column) -> Column:
    """Absolute times (ISO 8601) go; the times of task boundaries become a word."""
    for name in _BOUNDARIES:
        text = F.regexp_replace(text, rf"(?i)(?<=<{name}>)[^<]*+(?=</{name}>)", "absolute_time")
    return F.btrim(F.regexp_replace(text, rf"(?i)(?<![\p{{L}}\p{{N}}_]){_DAY}[T ]{_TIME}{_ZONE}?(?![0-9])", " "))


def endpoint(text: Column) -> Column:
    """(interface, port, state) of interface:address/port: observed, redacted, invalid or absent; unparsed without a colon."""
    name = F.lower(F.substring_index(text, ":", 1))
    token = F.regexp_extract(text, r"(?s)\A[^:]*:.*/([^/]*)\z", 1)

    def parts(t: Column) -> Column:
        n = port_digits(t)
        state = F.when(F.instr(text, ":") == 0, "unparsed").when(~text.rlike(r"(?s)\A[^:]*:.*/"), "absent").when(t.rlike(MARKER), "redacted").when(n <= 65535, "observed").otherwise("invalid")
        return let(state, lambda s: F.struct(F.when(s != "unparsed", name).alias("interface"), F.when(s == "observed", n).alias("port"), s.alias("state")))

    return let(token, parts)


#: Stands in a fact for a value that was there and not understood.
UNKNOWN = "unknown_value"


def facts_text(facts: Column, names: list[str]) -> Column:
    """Observed facts as ``name value`` in order of their names; values that weren't understood are left out."""
    parts = [F.when(facts[n].isNotNull() & ~facts[n].cast("string").isin("", UNKNOWN), F.concat(F.lit(f"{n} "), facts[n].cast("string"))) for n in sorted(names)]
    return F.concat_ws(" ", *parts)


# Routes whose text only repeats their facts.
_GENERATED = ("asa", "asa_acl", "asa_protocol", "native_flow", "native_firewall", "vpc_v2", "syslog_auth")
#: Fields of a behaviour and the words that show them, and fields of an authentication object that go unnamed.
_SHOWN = {"cmdline": "command", "filename": "file", "filepath": "path"}
_UNNAMED = ("reason", "result", "factor")


def _shown_fields() -> dict[str, str]:
    out = {}
    for inside in ("", "parent_details."):
        for own, word in _SHOWN.items():
            out[f"behaviors.[].{inside}{own}"], out[f"behaviors.[].{inside}parent_{own}"] = word, f"parent {word}"
    return out


def route_text(text: Column, route: Column) -> Column:
    """A payload text as its route shows it: empty for generated ones, without field names for authentication, with plain ones for payloads."""
    words = F.create_map(*[F.lit(x) for pair in _shown_fields().items() for x in pair])

    def shown(all_words: Column) -> Column:
        named = F.transform(all_words, lambda w: F.coalesce(F.element_at(words, w), w))
        plain = F.when(named[0] == "message", F.slice(named, 2, F.size(named))).otherwise(named)
        said = F.filter(all_words, lambda w: ~w.isin(*_UNNAMED))
        return F.array_join(F.when(route == "authentication", said).when(route == "bounded_payload", plain).otherwise(all_words), " ")

    return F.when(route.isin(*_GENERATED), "").otherwise(F.trim(let(F.split(text, " "), shown)))
