"""Masking of identities, clocks and device assertions in raw messages.

Spans are claimed by rank, and inside a rank from the left, the longest first; a claimed span keeps others out. Each is
replaced by its kind. The span search needs overlapping candidates with offsets in code points, which the built-in
functions don't give, so it runs in Arrow batches; the repairs of placeholders are expressions.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

_VALUE = r'(?:"(?:\\.|[^"\\])*"|[^\s,;}]+)'
_MONTHS = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_MARKER = r"\b(?:USER|HOST|CRED|ORG)-[0-9]+(?:-[0-9]+)*\b"
# Kinds of spans and their forms, by rank; below, strings of which a form needs one (looked for first).
_FORMS = [
    ("device_assertion", r'(?i)(?:"(?:classification|severity|riskScore|threatScore|quarantineRule|quarantineFolder|ruleName|attackType)"\s*:\s*|\b(?:severityCode|ruleName|attackType)=)' + _VALUE),
    ("absolute_clock", r'(?i)(?:"(?:timestamp|isotimestamp|created_at)"\s*:\s*|\b(?:created_at|start|rt)=)' + _VALUE),
    ("absolute_clock", r"^<\d{1,3}>Original Address=\S+\s+1\s+\S+\s+\S+\s+(?=flows\b|l7_firewall\b)"),
    ("absolute_clock", rf"^<\d{{1,3}}>{_MONTHS}\s+\d{{1,2}}\s+(?:(?:\d{{4}}|USER-\d+)\s+)?\d{{2}}:\d{{2}}:\d{{2}}:?\s*"),
    ("absolute_clock", r"(?<!\w)(?:\d{4}|USER-\d+)-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[Zz]|[+-]\d{2}:?\d{2})?(?!\d)"),
    ("identity", r'(?i)(?:"(?:EventRecordID|RecordNumber|ProcessId|ThreadId)"\s*:\s*|\b(?:EventRecordID|RecordNumber|ProcessID|ThreadID)=)' + _VALUE),
    ("identity", r"[\w.+-]+@[\w.-]+"),
    ("identity", r"\bdomain-[0-9]+(?:\.[A-Za-z0-9-]+)+\b"),
    ("identity", r"\b[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\b"),
    ("identity", r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w.])"),
    ("identity", _MARKER),
]
_NEEDS = ['"=', '"=', "<", "<", ":", '"=', "@", ["domain-"], "-", ".", ["USER-", "HOST-", "CRED-", "ORG-"]]
_COMPILED = [(kind, re.compile(form)) for kind, form in _FORMS]
_ADDRESS = 9  # the rank whose numbers must be 255 at most
_NEEDLES = sorted({n for needs in _NEEDS for n in needs})
_LEAST = {8: ("-", 4), 9: (".", 3)}  # of these ranks: how many of a character a form has
_FLOW_TOKENS = {1: "identity", 2: "identity", 10: "absolute_clock", 11: "absolute_clock"}


#: Fields of a flow record that say it is one, by their place, and their forms; and the fields that are masked.
_FLOW_FORMS = {0: "2", 1: r"(?i:\d{12}|-|unknown)", 2: rf"(?:eni-\S*|-|{_MARKER})", 12: "(?:ACCEPT|REJECT|-)"}
_FLOW = re.compile(r"\s*" + r"\s+".join(f"({_FLOW_FORMS.get(k, r'\S+')})" for k in range(14)) + r"\s*")


def _flow_spans(raw: str):
    """Account, interface and times of a flow record: fourteen fields, of which four have forms of their own."""
    if m := _FLOW.fullmatch(raw):
        yield from ((*m.span(k + 1), kind) for k, kind in _FLOW_TOKENS.items())


def _possible(raw: str) -> list[int]:
    """Ranks of which a message holds what their forms need (``_NEEDS``)."""
    has = {n: n in raw for n in _NEEDLES}
    return [k for k, needs in enumerate(_NEEDS) if (has[needs[0]] or (len(needs) > 1 and any(has[n] for n in needs))) and (k not in _LEAST or raw.count(_LEAST[k][0]) >= _LEAST[k][1])]


def spans(raw: str) -> list[tuple[int, int, str]]:
    """Masked spans in order, without overlaps."""
    begins: list[int] = []
    taken: list[tuple[int, int, str]] = []

    def claim(found) -> None:
        for a, b, kind in found:  # from the left; of one form, none begins where another does
            k = bisect_left(begins, a)
            if (k and taken[k - 1][1] > a) or (k < len(taken) and taken[k][0] < b):
                continue
            begins.insert(k, a)
            taken.insert(k, (a, b, kind))

    claim(_flow_spans(raw))
    start = raw.find("CEF:")
    if start >= 0:
        bars = [m.end() for m in re.finditer(r"(?<!\\)\|", raw[start:])]
        if len(bars) >= 7:
            claim([(start, start + bars[6], "device_assertion")])
    for rank in _possible(raw):
        kind, form = _COMPILED[rank]
        found = [(*m.span(), kind) for m in form.finditer(raw) if rank != _ADDRESS or max(map(int, m[0].split("."))) <= 255]
        if found:
            claim(found)
    return taken


_SHOWN = {kind: f" <{kind.upper()}> " for kind in dict(_FORMS)}


def _replaced(raw: str, found: list[tuple[int, int, str]]) -> str:
    """The message with each span replaced by its kind."""
    out, at = [], 0
    for a, b, kind in found:
        out += (raw[at:a], _SHOWN[kind])
        at = b
    return "".join([*out, raw[at:]])


def _covered(raw: str, found: list[tuple[int, int, str]]) -> list[dict]:
    """A complete cover by spans, in code points; what isn't masked is behavior_or_unresolved."""
    out, at = [], 0
    for a, b, kind in [*found, (len(raw), len(raw), "")]:
        if a > at:
            out.append({"start": at, "stop": a, "kind": "behavior_or_unresolved"})
        if b > a:
            out.append({"start": a, "stop": b, "kind": kind})
        at = b
    return out


#: Messages that are remembered, and the longest of them: logs repeat themselves, documents don't.
_REMEMBERED, _SHORT = 4096, 2048
_mask_short = lru_cache(maxsize=_REMEMBERED)(lambda raw: _replaced(raw, spans(raw)))


def mask(raw: str) -> str:
    """The message with each span replaced by its kind."""
    return _mask_short(raw) if len(raw) <= _SHORT else _replaced(raw, spans(raw))


@F.pandas_udf(StringType())
def masked(messages: pd.Series) -> pd.Series:
    """The masked message; null is an empty message."""
    return messages.map(lambda raw: mask(raw) if raw else "")


_LEDGER = ArrayType(StructType([StructField("start", IntegerType()), StructField("stop", IntegerType()), StructField("kind", StringType())]))


@F.pandas_udf(_LEDGER)
def span_ledger(messages: pd.Series) -> pd.Series:
    """A complete cover of each message by spans, in code points; what isn't masked is behavior_or_unresolved."""
    return messages.map(lambda raw: _covered(raw or "", spans(raw or "")))


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("ledger", _LEDGER)]))
def masked_with_ledger(messages: pd.Series) -> pd.DataFrame:
    """``masked`` and ``span_ledger`` of one search."""
    raw = [m or "" for m in messages]
    found = [spans(m) for m in raw]
    return pd.DataFrame({"text": list(map(_replaced, raw, found)), "ledger": list(map(_covered, raw, found))})


# Identities inside of words, and placeholders with remains of their prefix.
_INNER = r"(?:USER|HOST|CRED|ORG)-[0-9]+(?:-[0-9]+)*"
_CLUSTER = r"[ \t]*(?:(?:CRED|HOST|USER|ORG)-[ \t]*)*<IDENTITY>[ \t]*"
_INNER_COMPILED, _CLUSTER_COMPILED = re.compile(_INNER), re.compile(_CLUSTER)


def stable_text(text: str) -> str:
    """``stable`` of a string."""
    return _INNER_COMPILED.sub(" <IDENTITY> ", text)


def collapse_text(text: str) -> str:
    """``collapse`` of a string."""
    return _CLUSTER_COMPILED.sub(" <IDENTITY> ", text)


def stable(text: Column) -> Column:
    """Identities inside of words become placeholders too."""
    return F.regexp_replace(text, _INNER, " <IDENTITY> ")


def collapse(text: Column) -> Column:
    """Prefix remains around a placeholder are dropped, and its blanks made one on each side."""
    return F.regexp_replace(text, _CLUSTER, " <IDENTITY> ")


def drop_fragments(text: Column) -> Column:
    """Prefix remains before a placeholder are dropped; blanks stay."""
    return F.regexp_replace(text, r"((?:CRED|HOST|USER|ORG)-)([ \t]*)(?=<IDENTITY>)", "$2")
