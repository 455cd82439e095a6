"""Preparation: every record with its route, facts, features, sequence input and error."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StringType, StructField, StructType

from tarn.contract import MAX_BODY_BYTES
from tarn.functions import features, masking
from tarn.functions.values import MONTH, let
from tarn.operators.decode import classify
from tarn.sources.raw import ORDER

# The sanitised event name of the registered denial, and headers that may stand before it.
_EVENT = "USER-0010-0324"
_ASA_EVENT = rf"(?iuUd)\b{_EVENT}\s+Deny\b|%(?:ASA|PIX)-[0-7]-[0-9]{{6}}:"
_HIDDEN_CLOCK = r"(?:(?:USER|HOST|CRED|ORG)-)+[0-9]+(?:-[0-9]+)*"
_LEAD = rf"<\d{{1,3}}>{MONTH}\s+\d{{1,2}}\s+"
_HEADER = rf"(?Ud)\A{_LEAD}(?:(?:\d{{4}}|{_HIDDEN_CLOCK})\s+)?(?:\d{{2}}:\d{{2}}:\d{{2}}|{_HIDDEN_CLOCK}):?\s*(?={_EVENT}\s+Deny\b)"
_PLAIN_HEADER = rf"(?Ud)\A{_LEAD}(?:(?:\d{{4}}|USER-\d+)\s+)?\d{{2}}:\d{{2}}:\d{{2}}:?\s*"
_HIDDEN_END = rf"(?Ud){_HIDDEN_CLOCK}:?\s*\z"


_TEXTS = StructType([StructField("text", StringType()), StructField("body", BinaryType()), StructField("full", features.VECTOR_TYPE), StructField("header", features.VECTOR_TYPE)])


def model_texts(raw: list[str], asa: list[bool], behind: list[str | None], plain: list[bool]) -> tuple[list[str], list[bytes | None], list[str | None]]:
    """Masked texts; of ASA bodies (null: none) also their bytes and their headers' texts."""
    texts, bodies, headers = [], [], []
    for message, is_asa, body, is_plain in zip(raw, asa, behind, plain, strict=True):
        masked = masking.stable_text(masking.mask(message))
        text = masking.collapse_text(masked) if is_asa else masked
        texts.append(text)
        if body is None:
            bodies.append(None)
            headers.append(None)
            continue
        hidden = masking.mask(body)
        bodies.append(masking.collapse_text(masking.stable_text(hidden)).encode("utf-8", "surrogatepass"))
        headers.append(text if is_plain else masking.collapse_text(masking.stable_text(f" <ABSOLUTE_CLOCK> {hidden}")))
    return texts, bodies, headers


@F.arrow_udf(_TEXTS)
def _texts(raw: pa.Array, asa: pa.Array, behind: pa.Array, plain: pa.Array) -> pa.Array:
    """``model_texts`` with the byte n-grams of texts and headers."""
    texts, bodies, headers = model_texts(raw.to_pylist(), asa.to_pylist(), behind.to_pylist(), plain.to_pylist())
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(bodies, pa.binary()), features.byte_vectors(texts), features.byte_vectors(headers)], names=["text", "body", "full", "header"])


#: So that a filter on what is made from it isn't pushed below it, into a lambda that can't hold a worker's function.
_texts = _texts.asNondeterministic()


def _classified(records: DataFrame, beside: Callable[[Column, Column, Column, Column], dict[str, Column]]) -> DataFrame:
    """``classify`` with what ``beside`` makes of the message, whether it is a denial, its body behind a registered header (or null) and
    whether that header is a plain one; and __event, __fact_error, is_asa_source, __port."""

    def columns(raw: Column, asa: Column) -> dict[str, Column]:
        plain = asa & raw.rlike(_PLAIN_HEADER)

        def registered(h: Column) -> Column:
            behind = F.substr(raw, F.length(h) + 1)
            return F.when((h != "") & behind.startswith(f"{_EVENT} Deny ") & (plain | h.rlike(_HIDDEN_END)), behind)

        return beside(raw, asa, F.when(asa, let(F.regexp_extract(raw, _HEADER, 0), registered)), plain) | {"__event": raw.rlike(_ASA_EVENT)}

    rows = classify(records, beside=columns).withColumn("__fact_error", features.fact_error(F.col("facts")))
    source = (F.col("route") == "asa") | ((F.col("route") == "unsupported") & F.col("__event"))
    return rows.withColumns({"is_asa_source": source, "__port": features.record_port(F.col("src_port"))})


def _error(size: Column) -> Column:
    """Why a row isn't as the model expects it, or null; ``size``: bytes of its body, null for none."""
    asa = F.col("route") == "asa"
    problem = F.when(F.col("is_asa_source") & ~asa, "asa_parser_unsupported").when(asa & size.isNull(), "asa_grammar_unsupported").when(size == 0, "asa_body_empty").when(size > MAX_BODY_BYTES, F.concat(F.lit("asa_body_too_long:"), size, F.lit(f">{MAX_BODY_BYTES}")))
    return F.coalesce("__fact_error", problem)


def prepare(records: DataFrame) -> DataFrame:
    """Columns added to records (event_id, message_sanitized, src_port):

    route, supported, facts: see ``classify``. text: masked message. full: the whole feature vector. is_asa_source:
    the message is a candidate for the sequence model. header, body, length: its header features and its body's bytes; null
    unless the candidate is usable. port_state, port_conflict: of the record's own port. error: why a row
    isn't as the model expects it, or null. Every row is kept, and no body is cut.
    """
    rows = _classified(records, lambda raw, asa, behind, plain: {"__texts": _texts(raw, asa, behind, plain)})
    texts, size = F.col("__texts"), F.octet_length(F.col("__texts")["body"])
    rows = rows.withColumns(
        {
            "__facts": features.fact_vector(F.when(F.col("__fact_error").isNull(), F.col("facts"))),
            "error": _error(size),
            "__ports": features.port_vector(F.col("__port")["port"], F.col("facts")["src_port_fixed"]),
        }
    )
    good = (F.col("route") == "asa") & F.col("error").isNull()
    vector = lambda of_text: features.full_vector(texts[of_text], F.col("__facts"), F.col("__ports"))
    out = rows.withColumns(
        {
            "text": texts["text"],
            "full": vector("full"),
            "header": F.when(good, vector("header")),
            "body": F.when(good, texts["body"]),
            "length": F.when(good, size),
            "port_state": F.col("__port")["state"],
            "port_conflict": features.port_conflict(F.col("__port")["port"], F.col("facts")["src_port_fixed"]),
        }
    )
    return out.drop(*[c for c in out.columns if c.startswith("__")])


#: Columns that ``prepare`` makes and ``scored_texts`` doesn't.
OF_TEXTS = frozenset({"text", "full", "header", "body", "length"})


def scored_texts(records: DataFrame, keep: Sequence[str], score: Callable[[pa.RecordBatch], tuple[np.ndarray, list]]) -> DataFrame:
    """The columns ``keep`` of ``prepare`` (none of ``OF_TEXTS``) and ``probabilities``, without making vectors as columns.

    ``score`` gets batches of raw, asa, behind, plain (see ``model_texts``), facts (null: can't be encoded) and port, and gives the
    probabilities of each row and its body's bytes (or None). So a row's n-grams never leave the worker that counts them.
    """
    rows = _classified(records, lambda raw, asa, behind, plain: {"__message": raw, "__asa": asa, "__behind": behind, "__plain": plain})
    rows = rows.withColumns({"port_state": F.col("__port")["state"], "port_conflict": features.port_conflict(F.col("__port")["port"], F.col("facts")["src_port_fixed"])})
    of_error = ["route", "is_asa_source", "__fact_error"] if "error" in keep else []
    kept = list(dict.fromkeys([*(k for k in keep if k != "error"), *of_error]))
    facts = F.when(F.col("__fact_error").isNull(), F.col("facts")).alias("__facts")
    rows = rows.select(*kept, "__message", "__asa", "__behind", "__plain", facts, F.col("__port")["port"].alias("__number"))
    names = [*kept, "__size", "probabilities"]

    def run(batches):
        for batch in batches:
            p, bodies = score(batch.select(range(len(kept), batch.num_columns)).rename_columns(["raw", "asa", "behind", "plain", "facts", "port"]))
            sizes = pa.array([None if b is None else len(b) for b in bodies], pa.int32())
            ends = pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], sizes, pa.ListArray.from_arrays(ends, pa.array(p.ravel()))], names=names)

    done = rows.mapInArrow(run, StructType([*rows.schema.fields[: len(kept)], StructField("__size", IntegerType()), StructField("probabilities", ArrayType(DoubleType()))]))
    done = done.withColumn("error", _error(F.col("__size"))) if "error" in keep else done
    return done.select(*dict.fromkeys(keep), "probabilities")


def port_summary(prepared: DataFrame) -> DataFrame:
    """One row: records with an observed port, those whose message has none, and conflicts."""
    observed = F.col("port_state") == "observed"
    return prepared.agg(F.count(F.when(observed, 1)).alias("observed"), F.count(F.when(observed & F.col("facts.src_port_fixed").isNull(), 1)).alias("message_unobserved_record_observed"), F.count(F.when(F.col("port_conflict"), 1)).alias("conflicting_observations"))


class UnsupportedRecord(ValueError):
    """A record that strict mode refuses."""


def refuse_errors(prepared: DataFrame) -> DataFrame:
    """The same rows, if none has an error; else UnsupportedRecord names the first one (strict mode).

    First by place in the source where the rows have one (``source_order``), else by event_id and error. One pass over
    the rows is made at once, and one row is brought to the driver, so the outcome doesn't depend on which task ends first.
    """
    first = [F.col(ORDER)] if ORDER in prepared.columns else []
    found = prepared.agg(F.min(F.when(F.col("error").isNotNull(), F.struct(*first, "event_id", "error"))).alias("first")).first()["first"]
    if found is not None:
        raise UnsupportedRecord(f"unsupported record {found['event_id']}: {found['error']}")
    return prepared
