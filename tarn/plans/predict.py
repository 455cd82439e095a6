"""Prediction: raw records to event_id, pred_label."""

from __future__ import annotations

import os
import time
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tarn.contract import BYTE_FEATURES, FACT_FEATURES, LABELS, MAX_BODY_BYTES, WIDTH
from tarn.functions import features
from tarn.operators import coverage, scoring
from tarn.operators.neural import SequenceModel
from tarn.operators.prepare import OF_TEXTS, model_texts, prepare, refuse_errors, scored_texts
from tarn.operators.scoring import Router, flat_vectors
from tarn.plans.publish import counts, file_sha256, publish_csv, publish_table, write_report
from tarn.sources.raw import ORDER, ContractError, read_raw


@dataclass
class Fold:
    """One fitted model: the router for all rows, and the sequence model for rows it can read."""

    router: Router
    sequence: SequenceModel | None = None


@dataclass
class Ensemble:
    folds: Sequence[Fold] = field(default_factory=list)


def _some(vectors: pa.ListArray, use: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(indices, values) of the sparse vectors of some rows."""
    first, i, v = flat_vectors(vectors)
    return [(i[first[k] : first[k + 1]], v[first[k] : first[k + 1]]) for k in use]


def _probabilities(folds: Sequence[Fold], batch: pa.RecordBatch) -> np.ndarray:
    """Mean over folds: the sequence model's probabilities where a row has a header and a body, else the router's."""
    full, total = flat_vectors(batch.column("full")), np.zeros((batch.num_rows, len(LABELS)))
    if len(full[1]) and not (0 <= full[1].min() <= full[1].max() < WIDTH and np.isfinite(full[2]).all()):
        raise ValueError("a feature vector is too wide or isn't finite")
    use: list[int] = []
    if any(f.sequence is not None for f in folds) and "body" in batch.schema.names:
        use = np.flatnonzero(pc.and_(batch.column("header").is_valid(), batch.column("body").is_valid()).to_numpy(zero_copy_only=False)).tolist()
    headers = _some(batch.column("header"), use) if use else []
    bodies = batch.column("body").take(pa.array(use, pa.int64())).to_pylist() if use else []
    for fold in folds:
        p = fold.router.flat_probabilities(*full)
        if fold.sequence is not None and use:
            p[use] = fold.sequence.probabilities(headers, bodies)
        total += p
    return total / len(folds)


def score_rows(rows: DataFrame, model: Ensemble) -> DataFrame:
    """Prepared rows with ``probabilities``, class and label.

    All folds score a batch in one pass of a worker; the weights are of fixed size and sent to executors once.
    """
    shared = rows.sparkSession.sparkContext.broadcast(list(model.folds))

    def run(batches):
        for batch in batches:
            p = _probabilities(shared.value, batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(p), pa.list_(pa.float64()))], names=[*batch.schema.names, "probabilities"])

    return scoring.decide(rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("probabilities", ArrayType(DoubleType()))])))


def _score_texts(folds: Sequence[Fold], batch: pa.RecordBatch) -> tuple[np.ndarray, list[bytes | None]]:
    """``_probabilities`` of messages that aren't prepared yet (see ``scored_texts``), and their bodies."""
    n = batch.num_rows
    raw, asa, behind, plain = (batch.column(c).to_pylist() for c in ("raw", "asa", "behind", "plain"))
    texts, bodies, headers = model_texts(raw, asa, behind, plain)
    facts = batch.column("facts")
    given = facts.is_valid().to_numpy(zero_copy_only=False)
    row, index, value = features.fact_entries(facts)
    if not np.isfinite(value).all():
        raise ValueError("a feature vector isn't finite")
    ported = features.port_entries(batch.column("port"), pc.struct_field(facts, "src_port_fixed"))
    behind_text = [(row, index + BYTE_FEATURES, value), (ported[0], ported[1] + BYTE_FEATURES + FACT_FEATURES, ported[2])]

    def whole(of_text: features.Entries) -> features.Entries:
        """Entries of the whole vectors; a row whose facts can't be encoded has none."""
        row, index, value = map(np.concatenate, zip(of_text, *behind_text, strict=True))
        value = value.astype(np.float64)
        return (row, index, value) if given.all() else (row[given[row]], index[given[row]], value[given[row]])

    use = [k for k in range(n) if asa[k] and given[k] and bodies[k] is not None and 0 < len(bodies[k]) <= MAX_BODY_BYTES] if any(f.sequence is not None for f in folds) else []
    if use:
        row, index, value = whole(features.byte_entries([headers[k] if headers[k] is not None else "" for k in range(n)]))
        order = np.lexsort((index, row))
        first = np.searchsorted(row[order], [*range(n + 1)])
        pairs = [(index[order[first[k] : first[k + 1]]], value[order[first[k] : first[k + 1]]]) for k in use]
    full, total = whole(features.byte_entries(texts)), np.zeros((n, len(LABELS)))
    for fold in folds:
        p = scoring.softmax_rows(fold.router.entry_scores(*full, n))
        if fold.sequence is not None and use:
            p[use] = fold.sequence.probabilities(pairs, [bodies[k] for k in use])
        total += p
    return total / len(folds), bodies


def predict(records: DataFrame, model: Ensemble, strict: bool = False, keep: Sequence[str] | None = None) -> DataFrame:
    """Prepared records (or of them the columns ``keep``) with the folds' mean probabilities, class and label; one lazy plan.

    Rows that the sequence model can't read are scored by the router and say why in ``error``; with ``strict`` the first of
    them raises at once. With ``keep``, vectors aren't made as columns: rows are masked, counted and scored in one pass of a worker.
    """
    rows = prepare(records) if strict or keep is None else None
    rows = refuse_errors(rows) if strict else rows
    if keep is None:
        return score_rows(rows, model)
    if not OF_TEXTS.isdisjoint(keep):
        return score_rows(prepare(records).select(*dict.fromkeys([*keep, "full", "header", "body"])), model)
    shared = records.sparkSession.sparkContext.broadcast(list(model.folds))
    return scoring.decide(scored_texts(records, keep, lambda batch: _score_texts(shared.value, batch)))


def fingerprint(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Names, sizes and times of change of a source's files, on any store that Spark can read."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(at, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(found)


def predict_table(spark: SparkSession, source: str, output: str, model: Ensemble, strict: bool = False) -> dict:
    """Predict a source of any size into a CSV folder on any store; executors read and write all rows.

    Duplicate ids, an input that changes meanwhile and an existing output raise. The folder is written once, and counted from there.
    """
    before, records = fingerprint(spark, source), read_raw(spark, source)
    if coverage.duplicate_ids(records).limit(1).count():
        raise ContractError("event_id repeats")
    publish_table(predict(records, model, strict, ["event_id"]).select("event_id", "pred_label"), output)
    labels = counts(spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(output), "pred_label")
    if fingerprint(spark, source) != before or not labels:
        raise ContractError("the input changed, or is empty")
    return {"counts_by_label": labels, "rows": sum(labels.values()), "folds": len(model.folds)}


def predict_file(spark: SparkSession, source: str, output: str, model: Ensemble, strict: bool = False, report: str | None = None) -> dict:
    """Predict a source and publish one local CSV in the order of the source, with a report; ``predict_table`` has no such limits.

    Duplicate ids raise and leave nothing behind, as does an input that changes meanwhile. The result is cached while it is
    counted and written.
    """
    if os.path.exists(output) or report and os.path.exists(report):
        raise FileExistsError(output)
    began, before = time.time(), fingerprint(spark, source)
    records = read_raw(spark, source, order=True)
    if coverage.duplicate_ids(records).limit(1).count():
        raise ContractError("event_id repeats")
    done = predict(records, model, strict, ["event_id", "route", "error", "port_state", ORDER]).select("event_id", "pred_label", "route", "error", "port_state", ORDER).cache()
    try:
        made = {
            "counts_by_label": counts(done, "pred_label"),
            "counts_by_route": counts(done, "route"),
            "counts_by_fallback": counts(done.where("error is not null").withColumn("reason", F.substring_index("error", ":", 1)), "reason"),
            "folds": len(model.folds),
        }
        made["rows"] = publish_csv(done.orderBy(ORDER).select("event_id", "pred_label").toLocalIterator(), output)
        if fingerprint(spark, source) != before or made["rows"] != sum(made["counts_by_label"].values()) or not made["rows"]:
            os.unlink(output)
            raise ContractError("the input changed, or is empty")
    finally:
        done.unpersist()
    if os.path.isfile(source):
        made["input_sha256"] = file_sha256(source)
    made |= {"output_sha256": file_sha256(output), "seconds": round(time.time() - began, 3)}
    if report:
        write_report(made, report)
    return made
