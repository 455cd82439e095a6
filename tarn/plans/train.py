"""Training: the router over sparse features, with receipts, and the saved bundle."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.contract import BYTE_FEATURES, LABELS, WIDTH
from tarn.operators import coverage, metrics
from tarn.operators.neural import Base, EnsembleLayer, Residual, SequenceModel
from tarn.operators.neural_fit import SequenceConfig, fit_sequence
from tarn.operators.prepare import prepare, refuse_errors
from tarn.operators.scoring import Router
from tarn.plans.predict import Ensemble, Fold, score_rows
from tarn.plans.publish import file_sha256
from tarn.sources.raw import ORDER, read_labelled, read_raw

#: Name of the bundle's layout.
SCHEMA = "tarn-bundle-1"


class TrainingError(ValueError):
    """Data that can't be trained on."""


@dataclass(frozen=True)
class RouterConfig:
    """Three one-against-the-rest logistic losses with an L2 penalty on the weights."""

    penalty: float = 1e-6
    iterations: int = 200
    tolerance: float = 1e-6
    history: int = 10


def _loss(rows: DataFrame, width: int):
    """A function of weights and intercept to the summed loss and its gradient; one pass over cached rows of (full, label).

    Each task adds up its own gradient, and the tasks' gradients (of fixed size) are added as a tree.
    """
    spark = rows.sparkSession

    def run(w: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, int]:
        shared = spark.sparkContext.broadcast((w, b))

        def partial(batches):
            weights, intercept = shared.value
            gw, gb, loss, n = np.zeros((width, len(LABELS))), np.zeros(len(LABELS)), 0.0, 0
            for pdf in batches:
                if not len(pdf):
                    continue
                sizes = pdf["full"].map(len).to_numpy()
                entries = [e for v in pdf["full"] for e in v]
                i = np.fromiter((e["i"] for e in entries), np.int64, len(entries))
                x = np.fromiter((e["v"] for e in entries), np.float64, len(entries))
                r = np.repeat(np.arange(len(pdf)), sizes)
                z = np.stack([np.bincount(r, x * weights[i, c], len(pdf)) for c in range(len(LABELS))], axis=1) + intercept
                y = pdf["label"].to_numpy()[:, None] == np.arange(len(LABELS))
                loss += float(np.logaddexp(0, np.where(y, -z, z)).sum())
                error = 0.5 * (1 + np.tanh(z / 2)) - y
                for c in range(len(LABELS)):
                    gw[:, c] += np.bincount(i, x * error[r, c], width)
                gb += error.sum(axis=0)
                n += len(pdf)
            used = np.flatnonzero(gw.any(axis=1))
            yield pd.DataFrame({"k": [-2, -1, *used.tolist()], "g": [[loss, float(n), 0.0], gb.tolist(), *gw[used].tolist()]})

        found = rows.select("full", "label").mapInPandas(partial, "k int, g array<double>").groupBy("k").agg(*[F.sum(F.col("g")[c]).alias(f"g{c}") for c in range(len(LABELS))]).toPandas()
        shared.unpersist()
        g = found[[f"g{c}" for c in range(len(LABELS))]].to_numpy()
        k = found["k"].to_numpy()
        gw = np.zeros((width, len(LABELS)))
        gw[k[k >= 0]] = g[k >= 0]
        return float(g[k == -2][0, 0]), gw, g[k == -1][0], int(g[k == -2][0, 1])

    return run


def fit_router(rows: DataFrame, config: RouterConfig = RouterConfig(), width: int = WIDTH, history: list[dict] | None = None) -> Router:
    """Fit on rows of (full, label): limited-memory quasi-Newton steps with backtracking, from the classes' log rates.

    ``history`` gets the objective and the largest gradient of each step.
    """
    rows = rows.select("full", "label").cache()
    try:
        support = {r["label"]: r["support"] for r in metrics.class_support(rows).collect()}
        n = sum(support.values())
        if min(support.values()) == 0:
            raise TrainingError("a class has no rows")
        evaluate = _loss(rows, width)
        classes = len(LABELS)
        b0 = np.array([np.log(support[c] / (n - support[c])) for c in range(classes)])

        def objective(p: np.ndarray) -> tuple[float, np.ndarray]:
            w, b = p[:-classes].reshape(width, classes), p[-classes:]
            loss, gw, gb, _ = evaluate(w, b)
            return loss / n + 0.5 * config.penalty * float((w * w).sum()), np.concatenate(((gw / n + config.penalty * w).ravel(), gb / n))

        p = np.concatenate((np.zeros(width * classes), b0))
        value, gradient = objective(p)
        steps: list[tuple[np.ndarray, np.ndarray, float]] = []
        for step_number in range(config.iterations):
            if history is not None:
                history.append({"step": step_number, "objective": value, "gradient": float(np.abs(gradient).max())})
            if np.abs(gradient).max() <= config.tolerance:
                break
            q, alphas = gradient.copy(), []
            for s, y, rho in reversed(steps):
                alphas.append(rho * (s @ q))
                q -= alphas[-1] * y
            if steps:
                s, y, _ = steps[-1]
                q *= (s @ y) / (y @ y)
            for (s, y, rho), alpha in zip(steps, reversed(alphas), strict=True):
                q += (alpha - rho * (y @ q)) * s
            slope, step = -(gradient @ q), 1.0 if steps else min(1.0, 1 / np.abs(gradient).sum())
            for _ in range(30):
                new_value, new_gradient = objective(p - step * q)
                if new_value <= value + 1e-4 * step * slope:
                    break
                step /= 2
            else:
                break
            s, y = -step * q, new_gradient - gradient
            if s @ y > 1e-12:
                steps = [*steps, (s, y, 1 / (s @ y))][-config.history :]
            p, done, value, gradient = p - step * q, abs(value - new_value) <= 1e-12 * max(1.0, abs(value)), new_value, new_gradient
            if done:
                break
        return Router(p[:-classes].reshape(width, classes), p[-classes:])
    finally:
        rows.unpersist()


def read_training(spark: SparkSession, path: str, limit_rows: int | None = None, unsupported: str = "error") -> DataFrame:
    """Prepared, labelled records. ``unsupported``: ``error`` raises for the first row that has an error, ``router`` leaves it to the router."""
    if unsupported not in ("error", "router"):
        raise ValueError(f"unsupported: error or router, not {unsupported}")
    rows = prepare(read_raw(spark, path, labels=True, order=True) if limit_rows is None else read_labelled(spark, path, limit_rows))
    return (refuse_errors(rows) if unsupported == "error" else rows).drop(ORDER)


def validate_datasets(train: DataFrame, validation: DataFrame) -> dict:
    """Counts of both sets; raises if ids repeat or are shared, if a class is missing from training, or if a set is empty.

    Both have event_id, label and full. ``shared_inputs`` counts validation rows whose features also occur in training.
    """
    for rows in (train, validation):
        if coverage.duplicate_ids(rows).limit(1).count():
            raise TrainingError("event_id repeats")
    if coverage.shared_ids(train, validation, "event_id").limit(1).count():
        raise TrainingError("training and validation share ids")
    key = F.sha2(F.to_json("full"), 256).alias("row_key")
    out = {"train_rows": train.count(), "validation_rows": validation.count(), "shared_inputs": coverage.shared_rows(train.select(key), validation.select(key), "row_key").count()}
    if not out["train_rows"] or not out["validation_rows"]:
        raise TrainingError("a set is empty")
    if metrics.class_support(train).where("support = 0").count():
        raise TrainingError("a class has no rows")
    return out


def dataset_digest(rows: DataFrame) -> str:
    """A digest of the multiset of rows (event_id, label, full), whatever their order: the count, and sums of four parts of the row hashes.

    Repeated rows count as often as they occur.
    """
    row = F.sha2(F.to_json(F.struct("event_id", "label", "full")), 256)
    part = lambda k: F.sum(F.conv(F.substring(row, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)"))
    found = rows.agg(F.count(F.lit(1)).alias("n"), *[part(k).alias(f"p{k}") for k in range(4)]).first()
    return "-".join(str(v) for v in found)


def evaluate(rows: DataFrame, model: Ensemble) -> dict:
    """Confusion matrix and class metrics over prepared, labelled rows, scored as ``predict`` scores them (sequence models too)."""
    done = score_rows(rows.select("label", "full", *[c for c in ("header", "body") if c in rows.columns]), model)
    matrix = metrics.confusion(done, predicted="pred_class").cache()
    out = {"confusion": [r.asDict() for r in matrix.orderBy("label", "predicted").collect()], "classes": [r.asDict() for r in metrics.class_metrics(matrix).orderBy("label").collect()], **metrics.macro(matrix).first().asDict()}
    matrix.unpersist()
    return out


# --- bundles ------------------------------------------------------------------------------------------------------


def _arrays(model: SequenceModel) -> dict[str, np.ndarray]:
    out = {}
    for name in ("first", "second", "head", "direct"):
        layer: EnsembleLayer = getattr(model.base, name)
        out |= {f"base.{name}.{k}": getattr(layer, k) for k in ("weight", "r", "s", "b")}
    out["base.direct_from"] = np.array(model.base.direct_from)
    if model.residual is not None:
        out |= {f"residual.{k}": v for k, v in model.residual.weights.items()}
    return out


def save_bundle(model: Ensemble, folder: str, config: RouterConfig | None = None) -> None:
    """Arrays of each fold and a manifest with their sizes and hashes; an existing bundle is an error."""
    at = Path(folder)
    at.mkdir(parents=True, exist_ok=True)
    if (at / "manifest.json").exists():
        raise FileExistsError(at / "manifest.json")
    files = {}
    for k, fold in enumerate(model.folds):
        arrays = {"router.weights": fold.router.weights, "router.intercept": fold.router.intercept} | (_arrays(fold.sequence) if fold.sequence else {})
        np.savez_compressed(at / f"fold{k}.npz", **arrays)
        files[f"fold{k}.npz"] = {"sha256": file_sha256(at / f"fold{k}.npz"), "bytes": os.path.getsize(at / f"fold{k}.npz")}
    (at / "manifest.json").write_text(json.dumps({"schema": SCHEMA, "folds": len(model.folds), "files": files, "configuration": asdict(config) if config else None}, indent=2) + "\n")


def load_bundle(folder: str) -> Ensemble:
    """A saved bundle; a missing, changed or misshapen file raises."""
    at = Path(folder)
    manifest = json.loads((at / "manifest.json").read_text())
    if manifest.get("schema") != SCHEMA or len(manifest["files"]) != manifest["folds"]:
        raise TrainingError("not a bundle")
    folds = []
    for k in range(manifest["folds"]):
        name = f"fold{k}.npz"
        stated = manifest["files"][name]
        if os.path.getsize(at / name) != stated["bytes"] or file_sha256(at / name) != stated["sha256"]:
            raise TrainingError(f"{name} isn't what the manifest says")
        with np.load(at / name, allow_pickle=False) as data:
            a = dict(data)
        router = Router(a["router.weights"], a["router.intercept"])
        if router.weights.shape != (WIDTH, len(LABELS)) or router.intercept.shape != (len(LABELS),) or not np.isfinite(router.weights).all():
            raise TrainingError(f"{name}: the router's shape or values")
        sequence = None
        if "base.direct_from" in a:
            layers = {n: EnsembleLayer(*(a[f"base.{n}.{k}"] for k in ("weight", "r", "s", "b"))) for n in ("first", "second", "head", "direct")}
            residual = {n.removeprefix("residual."): v for n, v in a.items() if n.startswith("residual.")}
            sequence = SequenceModel(Base(**layers, direct_from=int(a["base.direct_from"])), Residual(residual) if residual else None)
        folds.append(Fold(router, sequence))
    return Ensemble(folds)


def fit_sequence_model(rows: DataFrame, config: SequenceConfig, history: list[dict] | None = None) -> SequenceModel | None:
    """The sequence model of the rows that it can read (header and body), at most ``config.max_rows`` of them; None without such rows."""
    usable = rows.where("header is not null and body is not null").select("event_id", "label", "header", "body")
    chosen = usable.orderBy(F.xxhash64("event_id"), "event_id").limit(config.max_rows).collect()  # a bounded number of rows of some KB
    if not chosen:
        return None
    vectors = [(np.array([e["i"] for e in r["header"]], dtype=np.int64), np.array([e["v"] for e in r["header"]], dtype=np.float64)) for r in chosen]
    return fit_sequence(vectors, [bytes(r["body"]) for r in chosen], np.array([r["label"] for r in chosen]), WIDTH, BYTE_FEATURES, config, history)


def train_bundle(spark: SparkSession, train: DataFrame, validation: DataFrame, folder: str, config: RouterConfig = RouterConfig(), sequence: SequenceConfig | None = None) -> dict:
    """Check both sets, fit the router and (with ``sequence``) the sequence model, save, load again and evaluate the loaded bundle.

    Receipts beside it: plan, history of the fit, and result or failure; an existing folder is an error.

    ``train`` and ``validation`` are prepared and labelled. Data that is refused leaves no folder.
    """
    checks = validate_datasets(train, validation)
    plan = {"checks": checks, "configuration": asdict(config), "sequence": asdict(sequence) if sequence else None, "train_digest": dataset_digest(train), "validation_digest": dataset_digest(validation)}
    at, history = Path(folder), []
    at.mkdir(parents=True)
    (at / "plan.json").write_text(json.dumps(plan, indent=2) + "\n")
    try:
        model = Ensemble([Fold(fit_router(train, config, history=history), fit_sequence_model(train, sequence, history) if sequence else None)])
        save_bundle(model, folder, config)
        result = evaluate(validation, load_bundle(folder))
    except Exception as error:
        (at / "failure.json").write_text(json.dumps({"error": f"{type(error).__name__}: {error}"[:2000]}) + "\n")
        raise
    finally:
        (at / "history.jsonl").write_text("".join(json.dumps(h) + "\n" for h in history))
    (at / "result.json").write_text(json.dumps(result, indent=2) + "\n")
    return result
