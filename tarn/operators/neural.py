"""Forward passes in NumPy: a batch ensemble over sparse features, and a byte transformer that corrects its scores.

The weights are of fixed size and sent to executors once; rows are scored in Arrow batches.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

#: Sequence model: width, heads, layers, and the width of the layers between.
DIM, HEADS, LAYERS, HIDDEN = 64, 4, 2, 128
#: Rows that are computed at once; bounds a worker's memory.
ROWS = 256


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def erf(x: np.ndarray) -> np.ndarray:
    """Error function to about 1e-7 (a rational approximation)."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    y = 1 - t * np.exp(-x * x) * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.sign(x) * y


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + erf(x / np.sqrt(2)))


def layer_norm(x: np.ndarray, weight: np.ndarray, bias: np.ndarray) -> np.ndarray:
    mean = x.mean(axis=-1, keepdims=True)
    return (x - mean) / np.sqrt(((x - mean) ** 2).mean(axis=-1, keepdims=True) + 1e-5) * weight + bias


@dataclass
class EnsembleLayer:
    """Members share ``weight`` (outputs x inputs) and scale its inputs by r, its outputs by s, and add b."""

    weight: np.ndarray
    r: np.ndarray
    s: np.ndarray
    b: np.ndarray

    def dense(self, x: np.ndarray) -> np.ndarray:
        """rows x members x inputs to rows x members x outputs."""
        return (x * self.r) @ self.weight.T * self.s + self.b

    def sparse(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Rows of (columns, values). Only columns that occur are gathered; a repeated column counts as often as it occurs."""
        out = np.broadcast_to(self.b, (len(rows), *self.b.shape)).astype(np.float64).copy()
        if not rows or not sum(len(i) for i, _ in rows):
            return out
        used, at = np.unique(np.concatenate([i for i, _ in rows]), return_inverse=True)
        x = np.zeros((len(rows), len(used)))
        np.add.at(x, (np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows]), at), np.concatenate([v for _, v in rows]))
        w = self.weight[:, used]
        for m in range(len(self.r)):  # a member at a time: rows x columns are held once
            out[:, m] += (x * self.r[m, used]) @ w.T * self.s[m]
        return out


@dataclass
class Base:
    """Two ensemble layers and a head over header features, with a direct linear path for the facts."""

    first: EnsembleLayer
    second: EnsembleLayer
    head: EnsembleLayer
    direct: EnsembleLayer
    direct_from: int

    def logits(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """rows x members x classes."""
        hidden = np.maximum(self.first.sparse(rows), 0)
        hidden = np.maximum(self.second.dense(hidden), 0)
        facts = [(i[i >= self.direct_from] - self.direct_from, v[i >= self.direct_from]) for i, v in rows]
        return self.head.dense(hidden) + self.direct.sparse(facts)


def tokens_of(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each body, padded with 256 to the longest, and which of them are real. A byte 0 is data; an empty body is one padding."""
    tokens = np.full((len(bodies), max(1, *map(len, bodies))), 256)
    for k, body in enumerate(bodies):
        tokens[k, : len(body)] = np.frombuffer(body, dtype=np.uint8)
    return tokens, tokens < 256


def positions(n: int) -> np.ndarray:
    """Sines and cosines of the places 0 to n - 1."""
    angle = np.arange(n)[:, None] * np.exp(-np.log(10000.0) * np.arange(0, DIM, 2) / DIM)
    return np.stack((np.sin(angle), np.cos(angle)), axis=-1).reshape(n, DIM)


@dataclass
class Residual:
    """Byte transformer: embedding of 256 bytes and padding, positions, pre-norm layers, masked mean, head."""

    weights: dict[str, np.ndarray]

    @classmethod
    def initial(cls, seed: int, classes: int = 3) -> Residual:
        """Random weights with a head of zeros, so that it corrects nothing."""
        g = np.random.default_rng(seed)
        w = {"embedding": g.normal(0, 0.02, (257, DIM)), "norm.weight": np.ones(DIM), "norm.bias": np.zeros(DIM), "head.weight": np.zeros((classes, DIM)), "head.bias": np.zeros(classes)}
        for k in range(LAYERS):
            for name, shape in (("qkv", (3 * DIM, DIM)), ("out", (DIM, DIM)), ("up", (HIDDEN, DIM)), ("down", (DIM, HIDDEN))):
                w[f"{k}.{name}.weight"], w[f"{k}.{name}.bias"] = g.normal(0, shape[1] ** -0.5, shape), np.zeros(shape[0])
            for name in ("norm1", "norm2"):
                w[f"{k}.{name}.weight"], w[f"{k}.{name}.bias"] = np.ones(DIM), np.zeros(DIM)
        return cls(w)

    def logits(self, bodies: list[bytes]) -> np.ndarray:
        """rows x classes. Padding never counts, and a byte 0 is data."""
        w = self.weights
        tokens, real = tokens_of(bodies)
        n = tokens.shape[1]
        x = w["embedding"][tokens] + positions(n)
        for k in range(LAYERS):
            h = layer_norm(x, w[f"{k}.norm1.weight"], w[f"{k}.norm1.bias"])
            q, key, v = np.split(h @ w[f"{k}.qkv.weight"].T + w[f"{k}.qkv.bias"], 3, axis=-1)
            q, key, v = (a.reshape(len(bodies), n, HEADS, DIM // HEADS).transpose(0, 2, 1, 3) for a in (q, key, v))
            scores = q @ key.transpose(0, 1, 3, 2) / np.sqrt(DIM // HEADS)
            mixed = softmax(np.where(real[:, None, None, :], scores, -1e30)) @ v
            x = x + mixed.transpose(0, 2, 1, 3).reshape(len(bodies), n, DIM) @ w[f"{k}.out.weight"].T + w[f"{k}.out.bias"]
            h = layer_norm(x, w[f"{k}.norm2.weight"], w[f"{k}.norm2.bias"])
            x = x + gelu(h @ w[f"{k}.up.weight"].T + w[f"{k}.up.bias"]) @ w[f"{k}.down.weight"].T + w[f"{k}.down.bias"]
        x = layer_norm(x, w["norm.weight"], w["norm.bias"])
        pooled = (x * real[:, :, None]).sum(axis=1) / real.sum(axis=1, keepdims=True)
        return pooled @ w["head.weight"].T + w["head.bias"]


@dataclass
class SequenceModel:
    """Base ensemble plus residual: the residual is added to every member's logits, and members' probabilities are averaged."""

    base: Base
    residual: Residual | None = None

    def probabilities(self, rows: list[tuple[np.ndarray, np.ndarray]], bodies: list[bytes]) -> np.ndarray:
        out = []
        for k in range(0, len(rows), ROWS):
            logits = self.base.logits(rows[k : k + ROWS])
            if self.residual is not None:
                logits = logits + self.residual.logits(bodies[k : k + ROWS])[:, None, :]
            out.append(softmax(logits).mean(axis=1))
        return np.concatenate(out) if out else np.zeros((0, 3))


def score_sequences(rows: DataFrame, model: SequenceModel, into: str = "p_asa") -> DataFrame:
    """``rows`` with the sequence model's probabilities; null where ``header`` or ``body`` is null."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(headers: pd.Series, bodies: pd.Series) -> pd.Series:
        out: list = [None] * len(headers)
        use = [k for k, (h, b) in enumerate(zip(headers, bodies, strict=True)) if h is not None and b is not None]
        vectors = [(np.array([e["i"] for e in headers[k]], dtype=np.int64), np.array([e["v"] for e in headers[k]], dtype=np.float64)) for k in use]
        for k, p in zip(use, shared.value.probabilities(vectors, [bytes(bodies[k]) for k in use]), strict=True):
            out[k] = p.tolist()
        return pd.Series(out)

    return rows.withColumn(into, run("header", "body"))
