"""Minibatch training of the sequence model in NumPy: gradients by hand, decoupled weight decay with adaptive steps.

Steps follow one another, so this runs in one process over a bounded number of rows (``SequenceConfig.max_rows``). Stages: the base
ensemble, each member by its own cross entropy; then, with the base frozen, the byte transformer that corrects its scores,
with a rising rate at first.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from tarn.contract import LABELS
from tarn.operators.neural import DIM, HEADS, LAYERS, Base, EnsembleLayer, Residual, SequenceModel, erf, positions, softmax, tokens_of

Rows = list[tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class SequenceConfig:
    """``max_rows``: rows that are fitted on at most, those with the smallest hashes of their ids. ``warm_up``: share of steps in which the residual's rate rises."""

    base_epochs: int = 2
    residual_epochs: int = 2
    base_rate: float = 1e-3
    residual_rate: float = 5e-4
    decay: float = 1e-4
    batch: int = 256
    members: int = 16
    hidden: int = 128
    warm_up: float = 0.1
    seed: int = 1
    max_rows: int = 200_000


def initial_base(width: int, direct_from: int, config: SequenceConfig) -> Base:
    """Uniform weights within 1 / sqrt(inputs); members differ by random input scales of the first layer."""
    g = np.random.default_rng(config.seed)
    m = config.members

    def layer(outputs: int, inputs: int, scales: np.ndarray | None = None) -> EnsembleLayer:
        bound = inputs**-0.5
        return EnsembleLayer(g.uniform(-bound, bound, (outputs, inputs)), np.ones((m, inputs)) if scales is None else scales, np.ones((m, outputs)), g.uniform(-bound, bound, (m, outputs)))

    first = layer(config.hidden, width, g.normal(size=(m, width)))
    return Base(first, layer(config.hidden, config.hidden), layer(len(LABELS), config.hidden), layer(len(LABELS), width - direct_from), direct_from)


def loss_and_slope(logits: np.ndarray, labels: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean cross entropy over rows and members (rows x members x classes), and its gradient."""
    p = softmax(logits)
    at = np.arange(len(labels))
    loss = -np.log(np.maximum(p[at, :, labels], 1e-300)).mean()
    p[at, :, labels] -= 1
    return float(loss), p / (p.shape[0] * p.shape[1])


def _packed(rows: Rows) -> tuple[np.ndarray, np.ndarray]:
    """Columns that occur, and the rows' values in them."""
    used, at = np.unique(np.concatenate([i for i, _ in rows]), return_inverse=True) if rows else (np.zeros(0, int), np.zeros(0, int))
    x = np.zeros((len(rows), len(used)))
    np.add.at(x, (np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows]), at), np.concatenate([v for _, v in rows]) if rows else np.zeros(0))
    return used, x


def _sparse_back(layer: EnsembleLayer, used: np.ndarray, x: np.ndarray, slope: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of a layer over sparse rows; of ``weight`` and ``r`` only the used columns."""
    w = layer.weight[:, used]
    dw, dr, ds = np.zeros_like(w), np.zeros((len(layer.r), len(used))), np.zeros_like(layer.s)
    for m in range(len(layer.r)):
        scaled = x * layer.r[m, used]
        ds[m] = (slope[:, m] * (scaled @ w.T)).sum(axis=0)
        inner = slope[:, m] * layer.s[m]
        dw += inner.T @ scaled
        dr[m] = ((inner @ w) * x).sum(axis=0)
    return {"weight": dw, "r": dr, "s": ds, "b": slope.sum(axis=0)}


def _dense_back(layer: EnsembleLayer, x: np.ndarray, slope: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of a layer over rows x members x inputs, and of its inputs."""
    scaled = x * layer.r
    inner = slope * layer.s
    back = inner @ layer.weight
    grads = {"weight": np.einsum("nmo,nmi->oi", inner, scaled), "r": (back * x).sum(axis=0), "s": (slope * (scaled @ layer.weight.T)).sum(axis=0), "b": slope.sum(axis=0)}
    return grads, back * layer.r


def base_gradients(base: Base, rows: Rows, labels: np.ndarray) -> tuple[float, dict[str, tuple[np.ndarray | None, np.ndarray]]]:
    """Loss, and of each array (named layer.array) its gradient with the columns that it is of (None: all)."""
    used, x = _packed(rows)
    facts = [(i[i >= base.direct_from] - base.direct_from, v[i >= base.direct_from]) for i, v in rows]
    fact_used, f = _packed(facts)
    h1 = base.first.sparse(rows)
    a1 = np.maximum(h1, 0)
    h2 = base.second.dense(a1)
    a2 = np.maximum(h2, 0)
    loss, slope = loss_and_slope(base.head.dense(a2) + base.direct.sparse(facts), labels)
    out = {f"direct.{k}": (fact_used if k in ("weight", "r") else None, v) for k, v in _sparse_back(base.direct, fact_used, f, slope).items()}
    head, back = _dense_back(base.head, a2, slope)
    second, back = _dense_back(base.second, a1, back * (h2 > 0))
    first = _sparse_back(base.first, used, x, back * (h1 > 0))
    for name, grads in (("head", head), ("second", second)):
        out |= {f"{name}.{k}": (None, v) for k, v in grads.items()}
    return loss, out | {f"first.{k}": (used if k in ("weight", "r") else None, v) for k, v in first.items()}


def _norm(x: np.ndarray, weight: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, Callable]:
    """A layer norm, and the way back: (gradients of weight and bias, gradient of x)."""
    centred = x - x.mean(axis=-1, keepdims=True)
    scale = 1 / np.sqrt((centred**2).mean(axis=-1, keepdims=True) + 1e-5)
    unit = centred * scale

    def back(slope: np.ndarray):
        axes = tuple(range(slope.ndim - 1))
        d = slope * weight
        return (slope * unit).sum(axis=axes), slope.sum(axis=axes), scale * (d - d.mean(axis=-1, keepdims=True) - unit * (d * unit).mean(axis=-1, keepdims=True))

    return unit * weight + bias, back


def residual_gradients(residual: Residual, bodies: list[bytes], slope_of: Callable[[np.ndarray], tuple[float, np.ndarray]]) -> tuple[float, dict[str, tuple[None, np.ndarray]]]:
    """Loss and gradients of the transformer's arrays; ``slope_of`` gives the loss of its logits (rows x classes) and their gradient."""
    w, g = residual.weights, {}
    tokens, real = tokens_of(bodies)
    n, size = tokens.shape
    x = w["embedding"][tokens] + positions(size)
    backs = []

    def linear(name: str, h: np.ndarray) -> np.ndarray:
        return h @ w[f"{name}.weight"].T + w[f"{name}.bias"]

    def linear_back(name: str, h: np.ndarray, slope: np.ndarray) -> np.ndarray:
        flat = slope.reshape(-1, slope.shape[-1])
        g[f"{name}.weight"], g[f"{name}.bias"] = flat.T @ h.reshape(-1, h.shape[-1]), flat.sum(axis=0)
        return slope @ w[f"{name}.weight"]

    heads = lambda a: a.reshape(n, size, HEADS, DIM // HEADS).transpose(0, 2, 1, 3)
    whole = lambda a: a.transpose(0, 2, 1, 3).reshape(n, size, DIM)
    for k in range(LAYERS):
        h, norm1 = _norm(x, w[f"{k}.norm1.weight"], w[f"{k}.norm1.bias"])
        q, key, v = (heads(a) for a in np.split(linear(f"{k}.qkv", h), 3, axis=-1))
        p = softmax(np.where(real[:, None, None, :], q @ key.transpose(0, 1, 3, 2) / np.sqrt(DIM // HEADS), -1e30))
        mixed = whole(p @ v)
        x = x + linear(f"{k}.out", mixed)
        h2, norm2 = _norm(x, w[f"{k}.norm2.weight"], w[f"{k}.norm2.bias"])
        up = linear(f"{k}.up", h2)
        bell = 0.5 * (1 + erf(up / np.sqrt(2)))
        x = x + linear(f"{k}.down", up * bell)
        backs.append((h, norm1, q, key, v, p, mixed, h2, norm2, up, bell))
    last, norm = _norm(x, w["norm.weight"], w["norm.bias"])
    share = real[:, :, None] / real.sum(axis=1)[:, None, None]
    pooled = (last * share).sum(axis=1)
    loss, slope = slope_of(linear("head", pooled))
    slope = linear_back("head", pooled, slope)[:, None, :] * share
    g["norm.weight"], g["norm.bias"], slope = norm(slope)
    for k in reversed(range(LAYERS)):
        h, norm1, q, key, v, p, mixed, h2, norm2, up, bell = backs[k]
        inner = linear_back(f"{k}.down", up * bell, slope)
        inner = linear_back(f"{k}.up", h2, inner * (bell + up * np.exp(-(up**2) / 2) / np.sqrt(2 * np.pi)))
        g[f"{k}.norm2.weight"], g[f"{k}.norm2.bias"], inner = norm2(inner)
        slope = slope + inner
        inner = heads(linear_back(f"{k}.out", mixed, slope))
        dp = inner @ v.transpose(0, 1, 3, 2)
        ds = p * (dp - (dp * p).sum(axis=-1, keepdims=True)) / np.sqrt(DIM // HEADS)
        parts = np.concatenate([whole(ds @ key), whole(ds.transpose(0, 1, 3, 2) @ q), whole(p.transpose(0, 1, 3, 2) @ inner)], axis=-1)
        g[f"{k}.norm1.weight"], g[f"{k}.norm1.bias"], inner = norm1(linear_back(f"{k}.qkv", h, parts))
        slope = slope + inner
    g["embedding"] = np.zeros_like(w["embedding"])
    np.add.at(g["embedding"], tokens, slope * real[:, :, None])
    return loss, {k: (None, v) for k, v in g.items()}


class Steps:
    """Adaptive steps with decoupled decay; columns without a gradient take part with one of zero."""

    def __init__(self, arrays: dict[str, np.ndarray], decay: float):
        self.arrays, self.decay, self.t = arrays, decay, 0
        self.moments = {k: (np.zeros_like(a), np.zeros_like(a)) for k, a in arrays.items()}

    def step(self, grads: dict[str, tuple[np.ndarray | None, np.ndarray]], rate: float) -> None:
        self.t += 1
        unbias = (1 - 0.9**self.t, 1 - 0.999**self.t)
        for name, (columns, g) in grads.items():
            a, (m, v) = self.arrays[name], self.moments[name]
            m *= 0.9
            v *= 0.999
            at = slice(None) if columns is None else (slice(None), columns)
            m[at] += 0.1 * g
            v[at] += 0.001 * g * g
            a *= 1 - rate * self.decay
            a -= rate * (m / unbias[0]) / (np.sqrt(v / unbias[1]) + 1e-8)


def fit_sequence(rows: Rows, bodies: list[bytes], labels: np.ndarray, width: int, direct_from: int, config: SequenceConfig = SequenceConfig(), history: list[dict] | None = None) -> SequenceModel:
    """Fit the base, then the residual on top of it; ``history`` gets the mean loss of each epoch."""
    base = initial_base(width, direct_from, config)
    layers = {f"{n}.{k}": getattr(getattr(base, n), k) for n in ("first", "second", "head", "direct") for k in ("weight", "r", "s", "b")}
    residual = Residual.initial(config.seed + 1, len(LABELS))
    random = np.random.default_rng(config.seed + 2)

    def stage(name: str, arrays: dict[str, np.ndarray], epochs: int, rate: float, gradients) -> None:
        steps, batches = Steps(arrays, config.decay), -(-len(rows) // config.batch)
        rising = max(1, int(np.ceil(config.warm_up * epochs * batches))) if name == "residual" else 1
        for epoch in range(epochs):
            total, order = 0.0, random.permutation(len(rows))
            for k in range(0, len(rows), config.batch):
                ids = order[k : k + config.batch]
                loss, grads = gradients(ids)
                if not np.isfinite(loss):
                    raise FloatingPointError(f"{name}: the loss isn't finite")
                total += loss * len(ids)
                steps.step(grads, rate * min(1.0, (steps.t + 1) / rising))
            if history is not None:
                history.append({"stage": name, "epoch": epoch + 1, "steps": steps.t, "loss": total / len(rows)})

    stage("base", layers, config.base_epochs, config.base_rate, lambda ids: base_gradients(base, [rows[i] for i in ids], labels[ids]))

    def corrected(ids: np.ndarray):
        fixed = base.logits([rows[i] for i in ids])

        def slope_of(logits: np.ndarray):
            loss, slope = loss_and_slope(fixed + logits[:, None, :], labels[ids])
            return loss, slope.sum(axis=1)

        return residual_gradients(residual, [bodies[i] for i in ids], slope_of)

    stage("residual", residual.weights, config.residual_epochs, config.residual_rate, corrected)
    return SequenceModel(base, residual)
