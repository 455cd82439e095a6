"""Toxicity scores from a factorization machine over hashed terms.

Terms of a text: its lower-cased words and their first 4, 5 and 6 bytes, hashed into ``2 ** SPACE_BITS`` features. All
terms of the fitted rows are features: none is chosen by its own association, so a term that is neutral alone counts
where a pair with it isn't. A text of n features gives each the value ``scale(n)``. The score is a logistic of bias +
linear weights + pairwise interactions <v_i, v_j> of all its features (for instance an insult with the mention of a
group), in time linear in the features: 1/2 sum_f [(sum_i v_if)^2 - sum_i v_if^2].

Fitting takes a bounded sample of ``max_labels`` labelled rows (those with the smallest hashes of their ids). Penalties
on weights (L1) and on factors (by group) shrink features that tell nothing; positive rows weigh ``BALANCE`` times what
balances the classes. Scoring covers every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tarn.llm.common import materialize, slices, small_batches, tidy
from tarn.llm.words import Words, mix
from tarn.sources.spread import spread

#: Labelled rows that are fitted on, at most.
MAX_LABELS = 30_000
#: Texts in one Arrow batch where the features of the fit are made.
TEXT_ROWS = 1000
#: Terms are hashed into a space of two to this power.
SPACE_BITS = 20
#: Weight of all positive rows, as a multiple of the weight of all others.
BALANCE = 1.5
_PREFIXES = (None, 4, 5, 6)


def term_hashes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms, and the word each is of."""
    out, at = [], []
    every = np.arange(len(words))
    for kind, size in enumerate(_PREFIXES):
        if size is None:
            h, own = words.hashes(), every
        else:
            own = np.flatnonzero(words.ends - words.starts > size)
            h = words.hashes(size=size)[own]
        out.append(mix(h + np.uint64(kind)))
        at.append(own)
    return np.concatenate(out), np.concatenate(at)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct pairs (text, feature), ordered, and the number of texts."""
    words = Words(texts, lower=True)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), words.docs
    h, at = term_hashes(words)
    pairs = np.unique((words.doc_of(at) << SPACE_BITS) | (h >> np.uint64(64 - SPACE_BITS)).astype(np.int64))
    return pairs >> SPACE_BITS, pairs & ((1 << SPACE_BITS) - 1), words.docs


def scale(n: np.ndarray) -> np.ndarray:
    """The value of each feature of texts with n features."""
    return 0.5 * np.maximum(n, 1).astype(np.float32) ** -0.35


@dataclass
class FactorizationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def scores(self, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """Probability of the positive label (classes weighted as in the fit) for texts 0 to n - 1 with the features (doc, term)."""
        x = scale(np.bincount(doc, minlength=n))
        z = self.bias + x * np.bincount(doc, self.linear[term], n)
        v = self.factors[term]
        for f in range(self.factors.shape[1]):
            z += 0.5 * x**2 * (np.bincount(doc, v[:, f], n) ** 2 - np.bincount(doc, v[:, f] ** 2, n))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    @classmethod
    def fit(cls, first: np.ndarray, term: np.ndarray, labels: np.ndarray, space: int = 1 << SPACE_BITS, factors: int = 8, epochs: int = 10, batch: int = 128, rate: float = 60.0, factor_rate: float = 10.0, l1: float = 7e-4, group: float = 3e-3, seed: int = 7) -> FactorizationMachine:
        """Proximal descent on the logistic loss with one adaptive step for all weights and one for all factors; row k has the features term[first[k]:first[k + 1]]."""
        random = np.random.default_rng(seed)
        rate_of_positive = float(np.clip((labels.sum() + 0.5) / (len(labels) + 1), 1e-6, 1 - 1e-6))
        own = cls(float(np.log(rate_of_positive / (1 - rate_of_positive))), np.zeros(space, np.float32), np.zeros((space, factors), np.float32))
        if not len(term) or not 0 < labels.sum() < len(labels):
            return own
        seen = np.zeros(space, dtype=bool)
        for k in range(0, len(term), 1 << 20):
            seen[term[k : k + (1 << 20)]] = True
        own.factors[seen] = 0.3 * random.standard_normal((int(seen.sum()), factors), dtype=np.float32)  # features of no fitted row stay 0
        x = scale(np.diff(first))
        weight = np.where(labels == 1, BALANCE * (len(labels) - labels.sum()) / labels.sum(), 1.0)
        gb, gw, gv = 1e-6, 1e-8, 1e-8
        for _ in range(epochs):
            order = random.permutation(len(labels))
            for k in range(0, len(order), batch):
                rows = order[k : k + batch]
                sizes = first[rows + 1] - first[rows]
                at = np.repeat(first[rows] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                d = np.repeat(np.arange(len(rows)), sizes)
                t, place = np.unique(term[at], return_inverse=True)
                w, v = own.linear[t], own.factors[t]
                xd = x[rows][d]
                xv = v[place] * xd[:, None]
                sums = np.stack([np.bincount(d, xv[:, f], len(rows)) for f in range(factors)], axis=1)
                z = own.bias + np.bincount(d, xd * w[place], len(rows)) + 0.5 * ((sums**2).sum(axis=1) - np.bincount(d, (xv**2).sum(axis=1), len(rows)))
                error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[rows]) * weight[rows] / len(rows)
                e = error[d] * xd
                dw = np.bincount(place, e, len(t))
                g = e[:, None] * (sums[d] - xv)
                dv = np.stack([np.bincount(place, g[:, f], len(t)) for f in range(factors)], axis=1)
                db = error.sum()
                gb, gw, gv = gb + db * db, gw + (dw**2).sum(), gv + (dv**2).sum()
                own.bias -= 0.1 * db / gb**0.5
                step = rate / gw**0.5
                w = w - step * dw
                own.linear[t] = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
                step = factor_rate / gv**0.5
                v = v - step * dv
                own.factors[t] = v * np.maximum(1 - step * group / np.maximum(np.sqrt((v**2).sum(axis=1, keepdims=True)), 1e-9), 0)
        own.bias = float(own.bias)
        return own


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never fitted on: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1, F.lit(False))


class ToxicityModel:
    """A fitted machine; ``score`` covers every row of a table."""

    def __init__(self, machine: FactorizationMachine):
        self.machine = machine

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> ToxicityModel:
        """Fit on labelled rows outside the held-out fold.

        Rows with a null label or id are left out; a doc_id labelled more than once counts as positive if any label is. Of a labelled
        doc_id each different text is a row; equal rows count once, and all together at most ``max_labels``.
        Without rows of both classes the score is the smoothed share of positives.
        """
        eligible = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("label")).where(~held_out())
        sample = eligible.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
        chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")  # max_labels rows of two numbers

        def featured(batches):
            for batch in batches:
                for part in slices(batch):
                    doc, term, docs_here = features(part.column("text"))
                    at = np.searchsorted(doc, np.arange(docs_here + 1))
                    term = term.astype("<i4")
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label").cast(pa.int32()), pa.array([term[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["doc_id", "label", "terms"])

        with small_batches(docs.sparkSession, TEXT_ROWS):
            found = materialize(chosen.select("doc_id", "label", "text").mapInArrow(tidy(featured), "doc_id long, label int, terms binary"), "features")
        rows = found.dropDuplicates(["doc_id", "terms"])  # rows of a labelled id may be many; equal ones teach nothing more
        order = F.xxhash64("doc_id", "terms")
        if rows.count() > max_labels:  # several texts of one id: of all those the ones with the smallest hashes
            last = rows.select(order.alias("h")).orderBy("h").limit(max_labels).agg(F.max("h")).first()[0]
            rows = rows.where(order <= last)
        labels, sizes, flat = [], [], bytearray()
        for r in rows.orderBy("doc_id", "terms").toLocalIterator():  # a partition at a time, so the driver holds each feature once
            labels.append(r["label"])
            sizes.append(len(r["terms"]) // 4)
            flat += r["terms"]
        first, term, labels = np.cumsum([0, *sizes]), np.frombuffer(flat, dtype="<i4"), np.array(labels, dtype=np.float64)
        return cls(FactorizationMachine.fit(first, term, labels))

    def score(self, docs: DataFrame, into: str = "score") -> DataFrame:
        """All columns of ``docs`` and the score (0 to 1) in ``into``, which replaces a column of that name. Null and empty texts have no features: the bias scores them."""
        own = docs.sparkSession.sparkContext.broadcast(self.machine)
        plain = spread(docs.drop(into))

        def run(batches):
            machine = own.value
            for batch in batches:
                for part in slices(batch):
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(machine.scores(*features(part.column("text"))))], names=[*part.schema.names, into])

        return plain.mapInArrow(tidy(run), StructType([*plain.schema.fields, StructField(into, DoubleType())]))
