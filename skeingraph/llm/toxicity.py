"""Toxicity scores by logistic regression, trained with FTRL-proximal.

Features are hashed word n-grams: single words, pairs of neighbours and skip-grams
(pairs with one word between), present or not.  Every coordinate has its own learning
rate, and the L1 term keeps most weights at exactly zero, so what is broadcast is a
short list of (index, weight).

Null and empty texts have no features and get the score of the bias.  Rows are
independent; repeated rows repeat their score.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._arrays import LOWER, PUNCTUATION, RollingHash, mix, text_blocks, words

#: Bits of a feature's index; the last index is the bias.
BITS = 20
BIAS = (1 << BITS) - 1
_SHIFT = np.uint64(64 - BITS)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of every word, neighbour pair and skip pair of a block of texts."""
    data = LOWER[data]
    start, end, at = words(data, offsets, PUNCTUATION)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    own = mix(RollingHash(data).ranges(start, end))
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    rows, index = [row], [own]
    for gap, seed in ((1, 0xA5A5A5A5A5A5A5A5), (2, 0x3C3C3C3C3C3C3C3C)):
        near = row[:-gap] == row[gap:]
        rows.append(row[:-gap][near])
        index.append(mix(own[:-gap] * np.uint64(3) + own[gap:] ^ np.uint64(seed))[near])
    return np.concatenate(rows), (np.concatenate(index) >> _SHIFT).astype(np.int64) % BIAS


@dataclass(frozen=True)
class Weights:
    """Nonzero weights of the model, by index."""

    index: np.ndarray
    weight: np.ndarray

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, dtype=np.float64)
        out[self.index] = self.weight
        return out


class Ftrl:
    """Per-coordinate FTRL-proximal for logistic loss on binary features."""

    def __init__(self, alpha: float = 2.0, beta: float = 1.0, l1: float = 20.0, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros(1 << BITS)
        self.n = np.zeros(1 << BITS)

    def weights(self, index: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[index], self.n[index]
        rate = (self.beta + np.sqrt(n)) / self.alpha + self.l2
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / rate)

    def learn(self, index: np.ndarray, label: int, importance: float = 1.0) -> None:
        w = self.weights(index)
        gradient = importance * (_sigmoid(w.sum()) - label)
        n = self.n[index]
        self.z[index] += gradient - (np.sqrt(n + gradient**2) - np.sqrt(n)) / self.alpha * w
        self.n[index] = n + gradient**2


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _rows(texts: pa.Array) -> Iterator[np.ndarray]:
    """The distinct indices of each text, the bias last; views of one array for each block."""
    for first, end, data, offsets in text_blocks(texts):
        row, feature = features(data, offsets)
        own = np.arange(end - first)
        key = np.unique(np.concatenate([row << BITS | feature, own << BITS | BIAS]))
        yield from np.split((key & BIAS).astype(np.int32), np.searchsorted(key >> BITS, own[1:]))


def _train(index: list[np.ndarray], labels: np.ndarray, epochs: int) -> Weights:
    """Passes over the rows in a fixed shuffled order; a rarer toxic label counts for more."""
    model = Ftrl()
    toxic = max(1, int(labels.sum()))
    importance = (1.0, max(1.0, (len(labels) / toxic - 1) ** 0.5))
    order = np.random.default_rng(7).permutation(len(index))
    for _ in range(epochs):
        for i in order:
            model.learn(index[i], int(labels[i]), importance[int(labels[i])])
    w = model.weights(slice(None))
    kept = np.flatnonzero(w)
    return Weights(kept, w[kept])


def train(labelled: DataFrame, *, text_col: str = "text", label_col: str = "toxic", order_col: str = "doc_id", epochs: int = 5) -> Weights:
    """Weights from labelled rows, learned in one task on an executor.

    The caller bounds the rows (:func:`bounded_sample`): online learning is sequential.
    The task keeps four bytes for each feature of a row, and no text.  Rows with a null
    label are left out; without rows all scores are 0.5.  Order ties are broken by a hash
    of the text, so reruns agree.
    """
    text = F.coalesce(text_col, F.lit(""))
    rows = labelled.where(F.col(label_col).isNotNull()).select(F.col(order_col).alias("pos"), F.sha2(text, 256).alias("tie"), F.col(label_col).cast("int").alias("label"), text.alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, index = [], []
        for batch in batches:
            if batch.num_rows:
                held.append(batch.select(["pos", "tie", "label"]))
                index += _rows(batch.column(3))
        if held:
            table = pa.Table.from_batches(held).append_column("at", pa.array(range(len(index)), pa.int64()))
            table = table.sort_by([("pos", "ascending"), ("tie", "ascending")])
            got = _train([index[i] for i in table.column("at").to_pylist()], table.column("label").to_numpy(), epochs)
            yield pa.RecordBatch.from_arrays([pa.array(got.index, pa.int64()), pa.array(got.weight, pa.float64())], names=["i", "w"])

    # At most 2 ** BITS rows come back.
    got = rows.repartition(1).mapInArrow(run, "i long, w double").toPandas()
    return Weights(got["i"].to_numpy(dtype=np.int64), got["w"].to_numpy(dtype=np.float64))


def bounded_sample(labels: DataFrame, docs: DataFrame, *, id_col: str = "doc_id", label_col: str = "toxic", text_col: str = "text", max_rows: int = 12000) -> DataFrame:
    """Texts of at most ``max_rows`` labelled ids, those with the smallest hashed id.

    An id with several labels is toxic if any of them is; null ids and labels are left
    out.  The ids are broadcast: their number is bounded by ``max_rows``.
    """
    ids = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias(label_col))
    ids = ids.orderBy(F.xxhash64(id_col), id_col).limit(max_rows)
    return docs.select(id_col, text_col).join(F.broadcast(ids), id_col).select(id_col, text_col, label_col)


def score(docs: DataFrame, weights: Weights, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` in place of the text column; the whole text counts."""
    return _scored(docs, weights, text_col, threshold, keep_text=False)


def reject(docs: DataFrame, weights: Weights, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with their columns as they were."""
    return _scored(docs, weights, text_col, threshold, keep_text=True)


def _scored(docs: DataFrame, weights: Weights, text_col: str, threshold: float, keep_text: bool) -> DataFrame:
    out = [c for c in docs.columns if keep_text or c not in (text_col, "score", "predicted")]
    fields = [docs.schema[c] for c in out]
    if not keep_text:
        fields += [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    schema = T.StructType(fields)
    position = {c: i for i, c in enumerate(dict.fromkeys([*out, text_col]))}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = weights.dense()
        for batch in batches:
            total = np.full(batch.num_rows, dense[BIAS])
            for first, end, data, offsets in text_blocks(batch.column(position[text_col])):
                row, index = features(data, offsets)
                hit = dense[index] != 0
                key = np.unique(row[hit] << BITS | index[hit])
                total[first:end] += np.bincount(key >> BITS, weights=dense[key & BIAS], minlength=end - first)
            value = _sigmoid(total)
            if keep_text:
                yield batch.select(out).filter(pa.array(value < threshold))
            else:
                columns = [batch.column(position[c]) for c in out]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(value), pa.array((value >= threshold).astype(np.int32))], names=schema.names)

    return docs.select(*position).mapInArrow(run, schema)
