"""The learned transform of query vectors: a small dense matrix kept on the driver."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Association:
    """y = gain * rowscale * (M x' + b) with x' the normalised input; identity until warmed up."""

    size: int
    rate: float = 0.01
    warm_up: int = 40
    least_gain: float = 0.0
    feedback: int = 0
    m: np.ndarray = field(init=False)
    bias: np.ndarray = field(init=False)
    mean: np.ndarray = field(init=False)
    var: np.ndarray = field(init=False)
    moment: np.ndarray = field(init=False)
    spread: np.ndarray = field(init=False)
    row_scale: np.ndarray = field(init=False)
    gain: float = 1.0
    history: list = field(default_factory=list)

    def __post_init__(self):
        self.m, self.bias = np.eye(self.size), np.zeros(self.size)
        self.mean, self.var = np.zeros(self.size), np.ones(self.size)
        self.row_scale = np.ones(self.size)
        self.moment, self.spread = np.zeros((self.size, self.size)), np.zeros((self.size, self.size))

    def transform(self, q: np.ndarray) -> np.ndarray:
        q = np.asarray(q, dtype=float)
        if self.feedback < self.warm_up or q.shape != (self.size,):
            return q
        return self.gain * self.row_scale * (self.m @ ((q - self.mean) / np.sqrt(self.var + 1e-8)) + self.bias)

    def observe(self, q: np.ndarray) -> None:
        """Running mean and variance with weight 0.9; the variance uses the updated mean."""
        self.mean = 0.9 * self.mean + 0.1 * q
        self.var = 0.9 * self.var + 0.1 * (q - self.mean) ** 2

    def marginal_gain(self, q: np.ndarray, reward: float, near: int = 5) -> float:
        """Reward over what the most similar past queries already brought."""
        if not self.history:
            return reward
        similar = sorted(((float(q @ p / (np.linalg.norm(q) * np.linalg.norm(p) or 1)), r) for p, r in self.history), reverse=True)[:near]
        return reward - sum(s * r for s, r in similar) / len(similar)

    def learn(self, q: np.ndarray, target: np.ndarray, reward: float) -> bool:
        """One Hebbian step with Adam, entries within 10 of zero; refused below the least gain."""
        q, target = np.asarray(q, float), np.asarray(target, float)
        refused = self.marginal_gain(q, reward) < self.least_gain
        self.feedback += 1
        self.history = [*self.history, (q, reward)][-200:]
        if refused:
            return False
        self.observe(q)
        step = reward * np.outer(target, q)
        self.moment = 0.9 * self.moment + 0.1 * step
        self.spread = 0.999 * self.spread + 0.001 * step**2
        k = self.feedback
        self.m = np.clip(self.m + self.rate * (self.moment / (1 - 0.9**k)) / (np.sqrt(self.spread / (1 - 0.999**k)) + 1e-8), -10, 10)
        return True

    def dump(self) -> str:
        """The whole state as JSON; what is no number becomes 0."""
        arrays = {n: np.nan_to_num(getattr(self, n)).tolist() for n in _ARRAYS}
        plain = {n: getattr(self, n) for n in ("size", "rate", "warm_up", "least_gain", "feedback", "gain")}
        return json.dumps(plain | arrays | {"history": [[np.asarray(q).tolist(), r] for q, r in self.history]})

    @classmethod
    def load(cls, text: str) -> Association:
        """The state of :meth:`dump`; a matrix of zeros alone heals to the identity."""
        raw = json.loads(text)
        out = cls(raw["size"], raw["rate"], raw["warm_up"], raw["least_gain"], raw["feedback"])
        for n in _ARRAYS:
            setattr(out, n, np.array(raw[n], dtype=float))
        if not out.m.any():
            out.m = np.eye(out.size)
        out.gain, out.history = raw["gain"], [(np.array(q), r) for q, r in raw["history"]]
        return out


_ARRAYS = ("m", "bias", "mean", "var", "moment", "spread", "row_scale")


def transform_rows(rows: DataFrame, state: Association, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, i, y): every vector through the whole transform, in Arrow batches; the state is a few MB at most."""
    kind = dict(rows.dtypes)[id_col]

    def run(batches):
        for batch in batches:
            out = [(i, k, float(y)) for i, v in zip(batch[id_col], batch[vector_col], strict=True) for k, y in enumerate(state.transform(np.asarray(v, dtype=float)))]
            yield pd.DataFrame(out, columns=["id", "i", "y"])

    return rows.select(id_col, vector_col).mapInPandas(run, f"id {kind}, i int, y double")


def apply_rows(vector: Column, rows: list[list[float]]) -> Column:
    """Matrix times vector as an expression, for a matrix of fixed size."""
    from .scores import dot

    return F.array(*[dot(vector, F.array(*[F.lit(float(x)) for x in row])) for row in rows])


def block_means(entries: DataFrame, size: int, blocks: int) -> DataFrame:
    """(bi, bj, mean) of a matrix in long form (i, j, v), cut in ``blocks`` each way."""
    step = size // blocks
    return entries.groupBy(F.floor(F.col("i") / step).alias("bi"), F.floor(F.col("j") / step).alias("bj")).agg(F.avg("v").alias("mean"))


def row_energy(entries: DataFrame) -> DataFrame:
    """(i, energy): the root of the squares of each row of a matrix in long form."""
    return entries.groupBy("i").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("energy"))


def shape_of(entries: DataFrame) -> DataFrame:
    """One row: Frobenius norm, mean deviation of the diagonal from 1, share of energy on it."""
    on = F.col("i") == F.col("j")
    square = F.col("v") * F.col("v")
    return entries.agg(F.sqrt(F.sum(square)).alias("frobenius"), F.avg(F.when(on, F.abs(F.col("v") - 1))).alias("diagonal_off"), (F.sum(F.when(on, square).otherwise(0.0)) / F.sum(square)).alias("identity_ratio"))
