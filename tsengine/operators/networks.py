"""A small neural regressor whose gradients are summed over partitions.

Rows are dealt to shards by a hash of their values and cut, in order, into blocks, so a block holds the same rows however the
input is partitioned. Each round broadcasts the weights with the function, every task adds up its blocks' gradients by matrix
products, and the driver takes one step (Adam). Gradients, and the sums that standardise the features, are added as
whole numbers of 2**-40 of a unit: such sums don't depend on their order, so the model doesn't depend on partitions, to the last bit.
A round reads one of ``batches`` parts of the blocks. What reaches the driver is one vector of the number of weights.

Rows with a missing feature or label (null or NaN) are not learned from, and have no prediction. Without rows the prediction is zero; a
constant feature is left as zero, and with a constant label that is the prediction.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block, rows of a shard (so that their number grows with the rows), and the unit of exact sums.
BLOCK, SHARD, UNIT = 2048, 200_000, 2.0**40


def whole(x: np.ndarray) -> np.ndarray:
    """Whole numbers of the unit, as Python's integers, which don't overflow."""
    return np.array([int(v) for v in np.rint(np.ravel(x) * UNIT)], dtype=object)


@dataclass
class Network:
    """Standardised features, layers of tanh and a line at the end; the label is standardised, too."""

    features: list[str]
    shift: np.ndarray = field(default_factory=lambda: np.zeros(1))
    scale: np.ndarray = field(default_factory=lambda: np.ones(1))
    layers: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    takes_missing = False

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        out = [x]
        for i, (w, b) in enumerate(self.layers):
            z = out[-1] @ w + b
            out.append(z if i == len(self.layers) - 1 else np.tanh(z))
        return out

    def gradient(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of half the sum of squared errors, for weights and biases of each layer."""
        held = self.forward(x)
        back, out = held[-1] - y[:, None], []
        for i in range(len(self.layers) - 1, -1, -1):
            out = [held[i].T @ back, back.sum(axis=0), *out]
            if i:
                back = (back @ self.layers[i][0].T) * (1 - held[i] ** 2)
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.where(np.isnan(x).any(axis=1), np.nan, 0.0)
        z = (x - self.shift[:-1]) * self.scale[:-1]
        return self.forward(z)[-1][:, 0] / (self.scale[-1] or 1.0) * (self.scale[-1] > 0) + self.shift[-1]

    def column(self, columns: list | None = None) -> Column:
        run = lambda *c: pd.Series(self.predict(np.column_stack([v.astype("float64") for v in c])))
        found = F.pandas_udf(run, "double")(*(F.col(c).cast("double") if isinstance(c, str) else c.cast("double") for c in columns or self.features))
        return F.nanvl(found, F.lit(None).cast("double"))

    def to_dict(self) -> dict:
        return {"features": self.features, "shift": self.shift.tolist(), "scale": self.scale.tolist(), "layers": [[w.tolist(), b.tolist()] for w, b in self.layers]}

    @classmethod
    def from_dict(cls, held: dict) -> Network:
        return cls(held["features"], np.array(held["shift"]), np.array(held["scale"]), [(np.array(w).reshape(len(w), len(b)), np.array(b)) for w, b in held["layers"]])


def exact_sum(df: DataFrame, run: Callable):
    """What run gives for the batches of each task, vectors of whole numbers, added up on the executors; None without rows."""
    one = lambda batches: iter([pa.RecordBatch.from_arrays([pa.array([pickle.dumps(run(batches))], pa.binary())], ["part"])])
    add = lambda a, b: b if a is None else a if b is None else a + b
    return df.mapInArrow(one, "part binary").rdd.map(lambda r: pickle.loads(r.part)).treeAggregate(None, add, add, 2)


def blocks(df: DataFrame, columns: list[str], shards: int) -> DataFrame:
    """(number, rows): the rows as matrices of doubles, a block each, the same for any partitioning."""
    width = len(columns)
    rows = df.select(*(F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(*rows.columns), F.lit(shards))).filter(" AND ".join(f"v{i} IS NOT NULL AND NOT isnan(v{i})" for i in range(width)))

    def cut(batches):
        shard, number, held = None, 0, np.zeros((0, width))

        def out():
            return pa.RecordBatch.from_arrays([pa.array([shard * 1_000_000_007 + number], pa.int64()), pa.array([held.tobytes()], pa.binary())], ["number", "rows"])

        for b in batches:
            at = b.column("shard").to_numpy()
            x = np.column_stack([b.column(i).to_numpy() for i in range(width)])
            edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for start, stop in zip(edges[:-1], edges[1:], strict=True):
                if start == stop:
                    continue
                if at[start] != shard:
                    if len(held):
                        yield out()
                    shard, number, held = int(at[start]), 0, np.zeros((0, width))
                held = np.vstack([held, x[start:stop]])
                while len(held) >= BLOCK:
                    whole_block, held = held[:BLOCK], held[BLOCK:]
                    rest, held = held, whole_block
                    yield out()
                    number, held = number + 1, rest
        if len(held):
            yield out()

    dealt = rows.repartition("shard").sortWithinPartitions("shard", *(f"v{i}" for i in range(width)))
    return dealt.mapInArrow(cut, "number long, rows binary")


def fit(df: DataFrame, features: list[str], label: str, hidden: tuple[int, ...] = (16,), rounds: int = 150, batches: int = 1, rate: float = 0.03, decay: float = 1e-4, seed: int = 32) -> Network:
    """Least squares by Adam; decay pulls the weights of standardised features towards zero."""
    width = len(features) + 1
    shards = max(1, math.ceil(df.count() / SHARD))
    held = blocks(df, [*features, label], shards).persist()
    try:

        def moments(parts):
            total = np.zeros(1 + 2 * width, dtype=object)
            for b in parts:
                for raw in b.column("rows").to_pylist():
                    x = np.frombuffer(raw).reshape(-1, width)
                    total = total + np.r_[np.array([len(x)], dtype=object), whole(x.sum(axis=0)), whole((x * x).sum(axis=0))]
            return total

        found = exact_sum(held, moments)
        if found is None or not found[0]:
            return Network(list(features))
        n = int(found[0])
        mean = np.array([float(v) for v in found[1 : 1 + width]]) / UNIT / n

        def spread(parts):
            total = np.zeros(width, dtype=object)
            for b in parts:
                for raw in b.column("rows").to_pylist():
                    total = total + whole(((np.frombuffer(raw).reshape(-1, width) - mean) ** 2).sum(axis=0))
            return total

        deviation = np.sqrt(np.array([float(v) for v in exact_sum(held, spread)]) / UNIT / n)
        scale = np.where(deviation > 1e-9 * np.maximum(1.0, np.abs(mean)), 1 / np.where(deviation > 0, deviation, 1.0), 0.0)
        rng, sizes = np.random.default_rng(seed), [len(features), *hidden, 1]
        layers = [(rng.normal(0, 1 / math.sqrt(a), (a, b)), np.zeros(b)) for a, b in zip(sizes[:-1], sizes[1:], strict=True)]
        net = Network(list(features), mean, scale, layers)
        first, second = ([np.zeros_like(p) for layer in layers for p in layer] for _ in range(2))
        for number in range(rounds if scale[-1] else 0):

            def gradients(parts, number=number, net=net):
                total = None
                for b in parts:
                    for place, raw in zip(b.column("number").to_pylist(), b.column("rows").to_pylist(), strict=True):
                        if place % batches == number % batches:
                            x = (np.frombuffer(raw).reshape(-1, width) - net.shift) * net.scale
                            part = np.r_[np.array([len(x)], dtype=object), whole(np.concatenate([g.ravel() for g in net.gradient(x[:, :-1], x[:, -1])]))]
                            total = part if total is None else total + part
                return total

            found = exact_sum(held, gradients)
            if found is None:
                continue
            flat, at, step = np.array([float(v) for v in found[1:]]) / UNIT / int(found[0]), 0, number + 1
            fresh = []
            for i, p in enumerate(p for layer in net.layers for p in layer):
                g = flat[at : at + p.size].reshape(p.shape) + (decay * p if p.ndim == 2 else 0)
                at += p.size
                first[i], second[i] = 0.9 * first[i] + 0.1 * g, 0.999 * second[i] + 0.001 * g * g
                fresh.append(p - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8))
            net = Network(net.features, net.shift, net.scale, list(zip(fresh[::2], fresh[1::2], strict=True)))
        return net
    finally:
        held.unpersist()
