"""Whitening of embeddings by a two-pass covariance.

An entry c becomes the integer x = floor(SCALE * c) + SHIFT. The first pass adds up the integers exactly, which gives the
mean without rounding; the second adds up outer products of the centred vectors by matrix products (``numpy`` GEMM), a
block of rows at a time. Both sums are merged by ``treeAggregate``, so the driver gets a few partial results, each of the
size of the result. LAPACK's symmetric eigenvalue solver runs on the driver, and the projection, which is as large as
the covariance at most, is broadcast. A third pass measures on the rows how far the whitened covariance is from the
identity. All passes are scans of one column without a shuffle of rows, so no key can be hot.

Defined results: rows whose vector is null or has a null, NaN or infinite entry are left out; null and repeated keys are
kept, and equal vectors get equal results. A vector that is shorter than the longest counts as having zeros at its end
(an empty one too). Entries whose x would be beyond 2**62 count as that. A deviation that no long can hold is null.
A component with less than ``width * eps / 1e-4`` of the largest eigenvalue can't be told from one without variance to
four digits: its whitened values are null, and the identity error leaves it out. Without variance at all (a single
row, or equal rows) that holds for every component, and ``explained`` and ``identity_error`` are null, too. An empty table
or none but empty vectors give no rows. Vectors may have ``MOST_DIMENSIONS`` entries (a task holds a matrix of that
order); more raise ``ValueError``. Only the named columns are read.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsengine.llm.common import table

SCALE, SHIFT, MOST_DIMENSIONS = 64, 1_000_000, 4096
#: Rows that are multiplied at a time.
BLOCK = 2048
LARGEST = 2.0**62
COMPONENTS = 32


@dataclass
class Whitening:
    """What was fitted: the number of vectors, exact sums by dimension, eigenvalues and unit eigenvectors (columns), largest first."""

    n: int
    sums: list[int]
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    axes: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    trace: float = 0.0
    identity_error: float | None = None

    @property
    def width(self) -> int:
        return len(self.sums)

    @property
    def known(self) -> np.ndarray:
        """Which components have a variance that can be told from rounding."""
        return self.values > max(self.values.max(initial=0.0), 0.0) * self.width * np.finfo(float).eps * 1e4

    @property
    def projection(self) -> np.ndarray:
        """Axes over the roots of their eigenvalues; zero for components that are not known."""
        return self.axes * np.where(self.known, 1 / np.sqrt(np.where(self.known, self.values, 1.0)), 0.0)

    def explained(self) -> list[float | None]:
        return [float(v) / self.trace if self.trace > 0 else None for v in self.values]


def integers(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a list column are kept, and their integers; short rows are filled as zeros up to width or the longest."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null entries become NaN
    ends = sizes.cumsum()
    bad = np.r_[0, (~np.isfinite(flat)).cumsum()]
    kept = (bad[ends] == bad[ends - sizes]) & column.is_valid().to_numpy(zero_copy_only=False)
    width = int(sizes[kept].max(initial=0)) if width is None else width
    if kept.all() and (sizes == width).all():
        entries = flat.reshape(len(sizes), width)
    else:
        entries = np.zeros((int(kept.sum()), width))
        for i, r in enumerate(np.flatnonzero(kept).tolist()):
            entries[i, : sizes[r]] = flat[ends[r] - sizes[r] : ends[r]]
    with np.errstate(over="ignore"):
        return kept, np.clip(np.floor(entries * SCALE), -LARGEST, LARGEST).astype(np.int64) + SHIFT


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, as int64 where all fit, else as Python's integers."""
    if n * int(np.abs(x).max(initial=0)) < 2**62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def squares(d: np.ndarray) -> list[int | None]:
    """Exact sums of squares by row; null where a long is too small."""
    about = (d.astype(np.float64) ** 2).sum(axis=1)
    out = (d * d).sum(axis=1).tolist() if d.dtype != object else [0] * len(d)  # wraps around, so right where the sum fits
    for i in np.flatnonzero(about > (2.0**62 if d.dtype != object else -1)).tolist():
        exact = sum(int(v) ** 2 for v in d[i])
        out[i] = exact if exact < 2**63 else None
    return out


def add_sums(a: tuple[int, list[int]], b: tuple[int, list[int]]) -> tuple[int, list[int]]:
    """(rows, sums) of both; a shorter list counts as filled with the integer of zero for each of its rows."""
    width = max(len(a[1]), len(b[1]))
    left, right = (p[1] + [p[0] * SHIFT] * (width - len(p[1])) for p in (a, b))
    return a[0] + b[0], [x + y for x, y in zip(left, right, strict=True)]


def column_sums(x: np.ndarray) -> list[int]:
    """Exact: halves of 32 bits can't overflow."""
    high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
    return [(h << 32) + l for h, l in zip(high, low, strict=True)]


def tree_sum(df: DataFrame, run, zero, add):
    """run turns batches into one object a task; these are merged by treeAggregate."""

    def one(batches):
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(run(batches))], pa.binary())], ["part"])

    return df.mapInArrow(one, "part binary").rdd.map(lambda r: pickle.loads(r.part)).treeAggregate(zero, add, add, 2)


def plain(df: DataFrame, vector: str, *others: str) -> DataFrame:
    """The vector as floats or doubles, which integers of less than 2**53 and decimals fit, and other columns before it."""
    kind = df.schema[vector].dataType.simpleString()
    found = F.col(f"`{vector}`")
    return df.select(*(F.col(f"`{c}`") for c in others), (found if kind in ("array<float>", "array<double>") else found.cast("array<double>")).alias("vector"))


def fit(df: DataFrame, vector: str, components: int = COMPONENTS) -> Whitening:
    """Mean and covariance over all rows that are kept, and the leading components."""
    rows, spark = plain(df, vector), df.sparkSession

    def first(batches):
        found = (0, [])
        for batch in batches:
            _, x = integers(batch.column(0))
            if x.shape[1] > MOST_DIMENSIONS:
                raise ValueError(f"a vector has {x.shape[1]} entries, more than {MOST_DIMENSIONS}")
            found = add_sums(found, (len(x), column_sums(x)))
        return found

    n, sums = tree_sum(rows, first, (0, []), add_sums)
    fitted = Whitening(n, sums)
    if not n or not sums:
        return fitted
    width, k = len(sums), min(components, len(sums))

    def add_arrays(a, b):
        return b if a is None else a if b is None else tuple(x + y for x, y in zip(a, b, strict=True))

    def centred(batches):
        for batch in batches:
            _, x = integers(batch.column(0), width)
            for i in range(0, len(x), BLOCK):
                yield deviations(x[i : i + BLOCK], n, sums).astype(np.float64) / n

    def second(batches):
        out = np.zeros((width, width))
        for c in centred(batches):
            out += c.T @ c
        return (out,)

    covariance = tree_sum(rows, second, None, add_arrays)[0] / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    fitted.values, fitted.axes = values[::-1][:k].copy(), axes[:, ::-1][:, :k].copy()
    fitted.axes *= np.where(np.take_along_axis(fitted.axes, np.abs(fitted.axes).argmax(axis=0)[None], 0) < 0, -1.0, 1.0)
    fitted.trace = float(np.trace(covariance))
    known = fitted.known
    if known.any():
        sent = spark.sparkContext.broadcast(fitted.projection[:, known])

        def third(batches):
            total, out = np.zeros(known.sum()), np.zeros((known.sum(),) * 2)
            for c in centred(batches):
                w = c @ sent.value
                total += w.sum(axis=0)
                out += w.T @ w
            return total, out

        total, out = tree_sum(rows, third, None, add_arrays)
        fitted.identity_error = float(np.abs(out / n - np.outer(total / n, total / n) - np.eye(len(total))).max())
    return fitted


def whiten(df: DataFrame, key: str, vector: str, fitted: Whitening) -> DataFrame:
    """(key, deviation, whitened): a row for each vector that is kept; whitened has a value for each component."""
    sent = df.sparkSession.sparkContext.broadcast((fitted.n, fitted.sums, fitted.projection, fitted.known))

    def run(batches):
        n, sums, projection, known = sent.value
        for batch in batches:
            kept, x = integers(batch.column(1), len(sums))
            keys = batch.column(0).filter(pa.array(kept))
            for i in range(0, len(x), BLOCK):
                d = deviations(x[i : i + BLOCK], n, sums)
                w = (d.astype(np.float64) / n) @ projection
                values = pa.array(w.ravel(), mask=np.broadcast_to(~known, w.shape).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1) * len(known), pa.int32()), values)
                yield pa.RecordBatch.from_arrays([keys.slice(i, len(d)), pa.array(squares(d), pa.int64()), lists], [key, "deviation", "whitened"])

    found = plain(df, vector, key)
    if not fitted.width:
        return found.select(key, F.lit(None).cast("long").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened")).limit(0)
    return found.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, deviation long, whitened array<double>")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    fitted = fit(rows, "embedding")
    shares = F.array(*(F.lit(x).cast("double") for x in fitted.explained())).cast("array<double>")
    return whiten(rows, "vec_id", "embedding", fitted).select(
        "vec_id", F.lit(fitted.n).cast("long").alias("n"), "deviation", F.posexplode("whitened").alias("at", "whitened")
    ).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.get(shares, "at").alias("explained"), F.lit(fitted.identity_error).cast("double").alias("identity_error")
    )
