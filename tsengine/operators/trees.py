"""Boosted regression trees that learn where missing values go, and attributions of trees' predictions to features, row by row.

Learning is by histograms: features are cut into bins once; for each level of a tree every task adds up its rows' residuals
by node, feature and bin with numpy, and ``treeAggregate`` merges these small tables on the executors. For each split both ways
for missing values are weighed, so rows without a value follow those that they resemble; a split may also tell
missing from present ones. The rows, with the sum of the trees so far beside them, stay in Spark.

Attributions are path-dependent Shapley values. For a leaf, what matters of a row is which of the path's features let it
through; a leaf's share for a feature is a sum over subsets of the others, which is read off the coefficients of a
product of linear polynomials. That takes a power of the path's length, not all subsets, and is done once for each pattern among the rows of a
batch. An ensemble is small (trees times leaves) and is broadcast with the function that uses it.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsengine.session import cut

#: Bins of a feature at most: with one for missing values they fit a byte.
BINS = 64
#: Trees after which the rows' lineage is cut.
CUT_EVERY = 8


@dataclass
class Tree:
    """Nodes as parallel lists, the root first. A leaf has feature -1; rows with at most the threshold go left; cover is the number of rows learned from."""

    feature: list[int] = field(default_factory=lambda: [-1])
    threshold: list[float] = field(default_factory=lambda: [math.inf])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    value: list[float] = field(default_factory=lambda: [0.0])
    cover: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, threshold: float, missing_left: bool) -> tuple[int, int]:
        self.feature[node], self.threshold[node], self.missing_left[node] = feature, threshold, missing_left
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for _ in range(2):
            for name, nothing in (("feature", -1), ("threshold", math.inf), ("left", -1), ("right", -1), ("missing_left", False), ("value", 0.0), ("cover", 0.0)):
                getattr(self, name).append(nothing)
        return self.left[node], self.right[node]

    def goes_left(self, node: int, values: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(values), self.missing_left[node], values <= self.threshold[node])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at = np.zeros(len(x), np.int64)
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if self.feature[node] < 0 or not len(rows):
                at[rows] = node
                continue
            left = self.goes_left(node, x[rows, self.feature[node]])
            stack += [(self.left[node], rows[left]), (self.right[node], rows[~left])]
        return at

    def paths(self) -> Iterator[tuple[int, dict[int, tuple[float, list[tuple[int, bool]]]]]]:
        """(leaf, {feature: (share of rows that its splits let through, [(node, whether left)])})."""
        stack: list[tuple[int, dict]] = [(0, {})]
        while stack:
            node, path = stack.pop()
            if self.feature[node] < 0:
                yield node, path
                continue
            for child, left in ((self.left[node], True), (self.right[node], False)):
                share, steps = path.get(self.feature[node], (1.0, []))
                part = self.cover[child] / self.cover[node] if self.cover[node] else 0.0
                stack.append((child, path | {self.feature[node]: (share * part, [*steps, (node, left)])}))


def shares(let_through: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Shapley values of a game worth one if all players let a row through, for each pattern (row) and player (column).

    A player outside of a coalition lets through its share. The coefficient of t**k in the product of (share + let_through * t) over
    the other players is the worth of their coalitions of k.
    """
    n = len(share)
    weights = [math.factorial(k) * math.factorial(n - 1 - k) / math.factorial(n) for k in range(n)]
    out = np.zeros(let_through.shape)
    for i in range(n):
        product = np.zeros((len(let_through), n))
        product[:, 0] = 1
        for j in range(n):
            if j != i:
                product[:, 1:] = product[:, 1:] * share[j] + product[:, :-1] * let_through[:, j : j + 1]
                product[:, 0] *= share[j]
        out[:, i] = (product @ weights) * (let_through[:, i] - share[i])
    return out


@dataclass
class Ensemble:
    """A prediction is the base and the sum of the trees' leaves."""

    features: list[str]
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    #: Rows with missing features are predicted, too.
    takes_missing = True

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += np.array(tree.value)[tree.leaves(x)]
        return out

    def expected(self) -> float:
        """The mean prediction by the trees' covers: what attributions start from."""
        return self.base + sum(tree.value[leaf] * math.prod(s for s, _ in path.values()) for tree in self.trees for leaf, path in tree.paths())

    def attributions(self, x: np.ndarray) -> np.ndarray:
        """A value by row and feature; a row's add up to its prediction less the expected one."""
        out = np.zeros((len(x), len(self.features)))
        for tree in self.trees:
            ways = {node: tree.goes_left(node, x[:, f]) for node, f in enumerate(tree.feature) if f >= 0}
            for leaf, path in tree.paths():
                if not path:
                    continue
                through = np.column_stack([np.logical_and.reduce([ways[node] == left for node, left in steps]) for _, steps in path.values()])
                patterns, which = np.unique(through, axis=0, return_inverse=True)
                found = shares(patterns.astype(float), np.array([s for s, _ in path.values()]))
                out[:, list(path)] += tree.value[leaf] * found[which.ravel()]
        return out

    def _over(self, columns: list, kind: str, run: Callable) -> Column:
        return F.pandas_udf(lambda *c: run(np.column_stack([v.astype("float64") for v in c])), kind)(*(F.col(c).cast("double") if isinstance(c, str) else c.cast("double") for c in columns))

    def column(self, columns: list | None = None) -> Column:
        """The prediction, from columns in the order of the features; null and NaN are missing."""
        return self._over(columns or self.features, "double", lambda x: pd.Series(self.predict(x)))

    def attribution(self, columns: list | None = None) -> Column:
        """The attributions as an array in the order of the features."""
        return self._over(columns or self.features, "array<double>", lambda x: pd.Series(list(self.attributions(x))))

    def to_dict(self) -> dict:
        return {"features": self.features, "base": self.base, "trees": [vars(t) for t in self.trees]}

    @classmethod
    def from_dict(cls, held: dict) -> Ensemble:
        return cls(held["features"], held["base"], [Tree(**t) for t in held["trees"]])


def of_spark(model, features: list[str]) -> Ensemble:
    """The trees of a fitted Spark model (boosted, or a forest or tree for regression) whose features are all continuous; there, NaN goes right."""
    trees, weights = (model.trees, model.treeWeights) if hasattr(model, "trees") else ([model], [1.0])
    if "Forest" in type(model).__name__:
        weights = [w / sum(weights) for w in weights]
    out = Ensemble(list(features))
    for held, weight in zip(trees, weights, strict=True):
        tree, stack = Tree(), [(0, held._call_java("rootNode"))]
        while stack:
            at, node = stack.pop()
            tree.value[at], tree.cover[at] = float(node.prediction()) * weight, float(node.impurityStats().count())
            if node.getClass().getSimpleName() == "InternalNode":
                found = node.split()
                if found.getClass().getSimpleName() != "ContinuousSplit":
                    raise ValueError("only splits of continuous features can be explained")
                left, right = tree.split(at, int(found.featureIndex()), float(found.threshold()), False)
                stack += [(left, node.leftChild()), (right, node.rightChild())]
        out.trees.append(tree)
    return out


# ---- learning --------------------------------------------------------------------------------------------------------
def best_split(counts: np.ndarray, sums: np.ndarray, l2: float, least: float) -> tuple[float, int, int, bool] | None:
    """(gain, feature, bin, missing left) of a node from its tables by feature and bin, the last bin being that of missing values.

    Rows with at most that bin go left. Of equal gains the first feature, then the lowest bin wins; missing values go
    where there is more gain, and with the larger side where both are alike.
    """
    n, s = counts[0].sum(), sums[0].sum()
    worth = lambda a, b: a * a / (b + l2)
    best = None
    for f in range(len(counts)):
        low_n, low_s = counts[f, :-1].cumsum(), sums[f, :-1].cumsum()
        lost_n, lost_s = counts[f, -1], sums[f, -1]
        gains = []
        for add_n, add_s in ((0.0, 0.0), (lost_n, lost_s)):
            left_n, left_s = low_n + add_n, low_s + add_s
            right_n, right_s = n - left_n, s - left_s
            with np.errstate(invalid="ignore", divide="ignore"):
                gain = worth(left_s, left_n) + worth(right_s, right_n) - worth(s, n)
            gains.append(np.where((left_n >= least) & (right_n >= least), gain, -np.inf))
        without, within = gains
        top = np.maximum(without, within)
        at = int(top.argmax())
        missing_left = bool(within[at] > without[at]) if lost_n else bool(low_n[at] * 2 >= n)
        if top[at] > 1e-12 * max(1.0, worth(s, n)) and (best is None or top[at] > best[0] * (1 + 1e-12)):
            best = (float(top[at]), f, at, missing_left)
    return best


def fit(df: DataFrame, features: list[str], label: str, trees: int = 50, depth: int = 4, rate: float = 0.1, l2: float = 1.0, least: float = 1.0, bins: int = BINS) -> Ensemble:
    """Squared error. Rows without a label are not learned from; null and NaN features are missing values.

    ``least`` is the number of rows on either side of a split. Without rows the prediction is zero.
    """
    if not 2 <= bins <= 250:
        raise ValueError("bins must be between 2 and 250")
    rows = df.filter(F.col(label).isNotNull() & ~F.isnan(F.col(label).cast("double"))).select(*(F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")).alias(f"f{i}") for i, f in enumerate(features)), F.col(label).cast("double").alias("y"))
    edges = [np.unique(q) for q in rows.approxQuantile([f"f{i}" for i in range(len(features))], [i / bins for i in range(1, bins + 1)], 1 / (8 * bins))]
    out, width = Ensemble(list(features)), bins + 2

    def binned(batches):
        for b in batches:
            x = np.full((b.num_rows, len(features)), bins + 1, np.uint8)
            for i, e in enumerate(edges):
                v = b.column(i).to_numpy(zero_copy_only=False)
                there = ~np.isnan(v)
                x[there, i] = np.searchsorted(e, v[there], "left")
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), b.column("y"), pa.array(np.zeros(b.num_rows))], ["x", "y", "so_far"])

    def matrix(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, len(features))

    def add(a, b):
        return b if a is None else a if b is None else a + b

    def merged(frame: DataFrame, table: Callable) -> np.ndarray | None:
        one = lambda batches: iter([pa.RecordBatch.from_arrays([pa.array([pickle.dumps(table(batches))], pa.binary())], ["part"])])
        return frame.mapInArrow(one, "part binary").rdd.map(lambda r: pickle.loads(r.part)).treeAggregate(None, add, add, 2)

    held = rows.mapInArrow(binned, "x binary, y double, so_far double").persist()
    n, mean = held.agg(F.count("*"), F.avg("y")).first()
    out.base = float(mean or 0.0)
    for number in range(trees if n else 0):
        # A tree over bins while it grows; its thresholds are the bins' edges afterwards.
        tree, open_nodes = Tree(), [0]

        def way(x, tree=tree):
            return tree.leaves(np.where(x == bins + 1, np.nan, x.astype(float)))

        for level in range(depth + 1):
            place = {node: i for i, node in enumerate(open_nodes)}

            def table(batches, way=way, place=place):
                found = np.zeros((2, len(place), len(features), width))
                for b in batches:
                    x, y, so_far = matrix(b.column("x")), b.column("y").to_numpy(), b.column("so_far").to_numpy()
                    at = np.array([place.get(i, -1) for i in range(max(place) + 1)])[np.minimum(way(x), max(place))]
                    some = at >= 0
                    residual = (y - so_far - out.base)[some]
                    for f in range(len(features)):
                        code = at[some] * width + x[some, f]
                        for k, w in ((0, None), (1, residual)):
                            found[k, :, f] += np.bincount(code, w, len(place) * width).reshape(len(place), width)
                return found

            counts, sums = merged(held, table)
            deeper = []
            for node, i in place.items():
                total = counts[i, 0].sum()
                tree.cover[node], tree.value[node] = float(total), float(rate * sums[i, 0].sum() / (total + l2)) if total + l2 else 0.0
                found = best_split(counts[i], sums[i], l2, least) if level < depth else None
                if found:
                    deeper += tree.split(node, found[1], float(found[2]), found[3])
            open_nodes = deeper
            if not open_nodes:
                break
        grown = [v if f < 0 else 0.0 for v, f in zip(tree.value, tree.feature, strict=True)]

        def step(batches, way=way, grown=grown):
            for b in batches:
                more = np.array(grown)[way(matrix(b.column("x")))]
                yield pa.RecordBatch.from_arrays([b.column("x"), b.column("y"), pa.array(b.column("so_far").to_numpy() + more)], ["x", "y", "so_far"])

        before = held
        held = before.mapInArrow(step, "x binary, y double, so_far double")
        held = (cut(held) if number % CUT_EVERY == CUT_EVERY - 1 else held).persist()
        held.count()
        before.unpersist()
        tree.value = grown
        tree.threshold = [t if f < 0 else float(edges[f][int(t)]) if t < len(edges[f]) else math.inf for t, f in zip(tree.threshold, tree.feature, strict=True)]
        out.trees.append(tree)
        if len(tree.feature) == 1:
            break
    held.unpersist()
    return out
