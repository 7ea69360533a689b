"""Trees that learn where missing values go, and attributions, against brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from tsengine.operators import models, trees


def frame(spark, x, y, parts=3):
    rows = [(*(None if np.isnan(v) else float(v) for v in r), float(t)) for r, t in zip(x, y, strict=True)]
    names = ", ".join(f"x{i} double" for i in range(x.shape[1]))
    return spark.createDataFrame(rows, f"{names}, y double").repartition(parts)


def some_data(seed, n, kinds=6, missing=0.25):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, kinds, (n, 3)).astype(float)
    y = x[:, 0] * 2 + (x[:, 1] > 2) * 5 + rng.normal(0, 0.3, n)
    x[rng.random(x.shape) < missing] = np.nan
    return x, y + np.where(np.isnan(x[:, 1]), 4.0, 0.0)


def plain_split(x, y, rows, l2, least):
    """The best (gain, feature, threshold, missing left) over all values and both ways for missing ones."""
    s, n = y[rows].sum(), len(rows)
    best = (0.0, None)
    for f in range(x.shape[1]):
        v = x[rows, f]
        lost = np.isnan(v)
        for t in np.unique(v[~lost]):
            for way in (False, True):
                left = np.where(lost, way, v <= t)
                a, b = left.sum(), (~left).sum()
                if min(a, b) < least:
                    continue
                g = y[rows][left].sum() ** 2 / (a + l2) + y[rows][~left].sum() ** 2 / (b + l2) - s * s / (n + l2)
                if g > best[0] * (1 + 1e-12) + 1e-12:
                    best = (g, (f, t, way))
    return best


def plain_trees(x, y, count, depth, rate, l2, least):
    base = y.mean()
    out = np.full(len(y), base)

    def grow(rows, level, residual):
        gain, found = plain_split(x, residual, rows, l2, least) if level < depth else (0, None)
        if not found:
            out[rows] += rate * residual[rows].sum() / (len(rows) + l2)
            return
        f, t, way = found
        left = np.where(np.isnan(x[rows, f]), way, x[rows, f] <= t)
        grow(rows[left], level + 1, residual)
        grow(rows[~left], level + 1, residual)

    for _ in range(count):
        grow(np.arange(len(y)), 0, y - out)
    return out


@pytest.mark.parametrize("depth, l2, least", [(1, 0.0, 1), (3, 1.0, 1), (2, 0.5, 12)])
def test_splits_are_those_of_a_search_over_all(spark, depth, l2, least):
    x, y = some_data(depth, 160)
    found = trees.fit(frame(spark, x, y), ["x0", "x1", "x2"], "y", trees=3, depth=depth, rate=0.5, l2=l2, least=least)
    assert len(found.trees) == 3 and np.allclose(found.predict(x), plain_trees(x, y, 3, depth, 0.5, l2, least), atol=1e-9)


def test_missing_values_not_at_random_are_learned(spark):
    x, y = some_data(9, 600)
    df = frame(spark, x, y).withColumn("location", F.lit("a")).withColumn("date_time", F.lit("2024-01-01").cast("timestamp_ntz"))
    errors = {}
    for name, more in (("learned_trees", {"params": {"trees": 20, "depth": 3, "rate": 0.3}}), ("boosted_trees", {"params": {"maxIter": 20, "maxDepth": 3, "stepSize": 0.3}, "impute": 0.0})):
        model = models.TimeSeriesModel(["x0", "x1", "x2"], "y", name, **more).fit(df)
        errors[name] = model.score(df).first().mean_squared_error
        if name == "learned_trees":
            assert model.predict(df).filter("predicted IS NULL").count() == 0
    alone = models.TimeSeriesModel(["x0", "x1", "x2"], "y", "boosted_trees", {"maxIter": 20, "maxDepth": 3, "stepSize": 0.3}, impute=0.0)
    alone._inputs = lambda: alone.features  # imputation without marks
    errors["imputed"] = alone.fit(df).score(df).first().mean_squared_error
    assert errors["learned_trees"] < errors["imputed"]


def test_no_rows_constant_labels_and_empty_features(spark):
    none = spark.createDataFrame([], "a double, y double")
    assert trees.fit(none, ["a"], "y").predict(np.array([[1.0]])).tolist() == [0.0]
    flat = spark.createDataFrame([(1.0, 3.0), (None, 3.0), (float("nan"), 3.0), (2.0, None)], "a double, y double")
    found = trees.fit(flat, ["a"], "y", trees=5)
    assert len(found.trees) == 1 and found.predict(np.array([[np.nan]])).tolist() == [3.0]
    lost = spark.createDataFrame([(None, 1.0), (None, 2.0)], "a double, y double")
    assert trees.fit(lost, ["a"], "y").predict(np.array([[5.0]])).tolist() == [1.5]


def plain_attributions(ensemble, x):
    """Over all subsets: outside of a subset, a split sends a row both ways by its share of rows."""
    k = len(ensemble.features)

    def worth(tree, node, row, known):
        f = tree.feature[node]
        if f < 0:
            return tree.value[node]
        ways = [(c, tree.cover[c] / tree.cover[node]) for c in (tree.left[node], tree.right[node])]
        if f in known:
            return worth(tree, ways[0][0] if tree.goes_left(node, np.array([row[f]]))[0] else ways[1][0], row, known)
        return sum(p * worth(tree, c, row, known) for c, p in ways)

    out = np.zeros((len(x), k))
    for r, row in enumerate(x):
        v = {s: sum(worth(t, 0, row, s) for t in ensemble.trees) for n in range(k + 1) for s in itertools.combinations(range(k), n)}
        for i in range(k):
            for s in v:
                if i not in s:
                    out[r, i] += math.factorial(len(s)) * math.factorial(k - len(s) - 1) / math.factorial(k) * (v[tuple(sorted((*s, i)))] - v[s])
    return out


def test_attributions_are_those_of_all_subsets(spark):
    x, y = some_data(4, 120)
    found = trees.fit(frame(spark, x, y), ["x0", "x1", "x2"], "y", trees=4, depth=4, rate=0.7)
    got = found.attributions(x)
    assert np.allclose(got, plain_attributions(found, x), atol=1e-9)
    assert np.allclose(got.sum(axis=1), found.predict(x) - found.expected(), atol=1e-9)
    assert found.expected() == pytest.approx(found.predict(x).mean())
    again = trees.Ensemble.from_dict(found.to_dict())
    rows = frame(spark, x, y, 2).select(again.column().alias("p"), again.attribution().alias("a"), "x0", "x1", "x2").collect()
    seen = np.array([[np.nan if v is None else v for v in (r.x0, r.x1, r.x2)] for r in rows])
    assert np.allclose([r.p for r in rows], found.predict(seen)) and np.allclose([r.a for r in rows], found.attributions(seen))


def test_attributions_of_sparks_trees(spark):
    x, y = some_data(5, 200, missing=0)
    df = VectorAssembler(inputCols=["x0", "x1", "x2"], outputCol="x").transform(frame(spark, x, y))
    model = GBTRegressor(featuresCol="x", labelCol="y", maxIter=4, maxDepth=3, seed=1).fit(df)
    found = trees.of_spark(model, ["x0", "x1", "x2"])
    want = [model.predict(r.x) for r in df.select("x").collect()]
    seen = np.array([r.x.toArray() for r in df.select("x").collect()])
    assert np.allclose(found.predict(seen), want) and np.allclose(found.attributions(seen), plain_attributions(found, seen), atol=1e-9)


def test_feature_score_weighs_each_row_by_its_attributions(spark):
    x, y = some_data(6, 200)
    df = frame(spark, x, y).withColumn("location", F.lit("a")).withColumn("date_time", F.lit("2024-01-01").cast("timestamp_ntz"))
    for name, more in (("learned_trees", {"params": {"trees": 5}}), ("boosted_trees", {"params": {"maxIter": 5}, "impute": 0.0})):
        model = models.TimeSeriesModel(["x0", "x1", "x2"], "y", name, **more).fit(df)
        got = model.predict(df.withColumn("date_time", F.to_timestamp_ntz(F.concat(F.lit("2024-01-01 00:00:00."), F.lpad(F.monotonically_increasing_id() % 100000, 6, "0")))), feature_score=True)
        scores = [r.feature_score for r in got.collect()]
        assert all(s is None or 0 <= s <= 1 + 1e-12 for s in scores) and len(set(scores)) > 20  # not one weight for all rows
    row = spark.createDataFrame([([12.0, -2.0, 5.0], None, 1.0, 2.0), ([12.0, 2.0, -5.0], 1.0, None, 3.0), ([0.0, 0.0, 0.0], 1.0, 1.0, 1.0)], "w array<double>, a double, b double, c double")
    got = row.select(models.feature_score({c: F.col(c).isNotNull().cast("double") for c in "abc"}, {c: F.abs(F.col("w")[i]) for i, c in enumerate("abc")}).alias("s")).collect()
    assert [r.s for r in got] == [pytest.approx(7 / 19), pytest.approx(17 / 19), None]
