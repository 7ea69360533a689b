"""The neural regressor: gradients, independence of partitions, and what it learns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsengine.operators import models, networks


def curved(spark, n=900):
    rng = np.random.default_rng(1)
    x = rng.normal(3, 2, (n, 2))
    y = np.sin(x[:, 0]) * 5 + (x[:, 1] - 3) ** 2 + rng.normal(0, 0.1, n)
    rows = [("p", i, float(a), float(b), float(t)) for i, ((a, b), t) in enumerate(zip(x, y, strict=True))]
    rows += [("p", n, None, 1.0, 1.0), ("p", n + 1, 1.0, None, 1.0), ("p", n + 2, 1.0, 1.0, None), rows[0]]
    df = spark.createDataFrame(rows, "location string, i int, a double, b double, value double")
    return df.withColumn("date_time", F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("i")))


def test_gradient_is_that_of_differences():
    rng = np.random.default_rng(0)
    net = networks.Network(["a", "b"], np.zeros(3), np.ones(3), [(rng.normal(0, 1, (2, 4)), rng.normal(0, 1, 4)), (rng.normal(0, 1, (4, 3)), rng.normal(0, 1, 3)), (rng.normal(0, 1, (3, 1)), rng.normal(0, 1, 1))])
    x, y = rng.normal(0, 1, (20, 2)), rng.normal(0, 1, 20)
    loss = lambda: 0.5 * ((net.forward(x)[-1][:, 0] - y) ** 2).sum()
    for p, g in zip((p for layer in net.layers for p in layer), net.gradient(x, y), strict=True):
        for at in np.ndindex(p.shape):
            was = p[at]
            p[at] = was + 1e-6
            up = loss()
            p[at] = was - 1e-6
            down = loss()
            p[at] = was
            assert g[at] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-5)


def test_partitions_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(networks, "SHARD", 200)
    monkeypatch.setattr(networks, "BLOCK", 64)
    df = curved(spark)
    found = [networks.fit(df.repartition(k, "i"), ["a", "b"], "value", (5,), rounds=6, batches=2).to_dict() for k in (1, 8)]
    assert found[0] == found[1]


def test_curves_are_learned_and_saved(spark, tmp_path):
    df = curved(spark)
    net = models.TimeSeriesModel(["a", "b"], estimator="network", params={"rounds": 60, "rate": 0.08}).fit(df)
    line = models.TimeSeriesModel(["a", "b"]).fit(df)
    assert net.score(df).first().mean_squared_error < 0.5 * line.score(df).first().mean_squared_error
    got = net.predict(df)
    assert got.filter("predicted IS NULL").count() == 2 and got.count() == df.count()
    net.save(str(tmp_path / "net"))
    again = models.TimeSeriesModel.load(spark, str(tmp_path / "net"))
    assert [r.predicted for r in again.predict(df).collect()] == [r.predicted for r in got.collect()]


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], "a double, value double")
    assert networks.fit(none, ["a"], "value").predict(np.array([[1.0]])).tolist() == [0.0]
    flat = spark.createDataFrame([(1.0, 5.0, 7.0), (2.0, 5.0, 7.0)], "a double, b double, value double")
    assert networks.fit(flat, ["a", "b"], "value", rounds=3).predict(np.array([[9.0, 9.0]])).tolist() == [7.0]
