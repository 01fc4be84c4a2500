"""Forests whose trees are grown whole in tasks."""

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.linalg import Vectors

from copse.operators import models


def test_a_tree_takes_the_best_splits():
    r = np.random.default_rng(1)
    x = r.integers(0, 32, (3000, 5)).astype(np.uint8)
    y = ((x[:, 1] > 12) & (x[:, 3] <= 20)).astype(float)
    feature, cut, child, share = models.grow(x, y, np.random.default_rng(2), 2, 1, 5)
    inner = {(f, c) for f, c in zip(feature, cut, strict=True) if f >= 0}
    assert inner == {(1, 12), (3, 20)} and set(share[feature < 0]) == {0.0, 1.0}
    assert (models.shown_by((feature, cut, child, share), x) == y).all()
    noise = r.integers(0, 2, 3000).astype(float)
    tree = models.grow(x, noise, np.random.default_rng(3), 4, 200, 2)
    assert 1 < (tree[0] < 0).sum() <= 16
    at = [models.shown_by(tree, x)]
    assert all((at[0] == s).sum() >= 100 for s in np.unique(at[0]))  # 200 drawn rows are over 100 rows
    assert models.grow(x[:1], y[:1], np.random.default_rng(4), 12, 2, 2)[0].tolist() == [-1]


def test_forest_without_spark_ml(spark, monkeypatch):
    r = np.random.default_rng(6)
    v = r.normal(size=(400, 6))
    rows = [(i, float(a[0] + a[1] * a[2] > 0), Vectors.dense(a)) for i, a in enumerate(v.tolist())]
    df = spark.createDataFrame(rows, ["id", "y", "features"])
    train, test = df.where("id < 300"), df.where("id >= 300").unionByName(df.where("id = 300"))
    want = {x.id: x.probability for x in _spark_ml(monkeypatch, train, test)}

    def refuse(*_, **__):
        raise AssertionError("all nodes would pass through the driver")

    with monkeypatch.context() as m:
        m.setattr(RandomForestClassifier, "fit", refuse)
        got = models.calibrated(train, test, models.forest(60), True)
        first, again = (sorted(tuple(x) for x in got.collect()) for _ in range(2))
    assert first == again and len(first) == 100 and got.columns == ["id", "y", "probability"]
    p, q = np.array([x[2] for x in first]), np.array([want[x[0]] for x in first])
    y = np.array([x[1] for x in first])
    assert ((p > 0.5) == y).mean() >= ((q > 0.5) == y).mean() - 0.05 and np.corrcoef(p, q)[0, 1] > 0.8


def _spark_ml(monkeypatch, train, test):
    with monkeypatch.context() as m:
        m.setattr(models, "WHOLE", 0)
        return models.calibrated(train, test, models.forest(60), True).collect()
