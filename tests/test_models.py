"""The three calibrated models and their comparison on data that are easy to tell apart."""

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from copse.operators import models, preparation

COLS = ["x0", "x1", "x2"]


def test_models_compared(spark):
    r = np.random.default_rng(5)
    y = r.integers(0, 2, 150)
    x = r.normal(size=(150, 3))
    x[:, 0] += 3 * y
    rows = [(i, float(y[i]), *map(float, x[i]), i % 5 == 0) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, y double, x0 double, x1 double, x2 double, is_test boolean")
    df = models.fourier(df, COLS).withColumn("rff", array_to_vector("rff")).withColumn("features", array_to_vector(F.array(*COLS)))
    train, test = df.where("not is_test"), df.where("is_test")
    table = {t.label: t for t in models.compare(train.drop("is_test"), test, trees=4).collect()}
    assert set(table) == {f"{m}{s}" for m in ("RF", "LogitEN", "SVM_RBF") for s in ("@0.50", "@cv_opt", "_proba_only")}
    for m in ("RF", "LogitEN", "SVM_RBF"):
        assert table[f"{m}@0.50"].roc_auc > 0.85 and table[f"{m}_proba_only"].accuracy is None and 0.01 <= table[f"{m}@cv_opt"].threshold <= 0.99
        assert table[f"{m}@0.50"].brier < 0.2
    make, isotonic, _ = models.estimators(train.count())["LogitEN"]
    imp = {t.feature: t for t in models.importance(train, test, COLS, make, isotonic, 10, "LogitEN").collect()}
    assert imp["x0"].share_percent > 80 and imp["x0"].rank_percentile == 100 and imp["x0"].model == "LogitEN"


def test_permuted_features_keep_their_values(spark):
    df = spark.createDataFrame([(i, i % 2, float(i), float(-i)) for i in range(20)], "id long, y int, a double, b double")
    p = preparation.permuted(df, ["a", "b"], 3).collect()
    for f in "ab":
        for k in range(3):
            own = [x for x in p if x.feature == f and x.rep == k]
            assert sorted(x[f] for x in own) == sorted(float(i if f == "a" else -i) for i in range(20)) and any(x[f] != (x.id if f == "a" else -x.id) for x in own)
            assert all(x["b" if f == "a" else "a"] == (-x.id if f == "a" else x.id) for x in own)
