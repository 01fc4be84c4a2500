"""Queries of the calibrated models (rows only: SQL cannot fit them)."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..functions.durable import cut
from ..operators import models as op
from ..operators import preparation
from .registry import query
from .scores import _XS, _imputed


def _sets(spark, sf_dir):
    df = preparation.standardise(_imputed(spark, sf_dir), _XS)
    df = VectorAssembler(inputCols=_XS, outputCol="features").transform(op.fourier(df, _XS)).withColumn("rff", array_to_vector("rff"))
    df = cut(df.select("id", F.col("y").cast("double").alias("y"), "is_test", "features", "rff", *_XS))
    return df.where("not is_test"), df.where("is_test")


def _one(spark, sf_dir, name):
    train, test = _sets(spark, sf_dir)
    make, isotonic, features = op.estimators(train.count())[name]
    return op.calibrated(train, test, make, isotonic, features)


@query("rf_calibrated")
def rf_calibrated(spark, sf_dir):
    return _one(spark, sf_dir, "RF")


@query("logit_en_calibrated")
def logit_en_calibrated(spark, sf_dir):
    return _one(spark, sf_dir, "LogitEN")


@query("svm_rbf_calibrated")
def svm_rbf_calibrated(spark, sf_dir):
    return _one(spark, sf_dir, "SVM_RBF")


@query("logit_importance")
def logit_importance(spark, sf_dir):
    """Of the calibrated elastic net, with 200 permutations of each feature."""
    train, test = _sets(spark, sf_dir)
    make, isotonic, _ = op.estimators(train.count())["LogitEN"]
    return op.importance(train, test, _XS, make, isotonic, 200, "LogitEN")
