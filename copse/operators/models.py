"""Presence classifiers with cross-fitted calibration on Spark ML.

Each of ``FOLDS`` base models is fitted without one fold; its scores of that
fold fit a calibrator (isotonic for the forest, logistic for the others), and
the mean of the calibrated models is the probability.  The radial-basis
machine is a linear one on random Fourier features, and the forest splits on
histograms, so neither equals a library's exact fit.

A forest of up to ``WHOLE`` rows is grown a tree at a time in tasks
that hold the rows as bytes (bins); Spark ML grows all trees level by level
and sends every node through the driver.  Beyond that Spark ML fits it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.durable import cut
from . import metrics, preparation
from .preparation import digest, ranked

FOLDS = 5
TREES, DEPTH, LEAF = 600, 12, 2
#: Iterations of the elastic net, at most; the fit ends when it rests, here after some tens.
ITERATIONS = 5000
FOURIER = 128
#: Rows of a partition of training data.
ROWS = 50_000
#: Training and test rows, at most, of a forest whose trees are grown whole in tasks: 16 features take 16 MB.
WHOLE = 1_000_000
#: Bins of a feature, and trees that one task grows.
BINS, TREES_A_TASK = 32, 100


def folded(train: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Adds ``fold``, dealt evenly within each class in digest order."""
    return ranked(train, ["y"], digest(F.col("id")), "id").withColumn("fold", (F.col("rank") % folds).cast("int")).drop("rank", "size")


def balanced(train: DataFrame) -> DataFrame:
    """Adds ``weight``: rows over twice the rows of the class."""
    sizes = train.groupBy("y").agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_t"))
    return train.join(F.broadcast(sizes.crossJoin(total)), "y").withColumn("weight", F.col("_t") / (2.0 * F.col("_n"))).drop("_n", "_t")  # two rows


def forest(trees: int = TREES, seed: int = 42):
    return RandomForestClassifier(labelCol="y", numTrees=trees, maxDepth=DEPTH, featureSubsetStrategy="sqrt", minInstancesPerNode=LEAF, subsamplingRate=1.0, seed=seed)


def elastic_net(rows: int):
    return LogisticRegression(labelCol="y", elasticNetParam=0.5, regParam=1.0 / rows, weightCol="weight", standardization=False, maxIter=ITERATIONS)


def margin_machine(rows: int):
    return LinearSVC(labelCol="y", regParam=1.0 / rows, weightCol="weight", standardization=False, maxIter=50)


def fourier(df: DataFrame, cols: list[str], features: int = FOURIER, seed: int = 42) -> DataFrame:
    """Random Fourier features of a radial basis with gamma = 1 / columns, for standardised columns."""
    r = np.random.default_rng(seed)
    w, b = r.normal(0, np.sqrt(2.0 / len(cols)), (features, len(cols))), r.uniform(0, 2 * np.pi, features)
    x = F.array(*[F.col(c) for c in cols])
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in row], F.lit(float(o))) for row, o in zip(w, b, strict=True)])
    dot = lambda row: F.aggregate(F.zip_with(x, F.slice(row, 1, len(cols)), lambda a, c: a * c), F.lit(0.0), lambda s, v: s + v)
    return df.withColumn("rff", F.transform(rows, lambda row: F.cos(dot(row) + F.element_at(row, -1)) * float(np.sqrt(2.0 / features))))


def _raw(df: DataFrame) -> Column:
    col = "probability" if "probability" in df.columns else "rawPrediction"
    return vector_to_array(F.col(col))[1]


def sized(df: DataFrame) -> DataFrame:
    """Cut to a checkpoint of one partition for each ROWS rows: a fit reads it hundreds of times, and a small table in many parts is all overhead."""
    df = cut(df)
    return cut(df.repartition(df.count() // ROWS + 1))


def grow(x: np.ndarray, y: np.ndarray, r: np.random.Generator, depth: int, leaf: int, tried: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A tree on a bootstrap sample of the rows: of each node its feature (-1: leaf), the last bin that goes left, the left child (the right one follows) and the share of class 1.

    ``x``: bins (rows, features).  A node tries ``tried`` features drawn anew and
    takes the split of the greatest drop in Gini impurity; both sides keep
    ``leaf`` drawn rows at least.  All nodes of a level are split together.
    """
    n, wide = x.shape
    drawn = np.bincount(r.integers(0, n, n), minlength=n)
    rows = np.flatnonzero(drawn)
    x, y, w = x[rows], y[rows].astype(np.float64), drawn[rows].astype(np.float64)
    node = np.zeros(len(rows), np.int64)  # among the nodes of the level
    features, cuts, children, shares = [], [], [], []
    count, total = 1, 0
    for level in range(depth + 1):
        every, ones = np.bincount(node, w, count), np.bincount(node, w * y, count)
        share = ones / every
        feature, cut_at, child = np.full(count, -1), np.zeros(count, np.int64), np.zeros(count, np.int64)
        if level < depth and len(node):
            of = r.random((count, wide)).argpartition(tried - 1, axis=1)[:, :tried] if tried < wide else np.tile(np.arange(wide), (count, 1))
            best, gain = np.zeros(count, np.int64), np.full(count, 1e-12)
            for k in range(tried):
                at = node * BINS + x[np.arange(len(node)), of[node, k]]
                left, hits = (np.bincount(at, v, count * BINS).reshape(count, BINS).cumsum(1) for v in (w, w * y))
                right = every[:, None] - left
                fits = (left >= leaf) & (right >= leaf)
                with np.errstate(divide="ignore", invalid="ignore"):
                    drop = hits**2 / left + (ones[:, None] - hits) ** 2 / right - (ones**2 / every)[:, None]
                drop = np.where(fits, drop, -1.0)
                top = drop.argmax(1)
                better = drop[np.arange(count), top] > gain
                gain = np.where(better, drop[np.arange(count), top], gain)
                feature, best = np.where(better, of[:, k], feature), np.where(better, top, best)
            cut_at = best
        split = feature >= 0
        child[split] = total + count + 2 * np.arange(split.sum())
        for into, v in ((features, feature), (cuts, cut_at), (children, child), (shares, share)):
            into.append(v)
        own = split[node]
        node, x, y, w = node[own], x[own], y[own], w[own]
        right = x[np.arange(len(node)), feature[node]] > cut_at[node]
        node = child[node] - total - count + right
        total, count = total + count, 2 * int(split.sum())
        if not count:
            break
    return tuple(np.concatenate(v) for v in (features, cuts, children, shares))


def shown_by(tree: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    """The share of class 1 in the leaf of each row of bins."""
    feature, cut_at, child, share = tree
    at, go = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(go := go[feature[at[go]] >= 0]):
        here = at[go]
        at[go] = child[here] + (x[go, feature[here]] > cut_at[here])
    return share[at]


def _forest(train: DataFrame, test: DataFrame, make, features: str) -> DataFrame:
    """``(fold, held, at, id, y, s)``: scores by the forest grown without each fold, of that fold's rows (held) and of all test rows.

    A task grows TREES_A_TASK trees of one fold and scores those rows by them.
    All rows reach it as bytes, WHOLE rows at most.
    """
    spark, wide = train.sparkSession, len(train.select(vector_to_array(features)).first()[0])
    x = vector_to_array(F.col(features))
    flat = train.select(*[F.get(x, F.lit(i)).alias(f"f{i}") for i in range(wide)])
    edges = [np.unique(v) for v in flat.approxQuantile(flat.columns, [k / BINS for k in range(1, BINS)], 0.001)]

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(0).flatten().to_numpy().reshape(-1, wide)
            made = np.column_stack([np.searchsorted(e, v[:, i]) for i, e in enumerate(edges)]).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([m.tobytes() for m in made], pa.binary()), *b.columns[1:]], names=["x", "id", "y", "fold"])

    rows = lambda df, fold: df.select(x.alias("x"), "id", F.col("y").cast("double").alias("y"), fold.cast("int").alias("fold"))
    both = rows(train, F.col("fold")).unionByName(rows(test, F.lit(None)))
    of_id = both.schema["id"]
    kind = T.StructType([T.StructField("x", T.BinaryType()), of_id, T.StructField("y", T.DoubleType()), T.StructField("fold", T.IntegerType())])
    shared = spark.sparkContext.broadcast(both.mapInArrow(binned, kind).orderBy(F.col("fold").isNull(), "id", "x").toArrow().combine_chunks())
    trees, seed, depth, leaf = make.getNumTrees(), abs(make.getSeed()), make.getMaxDepth(), make.getMinInstancesPerNode()
    jobs = FOLDS * -(-trees // TREES_A_TASK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        bins = np.frombuffer(b"".join(table["x"].to_pylist()), np.uint8).reshape(-1, wide)
        fold, y = table["fold"].fill_null(-1).to_numpy(), table["y"].to_numpy()
        for job in (j for b in batches for j in b.column(0).to_pylist()):
            k, first = job % FOLDS, job // FOLDS * TREES_A_TASK
            own, shown = (fold >= 0) & (fold != k), np.flatnonzero((fold == k) | (fold < 0))
            s = np.zeros(len(shown))
            for t in range(first, min(first + TREES_A_TASK, trees)):
                s += shown_by(grow(bins[own], y[own], np.random.default_rng([seed, k, t]), depth, leaf, int(np.ceil(np.sqrt(wide)))), bins[shown])
            ids = table["id"].combine_chunks().take(pa.array(shown))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(shown), k), pa.int32()), pa.array(fold[shown] == k), pa.array(shown, pa.int64()), ids, pa.array(y[shown]), pa.array(s)], names=["fold", "held", "at", "id", "y", "s"])

    out = T.StructType([T.StructField("fold", T.IntegerType()), T.StructField("held", T.BooleanType()), T.StructField("at", T.LongType()), of_id, T.StructField("y", T.DoubleType()), T.StructField("s", T.DoubleType())])
    grown = spark.range(0, jobs, 1, jobs).mapInArrow(run, out)
    return grown.groupBy("fold", "held", "at", "id", "y").agg((F.sum("s") / trees).alias("s"))

def _by_model(train: DataFrame, test: DataFrame, make, features: str, k: int) -> tuple[DataFrame, DataFrame]:
    """Scores by the model fitted without fold ``k``: of the fold's rows (y, s) and of the test rows (id, y, s)."""
    base = make.copy({make.featuresCol: features}).fit(train.where(F.col("fold") != k))
    held, shown = base.transform(train.where(F.col("fold") == k)), base.transform(test)
    return held.select("y", _raw(held).alias("s")), shown.select("id", "y", _raw(shown).alias("s"))


def calibrated(train: DataFrame, test: DataFrame, make, isotonic: bool, features: str = "features") -> DataFrame:
    """``(id, y, probability)`` of the test rows: mean of the folds' calibrated models."""
    train = sized(balanced(folded(train)))
    parts, scored = None, None
    if isinstance(make, RandomForestClassifier) and train.count() + test.count() <= WHOLE:
        scored = cut(_forest(train, test, make, features))
    for k in range(FOLDS):
        if scored is None:
            held, shown = _by_model(train, test, make, features, k)
        else:
            held, shown = (scored.where((F.col("fold") == k) & (F.col("held") == F.lit(h))) for h in (True, False))
            held, shown = held.select("y", "s"), shown.select("id", F.col("y").cast(test.schema["y"].dataType), "s")
        one = VectorAssembler(inputCols=["s"], outputCol="v")
        if isotonic:
            fit = IsotonicRegression(featuresCol="v", labelCol="y").fit(one.transform(held))
            p = fit.transform(one.transform(shown)).select("id", "y", F.col("prediction").alias("p"))
        else:
            out = LogisticRegression(featuresCol="v", labelCol="y").fit(one.transform(held)).transform(one.transform(shown))
            p = out.select("id", "y", vector_to_array("probability")[1].alias("p"))
        parts = p if parts is None else parts.unionByName(p)
    return parts.groupBy("id", "y").agg(F.avg("p").alias("probability"))


def estimators(rows: int, trees: int = TREES) -> dict[str, tuple[object, bool, str]]:
    """Of each model the estimator, whether it is calibrated by an isotonic curve, and its column of features."""
    return {"RF": (forest(trees), True, "features"), "LogitEN": (elastic_net(rows), False, "features"), "SVM_RBF": (margin_machine(rows), False, "rff")}


def compare(train: DataFrame, test: DataFrame, trees: int = TREES) -> DataFrame:
    """The metrics of all models: fit, threshold by cross-validation on the training rows, three settings each on the test rows.

    Each of the training folds is scored by a calibrated model of the others.
    """
    train = sized(folded(train).withColumnRenamed("fold", "cv"))
    rows, out = train.count(), None
    for name, (make, isotonic, features) in estimators(rows, trees).items():
        scored = cut(calibrated(train.drop("cv"), test, make, isotonic, features)).select("y", F.col("probability").alias("score"))
        held = None
        for k in range(FOLDS):
            part = calibrated(train.where(F.col("cv") != k).drop("cv"), train.where(F.col("cv") == k).drop("cv"), make, isotonic, features)
            part = cut(part).select("y", F.col("probability").alias("score"), F.lit(k).alias("fold"))
            held = part if held is None else held.unionByName(part)
        table = metrics.settings_table(scored, metrics.cv_threshold(held), name)
        out = table if out is None else out.unionByName(table)
    return out


def importance(train: DataFrame, test: DataFrame, cols: list[str], make, isotonic: bool, repeats: int, name: str) -> DataFrame:
    """Permutation importance of a calibrated model on the test rows (id, y, cols): drop in average precision over ``repeats`` permutations, with shares and ranks.

    The fitted models score all permuted copies of the test rows in one pass.
    """
    base = test.select("id", "y", *cols)
    copies = preparation.permuted(base, cols, repeats)
    shown = base.select(F.lit("").alias("feature"), F.lit(0).alias("rep"), "id", "y", *cols).unionByName(copies.select("feature", "rep", "id", "y", *cols))
    shown = shown.select(F.struct("feature", "rep", "id").alias("id"), "y", F.array(*cols).alias("x")).withColumn("features", array_to_vector("x")).select("id", "y", "features")
    scored = cut(calibrated(train, shown, make, isotonic)).select("id.feature", "id.rep", "y", F.round("probability", 9).alias("score"))
    ap = metrics.average_precision(scored, ("feature", "rep"))
    return preparation.importance_shares(preparation.importance_table(ap.where("feature <> ''"), ap.where("feature = ''").select(F.col("pr_auc").alias("baseline_ap"))), name)
