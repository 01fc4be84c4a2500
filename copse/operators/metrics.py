"""Classifier metrics from scores, as relational operators.

Input: rows with ``y`` (0 or 1) and ``score`` in [0, 1], optionally per group
columns.  Curves are running sums over the distinct scores; to keep any one
task small they are taken within ``SLICES`` slices of the score range and
shifted by the slices' totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SLICES = 1024
THRESHOLDS, LOW, HIGH = 199, 0.01, 0.99
BETA = 1.5


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def running(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per distinct score: ``pos``, ``neg`` there, ``tp``, ``fp`` at or above it, and totals ``p``, ``n``."""
    at = scores.groupBy(*by, "score").agg(F.sum("y").cast("long").alias("pos"), F.sum(1 - F.col("y")).cast("long").alias("neg"))
    at = at.withColumn("slice", F.floor(F.col("score") * SLICES))
    above = Window.partitionBy(*by).orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    slices = at.groupBy(*by, "slice").agg(F.sum("pos").alias("sp"), F.sum("neg").alias("sn"))
    slices = slices.select(*by, "slice", F.coalesce(F.sum("sp").over(above), F.lit(0)).alias("bp"), F.coalesce(F.sum("sn").over(above), F.lit(0)).alias("bn"), F.sum("sp").over(whole).alias("p"), F.sum("sn").over(whole).alias("n"))
    inside = Window.partitionBy(*by, "slice").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    at = at.withColumns({"tp": F.sum("pos").over(inside), "fp": F.sum("neg").over(inside)})
    return at.join(slices, [*by, "slice"]).select(*by, "score", "pos", "neg", (F.col("tp") + F.col("bp")).alias("tp"), (F.col("fp") + F.col("bn")).alias("fp"), "p", "n")


def roc_curve(scores: DataFrame) -> DataFrame:
    return running(scores).select(F.col("score").alias("threshold"), (F.col("fp") / F.col("n")).alias("fpr"), (F.col("tp") / F.col("p")).alias("tpr"))


def pr_curve(scores: DataFrame) -> DataFrame:
    return running(scores).select(F.col("score").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / F.col("p")).alias("recall"))


def _auc() -> Column:
    """Mann-Whitney with ties at half: each positive against the negatives below it."""
    below = F.col("n") - F.col("fp")
    return F.sum(F.col("pos") * (below + F.col("neg") / 2)) / F.first(F.col("p") * F.col("n"))


def _ap() -> Column:
    """Precision at each score, weighted by the recall gained there."""
    return F.sum(F.col("pos") / F.col("p") * (F.col("tp") / (F.col("tp") + F.col("fp"))))


def roc_auc(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return running(scores, by).groupBy(*by).agg(_auc().alias("roc_auc"))


def average_precision(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return running(scores, by).groupBy(*by).agg(_ap().alias("pr_auc"))


def brier(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg((F.col("score") - F.col("y")) * (F.col("score") - F.col("y"))).alias("brier"))


def counts_at(threshold: Column | float, pred: Column | None = None) -> dict[str, Column]:
    """tp, fp, fn, tn of score >= threshold as aggregates."""
    up = pred if pred is not None else F.col("score") >= threshold
    return {"tp": F.count_if(up & (F.col("y") == 1)), "fp": F.count_if(up & (F.col("y") == 0)), "fn": F.count_if(~up & (F.col("y") == 1)), "tn": F.count_if(~up & (F.col("y") == 0))}


def fbeta(tp: Column, fp: Column, fn: Column, beta: float = BETA) -> Column:
    p, r, b2 = ratio(tp, tp + fp), ratio(tp, tp + fn), beta * beta
    return ratio((1 + b2) * p * r, b2 * p + r)


def threshold(i: Column) -> Column:
    return LOW + i * ((HIGH - LOW) / (THRESHOLDS - 1))


def fbeta_scan(scores: DataFrame, by: tuple[str, ...] = (), beta: float = BETA) -> DataFrame:
    """``(by, t, fbeta)`` for each of the evenly spaced thresholds.

    Scores are binned by how many thresholds they reach, so each row counts
    once and not once for each threshold.
    """
    step = (HIGH - LOW) / (THRESHOLDS - 1)
    guess = F.floor((F.col("score") - LOW) / step)
    reach = F.when(F.col("score") >= threshold(guess + 1), guess + 2).when(F.col("score") >= threshold(guess), guess + 1).otherwise(guess)
    reach = F.least(F.greatest(reach, F.lit(0)), F.lit(THRESHOLDS))
    bins = scores.groupBy(*by, reach.alias("reach")).agg(F.sum("y").cast("long").alias("pos"), F.count("*").alias("n"))
    every = bins.select(*by).distinct() if by else scores.sparkSession.range(1).select()
    grid = every.select(*by, F.explode(F.sequence(F.lit(0), F.lit(THRESHOLDS - 1))).alias("i"))
    # a table of at most THRESHOLDS + 1 bins a group meets its THRESHOLDS thresholds
    met = grid.join(bins, list(by), "left") if by else grid.crossJoin(bins)
    up = F.col("reach") > F.col("i")
    agg = met.groupBy(*by, "i").agg(F.sum(F.when(up, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(up, F.col("n") - F.col("pos")).otherwise(0)).alias("fp"), F.sum(F.when(~up, F.col("pos")).otherwise(0)).alias("fn"))
    return agg.select(*by, threshold(F.col("i")).alias("t"), fbeta(F.col("tp"), F.col("fp"), F.col("fn"), beta).alias("fbeta"))


def best_threshold(scan: DataFrame, by: str = "fold") -> DataFrame:
    """Per group the first threshold of the largest F-beta."""
    best = Window.partitionBy(by).orderBy(F.desc("fbeta"), "t")
    return scan.withColumn("k", F.row_number().over(best)).where("k = 1").select(by, "t", "fbeta")


def cv_threshold(scores: DataFrame, by: str = "fold", beta: float = BETA) -> DataFrame:
    """Median over folds of the folds' best thresholds."""
    scan = fbeta_scan(scores, (by,), beta).withColumn("fbeta", F.round("fbeta", 12))
    return best_threshold(scan, by).agg(F.percentile("t", F.lit(0.5)).alias("threshold"))


def accuracy_f1(scores: DataFrame, at: float = 0.5) -> DataFrame:
    c = scores.agg(*[v.alias(k) for k, v in counts_at(at).items()])
    return c.select(((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))).alias("accuracy"), ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def confusion(scores: DataFrame, at: float = 0.5) -> DataFrame:
    """Rows: true label 0 and 1; columns: counts of each prediction."""
    c = scores.agg(*[v.alias(k) for k, v in counts_at(at).items()])
    return c.select(F.inline(F.array(F.struct(F.lit(0).alias("y"), F.col("tn").alias("pred_0"), F.col("fp").alias("pred_1")), F.struct(F.lit(1).alias("y"), F.col("fn").alias("pred_0"), F.col("tp").alias("pred_1")))))


def class_report(scores: DataFrame, at: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and support of each class, accuracy, and the macro and weighted means."""
    c = scores.agg(*[v.alias(k) for k, v in counts_at(at).items()])
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))

    def line(t: Column, f_pos: Column, f_neg: Column) -> tuple[Column, Column, Column, Column]:
        return ratio(t, t + f_pos), ratio(t, t + f_neg), ratio(2 * t, 2 * t + f_pos + f_neg), t + f_neg

    one, zero = line(tp, fp, fn), line(tn, fn, fp)
    total = tp + fp + fn + tn
    acc = (tp + tn) / total
    rows = [("0", *zero), ("1", *one), ("accuracy", acc, acc, acc, total), ("macro avg", *[(a + b) / 2 for a, b in zip(zero[:3], one[:3], strict=True)], total), ("weighted avg", *[(a * zero[3] + b * one[3]) / total for a, b in zip(zero[:3], one[:3], strict=True)], total)]
    names = ("precision", "recall", "f1", "support")
    return c.select(F.inline(F.array(*[F.struct(F.lit(k).alias("label"), *[v.cast("double" if n != "support" else "long").alias(n) for n, v in zip(names, vs, strict=True)]) for k, *vs in rows])))


def calibration_bins(scores: DataFrame, bins: int = 8) -> DataFrame:
    """Mean score and share of positives in uniform bins; a value on an inner edge is in the lower bin; empty bins are left out."""
    b = F.greatest(F.ceil(F.col("score") * bins) - 1, F.lit(0)).cast("int")
    return scores.groupBy(b.alias("bin")).agg(F.avg("score").alias("mean_predicted"), F.avg("y").alias("fraction_positive"), F.count("*").alias("n"))


def metrics_table(scores: DataFrame, by: str = "fold", label: str = "model") -> DataFrame:
    """Three settings: threshold 0.5, the cross-validated threshold, and scores alone (no accuracy nor F1)."""
    return settings_table(scores, cv_threshold(scores, by), label)


def settings_table(scores: DataFrame, cv: DataFrame, label: str) -> DataFrame:
    """The same with a cross-validated threshold (one row) from elsewhere."""
    base = running(scores).agg(_auc().alias("roc_auc"), _ap().alias("pr_auc"))
    settings = cv.select(F.inline(F.array(F.struct(F.lit(f"{label}@0.50").alias("label"), F.lit(0.5).alias("threshold")), F.struct(F.lit(f"{label}@cv_opt").alias("label"), F.col("threshold")), F.struct(F.lit(f"{label}_proba_only").alias("label"), F.lit(None).cast("double").alias("threshold")))))
    up = F.col("score") >= F.col("threshold")
    miss = F.avg((F.col("score") - F.col("y")) * (F.col("score") - F.col("y"))).alias("brier")
    c = scores.crossJoin(F.broadcast(settings)).groupBy("label", "threshold").agg(miss, *[v.alias(k) for k, v in counts_at(0, up).items()])  # three settings
    known = F.col("threshold").isNotNull()
    return c.crossJoin(base).select(
        "label", "threshold", "roc_auc", "pr_auc", "brier",
        F.when(known, (F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))).alias("accuracy"),
        F.when(known, ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"),
    )
