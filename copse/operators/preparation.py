"""Splits, imputation, scaling and importance tables for plot features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import metrics

TEST = 0.2


def digest(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"))


def ranked(df: DataFrame, by: list[str], order: Column, tie: str) -> DataFrame:
    """Adds ``rank`` (from 1) by a hex digest within groups, and ``size``, the group's rows.

    Ranks are made within digest prefixes and shifted by their totals, so that
    a group of any size is ranked in many tasks.
    """
    df = df.withColumns({"_d": order}).withColumn("_p", F.substring("_d", 1, 2))
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*by, "_p").agg(F.count("*").alias("_n"))
    sums = sums.select(*by, "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"), F.sum("_n").over(Window.partitionBy(*by)).alias("size"))
    df = df.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_p").orderBy("_d", tie)))
    return df.join(sums, [*by, "_p"]).withColumn("rank", F.col("_r") + F.col("_b")).drop("_d", "_p", "_r", "_b")


def stratified_split(df: DataFrame, id_col: str = "id", y: str = "y", test: float = TEST) -> DataFrame:
    """Adds boolean ``is_test``: of each class the first ``test`` share in digest order."""
    return ranked(df, [y], digest(F.col(id_col)), id_col).withColumn("is_test", F.col("rank") <= F.col("size") * test).drop("rank", "size")


def numeric_features(df: DataFrame, drop: tuple[str, ...] = ("PlotID", "plot_id", "id", "y", "is_test")) -> list[str]:
    """Numeric columns without ids and target."""
    return [c for c, t in df.dtypes if c not in drop and t in ("double", "float", "int", "bigint", "smallint", "tinyint")]


def train_medians(df: DataFrame, cols: list[str]) -> tuple[DataFrame, list[str]]:
    """One row of exact training medians; columns without any training value come back as a list and are to be dropped."""
    train = df.where("not is_test")
    row = train.agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in cols])
    empty = [c for c, v in train.agg(*[F.count(c).alias(c) for c in cols]).first().asDict().items() if v == 0]
    return row, empty


def impute(df: DataFrame, cols: list[str]) -> DataFrame:
    """Nulls of training and test rows replaced by training medians; all-null columns dropped."""
    medians, empty = train_medians(df, cols)
    kept = [c for c in cols if c not in empty]
    m = medians.select(*[F.col(c).alias(f"_{c}") for c in kept])
    others = [c for c in df.columns if c not in cols]
    return df.crossJoin(F.broadcast(m)).select(*others, *[F.coalesce(F.col(c).cast("double"), F.col(f"_{c}")).alias(c) for c in kept])  # one row


def standardise(df: DataFrame, cols: list[str]) -> DataFrame:
    """(x - mean) / population deviation of the training rows; a deviation of 0 counts as 1."""
    s = df.where("not is_test").agg(*[F.avg(c).alias(f"_m{c}") for c in cols], *[F.stddev_pop(c).alias(f"_s{c}") for c in cols])
    others = [c for c in df.columns if c not in cols]
    return df.crossJoin(F.broadcast(s)).select(*others, *[((F.col(c) - F.col(f"_m{c}")) / F.when(F.col(f"_s{c}") > 0, F.col(f"_s{c}")).otherwise(1.0)).alias(c) for c in cols])  # one row


def linear_score(cols: list[str], weights: list[float]) -> Column:
    z = F.lit(0.0)
    for c, w in zip(cols, weights, strict=True):
        z = z + F.col(c) * w
    return 1.0 / (1.0 + F.exp(-z))


def permuted(df: DataFrame, cols: list[str], repeats: int) -> DataFrame:
    """Adds ``feature`` and ``rep``: the rows once for each feature and repeat, that feature's values permuted.

    The permutation of a repeat pairs rows by their ranks in two digest orders.
    The order by id is the same for all, so rows are ranked by it once, and only
    (id, value) goes through the ranking of each feature and repeat.
    """
    to = ranked(df.withColumn("_one", F.lit(0)), ["_one"], digest(F.col("id")), "id").withColumnRenamed("rank", "k").drop("size", "_one")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in cols])).alias("p")
    values = df.select("id", pairs).select("id", "p.feature", "p.value", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("rep"))
    given = ranked(values, ["feature", "rep"], digest(F.col("id"), F.col("feature"), F.col("rep")), "id").select("feature", "rep", F.col("rank").alias("k"), "value")
    both = to.join(given, "k")
    rest = [c for c in df.columns if c not in cols]
    return both.select("feature", "rep", *rest, *[F.when(F.col("feature") == c, F.col("value")).otherwise(F.col(c)).alias(c) for c in cols])


def importance_table(ap: DataFrame, base: DataFrame) -> DataFrame:
    """Mean and population deviation of the drop from the baseline (one row) over repeats."""
    drop = F.col("baseline_ap") - F.col("pr_auc")
    return ap.crossJoin(F.broadcast(base)).groupBy("feature").agg(F.avg(drop).alias("perm_importance_mean"), F.stddev_pop(drop).alias("perm_importance_std"), F.first("baseline_ap").alias("baseline_ap"))


def permutation_importance(df: DataFrame, cols: list[str], score: Column, repeats: int) -> DataFrame:
    """Mean and population deviation of the drop in average precision when a feature's values are permuted.

    Columns: feature, perm_importance_mean, perm_importance_std, baseline_ap.
    """
    base = metrics.average_precision(df.select("y", F.round(score, 9).alias("score"))).withColumnRenamed("pr_auc", "baseline_ap")
    both = permuted(df.select("id", "y", *cols), cols, repeats)
    return importance_table(metrics.average_precision(both.select("y", "feature", "rep", F.round(score, 9).alias("score")), ("feature", "rep")), base)


def importance_shares(imp: DataFrame, model: str = "model") -> DataFrame:
    """Adds imp_pos, share_percent, rel_drop_percent and rank_percentile (100 for the first, 0 for the last)."""
    pos = F.greatest(F.col("perm_importance_mean"), F.lit(0.0))
    d = imp.select(F.lit(model).alias("model"), "*", pos.alias("imp_pos"))
    total, n = F.sum("imp_pos").over(Window.partitionBy("model")), F.count("*").over(Window.partitionBy("model"))
    i = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("perm_importance_mean"), "feature")) - 1
    return d.select(
        "model", "feature", "perm_importance_mean", "perm_importance_std", "imp_pos", "baseline_ap",
        F.when(total > 0, F.col("imp_pos") / total * 100.0).otherwise(0.0).alias("share_percent"),
        F.when(F.col("baseline_ap") > 0, F.col("imp_pos") / F.col("baseline_ap") * 100.0).otherwise(0.0).alias("rel_drop_percent"),
        F.when(n > 1, 100.0 * (1.0 - i / (n - 1))).otherwise(100.0).alias("rank_percentile"),
    )


def top_features(shares: DataFrame, k: int = 20) -> DataFrame:
    """The k most important features of each model."""
    order = Window.partitionBy("model").orderBy(F.desc("perm_importance_mean"), "feature")
    return shares.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
